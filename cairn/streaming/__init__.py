"""Structured Streaming: score a stream with fitted stages; running metrics."""

from cairn.streaming.scoring import running_metrics, score_stream

__all__ = ["running_metrics", "score_stream"]
