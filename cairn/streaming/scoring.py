"""Batch-fitted preprocessing + model applied to a stream.

The fitted ``PipelineModel`` stages (SQL stage, indexers, encoder, assembler,
model) are stateless row transforms, so the same objects score a streaming
frame. ``score_stream`` reads new parquet files as they arrive and appends the
predictions to a parquet sink; its checkpoint lives in the shared checkpoint
folder, so a restarted query resumes exactly once. ``running_metrics`` is the
metrics aggregation as a stateful streaming aggregation (complete mode): the
state per group is the mergeable sums behind r2 / rmse / mae.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cairn.operators.metrics import metric_columns
from cairn.session import scratch_path

from pyspark.sql import functions as F


def score_stream(
    spark: SparkSession,
    prep_model: PipelineModel,
    model: PipelineModel,
    source_path: str,
    schema: StructType,
    sink_path: str,
    keep: list[str],
    prediction: str = "prediction",
    available_now: bool = True,
    checkpoint: str | None = None,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    # bounded micro-batches, also when a large backlog is drained with availableNow
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_path)
    scored = model.transform(prep_model.transform(stream)).select(*keep, prediction)
    writer = (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or scratch_path(spark, "score-stream-ckpt"))
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(sink_path)


def running_metrics(scored: DataFrame, label: str, prediction: str = "prediction",
                    group_by: list[str] | None = None, metrics: tuple[str, ...] = ("r2", "rmse", "mae")) -> DataFrame:
    """Streaming (or batch) aggregation of the metrics; use output mode ``complete``."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    aggs = metric_columns(y, p, metrics) + [F.count(F.lit(1)).alias("n")]
    return scored.groupBy(*(group_by or [])).agg(*aggs)
