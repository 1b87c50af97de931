"""Data operators: target, profile, statistics, split, preprocessing, models, metrics."""
