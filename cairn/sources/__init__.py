"""Sources and sinks: CSV/parquet scans, the encoding inventory, artifacts and result payloads."""

from cairn.sources.artifacts import load_artifacts, result_frame, save_artifacts, write_result
from cairn.sources.csv import pandas_style_names, read_csv, spark_charset
from cairn.sources.encoding import detect_bytes, encoding_inventory, read_csv_folder
from cairn.sources.tables import load_table

__all__ = [
    "detect_bytes",
    "encoding_inventory",
    "load_artifacts",
    "load_table",
    "pandas_style_names",
    "read_csv",
    "read_csv_folder",
    "result_frame",
    "save_artifacts",
    "spark_charset",
    "write_result",
]
