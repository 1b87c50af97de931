"""Sinks: fitted preprocessor + model (Spark ML persistence) and the run's result payload."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Where a table that a saved SQL stage reads is kept, next to the preprocessor.
TABLES = "{base}/{name}-tables"
_TABLE = re.compile(r"parquet\.`([^`]+)`")


def _with_tables(model: PipelineModel, place) -> PipelineModel:
    """The same stages, with every table path of their SQL replaced by ``place(path)``."""
    stages = []
    for stage in model.stages:
        statement = stage.getStatement() if isinstance(stage, SQLTransformer) else ""
        moved = _TABLE.sub(lambda m: f"parquet.`{place(m[1])}`", statement)
        stages.append(SQLTransformer(statement=moved) if moved != statement else stage)
    return PipelineModel(stages=stages)


#: The table of complete versions under an artefact folder: a row is appended once both parts are written.
MANIFEST = "manifest"
MANIFEST_SCHEMA = "at double, version string, model string, preprocessor string"


def save_artifacts(prep_model: PipelineModel, model, directory: str,
                   model_name: str = "model", preprocessor_name: str = "preprocessor") -> tuple[str, str]:
    """Write both parts in a version folder of their own under ``directory``; returns their paths.

    The version counts once its manifest row is committed, last of all: a
    failure in between leaves the former pair in place. Vocabulary tables that
    the preprocessor joins are copied next to it, so the scratch folder may go.
    """
    spark = SparkSession.getActiveSession()
    base = directory.rstrip("/")
    version = f"version-{uuid.uuid4().hex}"
    model_path, prep_path = f"{base}/{version}/{model_name}", f"{base}/{version}/{preprocessor_name}"
    tables = TABLES.format(base=f"{base}/{version}", name=preprocessor_name)
    places: dict[str, str] = {}

    def keep(path: str) -> str:
        if path not in places:
            places[path] = f"{tables}/{len(places)}"
            spark.read.parquet(path).write.parquet(places[path])
        return places[path]

    prep_model = _with_tables(prep_model, keep)
    prep_model.write().save(prep_path)
    wrapped = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    wrapped.write().save(model_path)
    row = spark.createDataFrame([(time.time(), version, model_name, preprocessor_name)], MANIFEST_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{base}/{MANIFEST}")
    return model_path, prep_path


def current_version(directory: str, model_name: str = "model", preprocessor_name: str = "preprocessor") -> str:
    """The folder of the latest complete pair of these names (the folder itself if it was written without a manifest)."""
    base = directory.rstrip("/")
    spark = SparkSession.getActiveSession()
    try:
        manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/{MANIFEST}")
    except AnalysisException:
        return base
    row = manifest.where((F.col("model") == model_name) & (F.col("preprocessor") == preprocessor_name)).orderBy(F.desc("at"), F.desc("version")).first()
    return f"{base}/{row['version']}" if row else base


def load_artifacts(directory: str, model_name: str = "model",
                   preprocessor_name: str = "preprocessor") -> tuple[PipelineModel, PipelineModel]:
    """The latest complete pair; the folder may have been moved since it was written."""
    base = current_version(directory, model_name, preprocessor_name)
    try:
        prep = PipelineModel.load(f"{base}/{preprocessor_name}")
        model = PipelineModel.load(f"{base}/{model_name}")
    except Exception as exc:  # both parts must exist
        raise RuntimeError(f"artifacts under {base} are incomplete: {exc}") from exc
    tables = TABLES.format(base=base, name=preprocessor_name)
    return _with_tables(prep, lambda path: f"{tables}/{path.rsplit('/', 1)[-1]}"), model


RESULT_SCHEMA = T.StructType([
    T.StructField("status", T.StringType(), False),
    T.StructField("actions", T.ArrayType(T.StringType()), True),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("logs", T.ArrayType(T.StringType()), True),
    T.StructField("error", T.StringType(), True),
])


def result_frame(spark: SparkSession, status: str, metrics: dict | None = None, logs: list[str] | None = None,
                 actions: list[str] | None = None, error: str | None = None) -> DataFrame:
    return spark.createDataFrame([(status, actions, metrics, logs, error)], RESULT_SCHEMA)


def write_result(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def payload_json(status: str, metrics: dict | None = None, logs: list[str] | None = None,
                 actions: list[str] | None = None, error: str | None = None) -> str:
    """The payload as sorted-key JSON text (the command-line form)."""
    body: dict = {"status": status, "logs": logs or []}
    if error is None:
        body["metrics"] = metrics or {}
        body["actions"] = actions or []
    else:
        body["error"] = error
    return json.dumps(body, sort_keys=True)
