"""Small frame helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder (zstd) and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> list[Column]:
    """Two independent 64-bit hashes of the whole text (null counts as empty): the identity of a text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2")]


def row_key(ident: str = "doc_id") -> Column:
    """A hash of the row's id; a null id has a key too."""
    return F.xxhash64(F.lit("row"), F.col(ident).cast("long")).alias("rid")


def text_frame(df: DataFrame, ident: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the id and the text (null as empty), so that other columns and their names play no part."""
    return df.select(
        F.col(f"`{ident}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in keep],
    )


#: Rows of an Arrow batch, unless the session asks for another number than Spark's default: texts are long.
BATCH_ROWS = 2_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends Arrow batches of at most ``BATCH_ROWS`` rows from now on, if it had Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == "10000":
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
        pa.default_memory_pool().release_unused()  # the worker may idle beside other stages' tasks

    return bounded_batches(df).mapInArrow(run, schema)


def map_arrow_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of a task's batches, for rows that were dealt and sorted before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: A document's own columns travel under this one name, so that their names cannot clash with an operator's.
ROW = "__row"


def as_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias(ROW))


def with_text(docs: DataFrame, keep: list[str], *more: Column) -> DataFrame:
    """``keep`` columns and ``more``, with the text as ``_text`` unless it travels in ``ROW`` already."""
    own = [] if ROW in keep else [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")]
    return docs.select(*[f"`{c}`" for c in keep], *own, *more)


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The text column of a batch of :func:`with_text`."""
    return batch.column("_text") if "_text" in batch.schema.names else batch.column(ROW).field("text")
