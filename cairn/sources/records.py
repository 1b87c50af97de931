"""Quoted CSV records read in parallel: line breaks inside quotes do not tie a file to one task.

Whether a line starts inside quotes depends on all lines before it, but what a
line does to that is a function of two values: the state after it if it starts
outside, and if it starts inside. These functions compose, so

1. every split of a file (the text reader's own blocks) is read as a stream and
   gives one row: where it ends for both possible starts;
2. a window over the splits of each file composes them: a split that ends alike
   for both starts fixes the state, and those that swap it are counted since;
3. with its start known, every split cuts its own records. What it holds of a
   record begun before it, and the start of one that it does not end, are
   fragments, which are put together in the order of the splits.

The records are written once and parsed by Spark's own CSV expression, so fields
come out as its ``multiLine`` reader gives them. A quote opens a field only at
the field's start; text between a closing quote and the delimiter belongs to the
field; an unclosed last record ends with its file; empty records are skipped; a line
ends with ``\\n`` or ``\\r\\n``, which is ``\\n`` inside a field.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import materialize

#: Splits whose starting states are sent to all tasks at most (17 bytes each); beyond it, larger blocks are to be set.
MAX_SPLITS = 2_000_000
RECORD, OPENING, CLOSING, INSIDE = range(4)


def after_line(line: str, sep: str, inside: bool) -> bool:
    """Whether the line end stands inside quotes, for a line that starts inside or outside of them."""
    pos = 0
    while True:
        if inside:
            q = line.find('"', pos)
            if q < 0:
                return True
            if line.startswith('"', q + 1):  # a doubled quote
                pos = q + 2
                continue
            pos, inside = q + 1, False
        elif line.startswith('"', pos):
            pos, inside = pos + 1, True
            continue
        s = line.find(sep, pos)
        if s < 0:
            return False
        pos = s + len(sep)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[bytes], int]]:
    """A batch's stretches of one split: its key, the lines and the place of the first."""
    paths, starts = batch.column("path").to_pylist(), batch.column("start").to_pylist()
    lines = batch.column("line").to_pylist()
    lo = 0
    for i in range(1, len(lines) + 1):
        if i == len(lines) or starts[i] != starts[lo] or paths[i] != paths[lo]:
            yield (paths[lo], starts[lo]), lines[lo:i], lo
            lo = i


def _effects(sep: str, charset: str):
    """Per split: the state at its end if it starts outside quotes, and inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], tuple[bool, bool]] = {}
        for batch in batches:
            for key, lines, _ in _runs(batch):
                out, inside = ends.get(key, (False, True))
                for line in lines:
                    if b'"' in line:
                        text = line.decode(charset, "replace")
                        out, inside = (after_line(text, sep, s) for s in (out, inside))
                ends[key] = (out, inside)
        if ends:
            yield pa.RecordBatch.from_pydict({"path": [k[0] for k in ends], "start": [k[1] for k in ends],
                                              "out": [v[0] for v in ends.values()], "inside": [v[1] for v in ends.values()]})

    return run


def split_states(effects: DataFrame) -> DataFrame:
    """(path, start, begins): whether a split begins inside quotes, by composing those before it."""
    w = Window.partitionBy("path").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("out") == F.col("inside")
    e = effects.withColumn("swaps", F.sum(F.when(F.col("out") & ~F.col("inside"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(fixed, F.struct("out", "swaps")), ignorenulls=True).over(before)
    turned = F.coalesce(F.max("swaps").over(before), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    return e.select("path", "start", (F.coalesce(last["out"], F.lit(False)) != (turned % 2 == 1)).alias("begins"))


class _Cutter:
    """One split's lines, cut into records and fragments."""

    def __init__(self, key: tuple[str, int], begins: bool, sep: str):
        self.key, self.sep, self.inside = key, sep, begins
        self.parts: list[str] = []
        self.kind = INSIDE if begins else OPENING
        self.first = key[1] == 0 and not begins

    def rows(self, lines: list[str]) -> Iterator[tuple]:
        for line in lines:
            self.parts.append(line)
            if '"' in line or self.inside:
                self.inside = after_line(line, self.sep, self.inside)
            if not self.inside:
                yield from self._emit(CLOSING if self.kind == INSIDE else RECORD)
                self.kind = OPENING

    def rest(self) -> Iterator[tuple]:
        if self.parts:
            yield from self._emit(self.kind)

    def _emit(self, kind: int) -> Iterator[tuple]:
        text = "\n".join(self.parts)
        self.parts = []
        if kind == RECORD and not text:
            return
        yield (*self.key, kind, self.first, text)
        self.first = False


PIECES = "path string, start long, kind int, first boolean, record string"
_PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.string())])


def _cut(sep: str, charset: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Cutter | None = None
        for batch in batches:
            out: list[tuple] = []
            for key, lines, at in _runs(batch):
                if now is None or now.key != key:
                    if now is not None:
                        out += now.rest()
                    begins = batch.column("begins")[at].as_py()
                    if begins is None:
                        raise RuntimeError(f"the blocks of {key[0]} changed between two passes; read it again")
                    now = _Cutter(key, begins, sep)
                texts = [line.decode(charset, "replace").removesuffix("\r") for line in lines]
                if key[1] == 0 and texts and texts[0].startswith("﻿"):
                    texts[0] = texts[0][1:]
                out += now.rows(texts)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)
        if now is not None and (out := list(now.rest())):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    return run


def quoted_records(spark: SparkSession, paths: list[str], sep: str, charset: str) -> DataFrame:
    """(path, first, record) of every CSV record of the files; ``first`` marks a file's first one."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    effects = materialize(lines.mapInArrow(_effects(sep, charset), "path string, start long, out boolean, inside boolean"), "csv-splits")
    splits = effects.count()
    if splits > MAX_SPLITS:
        raise ValueError(f"{splits} blocks of quoted CSV: raise spark.sql.files.maxPartitionBytes so that there are at most {MAX_SPLITS}")
    states = split_states(effects).select(F.xxhash64("path").alias("_p"), F.col("start").alias("_s"), "begins")
    # a broadcast join keeps the order in which a task reads its lines
    known = lines.join(F.broadcast(states), (F.xxhash64("path") == F.col("_p")) & (F.col("start") == F.col("_s")), "left").select("path", "start", "line", "begins")
    pieces = materialize(known.mapInArrow(_cut(sep, charset), PIECES), "csv-records")
    chain = F.sum(F.when(F.col("kind") == OPENING, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("start", F.col("kind") == OPENING))
    parts = pieces.where(F.col("kind") != RECORD).withColumn("chain", chain)
    over = parts.groupBy("path", "chain").agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "record"))).alias("ps"))
    joined = over.select("path", "first", F.array_join(F.transform("ps", lambda p: p["record"]), "\n").alias("record"))
    return pieces.where(F.col("kind") == RECORD).select("path", "first", "record").unionByName(joined)


def parsed(records: DataFrame, width: int, sep: str, corrupt: str) -> DataFrame:
    """The records' fields ``_c0`` to ``_c<width-1>`` as text, and the whole record where it has another number of them."""
    schema = ", ".join([*[f"_c{i} string" for i in range(width)], f"{corrupt} string"])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*")


def surplus(record: Column, width: int, sep: str) -> Column:
    """What a record holds beyond its first ``width`` fields, null if nothing (quoted fields count as something)."""
    masked = F.regexp_replace(record, '"[^"]*"', "q")
    fields = F.split(masked, F.lit("\\Q" + sep + "\\E"), -1)
    more = F.filter(F.slice(fields, width + 1, F.greatest(F.size(fields) - width, F.lit(0))), lambda x: F.trim(x, F.lit(" \r\n")) != "")
    return F.when(F.size(more) > 0, F.array_join(more, sep))
