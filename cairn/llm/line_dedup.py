"""Removal of lines that many documents hold, over levelled sorted runs of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased. Keys of at least ``MIN_CHARS`` code points that at least
``MIN_DOCS`` documents hold lose all their lines except in the largest doc_id
that holds them.

1. One pass writes a row per eligible line: document, place, 128-bit key hash,
   and whether it is the document's first line of that key (found by sorting
   the document's own keys). The rows fall into ``BATCHES`` batches by doc_id,
   largest first.
2. :class:`LineRuns` takes the batches one by one. A batch is counted by key
   (pre-aggregated, so a line that every document holds is one row a task),
   dealt and sorted like the runs, and merge-anti-joined with them: a key that
   no run knows is *fresh*, its largest doc_id here is the key's holder; a known
   key only adds its count. The result is the batch's own run on level 0; every
   ``FAN`` runs of a level are compacted into one of the next. Runs are bucketed
   tables sorted by hash, so a join reads them without dealing them again.
3. The last compaction gives every key's document count and holder. Keys over
   the bound that very many documents hold go to all tasks (their number is at
   most ``HOT_KEYS``, since each accounts for one part in ``HOT_KEYS`` of all
   rows); the others meet their lines by hash.
4. The places to drop return to their document as one short array; places and
   lines are matched in time proportional to the lines.

Only DataFrame functions are used. Defined cases: a null or empty text is one
empty line; a null doc_id counts as the smallest; every row is a document, so
repeated rows count as often as they occur, and all rows that share the largest
doc_id keep the line; other columns play no part; an empty table gives an empty
result. Every pass is linear in the lines, and no group is gathered in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import shuffle_partitions, written
from cairn.session import scratch_path

MIN_CHARS = 40
MIN_DOCS = 5
#: Batches of one run over a whole table.
BATCHES = 4
#: Runs of one level that are compacted into one of the next.
FAN = 2
#: Keys sent to all tasks at most (24 bytes each).
HOT_KEYS = 100_000
#: Characters stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.trim(F.translate(line, upper, upper.lower()), F.lit(BLANK))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def identity() -> list[Column]:
    """A document: its id and its text's hash (rows that share an id may differ)."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th")]


def eligible_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, h1, h2, first): every line whose key is long enough."""
    keys = F.transform(split_lines(F.col("text")), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("pos")))
    hashed = F.transform(F.filter(keys, lambda s: F.char_length(s["k"]) >= min_chars),
                         lambda s: F.struct(F.xxhash64(s["k"]).alias("h1"), F.xxhash64(F.lit("second"), s["k"]).alias("h2"), s["pos"].alias("pos")))
    ordered = docs.select(*identity(), F.array_sort(hashed).alias("ls")).where(F.size("ls") > 0)

    def with_first(s: Column, i: Column) -> Column:
        before = F.get(F.col("ls"), i - 1)
        same = (before["h1"] == s["h1"]) & (before["h2"] == s["h2"])
        return F.struct(s["pos"].alias("pos"), s["h1"].alias("h1"), s["h2"].alias("h2"), (~F.coalesce(same, F.lit(False))).alias("first"))

    return ordered.select("doc_id", "th", F.inline(F.transform("ls", with_first)))


class LineRuns:
    """Levelled sorted runs of ``(h1, h2, n, holder, fresh)``; a key is unique within a run and fresh in one run only."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan, self.buckets = spark, fan, shuffle_partitions(spark.range(0))
        self.levels: list[list[DataFrame]] = []
        self._tables: list[str] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _run(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a bucketed table under the shared folder, sorted by hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.repartition(self.buckets, *KEY).write.format("parquet").option("compression", "zstd")
         .option("path", scratch_path(self.spark, "line-run")).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name))
        self._tables.append(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch of ``(doc_id, h1, h2, first)`` rows; returns its own run."""
        own = batch.groupBy(*KEY).agg(F.sum(F.col("first").cast("long")).alias("n"), F.max("doc_id").alias("last"))
        known = F.lit(False)
        for i, run in enumerate(self.runs):
            own = own.join(run.select(*KEY, F.lit(True).alias(f"in_{i}")).hint("merge"), [*KEY], "left")
            known = known | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        fresh = ~known
        run = self._run(own.select(*KEY, "n", F.when(fresh, F.col("last")).alias("holder"), fresh.alias("fresh")))
        self._push(0, run)
        return run

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._run(self._merged(runs)))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """The runs merge-joined one into the other: their buckets and order are alike, so nothing is dealt again."""
        rows = runs[0]
        for other in runs[1:]:
            b = other.select(*KEY, F.col("n").alias("n_b"), F.col("holder").alias("holder_b"), F.col("fresh").alias("fresh_b")).hint("merge")
            rows = rows.join(b, [*KEY], "full").select(
                *KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"),
                # one of the runs at most holds the key as fresh
                F.coalesce("holder", "holder_b").alias("holder"),
                (F.coalesce("fresh", F.lit(False)) | F.coalesce("fresh_b", F.lit(False))).alias("fresh"))
        return rows

    def totals(self) -> DataFrame | None:
        """(h1, h2, n, holder) of every key of all batches."""
        if not self.runs:
            return None
        rows = self._merged(self.runs) if len(self.runs) > 1 else self.runs[0]
        return rows.select(*KEY, "n", "holder")

    def forget(self) -> None:
        """Takes the runs' names out of the catalog; their files stay under the shared folder."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables = []


def _batched(lines: DataFrame, docs: DataFrame, batches: int) -> DataFrame:
    """``lines`` with ``batch``: ranges of doc_id of about equal size, the largest first, null ids last."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    batch = sum((F.when(F.col("doc_id") <= F.lit(c), 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    return lines.withColumn("batch", F.when(F.col("doc_id").isNull(), F.lit(batches)).otherwise(batch))


def dropped_places(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, th, drop): the places of the lines that each document loses (only documents that lose one)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lines")
    rows = _batched(eligible_lines(docs, min_chars), docs, batches)
    rows.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    schema = "doc_id long, th long, pos int, h1 long, h2 long, first boolean, batch int"
    lines = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, fan)
    for b in range(batches + 1):
        batch = lines.where(F.col("batch") == b)
        if not batch.isEmpty():
            runs.add(batch)
    totals = runs.totals()
    if totals is None:
        return spark.createDataFrame([], "doc_id long, th long, drop array<int>")
    keys = written(totals.where(F.col("n") >= min_docs), "line-keys")
    runs.forget()
    # a hot key accounts for more than one part in HOT_KEYS of all rows, so there are at most HOT_KEYS of them
    hot_from = max(1_000, lines.count() // HOT_KEYS + 1)
    hot = keys.where(F.col("n") >= hot_from).select(*KEY, F.col("holder").alias("hot_holder"), F.lit(True).alias("hot"))
    marked = lines.join(F.broadcast(hot), [*KEY], "left")
    goes = ["doc_id", "th", "pos"]
    common = marked.where("hot AND NOT (doc_id <=> hot_holder)").select(*goes)
    others = (marked.where("hot IS NULL").select(*goes, *KEY)
              .join(keys.where(F.col("n") < hot_from).select(*KEY, "holder"), [*KEY]).where("NOT (doc_id <=> holder)").select(*goes))
    # documents that are equal in id and text share their places
    places = common.unionByName(others).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop"))
    return written(places, "line-places")


def keep_lines(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) of every row of ``docs``: its text without the lines that go."""
    drops = dropped_places(docs, **settings).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "drop")
    text = docs.select(*identity(), split_lines(F.col("text")).alias("ls"))
    # merged at every size: the places grow with the lines
    both = text.join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("ls")).otherwise(F.transform(stays, lambda i: F.get(F.col("ls"), i)))
    return both.select("doc_id", F.array_join(kept, "\n").alias("kept"), F.size("ls").cast("long").alias("n_lines"),
                       F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
    rows = keep_lines(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
