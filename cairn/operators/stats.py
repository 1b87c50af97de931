"""Distributed column statistics: moments, exact quantiles and modes.

Spark's exact ``percentile`` and ``mode`` aggregates build one map of all
distinct values in a single final task, which does not survive a global
aggregate over a high-cardinality column at cluster scale. The operators here
stay exact and keep every pass a partial (map-side combined) aggregation:

* ``column_stats`` – count, missing count, mean, population variance, min,
  max and an approximate distinct count for many columns in ONE pass.
* ``exact_quantiles`` – linear-interpolated quantiles.
  Low-cardinality columns: one ``groupBy(column, value).count()`` pass whose
  result is bounded by the distinct count, then cumulative counts.
  High-cardinality columns: two passes on any distribution. Spark's mergeable
  quantile sketch, whose rank error is bounded, gives every wanted rank a
  bracket of values; the second pass counts the rows below each bracket and the
  values inside it, a few ten-thousandths of the rows, and picks the exact rank.
  Where the first pass is shared with category counts (``first_pass``), order
  statistics come by histogram refinement instead: each pass counts rows per
  value bucket inside the current bracket (first pass: binary exponent x 2048
  mantissa buckets; later passes: 2048 equal-width buckets), keeps the bucket
  holding the wanted rank, and stops when the bracket holds one value or few
  enough rows to fetch.
* ``modes`` – most frequent value (smallest among ties) via a distributed
  value count and a ``min(struct(-count, value))`` reduction per column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import qcol
from cairn.functions.numeric import nan_to_null

# Distinct-value bound under which a value-count table is fetched whole.
VALUE_TABLE_LIMIT = 2_048
# relative error of the distinct estimates; they only choose a strategy (value table vs buckets,
# literal vs table vocabulary), so the default precision suffices (0.02 tripled the pass time)
HLL_RSD = 0.05
# Rows a refined bracket may hold before its values are fetched and sorted.
FETCH_LIMIT = 50_000
FETCH_TOTAL = 200_000
# Buckets per refinement pass.
BUCKETS = 2048
MAX_PASSES = 64
# histogram rows the driver may receive directly (an upper bound computed before the pass)
DIRECT_HISTOGRAM_LIMIT = 200_000


@dataclass(frozen=True)
class ColumnStats:
    rows: int
    count: int  # non-missing values
    mean: float | None
    var_pop: float | None
    min: float | None
    max: float | None
    approx_distinct: int

    @property
    def missing(self) -> int:
        return self.rows - self.count


def _num(c: str) -> Column:
    return nan_to_null(qcol(c).cast("double"))


def column_stats(df: DataFrame, columns: list[str], categorical: list[str] = ()) -> dict[str, ColumnStats]:
    """One aggregation pass over all ``columns`` (cast to double, NaN = missing).

    The columns are unpivoted to ``(column id, value)`` rows and aggregated by
    column id, so the aggregate has a fixed handful of expressions however
    many columns there are (a wide aggregate with one HyperLogLog per column
    takes longer to code-generate than to run). Partial aggregation leaves
    one row per column and partition before the shuffle. ``categorical``
    columns (text) get rows, non-missing count and approximate distinct count
    in the same pass.
    """
    categorical = list(categorical)
    if not columns and not categorical:
        return {}
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    items = [F.struct(F.lit(i).alias("cid"), _num(c).alias("x"), null_s.alias("v")) for i, c in enumerate(columns)]
    off = len(columns)
    items += [F.struct(F.lit(off + j).alias("cid"), null_d.alias("x"), qcol(c).cast("string").alias("v"))
              for j, c in enumerate(categorical)]
    x, v = F.col("x"), F.col("v")
    rows = _rows(
        df.select(F.inline(F.array(*items)))
        .groupBy("cid")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(x).alias("n"),
            F.avg(x).alias("m"),
            F.var_pop(x).alias("var"),
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
            F.approx_count_distinct(x, HLL_RSD).alias("d"),
            F.count(v).alias("nv"),
            F.approx_count_distinct(v, HLL_RSD).alias("dv"),
        )
    )
    got = {r["cid"]: r for r in rows}
    out = {}
    for i, c in enumerate(columns + categorical):
        r = got.get(i)
        if r is None:  # empty frame
            out[c] = ColumnStats(0, 0, None, None, None, None, 0)
        elif i < off:
            out[c] = ColumnStats(int(r["rows"]), int(r["n"]), r["m"], r["var"], r["lo"], r["hi"], int(r["d"]))
        else:
            out[c] = ColumnStats(int(r["rows"]), int(r["nv"]), None, None, None, None, int(r["dv"]))
    return out


#: A category with more than one part in so many of the rows is frequent; there are fewer frequent ones than that.
FREQUENT_PARTS = 1_000


def vocabulary_table(df: DataFrame, column: str, extra: str | None = None) -> tuple[str, int, str | None]:
    """Sorted distinct values of a text column with their 0-based rank, as a parquet table.

    For vocabularies too large to travel with the plan: values are counted
    (pre-aggregated; ``extra`` stands for a missing one), range-partitioned and
    sorted inside each partition (distributed sort), row ids are frozen in a
    written table, per-partition counts (one row per partition) give each
    partition's first code, and the codes are written under the shared
    checkpoint folder. The frequent values are written as a table of their own,
    which by its definition has fewer than ``FREQUENT_PARTS`` rows. Returns
    (path, vocabulary size, path of the frequent values or None).
    """
    from cairn.session import materialize, scratch_path

    spark = df.sparkSession
    value = qcol(column).cast("string")
    vals = df.select((value if extra is None else F.coalesce(value, F.lit(extra))).alias("value")).where(F.col("value").isNotNull())
    parts = max(1, spark.sparkContext.defaultParallelism)
    # with AQE the count's shuffle runs once as a query stage; the range partitioner's sampling
    # job reads its output rather than the input again (checked in the event log)
    ranged = (vals.groupBy("value").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, "value").sortWithinPartitions("value")
              .withColumn("mid", F.monotonically_increasing_id()))
    frozen = materialize(ranged, "vocab-ids")
    pid = F.shiftright(F.col("mid"), 33)
    sizes = sorted((r["pid"], r["count"], r["rows"]) for r in
                   _rows(frozen.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("rows"))))
    offsets, total, rows = [], 0, 0
    for p_, n, k in sizes:
        offsets.append((int(p_), total))
        total += int(n)
        rows += int(k)
    base = spark.createDataFrame(offsets, "pid long, base long")  # one row per partition
    coded = frozen.join(F.broadcast(base), pid == F.col("pid")).select(
        "value", (F.col("base") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("code"), "n")
    path = scratch_path(spark, "vocab")
    coded.write.parquet(path)
    frequent = spark.read.parquet(path).where(F.col("n") * FREQUENT_PARTS > rows).select("value", "code")
    if frequent.isEmpty():
        return path, total, None
    frequent_path = scratch_path(spark, "vocab-frequent")
    frequent.coalesce(1).write.parquet(frequent_path)
    return path, total, frequent_path


def _positions(n: int, p: float) -> tuple[int, int, float]:
    pos = p * (n - 1)
    lo = math.floor(pos)
    hi = math.ceil(pos)
    return lo, hi, pos


def _interpolate(lo_v: float, hi_v: float, lo: int, hi: int, pos: float) -> float:
    if lo == hi:
        return float(lo_v)
    return (hi - pos) * lo_v + (pos - lo) * hi_v


def _long_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """(cid, x) rows for the non-missing values of ``columns``."""
    items = F.array(*[F.struct(F.lit(i).alias("cid"), _num(c).alias("x")) for i, c in enumerate(columns)])
    return df.select(F.inline(items)).where(F.col("x").isNotNull())


def exact_quantiles(
    df: DataFrame,
    probs: dict[str, list[float]],
    stats: dict[str, ColumnStats] | None = None,
    accuracy: int | None = None,
    first: dict[str, dict] | None = None,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns (missing values skipped).

    ``accuracy`` switches to Spark's one-pass ``percentile_approx`` (rank error
    about 1/accuracy) for callers that prefer one pass over exactness.
    """
    columns = list(probs)
    if not columns:
        return {}
    if accuracy is not None:
        row = df.agg(*[
            F.percentile_approx(_num(c), [float(p) for p in probs[c]], int(accuracy)).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs[c]))
                for i, c in enumerate(columns)}
    stats = stats or column_stats(df, columns)
    result: dict[str, list[float | None]] = {}
    # order statistics wanted per column: rank -> value
    wanted: dict[str, set[int]] = {}
    for c in columns:
        n = stats[c].count
        if n == 0:
            result[c] = [None for _ in probs[c]]
            continue
        ranks: set[int] = set()
        for p in probs[c]:
            lo, hi, _ = _positions(n, p)
            ranks.update((lo, hi))
        wanted[c] = ranks
    if not wanted:
        return result
    found: dict[str, dict[int, float]] = {}
    if first is None:
        few = [c for c in wanted if _by_value(stats[c])]
        many = {c: r for c, r in wanted.items() if c not in few}
        found = _order_stats_by_sketch(df, many, stats) if many else {}
    # the others by their values, or by a first pass that was made already
    rest = {c: r for c, r in wanted.items() if c not in found}
    if rest:
        hist = first if first is not None else first_pass(df, list(rest), stats, [], rest)[0]
        found |= _order_stats_by_refinement(df, list(rest), rest, stats, hist)
    for c in wanted:
        n = stats[c].count
        vals = []
        for p in probs[c]:
            lo, hi, pos = _positions(n, p)
            vals.append(_interpolate(found[c][lo], found[c][hi], lo, hi, pos))
        result[c] = vals
    return result


def _by_value(s: ColumnStats) -> bool:
    """Whether a column has few enough distinct values to count them all."""
    return s.approx_distinct <= VALUE_TABLE_LIMIT or s.min == s.max


#: Accuracy of the quantile sketch: its rank error is at most one part in so many of the rows.
SKETCH_ACCURACY = 10_000
#: Columns sketched in one aggregate; a wider frame takes several in one job.
SKETCH_COLUMNS = 16


def _brackets(ranks: set[int], n: int) -> list[tuple[int, int]]:
    """Merged rank intervals that surely hold the wanted ranks, with the sketch's error on both sides."""
    slack = 2 * math.ceil(n / SKETCH_ACCURACY) + 1
    out: list[list[int]] = []
    for r in sorted(ranks):
        lo, hi = max(0, r - slack), min(n - 1, r + slack)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _order_stats_by_sketch(df: DataFrame, wanted: dict[str, set[int]], stats: dict[str, ColumnStats]) -> dict[str, dict[int, float]]:
    """Order statistics in two jobs, whatever the distribution; a column whose bracket misses a rank is left out."""
    from pyspark.sql import Window

    columns = list(wanted)
    ranks = {c: _brackets(wanted[c], stats[c].count) for c in columns}
    # pass 1: the values at the ends of the brackets
    chunks = [columns[at : at + SKETCH_COLUMNS] for at in range(0, len(columns), SKETCH_COLUMNS)]
    parts = []
    for chunk in chunks:
        asked = [F.percentile_approx(_num(c), [min(1.0, (r + 1) / stats[c].count) for pair in ranks[c] for r in pair], SKETCH_ACCURACY).alias(f"q{i}")
                 for i, c in enumerate(chunk)]
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"q{i}").alias("q")) for i, c in enumerate(chunk)])
        parts.append(df.agg(*asked).select(F.inline(pairs)))
    told = parts[0]
    for part in parts[1:]:
        told = told.unionByName(part)
    ends = {r["c"]: r["q"] for r in _rows(told)}
    # pass 2: per column the rows in the gaps (even places) and the values inside the brackets (odd places)
    keys = []
    x = F.col("x")
    place = F.lit(None).cast("int")
    for i, c in enumerate(columns):
        own = F.lit(2 * len(ranks[c]))
        for k in reversed(range(len(ranks[c]))):
            lo, hi = (float(v) for v in ends[c][2 * k : 2 * k + 2])
            first, last = ranks[c][k]
            lo = float(stats[c].min) if first == 0 else lo
            hi = float(stats[c].max) if last == stats[c].count - 1 else hi
            own = F.when(x < F.lit(lo), 2 * k).when(x <= F.lit(hi), 2 * k + 1).otherwise(own)
        keys.append(own)
    for i, own in reversed(list(enumerate(keys))):
        place = F.when(F.col("cid") == i, own).otherwise(place)
    long = _long_frame(df, columns).withColumn("place", place)
    groups = long.groupBy("cid", "place", F.when(F.col("place") % 2 == 1, x).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    inside = sum(hi - lo + 1 + 4 * math.ceil(stats[c].count / SKETCH_ACCURACY) for c in columns for lo, hi in ranks[c])
    if inside > FETCH_TOTAL:  # too many for the driver: only the values at the wanted ranks leave
        running = Window.partitionBy("cid").orderBy("place", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        asked = df.sparkSession.createDataFrame([(i, r) for i, c in enumerate(columns) for r in sorted(wanted[c])], "rcid int, rank long")
        counted = groups.withColumn("cum", F.sum("n").over(running))
        hit = counted.join(F.broadcast(asked), (F.col("cid") == F.col("rcid")) & (F.col("cum") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("cum")))
        at = {(r["cid"], r["rank"]): r["v"] for r in _rows(hit.select("cid", "rank", "v"))}
    else:
        at, cum = {}, {}
        open_ranks = {i: sorted(wanted[c]) for i, c in enumerate(columns)}
        for r in sorted(_rows(groups), key=lambda r: (r["cid"], r["place"], r["v"] is not None, r["v"] or 0.0)):
            i = r["cid"]
            cum[i] = cum.get(i, 0) + r["n"]
            while open_ranks[i] and open_ranks[i][0] < cum[i]:
                at[i, open_ranks[i].pop(0)] = r["v"]
    out = {c: {r: at.get((i, r)) for r in wanted[c]} for i, c in enumerate(columns)}
    return {c: {r: float(v) for r, v in vals.items()} for c, vals in out.items() if all(v is not None for v in vals.values())}


def first_pass(
    df: DataFrame,
    numeric: list[str],
    stats: dict[str, ColumnStats],
    categorical: list[str],
    wanted: dict[str, set[int]] | None = None,
) -> tuple[dict[str, dict[int, tuple[float, float, int, int]]], dict[str, dict]]:
    """ONE scan: value/bucket histograms of numeric columns and value counts of categorical ones.

    Numeric columns with few distinct values are keyed by the value itself;
    the others by their magnitude bucket (exponent x mantissa bits).
    Categorical columns are keyed by their text (NULL kept as a key, for the
    missing count). Every key group is partial-aggregated, so a hot value is
    one row per partition before the shuffle.

    The driver never receives a numeric histogram: a running count per column
    (window over that column's buckets) joined with the broadcast list of
    wanted ranks returns only the bucket that holds each rank. Categorical
    counts come back whole: they are the category vocabulary.

    Returns ``({numeric column: {rank: (lo, hi, bucket rows, rank within bucket)}},
    {categorical column: {value: rows}})``.
    """
    from pyspark import StorageLevel
    from pyspark.sql import Window

    wanted = wanted or {c: set() for c in numeric}
    numeric = [c for c in numeric if wanted.get(c)]
    items = []
    for i, c in enumerate(numeric):
        x = _num(c)
        s = stats[c]
        key = x if _by_value(s) else _exp_bucket(x).cast("double")
        items.append(F.struct(F.lit(i).alias("cid"), key.alias("kd"), F.lit(None).cast("string").alias("ks"), x.alias("x")))
    off = len(numeric)
    for j, c in enumerate(categorical):
        items.append(F.struct(F.lit(off + j).alias("cid"), F.lit(None).cast("double").alias("kd"),
                              qcol(c).cast("string").alias("ks"), F.lit(None).cast("double").alias("x")))
    if not items:
        return {}, {}
    groups = (
        df.select(F.inline(F.array(*items)))
        .where((F.col("cid") >= off) | F.col("x").isNotNull())
        .groupBy("cid", "kd", "ks")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    counts: dict[str, dict] = {c: {} for c in categorical}
    found: dict[str, dict[int, tuple[float, float, int, int]]] = {c: {} for c in numeric}
    bound = sum(_histogram_bound(stats[c]) for c in numeric)
    if bound <= DIRECT_HISTOGRAM_LIMIT:
        # provably small: read histograms and category counts in the same single job
        hists: dict[int, list] = {}
        for r in _rows(groups):
            if r["cid"] >= off:
                counts[categorical[r["cid"] - off]][r["ks"]] = r["n"]
            else:
                hists.setdefault(r["cid"], []).append((r["kd"], r["n"], r["lo"], r["hi"]))
        for i, c in enumerate(numeric):
            hist = sorted(hists.get(i, []))
            for rank in wanted[c]:
                cum = 0
                for _key, n, lo, hi in hist:
                    if rank < cum + n:
                        found[c][rank] = (float(lo), float(hi), int(n), int(rank - cum))
                        break
                    cum += n
        return found, counts
    both = bool(numeric) and bool(categorical)
    if both:  # two small reads of one aggregated result: keep it instead of scanning twice
        groups = groups.persist(StorageLevel.MEMORY_AND_DISK)
    if categorical:
        for r in _rows(groups.where(F.col("cid") >= off).select("cid", "ks", "n")):
            counts[categorical[r["cid"] - off]][r["ks"]] = r["n"]
    if numeric:
        spark = df.sparkSession
        ranks = spark.createDataFrame([(i, int(r)) for i, c in enumerate(numeric) for r in sorted(wanted[c])],
                                      "rcid int, rank long")
        running = Window.partitionBy("cid").orderBy("kd").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = groups.where(F.col("cid") < off).withColumn("cum", F.sum("n").over(running))
        hit = hist.join(
            F.broadcast(ranks),  # one row per wanted rank
            (F.col("cid") == F.col("rcid")) & (F.col("cum") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("cum")),
        )
        for r in _rows(hit.select("cid", "rank", "lo", "hi", "n", (F.col("rank") - (F.col("cum") - F.col("n"))).alias("k"))):
            found[numeric[r["cid"]]][int(r["rank"])] = (float(r["lo"]), float(r["hi"]), int(r["n"]), int(r["k"]))
    if both:
        groups.unpersist()
    return found, counts


def _histogram_bound(s: ColumnStats) -> int:
    """Upper bound on the first-pass histogram rows of a column, from its moments pass."""
    if s.count == 0:
        return 0
    if _by_value(s):
        return int(s.approx_distinct * 1.3) + 16  # HLL error margin (6 sigma at HLL_RSD)
    lo, hi = float(s.min), float(s.max)
    if not (math.isfinite(lo) and math.isfinite(hi)) or lo <= 0 <= hi:
        return 10**12  # magnitudes down to zero: no useful bound
    a, b = sorted((abs(lo), abs(hi)))
    binades = math.floor(math.log2(b)) - math.floor(math.log2(a)) + 3
    return binades * BUCKETS


def _exp_bucket(x: Column) -> Column:
    """Monotone bucket id from sign, binary exponent and the top mantissa bits.

    ``floor(log2|x|)`` is monotone (Java's log is semi-monotonic), and the
    mantissa fraction is clamped into its binade, so the id never decreases
    as x grows even where the rounded logarithm lands one binade off. One
    pass thus splits any spread of magnitudes into ~``BUCKETS`` buckets per
    binade.
    """
    e = F.floor(F.log2(F.abs(x)))
    frac = F.abs(x) / F.pow(F.lit(2.0), e) - F.lit(1.0)
    sub = F.least(F.greatest(F.floor(frac * F.lit(BUCKETS)), F.lit(0)), F.lit(BUCKETS - 1))
    mag = (e + F.lit(1100)) * F.lit(BUCKETS) + sub + F.lit(1)
    return (
        F.when(x == F.lit(float("inf")), F.lit(10_000_000))
        .when(x == F.lit(float("-inf")), F.lit(-10_000_000))
        .when(x > 0, mag)
        .when(x < 0, -mag)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _lin_bucket(x: Column, lo: float, hi: float) -> Column:
    width = (hi - lo) / BUCKETS
    if not math.isfinite(width) or width <= 0:
        return _exp_bucket(x)
    b = F.floor((x - F.lit(lo)) / F.lit(width))
    return F.least(F.greatest(b, F.lit(0)), F.lit(BUCKETS - 1)).cast("long")


@dataclass
class _Bracket:
    column: str
    cid: int
    rank: int  # rank within the bracket (0-based)
    lo: float
    hi: float
    count: int
    passes: int = 0

    @property
    def span(self) -> tuple[int, float, float, int]:
        return (self.cid, self.lo, self.hi, self.passes)


def _rows(df: DataFrame) -> list[dict]:
    """Small result → list of dicts through Arrow (bounded by the callers)."""
    return df.toArrow().to_pylist()


def _order_stats_by_refinement(
    df: DataFrame,
    columns: list[str],
    wanted: dict[str, set[int]],
    stats: dict[str, ColumnStats],
    first: dict[str, dict],
) -> dict[str, dict[int, float]]:
    """Order statistics by histogram refinement.

    Brackets of the same column are either identical or disjoint (they are
    buckets of one histogram), so each row falls in at most one distinct
    bracket per column: a CASE chain gives its bracket id and bucket, and one
    ``groupBy(bracket, bucket)`` pass refines every open bracket at once.
    """
    out: dict[str, dict[int, float]] = {c: {} for c in columns}
    brackets: list[tuple[str, int, _Bracket]] = []
    for i, c in enumerate(columns):
        for r in sorted(wanted[c]):
            lo, hi, n, k = first[c][r]
            # the first pass was pass 0: the bracket continues with equal-width buckets
            brackets.append((c, r, _Bracket(c, i, k, lo, hi, n, passes=1)))
    long = _long_frame(df, columns)
    x = F.col("x")
    for _ in range(MAX_PASSES):
        open_ = []
        for c, r, b in brackets:
            if b.lo == b.hi:
                out[c][r] = b.lo
            elif r not in out[c]:
                open_.append((c, r, b))
        brackets = open_
        if not brackets:
            return out
        spans = sorted({b.span for _, _, b in brackets})
        size = {sp: next(b.count for _, _, b in brackets if b.span == sp) for sp in spans}
        # fetch the smallest brackets while the rows of this pass stay within FETCH_TOTAL (many columns);
        # the others are refined once more and come back smaller
        fetch, budget = [], FETCH_TOTAL
        for sp in sorted((sp for sp in spans if size[sp] <= FETCH_LIMIT), key=lambda sp: (size[sp], sp)):
            if size[sp] > budget:
                break
            fetch.append(sp)
            budget -= size[sp]
        refine = [sp for sp in spans if sp not in fetch]
        if fetch:
            cond = None
            for cid, lo, hi, _ in fetch:
                m = (F.col("cid") == cid) & (x >= lo) & (x <= hi)
                cond = m if cond is None else (cond | m)
            got = _rows(long.where(cond))
            for c, r, b in list(brackets):
                if b.span in fetch:
                    vals = sorted(v["x"] for v in got if v["cid"] == b.cid and b.lo <= v["x"] <= b.hi)
                    out[c][r] = float(vals[b.rank])
            brackets = [t for t in brackets if t[2].span not in fetch]
        if not refine:
            continue
        gid = None
        bucket = None
        for g, (cid, lo, hi, passes) in enumerate(refine):
            m = (F.col("cid") == cid) & (x >= lo) & (x <= hi)
            bk = _exp_bucket(x) if passes == 0 else _lin_bucket(x, lo, hi)
            gid = F.when(m, F.lit(g)) if gid is None else gid.when(m, F.lit(g))
            bucket = F.when(m, bk) if bucket is None else bucket.when(m, bk)
        hist = _rows(
            long.select(gid.alias("g"), bucket.alias("b"), x)
            .where(F.col("g").isNotNull())
            .groupBy("g", "b")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        )
        per: dict[int, list] = {}
        for h in hist:
            per.setdefault(h["g"], []).append((h["b"], h["n"], h["lo"], h["hi"]))
        for g in per:
            per[g].sort()
        index = {sp: g for g, sp in enumerate(refine)}
        for _, _, b in brackets:
            g = index.get(b.span)
            if g is None:
                continue
            cum = 0
            for _bk, n, lo, hi in per[g]:
                if b.rank < cum + n:
                    b.rank -= cum
                    b.lo, b.hi, b.count = float(lo), float(hi), int(n)
                    break
                cum += n
            b.passes += 1
    raise RuntimeError("quantile refinement did not converge")


def modes(df: DataFrame, columns: list[str], numeric: bool) -> dict[str, object]:
    """Most frequent non-missing value per column; ties go to the smallest value.

    ``groupBy(column, value).count()`` is a distributed, map-side combined
    aggregation (a hot value collapses to one row per partition); the per
    column reduction ``min(struct(-count, value))`` is again partial.
    """
    if not columns:
        return {}
    if numeric:
        vals = [_num(c) for c in columns]
    else:
        vals = [qcol(c).cast("string") for c in columns]
    items = F.array(*[F.struct(F.lit(i).alias("cid"), v.alias("x")) for i, v in enumerate(vals)])
    best = (
        df.select(F.inline(items))
        .where(F.col("x").isNotNull())
        .groupBy("cid", "x")
        .count()
        .groupBy("cid")
        .agg(F.min(F.struct((-F.col("count")).alias("nc"), F.col("x").alias("x"))).alias("best"))
        .collect()
    )
    got = {r["cid"]: r["best"]["x"] for r in best}
    return {c: got.get(i) for i, c in enumerate(columns)}
