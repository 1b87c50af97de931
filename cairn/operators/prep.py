"""Preprocessing: imputation, scaling and categorical encoding, fitted on the train side.

Fit
---
All statistics come from a fixed number of distributed passes over the train
rows, independent of the number of columns:

1. one aggregation: count, missing, mean, population variance, min, max and
   an approximate distinct count of every numeric column;
2. ONE grouped job for the rest: the value/bucket histograms behind the exact
   medians (see ``cairn.operators.stats``) together with the value count of
   every categorical column, which gives both its most frequent value and its
   sorted vocabulary. A median whose histogram bucket holds several values
   adds one small fetch; numeric modes (``most_frequent``) one value count.

Scaler statistics are those of the *imputed* column. For standard and
min-max scaling they follow in closed form from pass 1 and the fill value
(pooled mean/variance of the observed values and the filled copies), so no
extra pass is needed; robust scaling runs one more quantile pass over the
imputed expression.

Apply
-----
The fitted constants become SQL literals, ordinal codes come from Spark's
string indexer (a hash lookup, whatever the number of categories).
``FittedPrep.columns(df)`` gives one double column per output feature (asking
for the columns of a one-hot encoding is asking for one column per category,
at any number); ``FittedPrep.pipeline_model()`` is a persistable Spark ML
``PipelineModel`` (SQL stage + string indexers + one-hot encoder + vector
assembler) giving the same values as a (sparse) feature vector, usable on
batch and streaming frames alike. Vocabularies too large for the plan are
``(value, code)`` tables that are joined in, their frequent categories as a small
table of proven size; both forms give the same values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.config import CategoryPolicy, MissingPolicy, ScalingPolicy
from cairn.functions.numeric import nan_to_null, strict_double_sql
from cairn.functions.text import sql_double, sql_ident, sql_string, qcol
from cairn.operators.stats import column_stats, exact_quantiles, first_pass, modes, vocabulary_table

EPS = 2.220446049250313e-16
# categories a column may have for its vocabulary to be written into the plan as literals
LITERAL_VOCAB_LIMIT = 10_000
LITERAL_VOCAB_TOTAL = 200_000
# keys over which rows that have no code to look up are dealt in a vocabulary join
NULL_SPREAD = 512


@dataclass(frozen=True)
class NumericPlan:
    name: str
    fill: float | None  # None: no imputation (drop_rows) – column kept
    center: float = 0.0
    scale: float = 1.0
    dropped: bool = False  # all-missing train column under a statistic-based fill


@dataclass(frozen=True)
class CategoricalPlan:
    name: str
    fill: str | None
    vocabulary: tuple[str, ...] = ()
    dropped: bool = False
    # large vocabularies live in a (value, code) parquet table instead of the plan
    vocab_path: str | None = None
    vocab_size: int = 0
    # its frequent categories, fewer than FREQUENT_PARTS rows
    hot_path: str | None = None

    @property
    def size(self) -> int:
        return self.vocab_size if self.vocab_path else len(self.vocabulary)


class AttachNominal(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Declare a code column as nominal with ``numValues`` categories (for the one-hot encoder)."""

    column = Param(Params._dummy(), "column", "code column", typeConverter=TypeConverters.toString)
    numValues = Param(Params._dummy(), "numValues", "number of categories", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, column=None, numValues=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c, n = self.getOrDefault(self.column), self.getOrDefault(self.numValues)
        meta = {"ml_attr": {"type": "nominal", "num_vals": int(n), "name": c}}
        return dataset.withColumn(c, F.col(c).alias(c, metadata=meta))


@dataclass
class FittedPrep:
    numeric: list[NumericPlan]
    categorical: list[CategoricalPlan]
    encode: str = "onehot"
    handle_unknown: str = "ignore"
    drop_rows_on: list[str] = field(default_factory=list)
    train_rows: int | None = None  # train rows the fit saw (after drop_rows)

    # ---- SQL text of every output column -------------------------------------------------
    def _num_sql(self, p: NumericPlan) -> str:
        x = f"nanvl(CAST({sql_ident(p.name)} AS DOUBLE), CAST(NULL AS DOUBLE))"
        if p.fill is not None:
            x = f"coalesce({x}, {sql_double(p.fill)})"
        if p.center != 0.0 or p.scale != 1.0:
            x = f"(({x} - {sql_double(p.center)}) / {sql_double(p.scale)})"
        return x

    def _cat_imputed_sql(self, p: CategoricalPlan) -> str:
        s = f"CAST({sql_ident(p.name)} AS STRING)"
        if p.fill is not None:
            s = f"coalesce({s}, {sql_string(p.fill)})"
        return s

    def _unknown_error(self, i: int, p: CategoricalPlan, s: str) -> str:
        vocab = ", ".join(sql_string(v) for v in p.vocabulary) or "CAST(NULL AS STRING)"
        known = f"{self._table_code(i, p)} IS NOT NULL" if p.vocab_path else f"coalesce({s} IN ({vocab}), false)"
        msg = sql_string(f"Found unknown categories in column {p.name} during transform")
        return f"CASE WHEN {s} IS NOT NULL AND NOT ({known}) THEN raise_error({msg}) END"

    def numeric_outputs(self) -> list[tuple[str, str]]:
        return [(p.name, self._num_sql(p)) for p in self.numeric if not p.dropped]

    def _table_plans(self) -> list[tuple[int, CategoricalPlan]]:
        return [(i, p) for i, p in enumerate(self.categorical) if p.vocab_path and not p.dropped]

    @staticmethod
    def _table_code(i: int, p: CategoricalPlan) -> str:
        return f"coalesce(__hc{i}, __vc{i})" if p.hot_path else f"__vc{i}"

    def _spread_sql(self) -> str:
        """A key over which rows are dealt by their contents and input partition (copies lie in many)."""
        cols = [p.name for p in (*self.numeric, *self.categorical)][:8]
        return f"CAST(pmod(xxhash64(spark_partition_id(), {', '.join(map(sql_ident, cols))}), {NULL_SPREAD}) AS STRING)"

    def _joins(self) -> list[tuple[str, str, str, str]]:
        """Per table that is joined in: its alias, its rows, the condition, and a hint.

        The frequent categories of a column are a table of proven size and go to
        all tasks. Their rows, and rows without a category, have nothing to look
        up in the whole vocabulary: they are dealt over ``NULL_SPREAD`` keys, so
        no category with very many rows meets in one task.
        """
        out = []
        for i, p in self._table_plans():
            s = self._cat_imputed_sql(p)
            done = f"({s} IS NULL)"
            if p.hot_path:
                out.append((f"__h{i}", f"SELECT value AS __hv{i}, code AS __hc{i} FROM parquet.`{p.hot_path}`", f"{s} = __hv{i}", "broadcast"))
                done = f"({s} IS NULL OR __hc{i} IS NOT NULL)"
            out.append((f"__j{i}", f"SELECT value AS __vv{i}, code AS __vc{i}, false AS __vd{i} FROM parquet.`{p.vocab_path}`",
                        f"CASE WHEN {done} THEN __spread ELSE {s} END = __vv{i} AND {done} = __vd{i}", ""))
        return out

    def _vocab_from_sql(self) -> str:
        """The input, with LEFT JOINs bringing each table vocabulary's codes in."""
        joins = self._joins()
        if not joins:
            return "__THIS__"
        return f"(SELECT *, {self._spread_sql()} AS __spread FROM __THIS__) AS __t" + "".join(
            f" LEFT JOIN ({rows}) AS {alias} ON {on}" for alias, rows, on, _ in joins)

    def _join_temp(self) -> list[str]:
        names = ["__spread"] if self._table_plans() else []
        for i, p in self._table_plans():
            names += [f"__vv{i}", f"__vc{i}", f"__vd{i}", *([f"__hv{i}", f"__hc{i}"] if p.hot_path else [])]
        return names

    def _with_codes(self, df: DataFrame) -> DataFrame:
        """Column form: join the table vocabularies, look up the literal ones."""
        if joins := self._joins():
            df = df.withColumn("__spread", F.expr(self._spread_sql()))
            for _, rows, on, hint in joins:
                table = df.sparkSession.sql(rows)
                df = df.join(table.hint(hint) if hint else table, F.expr(on), "left")
        for i, p in self._ordinal_plans():
            df = self._indexer(i, p).transform(df.withColumn(f"__cat_{i}", F.expr(self._cat_imputed_sql(p))))
        return df

    def _ordinal_plans(self) -> list[tuple[int, CategoricalPlan]]:
        """Literal vocabularies whose codes are looked up by an indexer."""
        if self.encode != "ordinal":
            return []
        return [(i, p) for i, p in enumerate(self.categorical) if not p.dropped and not p.vocab_path and p.vocabulary]

    def _indexer(self, i: int, p: CategoricalPlan) -> StringIndexerModel:
        return StringIndexerModel.from_labels(list(p.vocabulary), inputCol=f"__cat_{i}", outputCol=f"__ord_{i}", handleInvalid="keep")

    def _ordinal_sql(self, i: int, p: CategoricalPlan) -> str:
        """The indexer's code; it gives the vocabulary's size to unknown and missing values."""
        unknown = "-1.0D"
        if self.handle_unknown == "error":
            unknown = f"raise_error({sql_string(f'Found unknown categories in column {p.name} during transform')})"
        return (f"CASE WHEN {self._cat_imputed_sql(p)} IS NULL THEN CAST(NULL AS DOUBLE) "
                f"WHEN __ord_{i} >= {len(p.vocabulary)} THEN {unknown} ELSE __ord_{i} END")

    def _vocabulary(self, p: CategoricalPlan) -> list[str]:
        """All categories in code order (a table's are read: the caller asked for a column each)."""
        if not p.vocab_path:
            return list(p.vocabulary)
        from pyspark.sql import SparkSession

        voc = SparkSession.getActiveSession().read.parquet(p.vocab_path)
        return [r["value"] for r in voc.orderBy("code").select("value").collect()]

    def _table_index_sql(self, i: int, p: CategoricalPlan, unknown: int) -> str:
        s = self._cat_imputed_sql(p)
        own = self._table_code(i, p)
        code = f"coalesce({own}, {int(unknown)})"
        if self.handle_unknown == "error":
            msg = sql_string(f"Found unknown categories in column {p.name} during transform")
            code = f"CASE WHEN {s} IS NOT NULL AND {own} IS NULL THEN raise_error({msg}) ELSE {code} END"
        return f"CAST({code} AS DOUBLE)"

    def categorical_outputs(self) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for i, p in enumerate(self.categorical):
            if p.dropped:
                continue
            s = self._cat_imputed_sql(p)
            if self.encode == "onehot":
                guard = self._unknown_error(i, p, s) if self.handle_unknown == "error" else None
                for k, v in enumerate(self._vocabulary(p)):
                    hit = f"{self._table_code(i, p)} = {k}" if p.vocab_path else f"{s} = {sql_string(v)}"
                    e = f"CASE WHEN {hit} THEN 1.0D ELSE 0.0D END"
                    if guard and k == 0:
                        e = f"coalesce({guard}, {e})"
                    out.append((f"{p.name}_{v}", e))
            elif p.vocab_path:
                out.append((p.name, self._table_index_sql(i, p, -1)))
            elif self.encode == "ordinal":
                if p.vocabulary:
                    out.append((p.name, self._ordinal_sql(i, p)))
                else:
                    out.append((p.name, f"CASE WHEN {s} IS NOT NULL THEN -1.0D END"))
            else:
                num = strict_double_sql(s)
                msg = sql_string(f"could not convert string to float in column {p.name}")
                e = f"CASE WHEN {s} IS NOT NULL AND {num} IS NULL THEN raise_error({msg}) ELSE {num} END"
                out.append((p.name, e))
        return out

    def output_sql(self) -> list[tuple[str, str]]:
        """(output column, SQL expression) in output order: numeric block first."""
        return self.numeric_outputs() + self.categorical_outputs()

    @property
    def output_columns(self) -> list[str]:
        return [n for n, _ in self.output_sql()]

    @property
    def feature_count(self) -> int:
        """Width of the feature vector."""
        n = sum(1 for p in self.numeric if not p.dropped)
        for p in self.categorical:
            if not p.dropped:
                n += p.size if self.encode == "onehot" else 1
        return n

    def _where_sql(self) -> str:
        if not self.drop_rows_on:
            return ""
        conds = []
        for c in self.drop_rows_on:
            conds.append(f"{sql_ident(c)} IS NOT NULL")
            if any(p.name == c for p in self.numeric):
                conds.append(f"NOT isnan(CAST({sql_ident(c)} AS DOUBLE))")
        return " WHERE " + " AND ".join(conds)

    # ---- column form --------------------------------------------------------------------
    def columns(self, df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """One double column per output feature, plus the ``keep`` columns."""
        if self.drop_rows_on:
            df = df.where(self._where_sql().replace(" WHERE ", "", 1))
        df = self._with_codes(df)
        exprs = [qcol(k) for k in keep] + [F.expr(e).alias(n) for n, e in self.output_sql()]
        return df.select(*exprs)

    def imputed(self, df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """The imputed (unscaled, unencoded) feature columns, plus the ``keep`` columns."""
        exprs = [qcol(k) for k in keep]
        for p in self.numeric:
            if not p.dropped:
                x = nan_to_null(qcol(p.name).cast("double"))
                exprs.append((F.coalesce(x, F.lit(p.fill)) if p.fill is not None else x).alias(p.name))
        for p in self.categorical:
            if not p.dropped:
                s = qcol(p.name).cast("string")
                exprs.append((F.coalesce(s, F.lit(p.fill)) if p.fill is not None else s).alias(p.name))
        return df.select(*exprs)

    # ---- vector form (Spark ML) -------------------------------------------------------------
    def pipeline_model(self, features_col: str = "features", train: DataFrame | None = None) -> PipelineModel:
        """Persistable stages giving the same features as ``columns`` in one (sparse) vector."""
        select = ["*"]
        num_out = []
        for p in self.numeric:
            if not p.dropped:
                name = f"__num_{len(num_out)}"
                select.append(f"{self._num_sql(p)} AS {sql_ident(name)}")
                num_out.append(name)
        cats = [(i, p) for i, p in enumerate(self.categorical) if not p.dropped]
        cat_out: list[str] = []
        temp = self._join_temp()
        stages: list = []
        if self.encode == "onehot" and cats:
            invalid = "error" if self.handle_unknown == "error" else "keep"
            idx_out = []
            for i, p in cats:
                if p.vocab_path:
                    # code from the joined vocabulary table; unknown -> k, dropped by the encoder
                    idx = f"__idx_{i}"
                    select.append(f"{self._table_index_sql(i, p, p.vocab_size)} AS {idx}")
                    n_vals = p.vocab_size + 1 if invalid == "keep" else p.vocab_size
                    stages.append(AttachNominal(column=idx, numValues=n_vals))
                else:
                    # one indexer per column: label lists of unequal length must not be padded
                    select.append(f"{self._cat_imputed_sql(p)} AS {sql_ident(f'__cat_{i}')}")
                    temp.append(f"__cat_{i}")
                    idx = f"__idx_{i}"
                    stages.append(StringIndexerModel.from_labels(list(p.vocabulary), inputCol=f"__cat_{i}",
                                                                 outputCol=idx, handleInvalid=invalid))
                idx_out.append(idx)
            temp += idx_out
            cat_out = [f"__ohe_{i}" for i, _ in cats]
            stages.append(OneHotEncoder(inputCols=idx_out, outputCols=cat_out, dropLast=(invalid == "keep"),
                                        handleInvalid="error"))
        else:
            for i, p in self._ordinal_plans():
                select.append(f"{self._cat_imputed_sql(p)} AS __cat_{i}")
                stages.append(self._indexer(i, p))
                temp += [f"__cat_{i}", f"__ord_{i}"]
            after = []
            for i, (_, e) in enumerate(self.categorical_outputs()):
                name = f"__catv_{i}"
                (after if "__ord_" in e else select).append(f"{e} AS {sql_ident(name)}")
                cat_out.append(name)
            if after:
                stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(after)} FROM __THIS__"))
        hot = [alias for alias, _, _, hint in self._joins() if hint]
        hint = f"/*+ BROADCAST({', '.join(hot)}) */ " if hot else ""
        sql = SQLTransformer(statement=f"SELECT {hint}{', '.join(select)} FROM {self._vocab_from_sql()}{self._where_sql()}")
        assembler = VectorAssembler(inputCols=num_out + cat_out, outputCol=features_col, handleInvalid="error")
        drop = SQLTransformer(statement="SELECT * EXCEPT ({}) FROM __THIS__".format(
            ", ".join(sql_ident(c) for c in num_out + cat_out + temp)))
        from pyspark.ml import Pipeline

        pipe = Pipeline(stages=[sql, *stages, assembler, drop])
        if train is None:
            train = _empty_like(self)
        return pipe.fit(train)

    def log(self) -> str:
        return f"build_preprocessor:num={len(self.numeric)},cat={len(self.categorical)}"


def _empty_like(prep: FittedPrep) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    cols = [f"{sql_ident(p.name)} double" for p in prep.numeric] + [f"{sql_ident(p.name)} string" for p in prep.categorical]
    return spark.createDataFrame([], ", ".join(cols) if cols else "__empty int")


def _pooled(st, fill: float | None) -> tuple[float | None, float | None, float | None, float | None]:
    """Mean, population variance, min, max of the imputed column in closed form."""
    n_a, n_b = st.count, st.missing if fill is not None else 0
    if n_a == 0 and n_b == 0:
        return None, None, None, None
    if n_a == 0:
        return fill, 0.0, fill, fill
    m_a, v_a = float(st.mean), float(st.var_pop)
    if n_b == 0:
        return m_a, v_a, float(st.min), float(st.max)
    n = n_a + n_b
    mean = (n_a * m_a + n_b * fill) / n
    m2 = v_a * n_a + (fill - m_a) ** 2 * n_a * n_b / n
    return mean, m2 / n, min(float(st.min), fill), max(float(st.max), fill)


def fit_prep(
    train: DataFrame,
    numeric: list[str],
    categorical: list[str],
    missing: MissingPolicy = MissingPolicy(),
    scaling: ScalingPolicy = ScalingPolicy(),
    category: CategoryPolicy = CategoryPolicy(),
) -> FittedPrep:
    """Fit imputation, scaling and encoding on the train rows."""
    if not numeric and not categorical:
        raise ValueError("No feature columns available to build a preprocessor.")
    drop_on: list[str] = []
    if missing.numeric == "drop_rows":
        drop_on += numeric
    if missing.categorical == "drop_rows":
        drop_on += categorical
    if drop_on:
        conds = [qcol(c).isNotNull() for c in drop_on] + [~F.isnan(qcol(c).cast("double")) for c in drop_on if c in numeric]
        for cnd in conds:
            train = train.where(cnd)

    # pass 1: moments of every numeric column, distinct counts of the categorical ones
    st = column_stats(train, numeric, categorical)
    # vocabularies small enough to travel with the plan are counted in pass 2; larger ones
    # become distributed (value, code) tables
    small_cats = [c for c in categorical if st[c].approx_distinct <= LITERAL_VOCAB_LIMIT]
    # the literal vocabularies together stay within LITERAL_VOCAB_TOTAL (wide frames): the largest
    # ones move to the table path until the rest fit
    by_size = sorted(small_cats, key=lambda c: (-st[c].approx_distinct, c))
    total = sum(st[c].approx_distinct for c in small_cats)
    for c in by_size:
        if total <= LITERAL_VOCAB_TOTAL:
            break
        small_cats.remove(c)
        total -= st[c].approx_distinct
    large_cats = [c for c in categorical if c not in small_cats]
    # pass 2 (one job): median histograms of the numeric columns + value counts of the small categorical ones
    need_median = missing.numeric == "median"
    med_cols = [c for c in numeric if st[c].count] if need_median else []
    med_ranks = {c: {(st[c].count - 1) // 2, st[c].count // 2} for c in med_cols}
    hist, counts = first_pass(train, med_cols, st, small_cats, med_ranks)
    fills: dict[str, float | None] = {}
    if missing.numeric in ("mean", "median", "most_frequent"):
        if missing.numeric == "mean":
            fills = {c: st[c].mean for c in numeric}
        elif missing.numeric == "median":
            q = exact_quantiles(train, {c: [0.5] for c in numeric}, st, first=hist)
            fills = {c: q[c][0] for c in numeric}
        else:
            fills = {c: (float(v) if v is not None else None) for c, v in modes(train, numeric, True).items()}
    elif missing.numeric == "constant":
        v = 0.0 if missing.fill_value_numeric is None else float(missing.fill_value_numeric)
        fills = {c: v for c in numeric}
    else:
        fills = {c: None for c in numeric}

    plans: list[NumericPlan] = []
    robust_q: dict[str, list[float | None]] = {}
    if scaling.strategy == "robust":
        imputed = train.select(
            *[
                (F.coalesce(nan_to_null(qcol(c).cast("double")), F.lit(fills[c]).cast("double")) if fills[c] is not None
                 else nan_to_null(qcol(c).cast("double"))).alias(c)
                for c in numeric
            ]
        )
        robust_q = exact_quantiles(imputed, {c: [0.25, 0.5, 0.75] for c in numeric})
    for c in numeric:
        stat_based = missing.numeric in ("mean", "median", "most_frequent")
        if stat_based and st[c].count == 0:
            plans.append(NumericPlan(c, None, dropped=True))
            continue
        fill = fills[c]
        center, scale = 0.0, 1.0
        mean, var, lo, hi = _pooled(st[c], fill)
        if scaling.strategy == "standard" and mean is not None:
            center = mean
            std = math.sqrt(max(var, 0.0))
            scale = 1.0 if (lo == hi or std < 10 * EPS) else std
        elif scaling.strategy == "minmax" and lo is not None:
            center = lo
            scale = (hi - lo) if hi > lo else 1.0
        elif scaling.strategy == "robust" and robust_q.get(c) and robust_q[c][1] is not None:
            q25, q50, q75 = robust_q[c]
            center = q50
            iqr = q75 - q25
            scale = iqr if iqr != 0 else 1.0
        plans.append(NumericPlan(c, fill, center, scale))

    # categorical value counts (from pass 2) → mode and vocabulary
    cat_plans: list[CategoricalPlan] = []
    large_modes = modes(train, large_cats, False) if large_cats and missing.categorical == "most_frequent" else {}
    if categorical:
        for c in categorical:
            if c in large_cats:
                cat_plans.append(_large_plan(train, c, st[c], missing, category, large_modes.get(c)))
                continue
            table = counts.get(c, {})
            rows_missing = table.pop(None, 0)
            if missing.categorical == "constant":
                fill = missing.fill_value_categorical or "missing"
            elif missing.categorical == "most_frequent":
                fill = min(table.items(), key=lambda kv: (-kv[1], kv[0]))[0] if table else None
            else:
                fill = None
            if missing.categorical == "most_frequent" and not table:
                cat_plans.append(CategoricalPlan(c, None, dropped=True))
                continue
            vocab = set(table)
            if rows_missing and fill is not None:
                vocab.add(fill)
            cat_plans.append(CategoricalPlan(c, fill, tuple(sorted(vocab))))
    rows = next(iter(st.values())).rows if st else None
    return FittedPrep(plans, cat_plans, category.encode, category.handle_unknown, drop_on, rows)


def _large_plan(train: DataFrame, c: str, st, missing: MissingPolicy, category: CategoryPolicy,
                mode_value) -> CategoricalPlan:
    """Plan of a high-cardinality column: distributed mode, vocabulary as a table."""
    if missing.categorical == "constant":
        fill = missing.fill_value_categorical or "missing"
    elif missing.categorical == "most_frequent":
        fill = mode_value
    else:
        fill = None
    if missing.categorical == "most_frequent" and st.count == 0:
        return CategoricalPlan(c, None, dropped=True)
    if category.encode == "none":
        return CategoricalPlan(c, fill)
    extra = fill if (st.missing and fill is not None) else None
    path, size, hot = vocabulary_table(train, c, extra)
    return CategoricalPlan(c, fill, (), vocab_path=path, vocab_size=size, hot_path=hot)
