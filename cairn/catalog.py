"""Registered queries (Spark) and their DuckDB oracle SQL, one per operator of the workflow.

Every query reads the driver's tables (whole tables, no row subsets) or data
Spark derives from them; missing values and spoiled text are made by fixed
row rules that appear identically in the query and the oracle. Floating
results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import CategoryPolicy, MissingPolicy, ModelPolicy, PipelineConfig, ScalingPolicy, TargetSpec
from cairn.functions.numeric import parse_decimal, strict_double
from cairn.functions.text import has_cjk
from cairn.operators import split as SP
from cairn.operators.metrics import regression_metrics
from cairn.operators.models import build_estimator
from cairn.operators.prep import fit_prep
from cairn.operators.profile import column_kinds, missing_over, missing_ratios, missing_summary
from cairn.operators.target import repair_target, resolve_target, target_quality_frame
from cairn.session import scratch_path
from cairn.sources.tables import load_table

R = 6  # decimals kept for floating results on both sides


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return load_table(spark, d, name)


def _r(c: Column | str, name: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, R).alias(name)


# ---- derived frames (same rules as the SQL CTEs below) ---------------------------------------

def lineitem_missing(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when((k + n) % 7 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(k % 5 == 0, None).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(n == 3, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )


LM_CTE = """lm AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_tax,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus FROM lineitem)"""

LM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def part_frame(spark: SparkSession, d: str) -> DataFrame:
    """part with the linear signal column, a size with missing values and a type with missing values."""
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey",
        (k % 1000).cast("double").alias("pk_mod"),
        F.when(k % 9 == 0, None).otherwise(F.col("p_size").cast("double")).alias("p_size"),
        F.when(k % 13 == 0, None).otherwise(F.col("p_type")).alias("p_type"),
        "p_brand",
        "p_retailprice",
        F.col("p_size").cast("double").alias("size_full"),
    )


PART_CTE = """pf AS (SELECT p_partkey, CAST(p_partkey % 1000 AS DOUBLE) AS pk_mod,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS p_size,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS p_type,
  p_brand, p_retailprice, CAST(p_size AS DOUBLE) AS size_full FROM part)"""

# md5 split of part: first ceil(20 %) rows in md5('42:<key>') order are the test side
PART_SPLIT_CTE = PART_CTE + """,
ps AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(p_partkey AS VARCHAR)))
  <= greatest(1, least(count(*) OVER () - 1, ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)))) AS is_test FROM pf)"""


def _part_split(spark: SparkSession, d: str) -> DataFrame:
    return SP.random_split(part_frame(spark, d), 0.2, 42, "p_partkey", unique_key=True)


def _long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Wide feature columns → (ids..., feature, value) rows."""
    return df.unpivot(ids, features, "feature", "value").select(*ids, "feature", _r("value", "value"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---- A1–A3 missing profile --------------------------------------------------------------------

_RATIO_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, ROUND(AVG(CASE WHEN {c} IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS ratio FROM lm"
    for c in LM_FEATURES
)


@query("missing_profile", f"WITH {LM_CTE} {_RATIO_UNION}")
def q_missing_profile(spark, d):
    r = missing_ratios(lineitem_missing(spark, d), LM_FEATURES)
    return r.select("column_name", _r("ratio", "ratio"))


@query("missing_top5", f"""WITH {LM_CTE}, r AS ({_RATIO_UNION}),
t AS (SELECT * FROM r ORDER BY ratio DESC, column_name LIMIT 5)
SELECT 'missing_top5:' || string_agg(column_name || ':' || printf('%.3f', ratio), ',' ORDER BY ratio DESC, column_name) AS summary FROM t""")
def q_missing_top5(spark, d):
    return missing_summary(missing_ratios(lineitem_missing(spark, d), LM_FEATURES))


@query("missing_over_threshold", f"""WITH {LM_CTE}, r AS ({_RATIO_UNION})
SELECT column_name, ratio FROM r WHERE ratio > CAST(0.1 AS DOUBLE)""")
def q_missing_over(spark, d):
    r = missing_over(missing_ratios(lineitem_missing(spark, d), LM_FEATURES), 0.1)
    return r.select("column_name", _r("ratio", "ratio"))


_DL_FEATURES = ["lang", "source", "n_chars", "quality", "toxic"]


@query("missing_profile_labels", "WITH dl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
       "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) " + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, ROUND(AVG(CASE WHEN {c} IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS ratio FROM dl"
           for c in _DL_FEATURES))
def q_missing_labels(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = _t(spark, d, "labels")
    dl = docs.join(labels, "doc_id", "left")
    return missing_ratios(dl, _DL_FEATURES).select("column_name", _r("ratio", "ratio"))


# ---- S9 column kinds, S4 decimal separator, F1 coercion, F7 CJK ------------------------------

def customer_text(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    acct = F.col("c_acctbal").cast("string")
    return c.select(
        F.col("c_custkey").cast("string").alias("custkey_text"),
        "c_name",
        acct.alias("acct_text"),
        F.when(k % 100 == 7, F.lit("n/a")).otherwise(acct).alias("acct_na"),
        F.when(k % 100 == 7, F.lit("unknown")).otherwise(acct).alias("acct_bad"),
        F.col("c_nationkey").cast("string").alias("nation_text"),
        "c_mktsegment",
        F.when(F.col("c_acctbal") > 0, F.lit("True")).otherwise(F.lit("False")).alias("positive_flag"),
    )


@query("column_kinds", """WITH ct AS (SELECT CAST(c_custkey AS VARCHAR) AS custkey_text, c_name,
  CAST(c_acctbal AS VARCHAR) AS acct_text,
  CASE WHEN c_custkey % 100 = 7 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS acct_na,
  CASE WHEN c_custkey % 100 = 7 THEN 'unknown' ELSE CAST(c_acctbal AS VARCHAR) END AS acct_bad,
  CAST(c_nationkey AS VARCHAR) AS nation_text, c_mktsegment,
  CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS positive_flag FROM customer)
SELECT * FROM (VALUES
 ('custkey_text', (SELECT CASE WHEN bool_and(TRY_CAST(custkey_text AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END FROM ct)),
 ('c_name', (SELECT CASE WHEN bool_and(TRY_CAST(c_name AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END FROM ct)),
 ('acct_text', (SELECT CASE WHEN bool_and(TRY_CAST(acct_text AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END FROM ct)),
 ('acct_na', (SELECT CASE WHEN bool_and(acct_na = 'n/a' OR TRY_CAST(acct_na AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END FROM ct)),
 ('acct_bad', (SELECT CASE WHEN bool_and(TRY_CAST(acct_bad AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END FROM ct)),
 ('nation_text', (SELECT CASE WHEN bool_and(TRY_CAST(nation_text AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END FROM ct)),
 ('c_mktsegment', (SELECT CASE WHEN bool_and(TRY_CAST(c_mktsegment AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END FROM ct)),
 ('positive_flag', (SELECT CASE WHEN bool_and(positive_flag IN ('True', 'False')) THEN 'numeric' ELSE 'categorical' END FROM ct))
) AS t(column_name, kind)""")
def q_column_kinds(spark, d):
    from cairn.sources.csv import type_columns

    df = customer_text(spark, d)
    _, kinds = type_columns(df)
    return df.sparkSession.createDataFrame(list(kinds.items()), "column_name string, kind string")


@query("decimal_comma", """SELECT c_custkey,
  TRY_CAST(replace(replace(CAST(c_acctbal AS VARCHAR), '.', ','), ',', '.') AS DOUBLE) AS acctbal FROM customer""")
def q_decimal_comma(spark, d):
    c = _t(spark, d, "customer")
    text = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    return c.select("c_custkey", parse_decimal(text, ",").alias("acctbal"))


SPOILED_CTE = """sp AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'bad'
  WHEN p_partkey % 13 = 0 THEN ' ' || CAST(p_size AS VARCHAR) || ' '
  WHEN p_partkey % 17 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)"""


def part_spoiled(spark: SparkSession, d: str, modulus: int = 11) -> DataFrame:
    p = _t(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    t = (F.when(k % modulus == 0, F.lit("bad"))
         .when(k % 13 == 0, F.concat(F.lit(" "), size, F.lit(" ")))
         .when(k % 17 == 0, F.lit("")).otherwise(size))
    return p.select("p_partkey", t.alias("t"))


@query("coerce_numeric", f"WITH {SPOILED_CTE} SELECT p_partkey, TRY_CAST(trim(t) AS DOUBLE) AS value FROM sp")
def q_coerce(spark, d):
    return part_spoiled(spark, d).select("p_partkey", strict_double("t").alias("value"))


@query("cjk_flag", "SELECT doc_id, regexp_matches(text, '[぀-ヿ一-鿿ｦ-ﾝ]') AS has_cjk FROM documents")
def q_cjk(spark, d):
    return _t(spark, d, "documents").select("doc_id", has_cjk("text").alias("has_cjk"))


# ---- column statistics: moments, exact quantiles (refinement path), modes -------------------

_STAT_COLS = [("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("orders", "o_totalprice"), ("part", "p_size")]


@query("column_moments", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n, ROUND(avg({c}), 6) AS mean, ROUND(var_pop({c}), 4) AS var_pop, "
    f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM {t}" for t, c in _STAT_COLS))
def q_column_moments(spark, d):
    from cairn.operators.stats import column_stats

    rows = []
    for t, c in _STAT_COLS:
        st = column_stats(_t(spark, d, t), [c])[c]
        rows.append((c, st.count, st.mean, st.var_pop, st.min, st.max))
    out = spark.createDataFrame(rows, "column_name string, n long, mean double, var_pop double, min_value double, max_value double")
    return out.select("column_name", "n", _r("mean", "mean"), F.round("var_pop", 4).alias("var_pop"), "min_value", "max_value")


_QPROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@query("quantiles_exact", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, ROUND(quantile_cont({c}, {p}), 6) AS value FROM {t}"
    for t, c in _STAT_COLS for p in _QPROBS))
def q_quantiles(spark, d):
    from cairn.operators.stats import exact_quantiles

    rows = []
    for t, c in _STAT_COLS:
        got = exact_quantiles(_t(spark, d, t), {c: _QPROBS})[c]
        rows += [(c, float(p), float(v)) for p, v in zip(_QPROBS, got)]
    out = spark.createDataFrame(rows, "column_name string, prob double, value double")
    return out.select("column_name", "prob", _r("value", "value"))


@query("column_modes", """SELECT * FROM (SELECT 'l_quantity' AS column_name, CAST(l_quantity AS VARCHAR) AS mode_value FROM lineitem
  GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'l_shipmode_day', CAST(dayofweek(l_shipdate) AS VARCHAR) FROM lineitem
  GROUP BY dayofweek(l_shipdate) ORDER BY count(*) DESC, dayofweek(l_shipdate) LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)""")
def q_modes(spark, d):
    from cairn.operators.stats import modes

    li = _t(spark, d, "lineitem").select("l_quantity", (F.dayofweek("l_shipdate") - 1).alias("l_shipmode_day"))
    o = _t(spark, d, "orders")
    num = modes(li, ["l_quantity", "l_shipmode_day"], True)
    cat = modes(o, ["o_orderpriority"], False)
    rows = [("l_quantity", str(num["l_quantity"])), ("l_shipmode_day", str(int(num["l_shipmode_day"]))),
            ("o_orderpriority", cat["o_orderpriority"])]
    return spark.createDataFrame(rows, "column_name string, mode_value string")


# ---- A4 gate, A5 median repair, P1–P3 target choice -------------------------------------------

_GATE = """SELECT '{v}' AS variant, count(*) AS n, count(*) - count(y) AS n_bad,
  ROUND((count(*) - count(y)) / CAST(count(*) AS DOUBLE), 6) AS nan_ratio,
  (count(*) - count(y)) / CAST(count(*) AS DOUBLE) <= CAST(0.2 AS DOUBLE) AS passed
FROM (SELECT TRY_CAST(trim(CASE WHEN p_partkey % {m} = 0 THEN 'bad' WHEN p_partkey % 13 = 0 THEN ' ' || CAST(p_size AS VARCHAR) || ' '
  WHEN p_partkey % 17 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END) AS DOUBLE) AS y FROM part)"""


@query("target_gate", _GATE.format(v="mod11", m=11) + " UNION ALL " + _GATE.format(v="mod3", m=3))
def q_target_gate(spark, d):
    a = target_quality_frame(part_spoiled(spark, d, 11), "t", 0.2).select(F.lit("mod11").alias("variant"), "*")
    b = target_quality_frame(part_spoiled(spark, d, 3), "t", 0.2).select(F.lit("mod3").alias("variant"), "*")
    return a.unionByName(b).select("variant", "n", "n_bad", _r("nan_ratio", "nan_ratio"), "passed")


@query("target_impute", f"""WITH {SPOILED_CTE}, y AS (SELECT p_partkey, TRY_CAST(trim(t) AS DOUBLE) AS y FROM sp)
SELECT p_partkey, COALESCE(y, (SELECT median(y) FROM y)) AS target FROM y""")
def q_target_impute(spark, d):
    fixed, _ = repair_target(part_spoiled(spark, d), "t")
    return fixed.select("p_partkey", F.col("t").alias("target"))


@query("target_by_name", "SELECT o_orderkey, o_totalprice AS label FROM orders")
def q_target_by_name(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("foo_y"),
                                      F.col("o_totalprice").alias("Target"), "o_orderstatus")
    t = resolve_target(o.columns, TargetSpec("by_name_heuristic"))
    return o.select("o_orderkey", F.col(t).alias("label"))


@query("target_last", "SELECT o_orderkey, o_totalprice AS label FROM orders")
def q_target_last(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = resolve_target(o.columns, TargetSpec("last_column"))
    return o.select("o_orderkey", F.col(t).alias("label"))


# ---- I1–I6 imputation, C1–C3 scaling ---------------------------------------------------------

def _impute_query(numeric: list[str], categorical: list[str], missing: MissingPolicy):
    def run(spark, d):
        lm = lineitem_missing(spark, d)
        prep = fit_prep(lm, numeric, categorical, missing, ScalingPolicy("none"), CategoryPolicy("none"))
        out = prep.imputed(lm, keep=["l_orderkey", "l_linenumber"])
        cols = [_r(c, c) if c in numeric else F.col(c) for c in numeric + categorical]
        return out.select("l_orderkey", "l_linenumber", *cols)
    return run


def _num_sql(fill_q: str, fill_d: str) -> str:
    return (f"WITH {LM_CTE} SELECT l_orderkey, l_linenumber, ROUND(COALESCE(l_quantity, ({fill_q})), 6) AS l_quantity, "
            f"ROUND(COALESCE(l_discount, ({fill_d})), 6) AS l_discount FROM lm")


def _mode_sql(c: str) -> str:
    return f"SELECT {c} FROM lm WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"


Q["impute_mean"] = _impute_query(["l_quantity", "l_discount"], [], MissingPolicy(numeric="mean"))
SQL["impute_mean"] = _num_sql("SELECT avg(l_quantity) FROM lm", "SELECT avg(l_discount) FROM lm")
Q["impute_median"] = _impute_query(["l_quantity", "l_discount"], [], MissingPolicy(numeric="median"))
SQL["impute_median"] = _num_sql("SELECT median(l_quantity) FROM lm", "SELECT median(l_discount) FROM lm")
Q["impute_mode"] = _impute_query(["l_quantity", "l_discount"], [], MissingPolicy(numeric="most_frequent"))
SQL["impute_mode"] = _num_sql(_mode_sql("l_quantity"), _mode_sql("l_discount"))
Q["impute_constant"] = _impute_query(["l_quantity", "l_discount"], [], MissingPolicy(numeric="constant", fill_value_numeric=-1.5))
SQL["impute_constant"] = _num_sql("SELECT CAST(-1.5 AS DOUBLE)", "SELECT CAST(-1.5 AS DOUBLE)")
Q["impute_cat_mode"] = _impute_query([], ["l_returnflag"], MissingPolicy(categorical="most_frequent"))
SQL["impute_cat_mode"] = (f"WITH {LM_CTE} SELECT l_orderkey, l_linenumber, "
                          f"COALESCE(l_returnflag, ({_mode_sql('l_returnflag')})) AS l_returnflag FROM lm")
Q["impute_cat_constant"] = _impute_query([], ["l_returnflag"], MissingPolicy(categorical="constant"))
SQL["impute_cat_constant"] = f"WITH {LM_CTE} SELECT l_orderkey, l_linenumber, COALESCE(l_returnflag, 'missing') AS l_returnflag FROM lm"


def _scale_query(strategy: str):
    def run(spark, d):
        lm = lineitem_missing(spark, d)
        prep = fit_prep(lm, ["l_quantity", "l_extendedprice"], [], MissingPolicy(numeric="median"), ScalingPolicy(strategy))
        out = prep.columns(lm, keep=["l_orderkey", "l_linenumber"])
        return out.select("l_orderkey", "l_linenumber", _r("l_quantity", "l_quantity"), _r("l_extendedprice", "l_extendedprice"))
    return run


_SCALE_BASE = f"""WITH {LM_CTE}, f AS (SELECT l_orderkey, l_linenumber,
  COALESCE(l_quantity, (SELECT median(l_quantity) FROM lm)) AS q, l_extendedprice AS e FROM lm)"""
Q["scale_standard"] = _scale_query("standard")
SQL["scale_standard"] = _SCALE_BASE + """, s AS (SELECT avg(q) AS cq, stddev_pop(q) AS sq, avg(e) AS ce, stddev_pop(e) AS se FROM f)
SELECT l_orderkey, l_linenumber, ROUND((q - cq) / sq, 6) AS l_quantity, ROUND((e - ce) / se, 6) AS l_extendedprice FROM f, s"""
Q["scale_minmax"] = _scale_query("minmax")
SQL["scale_minmax"] = _SCALE_BASE + """, s AS (SELECT min(q) AS cq, max(q) - min(q) AS sq, min(e) AS ce, max(e) - min(e) AS se FROM f)
SELECT l_orderkey, l_linenumber, ROUND((q - cq) / sq, 6) AS l_quantity, ROUND((e - ce) / se, 6) AS l_extendedprice FROM f, s"""
Q["scale_robust"] = _scale_query("robust")
SQL["scale_robust"] = _SCALE_BASE + """, s AS (SELECT quantile_cont(q, 0.5) AS cq, quantile_cont(q, 0.75) - quantile_cont(q, 0.25) AS sq,
  quantile_cont(e, 0.5) AS ce, quantile_cont(e, 0.75) - quantile_cont(e, 0.25) AS se FROM f)
SELECT l_orderkey, l_linenumber, ROUND((q - cq) / sq, 6) AS l_quantity, ROUND((e - ce) / se, 6) AS l_extendedprice FROM f, s"""


# ---- C5/C7 encoding with a category unseen in the fit ------------------------------------------

@query("onehot", """WITH v AS (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#2')
SELECT p_partkey, 'p_brand_' || v.p_brand AS feature,
  CASE WHEN part.p_brand = v.p_brand THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value
FROM part CROSS JOIN v""")
def q_onehot(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand")
    prep = fit_prep(p.where(F.col("p_brand") != "Brand#2"), [], ["p_brand"], category=CategoryPolicy("onehot", "ignore"))
    wide = prep.columns(p, keep=["p_partkey"])
    return _long(wide, ["p_partkey"], prep.output_columns)


@query("ordinal", """WITH v AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#2'))
SELECT p_partkey, COALESCE(v.code, CAST(-1 AS DOUBLE)) AS p_brand FROM part LEFT JOIN v ON part.p_brand = v.p_brand""")
def q_ordinal(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand")
    prep = fit_prep(p.where(F.col("p_brand") != "Brand#2"), [], ["p_brand"], category=CategoryPolicy("ordinal", "ignore"))
    return prep.columns(p, keep=["p_partkey"])


def _line_text(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with a unique text column: one category per line (60,000 at sf0.01)."""
    li = _t(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("line_code"),
    )


@query("ordinal_large", """WITH v AS (SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS k FROM lineitem WHERE l_returnflag <> 'R'))
SELECT l_orderkey, l_linenumber, COALESCE(v.code, CAST(-1 AS DOUBLE)) AS line_code
FROM lineitem LEFT JOIN v ON CAST(lineitem.l_orderkey * 10 + lineitem.l_linenumber AS VARCHAR) = v.k""")
def q_ordinal_large(spark, d):
    """Ordinal codes of a column with more categories than a literal vocabulary holds (table + join path)."""
    li = _line_text(spark, d)
    prep = fit_prep(li.where(F.col("l_returnflag") != "R"), [], ["line_code"],
                    category=CategoryPolicy("ordinal", "ignore"))
    return prep.columns(li, keep=["l_orderkey", "l_linenumber"])


_HOT_CODE = "CASE WHEN l_orderkey % 5 < 3 THEN 'hot' WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END"


@query("hot_category", f"""WITH li AS (SELECT *, COALESCE({_HOT_CODE}, 'missing') AS k FROM lineitem),
v AS (SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT k FROM li WHERE l_returnflag <> 'R'))
SELECT l_orderkey, l_linenumber, COALESCE(v.code, CAST(-1 AS DOUBLE)) AS as_column, COALESCE(v.code, CAST(-1 AS DOUBLE)) AS in_vector
FROM li LEFT JOIN v USING (k)""")
def q_hot_category(spark, d):
    """A table vocabulary with 60 % of the rows in one category and a frequent missing one, as column and in the vector."""
    from pyspark.ml.functions import vector_to_array

    li = _t(spark, d, "lineitem").withColumn("line_code", F.expr(_HOT_CODE.replace("VARCHAR", "STRING")))
    keys = ["l_orderkey", "l_linenumber"]
    prep = fit_prep(li.where(F.col("l_returnflag") != "R"), [], ["line_code"], MissingPolicy(categorical="constant", fill_value_categorical="missing"),
                    category=CategoryPolicy("ordinal", "ignore"))
    vector = prep.pipeline_model("features", li).transform(li).select(*keys, "line_code", vector_to_array("features")[0].alias("in_vector"))
    return prep.columns(vector, keep=[*keys, "in_vector"]).withColumnRenamed("line_code", "as_column")


# ---- D1–D6 split --------------------------------------------------------------------------------

_EDGES = "e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM orders)"
_BIN = ("CAST((o_totalprice > q[2])::INTEGER + (o_totalprice > q[3])::INTEGER + (o_totalprice > q[4])::INTEGER"
        " + (o_totalprice > q[5])::INTEGER AS INTEGER)")
_QUOTA = f"""{_EDGES},
b AS (SELECT o_orderkey, {_BIN} AS bin FROM orders, e),
s AS (SELECT bin, count(*) AS size FROM b GROUP BY bin),
t AS (SELECT sum(size) AS n, greatest(1, least(sum(size) - 1, ceil(sum(size) * CAST(0.2 AS DOUBLE)))) AS tc FROM s),
f AS (SELECT bin, size, least(size, floor(size * (CAST(tc AS DOUBLE) / n))) AS fl,
  size * (CAST(tc AS DOUBLE) / n) - least(size, floor(size * (CAST(tc AS DOUBLE) / n))) AS frac, tc FROM s, t),
r AS (SELECT *, tc - sum(fl) OVER () AS rem FROM f),
qt AS (SELECT bin, size, CAST(fl + least(size - fl, greatest(0, rem - coalesce(sum(size - fl) OVER
  (ORDER BY frac DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS quota FROM r)"""


@query("target_bins", f"WITH {_EDGES} SELECT o_orderkey, {_BIN} AS bin FROM orders, e")
def q_target_bins(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    edges = SP.stratify_edges(o, "o_totalprice")
    return o.select("o_orderkey", SP.target_bins(o, "o_totalprice", edges).alias("bin"))


@query("strata_quota", f"WITH {_QUOTA} SELECT bin, size, quota FROM qt")
def q_strata_quota(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    edges = SP.stratify_edges(o, "o_totalprice")
    return SP.strata_table(o, "o_totalprice", edges, 0.2)


@query("split_random", """SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)))
  <= greatest(1, least(count(*) OVER () - 1, ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)))) AS is_test FROM orders""")
def q_split_random(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return SP.random_split(o, 0.2, 42, "o_orderkey", unique_key=True)


@query("split_stratified", f"""WITH {_QUOTA},
h AS (SELECT o_orderkey, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) AS rn FROM b)
SELECT o_orderkey, rn <= quota AS is_test FROM h JOIN qt ON h.bin = qt.bin""")
def q_split_stratified(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return SP.stratified_split(o, "o_totalprice", 0.2, 42, "o_orderkey", unique_key=True).select("o_orderkey", "is_test")


# ---- C10 fit on train, apply to all ---------------------------------------------------------------

@query("prep_full", f"""WITH {PART_SPLIT_CTE},
tr AS (SELECT * FROM ps WHERE NOT is_test),
fill AS (SELECT median(p_size) AS ms, median(pk_mod) AS mk FROM tr),
mt AS (SELECT p_type AS m FROM tr WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1),
imp AS (SELECT ps.*, COALESCE(p_size, ms) AS s_i, COALESCE(pk_mod, mk) AS k_i, COALESCE(p_type, m) AS t_i FROM ps, fill, mt),
st AS (SELECT avg(s_i) AS a_s, stddev_pop(s_i) AS d_s, avg(k_i) AS a_k, stddev_pop(k_i) AS d_k FROM imp WHERE NOT is_test),
voc AS (SELECT DISTINCT t_i AS v FROM imp WHERE NOT is_test)
SELECT p_partkey, is_test, 'p_size' AS feature, ROUND((s_i - a_s) / d_s, 6) AS value FROM imp, st
UNION ALL SELECT p_partkey, is_test, 'pk_mod', ROUND((k_i - a_k) / d_k, 6) FROM imp, st
UNION ALL SELECT p_partkey, is_test, 'p_type_' || v, CASE WHEN t_i = v THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END FROM imp, voc""")
def q_prep_full(spark, d):
    sp = _part_split(spark, d)
    train = sp.where(~F.col("is_test"))
    prep = fit_prep(train, ["pk_mod", "p_size"], ["p_type"])
    wide = prep.columns(sp, keep=["p_partkey", "is_test"])
    return _long(wide, ["p_partkey", "is_test"], prep.output_columns)


# ---- M1 / M3 / M14 / S12 models ----------------------------------------------------------------

def _fit_linear(df: DataFrame, features: list[str], label: str, params: dict | None = None,
                solver: str = "auto") -> PipelineModel:
    from pyspark.ml import Pipeline

    asm = VectorAssembler(inputCols=features, outputCol="features")
    est = build_estimator(ModelPolicy("linear_regression", params or {}, solver), len(features), "features", label,
                          "prediction")
    return Pipeline(stages=[asm, est]).fit(df)


def _coefs(model: PipelineModel) -> tuple[list[float], float]:
    from cairn.operators.models import NonNegativeLeastSquaresModel

    m = model.stages[-1]
    if isinstance(m, NonNegativeLeastSquaresModel):
        return [float(v) for v in m.getOrDefault(m.coefficients)], float(m.getOrDefault(m.intercept))
    return [float(v) for v in m.coefficients.toArray()], float(m.intercept)


def _coef_frame(spark: SparkSession, names: list[str], model: PipelineModel) -> DataFrame:
    coefs, icpt = _coefs(model)
    cols = [(f"coef_{n}", v) for n, v in zip(names, coefs)] + [("intercept", icpt)]
    row = spark.createDataFrame([tuple(v for _, v in cols)], ", ".join(f"{n} double" for n, _ in cols))
    return row.select(*[_r(n, n) for n, _ in cols])


def _part_y2(spark, d):
    pf = part_frame(spark, d)
    return pf.withColumn("y2", F.col("p_retailprice") + F.lit(0.5) * F.col("size_full"))


@query("ols_simple", f"""WITH {PART_CTE} SELECT ROUND(regr_slope(p_retailprice, pk_mod), 6) AS coef_pk_mod,
  ROUND(regr_intercept(p_retailprice, pk_mod), 6) AS intercept FROM pf""")
def q_ols_simple(spark, d):
    pf = part_frame(spark, d)
    return _coef_frame(spark, ["pk_mod"], _fit_linear(pf, ["pk_mod"], "p_retailprice"))


_OLS2 = """c AS (SELECT covar_pop(pk_mod, pk_mod) AS s11, covar_pop(size_full, size_full) AS s22, covar_pop(pk_mod, size_full) AS s12,
  covar_pop(pk_mod, y2) AS s1y, covar_pop(size_full, y2) AS s2y, avg(pk_mod) AS m1, avg(size_full) AS m2, avg(y2) AS my FROM {src}),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM c)"""


@query("ols_two_features", f"""WITH {PART_CTE}, y AS (SELECT *, p_retailprice + 0.5 * size_full AS y2 FROM pf), {_OLS2.format(src='y')}
SELECT ROUND(b1, 6) AS coef_pk_mod, ROUND(b2, 6) AS coef_size_full, ROUND(my - b1 * m1 - b2 * m2, 6) AS intercept FROM b""")
def q_ols_two(spark, d):
    y = _part_y2(spark, d)
    """Spark's LinearRegression (normal equations); the default Gram path is checked by ols_gram."""
    return _coef_frame(spark, ["pk_mod", "size_full"], _fit_linear(y, ["pk_mod", "size_full"], "y2", solver="spark"))


@query("ols_gram", SQL["ols_two_features"])
def q_ols_gram(spark, d):
    """Same fit through the distributed Gram matrix and the minimum-norm solve."""
    from pyspark.ml import Pipeline

    y = _part_y2(spark, d)
    est = build_estimator(ModelPolicy("linear_regression", solver="gram"), 2, "features", "y2", "prediction")
    model = Pipeline(stages=[VectorAssembler(inputCols=["pk_mod", "size_full"], outputCol="features"), est]).fit(y)
    return _coef_frame(spark, ["pk_mod", "size_full"], model)


_PREDICT_SQL = f"""WITH {PART_SPLIT_CTE}, y AS (SELECT *, p_retailprice + 0.5 * size_full AS y2 FROM ps),
tr AS (SELECT * FROM y WHERE NOT is_test), {_OLS2.format(src='tr')}
SELECT p_partkey, ROUND(my + b1 * (pk_mod - m1) + b2 * (size_full - m2), 6) AS prediction FROM y, b WHERE is_test"""


def _split_y2(spark, d):
    sp = _part_split(spark, d)
    return sp.withColumn("y2", F.col("p_retailprice") + F.lit(0.5) * F.col("size_full"))


@query("ols_predict", _PREDICT_SQL)
def q_ols_predict(spark, d):
    sp = _split_y2(spark, d)
    model = _fit_linear(sp.where(~F.col("is_test")), ["pk_mod", "size_full"], "y2")
    return model.transform(sp.where(F.col("is_test"))).select("p_partkey", _r("prediction", "prediction"))


@query("persist_roundtrip", _PREDICT_SQL)
def q_persist(spark, d):
    from cairn.sources.artifacts import load_artifacts, save_artifacts

    sp = _split_y2(spark, d)
    train = sp.where(~F.col("is_test"))
    prep = fit_prep(train, ["pk_mod", "size_full"], [], MissingPolicy(), ScalingPolicy("none"))
    prep_model = prep.pipeline_model("features", train)
    est = build_estimator(ModelPolicy("linear_regression"), 2, "features", "y2", "prediction")
    model = est.fit(prep_model.transform(train))
    where = scratch_path(spark, "artifacts")
    save_artifacts(prep_model, model, where)
    prep2, model2 = load_artifacts(where)
    scored = model2.transform(prep2.transform(sp.where(F.col("is_test"))))
    return scored.select("p_partkey", _r("prediction", "prediction"))


@query("nnls", f"""WITH {PART_CTE}, y AS (SELECT *, p_retailprice - 0.3 * size_full AS y3 FROM pf)
SELECT ROUND(regr_slope(y3, pk_mod), 6) AS coef_pk_mod, CAST(0 AS DOUBLE) AS coef_size_full,
  ROUND(regr_intercept(y3, pk_mod), 6) AS intercept FROM y""")
def q_nnls(spark, d):
    pf = part_frame(spark, d).withColumn("y3", F.col("p_retailprice") - F.lit(0.3) * F.col("size_full"))
    model = _fit_linear(pf, ["pk_mod", "size_full"], "y3", {"positive": True})
    return _coef_frame(spark, ["pk_mod", "size_full"], model)


_WIDE_SQL = """WITH g AS (SELECT l_orderkey % 12000 AS k, ROUND(AVG(l_extendedprice), 6) AS prediction, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT k, prediction, n, CAST((SELECT COUNT(*) FROM g) AS BIGINT) AS width FROM g"""


def _wide_fit(spark: SparkSession, d: str, params: dict) -> DataFrame:
    """lineitem on up to 12,000 one-hot columns (beyond the Gram width on every table but the smallest): the fit is each category's mean."""
    li = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 12000).alias("k"), F.col("l_extendedprice").alias("y"))
    li = li.withColumn("c", F.col("k").cast("string"))
    prep = fit_prep(li, [], ["c"], MissingPolicy(), ScalingPolicy("none"))
    prep_model = prep.pipeline_model("features", li)
    model = build_estimator(ModelPolicy("linear_regression", params), prep.feature_count, "features", "y", "prediction").fit(prep_model.transform(li))
    means = model.transform(prep_model.transform(li)).groupBy("k").agg(F.max("prediction").alias("p"), F.count(F.lit(1)).alias("n"))
    return means.select("k", _r("p", "prediction"), "n", F.lit(prep.feature_count).cast("long").alias("width"))


@query("ols_wide", _WIDE_SQL)
def q_ols_wide(spark, d):
    return _wide_fit(spark, d, {})


@query("nnls_wide", _WIDE_SQL)
def q_nnls_wide(spark, d):
    """With a free intercept, non-negative coefficients fit the means as well."""
    return _wide_fit(spark, d, {"positive": True})


@query("stream_score", _PREDICT_SQL)
def q_stream_score(spark, d):
    from cairn.streaming import score_stream

    sp = _split_y2(spark, d)
    train = sp.where(~F.col("is_test"))
    prep = fit_prep(train, ["pk_mod", "size_full"], [], MissingPolicy(), ScalingPolicy("none"))
    prep_model = prep.pipeline_model("features", train)
    model = PipelineModel(stages=[build_estimator(ModelPolicy("linear_regression"), 2, "features", "y2", "prediction")
                                  .fit(prep_model.transform(train))])
    # the test rows, written as a file source, arrive as a stream
    src = scratch_path(spark, "stream-src")
    sp.where(F.col("is_test")).select("p_partkey", "pk_mod", "size_full").write.parquet(src)
    sink = scratch_path(spark, "stream-sink")
    q = score_stream(spark, prep_model, model, src, spark.read.parquet(src).schema, sink, keep=["p_partkey"])
    q.awaitTermination()
    return spark.read.parquet(sink).select("p_partkey", _r("prediction", "prediction"))


# ---- A8–A11 metrics ----------------------------------------------------------------------------

_MET = """ROUND(CASE WHEN min(y) = max(y) THEN CASE WHEN bool_and(abs(y - p) <= 1e-8 + 1e-5 * abs(p)) THEN 1.0 ELSE 0.0 END
  ELSE 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END, 6) AS r2,
  ROUND(sqrt(sum((y - p) * (y - p)) / count(*)), 6) AS rmse, ROUND(avg(abs(y - p)), 6) AS mae, count(*) AS n"""


def _lineitem_pred(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return li.select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("y"),
                     (F.col("l_quantity") * F.lit(1500.0)).alias("p"))


def _metric_frame(df: DataFrame, group_by=None) -> DataFrame:
    m = regression_metrics(df, "y", "p", group_by=group_by, with_count=True)
    keys = list(group_by or [])
    return m.select(*keys, _r("r2", "r2"), _r("rmse", "rmse"), _r("mae", "mae"), "n")


_LP = "lp AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity * CAST(1500 AS DOUBLE) AS p FROM lineitem)"


@query("metrics_all", f"WITH {_LP} SELECT {_MET} FROM lp")
def q_metrics_all(spark, d):
    return _metric_frame(_lineitem_pred(spark, d))


@query("metrics_by_group", f"WITH {_LP} SELECT l_returnflag, l_linestatus, {_MET} FROM lp GROUP BY l_returnflag, l_linestatus")
def q_metrics_group(spark, d):
    return _metric_frame(_lineitem_pred(spark, d), ["l_returnflag", "l_linestatus"])


@query("metrics_constant", f"""WITH c AS (
  SELECT 'exact' AS case_name, CAST(5 AS DOUBLE) AS y, CAST(5 AS DOUBLE) AS p FROM lineitem
  UNION ALL SELECT 'close', CAST(5 AS DOUBLE), CAST(5 AS DOUBLE) + CAST(1e-9 AS DOUBLE) FROM lineitem
  UNION ALL SELECT 'off', CAST(5 AS DOUBLE), CAST(5 AS DOUBLE) + l_discount FROM lineitem)
SELECT case_name, {_MET} FROM c GROUP BY case_name""")
def q_metrics_constant(spark, d):
    li = _t(spark, d, "lineitem")
    five = F.lit(5.0)
    c = (li.select(F.lit("exact").alias("case_name"), five.alias("y"), five.alias("p"))
         .unionByName(li.select(F.lit("close").alias("case_name"), five.alias("y"), (five + F.lit(1e-9)).alias("p")))
         .unionByName(li.select(F.lit("off").alias("case_name"), five.alias("y"), (five + F.col("l_discount")).alias("p"))))
    return _metric_frame(c, ["case_name"])


@query("metrics_stream", f"WITH {_LP} SELECT l_returnflag, {_MET} FROM lp GROUP BY l_returnflag")
def q_metrics_stream(spark, d):
    """The metrics as a stateful streaming aggregation over lineitem arriving as files."""
    from cairn.streaming import running_metrics

    path = f"{d.rstrip('/')}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d).select(
        "l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.lit(1500.0)).alias("p"))
    agg = running_metrics(stream, "y", "p", ["l_returnflag"])
    sink = scratch_path(spark, "metrics-stream")

    def write(batch, _epoch):
        batch.write.mode("overwrite").parquet(sink)

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", scratch_path(spark, "metrics-stream-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("l_returnflag", _r("r2", "r2"), _r("rmse", "rmse"), _r("mae", "mae"), "n")


# ---- S1–S3, S8: CSV written from customer, read back --------------------------------------------

@query("csv_roundtrip", """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_acctbal,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def q_csv_roundtrip(spark, d):
    from cairn.config import FileSpec
    from cairn.sources.csv import read_csv

    c = _t(spark, d, "customer")
    text = c.select(
        F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
        F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("NA")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    path = scratch_path(spark, "csv-roundtrip")
    text.write.option("sep", ";").option("header", "true").option("quoteAll", "true").csv(path)
    df, _, _ = read_csv(spark, FileSpec(path, "utf-8", ";", ",", check_exists=False))
    return df


@query("documents_csv_1252", "SELECT CAST(doc_id AS DOUBLE) AS doc_id, lang, text FROM documents")
def q_documents_csv_1252(spark, d):
    """Whole document texts (multi-line, quotes, accents) written as windows-1252 CSV, read back with the
    encoding detected by the inventory job."""
    from cairn.config import FileSpec
    from cairn.sources.csv import charsets, read_csv

    docs = _t(spark, d, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "documents-1252")
    with charsets(spark, "windows-1252"):
        (docs.write.option("encoding", "windows-1252").option("header", "true").option("escape", '"')
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
    df, _, _ = read_csv(spark, FileSpec(path, None, check_exists=False))
    return df


@query("csv_folder_mixed", "SELECT CAST(doc_id AS DOUBLE) AS doc_id, lang, text FROM documents")
def q_csv_folder_mixed(spark, d):
    """One folder of document CSV files in two encodings (en/de as UTF-8, fr/es as windows-1252), read back
    with each file's detected encoding; files sharing an encoding and header are read in one scan."""
    from cairn.config import FileSpec
    from cairn.sources.csv import charsets
    from cairn.sources.encoding import read_csv_folder

    docs = _t(spark, d, "documents").select("doc_id", "lang", "text")
    base = scratch_path(spark, "documents-mixed")
    as_utf8 = F.col("lang").isin("en", "de")
    for charset, part in (("utf-8", docs.where(as_utf8)), ("windows-1252", docs.where(~as_utf8))):
        with charsets(spark, charset):
            (part.write.option("encoding", charset).option("header", "true")
             .option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
             .option("ignoreTrailingWhiteSpace", "false").csv(f"{base}/{charset}"))
    df, _, _ = read_csv_folder(spark, FileSpec(f"{base}/*/*.csv", check_exists=False))
    return df


# ---- S6 encoding inventory, M5 forest, X3 report (rows-only: no SQL form) ------------------------

@query("encoding_inventory", "SELECT * FROM (VALUES ('utf-8', 'utf-8'), ('windows-1252', 'windows-1252')) AS t(written_as, encoding) WHERE (SELECT count(*) FROM documents) > 0")
def q_encoding_inventory(spark, d):
    from cairn.sources.csv import charsets
    from cairn.sources.encoding import encoding_inventory

    docs = _t(spark, d, "documents").select("doc_id", "lang", "text")
    base = scratch_path(spark, "encodings")
    for charset in ("utf-8", "windows-1252"):
        with charsets(spark, charset):
            docs.write.option("encoding", charset).option("header", "true").csv(f"{base}/{charset}")
    inv = encoding_inventory(spark, f"{base}/*/*.csv")
    folder = F.regexp_extract("path", r"/(utf-8|windows-1252)/", 1)
    # a file of English lines only is ASCII in both folders
    return inv.where("encoding <> 'ascii'").select(folder.alias("written_as"), "encoding").distinct()


def _part_run(spark, d, kind: str, params: dict) -> "object":
    from cairn.plans import run_regression

    pf = part_frame(spark, d).drop("size_full")
    cfg = PipelineConfig(target=TargetSpec("explicit", "p_retailprice"), model=ModelPolicy(kind, params), check_missing=True)
    return run_regression(spark, cfg, pf, key="p_partkey", unique_key=True)


@query("rf_metrics")
def q_rf_metrics(spark, d):
    res = _part_run(spark, d, "random_forest", {"n_estimators": 20, "max_depth": 10, "random_state": 42})
    return regression_metrics(res.predictions, res.target, "prediction", with_count=True)


@query("run_report")
def q_run_report(spark, d):
    from cairn.plans import run_report

    res = _part_run(spark, d, "linear_regression", {})
    return run_report(spark, res.logs)


def _cases() -> None:
    """The further cases add themselves to Q and SQL."""
    from cairn import catalog_cases  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _cases()
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    _cases()
    return dict(SQL)
