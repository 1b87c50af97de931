"""Further registered queries: settings, error rules, fallbacks and reports, each with its DuckDB SQL.

Like :mod:`cairn.catalog`, every query reads the whole of its tables. Where a
rule ends in an error, the query returns whether it was raised next to counts
of the table that it was raised on; where a model cannot be written in SQL
(forests), the query returns its settings and whether its R² reaches the bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.catalog import (
    LM_CTE,
    LM_FEATURES,
    PART_CTE,
    PART_SPLIT_CTE,
    SPOILED_CTE,
    _LP,
    _coef_frame,
    _fit_linear,
    _lineitem_pred,
    _part_split,
    _r,
    _t,
    lineitem_missing,
    part_frame,
    part_spoiled,
    query,
)
from cairn.config import CategoryPolicy, FileSpec, MissingPolicy, ModelPolicy, PipelineConfig, ScalingPolicy, SplitPolicy, TargetSpec
from cairn.operators import split as SP
from cairn.operators.metrics import regression_metrics
from cairn.operators.models import build_estimator
from cairn.operators.prep import fit_prep
from cairn.operators.stats import column_stats
from cairn.operators.target import repair_target, resolve_target
from cairn.plans import run_regression
from cairn.plans.regression import forest_input
from cairn.session import materialize, scratch_path


def _raises(action: Callable[[], object], part: str) -> bool:
    """Whether the action fails with a message that holds ``part``."""
    try:
        action()
    except Exception as exc:
        return part in str(exc)
    return False


def _consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


# ---- CSV --------------------------------------------------------------------------------------

def _csv(df: DataFrame, path: str, header: bool = True, **options: str) -> None:
    df.write.options(header=str(header).lower(), escape='"', **options).csv(path)


def _headed(lines: DataFrame, header: str, path: str) -> None:
    """Lines (column ``value``) as text files that each start with the header, written by their own tasks."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines.select(F.when(first, F.concat(F.lit(header + "\n"), "value")).otherwise(F.col("value")).alias("value")).write.text(path)


@query("target_last_csv", "SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice AS label, 'o_totalprice' AS target FROM orders")
def q_target_last_csv(spark: SparkSession, d: str) -> DataFrame:
    from cairn.sources.csv import read_csv

    path = scratch_path(spark, "last-csv")
    _csv(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    df, _, _ = read_csv(spark, FileSpec(path, check_exists=False))
    target = resolve_target(df.columns, TargetSpec("last_column"))
    fixed, _ = repair_target(df, target)
    return fixed.select("o_orderkey", F.col(target).alias("label"), F.lit(target).alias("target"))


@query("csv_headerless", 'SELECT CAST(c_custkey AS DOUBLE) AS "0", c_name AS "1", c_acctbal AS "2" FROM customer')
def q_csv_headerless(spark: SparkSession, d: str) -> DataFrame:
    from cairn.sources.csv import read_csv

    path = scratch_path(spark, "headerless")
    _csv(_t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, header=False)
    return read_csv(spark, FileSpec(path, "utf-8", has_header=False, check_exists=False))[0]


@query("csv_two_header_orders", "SELECT CAST(c_custkey AS DOUBLE) AS k, c_name AS n, c_acctbal AS v FROM customer")
def q_csv_two_header_orders(spark: SparkSession, d: str) -> DataFrame:
    from cairn.sources.csv import read_csv

    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_acctbal").alias("v"))
    base = scratch_path(spark, "two-orders")
    _csv(c.where("k % 2 = 0").select("k", "n", "v"), f"{base}/even")
    _csv(c.where("k % 2 = 1").select("v", "k", "n"), f"{base}/odd")
    return read_csv(spark, FileSpec(f"{base}/*/*.csv", "utf-8", check_exists=False))[0].select("k", "n", "v")


@query("csv_case_headers", 'SELECT CAST(c_custkey AS DOUBLE) AS "A", c_acctbal AS "a_1", c_name AS "tick" FROM customer')
def q_csv_case_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header ``A,a,x`y``: the second name is taken apart from the first, the back-tick is a plain character."""
    from cairn.sources.csv import read_csv

    path = scratch_path(spark, "case-headers")
    c = _t(spark, d, "customer")
    _headed(c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), "c_name").alias("value")), "A,a,x`y", path)
    df, _, _ = read_csv(spark, FileSpec(path, "utf-8", check_exists=False))
    return df.toDF("A", "a_1", "tick")


@query("csv_too_long_row", "SELECT count(*) AS n, true AS refused, true AS refused_behind_empty, true AS empty_surplus_kept FROM customer")
def q_csv_too_long(spark: SparkSession, d: str) -> DataFrame:
    """A value beyond the header is refused, directly behind it or after an empty field; empty fields alone are not."""
    from cairn.sources.csv import read_csv

    c = _t(spark, d, "customer")

    def read(more: str) -> DataFrame:
        path = scratch_path(spark, "too-long")
        rest = F.when(F.col("c_custkey") == 1, F.concat("c_name", F.lit(more))).otherwise(F.col("c_name"))
        _headed(c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), rest).alias("value")), "key,name", path)
        return read_csv(spark, FileSpec(path, "utf-8", check_exists=False))[0]

    refused = _raises(lambda: read(",extra"), "more fields")
    behind = _raises(lambda: read(",,5"), "more fields")
    kept = read(",,").count() == c.count()
    return c.agg(F.count(F.lit(1)).alias("n")).withColumns({"refused": F.lit(refused), "refused_behind_empty": F.lit(behind), "empty_surplus_kept": F.lit(kept)})


@query("csv_quoted_parallel", "SELECT CAST(doc_id AS DOUBLE) AS k, nullif(text, '') AS t, true AS several_tasks FROM documents")
def q_csv_quoted_parallel(spark: SparkSession, d: str) -> DataFrame:
    """Every document, line breaks and quotes in quoted fields, read back by splits: a file by more than one task."""
    from cairn.sources.csv import read_csv

    path = scratch_path(spark, "quoted")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    docs = _t(spark, d, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted).alias("value"))
    _headed(docs, "k,t", path)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    size = docs.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    try:
        # about 16 blocks of a small table, of the usual size for a large one
        spark.conf.set(setting, str(min(max(size // 16, 1 << 16), 128 << 20)))
        df = read_csv(spark, FileSpec(path, "utf-8", check_exists=False))[0]
        blocks = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).distinct()
        several = blocks.groupBy("f").count().agg(F.max("count")).first()[0] > 1
    finally:
        spark.conf.set(setting, before)
    return df.select("k", "t").withColumn("several_tasks", F.lit(several))


@query("csv_shift_jis", "SELECT CAST(o_orderkey AS DOUBLE) AS k, CASE WHEN o_orderkey % 2 = 0 THEN '東京' ELSE '大阪' END AS city, 'shift_jis' AS encoding FROM orders")
def q_csv_shift_jis(spark: SparkSession, d: str) -> DataFrame:
    from cairn.sources.csv import LEGACY, read_csv

    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "東京").otherwise("大阪").alias("city"))
    path, before = scratch_path(spark, "sjis"), spark.conf.get(LEGACY, None)
    spark.conf.set(LEGACY, "true")
    try:
        _csv(o, path, encoding="Shift_JIS")
    finally:
        spark.conf.unset(LEGACY) if before is None else spark.conf.set(LEGACY, before)
    df, _, encoding = read_csv(spark, FileSpec(path, check_exists=False))
    return df.withColumn("encoding", F.lit(encoding))


# ---- target, features ------------------------------------------------------------------------

@query("target_explicit", "SELECT o_orderkey, o_totalprice AS label, true AS wrong_case_refused FROM orders")
def q_target_explicit(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    target = resolve_target(o.columns, TargetSpec("explicit", "o_totalprice"))
    refused = _raises(lambda: resolve_target(o.columns, TargetSpec("explicit", "O_TotalPrice")), "Target column 'O_TotalPrice' not found in the dataset.")
    return o.select("o_orderkey", F.col(target).alias("label"), F.lit(refused).alias("wrong_case_refused"))


@query("target_boolean", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label FROM orders")
def q_target_boolean(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("label"))
    return repair_target(o, "label")[0]


@query("target_failed_entry", f"""WITH {SPOILED_CTE.replace('% 11', '% 3')}
SELECT 'target_numeric_failed:nan_ratio=' || printf('%.3f', (count(*) - count(TRY_CAST(trim(t) AS DOUBLE))) / CAST(count(*) AS DOUBLE)) AS entry FROM sp""")
def q_target_failed(spark: SparkSession, d: str) -> DataFrame:
    from cairn.plans import run_with_payload

    df = part_spoiled(spark, d, 3)
    payload, _ = run_with_payload(spark, PipelineConfig(target=TargetSpec("explicit", "t")), df=df)
    return payload.select(F.explode("logs").alias("entry")).where(F.col("entry").startswith("target_numeric_failed"))


@query("target_distinct", "SELECT 'l_discount' AS column_name, count(DISTINCT l_discount) AS n, count(DISTINCT l_discount) >= 5 AS full_bins FROM lineitem")
def q_target_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The exact distinct count behind the number of bins (fewer than 100 distinct values)."""
    li = _t(spark, d, "lineitem")
    n = SP.target_distinct(li, "l_discount", column_stats(li.select(F.col("l_discount").cast("double")), ["l_discount"])["l_discount"])
    edges = SP.stratify_edges(li, "l_discount")
    return spark.createDataFrame([("l_discount", n, edges is not None)], "column_name string, n long, full_bins boolean")


# ---- imputation and encoding rules ----------------------------------------------------------------

@query("drop_rows", f"WITH {LM_CTE} SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lm WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def q_drop_rows(spark: SparkSession, d: str) -> DataFrame:
    lm = lineitem_missing(spark, d)
    prep = fit_prep(lm, ["l_quantity", "l_discount"], [], MissingPolicy(numeric="drop_rows"), ScalingPolicy("none"))
    return prep.columns(lm, keep=["l_orderkey", "l_linenumber"])


@query("all_missing", """SELECT o_orderkey, CAST(-7 AS DOUBLE) AS empty_constant, 'o_totalprice' AS kept_by_mean FROM orders""")
def q_all_missing(spark: SparkSession, d: str) -> DataFrame:
    """A column without values leaves the output under a statistic, and is kept under a constant."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(None).cast("double").alias("empty"))
    mean = fit_prep(o, ["empty", "o_totalprice"], [], MissingPolicy(numeric="mean"), ScalingPolicy("none"))
    const = fit_prep(o, ["empty"], [], MissingPolicy(numeric="constant", fill_value_numeric=-7.0), ScalingPolicy("none"))
    out = const.columns(o, keep=["o_orderkey"]).withColumnRenamed("empty", "empty_constant")
    return out.withColumn("kept_by_mean", F.lit(",".join(mean.output_columns)))


@query("encode_unknown_error", """SELECT 'onehot' AS encode, count(*) FILTER (WHERE p_brand = 'Brand#2') > 0 AS raised FROM part
UNION ALL SELECT 'ordinal', count(*) FILTER (WHERE p_brand = 'Brand#2') > 0 FROM part""")
def q_encode_unknown_error(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select("p_partkey", "p_brand")
    rows = []
    for encode in ("onehot", "ordinal"):
        prep = fit_prep(p.where("p_brand <> 'Brand#2'"), [], ["p_brand"], category=CategoryPolicy(encode, "error"))
        rows.append((encode, _raises(lambda prep=prep: _consume(prep.columns(p)), "unknown categories")))
    return spark.createDataFrame(rows, "encode string, raised boolean")


@query("encode_known_error_mode", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS p_brand FROM part")
def q_encode_known(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal codes in error mode when every category is known."""
    p = _t(spark, d, "part").select("p_partkey", "p_brand")
    return fit_prep(p, [], ["p_brand"], category=CategoryPolicy("ordinal", "error")).columns(p, keep=["p_partkey"])


@query("encode_none", "SELECT o_orderkey, CAST(o_orderkey % 97 AS DOUBLE) AS code, true AS text_refused FROM orders")
def q_encode_none(spark: SparkSession, d: str) -> DataFrame:
    """Without encoding, numeric text is read as numbers and other text is an error."""
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).cast("string").alias("code"), "o_orderpriority")
    num = fit_prep(o, [], ["code"], category=CategoryPolicy("none"))
    text = fit_prep(o, [], ["o_orderpriority"], category=CategoryPolicy("none"))
    refused = _raises(lambda: _consume(text.columns(o)), "could not convert")
    return num.columns(o, keep=["o_orderkey"]).withColumn("text_refused", F.lit(refused))


@query("onehot_vector", """WITH v AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_brand <> 'Brand#2'),
n AS (SELECT b, row_number() OVER (ORDER BY b) AS place FROM v)
SELECT p_partkey, CAST(n.place AS INTEGER) AS place, CASE WHEN part.p_brand = n.b THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value FROM part CROSS JOIN n
UNION ALL SELECT p_partkey, 0, CAST(p_size AS DOUBLE) FROM part""")
def q_onehot_vector(spark: SparkSession, d: str) -> DataFrame:
    """The sparse vector form: numeric block, then one place per category (unknown: none)."""
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    train = p.where("p_brand <> 'Brand#2'")
    model = fit_prep(train, ["p_size"], ["p_brand"], scaling=ScalingPolicy("none")).pipeline_model("features", train)
    return model.transform(p).select("p_partkey", F.posexplode(vector_to_array("features")).alias("place", "value"))


# ---- split rules -----------------------------------------------------------------------------------

@query("split_random_nokey", """WITH h AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5('42:{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}')) AS rn,
count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey, rn <= greatest(1, least(n - 1, ceil(n * CAST(0.2 AS DOUBLE)))) AS is_test FROM h""")
def q_split_nokey(spark: SparkSession, d: str) -> DataFrame:
    """Without a key the rows' own content gives the order."""
    return SP.random_split(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.2, 42)


@query("split_copies", """WITH c AS (SELECT count(*) AS n FROM lineitem) SELECT n, CAST(greatest(1, least(n - 1, ceil(n * CAST(0.2 AS DOUBLE)))) AS BIGINT) AS n_test,
(SELECT count(DISTINCT l_linestatus) FROM lineitem) AS kinds FROM c""")
def q_split_copies(spark: SparkSession, d: str) -> DataFrame:
    """A frame of large groups of identical rows is cut exactly, in one of the groups."""
    out = SP.random_split(_t(spark, d, "lineitem").select("l_linestatus"), 0.2, 42)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"), F.count_distinct("l_linestatus").alias("kinds"))


_NULLED = "k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS key FROM orders)"


@query("split_null_key", f"""WITH {_NULLED}, c AS (SELECT count(*) AS n FROM k),
h AS (SELECT o_orderkey, key, md5('42:' || coalesce(key, chr(0))) AS h FROM k),
cut AS (SELECT max(h) AS h FROM (SELECT h FROM h, c ORDER BY h LIMIT (SELECT CAST(greatest(1, least(n - 1, ceil(n * CAST(0.2 AS DOUBLE)))) AS BIGINT) FROM c)))
SELECT h.o_orderkey, h.h < cut.h AS surely_test FROM h, cut WHERE h.h <> cut.h""")
def q_split_null_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a key share one place in the order; all others go by their key's hash."""
    o = _t(spark, d, "orders")
    key = F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_orderkey").cast("string"))
    df = o.select("o_orderkey", key.alias("key"))
    out = SP.random_split(df, 0.2, 42, "key", keep_keys=True)
    last = out.where("is_test").agg(F.max(F.struct(SP.K1, SP.K2)).alias("m")).select("m.*").first()
    here = (F.col(SP.K1) == last[0]) & (F.col(SP.K2) == last[1])
    return out.where(~here).select("o_orderkey", F.col("is_test").alias("surely_test"))


@query("split_fallback_null_label", """SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)))
  <= greatest(1, least(count(*) OVER () - 1, ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)))) AS is_test FROM orders""")
def q_split_null_label(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")).alias("y"))
    return SP.stratified_split(o, "y", 0.2, 42, "o_orderkey", unique_key=True).select("o_orderkey", "is_test")


@query("split_fallback_many_groups", """WITH g AS (SELECT o_custkey % 25 AS g FROM orders GROUP BY 1)
SELECT g, row_number() OVER (ORDER BY md5('42:' || CAST(g AS VARCHAR)))
  <= greatest(1, least(count(*) OVER () - 1, ceil(count(*) OVER () * CAST(0.1 AS DOUBLE)))) AS is_test FROM g""")
def q_split_many_groups(spark: SparkSession, d: str) -> DataFrame:
    """More strata (5) than test rows (3): the random split, here of all orders in 25 groups."""
    g = _t(spark, d, "orders").groupBy((F.col("o_custkey") % 25).alias("g")).agg(F.sum("o_totalprice").cast("double").alias("y"))
    return SP.stratified_split(g, "y", 0.1, 42, "g", unique_key=True).select("g", "is_test")


# ---- linear models ----------------------------------------------------------------------------------

@query("ols_no_intercept", f"""WITH {PART_CTE} SELECT ROUND(sum(p_retailprice * pk_mod) / sum(pk_mod * pk_mod), 6) AS coef_pk_mod, CAST(0 AS DOUBLE) AS intercept FROM pf""")
def q_ols_no_intercept(spark: SparkSession, d: str) -> DataFrame:
    return _coef_frame(spark, ["pk_mod"], _fit_linear(part_frame(spark, d), ["pk_mod"], "p_retailprice", {"fit_intercept": False}))


@query("ols_far_from_zero", "SELECT CAST(3 AS DOUBLE) AS slope, count(*) AS n, true AS fits FROM lineitem")
def q_ols_far(spark: SparkSession, d: str) -> DataFrame:
    """Slope 3 on epoch seconds (mean 8e8): centring must not cancel."""
    days = F.datediff("l_shipdate", F.lit("1970-01-01"))
    li = _t(spark, d, "lineitem").select((days * 86_400.0 + 900_000_000.0).alias("t"))
    df = li.withColumn("y", 3 * F.col("t") + 7)
    model = _fit_linear(df, ["t"], "y")
    worst = model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("y"))).alias("e"), F.count(F.lit(1)).alias("n"))
    slope = model.stages[-1].getOrDefault("coefficients")[0]
    return worst.select(F.round(F.lit(slope), 6).alias("slope"), "n", (F.col("e") < 1e-3).alias("fits"))


@query("ols_mixed_scales", """SELECT p_partkey, ROUND(CAST(p_partkey % 1000 AS DOUBLE) * 2 + p_size * 5 + CAST(substr(p_brand, 7) AS DOUBLE), 6) AS prediction FROM part""")
def q_ols_mixed_scales(spark: SparkSession, d: str) -> DataFrame:
    """Features of scale 1e9 and 1e-3 next to a full one-hot encoding."""
    p = _t(spark, d, "part")
    brand = F.substring("p_brand", 7, 9).cast("double")
    df = p.select("p_partkey", ((F.col("p_partkey") % 1000) * 1e6).alias("big"), (F.col("p_size") * 1e-3).alias("small"), "p_brand",
                  ((F.col("p_partkey") % 1000) * 2 + F.col("p_size") * 5 + brand).cast("double").alias("y"))
    prep = fit_prep(df, ["big", "small"], ["p_brand"], scaling=ScalingPolicy("none"))
    data = prep.pipeline_model("features", df).transform(df)
    model = build_estimator(ModelPolicy(), prep.feature_count, "features", "y").fit(data)
    return model.transform(data).select("p_partkey", _r("prediction", "prediction"))


@query("ols_unseen_category", f"""WITH tr AS (SELECT p_type, avg(p_size) AS m FROM part WHERE p_brand <> 'Brand#2' GROUP BY p_type),
g AS (SELECT avg(m) AS unseen FROM tr)
SELECT p_partkey, ROUND(CASE WHEN p_brand = 'Brand#2' THEN unseen ELSE m END, 6) AS prediction FROM part JOIN tr USING (p_type), g""")
def q_ols_unseen(spark: SparkSession, d: str) -> DataFrame:
    """One one-hot column: the minimum-norm fit predicts a category's mean, and their plain mean for an unseen one."""
    p = _t(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("y"), "p_type")
    train = p.where("p_brand <> 'Brand#2'")
    prep = fit_prep(train, [], ["p_type"])
    pm = prep.pipeline_model("features", train)
    model = build_estimator(ModelPolicy(), prep.feature_count, "features", "y").fit(pm.transform(train))
    shown = p.withColumn("p_type", F.when(F.col("p_brand") == "Brand#2", F.lit("no such type")).otherwise(F.col("p_type")))
    return model.transform(pm.transform(shown)).select("p_partkey", _r("prediction", "prediction"))


# ---- forests: settings and the R² bound ----------------------------------------------------------------

_FOREST_CASES = {
    "few": {"n_estimators": 3, "max_depth": 2, "random_state": 5}, "leaf": {"n_estimators": 2, "max_depth": 6, "min_samples_leaf": 50, "bootstrap": False},
    "sqrt": {"n_estimators": 1, "max_depth": 3, "max_features": "sqrt"}, "deep": {"n_estimators": 1, "max_depth": 31, "min_samples_leaf": 20},
}


@query("forest_settings", """SELECT * FROM (VALUES ('few', 3, true, true, true, CAST(5 AS BIGINT)), ('leaf', 2, true, true, true, CAST(0 AS BIGINT)),
 ('sqrt', 1, true, true, true, CAST(0 AS BIGINT)), ('deep', 1, true, true, true, CAST(0 AS BIGINT))) AS t(setting, n_trees, depth_reached, leaves_large_enough, subset_ok, seed)
 WHERE (SELECT count(*) FROM part) > 0""")
def q_forest_settings(spark: SparkSession, d: str) -> DataFrame:
    """Forests fitted on all of ``part``: number and depth of trees and size of leaves are read from the fitted trees."""
    p = part_frame(spark, d)
    prep = fit_prep(p, ["pk_mod", "size_full"], [])
    # partitions that follow the rows, not the table's files
    keyed = prep.pipeline_model("features", p).transform(SP.with_order_keys(p, 42, ["p_partkey"]))
    data = forest_input(keyed, p.count()).select("features", "p_retailprice").cache()
    rows = []
    for name, params in _FOREST_CASES.items():
        made = build_estimator(ModelPolicy("random_forest", params), 2, "features", "p_retailprice")
        model = made.fit(data)
        depth, least = min(params["max_depth"], 30), params.get("min_samples_leaf", 1)
        trees = model.trees
        # without a bootstrap a leaf's rows are the table's own; each tree is a table of nodes
        full = params.get("bootstrap", True) or all(_leaf_sizes(data, t) >= least for t in trees)
        reached = all(t.depth <= depth for t in trees) and (name in ("leaf", "deep") or max(t.depth for t in trees) == depth)
        subset = made.getFeatureSubsetStrategy() == ("1" if params.get("max_features") else "all")
        rows.append((name, model.getNumTrees, reached, full, subset, model.getSeed() if "random_state" in params else 0))
    data.unpersist()
    return spark.createDataFrame(rows, "setting string, n_trees int, depth_reached boolean, leaves_large_enough boolean, subset_ok boolean, seed long")


def _leaf_sizes(data: DataFrame, tree) -> int:
    """Rows of a fitted tree's smallest leaf: rows that share a leaf share its prediction."""
    return tree.transform(data).groupBy("prediction").count().agg(F.min("count")).first()[0]


def _gradient_boosted(columns: dict, params: dict):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(**columns, maxIter=int(params.get("rounds", 20)), maxDepth=int(params.get("depth", 5)), seed=int(params.get("seed", 42)))


@query("user_model", f"WITH {PART_SPLIT_CTE} SELECT count(*) AS n_test, 'train_model:gradient_boosted' AS entry, true AS r2_ok, true AS reloaded_same, true AS unknown_refused FROM ps WHERE is_test")
def q_user_model(spark: SparkSession, d: str) -> DataFrame:
    """A registered kind of model in a whole run over ``part``: log, metrics, artefacts and their reload."""
    from cairn.model_kinds import register_model_kind
    from cairn.sources.artifacts import load_artifacts, save_artifacts

    register_model_kind("gradient_boosted", _gradient_boosted, ["rounds", "depth", "seed"], fixed_partitions=True)
    p = part_frame(spark, d).select("p_partkey", "pk_mod", "size_full", "p_retailprice")
    cfg = PipelineConfig(target=TargetSpec("explicit", "p_retailprice"), model=ModelPolicy("gradient_boosted", {"rounds": 15}))
    res = run_regression(spark, cfg, p, key="p_partkey", unique_key=True)
    where = scratch_path(spark, "user-model")
    save_artifacts(res.prep_model, res.model, where)
    prep, model = load_artifacts(where)
    test = res.split.where("is_test")
    again = model.transform(prep.transform(test)).select("p_partkey", F.col("prediction").alias("again"))
    both = res.predictions.select("p_partkey", "prediction").join(again, "p_partkey")
    entry = next((x for x in res.logs if x.startswith("train_model:")), "")
    refused = _raises(lambda: ModelPolicy("gradient_boosted", {"trees": 3}), "Unsupported parameter")
    return both.agg(F.count(F.lit(1)).alias("n_test"), F.lit(entry).alias("entry"), F.lit(res.metrics["r2"] >= 0.9).alias("r2_ok"),
                    (F.max(F.abs(F.col("prediction") - F.col("again"))) == 0).alias("reloaded_same"), F.lit(refused).alias("unknown_refused"))


@query("forest_copies", "SELECT count(*) AS n, true AS all_there, true AS even FROM lineitem")
def q_forest_copies(spark: SparkSession, d: str) -> DataFrame:
    """A third of lineitem as copies of one row: the forest's input keeps every copy and no partition has over 1.5 times the median."""
    from pyspark.ml.feature import VectorAssembler

    crowd = F.col("l_orderkey") % 3 == 0
    li = _t(spark, d, "lineitem").select(*[F.when(crowd, 1.0).otherwise(F.col(c).cast("double")).alias(c) for c in ("l_quantity", "l_discount", "l_extendedprice")])
    keyed = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(SP.with_order_keys(li, 42))
    total = li.count()
    dealt = forest_input(keyed, total)
    names = ["l_quantity", "l_discount", "l_extendedprice"]
    # dealt once: its rows of each kind by partition
    there = materialize(dealt.groupBy(F.spark_partition_id().alias("part"), *names).count(), "forest-dealt")
    sizes = sorted(r["n"] for r in there.groupBy("part").agg(F.sum("count").alias("n")).collect())
    even = sizes[-1] <= 1.5 * sizes[len(sizes) // 2]
    left = keyed.groupBy(*names).count()
    same = left.exceptAll(there.groupBy(*names).agg(F.sum("count").alias("count"))).isEmpty()
    return there.agg(F.sum("count").alias("n"), F.lit(same).alias("all_there"), F.lit(even).alias("even"))


@query("forest_fits", f"WITH {PART_SPLIT_CTE} SELECT count(*) AS n_test, true AS r2_ok, true AS criterion_refused FROM ps WHERE is_test")
def q_forest_fits(spark: SparkSession, d: str) -> DataFrame:
    sp = SP.random_split(part_frame(spark, d), 0.2, 42, "p_partkey", unique_key=True, keep_keys=True)
    train = sp.where(~F.col("is_test"))
    prep = fit_prep(train, ["pk_mod", "size_full"], [])
    pm = prep.pipeline_model("features", train)
    forest = build_estimator(ModelPolicy("random_forest", {"n_estimators": 20, "max_depth": 12, "random_state": 42}), 2, "features", "p_retailprice")
    out = forest.fit(forest_input(pm.transform(train), train.count())).transform(pm.transform(sp.where("is_test")))
    refused = _raises(lambda: build_estimator(ModelPolicy("random_forest", {"criterion": "poisson"}), 2), "criterion")
    m = regression_metrics(out, "p_retailprice", "prediction", with_count=True)
    return m.select(F.col("n").alias("n_test"), (F.col("r2") >= 0.9).alias("r2_ok"), F.lit(refused).alias("criterion_refused"))


# ---- metrics --------------------------------------------------------------------------------------------

@query("metrics_null_pairs", """WITH x AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS y,
 CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity * CAST(1500 AS DOUBLE) END AS p FROM lineitem), z AS (SELECT * FROM x WHERE y IS NOT NULL AND p IS NOT NULL)
SELECT ROUND(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, ROUND(sqrt(avg((y - p) * (y - p))), 6) AS rmse, ROUND(avg(abs(y - p)), 6) AS mae,
 (SELECT count(*) FROM x) AS n, count(*) AS n_pairs FROM z""")
def q_metrics_null_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    df = li.select(F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("y"),
                   F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity") * 1500.0).otherwise(F.when(F.col("l_orderkey") % 2 == 0, F.lit(float("nan")))).alias("p"))
    m = regression_metrics(df, "y", "p", with_count=True, with_pairs=True)
    return m.select(*[_r(c, c) for c in ("r2", "rmse", "mae")], "n", "n_pairs")


@query("metrics_subset", f"WITH {_LP} SELECT ROUND(avg(abs(y - p)), 6) AS mae, ROUND(sqrt(avg((y - p) * (y - p))), 6) AS rmse, 'mae,rmse' AS asked FROM lp")
def q_metrics_subset(spark: SparkSession, d: str) -> DataFrame:
    """Only the metrics asked for, in the order asked for."""
    m = regression_metrics(_lineitem_pred(spark, d), "y", "p", ("mae", "rmse"))
    return m.select(_r("mae", "mae"), _r("rmse", "rmse"), F.lit(",".join(m.columns)).alias("asked"))


# ---- the whole run: log, payload, user steps --------------------------------------------------------------

_RUN_LOG = f"""WITH {PART_CTE}, m AS (SELECT column_name, ratio FROM (
 SELECT 'pk_mod' AS column_name, CAST(0 AS DOUBLE) AS ratio UNION ALL SELECT 'p_brand', 0 UNION ALL
 SELECT 'p_size', avg(CASE WHEN p_size IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM pf UNION ALL
 SELECT 'p_type', avg(CASE WHEN p_type IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM pf))
SELECT * FROM (VALUES (0, 'target', 'p_retailprice'), (1, 'target_numeric_ok', 'nan_ratio=0.000,imputed=median'), (2, 'split_xy', ''),
 (3, 'missing_top5', (SELECT string_agg(column_name || ':' || printf('%.3f', ratio), ',' ORDER BY ratio DESC, column_name) FROM m)),
 (4, 'train_test_split', ''), (5, 'build_preprocessor', 'num=2,cat=2'), (6, 'fit_transform_preprocessor', ''), (7, 'train_model', 'linear_regression'),
 (8, 'predict', ''), (9, 'evaluate', 'r2,rmse,mae')) AS t(seq, step, detail)"""


def _part_config(**kwargs) -> PipelineConfig:
    return PipelineConfig(target=TargetSpec("explicit", "p_retailprice"), check_missing=True, **kwargs)


@query("run_log", _RUN_LOG)
def q_run_log(spark: SparkSession, d: str) -> DataFrame:
    from cairn.plans import run_regression, run_report

    res = run_regression(spark, _part_config(), part_frame(spark, d).drop("size_full"), key="p_partkey", unique_key=True)
    res.release()
    return run_report(spark, res.logs)


@query("run_predictions", f"""WITH {PART_SPLIT_CTE} SELECT p_partkey, ROUND(p_retailprice, 4) AS prediction FROM ps WHERE is_test""")
def q_run_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The run as a whole: the test rows and their predictions (the price is linear in the key)."""
    from cairn.plans import run_regression

    res = run_regression(spark, _part_config(), part_frame(spark, d).drop("size_full"), key="p_partkey", unique_key=True)
    return res.predictions.select("p_partkey", F.round("prediction", 4).alias("prediction"))


@query("run_payloads", """SELECT * FROM (VALUES
 ('good', 'ok', NULL, 'evaluate', true, 9), ('bad_target', 'error', 'execution_failed', 'identify_target', false, 3),
 ('bad_setting', 'error', 'configuration_error', NULL, false, 1), ('bad_step', 'error', 'execution_failed', NULL, false, 1)) AS t(run, status, error, last_action, has_r2, n_logs)
 WHERE (SELECT count(*) FROM part) > 0""")
def q_run_payloads(spark: SparkSession, d: str) -> DataFrame:
    from cairn.plans import StepRegistry, run_with_payload

    pf = part_frame(spark, d).drop("size_full")
    steps = StepRegistry()
    steps.register("narrow", lambda df: df.select("p_partkey", "pk_mod", "p_size", "p_retailprice"))
    good = run_with_payload(spark, PipelineConfig(target=TargetSpec("last_column")), df=pf, key="p_partkey", unique_key=True, steps=["narrow"], registry=steps)[0]
    bad = run_with_payload(spark, PipelineConfig(target=TargetSpec("explicit", "t")), df=part_spoiled(spark, d, 3))[0]
    setting = run_with_payload(spark, lambda: PipelineConfig(split=SplitPolicy(test_size=0.9)), df=pf)[0]
    step = run_with_payload(spark, PipelineConfig(), df=pf, steps=["unknown"], registry=steps)[0]
    out = None
    for name, p in (("good", good), ("bad_target", bad), ("bad_setting", setting), ("bad_step", step)):
        row = p.select(F.lit(name).alias("run"), "status", "error", F.try_element_at("actions", F.lit(-1)).alias("last_action"),
                       F.coalesce(F.map_contains_key("metrics", "r2"), F.lit(False)).alias("has_r2"), F.size("logs").alias("n_logs"))
        out = row if out is None else out.unionByName(row)
    return out


@query("user_steps", f"""WITH {PART_CTE} SELECT CAST(2 * count(*) AS BIGINT) AS n, CAST(greatest(1, least(2 * count(*) - 1, ceil(2 * count(*) * CAST(0.2 AS DOUBLE)))) AS BIGINT) AS n_test,
 'p_retailprice' AS target FROM pf""")
def q_user_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps that choose columns and double the rows; the last column is the target."""
    from cairn.plans import StepRegistry, run_regression

    steps = StepRegistry()
    steps.register("choose", lambda df: df.select("pk_mod", "p_size", "p_retailprice"))
    steps.register("double", lambda df: df.union(df))
    res = run_regression(spark, PipelineConfig(target=TargetSpec("last_column")), part_frame(spark, d), steps=["choose", "double"], registry=steps)
    return res.split.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test")).withColumn("target", F.lit(res.target))


@query("shape", f"WITH {LM_CTE} SELECT 'csv_shape=' || count(*) || 'x' || {len(LM_FEATURES)} AS entry FROM lm")
def q_shape(spark: SparkSession, d: str) -> DataFrame:
    """The shape that a run on a CSV file logs."""
    from cairn.plans import run_regression

    path = scratch_path(spark, "shape")
    _csv(lineitem_missing(spark, d).select(*LM_FEATURES), path)
    cfg = PipelineConfig(file=FileSpec(path, "utf-8", check_exists=False), target=TargetSpec("explicit", "l_extendedprice"))
    res = run_regression(spark, cfg)
    res.release()
    return spark.createDataFrame([(res.logs[1],)], "entry string")
