"""The thin queries ``opN_<name>`` over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import byte_bpe, conversation_repair, language_id, line_crf, line_dedup, merkle_manifest, ngram_join, one_bit_ann, oracles, packing, quality_rules, suffix_dedup, toxicity, wrapper_extract

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op1_ngram_jaccard_join": oracles.NGRAM_JOIN, "op3_suffix_array_dedup": oracles.SUFFIX_DEDUP,
                      "op11_merkle_manifest": oracles.MERKLE, "op12_conversation_repair": oracles.CONVERSATIONS,
                      "op13_line_dedup": oracles.LINE_DEDUP}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document under 5-word Jaccard >= 0.8."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text by the line model, learned without the held-out fold."""
    return line_crf.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of a 400-byte string that occurs twice goes; digest of what is left."""
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text and the verdict of the learned quality model."""
    return quality_rules.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the wrapper of its host."""
    return wrapper_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document in one piece of a full sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and confidence of every text."""
    return language_id.digest(table(spark, sf_dir, "documents"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text under the multilingual byte-level BPE, and the bytes decoded from them."""
    return byte_bpe.digest(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned without the held-out fold."""
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector with all others."""
    return one_bit_ann.digest(table(spark, sf_dir, "embeddings"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and the root of the tampered version of every document."""
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text's hash of every damaged conversation."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least five documents hold stay in the largest one only."""
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
