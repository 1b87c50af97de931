"""From raw documents to packed training sequences.

``STAGES``: quality rules, language identification, n-gram Jaccard join (one
document of each class stays), suffix-array dedup, packing. Each stage takes
``(spark, docs, sf_dir)`` and works on all documents that its predecessor kept;
all but the last return the columns of ``documents``. ``run`` writes every
stage's result as Parquet under the shared folder and reads it back as the next
stage's input, so a lost executor never costs more than one stage.

The pipeline has no SQL form (learned models, suffix arrays, a tokenizer), so
``ORACLE_SQL`` is ``None``; the tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import language_id, ngram_join, packing, quality_rules, suffix_dedup
from cairn.session import ensure_checkpoint_dir, scratch_path, ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base counts or the learned quality model go."""
    ship_package(spark)
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go; a null ``lang`` is filled in."""
    ship_package(spark)
    return language_id.keep_identified(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies stays."""
    ship_package(spark)
    return ngram_join.keep_one(docs)


#: Bytes from which a repeated passage goes: a passage of over 50 words is meant, and of the windows of
#: 51 words in the documents 999 in 1,000 are longer (English 203 to 305 bytes, the other languages more).
PASSAGE_BYTES = 200


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``PASSAGE_BYTES`` bytes or more that occur twice are cut from the texts."""
    ship_package(spark)
    return suffix_dedup.remove_repeats(docs, span=PASSAGE_BYTES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in full sequences."""
    ship_package(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("suffix_array_dedup", repeat_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
