"""Small tables for the corpus operators' tests."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the user whose names an operator might use itself.
CLASHES = ("k1", "k2", "rid", "node", "_text", "_kept", "_new", "kept", "score", "lang_pred", "hits", "root", "_rows", "probability", "y", "held", "Score2")


def documents(spark, rows, clashes=False):
    """A small documents table from (doc_id, text) or full rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clashes:
        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    return df
