"""Language ID: held-out accuracy on the whole table, and the defined cases."""

from pyspark.sql import functions as F

from cairn.llm import language_id as li
from cairn.llm.linear import fit_temperature
from llm_tables import documents


def test_held_out_languages_are_found(spark, table):
    docs = table("documents")
    got = li.digest(docs)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).count() == len(held)


ROWS = ([(i, "the house and the garden of the king " + "and so on " * (i % 5), "en", "s", 1) for i in range(40)]
        + [(100 + i, "das haus und der garten des königs " + "und so weiter " * (i % 5), "de", "s", 1) for i in range(40)])
ODD = [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "123 !?", None, "s", 0), (None, "the king of the house", None, "s", 0),
       (204, "der könig und das haus", None, None, None), (204, "der könig und das haus", None, None, None), (205, "the garden " * 30_000, None, "s", 0)]


def test_defined_cases(spark):
    got = {(r.doc_id, r.lang_pred) for r in li.digest(documents(spark, ROWS + ODD, clashes=True)).collect()}
    assert {(200, "und"), (201, "und"), (202, "und"), (None, "en"), (204, "de"), (205, "en")} <= got
    unlabelled = documents(spark, [(1, "some text", None, None, None), (2, None, "en", None, None)])
    assert [(r.lang_pred, r.score) for r in li.digest(unlabelled).collect()] == [("und", 0.0)] * 2
    assert li.digest(documents(spark, [])).count() == 0


def test_filter_keeps_columns_and_fills_the_language(spark):
    docs = documents(spark, ROWS + ODD, clashes=True)
    out = li.keep_identified(docs)
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == len(ROWS) + 4
    assert {r.lang for r in rows if r.doc_id in (204, 205, None)} == {"de", "en"} and {r.score for r in rows} == {"own score"}
    assert li.keep_identified(documents(spark, [(1, "some text", None, None, None), (2, "123", None, None, None)])).count() == 1


def test_document_frequencies_cover_every_text(spark):
    docs = documents(spark, [(1, "aab"), (2, "ab"), (3, "b")])
    df, n = li.document_frequencies(docs)
    texts = next(li.tv.texts_of(__import__("pyarrow").array(["a", "b", "ab"])))[2]
    one, first = texts.char_grams(1)
    two, _ = texts.char_grams(2)
    assert n == 3 and df[li._column(one[:1], 1)] == 2 and df[li._column(one[first[1]:first[1] + 1], 1)] == 3 and df[li._column(two[-1:], 2)] == 2


def test_temperature_softens_overconfident_scores():
    import numpy as np

    scores = np.array([[9.0, 0.0], [9.0, 0.0], [9.0, 0.0], [9.0, 0.0]])
    assert fit_temperature(scores, np.array([0, 0, 0, 1])) > 2
    assert fit_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0
