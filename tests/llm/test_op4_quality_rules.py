"""Base counts against plain Python, the learned verdict on documents that the fit did not see."""

import re
from collections import Counter

from pyspark.sql import functions as F

from cairn.llm import quality_rules as qr
from llm_tables import documents


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if twice[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_on_whole_table_and_odd_texts(spark, table):
    odd = [(1, None), (2, ""), (3, "a b c a b c"), (4, "é\n\né\n é\x0b|"), (5, "x " * 40_000), (5, "x " * 40_000), (None, "\x1c one\r\ntwo\r\none\r\n"), (7, "one two\none two\n\n \n \n")]
    for docs in (documents(spark, odd, clashes=True), table("documents")):
        want = Counter((r.doc_id, *counts(r.text)) for r in docs.select("doc_id", "text").collect())
        got = qr.judge(docs, None).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept != r.base_failed for r in got)


def test_learned_verdict_keeps_good_and_drops_bad_unseen_documents(spark, table):
    docs, labels = table("documents"), table("labels")
    unseen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 1
    model = qr.fit(docs, labels.where(~unseen))
    rows = qr.judge(docs, model).join(labels.where(unseen), "doc_id").where("not base_failed").collect()
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.97 * sum(r.quality == 1 for r in rows)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.2 * sum(r.quality == 0 for r in rows)


def test_filter_keeps_columns_and_works_without_labels(spark):
    docs = documents(spark, [(1, " ".join(f"w{i}" for i in range(60))), (2, None), (3, "short")], clashes=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = qr.keep_good(docs, none)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
    one_class = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in qr.keep_good(docs, one_class).collect()] == [1]
    assert qr.keep_good(docs.limit(0), none).count() == 0


def test_four_thousand_rows_are_learned_slice_by_slice(spark):
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 6 + i % 4))) for i in range(6_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6_000)], "doc_id long, quality int, toxic int")
    drawn = qr.labelled(documents(spark, rows), labels, "quality", qr.SAMPLE).select("text", "y", "held")
    assert 3_700 < drawn.count() < 4_300
    make = lambda parts: qr.map_arrow(drawn.repartition(parts), qr._sample_batch, "y int, held boolean, cols binary, vals binary, order long").persist()
    one = make(3)
    want = {h: sorted((r.y, bytes(r.cols), bytes(r.vals)) for r in one.collect() if r.held == h) for h in (False, True)}
    first, again = qr.gather(one), qr.gather(make(5))
    for h, (x, y), (x2, y2) in zip((False, True), first, again):
        got = [(int(y[i]), x.index[x.ptr[i] : x.ptr[i + 1]].tobytes(), x.value[x.ptr[i] : x.ptr[i + 1]].tobytes()) for i in range(len(y))]
        assert sorted(got) == want[h]
        assert (x.ptr == x2.ptr).all() and (x.index == x2.index).all() and (x.value == x2.value).all() and (y == y2).all()
