"""Suffix-array dedup against counting every 400-byte string."""

import hashlib
import random
from collections import Counter

from cairn.llm import suffix_dedup as sd
from llm_tables import documents


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + 400] for r in raws for i in range(len(r) - 399))
    out = []
    for r in raws:
        covered = bytearray(len(r))
        for i in range(len(r) - 399):
            if seen[r[i:i + 400]] > 1:
                covered[i:i + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(r, covered) if not c)
        out.append((len(r), sum(covered), sum(bool(c) and not (i and covered[i - 1]) for i, c in enumerate(covered)), hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(110), text(95), text(300)]
    rows = [text(rng.randint(0, 80)) + p + text(rng.randint(0, 80)) for p in shared * 9]
    rows += [text(500)] * 3 + [shared[2] + "\n" + shared[2], shared[0][3:], "z" * 900, "ab" * 700, None, "", text(5)]
    rows += [shared[1][:399], shared[1][:400], shared[1][:401], "é" * 200 + text(3), "é" * 200 + text(4)]
    return rows


def test_spans_equal_all_windows(spark):
    texts = passages()
    want = dict(enumerate(brute(texts)))
    docs = documents(spark, list(enumerate(texts)), clashes=True)
    for hot in (sd.HOT_CONTEXTS, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digest(docs, hot).collect()}
        assert got == want
    assert sum(v[1] for v in want.values()) > 10_000


def test_documents_keep_their_columns_and_valid_text(spark):
    texts = passages()
    docs = documents(spark, [*enumerate(texts), (None, texts[0]), (3, texts[3])], clashes=True)
    out = sd.remove_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(texts) + 2 and {r.kept for r in rows} == {"own kept"}
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert [r.text for r in rows if r.doc_id == texts.index(None)] == [None]


def test_empty_table(spark):
    assert sd.digest(documents(spark, [])).count() == 0
    assert sd.remove_repeats(documents(spark, [])).count() == 0


def test_deep_shallow_order_and_reach():
    rng = random.Random(1)
    for _ in range(600):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(2, 40))]
        order, shared = sd.suffix_order(strings, rng.randint(0, 5))
        assert [strings[i] for i in order] == sorted(strings)
        assert shared[1:] == [sd.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    for _ in range(300):
        n, need = rng.randint(2, 40), 10
        before, after = ([bytes(rng.choice(b"aab") for _ in range(rng.randint(0, need))) for _ in range(n)] for _ in range(2))
        left, right = sd.reaches(before, after, need)
        for i in range(n):
            pairs = [(sd.common_prefix(before[i], before[j]), sd.common_prefix(after[i], after[j])) for j in range(n) if j != i]
            pairs = [p for p in pairs if sum(p) >= need]
            assert (left[i], right[i]) == ((max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else (-1, -1))
