"""Byte-level BPE: ids of the tiktoken library, exact round trip, perfect hash."""

import hashlib
import random

import public_tokenizers
import tiktoken

from cairn.llm import byte_bpe as bb
from llm_tables import documents


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bb.codec().ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    table, keys = bb.codec().table, bb.codec().keys
    assert sorted(table.place) == list(range(len(keys)))
    assert all(keys[table.slot(k)] == k for k in keys)
    for n in (0, 1, 2, 7):
        small = [f"k{i}".encode() for i in range(n)]
        assert [bb.PerfectHash(small).slot(k) for k in small] == list(range(n))


def test_ids_equal_the_library_on_odd_texts():
    own, codec, rng = library(), bb.codec(), random.Random(0)
    letters = "aAé ÉßẞİıΣς'sS’tre\n\t\x1c\x85\xa0　 ²½٣中文éﬁ<|endoftext|>ªµ×.,LL日0123\x00ſK🙂👍🏽aaaaa\r\n  "
    for _ in range(4_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        ids = codec.encode(text)
        assert ids == own.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_whole_table_and_defined_cases(spark, table):
    own = library()
    odd = documents(spark, [(1, None), (2, ""), (3, "<|endoftext|>"), (3, "<|endoftext|>"), (None, "é\n\n  x"), (5, "a" * 3_000 + " word" * 40_000)], clashes=True)
    for docs in (table("documents"), odd):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = own.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = [tuple(r) for r in bb.digest(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bb.digest(odd.limit(0)).count() == 0


def test_encode_then_decode(spark):
    docs = documents(spark, [(1, "Grüße, world!  "), (2, None), (None, "日本 🙂")])
    assert {(r.doc_id, r.text) for r in bb.decode(bb.encode(docs)).collect()} == {(1, "Grüße, world!  "), (2, ""), (None, "日本 🙂")}


def test_remembered_generations_stay_bounded(monkeypatch):
    monkeypatch.setattr(bb, "REMEMBERED", 50)
    codec, own = bb.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), library()
    text = " ".join(f"qx{i % 170}z" for i in range(2_000))
    assert codec.encode(text) == own.encode_ordinary(text) and len(codec.known) <= 50 and len(codec.known.old) <= 50
