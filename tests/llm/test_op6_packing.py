"""Packing: every id in one piece, no padding, the tokenizer's own ids."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cairn.llm import packing as pk
from llm_tables import documents


def check(spark, docs):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pk.pack(docs, with_ids=True).collect()
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append(np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        n = sum(r.length for r in s)
        assert n <= 4096 and n & (n - 1) == 0 and {r.tier for r in s} == {n}
        assert len({r.step_group for r in s}) == 1
    for doc, mine in pieces.items():
        mine.sort(key=lambda r: r.start)
        if len(ids[doc]) == 1:
            assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
            assert np.concatenate([r.ids for r in mine]).tolist() == ids[doc][0].tolist()
            assert {r.doc_tokens for r in mine} == {len(ids[doc][0])}
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    return rows


def test_whole_table_is_packed_without_padding(spark, table):
    rows = check(spark, table("documents").repartition(3))
    assert {512, 1024, 2048, 4096} <= {r.tier for r in rows}


def test_defined_cases(spark):
    rows = check(spark, documents(spark, [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "word " * 30_000), (5, "x" * 5_000), (6, "<|endoftext|> é İ 日本"), (7, "Some text <|endoftext|> more"), (8, "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext")], clashes=True))
    assert sum(r.length for r in rows if r.doc_id in (1, 2)) == 2
    special = sorted((r.start, r.ids) for r in rows if r.doc_id == 7)
    assert [i for _, ids in special for i in ids] == [836, 4160, 49407, 750, 2]
    assert pk.pack(documents(spark, [])).count() == 0


def test_word_by_word_ids_equal_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    fast, own, rng = pk.WordIds(path), Tokenizer.from_file(path), random.Random(0)
    letters = "aAé ÉßẞİıǅΣςσ'sS’tre\n\t\x1c\x85\xa0 ²½٣中文éﬁ<|endoftext|>ªµ×÷.,'LL日0123\x00ſK"
    for _ in range(4_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        assert fast.encode(text) == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_step_groups_hold_one_tier_and_like_costs():
    rng = random.Random(1)
    pieces = [pk.Piece(i, 0, bytes(4 * rng.randint(1, 4095)), 0) for i in range(900)]
    windows, left = pk.fill_windows(pieces)
    groups = pk.step_groups(windows)
    tiers, costs = defaultdict(set), defaultdict(float)
    for (size, window), g in zip(windows, groups):
        assert sum(map(len, window)) == size
        tiers[g].add(size)
        costs[size, g] += sum(len(p) ** 2 for p in window)
    assert all(len(t) == 1 for t in tiers.values())
    big = [c for (size, _), c in costs.items() if size == 4096]
    assert max(big) <= 1.5 * min(big)


def test_capitals_whose_small_letters_lie_above_the_plain_range():
    path = public_tokenizers.path("word_bpe_49k.json")
    fast, own, rng = pk.WordIds(path), Tokenizer.from_file(path), random.Random(3)
    for letter in map(chr, range(0x250)):
        for text in (f"{letter}li", f"a{letter}b {letter}", f"x1{letter}'s"):
            assert fast.encode(text) == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    capitals = [c for c in map(chr, range(0x250)) if c.lower() > "ɏ"] + list("abÉß 1'.")
    for _ in range(2_000):
        text = "".join(rng.choice(capitals) for _ in range(rng.randint(0, 12)))
        assert fast.encode(text) == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
