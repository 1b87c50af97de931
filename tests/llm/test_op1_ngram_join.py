"""Jaccard classes against all pairs of shingle sets."""

import random
from collections import defaultdict

from cairn.llm import ngram_join as nj
from cairn.llm.graph import components
from llm_tables import documents


def shingles(text):
    w = (text or "").encode().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    nodes = defaultdict(list)
    for i, t in rows:
        if shingles(t):
            nodes[shingles(t)].append(i)
    keys = list(nodes)
    up = list(range(len(keys)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if both and 5 * both >= 4 * (len(keys[a]) + len(keys[b]) - both):
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    low = {}
    for k, s in enumerate(keys):
        low[find(k)] = min([low.get(find(k), 1 << 60), *nodes[s]])
    place = {s: k for k, s in enumerate(keys)}
    return {i: (low[find(place[shingles(t)])], links[place[shingles(t)]], len(nodes[shingles(t)])) if shingles(t) else (i, 0, 1) for i, t in rows}


def near_copies(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 5, 9, 60, 200]))]
        for _ in range(rng.choice([1, 2, 14])):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_classes_and_links_equal_all_pairs(spark):
    rows = near_copies() + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "one"), (905, "one two  three"), (906, "one two\nthree"), (907, "long " * 60_000)]
    want = brute(rows)
    for block in (nj.BLOCK, 3):
        got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in nj.jaccard_classes(documents(spark, rows, clashes=True), block).collect()}
        assert got == want
    assert max(v[1] for v in want.values()) >= 3


def test_one_of_each_class_stays_with_all_columns(spark):
    rows = [(2, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (None, "h i j k l m"), (5, None), (6, ""), (7, "h i j k l m")]
    docs = documents(spark, rows, clashes=True)
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 5, 6, 7]
    assert {r.k1 for r in kept.collect()} == {"own k1"}


def test_empty_table_and_null_ids(spark):
    assert nj.jaccard_classes(documents(spark, [])).count() == 0
    assert nj.keep_one(documents(spark, [])).count() == 0
    got = nj.jaccard_classes(documents(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.class_id, r.n_links, r.n_copies) for r in got) == [(None, 0, 1), (None, 0, 2), (None, 0, 2)]


def test_prefixes_are_shortened_until_the_recall_is_reached():
    d = nj.prefix_depth()
    assert 1 - (1 - 0.8**d) ** nj.TREES >= nj.TARGET_RECALL > 1 - (1 - 0.8 ** (d + 1)) ** nj.TREES
    assert nj.prefix_depth(trees=1, longest=5, target=0.99999) == 1


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(12)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(13)} | {i: 100 for i in range(100, 160)}
