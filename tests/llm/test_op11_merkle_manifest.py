"""Merkle manifest against plain Python; versions share what they do not copy."""

import hashlib
import zlib

import pytest

from cairn.llm import merkle_manifest as mm
from llm_tables import documents

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(field(v) for v in (row[0], row[3], row[2], row[4], text)))


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 16
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
        i //= 16
    return out


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
    trees = {s: build([leaf_of(r, r[1]) for r in by[s]]) for s in sources}
    top = build([trees[s][-1][0] for s in sources])
    root = top[-1][0] if sources else None
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            siblings = path(trees[s], i) + path(top, k)
            node = leaf_of(r, r[1])
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                node = leaf_of(r, r[1].translate(str.maketrans(UPPER, UPPER.lower())))
            for left, right in siblings:
                node = sha(left + node + right)
            out.append((r[0], leaf_of(r, r[1]), trees[s][-1][0], root, sha("".join(a + b for a, b in siblings)), node, node == root))
    return sorted(out, key=repr)


def got(spark, rows, depth=mm.LEVELS, clashes=False):
    return sorted((tuple(r) for r in mm.manifest(documents(spark, rows, clashes), depth).collect()), key=repr)


def table_rows(sizes):
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            doc += 1
            rows.append(((doc * 7919) % 100_003, f"Text {doc}" if doc % 3 else f"text {doc}", "en", source, doc))
    return rows


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_equals_plain_python_over_several_rounds(spark, depth):
    sizes = {"a": 1, "b": 16, "c": 17, "é": 257, "Z": 700, None: 33, "": 2} | {f"s{i}": 1 for i in range(30)}
    rows = table_rows(sizes)
    assert got(spark, rows, depth, clashes=depth == 3) == brute(rows)


def test_one_source_of_more_than_a_block(spark):
    rows = table_rows({"hot": 4096 + 300, "small": 4})
    want = brute(rows)
    assert got(spark, rows) == want
    changed = [r for r in want if not r[6]]
    assert 300 < len(changed) < 1000 and len({r[5] for r in changed}) == len(changed)  # a version of its own each


def test_defined_cases(spark):
    rows = [(None, "A", None, None, None), (None, None, "x", None, 3), (5, None, "en", "s", None), (5, "B", "en", "s", 1), (5, "B", "en", "s", 1),
            (-3, "", "", "", 0), (10, "Long " * 200_000, "en", "s", 10), (11, "É a\x00b\nC", "fr", "ü", -1)]
    assert got(spark, rows, clashes=True) == brute(rows)
    assert got(spark, rows[2:3]) == brute(rows[2:3])
    assert got(spark, rows[2:3])[0][4] == hashlib.sha256(b"").hexdigest()
    assert got(spark, []) == []


def test_versions_copy_ancestors_only():
    nodes = [mm.H(b"%d" % i) for i in range(300)]
    tree = mm.Tree(list(nodes), 300, 3)
    before = [list(level) for level in tree.levels]
    copied = tree.version(299, b"x")
    assert len(copied) == 4 and [list(level) for level in tree.levels] == before
    nodes[299] = b"x"
    assert copied[-1] == mm.Tree(nodes, 300, 3).top
    assert tree.version(17, tree.levels[0][17])[-1] == tree.top
