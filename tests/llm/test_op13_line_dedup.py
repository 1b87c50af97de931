"""Line dedup against plain Python, and the levels of its runs."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from cairn.llm import line_dedup as ld
from llm_tables import documents

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def key(line):
    return line.translate(str.maketrans(UPPER, UPPER.lower())).strip(" \t\n\x0b\x0c\r")


def brute(rows, chars=ld.MIN_CHARS, least=ld.MIN_DOCS):
    held = defaultdict(list)
    for doc, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= chars:
                held[k].append(-1 if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = -1 if doc is None else doc
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= least and max(held[key(x)]) != own)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, clashes=False):
    return sorted((tuple(r) for r in ld.digest(documents(spark, rows, clashes)).collect()), key=repr)


def sample():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(9) for _ in range(30)]
    rows = []
    for doc in range(120):
        lines = [line(rng.randint(0, 12)) for _ in range(rng.randint(0, 6))]
        for s in rng.sample(shared, rng.randint(0, 4)):
            lines.insert(rng.randint(0, len(lines)), rng.choice([s, s.upper() if s.isascii() else s, f"\t {s}\x0b\r", s.title() if s.isascii() else s]))
        rows.append((doc * 7 - 50, "\n".join(lines)))
    return rows


def test_equals_plain_python(spark):
    rows = sample()
    want = brute(rows)
    assert got(spark, rows, clashes=True) == want and sum(r[2] for r in want) > 50
    rng = random.Random(1)
    rng.shuffle(rows)
    assert got(spark, rows) == want  # the order of rows plays no part


def test_defined_cases(spark):
    long_line = "the same line of more than forty characters, x"
    exact, short = "y" * 40, "z" * 39
    rows = [(i, f"{long_line}\n{exact}\n{short}\n{i}") for i in range(1, 6)]
    rows += [(5, f"{long_line}\nagain"), (None, long_line), (None, None), (77, None), (78, ""), (79, "\n"), (80, "tail\n"), (81, long_line + "\xa0")]
    rows += [(90, "\n".join([long_line] * 3000 + [exact.upper()]))]  # a very long text that holds both
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:4]) == brute(rows[:4])  # four documents are not enough
    only = [(None, exact)] * 6
    assert got(spark, only) == brute(only)
    assert got(spark, []) == []


def test_common_key_goes_to_all_tasks(spark, monkeypatch):
    rows = [(i, "a line that very many documents of the table hold\n" + f"own line number {i} of forty characters and more") for i in range(1500)]
    monkeypatch.setattr(ld, "HOT_KEYS", 10)
    assert got(spark, rows) == brute(rows)


def test_runs_are_levelled_and_hold_every_key_fresh_once(spark):
    docs = documents(spark, sample())
    lines = ld.eligible_lines(docs).cache()
    want = {(r.h1, r.h2): (r.n, r.d) for r in lines.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("d")).collect()}
    runs = ld.LineRuns(spark, fan=2)
    sizes = []
    for lo in range(800, -101, -100):  # the largest documents first
        runs.add(lines.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 100)))
        sizes.append([len(level) for level in runs.levels])
    assert sizes[:4] == [[1], [0, 1], [1, 1], [0, 0, 1]]
    assert max(len(s) for s in sizes) == 4 and len(sizes) == 10
    got_keys = {(r.h1, r.h2): (r.n, r.holder) for r in runs.totals().collect()}
    assert got_keys == want
    plan = ld.LineRuns._merged(runs.runs)._jdf.queryExecution().executedPlan().toString()
    assert len(runs.runs) == 2 and "SortMergeJoin" in plan and "Exchange" not in plan
    runs.forget()


def test_only_dataframe_functions(spark, table):
    plan = ld.digest(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
