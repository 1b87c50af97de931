"""Conversation repair against a plain dynamic programme over all edits."""

import hashlib
import itertools
import random
import zlib

import pytest

from cairn.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """The rows after damage, in order: (turn, role, text)."""
    out = []
    said = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(ch for ch in text if ch not in ".!?")
        if hit == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def legal(initials):
    s = "".join(initials)
    if s.startswith("s"):
        s = s[1:]
        if not s:
            return False
    return s == "ua" * (len(s) // 2)


def scripts(rows, told, inserts):
    """Every sequence of edits with at most so many insertions in a row: (cost, audit, repaired lines)."""
    gaps = [c for k in range(inserts + 1) for c in itertools.product(("user", "assistant"), repeat=k)]
    choices = []
    for (_, role, text), fault in zip(rows, told):
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            own += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
        choices.append(own)
    for edits in itertools.product(*choices):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                for role in added[k]:
                    cost, audit = cost + 5, audit + "I"
                    lines.append((role, ""))
                if k < len(rows):
                    letter, c, line = edits[k]
                    cost, audit = cost + c, audit + letter
                    if line:
                        lines.append(line)
            if legal(role[:1] for role, _ in lines):
                yield cost, audit, lines


def programme(rows, told):
    """The same by a table over (rows, roles so far), for longer conversations."""
    step = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ())}

    def insertions(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                role = step[state]
                new = (cost + 5, audit + "I", (*lines, (role, "")))
                if role[0] not in states or new[:2] < states[role[0]][:2]:
                    states[role[0]] = new
        return states

    for (_, role, text), fault in zip(rows, told):
        before, best = insertions(best), {}
        for state, (cost, audit, lines) in before.items():
            options = [(state, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                options.append((step[state][0], cost + 1 + extra, audit + "R", (*lines, (step[state], text))))
                if role[:1] == step[state][0] or (role[:1] == "s" and state == ""):
                    options.append((role[0], cost + extra, audit + "K", (*lines, (role, text))))
            for s, c, a, ls in options:
                if s not in best or (c, a) < best[s][:2]:
                    best[s] = (c, a, ls)
    best = insertions(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda t: t[:2])


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = []
    for conv, own in by.items():
        after = damage(own)
        told = faults(after)
        turns = [r[0] for r in after if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = programme(after, told)
        text = "\n".join(f"{role}:{t}" for role, t in lines)
        out.append((conv, gaps, told.count("blank"), told.count("duplicate"), told.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in cr.repair(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ünknown"])
            text = rng.choice(["Yes.", "No!", "And", "so", "", " \n", "Why?  ", f"Text {rng.random()}.", f"Text {rng.random()}"])
            rows.append((conv, turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 5])
    return rows


def test_search_equals_all_scripts():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(0, 3)
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), "x") for i in range(n)]
        told = [rng.choice([None, None, "blank", "truncated"]) for _ in range(n)]
        want = min((c, a) for c, a, _ in scripts(rows, told, 2 if n < 3 else 1))
        codes = bytes(4 * {None: cr.SOUND, "blank": cr.GOES, "truncated": cr.LOOSE}[f] + "sua".find(r[1][0]) % 4 for r, f in zip(rows, told))
        assert cr.cheapest(codes) == want == programme(rows, told)[:2]


def test_chunks_and_folding_equal_one_search():
    rng = random.Random(4)
    for n in (1, 5, 23, 60):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9, 10]) for _ in range(n))
        folding = cr.Folding()
        for i in range(0, n, 7):
            folding.add(cr.matrix(codes[i:i + 7]))
        m = folding.result()
        assert min(x for x in (m[0], m[3]) if x) == cr.cheapest(codes)
        assert m == cr.matrix(codes)


def test_equals_the_programme(spark):
    rows = random_rows(7, 300, 14)
    random.Random(1).shuffle(rows)
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("parts", ["3", "16"])
def test_one_very_long_conversation_over_many_ranges(spark, parts):
    rng = random.Random(9)
    rows = [(5, i, ["user", "assistant"][i % 2] if rng.random() < 0.9 else "system", rng.choice(["Same.", f"t {i}.", f"t {i}", " "])) for i in range(1500)]
    rows += random_rows(8, 5, 6)[:20] + [(10**12, 0, "user", "a.")]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(spark, [r for r in rows if r[0] != 5 or True]) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_defined_cases(spark):
    rows = [(1, None, "user", "a."), (1, None, None, "b."), (None, 3, "assistant", "c."), (None, None, "user", None), (2, None, None, None),
            (3, 7, "user", "Long. " * 100_000), (3, 9, "assistant", "x\x85."), (4, -5, "", "e."), (4, 900, "system", "f."), (5, 1, "system", "g.")]
    rows += [(6, 2, "user", "same.")] * 3 + [(7, t, "user", f"{t}") for t in range(12)]
    assert got(spark, rows) == expected(rows)
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "a.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(spark, []) == []


def test_extra_columns_play_no_part(spark, table):
    from pyspark.sql import functions as F

    conversations = table("conversations")
    more = conversations.withColumns({c: F.lit("own") for c in ("kind", "tie", "copy", "audit", "cost", "dropped", "hit", "k1")})
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in cr.repair(more).collect()), key=repr) == expected(rows)
