"""Repair of conversations by least edits, found by a bidirectional Dijkstra search over the edit lattice.

A conversation's rows go by turn. A row's first fault counts: *blank*,
*duplicate* (role and text seen earlier) or *truncated* (its last character
that is not blank is none of ``.!?``). Edits: Keep (0), Rerole to user or
assistant (1), Delete (2; required for blank and duplicate rows) and Insert an
empty user or assistant row (5); a truncated row that stays adds 5. The roles
that remain must read ``(s?(ua)+)?`` by their initials. The audit is the
edits' initials in order; of all cheapest ones the least is taken.

The lattice has a node per (rows consumed, state), the states being nothing
yet, system, user, assistant. Since the next role is forced by the state, an
audit determines the repaired conversation. :func:`cheapest` searches from both
ends, each heap giving every node its least cost and, among equals, its least
audit; when the heaps have met, all crossings of equal cost are finished before
the least concatenated audit is picked.

Scale. No conversation is gathered:

1. A light row (ids, hashes, role initial and flags, no text) is written per
   row. First occurrences of (role, text) are found by a pre-aggregated minimum
   of the row's order key and meet their row by sorting, not by a join.
2. Light rows are dealt and sorted by ranges of (conversation, turn), so a
   conversation that holds most of the rows is spread over many tasks. Each task
   reads its range as a stream. A conversation that lies inside one range is
   solved at once; one that goes over its ends, or has more than ``CHUNK`` rows,
   is cut into chunks, each searched from every state to every state and folded
   into one piece per task. Pieces of a conversation are joined in their order:
   (cost, audit) compose, as two audits of equal cost between the same nodes are
   never prefixes of each other.
3. The edits meet the texts in one more sort by conversation, where each text is
   hashed as it passes. SHA-256 is sequential by nature, so one conversation is
   one stream; no more than a batch of it is held, beside its audit.

Defined cases: in strings a null is one space (so a null text is blank and a
null role is no legal one); a null conv_id is a conversation of its own; a null
turn comes first and counts in no gap; rows of equal turn go by the hash of
their role and text, copies side by side; repeated rows are duplicates; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_arrow_stream, written

#: Rows of a chunk of the lattice that is searched at once.
CHUNK = 256
BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 1, 2, 5, 5
#: Lattice states: nothing yet, system, user, assistant; the state that the next user or assistant row leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Initials as a light row holds them: s, u, a, any other; and what a row asks for.
INITIALS = "sua"
OTHER = 3
SOUND, GOES, LOOSE = range(3)
Path = tuple[int, str]


def _kept(state: int, initial: int) -> int | None:
    """The state after a row that keeps its role, if that is legal."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    wanted = NEXT[state]
    return wanted if (initial == 1 and wanted == USER) or (initial == 2 and wanted == ASSISTANT) else None


def _row_edges(code: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letter) of a row with this code (4 × fault + initial)."""
    fault, initial = divmod(code, 4)
    edges = [(p, p, DELETE, "D") for p in STATES]
    if fault != GOES:
        extra = UNENDED if fault == LOOSE else 0
        for p in STATES:
            if (q := _kept(p, initial)) is not None:
                edges.append((p, q, KEEP + extra, "K"))
            edges.append((p, NEXT[p], REROLE + extra, "R"))
    return edges


FORWARD: list[list[list[tuple[int, int, str]]]] = [[[(q, c, x) for p, q, c, x in _row_edges(code) if p == s] for s in STATES] for code in range(12)]
REVERSE: list[list[list[tuple[int, int, str]]]] = [[[(p, c, x) for p, q, c, x in _row_edges(code) if q == s] for s in STATES] for code in range(12)]
INSERTS_TO: list[list[int]] = [[p for p in STATES if NEXT[p] == s] for s in STATES]


def cheapest(codes: bytes, start: int = NOTHING, targets: tuple[int, ...] = (NOTHING, ASSISTANT)) -> Path | None:
    """(cost, audit) of the cheapest and among equals least edits from ``start`` to a target over all rows.

    A heap's entries are (cost, rows consumed from its end, audit, state): edges
    of cost 0 consume a row, so a node's first entry off the heap has its least
    cost and its least audit.
    """
    n = len(codes)
    done_f: dict[tuple[int, int], Path] = {}
    done_r: dict[tuple[int, int], Path] = {}
    heap_f = [(0, 0, "", start)]
    heap_r = [(0, 0, "", t) for t in targets]
    best: Path | None = None

    def met(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = (cost, audit)

    while heap_f or heap_r:
        # a path not seen yet goes on from both heaps, or from the one that is left
        reach_f, reach_r = (h[0][0] if h else 0 for h in (heap_f, heap_r))
        if best is not None and reach_f + reach_r > best[0]:
            break
        if not heap_r or (heap_f and reach_f < reach_r):
            cost, i, audit, state = heapq.heappop(heap_f)
            if (i, state) in done_f:
                continue
            done_f[i, state] = (cost, audit)
            steps = [(i, NEXT[state], INSERT, "I")]
            if i < n:
                steps += [(i + 1, q, c, x) for q, c, x in FORWARD[codes[i]][state]]
            if (other := done_r.get((i, state))) is not None:
                met(cost + other[0], audit + other[1])
            for j, q, c, x in steps:
                if (other := done_r.get((j, q))) is not None:
                    met(cost + c + other[0], audit + x + other[1])
                if (j, q) not in done_f:
                    heapq.heappush(heap_f, (cost + c, j, audit + x, q))
        else:
            cost, back, audit, state = heapq.heappop(heap_r)
            i = n - back
            if (i, state) in done_r:
                continue
            done_r[i, state] = (cost, audit)
            steps = [(i, p, INSERT, "I") for p in INSERTS_TO[state]]
            if i > 0:
                steps += [(i - 1, p, c, x) for p, c, x in REVERSE[codes[i - 1]][state]]
            if (other := done_f.get((i, state))) is not None:
                met(other[0] + cost, other[1] + audit)
            for j, p, c, x in steps:
                if (other := done_f.get((j, p))) is not None:
                    met(other[0] + c + cost, other[1] + x + audit)
                if (j, p) not in done_r:
                    heapq.heappush(heap_r, (cost + c, n - j, x + audit, p))
    return best


@lru_cache(maxsize=20_000)
def _cheapest_short(codes: bytes) -> Path:
    return cheapest(codes)


def solved(codes: bytes) -> Path:
    return _cheapest_short(codes) if len(codes) <= 16 else cheapest(codes)


Matrix = list[Path | None]


def matrix(codes: bytes) -> Matrix:
    """The cheapest path between every two states over these rows (index 4 × before + after)."""
    return [cheapest(codes, p, (q,)) for p in STATES for q in STATES]


def joined(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for p in STATES:
        for q in STATES:
            ways = [(x[0] + y[0], x[1] + y[1]) for m in STATES if (x := a[4 * p + m]) is not None and (y := b[4 * m + q]) is not None]
            out.append(min(ways, default=None))
    return out


class Folding:
    """Matrices joined in order, neighbours of equal size first, so that every audit is copied a logarithm of times."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, Matrix]] = []

    def add(self, m: Matrix) -> None:
        size = 1
        while self.stack and self.stack[-1][0] == size:
            m = joined(self.stack.pop()[1], m)
            size *= 2
        self.stack.append((size, m))

    def result(self) -> Matrix | None:
        out = None
        for _, m in reversed(self.stack):
            out = m if out is None else joined(m, out)
        return out


# ---- damage and light rows ---------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, copy, role, text, dropped): the rows after damage, the dropped ones marked."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), hit.alias("hit"),
                                F.xxhash64(said("role"), said("text")).alias("tie"), said("role").alias("role"), said("text").alias("text"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "tie", F.explode(copies).alias("copy"), F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("hit") == 0).alias("dropped"))


ORDER = ("turn", "tie", "copy")


def light_rows(rows: DataFrame) -> DataFrame:
    """The rows without their texts: order key, hash of role and text, role initial, blank and unended flags."""
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    first = F.substring("role", 1, 1)
    initial = F.lit(OTHER)
    for k, letter in enumerate(INITIALS):
        initial = F.when(first == letter, k).otherwise(initial)
    return rows.select("conv_id", *ORDER, F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("second"), F.col("text"), F.col("role")).alias("k2"),
                       initial.cast("int").alias("initial"), (bare == "").alias("blank"),
                       (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("unended"), "dropped")


def ordered_light(light: DataFrame) -> DataFrame:
    """Rows (kind 1) in ranges of their order, each first of its role and text after a marker (kind 0) with its order key."""
    firsts = (light.where("NOT dropped").groupBy("conv_id", "k1", "k2").agg(F.min(F.struct(*ORDER)).alias("o"))
              .select("conv_id", "o.*", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("initial"),
                      *[F.lit(None).cast("boolean").alias(c) for c in ("blank", "unended", "dropped")]))
    both = light.select("conv_id", *ORDER, F.lit(1).alias("kind"), "initial", "blank", "unended", "dropped").unionByName(firsts)
    return both.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER, "kind")


# ---- one range of light rows -------------------------------------------------------------------

COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal")
PIECE = ("conv_id long, part int, " + ", ".join(f"{c} long" for c in COUNTS) + ", turns long, first_turn long, last_turn long, first_initial int, last_initial int,"
         " whole boolean, cost long, audit string, costs array<long>, audits array<string>")
_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), *[(c, pa.int64()) for c in COUNTS], ("turns", pa.int64()), ("first_turn", pa.int64()),
                    ("last_turn", pa.int64()), ("first_initial", pa.int32()), ("last_initial", pa.int32()), ("whole", pa.bool_()), ("cost", pa.int64()),
                    ("audit", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Conversation:
    """What has been read of one conversation in one range."""

    def __init__(self, conv_id: int | None, first: bool):
        self.conv_id, self.first = conv_id, first
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns, self.first_turn, self.last_turn, self.first_initial, self.last_initial = 0, None, None, None, None
        self.codes, self.folding = bytearray(), Folding()
        self.marked = None

    def row(self, key: tuple, initial: int, blank: bool, unended: bool) -> None:
        known = self.marked != key
        self.marked = None
        fault = "blank" if blank else "duplicate" if known else "truncated" if unended else None
        self.counts["rows"] += 1
        if fault:
            self.counts[fault] += 1
        if self.last_initial is None:
            self.first_initial = initial
        elif (self.last_initial, initial) not in LEGAL:
            self.counts["illegal"] += 1
        self.last_initial = initial
        turn = key[0]
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.codes.append(4 * (SOUND if fault is None else LOOSE if fault == "truncated" else GOES) + initial)
        if len(self.codes) == CHUNK:
            self.folding.add(matrix(bytes(self.codes)))
            self.codes.clear()

    def piece(self, part: int, last: bool) -> dict:
        out = {"conv_id": self.conv_id, "part": part, **self.counts, "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn,
               "first_initial": self.first_initial, "last_initial": self.last_initial}
        if not (self.first or last or self.folding.stack):
            cost, audit = solved(bytes(self.codes))
            return out | {"whole": True, "cost": cost, "audit": audit}
        if self.codes:
            self.folding.add(matrix(bytes(self.codes)))
        m = self.folding.result() or matrix(b"")
        return out | {"whole": False, "costs": [x and x[0] for x in m], "audits": [x and x[1] for x in m]}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    now: _Conversation | None = None
    out: list[dict] = []
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", *ORDER, "kind", "initial", "blank", "unended", "dropped")]
        for conv, turn, tie, copy, kind, initial, blank, unended, dropped in zip(*columns):
            if now is None or now.conv_id != conv:
                if now is not None:
                    out.append(now.piece(part, last=False))
                now = _Conversation(conv, first=now is None)
            if kind == 0:
                now.marked = (turn, tie, copy)
            elif not dropped:
                now.row((turn, tie, copy), initial, blank, unended)
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, _PIECE)
            out = []
    if now is not None:
        out.append(now.piece(part, last=True))
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECE)


SOLVED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SOLVED = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def _put_together(pieces: pa.Table) -> pa.Table:
    """The pieces of one conversation, one per range that it touches."""
    rows = sorted(pieces.to_pylist(), key=lambda r: r["part"])
    total = dict.fromkeys(COUNTS, 0)
    folding = Folding()
    turns, first_turn, last_turn, last_initial = 0, None, None, None
    for r in rows:
        for c in COUNTS:
            total[c] += r[c]
        if r["first_initial"] is not None:
            total["illegal"] += last_initial is not None and (last_initial, r["first_initial"]) not in LEGAL
            last_initial = r["last_initial"]
        if r["first_turn"] is not None:
            turns += r["turns"] - (r["first_turn"] == last_turn)
            first_turn = r["first_turn"] if first_turn is None else first_turn
            last_turn = r["last_turn"]
        folding.add([None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])])
    m = folding.result()
    cost, audit = min(x for x in (m[4 * NOTHING + NOTHING], m[4 * NOTHING + ASSISTANT]) if x is not None)
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - turns
    row = {"conv_id": rows[0]["conv_id"], "gaps": gaps, **{c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}
    return pa.Table.from_pylist([row], _SOLVED)


def edits(conversations: DataFrame) -> DataFrame:
    """Counts, cost and audit of every conversation."""
    light = written(light_rows(damaged(conversations)), "conversation-light")
    pieces = written(map_arrow_stream(ordered_light(light), _pieces, PIECE), "conversation-pieces")
    gaps = F.when(F.col("first_turn").isNull(), F.lit(0)).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"))
    whole = pieces.where("whole").select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    over = pieces.where("NOT whole").groupBy("conv_id").applyInArrow(_put_together, SOLVED)
    return whole.unionByName(over)


# ---- texts -------------------------------------------------------------------------------------

NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired_sha256 string"
_RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in NUMBERS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
SAID = {USER: "user", ASSISTANT: "assistant"}


class _Repair:
    """The repaired conversation, line by line as its rows pass, into a hash."""

    def __init__(self, row: dict):
        self.row, self.at, self.state, self.sha, self.lines = row, 0, NOTHING, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def inserted(self) -> None:
        audit = self.row["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.line(SAID[self.state], "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.row["audit"][self.at]
        self.at += 1
        if letter == "K":
            self.state = SYSTEM if role[0] == "s" else NEXT[self.state]
            self.line(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.line(SAID[self.state], text)

    def result(self) -> dict:
        self.inserted()
        return self.row | {"repaired_sha256": self.sha.hexdigest()}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Repair | None = None
    out: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if row["kind"] == 0:
                if now is not None:
                    out.append(now.result())
                now = _Repair({c: row[c] for c in ("conv_id", *NUMBERS, "audit")})
            else:
                now.take(row["role"], row["text"])
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, _RESULT)
            out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield pa.RecordBatch.from_pylist(out, _RESULT)


def repair(conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of the repaired text of every conversation."""
    found = written(edits(conversations), "conversation-edits")
    none: dict[str, Column] = {"turn": F.lit(None).cast("long"), "tie": F.lit(None).cast("long"), "copy": F.lit(None).cast("int"),
                               "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    heads = found.select("conv_id", F.lit(0).alias("kind"), *[c.alias(name) for name, c in none.items()], *NUMBERS, "audit")
    rows = damaged(conversations).where("NOT dropped").select(
        "conv_id", F.lit(1).alias("kind"), *none, *[F.lit(None).cast("long").alias(c) for c in NUMBERS], F.lit(None).cast("string").alias("audit"))
    stream = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return map_arrow_stream(stream, _hashed, RESULT)
