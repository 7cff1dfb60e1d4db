"""Conversation structure repair (operator 12): the cheapest edits that make a conversation alternate, by depth-first branch-and-bound.

Rows of a conversation are kept, given another role, deleted or joined by inserted empty rows until their role initials read
``(s?(ua)+)?``. The search walks the rows with an explicit stack; a node is the number of rows done and what may follow. A prefix is cut off if its cost plus the
least that the remaining rows can cost is above the incumbent (cost, audit), or if its node's dominance table holds a prefix that is no
worse. When the stack is empty, the incumbent is proved best.

Rows are sorted by ranges of (conversation, turn), so a conversation of any length is spread over tasks. A whole conversation inside a range is
solved there. Of one that a range may cut, and of long ones, runs of rows give the cheapest edits from each entry to each exit
state; these are put together pairwise, and only the digest of the repaired text follows the rows once more, in constant memory.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, scratch

# What has been written so far: nothing (0), a system row (1), a user row (2), an assistant row (3). A repaired conversation ends in 0 or 3.
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)  # the state after a user or assistant row, of which each state admits one
NAMES = {2: "user", 3: "assistant"}
ENDS = (0, 3)
LEAST = {"x": 2, "s": 0, "u": 0, "a": 0, "o": 1, "S": 2, "U": 2, "A": 2, "O": 2}  # the cheapest edit of a row by its code
RUN = 48  # rows of one search
HELD_ROWS, HELD_BYTES = 4096, 16 << 20  # beyond either, a conversation's texts aren't held for its digest

Found = tuple[int, str]  # cost, audit


def code(initial: str, fault: str) -> str:
    """A row as one letter: x must go; s, u, a or o (other) by its role, upper case if its text is truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    letter = initial if initial in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


@functools.lru_cache(1 << 15)
def search(codes: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> Found | None:
    """The least (cost, audit) that leads the rows from state start to one of ends; None if nothing does."""
    n, least = len(codes), [0]
    for c in reversed(codes):
        least.append(least[-1] + LEAST[c])
    least.reverse()
    best: Found | None = (least[0], "") if not n and start in ends else None
    stack, dominant = [(0, start, 0, "")], {}
    while stack:
        at, state, cost, audit = stack.pop()
        if best is not None and (bound := cost + least[at]) >= best[0] and (bound > best[0] or audit > best[1][: len(audit)]):
            continue
        if (known := dominant.get((at, state))) is not None and known <= (cost, audit):
            continue
        dominant[at, state] = (cost, audit)
        if at == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        stack.append((at, NEXT[state], cost + 5, audit + "I"))
        if at == n:
            continue
        c = codes[at]
        truncated = 5 if c.isupper() else 0
        edits = [(2, "D", state)]
        if c != "x":
            edits.append((1 + truncated, "R", NEXT[state]))
            if (to := FOLLOWS.get((state, c.lower()))) is not None:
                edits.append((truncated, "K", to))
        stack += [(at + 1, to, cost + more, audit + e) for more, e, to in sorted(edits, reverse=True)]  # the cheapest is tried first
    return best


Options = dict[tuple[int, int], Found]


def options(codes: str) -> Options:
    """The least (cost, audit) from each state to each."""
    return {(i, j): found for i in range(4) for j in range(4) if (found := search(codes, i, (j,))) is not None}


def together(left: Options, right: Options) -> Options:
    """Options of two runs, one after the other."""
    out: Options = {}
    for (i, j), (cost, audit) in left.items():
        for k in range(4):
            if (more := right.get((j, k))) is not None and ((i, k) not in out or (cost + more[0], audit + more[1]) < out[i, k]):
                out[i, k] = (cost + more[0], audit + more[1])
    return out


def joined(runs: list[Options]) -> Options:
    """Options of all runs in order, put together pairwise."""
    while len(runs) > 1:
        runs = [together(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0] if runs else {(k, k): (0, "") for k in range(4)}


def whole(found: Options) -> Found:
    return min(found[0, k] for k in ENDS if (0, k) in found)


class Edited:
    """Follows an audit over its rows and takes the digest of ``role:text`` lines as they are written."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.lines = audit, 0, 0, hashlib.sha256(), 0

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self._write(NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = FOLLOWS[self.state, role[:1]]
            self._write(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._write(NAMES[self.state], text)

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()


_SPACES = " \t\n\r\x0b\x0c"


class _Piece:
    """What one task has seen of a conversation."""

    def __init__(self):
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.bytes = 0
        self.low = self.high = self.first = self.last = self.first_turn = self.last_turn = None
        self.codes: list[str] = []
        self.runs: list[Options] = []
        self.held: list[tuple[str, str, int]] | None = []

    def row(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        stripped = text.rstrip(_SPACES)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if not self.rows:
            self.first, self.first_turn = role[:1], turn
        self.last_turn = turn
        for k in range(copies):
            fault = "blank" if not stripped else "duplicate" if again or k else "truncated" if stripped[-1] not in ".!?" else ""
            if fault:
                setattr(self, fault, getattr(self, fault) + 1)
            if self.rows:
                self.illegal += f"{self.last}{role[:1]}" not in ("su", "ua", "au")
            self.last = role[:1]
            self.rows += 1
            self.codes.append(code(role[:1], fault))
            if len(self.codes) == RUN * 8:
                self._close()
        if self.held is not None:
            self.bytes += len(text)
            self.held.append((role, text, copies))
            if len(self.held) > HELD_ROWS or self.bytes > HELD_BYTES:
                self.held = None

    def _close(self) -> None:
        for k in range(0, len(self.codes), RUN):
            self.runs.append(options("".join(self.codes[k : k + RUN])))
        self.codes = []

    def result(self, cut: bool) -> dict:
        """cut: another task may hold more of the conversation, so the options are needed besides what holds if it doesn't."""
        found: Options = {}
        if not cut and not self.runs and len(self.codes) <= RUN:
            cost, audit = search("".join(self.codes))
        else:
            self._close()
            found = joined(self.runs)
            cost, audit = whole(found)
        digest = None
        if self.held is not None:
            edited = Edited(audit)
            for role, text, copies in self.held:
                for _ in range(copies):
                    edited.row(role, text)
            digest = edited.end()
        return {
            "rows": self.rows, "turns": self.turns, "low": self.low, "high": self.high, "first": self.first, "last": self.last, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "digest": digest,
            "options": [{"enter": i, "leave": j, "cost": c, "audit": a} for (i, j), (c, a) in found.items()] if cut else None,
        }


_PIECE = [("seq", "int"), ("cut", "boolean"), ("rows", "bigint"), ("turns", "bigint"), ("low", "bigint"), ("high", "bigint"), ("first", "string"), ("last", "string"), ("first_turn", "bigint"), ("last_turn", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"), ("cost", "bigint"), ("audit", "string"), ("digest", "string"), ("options", "array<struct<enter:int,leave:int,cost:bigint,audit:string>>")]
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), _PIECE[-1][1]: pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))}
RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _stream(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a range; the first and the last conversation of a range may be cut."""
    from pyspark import TaskContext

    seq, kind = TaskContext.get().partitionId(), None

    def made(conv: object, piece: _Piece, cut: bool) -> pa.RecordBatch:
        row = {"seq": seq, "cut": cut} | piece.result(cut)
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), *(pa.array([row[k]], _ARROW[t]) for k, t in _PIECE)], ["conv", *(k for k, _ in _PIECE)])

    def pieces() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        now, piece, first = None, None, True
        for b in batches:
            kind = b.schema.field("conv").type
            for conv, turn, role, text, copies, again in _stream([b], ["conv", "turn", "role", "text", "copies", "again"]):
                if piece is None or conv != now:
                    if piece is not None:
                        yield made(now, piece, first)
                        first = False
                    now, piece = conv, _Piece()
                if copies:
                    piece.row(turn, role, text, copies, again)
        if piece is not None:
            yield made(now, piece, True)

    some: list[pa.RecordBatch] = []
    for b in pieces():
        some.append(b)
        if len(some) == 1000:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some = []
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _put_together(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a conversation from its pieces, at most one for each range."""
    pieces = [dict(zip(frame.columns, row, strict=True)) for row in frame.sort_values("seq").itertuples(index=False)]
    held = [p for p in pieces if p["rows"]]
    runs = [{(o["enter"], o["leave"]): (o["cost"], o["audit"]) for o in p["options"]} for p in held]
    cost, audit = whole(joined(runs))
    turns = [(p["low"], p["high"], p["turns"]) for p in held if p["turns"]]
    distinct = sum(t[2] for t in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))  # the same turn on both sides of a cut
    out = {k: sum(p[k] for p in held) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(f"{a['last']}{b['first']}" not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
    out |= {"gaps": turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0, "cost": cost, "audit": audit, "digest": held[0]["digest"] if len(held) == 1 else None if held else Edited("").end()}
    return pd.DataFrame([{"conv": frame["conv"].iloc[0]} | out])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, digest) from rows in order, each conversation led by a row with its audit."""
    now, edited, kind, done = None, None, None, []
    for b in batches:
        kind = b.schema.field("conv").type
        for conv, audit, role, text, copies in _stream([b], ["conv", "audit", "role", "text", "copies"]):
            if audit is not None:
                if edited is not None:
                    done.append((now, edited.end()))
                now, edited = conv, Edited(audit)
            else:
                for _ in range(copies):
                    edited.row(role, text)
    if edited is not None:
        done.append((now, edited.end()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], ["conv", "digest"])


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """One row for each conversation: (conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Rows go by turn, nulls first; within a turn by role, the first 100 characters of the text and its digest, so rows that are alike stand
    together and the order is always the same. Null roles and texts are one space. A row's first fault counts: blank (no character but white space), duplicate (role
    and text seen earlier in the conversation), truncated (the last character but white space isn't ``.``, ``!`` or ``?``). gaps: missing turns between
    the least and the largest; illegal: neighbours whose role initials aren't su, ua or au. An empty role has no
    initial and can't stay as it is.

    Costs: keep 0, another role 1, delete 2 (blank and duplicate rows must go), insert an empty user or assistant row 5; truncated rows
    that stay cost 5 more. audit: the edits' initials in order; of the cheapest, the least in ASCII. copies: how often a row counts (default 1); a
    conversation without rows left has zeros, an empty audit and the digest of nothing. An empty table gives no rows. Only the four columns are read.

    A conversation's audit is one string and its digest runs over its text in order: these two bound a conversation, at 2 GB of audit.
    """
    kind = rows.schema[conv_col].dataType.simpleString()
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    # ids and turns in structs, whose nulls are equal to each other and come first
    seen = rows.select(F.struct(F.col(conv_col).alias("v")).alias("c"), F.struct(F.col(turn_col).cast("bigint").alias("v")).alias("t"), one(role_col).alias("role"), one(text_col).alias("text"), (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"))
    key = ["c", "t", "role", "digest"]
    merged = seen.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).groupBy(*key).agg(F.sum("copies").alias("copies"), F.any_value("text").alias("text"))
    columns = f"conv {kind}, " + ", ".join(f"`{k}` {t}" for k, t in _PIECE)
    with scratch(rows.sparkSession) as keep:
        first = merged.filter("copies > 0").groupBy("c", "role", "digest").agg(F.min("t").alias("t")).withColumn("_first", F.lit(True))
        flagged = merged.join(first, key, "left").withColumn("start", F.substring("text", 1, 100))
        order = ["c", "t", "role", "start", "digest"]
        ordered = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
        asked = ordered.select(F.col("c.v").alias("conv"), F.col("t.v").alias("turn"), "role", "text", "copies", F.col("_first").isNull().alias("again"))
        pieces = keep(asked.mapInArrow(_solve, columns))
        gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
        inner = pieces.filter("not cut").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest")
        edge = pieces.filter("cut").groupBy("conv").applyInPandas(_put_together, f"conv {kind}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, gaps bigint, cost bigint, audit string, digest string")
        known = keep(inner.unionByName(edge))
        # conversations over several ranges, or too long to be held: their rows pass once more, led by the audit
        lead = known.filter("digest is null").select(F.struct(F.col("conv").alias("v")).alias("c"), "audit")
        none = {"t": "struct<v:bigint>", "role": "string", "start": "string", "digest": "string", "text": "string", "copies": "bigint"}
        heads = lead.select("c", "audit", *[F.lit(None).cast(t).alias(n) for n, t in none.items()], F.lit(0).alias("kind"))
        body = flagged.join(lead.select("c"), "c", "left_semi").select("c", F.lit(None).cast("string").alias("audit"), *none, F.lit(1).alias("kind"))
        followed = heads.unionByName(body).repartition("c").sortWithinPartitions("c", "kind", *order[1:])
        late = followed.select(F.col("c.v").alias("conv"), "audit", "role", "text", "copies").mapInArrow(_digests, f"conv {kind}, digest string")
        late = late.select(F.struct(F.col("conv").alias("v")).alias("c"), F.col("digest").alias("late"))
        done = known.withColumn("c", F.struct(F.col("conv").alias("v"))).join(late, "c", "left")
        return checkpoint(done.select(F.col("conv").alias(conv_col), *RESULT[:-1], F.coalesce("digest", "late").alias(RESULT[-1])))
