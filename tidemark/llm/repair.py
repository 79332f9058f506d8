"""Conversation structure repair: the cheapest edits that give a well-formed sequence of roles, found by A* on the edit lattice.

A conversation is well-formed if its roles' initials are (s?(ua)+)?.  A row may be
kept (0), given the role user or assistant (2) or deleted (3, which blank and
repeated rows must be); a user or assistant row with an empty text may be
inserted anywhere (2); a truncated row that isn't deleted costs 1 more.  Among
the cheapest edits, those whose initials K, R, D, I are least by ASCII count.

The search sees one character for each row.  Its heuristic is the sum, over the
rows that are left, of deletions that must be and truncation charges that can't
be avoided; states are taken by (cost plus heuristic, initials so far), so that
the first end that comes up is the cheapest and least.  That holds since two ways
to the same place and state at the same cost never have initials of which one
begins with the other: the rest would be insertions, which cost.  Long
conversations are searched in stretches, from each state that a stretch can
begin in, and the stretches' ends compared in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

#: Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a stretch that is searched at once; results of so many short ones are kept.
STRETCH, SHORT, KEPT = 256, 64, 4096
#: States: nothing yet, after a system row, after a user row, after an assistant row; a conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: From each state, the state that a row with an initial leads to.
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: A row is the initial of its role (o: another one), in upper case if it's truncated; MUST_GO is one that must be deleted.
MUST_GO = "x"
#: What is put out for each edit: a kept row, a deleted one, its new role; inserted rows in lower case.
KEEP, GONE = "K", "D"
ROLES = {"u": "user", "a": "assistant"}
NOT_BLANK, WHOLE = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def search(rows: str, entry: int, last: bool) -> tuple[tuple[int, int, str, str], ...]:
    """(state, cost, initials, edits) of the best way through a stretch to each state it can end in; of the last stretch, to the best end.

    Rows are inserted before a row, or at the end of the last stretch, so that the initials of all ways through a stretch end with a row's.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i] == MUST_GO else TRUNCATED if rows[i].isupper() else 0)
    heap, done, found = [(rest[0], "", 0, entry, 0, "")], set(), []
    while heap:
        _, initials, i, state, cost, edits = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if not last:
                found.append((state, cost, initials, edits))
                continue
            if state in ENDS:
                return ((state, cost, initials, edits),)

        def reach(i: int, state: int, price: int, initial: str, edit: str, initials=initials, cost=cost, edits=edits) -> None:
            if (i, state) not in done:
                heappush(heap, (cost + price + rest[i], initials + initial, i, state, cost + price, edits + edit))

        for role, to in STEPS[state].items():
            if role in ROLES:
                reach(i, to, INSERT, "I", role)
        if i < n:
            row = rows[i]
            reach(i + 1, state, DELETE, "D", GONE)
            if row != MUST_GO:
                more = TRUNCATED if row.isupper() else 0
                if row.lower() in STEPS[state]:
                    reach(i + 1, STEPS[state][row.lower()], more, "K", KEEP)
                for role, to in STEPS[state].items():
                    if role in ROLES:
                        reach(i + 1, to, REROLE + more, "R", role.upper())
    return tuple(found)


_known = lru_cache(KEPT)(search)


def through(rows: str, entry: int, last: bool) -> tuple[tuple[int, int, str, str], ...]:
    return (_known if len(rows) <= SHORT else search)(rows, entry, last)


@dataclass(frozen=True, eq=False)
class Way:
    """The best way so far to a state: its cost, the stretch it ended with and the way before that."""

    cost: int
    initials: str = ""
    edits: str = ""
    before: Way | None = None

    def better(self, other: Way | None) -> bool:
        if other is None or self.cost != other.cost:
            return other is None or self.cost < other.cost
        a, b, less = self, other, False
        while a is not b:  # as many stretches; the first that differs counts
            if a.initials != b.initials:
                less = a.initials < b.initials
            a, b = a.before, b.before
        return less

    def whole(self) -> tuple[str, str]:
        way, parts = self, []
        while way is not None:
            parts.append((way.initials, way.edits))
            way = way.before
        return "".join(p[0] for p in reversed(parts)), "".join(p[1] for p in reversed(parts))


def repair(stretches: list[str]) -> tuple[int, str, str]:
    """Cost, initials and edits of a conversation; edits: for each row in turn the inserted rows before it and its own."""
    ways = {START: Way(0)}
    for k, rows in enumerate(stretches):
        new: dict[int, Way] = {}
        for entry, way in ways.items():
            for state, cost, initials, edits in through(rows, entry, k == len(stretches) - 1):
                to = Way(way.cost + cost, initials, edits, way)
                if to.better(new.get(state)):
                    new[state] = to
        ways = new
    best = None
    for way in ways.values():
        best = way if way.better(best) else best
    return best.cost, *best.whole()


# ---- rows ----

_STATS = ("blank", "duplicate", "truncated", "illegal")


def _marked(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: Column) -> DataFrame:
    """What the search and the order of rows need: id, turn, role, a digest of the text and what is wrong with the text."""
    text = F.coalesce(text_col, F.lit(" "))
    return df.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        (~text.rlike(NOT_BLANK)).alias("blank"), (~text.rlike(WHOLE)).alias("cut_off"), gone.alias("gone"),
    )


def _row_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def plan_repairs(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, edits: one row for each conversation.

    Rows are taken by turn (null first), then role, then a digest of the text, so
    that repeated rows lie beside each other.  A null role or text is one space;
    a null id is an id like others.  gone_col: rows where it is true only say
    that the conversation is there; one without other rows has no edits.  Of a
    row's faults the first counts: blank, duplicate (role and text seen earlier),
    truncated (its last character that isn't blank is none of .!?).  gaps: turns
    missing between the least and largest.  illegal: neighbours whose initials
    aren't su, ua or au.  audit: initials of the edits; edits: see repair().

    Texts aren't shuffled.  A conversation's rows, some 60 bytes each, meet in
    one task, which sorts them and spills; the search gets a byte for each.
    """
    gone = F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)
    rows = _marked(df, id_col, turn_col, role_col, text_col, gone)
    order = Window.partitionBy("conv_id").orderBy("gone", *_row_order())
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"place": F.row_number().over(order), "before": F.lag(initial).over(order), "turn_before": F.lag("turn").over(order)})
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("place")) > 1
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut_off"), "truncated")
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    rows = rows.withColumn("seen", seen).withColumn("fault", fault).withColumn("symbol", symbol)
    rows = rows.withColumn("illegal", (F.col("place") > 1) & ~F.concat("before", initial).isin("su", "ua", "au"))
    there = ~F.col("gone")
    stretches = rows.groupBy("conv_id", F.when(there, F.floor((F.col("place") - 1) / STRETCH)).otherwise(-1).alias("stretch")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(there, F.struct("place", "symbol")))), lambda x: x["symbol"]), "").alias("symbols"),
        *(F.count_if(there & (F.col("fault") == k)).alias(k) for k in _STATS[:3]), F.count_if(there & F.col("illegal")).alias("illegal"),
        F.min(F.when(there, F.col("turn"))).alias("first"), F.max(F.when(there, F.col("turn"))).alias("last"), F.count_if(there & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("turns"),
    )
    kind = dict(stretches.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits string"
    return map_arrow(stretches.repartition("conv_id").sortWithinPartitions("conv_id", "stretch"), _planned, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, object, Iterator[dict]]]:
    """The type of conv_id, its value and its rows as dicts, anew wherever it changes; each run's rows must be read up before the next."""
    rows = ((batch.schema.field("conv_id").type, row) for batch in batches for row in batch.to_pylist())
    for _, run in groupby(rows, key=lambda x: x[1]["conv_id"]):
        kind, first = next(run)
        yield kind, first["conv_id"], chain([first], (row for _, row in run))


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", *_STATS, "cost", "audit", "edits"]
    kind, out = None, []
    for kind, conv_id, rows in _runs(batches):
        parts, stats, first, last, turns = [], dict.fromkeys(_STATS, 0), None, None, 0
        for row in rows:
            parts += [row["symbols"]] if row["symbols"] else []
            stats = {k: v + row[k] for k, v in stats.items()}
            turns += row["turns"]
            if row["first"] is not None:
                first, last = min(row["first"], row["first"] if first is None else first), max(row["last"], row["last"] if last is None else last)
        cost, audit, edits = repair(parts) if parts else (0, "", "")
        out.append((conv_id, 0 if first is None else last - first + 1 - turns, *stats.values(), cost, audit, edits))
        if len(out) == 1024 or len(audit) > 1 << 16:
            yield _batch(out, names, kind)
            out = []
    if out:
        yield _batch(out, names, kind)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *([pa.int64()] * (len(names) - 3)), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repaired_turns(df: DataFrame, plan: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """conv_id, place (from 0), role, text: the rows of df after the edits of plan_repairs(df).

    Texts are shuffled once, by conversation, and sorted behind their
    conversation's edits; rows then stream through, so of a conversation only the
    edits (a byte or two for each row) are held.  Rows come out in order, the
    conversations one after the other in each partition.
    """
    gone = F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)
    rows = df.where(~gone).select(
        F.col(id_col).alias("conv_id"), F.lit(1).alias("kind"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.unhex(F.sha2(F.coalesce(text_col, F.lit(" ")).cast("binary"), 256)).alias("digest"), F.coalesce(text_col, F.lit(" ")).alias("text"),
    )
    heads = plan.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("edits").alias("text"))
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_row_order()).select("conv_id", "role", "text")
    return map_arrow(both, _repaired, f"conv_id {dict(both.dtypes)['conv_id']}, place long, role string, text string")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kind, conv_id, rows in _runs(batches):
        edits, at, place, out = next(rows)["text"], 0, 0, []

        def inserted(at: int, edits: str = edits) -> tuple[int, list[tuple[str, str]]]:
            end = at
            while end < len(edits) and edits[end] in ROLES:
                end += 1
            return end, [(ROLES[x], "") for x in edits[at:end]]

        for row in rows:
            at, new = inserted(at)
            edit, at = edits[at], at + 1
            out += new
            if edit != GONE:
                out.append((row["role"] if edit == KEEP else ROLES[edit.lower()], row["text"]))
            if len(out) >= 256:
                yield _turns(kind, conv_id, place, out)
                place, out = place + len(out), []
        out += inserted(at)[1]
        if out:
            yield _turns(kind, conv_id, place, out)


def _turns(kind: pa.DataType, conv_id: object, place: int, rows: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = [pa.array([conv_id] * len(rows), kind), pa.array(range(place, place + len(rows)), pa.int64()), pa.array([r for r, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "role", "text"])


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of role:text, joined by newlines, from what repaired_turns gives, in the order in which it gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, conv_id, rows in _runs(batches):
            said = hashlib.sha256()
            for row in rows:
                said.update(f"{chr(10) if row['place'] else ''}{row['role']}:{row['text']}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], kind), pa.array([said.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return map_arrow(turns, run, f"conv_id {dict(turns.dtypes)['conv_id']}, repaired_sha256 string")
