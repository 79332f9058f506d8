"""Conversation repair, against all edits of short conversations and against a table of best ways."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from conftest import DATA, against_oracle

from tidemark.llm import queries, repair

TABLE = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """rows: symbols of the search; the least (cost, initials, edits) of all edits, with two insertions in a row at most."""
    gaps = ["", *("".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n))]
    best = None
    for ops in itertools.product("KDUA", repeat=len(rows)):
        if any(op != "D" and row == "x" for op, row in zip(ops, rows, strict=True)):
            continue
        for before in itertools.product(gaps, repeat=len(rows) + 1):
            edits = "".join(g + op for g, op in zip(before, ops, strict=False)) + before[-1]
            roles, cost, k = "", 0, 0
            for e in edits:
                if e in "ua":
                    roles, cost = roles + e, cost + 2
                    continue
                row, k = rows[k], k + 1
                cost += 3 if e == "D" else (e != "K") * 2 + row.isupper()
                roles += "" if e == "D" else row.lower() if e == "K" else e.lower()
            if LEGAL.fullmatch(roles):
                initials = re.sub("[UA]", "R", re.sub("[ua]", "I", edits))
                best = min(best or (999, "", ""), (cost, initials, edits))
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_search_is_the_best_of_all_edits(n):
    for rows in itertools.product("suaoSUAOx", repeat=n):
        assert repair.repair(["".join(rows)]) == every_repair("".join(rows))


def best_by_table(rows):
    """Cost and initials by a plain table of the best way to each state."""
    ways = {0: (0, "")}

    def closed(ways):
        for _ in range(3):
            for state, (c, w) in list(ways.items()):
                for role, to in repair.STEPS[state].items():
                    if role != "s":
                        ways[to] = min(ways.get(to, (10**9, "")), (c + 2, w + "I"))
        return ways

    for row in rows:
        new = {}
        for state, (c, w) in closed(ways).items():
            new[state] = min(new.get(state, (10**9, "")), (c + 3, w + "D"))
            for role, to in repair.STEPS[state].items() if row != "x" else ():
                more = row.isupper()
                if role == row.lower():
                    new[to] = min(new.get(to, (10**9, "")), (c + more, w + "K"))
                if role != "s":
                    new[to] = min(new.get(to, (10**9, "")), (c + 2 + more, w + "R"))
        ways = new
    return min(v for k, v in closed(ways).items() if k in (0, 3))


def test_long_conversations_in_stretches():
    rng = random.Random(3)
    for _ in range(300):
        rows = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(1, 60)))
        cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(6)))) if len(rows) > 1 else []
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        cost, initials, edits = repair.repair(parts)
        assert (cost, initials) == best_by_table(rows)
        assert re.sub("[UA]", "R", re.sub("[ua]", "I", edits)) == initials


def query_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, TABLE).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(queries.op12_conversation_repair(spark, str(tmp_path)).collect(), key=str)


def undamaged(conv_id, turns):
    """The first of these turns whose rows come through without damage."""
    return [t for t in turns if zlib.crc32(f"{conv_id}:{t}".encode()) % 20 > 4]


def test_repair_of_odd_rows(spark, tmp_path):
    a, b, c, d = undamaged(1, range(50))[:4]
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    null = next(t for t in range(50) if zlib.crc32(f" :{t}".encode()) % 20 > 4)
    rows = [
        (1, a, "user", "Hi."), (1, b, "user", "Hi."), (1, c, "assistant", "No end\n"), (1, d, "assistant", " \t\n"),
        (dropped, 0, "user", "Gone."), (None, null, None, None),
    ]
    got = {r.conv_id: r for r in query_of(spark, tmp_path, rows)}
    assert len(got) == 3
    r = got[1]
    assert (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps) == (1, 1, 1, 2, d - a + 1 - 4)
    assert (r.cost, r.audit) == (7, "KDKD")
    assert r.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:No end\n").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert tuple(got[None])[1:] == (0, 1, 0, 0, 0, 3, "D", empty)


def test_repair_of_no_rows(spark, tmp_path):
    assert query_of(spark, tmp_path, []) == []


def test_repair_with_ties_nulls_and_a_long_conversation(spark, tmp_path):
    rng = random.Random(5)
    rows = [(7, rng.choice([None, rng.randrange(400)]), rng.choice(["user", "assistant", "assistant", "system", "tool", None]), rng.choice(["A.", "B", "C!", "", None, "D. "]) if rng.random() < 0.5 else f"t{k}.") for k in range(900)]
    rows += [(k % 40, rng.randrange(4), rng.choice(["user", "assistant"]), rng.choice(["x.", "y", "z? "])) for k in range(300)]
    spark.createDataFrame(rows, TABLE).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    df = queries.op12_conversation_repair(spark, str(tmp_path))
    want = con.execute(queries.OP12_SQL)
    names = [x[0] for x in want.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(str(tuple(x)) for x in want.fetchall())


def test_repaired_turns_are_well_formed(spark):
    rows = queries.damaged(spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet"))
    plan = repair.plan_repairs(rows, gone_col="gone")
    turns = repair.repaired_turns(rows, plan, gone_col="gone").collect()
    by = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.place)):
        by.setdefault(r.conv_id, []).append(r.role[0])
    assert by and all(LEGAL.fullmatch("".join(x)) for x in by.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repair_of_the_tables(spark, sf):
    against_oracle(queries.op12_conversation_repair(spark, f"{DATA}/{sf}"), queries.OP12_SQL, sf)
