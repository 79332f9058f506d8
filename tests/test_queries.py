"""Every registered query of the engine against its SQL."""

import pytest
from conftest import DATA, against_oracle

from tidemark.plans.derived import Ledger
from tidemark.queries import DAILY, LIMITS, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    if name in ORACLES:
        against_oracle(df, ORACLES[name])
    else:
        assert df.count() > 0


def all_behind(spark, cursors: dict[str, str]) -> dict[str, int]:
    """Messages after given cursors of entries, counted one by one."""
    x = Ledger(spark, f"{DATA}/sf0.001")
    channels, messages = {r.entry_key: r.channel_id for r in x.entries.collect()}, [(r.channel_id, r.id_num) for r in x.messages.select("channel_id", "id_num").collect()]
    return {k: sum(c == channels[k] and n > int(cursor) for c, n in messages) for k, cursor in cursors.items()}


def test_catchup_plan_counts_all_behind(spark):
    rows = QUERIES["catchup_plan"](spark, f"{DATA}/sf0.001").collect()
    assert {r.entry_key: r.behind for r in rows} == all_behind(spark, {r.entry_key: r.cursor for r in rows})
    assert max(r.behind for r in rows) > LIMITS.pages * LIMITS.page + 1


def test_catchup_repeats_counts_all_behind_once(spark):
    got = {(r.entry_key, r.behind) for r in QUERIES["catchup_repeats"](spark, f"{DATA}/sf0.001").collect()}
    plan = QUERIES["catchup_plan"](spark, f"{DATA}/sf0.001").where("added > 0").collect()
    assert got == set(all_behind(spark, {r.entry_key: r.cursor for r in plan}).items())
    assert max(n for _, n in got) > LIMITS.pages * LIMITS.page + 1


def test_daily_sync_plan_counts_all_behind(spark):
    rows = QUERIES["daily_sync_plan"](spark, f"{DATA}/sf0.001").collect()
    assert {r.entry_key: r.behind for r in rows} == all_behind(spark, {r.entry_key: r.cursor for r in rows})
    assert max(r.behind for r in rows) > DAILY.pages * DAILY.page + 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
