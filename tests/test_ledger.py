"""Queue and ledger rules on small fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.cursors import id_number, newest_cursor
from tidemark.operators import audit, catchup, ledger, select
from tidemark.plans.schemas import ENTRIES, MESSAGES, QUEUE

TODAY, NOW = "2026-06-09", "2026-06-09T01:00:00Z"


def rows(spark, schema: str, items: list[dict]):
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    return spark.createDataFrame([tuple(x.get(f) for f in kind.names) for x in items], kind)


def entry(key, cursor="100", **more):
    return {"entry_key": key, "type": "channel", "channel_id": "1", "relative_path": "topic", "last_written_message_id": cursor, "last_message_id": cursor, "sync_status": "healthy", "has_sync_status": True, "last_backup": "2026-05-17"} | more


def item(ordinal, key, **more):
    return {"ordinal": ordinal, "entry_key": key, "status": "queued", "has_status": True} | more


def entries_of(spark, *x):
    return rows(spark, ENTRIES, list(x))


def queue_of(spark, *x):
    return rows(spark, QUEUE, list(x))


def chosen(spark, entries, queue, limit):
    return [r.asDict() for r in select.select_worker(entries, queue, TODAY, limit).orderBy("rank").collect()]


@pytest.mark.parametrize("a,b,want", [("99", "100", "100"), ("100", "99", "100"), ("", "5", "5"), (None, None, None), ("", "", None), ("0", None, "0"), ("x", "0", "x"), ("7", "007", "7"), ("1_0", "2", "2"), ("1.5", "1", "1")])
def test_newest_cursor(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(newest_cursor("a", "b")).first()[0] == want


def test_id_number(spark):
    got = spark.createDataFrame([(x,) for x in ("12", " 12 ", "-3", "1.5", "1_0", "", None, "9" * 30)], "a string").select(id_number("a")).collect()
    assert [r[0] for r in got] == [12, 12, -3, 0, 0, 0, 0, 0]


def test_stale_probe(spark):
    e, q = entries_of(spark, entry("a")), queue_of(spark)
    assert [(c["entry_key"], c["reason"], c["cursor"], c["priority"]) for c in chosen(spark, e, q, 1)] == [("a", "healthy_stale_probe", "100", 60)]
    after = select.queue_after_selection(e, q, TODAY, NOW, 1).collect()
    assert [(r.entry_key, r.status, r.cursor_message_id) for r in after] == [("a", "queued", "100")]


def test_partial_reactivates_and_never_lags(spark):
    e = entries_of(spark, entry("a", "200", sync_status="partial", backlog_reason="page_limit_reached"))
    q = queue_of(spark, item(0, "a", status="caught_up", cursor_message_id="150", priority=80, attempts=7))
    got = select.queue_after_selection(e, q, TODAY, NOW, 1).first()
    assert (got.status, got.reason, got.priority, got.cursor_message_id, got.attempts) == ("queued", "page_limit_reached", 40, "200", 0)


def test_active_cursor_rises(spark):
    got = chosen(spark, entries_of(spark, entry("a", "300")), queue_of(spark, item(0, "a", cursor_message_id="250", priority=9)), 1)
    assert got[0]["cursor"] == "300" and got[0]["tier"] == 1


def test_only_selected_stale_are_enqueued(spark):
    e = entries_of(spark, *(entry(f"e{k}") for k in range(5)))
    assert select.queue_after_selection(e, queue_of(spark), TODAY, NOW, 2).count() == 2


def test_bootstrap_once_a_day(spark):
    make = lambda day: entries_of(spark, entry("a", None, type="thread", last_backup=day))
    assert [(c["reason"], c["priority"], c["cursor"]) for c in chosen(spark, make("2026-06-08"), queue_of(spark), 1)] == [("bootstrap_needed", 90, "0")]
    assert chosen(spark, make(TODAY), queue_of(spark), 1) == []
    assert [r.cursor_message_id for r in select.queue_after_selection(make(None), queue_of(spark), TODAY, NOW, 1).collect()] == ["0"]


def test_null_and_missing_status_differ(spark):
    missing, null = entry("a", sync_status=None, has_sync_status=False), entry("b", sync_status=None)
    assert [c["entry_key"] for c in chosen(spark, entries_of(spark, missing, null), queue_of(spark), 9)] == ["a"]
    assert [r.entry_key for r in audit.unreachable_entries(entries_of(spark, missing, null), queue_of(spark)).collect()] == ["b"]


def test_full_tier_one_changes_nothing(spark):
    e = entries_of(spark, entry("a"), entry("b", sync_status="partial"))
    q = queue_of(spark, item(0, "a", priority=5))
    assert select.queue_after_selection(e, q, TODAY, NOW, 1).count() == 1
    assert select.queue_after_selection(e, q, TODAY, NOW, 2).count() == 2


def test_preview_prefers_the_queue_and_ages(spark):
    e = entries_of(spark, entry("a", relative_path="z"), entry("b", relative_path="y"), entry("c", None, relative_path="x"), entry("d", relative_path="w", last_backup="2026-06-08"))
    q = queue_of(spark, item(0, "b", priority=5))
    assert select.select_preview(e, q, TODAY, 1).first().entry_key == "b"
    assert [r.entry_key for r in select.select_preview(e, q, TODAY, 9).orderBy("rank").collect()] == ["b", "a", "c"]


def test_preview_leaves_error_alone(spark):
    e = entries_of(spark, entry("a", sync_status="error", last_backup=TODAY))
    assert select.select_preview(e, queue_of(spark), TODAY, 9).count() == 0
    assert chosen(spark, e, queue_of(spark), 9)[0]["tier"] == 2


def test_orphans_retire(spark):
    got = {r.entry_key: r for r in ledger.normalize_queue(queue_of(spark, item(0, "gone"), item(1, "a"), item(2, None)), entries_of(spark, entry("a")), NOW).collect()}
    assert got["gone"].status == "retired" and got["a"].status == "queued" and got[None].status == "queued"


def test_old_caught_up_suppresses_active(spark):
    """Kept behaviour: if the ledger is ahead of both, their cursors tie and the caught-up item wins."""
    q = queue_of(spark, item(0, "a", status="caught_up", cursor_message_id="300"), item(1, "a", status="catching_up", cursor_message_id="250"))
    got = ledger.normalize_queue(q, entries_of(spark, entry("a", "300")), NOW).collect()
    assert [(r.status, r.cursor_message_id) for r in got] == [("caught_up", "300")]


def fold(items: list[dict], cursor: str) -> dict:
    """A plain model of the fold of one entry's items."""
    number = lambda x: int(x) if x else 0
    out = None
    for x in items:
        x = dict(x, cursor_message_id=max([c for c in (x["cursor_message_id"], cursor) if c], key=number))
        if out is None:
            out = x
            continue
        a, b = number(x["cursor_message_id"]), number(out["cursor_message_id"])
        done, was = x["status"] == "caught_up", out["status"] == "caught_up"
        wins = a > b if a != b else (done if done != was else (x["priority"] or 50) < (out["priority"] or 50))
        mine, other = (x, out) if wins else (out, x)
        mine = dict(mine, attempts=max(x["attempts"] or 0, out["attempts"] or 0))
        mine["target_hint_message_id"] = mine["target_hint_message_id"] or other["target_hint_message_id"]
        if not mine["created_at"] or (other["created_at"] and other["created_at"] < mine["created_at"]):
            mine["created_at"] = other["created_at"]
        out = mine
    return out


def test_fold_like_the_model(spark):
    rng = random.Random(4)
    entries, items = [], []
    for k in range(120):
        entries.append(entry(f"k{k}", "300"))
        for _ in range(rng.randint(1, 5)):
            items.append(item(len(items), f"k{k}", cursor_message_id=rng.choice(["250", "300", "310", "99", None]), priority=rng.choice([None, 0, 5, 60]), status=rng.choice(["caught_up", "queued", "retry"]), attempts=rng.choice([None, 2, 9]), target_hint_message_id=rng.choice([None, "", "A", "B"]), created_at=rng.choice([None, "", "2026-01-01", "2026-02-01"])))
    got = {r.entry_key: r for r in ledger.normalize_queue(queue_of(spark, *items), entries_of(spark, *entries), NOW).collect()}
    for e in entries:
        want = fold([x for x in items if x["entry_key"] == e["entry_key"]], "300")
        r = got[e["entry_key"]]
        assert (r.status, r.cursor_message_id, r.priority, r.target_hint_message_id, r.created_at, r.attempts) == (want["status"], want["cursor_message_id"], want["priority"], want["target_hint_message_id"], want["created_at"], want["attempts"] or 0)


def test_merge_is_monotonic(spark):
    disk = entries_of(spark, entry("a", "300"), entry("only"))
    for memory, want in (("250", "300"), ("400", "400")):
        got = {r.entry_key: r for r in ledger.merge_state(entries_of(spark, entry("a", memory)), disk).collect()}
        assert got["a"].last_written_message_id == want and "only" in got


def test_upsert_keeps_priority(spark):
    changes = spark.createDataFrame([("a", "queued", None, 40), ("new", "queued", None, None)], "entry_key string, status string, reason string, priority int")
    got = {r.entry_key: r for r in ledger.upsert_queue(queue_of(spark, item(0, "a", priority=10)), entries_of(spark, entry("a"), entry("new")), changes, NOW).collect()}
    assert got["a"].priority == 10 and got["a"].reason == "state_partial"
    assert (got["new"].priority, got["new"].attempts, got["new"].created_at) == (50, 0, NOW)


def test_warnings_are_about_active_items(spark):
    q = queue_of(spark, item(0, "a", status="retry", attempts=9), item(1, "b", status="caught_up", attempts=9))
    assert [(r.entry_key, r.n) for r in audit.audit_warnings(entries_of(spark, entry("a")), q).collect()] == [("a", 9)]


def loop(counts: list[int], size: int, pages: int, reads: int) -> list[tuple]:
    """The loop of reads that the plan's closed form stands for."""
    total, out = 0, []
    for left in counts:
        if total >= reads:
            break
        batches = added = 0
        status, begin = "still_queued", total
        while batches < pages and total < reads:
            n = min(size, left)
            total, batches = total + 1, batches + 1
            if not n:
                status = "caught_up"
                break
            left, added = left - n, added + n
            if n < size and total < reads:
                total += 1
                status = "caught_up"
                break
        out.append((batches, total - begin, added, status))
    return out


@pytest.mark.parametrize("size,pages,reads", [(1, 1, 3), (3, 2, 7), (4, 5, 20), (10, 2, 9)])
def test_plan_like_the_loop(spark, size, pages, reads):
    rng = random.Random(size)
    counts = [rng.choice([0, size - 1, size, size + 1, size * pages, size * pages + 1, 2]) for _ in range(14)]
    entries = entries_of(spark, *(entry(f"e{k:02}", None, channel_id=str(k)) for k in range(len(counts))))
    messages = spark.createDataFrame([(str(k), str(n + 1), n + 1, None, None, None, None) for k, c in enumerate(counts) for n in range(c)], MESSAGES)
    candidates = entries.select((F.substring("entry_key", 2, 9).cast("int") + 1).alias("rank"), "entry_key", F.lit(None).cast("string").alias("cursor"))
    limits = catchup.Limits(len(counts), reads, pages, size)
    plan = catchup.plan_candidates(candidates, entries, messages, limits)
    got = plan.orderBy("rank").collect()
    assert [(r.batches, r.reads, r.added, r.status) for r in got] == loop(counts, size, pages, reads)
    assert [r.new_cursor for r in got] == [str(r.added) for r in got]
    assert catchup.catchup_messages(plan, entries, messages, limits).count() == sum(r.added for r in got)


def test_read_errors(spark):
    entries = entries_of(spark, entry("a", "0", channel_id="1"), entry("b", "0", channel_id="2"))
    messages = spark.createDataFrame([(c, str(n), n, None, None, None, None) for c in "12" for n in range(1, 8)], MESSAGES)
    candidates = spark.createDataFrame([(1, "a", "0"), (2, "b", "0")], "rank int, entry_key string, cursor string")
    errors = spark.createDataFrame([("a", 1)], "entry_key string, ok_reads int")
    plan = catchup.plan_candidates(candidates, entries, messages, catchup.Limits(4, 12, 5, 3), errors)
    got = {r.entry_key: r for r in plan.collect()}
    assert (got["a"].status, got["a"].added, got["a"].new_cursor) == ("error", 3, "3")
    assert got["b"].status == "caught_up"
    after = {r.entry_key: r for r in catchup.entries_after(entries, plan, TODAY).collect()}
    assert (after["a"].sync_status, after["a"].consecutive_errors, after["b"].sync_status, after["b"].last_backup) == ("error", 1, "healthy", TODAY)
    assert catchup.queue_after(queue_of(spark, item(0, "a")), plan, NOW).first().status == "retry"


def test_plan_counts_all_behind(spark):
    entries = entries_of(spark, entry("a", "2"), entry("b", "15"), entry("c", "30"), entry("d", None, channel_id=None))
    messages = spark.createDataFrame([("1", str(n), n, None, None, None, None) for n in [*range(1, 31), *range(10, 25), 4]], MESSAGES)
    candidates = spark.createDataFrame([(1, "a", "2"), (2, "b", "15"), (3, "c", "30"), (4, "d", None)], "rank int, entry_key string, cursor string")
    plan = catchup.plan_candidates(candidates, entries, messages, catchup.Limits(4, 12, 2, 3))
    assert [(r.entry_key, r.behind, r.added, r.new_cursor) for r in plan.orderBy("rank").collect()] == [("a", 28, 6, "8"), ("b", 15, 6, "21"), ("c", 0, 0, "30"), ("d", 0, 0, "0")]
    assert "count" not in plan.select("entry_key", "added", "new_cursor")._jdf.queryExecution().optimizedPlan().toString()


def test_daily_counts_all_behind(spark):
    entries = entries_of(spark, entry("a", "2"), entry("b", "28", last_backup="2026-05-18"), entry("c", "30", last_backup="2026-05-19"), entry("d", "5", channel_id=None, last_backup="2026-05-20"))
    messages = spark.createDataFrame([("1", str(n), n, None, None, None, None) for n in [*range(1, 31), *range(10, 25)]], MESSAGES)
    plan = catchup.daily_sync_plan(entries, queue_of(spark), messages, catchup.DailyLimits(page=3))
    assert [(r.entry_key, r.behind, r.added, r.status) for r in plan.orderBy("rank").collect()] == [("a", 28, 6, "partial"), ("b", 2, 2, "healthy"), ("c", 0, 0, "healthy"), ("d", 0, 0, "healthy")]


def test_empty_tables(spark):
    e, q, m = entries_of(spark), queue_of(spark), spark.createDataFrame([], MESSAGES)
    assert chosen(spark, e, q, 4) == []
    assert catchup.catchup_plan(e, q, m, TODAY).count() == 0
    assert catchup.run_totals(catchup.catchup_plan(e, q, m, TODAY)).first().processed == 0
    assert audit.audit_clean(e, q, m).first().clean
    assert catchup.daily_sync_plan(e, q, m).count() == 0
