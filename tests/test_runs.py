"""Whole runs over a root folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_ledger import TODAY, entries_of, entry, item, queue_of

from tidemark import run
from tidemark.operators.catchup import Limits
from tidemark.operators.migrate import migrate_header
from tidemark.plans.schemas import ENTRIES, HEADER, MESSAGES
from tidemark.sources.archive import read_raw
from tidemark.sources.snapshots import Locked, MissingSnapshot, lock


def messages_of(spark, n):
    return spark.createDataFrame([("1", str(k), k, None, "x", None, None) for k in range(1, n + 1)], MESSAGES).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))


def test_runs_until_caught_up(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    messages = messages_of(spark, 25)
    with pytest.raises(MissingSnapshot):
        run.catch_up(spark, root, messages, TODAY, "2026-06-09T01:00:00Z")
    state, work = run.tables(spark, root)
    state.save(entries_of(spark, entry("a", "3"), entry("b", "9", channel_id="2", last_backup=TODAY)))
    dry = run.catch_up(spark, root, messages, TODAY, "2026-06-09T01:00:00Z", dry_run=True)
    assert [r.entry_key for r in dry["candidates"].collect()] == ["a"] and state.versions() == [1]
    seen = []
    for hour in range(3):
        got = run.catch_up(spark, root, messages, TODAY, f"2026-06-09T0{hour}:00:00Z", Limits(4, 12, 2, 5))
        seen.append([(r.status, r.added) for r in got["entries"].collect()])
    assert seen == [[("still_queued", 10)], [("still_queued", 10)], [("caught_up", 2)]]
    assert sorted(r.id_num for r in read_raw(spark, f"{root}/archive").collect()) == list(range(4, 26))
    final = {r.entry_key: r for r in state.load().collect()}
    assert (final["a"].last_written_message_id, final["a"].sync_status, final["a"].backlog_reason) == ("25", "healthy", None)
    assert [(r.entry_key, r.status, r.attempts, r.ordinal) for r in work.load().collect()] == [("a", "caught_up", 0, 0)]
    for _ in range(2):
        run.write_report(spark, got, f"{root}/reports/last")
    assert run.read_report(spark, f"{root}/reports/last").first().ok is True
    assert [(r.entry_key, r.added) for r in run.read_report(spark, f"{root}/reports/last", "entries").collect()] == [("a", 2)]
    with lock(spark, root), pytest.raises(Locked):
        run.catch_up(spark, root, messages, TODAY, "x")


def test_audit_requeues(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    state, work = run.tables(spark, root)
    state.save(entries_of(spark, entry("a", "3"), entry("b", None)))
    work.save(queue_of(spark, item(4, "z", status="retired")))
    got = run.audit_run(spark, root, messages_of(spark, 5), "2026-06-09T01:00:00Z", requeue=True)
    assert got["requeued"] and sorted((r.category, r.entry_key) for r in got["report"].collect()) == [("liveNewAfterCursor", "a"), ("nullCursor", "b")]
    assert [(r.ordinal, r.entry_key, r.priority, r.target_hint_message_id) for r in work.load().orderBy("ordinal").collect()] == [(4, "z", None, None), (5, "a", 25, "4")]
    assert {r.entry_key: r.sync_status for r in state.load().collect()}["a"] == "partial"


def test_audit_keeps_what_a_catch_up_changed(spark, tmp_path, monkeypatch):
    """The ledger and queue are read under the lock, which a catch-up holds until it has written both."""
    root = f"file://{tmp_path}/r"
    state, work = run.tables(spark, root)
    state.save(entries_of(spark, entry("a", "3"), entry("b", "9", channel_id="2")))
    load, seen = run.Snapshots.load, []

    def watched(self, default=None):
        seen.append((tmp_path / "r" / "LOCK").exists())
        return load(self, default)

    monkeypatch.setattr(run.Snapshots, "load", watched)
    errors = spark.createDataFrame([("a", "HTTP 500")], "entry_key string, error string")
    got = run.audit_run(spark, root, messages_of(spark, 5), "2026-06-09T01:00:00Z", requeue=True, errors=errors)
    assert all(seen) and not got["requeued"] and [(r.category, r.entry_key, r.detail) for r in got["report"].collect()] == [("errors", "a", "HTTP 500")]


def test_hook_after_a_run(spark, tmp_path):
    hook = lambda *x, **y: tuple(run.after_run(spark, *x, **y).first())
    assert hook({}) == hook({"enabled": False, "command": "exit 9"}) == ("skipped", None, None, None)
    config = {"enabled": True, "folder": str(tmp_path), "command": "printf x%.0s $(seq 5000); echo '{\"b\": 1}' > manifest.json"}
    assert hook(config, dry_run=True)[0] == "planned" and not list(tmp_path.iterdir())
    assert hook(config) == ("ok", 0, "x" * 4000, '{"b": 1}')
    (tmp_path / "manifest.json").write_text("{")
    assert hook(config | {"command": "echo no >&2; exit 3"}) == ("failed", 3, "no\n", None)


def test_migration_and_discovery(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    stats = run.migrate_run(spark, root, entries_of(spark, entry("a", "5", sync_status="partial"), entry("b", None)), queue_of(spark, item(0, "a", status="done")), "now").first()
    assert (stats.entries, stats.partial, stats.bootstrap, stats.queued) == (2, 1, 1, 2)
    assert [(r.ordinal, r.entry_key, r.status) for r in run.tables(spark, root)[1].load().orderBy("ordinal").collect()] == [(0, "a", "queued"), (1, "b", "queued")]
    inventory = spark.createDataFrame([(0, "channel", "c", None, "7", None, None)], "ordinal long, kind string, name string, channel_name string, id string, other_id string, parent string")
    assert run.discover_run(spark, root, inventory, spark.createDataFrame([], ENTRIES), "g").first().created == 1
    assert {r.entry_key for r in run.tables(spark, root)[0].load().collect()} == {"a", "b", "c"}
    header = migrate_header(spark.createDataFrame([(2, None, None, None, None, None, None)], HEADER), "q", "s").first()
    assert header.version == 3 and header.cursor_policy["compat_field"] == "last_message_id"
