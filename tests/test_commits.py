"""Archives and ledgers that lose and repeat nothing: crashes, other writers, streams, the served API."""

from __future__ import annotations

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F
from test_ledger import TODAY, entries_of, entry, item, queue_of
from test_sources import message

from tidemark import run
from tidemark.operators.catchup import Limits, ranked_messages
from tidemark.plans.places import with_places
from tidemark.plans.schemas import MESSAGES
from tidemark.sources import documents, live, snapshots
from tidemark.sources.archive import Archive, read_raw
from tidemark.sources.messages import read_messages, write_messages
from tidemark.sources.snapshots import Moved, Snapshots
from tidemark.streaming import ingest

NOW, SMALL = "2026-06-09T01:00:00Z", Limits(4, 12, 1, 3)


class Crash(Exception):
    pass


def messages_of(spark, *ids, channel="1"):
    return spark.createDataFrame([message(n, channel=channel) for n in ids], MESSAGES)


def ids_in(spark, root):
    """Ids of the archive's messages, as often as they are there."""
    return sorted(r.id_num for r in read_raw(spark, f"{root}/archive").collect())


def cursor_of(spark, root, key="a"):
    return {r.entry_key: r.last_written_message_id for r in run.tables(spark, root)[0].load().collect()}[key]


def new_root(spark, tmp_path, *entries):
    root = f"file://{tmp_path}/r"
    run.tables(spark, root)[0].save(entries_of(spark, *(entries or [entry("a", "0")])))
    return root


def test_runs_with_one_now(spark, tmp_path):
    root = new_root(spark, tmp_path)
    seen = []
    for _ in range(4):
        run.catch_up(spark, root, messages_of(spark, *range(1, 9)), TODAY, NOW, SMALL)
        seen.append((cursor_of(spark, root), len(ids_in(spark, root))))
    assert seen == [("3", 3), ("6", 6), ("8", 8), ("8", 8)] and ids_in(spark, root) == list(range(1, 9))
    assert Archive(spark, f"{root}/archive").summaries().count() == 3


@pytest.mark.parametrize("where", ["Archive.announce", "Snapshots.save", "Archive.confirm", "numbered"])
def test_crash_within_a_run(spark, tmp_path, monkeypatch, where):
    """Before the batch is announced, before the ledger is committed, after that, and before the queue is: archive and cursors agree."""
    root = new_root(spark, tmp_path)

    def crash(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        name, _, method = where.partition(".")
        m.setattr(getattr(run, name), method, crash) if method else m.setattr(run, name, crash)
        with pytest.raises(Crash):
            run.catch_up(spark, root, messages_of(spark, *range(1, 9)), TODAY, NOW, SMALL)
    committed = where in ("Archive.confirm", "numbered")
    assert (cursor_of(spark, root), ids_in(spark, root)) == (("3", [1, 2, 3]) if committed else ("0", []))
    for _ in range(3):
        run.catch_up(spark, root, messages_of(spark, *range(1, 9)), TODAY, NOW, SMALL)
    assert ids_in(spark, root) == list(range(1, 9)) and cursor_of(spark, root) == "8"
    files = Archive(spark, f"{root}/archive").files
    assert not [b for b in files.folders("raw") if b.removeprefix("batch=") not in files.names("commits")] or where == "Archive.announce"


def test_audit_before_the_lock_is_kept(spark, tmp_path, monkeypatch):
    """A catch-up that has begun but not got the lock sees what an audit commits meanwhile."""
    root = new_root(spark, tmp_path, entry("a", "0"), entry("b", "9", channel_id="2", last_backup=TODAY))
    both = messages_of(spark, *range(1, 5)).unionByName(messages_of(spark, 20, channel="2"))
    held = run.lock

    def late(*x, **y):
        monkeypatch.setattr(run, "lock", held)
        assert run.audit_run(spark, root, both, NOW, requeue=True)["requeued"]
        return held(*x, **y)

    monkeypatch.setattr(run, "lock", late)
    run.catch_up(spark, root, both, TODAY, NOW, Limits(1, 12, 1, 3))
    got = {r.entry_key: r for r in run.tables(spark, root)[0].load().collect()}
    assert got["b"].last_seen_message_id == "20" and got["b"].sync_status in ("partial", "healthy") and {r.entry_key for r in run.tables(spark, root)[1].load().collect()} == {"a", "b"}
    assert sum(len(x) for x in [ids_in(spark, root)]) == (3 if got["a"].last_written_message_id == "3" else 1)


def test_commit_by_comparison(spark, tmp_path):
    a, b = (Snapshots(spark, f"file://{tmp_path}/l") for _ in range(2))
    rows = lambda *x: spark.createDataFrame(list(x), "entry_key string, n int")
    a.save(rows(("x", 0)))
    a.load(), b.load()
    a.save(rows(("x", 1)), expected=a.at)
    with pytest.raises(Moved):
        b.save(rows(("x", 2)), expected=b.at)
    assert b.load().first().n == 1 and len(a.commits()) == 2
    again = []

    def plus(table):
        if not again:
            again.append(a.save(rows(("x", 5))))  # another writer, in between
        return table.withColumn("n", F.col("n") + 1)

    b.update(plus)
    assert a.load().first().n == 6


def test_many_writers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/l"
    Snapshots(spark, root).save(spark.createDataFrame([(k, 0) for k in "abcd"], "entry_key string, n int"))

    def work(key):
        own = Snapshots(spark, root)
        for _ in range(3):
            own.update(lambda t: t.withColumn("n", F.col("n") + (F.col("entry_key") == key).cast("int")))

    threads = [threading.Thread(target=work, args=(k,)) for k in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.entry_key: r.n for r in Snapshots(spark, root).load().collect()} == dict.fromkeys("abcd", 3)


def test_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "DELTAS", 3)
    s = Snapshots(spark, f"file://{tmp_path}/l", keep=2)
    rows = lambda *x: spark.createDataFrame(list(x), "entry_key string, n int")
    s.save(rows(*((str(k), 0) for k in range(50))))
    kinds = []
    for n in range(1, 9):
        s.patch(rows(("7", n), (f"new{n}", n)), expected=s.at)
        kinds.append(s.entry(s.at)["kind"])
        got = {r.entry_key: r.n for r in s.load().collect()}
        assert got["7"] == n and len(got) == 50 + n and got["8"] == 0
    assert kinds == [*["delta"] * 3, "table", *["delta"] * 3, "table"]
    assert spark.read.parquet(f"{tmp_path}/l/v=8").count() == 2  # only what was touched
    with pytest.raises(Moved):
        s.patch(rows(("7", 0)), expected=s.at - 1)
    s.patch(rows(("7", 99)), expected=s.at)
    last = tmp_path / "l" / f"v={s.current()}"
    for f in [*last.glob("*.parquet")]:
        f.write_bytes(b"broken")
    for f in last.glob(".*.crc"):
        f.unlink()
    assert {r.entry_key: r.n for r in s.load().collect()}["7"] == 8 and len(s.recovered) == 1


def put(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), MESSAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_second_stream_on_one_archive(spark, tmp_path):
    ledger = Snapshots(spark, f"file://{tmp_path}/r/ledger")
    ledger.save(entries_of(spark, entry("a", "0"), *(entry(f"other{k}", "5", channel_id=f"9{k}") for k in range(30))))
    go = lambda ck: ingest.start(spark, f"{tmp_path}/in", ledger, f"{tmp_path}/r/archive", f"{tmp_path}/{ck}", "run", 1).awaitTermination()
    put(spark, tmp_path, *(message(n) for n in (1, 2, 5, 5)))
    go("ck1")
    assert ledger.entry(ledger.load() and ledger.at)["kind"] == "delta" and spark.read.parquet(f"{tmp_path}/r/ledger/v={ledger.current()}").count() == 1
    put(spark, tmp_path, *(message(n) for n in (3, 5, 6)))  # late, repeated, new
    go("ck1")
    put(spark, tmp_path, message(8))
    go("ck2")  # another checkpoint: its batch 0 isn't the first one's
    assert ids_in(spark, f"{tmp_path}/r") == [1, 2, 3, 5, 6, 8] and cursor_of(spark, f"file://{tmp_path}/r") == "8"
    # A crash after the commit and before the stream's own note of it: the batch is done again, and finds itself committed.
    done = max((tmp_path / "ck1" / "commits").iterdir(), key=lambda f: int(f.name) if f.name.isdigit() else -1)
    done.unlink()
    (done.parent / f".{done.name}.crc").unlink(missing_ok=True)
    put(spark, tmp_path, message(9))
    go("ck1")
    assert ids_in(spark, f"{tmp_path}/r") == [1, 2, 3, 5, 6, 8, 9]


def test_catch_up_while_a_stream_commits(spark, tmp_path, monkeypatch):
    """The stream commits between the catch-up's archive and ledger: the run is made anew, and both changes are there, each message once."""
    root = new_root(spark, tmp_path)
    put(spark, tmp_path, *(message(n) for n in range(1, 6)))
    state, announce, streamed = Snapshots(spark, f"{root}/ledger"), Archive.announce, []

    def between(self, *x):
        announce(self, *x)
        if not streamed:
            streamed.append(1)
            ingest.start(spark, f"{tmp_path}/in", state, f"{root}/archive", f"{tmp_path}/ck", "run").awaitTermination()

    monkeypatch.setattr(Archive, "announce", between)
    got = run.catch_up(spark, root, messages_of(spark, *range(1, 9)), TODAY, NOW, SMALL)
    assert [(r.cursor, r.added) for r in got["entries"].collect()] == [("5", 3)]
    assert ids_in(spark, root) == list(range(1, 9)) and cursor_of(spark, root) == "8"
    # The other way round: the catch-up commits between the stream's archive and ledger.
    put(spark, tmp_path, *(message(n) for n in range(9, 13)))
    other = []

    def again(self, *x):
        announce(self, *x)
        if not other:
            other.append(1)
            run.catch_up(spark, root, messages_of(spark, *range(1, 12)), "2026-06-10", NOW, Limits(4, 12, 1, 2))

    monkeypatch.setattr(Archive, "announce", again)
    ingest.start(spark, f"{tmp_path}/in", state, f"{root}/archive", f"{tmp_path}/ck", "run").awaitTermination()
    assert ids_in(spark, root) == list(range(1, 13)) and cursor_of(spark, root) == "12"


# ---- the served API ----


def test_live_stream_ends_healthy(spark, tmp_path, served):
    served.data = {"1": list(range(1, 24)), "2": [4, 5, 6], "3": [], "4": [1]}
    served.failing, served.limited = {"2": 2, "4": 99}, {"1": 3}
    root = new_root(spark, tmp_path, entry("a", "3"), entry("b", None, channel_id="2"), entry("c", "9", channel_id="3"), entry("d", "0", channel_id="4"))
    ledger = Snapshots(spark, f"{root}/ledger")

    def go():
        query = ingest.start_live(spark, served.options | {"page": "5", "reads": "2"}, ledger, f"{root}/archive", f"{tmp_path}/ck", "run", TODAY, processingTime="0 seconds")
        query.processAllAvailable()
        query.stop()
        return {r.entry_key: (r.last_written_message_id, r.sync_status, r.backlog_reason, r.last_backup, r.consecutive_errors) for r in ledger.load().collect()}

    first = go()
    assert first["a"] == ("23", "healthy", None, TODAY, 0) and first["b"] == ("6", "healthy", None, TODAY, 0) and first["c"][1] == "healthy"
    assert first["d"][:2] == ("0", "error") and first["d"][4] == 3
    served.data["1"] += [30, 31]
    served.failing = {}
    second = go()
    assert second["a"][:2] == ("31", "healthy") and second["d"] == ("1", "healthy", None, TODAY, 0)
    got = read_raw(spark, f"{root}/archive").collect()
    assert sorted((r.channel_id, r.id_num) for r in got) == [*(("1", n) for n in [*range(4, 24), 30, 31]), *(("2", n) for n in (4, 5, 6)), ("4", 1)]


def test_audit_of_the_served_api(spark, tmp_path, served):
    served.data = {"1": [5, 6], "2": [7], "3": [9], "4": [9]}
    served.failing, served.limited = {"2": 99}, {"3": 2, "4": 99}
    root = new_root(spark, tmp_path, entry("a", "5"), entry("b", "1", channel_id="2"), entry("c", "9", channel_id="3"), entry("d", "1", channel_id="4"), entry("e", "3", channel_id=None), entry("f", None))
    got = run.audit_live(spark, root, served.options, NOW, requeue=True, tasks=2, rate=200)
    report = sorted((r.category, r.entry_key, (r.detail or "")[:8]) for r in got["report"].collect())
    assert report == [("errors", "b", "HTTP 500"), ("errors", "d", "still li"), ("errors", "e", "no chann"), ("liveNewAfterCursor", "a", "6"), ("nullCursor", "f", "")]
    assert got["requeued"] and [r.entry_key for r in run.tables(spark, root)[1].load().collect()] == ["a"]


def test_probes_share_a_rate(spark, served):
    served.data = {str(k): [] for k in range(12)}
    places = spark.createDataFrame([(str(k), str(k), "0") for k in range(12)], "entry_key string, channel_id string, cursor string")
    found = live.read_after(places, served.options, 1, 1, tasks=3, rate=20.0).collect()
    times = sorted(t for _, t in served.asked)
    assert len(found) == 12 and all(r.id is None and r.error is None for r in found)
    assert len(times) == 12 and times[-1] - times[0] >= (12 / 3 - 2) * 3 / 20.0  # each task waits 3/20 s between its requests


def test_catch_up_from_the_served_api(spark, tmp_path, served):
    served.data = {"1": list(range(1, 8)), "2": list(range(1, 4)), "3": [1]}
    root = new_root(spark, tmp_path, entry("a", "0"), entry("b", "0", channel_id="2"), entry("c", "0", channel_id="3"))
    served.failing = {"3": 99}
    got = run.catch_up_live(spark, root, served.options, TODAY, NOW, Limits(4, 20, 2, 3))
    assert {r.entry_key: (r.status, r.added) for r in got["entries"].collect()} == {"a": ("still_queued", 6), "b": ("caught_up", 3), "c": ("error", 0)}
    state = {r.entry_key: (r.sync_status, r.last_written_message_id, r.consecutive_errors) for r in run.tables(spark, root)[0].load().collect()}
    assert state["a"][:2] == ("partial", "6") and state["b"][:2] == ("healthy", "3") and state["c"] == ("error", "0", 1)
    assert ids_in(spark, root) == sorted([*range(1, 7), 1, 2, 3])


# ---- reads and places ----


def test_reads_open_files_of_their_channels_only(spark, tmp_path):
    rows = [message(n, channel=str(c)) for c in range(1, 6) for n in range(1, 40)] + [message(n, channel="7") for n in range(1, 2000)]
    write_messages(spark.createDataFrame(rows, MESSAGES), f"{tmp_path}/m", ranges=4)
    assert len(list((tmp_path / "m" / "channel_id=7").glob("*.parquet"))) > 1  # a large channel is several files
    for c in (3, 4, 5):
        for f in (tmp_path / "m" / f"channel_id={c}").glob("*.parquet"):
            f.write_bytes(b"broken")
    chosen = spark.createDataFrame([("a", "1", "35", 35), ("b", "7", "1990", 1990), ("c", "o'\\dd", "0", 0)], "entry_key string, channel_id string, cursor string, cursor_num long")
    got = ranked_messages(chosen, read_messages(spark, f"{tmp_path}/m"), 100)
    assert sorted((r.entry_key, r.id_num) for r in got.collect()) == [*(("a", n) for n in range(36, 40)), *(("b", n) for n in range(1991, 2000))]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [channel_id" in plan and "GreaterThan(id_num,35)" in plan and "WindowGroupLimit" in plan


def test_places_without_a_window(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, *range(7)])) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, x int").repartition(5)
    order = [F.col("x").desc_nulls_first(), F.col("k")]
    got = with_places(df, order, "n")
    assert "Window" not in got._jdf.queryExecution().toString()
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    assert [(r.k, r.x) for r in sorted(got.collect(), key=lambda r: r.n)] == want and sorted(r.n for r in got.collect()) == list(range(500))
    assert with_places(df.limit(0), order, "n").collect() == []
    queue = queue_of(spark, item(4, "z"), item(None, "y"), item(None, "b"))
    assert sorted((r.ordinal, r.entry_key) for r in run.numbered(queue).collect()) == [(4, "z"), (5, "b"), (6, "y")]
    assert sorted((r.ordinal, r.entry_key) for r in run.numbered(queue_of(spark, item(None, "y"))).collect()) == [(0, "y")]


def test_readers_recover_documents(spark, tmp_path):
    for name, text, at in (
        ("state.json", '{"entries": {"a', 9), ("state.json.bak1", '{"entries": {"old": {}}}', 1), ("state.json.bak2", '{"entries": {"a": {"channelId": "1"}}}', 2), ("state.json.bak3", "[", 3),
        ("queue.json", "", 9), ("queue.json.bak", '{"items": [{"entryKey": "q"}]}', 2), ("queue.jsonx", '{"items": []}', 9),
    ):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))
    recovered = []
    assert [r.entry_key for r in documents.read_state(spark, f"{tmp_path}/state.json", recovered).collect()] == ["a"]
    assert [r.entry_key for r in documents.read_queue(spark, f"{tmp_path}/queue.json", recovered).collect()] == ["q"]
    assert [x["recovered_from"].rpartition("/")[2] for x in recovered] == ["state.json.bak2", "queue.json.bak"]
    (tmp_path / "state.json").write_text(json.dumps({"entries": {"new": {}}}))
    assert [r.entry_key for r in documents.read_state(spark, f"{tmp_path}/state.json", recovered).collect()] == ["new"] and len(recovered) == 2
    with pytest.raises(documents.Missing):
        documents.read_queue(spark, f"{tmp_path}/none.json")
    (tmp_path / "queue.json.bak").write_text("{")
    with pytest.raises(documents.Unusable):
        documents.read_queue(spark, f"{tmp_path}/queue.json")
