"""Documents, snapshots, archives, the live source and the stream."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from test_ledger import entries_of, entry

from tidemark.operators import discover
from tidemark.operators.digest import link_extract, raw_render, topic_labels
from tidemark.operators.migrate import migrate_classify
from tidemark.plans.schemas import MESSAGES
from tidemark.sources import documents, live
from tidemark.sources.archive import read_raw, write_batch
from tidemark.sources.snapshots import Locked, MissingSnapshot, Snapshots, lock, locked_run
from tidemark.streaming import ingest


def message(n, content="hello", channel="1", ts=datetime(2024, 1, 1, 16, 0), author=("G", "u", "9"), files=None):
    return (channel, str(n), n, ts, content, author, files)


def test_read_state_and_queue(spark, tmp_path):
    state = {"version": 3, "entries": {"a": {"type": "channel", "channelId": "1", "syncStatus": None, "hot": True, "consecutiveErrors": 2, "odd": "x"}, "b": {"channelId": "2"}}}
    (tmp_path / "state.json").write_text(json.dumps(state))
    got = {r.entry_key: r for r in documents.read_state(spark, str(tmp_path / "state.json")).collect()}
    assert (got["a"].sync_status, got["a"].has_sync_status, got["b"].has_sync_status) == (None, True, False)
    assert got["a"].hot is True and got["a"].consecutive_errors == 2 and got["a"].extra == {"odd": "x"}
    (tmp_path / "queue.json").write_text(json.dumps({"version": 1, "items": [{"entryKey": "b", "status": "queued", "priority": 0}, {"entryKey": "a"}]}))
    rows = documents.read_queue(spark, str(tmp_path / "queue.json")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.entry_key, r.priority, r.has_status) for r in rows] == [(0, "b", 0, True), (1, "a", None, False)]
    back = json.loads(documents.state_json(documents.read_state(spark, str(tmp_path / "state.json"))).where("entry_key = 'a'").first().json)
    assert back["channelId"] == "1" and back["consecutiveErrors"] == 2
    (tmp_path / "bad.json").write_text(json.dumps({"version": 3}))
    with pytest.raises(Exception, match="unsupported state"):
        documents.read_state(spark, str(tmp_path / "bad.json")).collect()


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"items": x}, lambda x: {"other": 1, "threads": x}])
def test_inventory(spark, tmp_path, wrap):
    items = [{"threadName": "t", "threadId": "7", "parent": "p"}, {"name": "", "id": "8", "parent": "p"}, {"name": "u", "id": "9"}, {"name": "t", "id": "10", "parentName": "p"}]
    (tmp_path / "i.json").write_text(json.dumps(wrap(items)))
    inventory = documents.read_inventory(spark, str(tmp_path / "i.json"), "thread")
    got = discover.inventory_upsert(entries_of(spark, entry("p/t", channel_id="1")), inventory, "g").collect()
    assert [(r.entry_key, r.channel_id, r.parent_channel, r.guild_id, r.last_written_message_id) for r in got] == [("p/t", "10", "p", "g", "100")]
    s = discover.inventory_stats(entries_of(spark, entry("p/t")), inventory).first()
    assert (s.threads, s.created, s.updated) == (2, 0, 2)


def test_bad_inventory(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"none": 1}')
    with pytest.raises(Exception, match="unsupported inventory"):
        documents.read_inventory(spark, str(tmp_path / "i.json"), "channel").collect()


def test_snapshots_commit_rotate_and_recover(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/ledger")
    with pytest.raises(MissingSnapshot):
        s.load()
    for k in range(7):
        s.save(spark.createDataFrame([(k,)], "k int"))
    assert s.versions() == [3, 4, 5, 6, 7] and s.current() == 7 and s.load().first().k == 6
    for f in (tmp_path / "ledger" / "v=7").glob("*.parquet"):
        f.write_bytes(b"broken")
    (tmp_path / "ledger" / "v=7").joinpath("x").touch()
    for f in (tmp_path / "ledger" / "v=7").glob(".*.crc"):
        f.unlink()
    assert s.load().first().k == 5 and s.recovered[0]["recovered_from"].endswith("v=6")


def test_damage_in_data_pages_only(spark, tmp_path):
    """The footer is sound, so that counting rows finds nothing."""
    s = Snapshots(spark, f"file://{tmp_path}/ledger")
    for k in range(2):
        s.save(spark.range(20_000).selectExpr(f"id + {k} AS id", "uuid() AS x").coalesce(1))
    for f in (tmp_path / "ledger" / "v=2").glob("*.parquet"):
        raw = bytearray(f.read_bytes())
        raw[200_000:202_000] = bytes(k * 7 % 251 for k in range(2000))
        f.write_bytes(raw)
    for f in (tmp_path / "ledger" / "v=2").glob(".*.crc"):
        f.unlink()
    raw = spark.read.parquet(f"{tmp_path}/ledger/v=2")
    assert raw.count() == 20_000
    assert s.load().agg({"id": "min"}).first()[0] == 0 and s.recovered[0]["recovered_from"].endswith("v=1")


def test_other_errors_are_no_damage(spark, tmp_path):
    from pyspark.errors import PySparkException

    from tidemark.sources.snapshots import unreadable

    with pytest.raises(PySparkException) as e:
        spark.range(1).selectExpr("raise_error('lost')").collect()
    assert not unreadable(e.value)


def test_json_backups(spark, tmp_path):
    import os

    path, recovered = tmp_path / "state.json", []
    assert documents.sound(spark, str(path)) is None
    for name, text, at in (("state.json", '{"entries": {"a', 5), ("state.json.bak1", '{"entries": {"old": {}}}', 1), ("state.json.bak-2", '{"entries": {"a": {"channelId": "1"}}}', 2), ("state.json.bak3", "", 3)):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))
    at = documents.sound(spark, str(path), recovered)
    assert at.endswith("state.json.bak-2") and [x["path"] for x in recovered] == [str(path)]
    assert [r.entry_key for r in documents.read_state(spark, at).collect()] == ["a"]
    (tmp_path / "state.json").write_text('{"entries": {}}')
    assert documents.sound(spark, str(path), recovered) == str(path) and len(recovered) == 1
    for f in tmp_path.iterdir():
        f.write_text("{")
    with pytest.raises(documents.Unusable):
        documents.sound(spark, str(path))


def test_lock(spark, tmp_path):
    root = f"file://{tmp_path}/l"
    with lock(spark, root):
        assert locked_run(spark, root, dict)["skipped"] == "locked"
        with pytest.raises(Locked), lock(spark, root):
            pass
    assert locked_run(spark, root, lambda: {"ok": True}) == {"ok": True}


def test_lock_left_behind(spark, tmp_path):
    import os
    import time

    root = f"file://{tmp_path}/l"
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "LOCK").write_text("of a run that died")
    with pytest.raises(Locked), lock(spark, root):
        pass
    os.utime(tmp_path / "l" / "LOCK", (1, 1))
    with lock(spark, root):
        with pytest.raises(Locked), lock(spark, root):
            pass
    assert [x.name for x in (tmp_path / "l").iterdir() if not x.name.startswith(".")] == []
    with lock(spark, root, stale=1.0):  # renewed while it is held
        os.utime(tmp_path / "l" / "LOCK", (1, 1))
        time.sleep(0.7)
        with pytest.raises(Locked), lock(spark, root, stale=1.0):
            pass


def test_rendering(spark):
    m = spark.createDataFrame([message(99, "　 ", author=(None, "", "5"), files=[(None, "u"), ("f", None)]), message(100, "see https://a.b/c　end API", author=None)], MESSAGES)
    got = {r.id: r for r in raw_render(m).collect()}
    assert got["99"].block == "\n### 2024-01-02 00:00:00 +0800 — 5 — id:99\n\n(無文字內容)\n[附件] file u\n[附件] f \n"
    assert str(got["100"].day) == "2024-01-02" and "unknown" in got["100"].block
    assert link_extract(m).first().links == "attachment: u\nf: \nhttps://a.b/c"
    assert topic_labels(m).first().topics == "程式 / app / 實作討論|一般對話與進度確認"


def test_many_links_are_cut(spark):
    m = spark.createDataFrame([message(n, f"http://x/{n} http://y/{n}") for n in range(1, 30)], MESSAGES)
    assert link_extract(m).first().links.split("\n") == [f"http://{h}/{n}" for n in range(1, 7) for h in "xy"]


def test_archive_is_idempotent(spark, tmp_path):
    from pyspark.sql import functions as F

    m = spark.createDataFrame([message(n) for n in (2, 1, 1)], MESSAGES).withColumn("relative_path", F.lit("a/b"))
    for _ in range(2):
        write_batch(m, str(tmp_path), "7", "run")
    got = read_raw(spark, str(tmp_path)).collect()
    assert sorted(r.id_num for r in got) == [1, 2] and {r.relative_path for r in got} == {"a/b"}


def test_stream(spark, tmp_path):
    ledger = Snapshots(spark, f"file://{tmp_path}/ledger")
    ledger.save(entries_of(spark, entry("a", "1", channel_id="1"), entry("b", "5", channel_id="2")))
    first = [message(n) for n in range(1, 5)] + [message(n, channel="2") for n in (4, 5)]
    for x in (first[2:], first[:2]):  # the earlier messages come in a later file
        spark.createDataFrame(x, MESSAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.start(spark, f"{tmp_path}/in", ledger, f"{tmp_path}/archive", f"{tmp_path}/ck", "run", 1).awaitTermination()
    run()
    spark.createDataFrame([message(9)], MESSAGES).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    got = {r.entry_key: r for r in ledger.load().collect()}
    assert (got["a"].last_written_message_id, got["a"].sync_status, got["b"].last_written_message_id, got["b"].sync_status) == ("9", "partial", "5", "healthy")
    assert sorted(r.id_num for r in read_raw(spark, f"{tmp_path}/archive").collect()) == [2, 3, 4, 9]
    spark.createDataFrame([message(11)], MESSAGES).write.mode("append").parquet(f"{tmp_path}/in")
    end = {r.entry_key: r for r in ingest.catch_up(spark, f"{tmp_path}/in", ledger, f"{tmp_path}/archive", f"{tmp_path}/ck", "run", "2024-01-30").collect()}
    assert {k: (r.sync_status, r.backlog_reason, r.last_backup) for k, r in end.items()} == {k: ("healthy", None, "2024-01-30") for k in "ab"} and end["a"].last_written_message_id == "11"
    spark.createDataFrame([message(12)], MESSAGES).write.mode("append").parquet(f"{tmp_path}/in")  # after the stream: pending
    assert {r.entry_key: r.sync_status for r in ingest.complete(ledger, spark.read.parquet(f"{tmp_path}/in"), "2024-01-31").collect()}["b"] == "healthy"
    assert {r.entry_key: r.last_backup for r in ledger.load().collect()} == {"a": "2024-01-30", "b": "2024-01-31"}


def test_rate_limit_is_bounded():
    calls, waits = [], []

    def get(url, headers):
        calls.append(url)
        return 429, '{"retry_after": 99}'

    with pytest.raises(live.ReadFailed):
        live.read_page("http://x", "1", "5", 10, "t", get, waits.append)
    assert len(calls) == 9 and waits == [30.0] * 8 and "after=5" in calls[0]


def test_paging():
    data = [{"id": str(n)} for n in range(1, 8)]

    def get(url, headers):
        after = int(url.rpartition("after=")[2]) if "after=" in url else 0
        return 200, json.dumps([m for m in data if int(m["id"]) > after][:3][::-1])

    assert [m["id"] for m in live.read_channel("http://x", "1", None, 3, 9, "t", get)] == [str(n) for n in range(1, 8)]
    assert len(list(live.read_channel("http://x", "1", None, 3, 2, "t", get))) == 6
    with pytest.raises(live.ReadFailed, match="HTTP 500"):
        live.read_page("http://x", "1", None, 3, "t", lambda *_: (500, "no"))


def test_token(monkeypatch, tmp_path):
    monkeypatch.delenv("MESSAGES_TOKEN", raising=False)
    (tmp_path / "c.json").write_text(json.dumps({"channels": {"chat": {"token": "t"}, "x": "y"}}))
    options = {"token_file": str(tmp_path / "c.json"), "token_path": "channels.chat.token"}
    assert live.token_of(options) == "t"
    for bad in ({}, options | {"token_path": "channels.x.token"}, options | {"token_file": str(tmp_path / "none")}):
        with pytest.raises(live.NoToken):
            live.token_of(bad)
    monkeypatch.setenv("MESSAGES_TOKEN", "e")
    assert live.token_of(options) == "e"


def test_live_stream(spark, tmp_path):
    """From the paged API to a healthy ledger: bounded batches, a channel that fails for a while, a restart from the checkpoint."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    data = {"1": list(range(1, 24)), "2": [4, 5, 6], "3": []}
    refused = {"2": 3}

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            channel, query = at.path.split("/")[2], parse_qs(at.query)
            bad = refused.get(channel, 0) > 0
            refused[channel] = refused.get(channel, 0) - 1
            ids = [n for n in data[channel] if n > int(query.get("after", ["0"])[0])][: int(query["limit"][0])]
            body = b"no" if bad else json.dumps([{"id": str(n), "timestamp": "2024-01-01T00:00:00Z", "content": f"m{n}", "author": {"username": "u"}} for n in ids[::-1]]).encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "c.json").write_text('{"token": "t"}')
    spark.dataSource.register(live.PagedMessages)
    ledger = Snapshots(spark, f"file://{tmp_path}/ledger")
    ledger.save(entries_of(spark, entry("a", "3", channel_id="1"), entry("b", None, channel_id="2"), entry("c", "9", channel_id="3")))
    options = {"url": f"http://127.0.0.1:{server.server_port}", "cursors": json.dumps({"1": "3", "2": "", "3": "9"}), "page": "5", "reads": "1", "token_file": f"{tmp_path}/c.json"}

    def run():
        stream = live.as_messages(spark.readStream.format("paged_messages").options(**options).load())
        query = ingest.start_from(spark, stream, ledger, f"{tmp_path}/archive", f"{tmp_path}/ck", "run", processingTime="0 seconds")
        query.processAllAvailable()
        query.stop()

    try:
        run()
        data["1"] += [30, 31]
        run()
        once = spark.read.format("paged_messages").options(**options | {"pages": "9"}).load()
        end = {r.entry_key: (r.last_written_message_id, r.sync_status) for r in ingest.complete(ledger, live.as_messages(once), "2024-01-30").collect()}
    finally:
        server.shutdown()
    assert end == {"a": ("31", "healthy"), "b": ("6", "healthy"), "c": ("9", "healthy")}
    got = read_raw(spark, f"{tmp_path}/archive").collect()
    assert sorted((r.channel_id, r.id_num) for r in got) == [*(("1", n) for n in [*range(4, 24), 30, 31]), *(("2", n) for n in (4, 5, 6))]


def test_live_source(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            bad = "/channels/2/" in self.path
            body = b"no" if bad else json.dumps([{"id": "7", "timestamp": "2024-01-01T00:00:00Z", "content": "x", "author": {"username": "u"}}]).encode()
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "c.json").write_text('{"token": "t"}')
    spark.dataSource.register(live.PagedMessages)
    df = spark.read.format("paged_messages").option("url", f"http://127.0.0.1:{server.server_port}").option("cursors", json.dumps({"1": "5", "2": ""})).option("token_file", f"{tmp_path}/c.json").load()
    got = {r.channel_id: r for r in df.collect()}
    server.shutdown()
    assert got["1"].id == "7" and got["1"].author.username == "u" and got["2"].error.startswith("HTTP 500")


def test_migration_anomalies(spark):
    e = entries_of(spark, entry("a", sync_status="partial", backlog_reason="page_limit_reached"), entry("b", backlog_reason="x"), entry("c", None), entry("d", deferred_reason="達單輪上限", hot=True))
    got = {r.entry_key: r for r in migrate_classify(e).collect()}
    assert (got["a"].backlog_reason, got["a"].priority) == ("daily_deferred", 20)
    assert (got["b"].sync_status, got["b"].backlog_reason, got["b"].enqueue) == ("healthy", "x", False)
    assert (got["c"].sync_status, got["c"].priority) == ("queued", 60)
    assert (got["d"].sync_status, got["d"].priority) == ("partial", 5)
