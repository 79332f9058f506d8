"""Messages from a paged REST API: as a Python data source in batch and stream, one partition a channel, and read after the cursors of a DataFrame.

The API answers GET <url>/channels/<id>/messages?limit=&after= with a JSON list
of the oldest messages after the cursor.  Status 429 is retried at most eight
times, after the time that the answer asks for and at most 30 seconds; any other
error fails the channel.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MOST_RETRIES, LONGEST_WAIT, MARGIN, TIMEOUT = 8, 30.0, 0.25, 30

SCHEMA = "channel_id string, id string, ts string, content string, author struct<global_name:string,username:string,id:string>, attachments array<struct<filename:string,url:string>>, error string"


class ReadFailed(Exception):
    """The API refused a read, or kept limiting it."""


class NoToken(Exception):
    """Neither the environment nor the configuration has a token."""


def token_of(options: dict[str, str]) -> str:
    """The API's token: the environment variable token_env (MESSAGES_TOKEN), else the field token_path (dots between names) of the JSON file token_file.

    Looked up once for a read, by the process that plans it on the driver's machine.
    """
    name = options.get("token_env", "MESSAGES_TOKEN")
    if os.environ.get(name):
        return os.environ[name]
    file, value = options.get("token_file"), None
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            value = json.load(f)
        for key in options.get("token_path", "token").split("."):
            value = value.get(key) if isinstance(value, dict) else None
    if not value:
        raise NoToken(f"set {name}, or token_file and token_path")
    return str(value)


def get_json(url: str, headers: dict[str, str]) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as answer:
            return answer.status, answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "ignore")


def read_page(base: str, channel: str, after: str | None, limit: int, token: str, get: Callable = get_json, sleep: Callable = time.sleep) -> list[dict]:
    """One page, oldest first by number."""
    query = {"limit": str(limit)} | ({"after": after} if after else {})
    url = f"{base}/channels/{channel}/messages?{urllib.parse.urlencode(query)}"
    for attempt in range(MOST_RETRIES + 1):
        status, body = get(url, {"Authorization": f"Bot {token}"})
        if status == 200:
            return sorted(json.loads(body), key=lambda m: int(m["id"]))
        if status != 429:
            raise ReadFailed(f"HTTP {status}: {body[:500]}")
        if attempt < MOST_RETRIES:
            try:
                wait = float(json.loads(body).get("retry_after", 1.0))
            except (ValueError, TypeError, AttributeError):
                wait = 1.0
            sleep(min(wait + MARGIN, LONGEST_WAIT))
    raise ReadFailed(f"still limited after {MOST_RETRIES} more tries: {body[:200]}")


def read_channel(base: str, channel: str, cursor: str | None, page: int, pages: int, token: str, get: Callable = get_json, sleep: Callable = time.sleep) -> Iterator[dict]:
    """Messages after the cursor, page by page up to a short page or `pages` of them."""
    for _ in range(pages):
        got = read_page(base, channel, cursor, page, token, get, sleep)
        yield from got
        if len(got) < page:
            return
        cursor = got[-1]["id"]


@dataclass
class _Channel(InputPartition):
    channel: str
    cursor: str | None


def _row(channel: str, m: dict) -> tuple:
    a = m.get("author") or {}
    files = [(x.get("filename"), x.get("url")) for x in m.get("attachments") or []]
    return channel, m["id"], m.get("timestamp"), m.get("content"), (a.get("global_name"), a.get("username"), a.get("id")), files, None


def as_messages(df: DataFrame, keep: list[str] | None = None, only_messages: bool = True) -> DataFrame:
    """Rows of the source as messages, with the columns `keep`; rows that tell of an error or of an empty read go, unless asked for."""
    ts = F.to_timestamp("ts").cast("timestamp_ntz")
    rows = df.where("id is not null") if only_messages else df
    return rows.select("channel_id", "id", F.col("id").cast("bigint").alias("id_num"), ts.alias("ts"), "content", "author", "attachments", *(keep or []))


def errors_of(df: DataFrame) -> DataFrame:
    """entry_key, error, ok_reads of what read_after() couldn't read; ok_reads: pages read before that."""
    return df.where("error is not null").select("entry_key", "error", "ok_reads")


def cursors_option(places: DataFrame) -> str:
    """The option `cursors` from entry_key, channel_id, cursor: a channel that several entries have is read after the least cursor.

    One line for each channel comes to the driver, as it is in a stream's offsets.
    """
    rows = places.where("channel_id is not null").groupBy("channel_id").agg(F.min_by("cursor", F.coalesce(F.col("cursor").try_cast("bigint"), F.lit(0))).alias("cursor")).collect()
    return json.dumps({r.channel_id: r.cursor or "" for r in rows}, sort_keys=True)


class _Paced:
    """Requests of one task at most so often; waits before each but the first."""

    def __init__(self, every: float, get: Callable = None):
        self.every, self.get, self.next = every, get or get_json, 0.0

    def __call__(self, url: str, headers: dict[str, str]) -> tuple[int, str]:
        now = time.monotonic()
        if self.next > now:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.every
        return self.get(url, headers)


def read_after(places: DataFrame, options: dict[str, str], page: int = 100, pages: int = 1, tasks: int = 8, rate: float | None = None) -> DataFrame:
    """Reads the API after each place's cursor (entry_key, channel_id, cursor), in `tasks` tasks: the source's columns, with entry_key and ok_reads.

    Up to `pages` pages are read of each, and after a short one, or as many full
    ones, one message more, so that what is there can be told from what isn't.
    `rate` is what all tasks together may ask a second; each has an equal share.
    A place whose read fails gives the messages read before and a row with the
    error and the number of reads before it; one with nothing after its cursor
    gives a row without id and error.  Each call of an action reads anew: cut()
    what is used twice.
    """
    token, every = token_of(options), tasks / rate if rate else 0.0
    url, names = options["url"], ["entry_key", "channel_id", "id", "ts", "content", "author", "attachments", "error", "ok_reads"]
    message = pa.struct([("filename", pa.string()), ("url", pa.string())])
    author = pa.struct([("global_name", pa.string()), ("username", pa.string()), ("id", pa.string())])
    schema = pa.schema([*((n, pa.string()) for n in names[:5]), ("author", author), ("attachments", pa.list_(message)), ("error", pa.string()), ("ok_reads", pa.int32())])

    def one(entry: str, channel: str | None, cursor: str | None, get: Callable) -> Iterator[tuple]:
        reads = found = 0
        try:
            if channel is None:
                raise ReadFailed("no channel")
            while True:
                size = page if reads < pages and (not reads or found == page * reads) else 1
                got = read_page(url, channel, cursor, size, token, get)
                for m in got:
                    yield entry, *_row(channel, m), None
                reads, found, cursor = reads + 1, found + len(got), got[-1]["id"] if got else cursor
                if not got or size < page or (page == 1 and reads >= pages):
                    break
        except (ReadFailed, OSError, ValueError, KeyError, TypeError) as e:
            yield entry, channel, None, None, None, None, None, str(e) or type(e).__name__, reads
            return
        if not found:
            yield entry, channel, None, None, None, None, None, None, reads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Paced(every)
        for batch in batches:
            for place in batch.to_pylist():
                rows = [_named(names, x) for x in one(place["entry_key"], place["channel_id"], place["cursor"], get)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return places.select("entry_key", "channel_id", "cursor").repartition(tasks).mapInArrow(run, f"entry_key string, {SCHEMA}, ok_reads int")


def _named(names: list[str], row: tuple) -> dict:
    out = dict(zip(names, row, strict=True))
    if out["author"] is not None:
        out["author"] = dict(zip(("global_name", "username", "id"), out["author"], strict=True))
        out["attachments"] = [dict(zip(("filename", "url"), x, strict=True)) for x in out["attachments"]]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.token = options, token_of(options)

    def partitions(self) -> list[InputPartition]:
        return [_Channel(c, x or None) for c, x in json.loads(self.options["cursors"]).items()]

    def read(self, partition: _Channel) -> Iterator[tuple]:
        o = self.options
        try:
            for m in read_channel(o["url"], partition.channel, partition.cursor, int(o.get("page", 100)), int(o.get("pages", 5)), self.token):
                yield _row(partition.channel, m)
        except (ReadFailed, OSError) as e:
            yield partition.channel, None, None, None, None, None, str(e)


@dataclass
class _Range(InputPartition):
    """A channel's messages after one id up to another, and what is to be said of it: nothing, that a read gave nothing ("") or an error."""

    channel: str
    after: str
    upto: str
    said: str | None


class _StreamReader(DataSourceStreamReader):
    """Offsets are a channel's last id, whether a read after it gave nothing, and its failures.

    A batch is at most `reads` pages with messages, `threads` of which are asked
    for at once; every channel is asked at most once.  The planner keeps a page's
    last id and drops it; tasks, one a channel, read its messages again, up to
    that id, so that a batch that is repeated is the same.  A channel whose read
    fails is asked again in the next two batches, and then every `again` seconds.
    What is known is where the reader was made to begin (the ledger's cursors)
    and what it has planned since.  If a checkpoint is ahead of that, the first
    batch after a restart tells, and the next one reads some messages again.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.token, self.next, self.later = options, token_of(options), 0, {}
        self.known = {c: {"id": x or "", "empty": False, "failed": 0, "error": ""} for c, x in sorted(json.loads(options["cursors"]).items())}
        self.begin = {c: dict(x) for c, x in self.known.items()}

    def initialOffset(self) -> dict:
        return self.begin

    def _asked(self, channel: str) -> list[dict] | Exception:
        try:
            return read_page(self.options["url"], channel, self.known[channel]["id"] or None, int(self.options.get("page", 100)), self.token)
        except (ReadFailed, OSError, ValueError, KeyError, TypeError) as e:
            return e

    def latestOffset(self) -> dict:
        channels, left, threads = list(self.known), int(self.options.get("reads", 12)), int(self.options.get("threads", 4))
        turn = [c for c in channels[self.next :] + channels[: self.next] if self.later.get(c, 0.0) <= time.monotonic()]
        with ThreadPoolExecutor(threads) as pool:
            while turn and left > 0:
                now, turn = turn[: min(threads, left)], turn[min(threads, left) :]
                for channel, got in zip(now, pool.map(self._asked, now), strict=True):
                    at = self.known[channel]
                    if isinstance(got, Exception):
                        at |= {"failed": at["failed"] + 1, "error": str(got)[:500] or type(got).__name__}
                        if at["failed"] % 3 == 0:
                            self.later[channel] = time.monotonic() + float(self.options.get("again", 600))
                    else:
                        at |= {"failed": 0, "error": "", "empty": not got}
                        if got:
                            at["id"], left = got[-1]["id"], left - 1
                    self.next = (channels.index(channel) + 1) % len(channels)
        return {c: dict(x) for c, x in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, new = [], {"id": "", "empty": False, "failed": 0, "error": ""}
        for channel, to in end.items():
            was = start.get(channel, new)
            for x in (was, to) if channel in self.known else ():  # planned before a restart
                if int(x["id"] or 0) > int(self.known[channel]["id"] or 0):
                    self.known[channel]["id"] = x["id"]
            said = to["error"] if to["failed"] and to["failed"] != was["failed"] else "" if to["empty"] and not was["empty"] else None
            if int(to["id"] or 0) > int(was["id"] or 0) or said is not None:
                out.append(_Range(channel, was["id"], to["id"], said))
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        p, o = partition, self.options
        if p.upto != p.after:
            for m in read_channel(o["url"], p.channel, p.after or None, int(o.get("page", 100)), 2**31, self.token):
                if int(m["id"]) > int(p.upto):
                    break
                yield _row(p.channel, m)
        if p.said is not None:
            yield p.channel, None, None, None, None, None, p.said or None


class PagedMessages(DataSource):
    """spark.read.format("paged_messages").option("url", ...).option("cursors", json of channel to cursor).load()

    A channel that fails gives the messages read so far and a row with its error.
    spark.readStream reads on from the cursors, a bounded number of pages a batch;
    a row without id says that a read failed (error) or that it gave nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_messages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
