"""A ledger, queue and messages derived from the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cut import cut

RUN_DATE = "2024-01-30"
RUN_TIME = "2024-01-30T09:00:00Z"

_BASE = """base AS (SELECT user_id AS u, max(CASE WHEN CAST(ts AS DATE) < DATE '2024-01-25' THEN event_id END) AS cur, max(event_id) AS top FROM events GROUP BY user_id)"""

_ENTRIES = """entries AS (SELECT 'ch' || CAST(u AS STRING) AS entry_key,
    CASE WHEN u % 4 = 3 THEN 'thread' ELSE 'channel' END AS type,
    CASE WHEN u % 41 = 0 THEN NULL ELSE CAST(u - CASE WHEN u % 43 = 1 THEN 1 ELSE 0 END AS STRING) END AS channel_id,
    CASE WHEN u % 23 = 0 THEN 'shared/path' WHEN u % 19 = 0 THEN 'hot/lively/' || CAST(u AS STRING) ELSE 'archive/' || CAST(u AS STRING) END AS relative_path,
    CASE WHEN u % 13 = 0 THEN NULL WHEN u % 11 = 0 THEN '' ELSE CAST(cur AS STRING) END AS last_written_message_id,
    CASE WHEN u % 13 = 0 THEN NULL WHEN u % 17 = 0 THEN CAST(cur - 1 AS STRING) ELSE CAST(cur AS STRING) END AS last_message_id,
    CASE WHEN u % 6 = 1 THEN CAST(top AS STRING) END AS last_seen_message_id,
    CASE u % 10 WHEN 0 THEN 'healthy' WHEN 1 THEN 'partial' WHEN 2 THEN 'healthy' WHEN 3 THEN 'error' WHEN 5 THEN 'healthy' WHEN 6 THEN 'queued' WHEN 7 THEN 'healthy' WHEN 8 THEN 'catching_up' WHEN 9 THEN 'caught_up' END AS sync_status,
    (u % 20 <> 4) AS has_sync_status,
    CASE WHEN u % 7 = 2 THEN 'page_limit_reached' WHEN u % 29 = 0 THEN 'stale_incremental' WHEN u % 7 = 3 THEN '' END AS backlog_reason,
    CASE WHEN u % 14 = 5 THEN '達單輪上限' WHEN u % 14 = 6 THEN 'Deferred by limit' END AS deferred_reason,
    CASE WHEN u % 16 = 7 THEN '增量部分完成' END AS daily_sync_status,
    CASE WHEN u % 18 = 7 THEN 'partial read' WHEN u % 18 = 8 THEN '剩餘交給 backlog' END AS daily_sync_note,
    (u % 12 = 1) AS hot,
    CASE u % 3 WHEN 0 THEN '2024-01-30' WHEN 1 THEN '2024-01-2' || CAST(u % 10 AS STRING) END AS last_backup,
    CAST(u % 6 AS INT) AS consecutive_errors, CAST(u % 9 AS INT) AS backlog_attempts FROM base)"""

_ITEM = """CASE WHEN u % 50 = 0 THEN 'no-path' ELSE 'old/' || CAST(u AS STRING) END AS relative_path, 'channel' AS type"""
_QUEUE = f"""queue AS (
    SELECT u * 10 AS ordinal, 'ch' || CAST(u AS STRING) AS entry_key, CAST(u AS STRING) AS channel_id, {_ITEM}, CAST(cur - 3 AS STRING) AS cursor_message_id,
        CASE WHEN u % 2 = 0 THEN CAST(top AS STRING) END AS target_hint_message_id, CAST(u % 50 AS INT) AS priority,
        CASE WHEN u % 5 = 0 THEN NULL ELSE 'daily_deferred' END AS reason,
        CASE WHEN u % 15 = 0 THEN NULL WHEN u % 4 = 0 THEN 'queued' WHEN u % 4 = 1 THEN 'caught_up' WHEN u % 4 = 2 THEN 'retry' ELSE 'catching_up' END AS status,
        (u % 30 <> 0) AS has_status, CAST(u % 9 AS INT) AS attempts, '2024-01-1' || CAST(u % 10 AS STRING) AS created_at, '2024-01-20' AS updated_at
    FROM base WHERE u % 3 = 0
    UNION ALL SELECT u * 10 + 1, 'ch' || CAST(u AS STRING), CAST(u AS STRING), {_ITEM}, CASE WHEN u % 18 = 0 THEN CAST(top AS STRING) ELSE CAST(cur - 1 AS STRING) END,
        CASE WHEN u % 4 = 1 THEN 'h' || CAST(u AS STRING) END, CAST(7 AS INT), 'live_probe_found_new_messages', CASE WHEN u % 27 = 0 THEN 'caught_up' ELSE 'queued' END,
        true, CAST(8 AS INT), CASE WHEN u % 27 = 9 THEN '' ELSE '2024-01-09' END, '2024-01-21' FROM base WHERE u % 9 = 0
    UNION ALL SELECT u * 10 + 2, 'ch' || CAST(u AS STRING), CAST(u AS STRING), {_ITEM}, CAST(cur AS STRING), 'third' || CAST(u AS STRING), CAST(3 AS INT), '', 'retry', true, CAST(2 AS INT), '2024-01-02', '2024-01-22' FROM base WHERE u % 36 = 0
    UNION ALL SELECT u * 10 + 3, 'gone' || CAST(u AS STRING), CAST(u AS STRING), {_ITEM}, CAST(cur AS STRING), NULL, CAST(5 AS INT), 'daily_deferred', CASE WHEN u % 2 = 0 THEN 'retired' ELSE 'queued' END, true, CAST(9 AS INT), '2024-01-03', '2024-01-23' FROM base WHERE u % 31 = 0
    UNION ALL SELECT u * 10 + 4, NULL, CAST(u AS STRING), {_ITEM}, CAST(cur AS STRING), NULL, CAST(5 AS INT), 'daily_deferred', 'queued', true, CAST(9 AS INT), '2024-01-03', '2024-01-24' FROM base WHERE u % 37 = 0)"""

_MESSAGES = """messages AS (SELECT CAST(user_id AS STRING) AS channel_id, CAST(event_id AS STRING) AS id, event_id AS id_num, ts,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 5 = 0 THEN props || ' see https://example.org/' || event_type || '?id=' || CAST(event_id AS STRING) || ' backup' WHEN event_id % 13 = 0 THEN 'Rapid fix of the online queue' ELSE props END AS content,
    CASE WHEN event_id % 3 = 0 THEN event_type END AS global_name, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE 'u' || CAST(user_id AS STRING) END AS username,
    CASE WHEN event_id % 5 = 1 THEN NULL ELSE CAST(user_id AS STRING) END AS author_id,
    CASE WHEN event_id % 6 = 0 THEN 'f' || CAST(event_id AS STRING) || '.txt' END AS filename, CASE WHEN event_id % 12 = 0 THEN 'https://files.example.org/' || CAST(event_id AS STRING) END AS file_url,
    (event_id % 6 IN (0, 1)) AS has_file FROM events)"""

#: Older copies of the ledger, as another process may have left them on disk.
_DISK = """disk AS (SELECT entry_key, type, channel_id, relative_path, CAST(try_cast(last_written_message_id AS BIGINT) + CASE WHEN try_cast(channel_id AS BIGINT) % 2 = 0 THEN 5 ELSE -5 END AS STRING) AS last_written_message_id,
    last_message_id, sync_status, backlog_reason, last_backup FROM entries WHERE try_cast(channel_id AS BIGINT) % 3 <> 1
    UNION ALL SELECT 'disk' || CAST(u AS STRING), 'channel', CAST(u AS STRING), 'disk/' || CAST(u AS STRING), CAST(cur AS STRING), CAST(cur AS STRING), 'healthy', NULL, NULL FROM base WHERE u % 21 = 0)"""

#: An inventory: renamed, new, repeated and invalid rows.
_INVENTORY = """inventory AS (SELECT u AS ordinal, CASE WHEN u % 4 = 3 THEN 'thread' ELSE 'channel' END AS kind,
    CASE WHEN u % 47 = 0 THEN NULL WHEN u % 5 = 0 THEN 'new' || CAST(u AS STRING) ELSE 'ch' || CAST(u AS STRING) END AS name, CAST(NULL AS STRING) AS channel_name,
    CASE WHEN u % 53 = 0 THEN '' WHEN u % 2 = 0 THEN CAST(u AS STRING) END AS id, CAST(u AS STRING) AS other_id, CASE WHEN u % 59 = 3 THEN NULL ELSE 'parent' END AS parent FROM base WHERE u % 2 = 0 OR u % 5 = 0 OR u % 4 = 3
    UNION ALL SELECT u + 1000000, 'channel', 'ch' || CAST(u AS STRING), NULL, 'again' || CAST(u AS STRING), NULL, NULL FROM base WHERE u % 10 = 2)"""

CTES = {"base": _BASE, "entries": _ENTRIES, "queue": _QUEUE, "messages": _MESSAGES, "disk": _DISK, "inventory": _INVENTORY}


def with_ctes(*names: str) -> str:
    """WITH and the named tables and what they need; a query or more tables may follow."""
    needed = ["base", *(["entries"] if "disk" in names or "entries" in names else []), *(x for x in names if x not in ("base", "entries"))]
    return "WITH " + ",\n".join(CTES[x] for x in dict.fromkeys(needed))


class Ledger:
    """The derived tables over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.events = spark, spark.read.parquet(f"{sf_dir}/events.parquet")

    def _table(self, name: str) -> DataFrame:
        return self.spark.sql(f"{with_ctes(name)} SELECT * FROM {name}".replace("FROM events", "FROM {events}"), events=self.events)

    # Ledger and queue, a row for each channel, are read many times by a query.

    @cached_property
    def entries(self) -> DataFrame:
        return cut(self._table("entries"))

    @cached_property
    def queue(self) -> DataFrame:
        return cut(self._table("queue"))

    @property
    def disk(self) -> DataFrame:
        return self._table("disk")

    @property
    def inventory(self) -> DataFrame:
        return self._table("inventory")

    @property
    def messages(self) -> DataFrame:
        m = self._table("messages")
        author = F.struct("global_name", "username", F.col("author_id").alias("id"))
        files = F.when(F.col("has_file"), F.array(F.struct("filename", F.col("file_url").alias("url"))))
        return m.select("channel_id", "id", "id_num", "ts", "content", author.alias("author"), files.alias("attachments"))
