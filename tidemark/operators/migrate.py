"""Migration of older ledgers: what each entry is, and its queue item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cursors import newest_cursor, or_default, truthy, written_cursor

#: Markers of an unfinished sync in any of five fields, and of a limit in the notes.
PARTIAL_MARKERS = ("partial", "deferred", "catching_up", "error", "queued", "部分完成", "增量部分完成", "剩餘交給 backlog", "達單輪上限")
LIMIT_MARKER = "上限"
NOTES = ("deferred_reason", "daily_sync_status", "daily_sync_note")
VERSION = 3


def _text(*fields: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(F.col(f), F.lit("")) for f in fields))


def is_partial() -> Column:
    text = F.lower(_text("sync_status", "backlog_reason", *NOTES))
    found = F.lit(False)
    for marker in PARTIAL_MARKERS:
        found = found | text.contains(marker.lower())
    return found


def reason_for() -> Column:
    """Why an entry is incomplete; null if it isn't.  Only the notes tell a page limit from a deferral."""
    note = _text(*NOTES)
    limit = note.contains(LIMIT_MARKER) | F.lower(note).contains("limit") | F.lower(note).contains("partial")
    return F.when(written_cursor().isNull(), "bootstrap_needed").when(is_partial(), F.when(limit, "page_limit_reached").otherwise("daily_deferred"))


def priority_for(reason: Column, hot_paths: tuple[str, ...] = ()) -> Column:
    """hot_paths: parts of paths whose entries are hot, besides those that say so."""
    base = F.when(reason.isNull(), 90).when(reason == "page_limit_reached", 10).when(reason == "daily_deferred", 20).when(reason == "bootstrap_needed", 60).otherwise(50)
    hot = F.coalesce(F.col("hot"), F.lit(False))
    for path in hot_paths:
        hot = hot | F.coalesce(F.col("relative_path"), F.lit("")).contains(path)
    return F.when(hot, F.greatest(F.lit(1), base - 5)).otherwise(base)


def migrate_classify(entries: DataFrame, hot_paths: tuple[str, ...] = ()) -> DataFrame:
    """The migrated entries, with class (bootstrap, partial, healthy), enqueue and priority.

    The cursor is mirrored to both fields.  A healthy entry keeps a left-over reason.
    """
    reason = F.col("__reason")
    out = entries.withColumn("__reason", reason_for()).withColumn("__cursor", written_cursor())
    status = F.when(reason == "bootstrap_needed", "queued").when(reason.isNotNull(), F.when(F.col("sync_status") == "queued", "queued").otherwise("partial")).otherwise(F.coalesce(truthy("sync_status"), F.lit("healthy")))
    out = out.withColumn("__status", status).withColumn("backlog_reason", F.coalesce("__reason", "backlog_reason")).withColumn("sync_status", F.col("__status"))
    out = out.withColumns({
        "has_sync_status": F.lit(True),
        "last_written_message_id": F.col("__cursor"),
        "last_message_id": F.col("__cursor"),
        "consecutive_errors": F.coalesce("consecutive_errors", F.lit(0)),
        "backlog_attempts": F.coalesce("backlog_attempts", F.lit(0)),
        "state_schema_version": F.lit(VERSION),
        "class": F.when(reason == "bootstrap_needed", "bootstrap").when(reason.isNotNull(), "partial").otherwise("healthy"),
        "enqueue": F.col("__status").isin("partial", "queued"),
        "priority": priority_for(F.coalesce(truthy("backlog_reason"), F.lit("daily_deferred")), hot_paths),
    })
    return out.drop("__reason", "__status", "__cursor")


def migrate_stats(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("entries"), *(F.count_if(F.col("class") == c).alias(c) for c in ("healthy", "partial", "bootstrap")), F.count_if("enqueue").alias("queued"),
    )


def migrate_queue_merge(queue: DataFrame, classified: DataFrame, now: str) -> DataFrame:
    """The queue with an item for each entry to enqueue.

    Of several items of an entry the last one stays; keyless items go.  The
    smaller priority wins (null and 0 count as 99), the newer cursor wins.
    """
    last = queue.where(truthy("entry_key").isNotNull()).groupBy("entry_key").agg(F.max_by(F.struct(*(c for c in queue.columns if c != "entry_key")), "ordinal").alias("o"))
    new = classified.where("enqueue").select(
        "entry_key", F.col("channel_id").alias("n_channel"), F.coalesce("relative_path", "entry_key").alias("n_path"), F.col("type").alias("n_type"), F.col("last_written_message_id").alias("n_cursor"),
        F.col("last_seen_message_id").alias("n_hint"), F.col("priority").alias("n_priority"), F.coalesce(truthy("backlog_reason"), F.lit("daily_deferred")).alias("n_reason"), F.col("backlog_attempts").alias("n_attempts"), F.lit(True).alias("hit"),
    )
    both = last.join(new, "entry_key", "full_outer")
    hit, old = F.coalesce("hit", F.lit(False)), F.col("o").isNotNull()
    take = lambda new, was: F.when(hit, F.col(new)).otherwise(F.col(f"o.{was}"))
    out = both.select(
        F.col("o.ordinal").alias("ordinal"),
        "entry_key",
        take("n_channel", "channel_id").alias("channel_id"),
        take("n_path", "relative_path").alias("relative_path"),
        take("n_type", "type").alias("type"),
        F.when(hit, newest_cursor("o.cursor_message_id", "n_cursor")).otherwise(F.col("o.cursor_message_id")).alias("cursor_message_id"),
        take("n_hint", "target_hint_message_id").alias("target_hint_message_id"),
        F.when(hit & old, F.least(or_default("o.priority", 99), F.col("n_priority"))).when(hit, F.col("n_priority")).otherwise(F.col("o.priority")).alias("priority"),
        F.when(hit, F.coalesce("n_reason", "o.reason")).otherwise(F.col("o.reason")).alias("reason"),
        F.when(hit & (~old | F.col("o.status").isNull() | F.col("o.status").isin("done", "caught_up")), "queued").otherwise(F.col("o.status")).alias("status"),
        F.when(old, F.col("o.attempts")).otherwise(F.col("n_attempts")).alias("attempts"),
        F.when(old, F.col("o.created_at")).otherwise(F.lit(now)).alias("created_at"),
        F.when(hit, F.lit(now)).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )
    return out


def queue_order() -> list[Column]:
    """The order in which a migrated queue is stored."""
    return [or_default("priority", 99), F.coalesce("created_at", F.lit("")), F.coalesce("relative_path", F.lit("")), F.col("ordinal").asc_nulls_last(), F.col("entry_key")]


def migrate_header(header: DataFrame, queue_path: str, schema: str) -> DataFrame:
    """The ledger's header row at the current version; a cursor policy that is there stays."""
    policy = {"source_of_truth": "last_written_message_id", "compat_field": "last_message_id", "complete_when": "message read after cursor returns 0", "never_advance_past_unwritten_raw": "true"}
    default = F.create_map(*(F.lit(x) for pair in policy.items() for x in pair))
    return header.withColumns({"version": F.greatest(F.coalesce("version", F.lit(0)), F.lit(VERSION)), "schema": F.lit(schema), "queue_path": F.lit(queue_path), "cursor_policy": F.coalesce("cursor_policy", default)})
