"""Which entries the next run works on: four tiers, the first one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cursors import ACTIVE, INCOMPLETE, INCOMPLETE_PREVIEW, durable_cursor, newest_cursor, or_default, parse_day, truthy, written_cursor
from ..plans.cut import cut
from .ledger import upsert_queue

#: The order of candidates; entries that are alike by all of its rules follow each other by key.
ORDER = ("tier", "k1", "k2", "k3", "ordinal", "entry_key")
CANDIDATE = ("entry_key", "tier", "cursor", "priority", "reason", "queue_status")


def _selectable(queue: DataFrame) -> DataFrame:
    """Active items; a missing status counts as queued here."""
    return queue.withColumn("q_status", F.when(F.col("has_status"), F.col("status")).otherwise("queued")).where(F.col("q_status").isin(*ACTIVE))


def _first_items(queue: DataFrame) -> DataFrame:
    """The item that an upsert of an entry would change."""
    return queue.where("entry_key is not null").groupBy("entry_key").agg(F.min_by(F.struct("cursor_message_id", "priority", "status"), "ordinal").alias("item"))


def _ranked(tiers: DataFrame, limit: int) -> DataFrame:
    """The first tier of each entry, in order, cut at the limit: a top-k, not a sort of all."""
    return _first_tier(tiers).orderBy(*ORDER).limit(limit)


def _first_tier(tiers: DataFrame) -> DataFrame:
    by_key = Window.partitionBy("entry_key").orderBy(*ORDER)
    return tiers.withColumn("n", F.row_number().over(by_key)).where("n = 1").drop("n")


def _row(tier: int, cursor: Column, priority: Column, reason: Column, queue_status: Column, k1: Column, k2: Column, k3: Column, ordinal: Column, *more: Column | str) -> list:
    return ["entry_key", F.lit(tier).alias("tier"), cursor.alias("cursor"), priority.cast("int").alias("priority"), reason.alias("reason"), queue_status.alias("queue_status"), k1.alias("k1"), k2.alias("k2"), k3.alias("k3"), ordinal.cast("bigint").alias("ordinal"), *more]


def worker_tiers(entries: DataFrame, queue: DataFrame, run_date: str) -> DataFrame:
    """All entries of the four tiers; an entry may be in several."""
    none = F.lit(None).cast("string")
    last = lambda default: F.coalesce(truthy("last_backup"), F.lit(default))
    items = _selectable(queue).select(F.col("entry_key").alias("k"), "cursor_message_id", F.col("priority").alias("q_priority"), F.col("reason").alias("q_reason"), "q_status", "created_at", F.col("relative_path").alias("q_path"), "ordinal")
    active = entries.join(items, F.col("entry_key") == F.col("k")).select(
        *_row(1, newest_cursor("cursor_message_id", "last_written_message_id", "last_message_id"), or_default("q_priority", 50), F.col("q_reason"), F.col("q_status"), F.format_string("%010d", or_default("q_priority", 50)), F.coalesce("created_at", F.lit("")), F.coalesce("q_path", F.lit("")), F.col("ordinal"))
    )
    e = entries.join(_first_items(queue), "entry_key", "left").withColumn("newest", durable_cursor())
    upserted = lambda p: F.when(F.col("item").isNull(), F.lit(p)).otherwise(F.least(or_default("item.priority", 99), F.lit(p)))
    cursor = newest_cursor("item.cursor_message_id", "newest")
    zero = F.lit(0)
    reason = truthy("backlog_reason")
    incomplete = e.where(F.col("sync_status").isin(*INCOMPLETE) | reason.isNotNull()).select(
        *_row(2, cursor, upserted(40), F.coalesce(reason, F.lit("state_partial")), F.lit("queued"), F.format_string("%010d", or_default(upserted(40), 50)), last("9999-99-99"), F.col("entry_key"), zero)
    )
    not_today = F.coalesce(F.col("last_backup") != run_date, F.lit(True))
    healthy = F.when(F.col("has_sync_status"), F.coalesce(F.col("sync_status") == "healthy", F.lit(False))).otherwise(True)
    stale = e.where(healthy & reason.isNull() & F.col("newest").isNotNull() & not_today).select(*_row(3, cursor, upserted(60), F.lit("healthy_stale_probe"), F.lit("queued"), last("0000-00-00"), F.col("entry_key"), F.lit(""), zero))
    bootstrap = e.where(F.col("newest").isNull() & truthy("channel_id").isNotNull() & not_today).select(
        *_row(4, F.coalesce(truthy("item.cursor_message_id"), F.lit("0")), upserted(90), F.lit("bootstrap_needed"), F.lit("queued"), last("0000-00-00"), F.col("entry_key"), F.lit(""), zero)
    )
    return active.unionByName(incomplete).unionByName(stale).unionByName(bootstrap).withColumn("none", none).drop("none")


def select_worker(entries: DataFrame, queue: DataFrame, run_date: str, limit: int = 4) -> DataFrame:
    """The worker's candidates in order (rank from 1), as they stand after their upsert; queue is normalised."""
    chosen = _ranked(worker_tiers(entries, queue, run_date), limit)
    order = Window.orderBy(*ORDER)  # over at most `limit` rows
    return chosen.withColumn("rank", F.row_number().over(order)).select("rank", *CANDIDATE)


def queue_after_selection(entries: DataFrame, queue: DataFrame, run_date: str, now: str, limit: int = 4) -> DataFrame:
    """The queue as selection leaves it.

    If active items alone fill the limit nothing changes.  Else every incomplete
    entry is upserted, also beyond the limit, and the chosen ones of the other
    tiers.
    """
    tiers = worker_tiers(entries, queue, run_date)
    tiers = cut(tiers)  # a few rows for each entry, used four times
    chosen = _ranked(tiers, limit)
    full = chosen.agg(F.coalesce(F.count_if(F.col("tier") == 1) >= limit, F.lit(False)).alias("full"))
    seen = tiers.where("tier = 1").select("entry_key").distinct()
    second = tiers.where("tier = 2").join(seen, "entry_key", "left_anti").select("entry_key", "tier")
    changes = second.unionByName(chosen.where("tier > 2").select("entry_key", "tier")).join(F.broadcast(full)).where("not full").drop("full")  # one row
    detail = entries.select("entry_key", truthy("backlog_reason").alias("own"))
    priority = F.element_at(F.create_map(F.lit(2), F.lit(40), F.lit(3), F.lit(60), F.lit(4), F.lit(90)), F.col("tier"))
    reason = F.when(F.col("tier") == 2, F.coalesce("own", F.lit("state_partial"))).when(F.col("tier") == 3, "healthy_stale_probe").otherwise("bootstrap_needed")
    changes = changes.join(detail, "entry_key").select("entry_key", F.lit("queued").alias("status"), reason.alias("reason"), priority.alias("priority"), "tier")
    after = upsert_queue(queue, entries, changes, now)
    fourth = changes.where("tier = 4").select("entry_key", F.lit(True).alias("zero"))
    return after.join(fourth, "entry_key", "left").withColumn("cursor_message_id", F.when(F.col("zero"), F.coalesce(truthy("cursor_message_id"), F.lit("0"))).otherwise(F.col("cursor_message_id"))).drop("zero")


def preview_tiers(entries: DataFrame, queue: DataFrame, run_date: str, stale_days: int = 2) -> DataFrame:
    """Each entry's tier in the preview, with the keys of its order; no order and no limit."""
    e = entries.withColumn("written", written_cursor()).withColumn("path", F.coalesce("relative_path", "entry_key"))
    items = _selectable(queue).where(truthy("entry_key").isNotNull()).select(F.col("entry_key").alias("k"), F.col("priority").alias("q_priority"), F.col("reason").alias("q_reason"), "q_status", "created_at", F.col("relative_path").alias("q_path"), "ordinal")
    none, zero, path = F.lit(None).cast("string"), F.lit(0), F.coalesce("path", F.lit(""))
    reason = truthy("backlog_reason")
    active = e.join(items, F.col("entry_key") == F.col("k")).select(
        *_row(1, F.col("written"), or_default("q_priority", 50), F.coalesce(truthy("q_reason"), reason, F.lit("queued")), F.col("q_status"), F.format_string("%010d", or_default("q_priority", 50)), F.coalesce("created_at", F.lit("")), F.coalesce("q_path", F.lit("")), F.col("ordinal"))
    )
    partial = e.where(F.col("sync_status").isin(*INCOMPLETE_PREVIEW) | reason.isNotNull()).select(*_row(2, F.col("written"), F.lit(40), F.coalesce(reason, F.lit("state_partial")), none, F.lit(""), F.coalesce(truthy("last_backup"), F.lit("9999-99-99")), path, zero))
    day = parse_day("last_backup")
    stale = e.where(F.col("written").isNotNull() & (day.isNull() | (day <= F.date_sub(F.lit(run_date).cast("date"), stale_days)))).select(
        *_row(3, F.col("written"), F.lit(70), F.lit("stale_incremental"), none, F.coalesce(day.cast("string"), F.lit("0000-00-00")), path, F.lit(""), zero)
    )
    bootstrap = e.where("written is null").select(*_row(4, F.col("written"), F.lit(90), F.lit("bootstrap_needed"), none, path, F.lit(""), F.lit(""), zero))
    return _first_tier(active.unionByName(partial).unionByName(stale).unionByName(bootstrap))


def select_preview(entries: DataFrame, queue: DataFrame, run_date: str, limit: int = 4, stale_days: int = 2) -> DataFrame:
    """The read-only preview, which has rules of its own: no upserts, constant priorities, stale by age and whatever the status."""
    e = entries.withColumn("path", F.coalesce("relative_path", "entry_key"))
    chosen = preview_tiers(entries, queue, run_date, stale_days).orderBy(*ORDER).limit(limit)
    order = Window.orderBy(*ORDER)  # over at most `limit` rows
    payload = e.select("entry_key", "type", "channel_id", F.col("path").alias("relative_path"), "last_backup", "sync_status", "backlog_reason")
    return chosen.withColumn("rank", F.row_number().over(order)).join(payload, "entry_key").select("rank", *CANDIDATE, "type", "channel_id", "relative_path", "last_backup", "sync_status", "backlog_reason")
