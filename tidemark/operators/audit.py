"""Audit and reconciliation: what proves, or disproves, that channels are caught up.

A channel is caught up only when a read after its cursor returns nothing; its
last-checked date never proves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cursors import ACTIVE, durable_cursor, id_number, newest_cursor, or_default, truthy, written_cursor
from ..plans.schemas import ENTRY_STATUSES, QUEUE_STATUSES, REASONS


def with_cursor(entries: DataFrame) -> DataFrame:
    return entries.withColumn("cursor", written_cursor())


def null_cursor(entries: DataFrame) -> DataFrame:
    return with_cursor(entries).where("cursor is null").select("entry_key")


def cursor_mismatch(entries: DataFrame) -> DataFrame:
    """Entries whose two cursors are set and differ as strings."""
    a, b = truthy("last_written_message_id"), truthy("last_message_id")
    return entries.where(a.isNotNull() & b.isNotNull() & (a != b)).select("entry_key", "last_written_message_id", "last_message_id")


def not_healthy(entries: DataFrame) -> DataFrame:
    """Entries with a cursor whose status isn't healthy (null is) or that have a reason."""
    odd = (F.col("sync_status").isNotNull() & (F.col("sync_status") != "healthy")) | truthy("backlog_reason").isNotNull()
    return with_cursor(entries).where(F.col("cursor").isNotNull() & odd).select("entry_key", "sync_status", "backlog_reason")


def messages_after(entries: DataFrame, messages: DataFrame, cursor: str = "cursor") -> DataFrame:
    """Each entry's messages with an id above its cursor: an equi join on the channel with the range as residual."""
    e = entries.select("entry_key", F.col("channel_id").alias("of_channel"), F.col(cursor).alias("cursor"), id_number(cursor).alias("cursor_num"))
    return messages.join(e, (F.col("channel_id") == F.col("of_channel")) & (F.col("id_num") > F.col("cursor_num"))).drop("of_channel", "cursor_num")


def live_new_after_cursor(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """The first message after each entry's cursor; entries that are caught up give no row.

    Minima combine in each task, so a channel with very many messages is no burden.
    """
    probed = with_cursor(entries).where("cursor is not null")
    first = messages_after(probed, messages.select("channel_id", "id", "id_num", "ts")).groupBy("entry_key", "cursor").agg(F.min_by(F.struct("id", "ts"), "id_num").alias("m"))
    return first.select("entry_key", "cursor", F.col("m.id").alias("next_id"), F.col("m.ts").alias("next_ts"))


def active_queue(queue: DataFrame) -> DataFrame:
    """Items that count as active: a missing status doesn't."""
    return queue.where(F.col("status").isin(*ACTIVE))


def active_queue_count(queue: DataFrame) -> DataFrame:
    return active_queue(queue).agg(F.count("*").alias("active"))


def audit_counts(entries: DataFrame, queue: DataFrame) -> DataFrame:
    """entries, probed (those with a cursor; errors count) and active queue items."""
    counts = with_cursor(entries).agg(F.count("*").alias("entries"), F.count("cursor").alias("probed"))
    return counts.crossJoin(active_queue_count(queue).withColumnRenamed("active", "active_queue"))  # one row each


def audit_report(entries: DataFrame, messages: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The audit's lists in long form: category, entry_key, detail.  errors: entry_key, error of reads that failed."""
    new = live_new_after_cursor(entries, messages)
    parts = [
        null_cursor(entries).select(F.lit("nullCursor").alias("category"), "entry_key", F.lit(None).cast("string").alias("detail")),
        cursor_mismatch(with_cursor(entries).where("cursor is not null")).select(F.lit("cursorMismatch"), "entry_key", F.concat_ws("|", "last_written_message_id", "last_message_id")),
        not_healthy(entries).select(F.lit("notHealthy"), "entry_key", F.concat(F.coalesce("sync_status", F.lit("")), F.lit("|"), F.coalesce("backlog_reason", F.lit("")))),
    ]
    if errors is not None:
        new = new.join(errors.select("entry_key"), "entry_key", "left_anti")
        parts.append(with_cursor(entries).where("cursor is not null").join(errors, "entry_key").select(F.lit("errors"), "entry_key", "error"))
    parts.append(new.select(F.lit("liveNewAfterCursor"), "entry_key", "next_id"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def audit_clean(entries: DataFrame, queue: DataFrame, messages: DataFrame) -> DataFrame:
    """Whether all lists are empty and no item is active."""
    found = audit_report(entries, messages).agg(F.count("*").alias("findings"))
    return found.crossJoin(active_queue_count(queue)).select("findings", F.col("active").alias("active_queue"), ((F.col("findings") == 0) & (F.col("active") == 0)).alias("clean"))  # one row each


def partial_missing_from_queue(entries: DataFrame, queue: DataFrame) -> DataFrame:
    """Partial or queued entries without an active item."""
    keys = active_queue(queue).select("entry_key").where("entry_key is not null")
    return entries.where(F.col("sync_status").isin("partial", "queued")).join(keys, "entry_key", "left_anti").select("entry_key", "sync_status")


def false_healthy(entries: DataFrame, messages: DataFrame, run_date: str) -> DataFrame:
    """Entries that call themselves healthy and checked on the run date, with messages after their cursor."""
    healthy = F.coalesce(F.col("sync_status"), F.lit("healthy")) == "healthy"
    checked = entries.where(healthy & (F.col("last_backup") == run_date)).select("entry_key")
    return live_new_after_cursor(entries, messages).join(checked, "entry_key", "left_semi")


def raw_positions(entries: DataFrame, archive: DataFrame) -> DataFrame:
    """Each entry's newest cursor and the largest id in its raw archive (relative_path, id_num); 0 if there is none."""
    top = archive.groupBy("relative_path").agg(F.max("id_num").alias("raw_num"))
    cursors = entries.select("entry_key", "relative_path", durable_cursor().alias("cursor")).withColumn("cursor_num", id_number("cursor"))
    return cursors.join(top, "relative_path", "left").select("entry_key", "cursor", "cursor_num", F.coalesce("raw_num", F.lit(0)).alias("raw_num"))


def cursor_ahead_of_raw(entries: DataFrame, archive: DataFrame) -> DataFrame:
    """Unsafe: the cursor is past what was written."""
    return raw_positions(entries, archive).where("cursor_num > raw_num")


def cursor_behind_raw(entries: DataFrame, archive: DataFrame) -> DataFrame:
    """The next run would append messages again."""
    return raw_positions(entries, archive).where("cursor_num < raw_num")


def path_collision(entries: DataFrame) -> DataFrame:
    """Paths that several channels share."""
    return entries.groupBy("relative_path").agg(F.count_distinct("channel_id").alias("channels")).where("channels > 1")


def channel_rename(entries: DataFrame) -> DataFrame:
    """Channels with several paths."""
    return entries.where("channel_id is not null").groupBy("channel_id").agg(F.count_distinct("relative_path").alias("paths")).where("paths > 1")


def audit_warnings(entries: DataFrame, queue: DataFrame, most_attempts: int = 5, most_errors: int = 3) -> DataFrame:
    """Active items tried too often, and entries with too many errors in a row: entry_key, kind, n, status."""
    items = active_queue(queue).where(or_default("attempts", 0) > most_attempts).select("entry_key", F.lit("attempts").alias("kind"), or_default("attempts", 0).alias("n"), "status")
    failing = entries.where(or_default("consecutive_errors", 0) > most_errors).select("entry_key", F.lit("consecutiveErrors").alias("kind"), or_default("consecutive_errors", 0).alias("n"), F.col("sync_status").alias("status"))
    return items.unionByName(failing)


def status_enum_violations(entries: DataFrame, queue: DataFrame) -> DataFrame:
    """Statuses and reasons outside the documented values: entry_key, field, value."""
    e = lambda field, known: entries.where(truthy(field).isNotNull() & ~F.col(field).isin(*known)).select("entry_key", F.lit(f"entry.{field}").alias("field"), F.col(field).alias("value"))
    q = lambda field, known: queue.where(truthy(field).isNotNull() & ~F.col(field).isin(*known)).select("entry_key", F.lit(f"queue.{field}").alias("field"), F.col(field).alias("value"))
    return e("sync_status", ENTRY_STATUSES).unionByName(e("backlog_reason", REASONS)).unionByName(q("status", QUEUE_STATUSES)).unionByName(q("reason", REASONS))


def unreachable_entries(entries: DataFrame, queue: DataFrame) -> DataFrame:
    """Entries that no tier of the worker's selection reaches on any day: a cursor, no reason, a status that is neither incomplete nor healthy, no active item."""
    status = F.when(F.col("has_sync_status"), F.coalesce("sync_status", F.lit("null"))).otherwise("healthy")
    odd = entries.where(durable_cursor().isNotNull() & truthy("backlog_reason").isNull() & ~status.isin("healthy", "partial", "queued", "catching_up", "error"))
    selectable = queue.where(F.when(F.col("has_status"), F.col("status")).otherwise("queued").isin(*ACTIVE) & F.col("entry_key").isNotNull()).select("entry_key")
    return odd.join(selectable, "entry_key", "left_anti").select("entry_key", "sync_status")


def audit_requeue(queue: DataFrame, entries: DataFrame, live_new: DataFrame, now: str) -> DataFrame:
    """The queue after live findings are put back in it.

    Of an entry's items the last one is the target; its priority and attempts
    stay, its cursor only ever rises.  Entries without an item get one of
    priority 25, after all others.
    """
    found = live_new.join(entries.select("entry_key", "channel_id", F.coalesce("relative_path", "entry_key").alias("relative_path"), "type"), "entry_key").select(
        F.col("entry_key").alias("k"), F.col("channel_id").alias("n_channel"), F.col("relative_path").alias("n_path"), F.col("type").alias("n_type"), F.col("cursor").alias("n_cursor"), "next_id"
    )
    last = queue.where("entry_key is not null").groupBy("entry_key").agg(F.max("ordinal").alias("ordinal"))
    both = queue.join(last.withColumn("target", F.lit(True)), ["entry_key", "ordinal"], "left").join(found, (F.col("entry_key") == F.col("k")) & F.col("target"), "full_outer")
    hit, new = F.col("k").isNotNull(), F.col("ordinal").isNull()
    pick = lambda old, value: F.when(hit, value).otherwise(F.col(old)).alias(old)
    fresh = lambda old, value: F.when(new, value).otherwise(F.col(old)).alias(old)
    return both.select(
        "ordinal",
        F.coalesce("entry_key", "k").alias("entry_key"),
        fresh("channel_id", F.col("n_channel")),
        fresh("relative_path", F.col("n_path")),
        fresh("type", F.col("n_type")),
        pick("cursor_message_id", newest_cursor("cursor_message_id", "n_cursor")),
        pick("target_hint_message_id", F.col("next_id")),
        fresh("priority", F.lit(25)),
        pick("reason", F.lit("live_probe_found_new_messages")),
        pick("status", F.lit("queued")),
        F.when(hit, True).otherwise(F.col("has_status")).alias("has_status"),
        fresh("attempts", F.lit(0)),
        fresh("created_at", F.lit(now)),
        pick("updated_at", F.lit(now)),
    )
