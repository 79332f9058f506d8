"""The ledger and its queue: folding duplicates, upserts and merges, all monotonic in the cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cursors import ACTIVE, durable_cursor, id_number, newest_cursor, or_default, truthy

QUEUE_COLUMNS = ("ordinal", "entry_key", "channel_id", "relative_path", "type", "cursor_message_id", "target_hint_message_id", "priority", "reason", "status", "has_status", "attempts", "created_at", "updated_at")


def queue_orphans(queue: DataFrame, entries: DataFrame) -> DataFrame:
    """Items whose entry no longer exists."""
    return queue.where("entry_key is not null and entry_key <> ''").join(entries.select("entry_key"), "entry_key", "left_anti")


def _entry_side(entries: DataFrame) -> DataFrame:
    return entries.select(
        F.col("entry_key").alias("k"), F.col("channel_id").alias("e_channel"), F.coalesce("relative_path", "entry_key").alias("e_path"), F.col("type").alias("e_type"), durable_cursor().alias("e_cursor"),
        F.col("last_seen_message_id").alias("e_seen"), truthy("backlog_reason").alias("e_reason"),
    )


def normalize_queue(queue: DataFrame, entries: DataFrame, now: str) -> DataFrame:
    """One item for each entry, orphans retired; keyless items and orphans pass through.

    Every item's cursor first rises to its entry's.  Then the items of an entry
    are folded in list order: the larger cursor wins; on a tie a caught-up item
    beats any other, else the smaller priority wins, else the earlier item.  The
    survivor takes the most attempts, the earliest creation, and its own target
    hint or the one gathered so far.  That hint depends on the order of the fold,
    which is why it is one: an entry's few items meet in one row.
    position: passed-through items come first, then merged ones, each in order.
    """
    joined = queue.join(_entry_side(entries), F.col("entry_key") == F.col("k"), "left")
    keyed = truthy("entry_key").isNotNull()
    orphan = keyed & F.col("k").isNull()
    passing = joined.where(~keyed | orphan).select(
        *(c for c in QUEUE_COLUMNS if c not in ("status", "has_status", "updated_at")),
        F.when(orphan, F.lit("retired")).otherwise(F.col("status")).alias("status"),
        F.when(orphan, F.lit(True)).otherwise(F.col("has_status")).alias("has_status"),
        F.when(orphan & (F.coalesce("status", F.lit("")) != "retired"), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.lit(0).alias("group"),
    )
    kept = joined.where(keyed & F.col("k").isNotNull()).withColumn("cursor_message_id", newest_cursor("cursor_message_id", "e_cursor"))
    item = F.struct(
        "ordinal", "cursor_message_id", id_number("cursor_message_id").alias("num"), F.col("target_hint_message_id").alias("hint"), "priority", "reason", "status", "has_status",
        or_default("attempts", 0).alias("attempts"), "created_at", "updated_at", F.col("ordinal").alias("first"),
    )
    same = ("ordinal", "num", "priority", "reason", "status", "has_status")

    def fold(a: Column, x: Column) -> Column:
        done, was = F.coalesce(x["status"], F.lit("")) == "caught_up", F.coalesce(a["status"], F.lit("")) == "caught_up"
        replaces = F.when(x["num"] != a["num"], x["num"] > a["num"]).when(done != was, done).otherwise(or_default(x["priority"], 50) < or_default(a["priority"], 50))
        own, other = (lambda f: F.when(replaces, x[f]).otherwise(a[f])), (lambda f: F.when(replaces, a[f]).otherwise(x[f]))
        mine, theirs = truthy(own("created_at")), truthy(other("created_at"))
        made = F.when(mine.isNull() | (theirs.isNotNull() & (theirs < mine)), other("created_at")).otherwise(own("created_at"))
        return F.struct(
            own("ordinal").alias("ordinal"), newest_cursor(own("cursor_message_id"), other("cursor_message_id")).alias("cursor_message_id"), own("num").alias("num"),
            F.coalesce(truthy(own("hint")), other("hint")).alias("hint"), *(own(f).alias(f) for f in same[2:]),
            F.greatest(x["attempts"], a["attempts"]).alias("attempts"), made.alias("created_at"), F.lit(now).alias("updated_at"), a["first"].alias("first"),
        )

    sorted_items = kept.groupBy("entry_key", "e_channel", "e_path", "e_type").agg(F.array_sort(F.collect_list(item)).alias("items"))
    merged = sorted_items.withColumn("m", F.aggregate(F.slice("items", F.lit(2), F.size("items")), F.get("items", F.lit(0)), fold)).select(
        F.col("m.first").alias("ordinal"), "entry_key", F.col("e_channel").alias("channel_id"), F.col("e_path").alias("relative_path"), F.col("e_type").alias("type"), "m.cursor_message_id",
        F.col("m.hint").alias("target_hint_message_id"), "m.priority", "m.reason", "m.status", "m.has_status", "m.attempts", "m.created_at", "m.updated_at", F.lit(1).alias("group"),
    )
    return passing.unionByName(merged)


def upsert_queue(queue: DataFrame, entries: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """The queue after an upsert for each row of changes (entry_key, status, reason, priority; the last two may be null).

    An entry's first item is its target.  Reactivating a caught-up item starts its
    attempts anew; cursors only rise; priorities are never downgraded.  Entries
    without an item get one (ordinal null: it comes last).  Rows of changes for
    unknown entries have no effect.
    """
    wanted = changes.select(F.col("entry_key").alias("k"), F.col("status").alias("n_status"), truthy("reason").alias("n_reason"), F.col("priority").cast("int").alias("n_priority")).join(_entry_side(entries), "k")
    first = queue.where("entry_key is not null").groupBy("entry_key").agg(F.min("ordinal").alias("ordinal"))
    both = queue.join(first.withColumn("target", F.lit(True)), ["entry_key", "ordinal"], "left").join(wanted, (F.col("entry_key") == F.col("k")) & F.col("target"), "full_outer")
    hit, new = F.col("k").isNotNull(), F.col("ordinal").isNull()
    pick = lambda old, value: F.when(hit, value).otherwise(F.col(old)).alias(old)
    restarts = (F.col("status") == "caught_up") & F.col("n_status").isin(*ACTIVE)
    priority = F.when(F.col("n_priority").isNull(), F.coalesce("priority", F.lit(50))).when(new, F.col("n_priority")).otherwise(F.least(or_default("priority", 99), F.col("n_priority")))
    return both.select(
        "ordinal",
        F.coalesce("entry_key", "k").alias("entry_key"),
        pick("channel_id", F.col("e_channel")),
        pick("relative_path", F.col("e_path")),
        pick("type", F.col("e_type")),
        pick("cursor_message_id", newest_cursor("cursor_message_id", "e_cursor")),
        pick("target_hint_message_id", F.coalesce(truthy("e_seen"), "target_hint_message_id")),
        pick("priority", priority),
        pick("reason", F.coalesce("n_reason", truthy("reason"), "e_reason", F.lit("state_partial"))),
        pick("status", F.col("n_status")),
        F.when(hit, True).otherwise(F.col("has_status")).alias("has_status"),
        F.when(new | (hit & restarts), 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(new, F.lit(now)).otherwise(F.col("created_at")).alias("created_at"),
        pick("updated_at", F.lit(now)),
    )


def mark_queue(queue: DataFrame, marks: DataFrame, now: str) -> DataFrame:
    """Sets status, cursor and attempts (null: as before) on all items of the entries in marks (entry_key, m_status, m_cursor, m_attempts)."""
    both = queue.join(marks, "entry_key", "left")
    hit = F.col("m_status").isNotNull()
    changed = {"status": F.coalesce("m_status", "status"), "has_status": hit | F.col("has_status"), "cursor_message_id": F.coalesce("m_cursor", "cursor_message_id"), "attempts": F.coalesce("m_attempts", "attempts"), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    return both.withColumns(changed).select(*QUEUE_COLUMNS)


def merge_state(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Entries in memory with what is on disk: the two cursors take the newer value, all else is memory's; entries only on disk stay."""
    cursors = ("last_written_message_id", "last_message_id")
    shared = [c for c in memory.columns if c in disk.columns and c != "entry_key"]
    right = disk.select("entry_key", *(F.col(c).alias(f"d_{c}") for c in shared), F.lit(True).alias("on_disk"))
    both = memory.withColumn("in_memory", F.lit(True)).join(right, "entry_key", "full_outer")
    mine = F.col("in_memory").isNotNull()
    out = []
    for c in memory.columns:
        if c == "entry_key" or c not in shared:
            out.append(F.col(c))
        elif c in cursors:
            out.append(F.when(mine, F.coalesce(newest_cursor(c, f"d_{c}"), c)).otherwise(F.col(f"d_{c}")).alias(c))
        else:
            out.append(F.when(mine, F.col(c)).otherwise(F.col(f"d_{c}")).alias(c))
    return both.select(*out)
