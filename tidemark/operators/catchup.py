"""Budget-bounded catch-up: how far each selected entry gets, which messages it writes, and what it leaves.

The loop of reads has a closed form for a source that doesn't change meanwhile:
with R messages after the cursor, page size L, P pages an entry and M reads in
all, an entry's last read is short or empty, a short one is followed by a probe,
and what earlier entries used up is a running sum in selection order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cursors import id_number, truthy
from .audit import active_queue, messages_after
from .ledger import mark_queue
from .select import select_worker


@dataclass(frozen=True)
class Limits:
    """Entries a run, reads a run, page reads an entry, messages a page; all at least 1."""

    entries: int = 4
    reads: int = 12
    pages: int = 5
    page: int = 100


def _kept(df: DataFrame) -> DataFrame:
    """A few rows, at most one for each candidate, as a local table: no plan behind it and no files."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def with_channels(candidates: DataFrame, entries: DataFrame, limits: Limits) -> DataFrame:
    """rank, entry_key, cursor, cursor_num, channel_id, relative_path of the first `limits.entries` candidates, as a local table."""
    first = candidates.select("rank", "entry_key", F.coalesce(truthy("cursor"), F.lit("0")).alias("cursor")).orderBy("rank").limit(limits.entries)
    return _kept(first.withColumn("cursor_num", id_number("cursor")).join(entries.select("entry_key", "channel_id", "relative_path"), "entry_key"))


def of_channels(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of a few chosen channels after their cursors, by literals, which reach the scan; a table by channel (sources/messages.py) opens no other channel's files."""
    rows = [r for r in chosen.select("channel_id", "cursor_num").collect() if r.channel_id is not None]
    if not rows:
        return messages.where(F.lit(False))
    name = lambda r: "'" + r.channel_id.replace("\\", "\\\\").replace("'", "\\'") + "'"
    near = " OR ".join(sorted({f"channel_id = {name(r)} AND id_num > {r.cursor_num}" for r in rows}))
    return messages.where(f"channel_id IN ({', '.join(sorted({name(r) for r in rows}))}) AND id_num > {min(r.cursor_num for r in rows)} AND ({near})")


def after_cursors(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """Each chosen entry's messages after its cursor, with entry_key."""
    return messages_after(F.broadcast(chosen.select("entry_key", "channel_id", "cursor")), of_channels(chosen, messages)).drop("cursor")


def messages_behind(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """entry_key, behind: how many messages each chosen entry has after its cursor, all of them, each once however often the source repeats it; an entry without any gives no row.

    Ids are dealt out by entry and id, so a channel with very many messages is counted by all tasks.
    """
    return after_cursors(chosen, messages.select("channel_id", "id_num")).groupBy("entry_key").agg(F.count_distinct("id_num").alias("behind"))


def ranked_messages(chosen: DataFrame, messages: DataFrame, most: int) -> DataFrame:
    """The first `most` messages of each chosen entry after its cursor, numbered by id (rn), each once, however often the source repeats it.

    The constant bound limits the ranking in each task, so a channel with very many messages is no burden.
    """
    by = Window.partitionBy("entry_key").orderBy("id_num")
    return after_cursors(chosen, messages).withColumn("rn", F.dense_rank().over(by)).where(F.col("rn") <= most).dropDuplicates(["entry_key", "rn"])


def plan_rows(chosen: DataFrame, rows: DataFrame, limits: Limits, errors: DataFrame | None = None) -> DataFrame:
    """The plan for chosen entries, from their first pages * page + 1 messages (entry_key, rn, id): a few rows; behind is counted in those messages only."""
    size, pages, reads = F.lit(limits.page), F.lit(limits.pages), F.lit(limits.reads)
    # Of an entry's messages, the last one's id and those that end a page.
    ends = F.collect_list(F.when(F.col("rn") % size == 0, F.struct("rn", "id"))).alias("ends")
    counts = rows.groupBy("entry_key").agg(F.max("rn").alias("n"), F.max_by("id", "rn").alias("last"), ends)
    c = chosen.join(counts, "entry_key", "left").withColumn("behind", F.coalesce("n", F.lit(0)))
    c = c.withColumn("need", F.floor(F.col("behind") / size) + 1).withColumn("rest", F.col("behind") % size)
    if errors is not None:
        c = c.join(errors.select("entry_key", "ok_reads"), "entry_key", "left")
    else:
        c = c.withColumn("ok_reads", F.lit(None).cast("int"))
    wanted = F.least(F.col("need"), pages) + F.when((F.col("rest") > 0) & (F.col("need") <= pages), 1).otherwise(0)
    fails = F.col("ok_reads").isNotNull() & (F.col("ok_reads") < wanted)
    c = c.withColumn("fails", fails).withColumn("cost", F.when(fails, F.col("ok_reads")).otherwise(wanted))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # over at most limits.entries rows
    c = c.withColumn("left", F.greatest(F.lit(0), reads - F.coalesce(F.sum("cost").over(before), F.lit(0)))).where("left > 0")
    c = c.withColumn("batches", F.least(F.when(F.col("fails"), F.least("ok_reads", "need")).otherwise(F.least("need", pages)), F.col("left")))
    c = c.withColumn("reads", F.least("cost", "left")).withColumn("added", F.least(F.col("behind"), F.col("batches") * size))
    failed = F.col("fails") & (F.col("ok_reads") < F.col("left"))
    status = F.when(failed, "error").when(~F.col("fails") & (F.col("need") <= pages) & (F.col("cost") <= F.col("left")), "caught_up").otherwise("still_queued")
    c = c.withColumn("status", status)
    c = c.withColumn("reached", F.when(F.col("added") == F.col("n"), F.col("last")).otherwise(F.get(F.filter("ends", lambda x: x["rn"] == F.col("added")), F.lit(0))["id"]))
    return _kept(c.select(
        "rank", "entry_key", "relative_path", "cursor", F.col("behind").cast("bigint").alias("behind"), F.col("batches").cast("bigint").alias("batches"), F.col("reads").cast("bigint").alias("reads"),
        F.col("added").cast("bigint").alias("added"), "status", F.coalesce("reached", "cursor").alias("new_cursor"),
    ))


def plan_candidates(candidates: DataFrame, entries: DataFrame, messages: DataFrame, limits: Limits, errors: DataFrame | None = None) -> DataFrame:
    """What the run does with each candidate: rank, entry_key, relative_path, cursor, behind, batches, reads, added, status, new_cursor.

    candidates: rank, entry_key, cursor; the first `limits.entries` of them.
    Entries that the budget doesn't reach give no row.  errors: entry_key,
    ok_reads; after so many reads, the probe after a short page included, the
    next one fails.  The pages read until then count, the failed read doesn't.
    behind: all messages after the cursor, each once however often the source
    repeats it.  Nothing else in the plan depends on more than one message over what
    a run can read of an entry, so they are counted where behind is asked for only.
    """
    chosen = with_channels(candidates, entries, limits)
    rows = ranked_messages(chosen, messages.select("channel_id", "id", "id_num"), limits.pages * limits.page + 1)
    plan = plan_rows(chosen, rows, limits, errors)
    counted = plan.drop("behind").join(F.broadcast(messages_behind(chosen, messages)), "entry_key", "left")
    return counted.withColumn("behind", F.coalesce("behind", F.lit(0).cast("bigint"))).select(plan.columns)


def catchup_plan(entries: DataFrame, queue: DataFrame, messages: DataFrame, run_date: str, limits: Limits = Limits()) -> DataFrame:
    return plan_candidates(select_worker(entries, queue, run_date, limits.entries), entries, messages, limits)


def written_rows(plan: DataFrame, rows: DataFrame, limits: Limits) -> DataFrame:
    """The ranked messages that a plan writes, with relative_path and batch (the page, from 1)."""
    kept = rows.join(F.broadcast(plan.select("entry_key", "relative_path", "added")), "entry_key").where("rn <= added")
    return kept.withColumn("batch", F.ceil(F.col("rn") / limits.page)).drop("added")


def catchup_messages(plan: DataFrame, entries: DataFrame, messages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The messages that a plan writes: entry_key, relative_path and the message, with batch (its page, from 1) and rn."""
    chosen = with_channels(plan, entries, limits)
    return written_rows(plan, ranked_messages(chosen, messages, limits.pages * limits.page), limits)


def entries_after(entries: DataFrame, plan: DataFrame, run_date: str) -> DataFrame:
    """The ledger after the run: cursor, status, reason, dates and error counts of the planned entries."""
    p = F.broadcast(plan.select("entry_key", F.col("status").alias("p_status"), "new_cursor", "added"))
    both = entries.join(p, "entry_key", "left")
    hit, done, failed, wrote = F.col("p_status").isNotNull(), F.col("p_status") == "caught_up", F.col("p_status") == "error", F.col("added") > 0
    new = {
        "last_written_message_id": F.when(wrote, F.col("new_cursor")).otherwise(F.col("last_written_message_id")),
        "last_message_id": F.when(wrote, F.col("new_cursor")).otherwise(F.col("last_message_id")),
        "sync_status": F.when(done, "healthy").when(failed, "error").when(wrote, "partial").when(hit, "catching_up").otherwise(F.col("sync_status")),
        "has_sync_status": hit | F.col("has_sync_status"),
        "backlog_reason": F.when(done, None).when(wrote, F.coalesce(truthy("backlog_reason"), F.lit("page_limit_reached"))).otherwise(F.col("backlog_reason")),
        "last_backup": F.when(done, F.lit(run_date)).otherwise(F.col("last_backup")),
        "consecutive_errors": F.when(done, 0).when(failed, F.coalesce("consecutive_errors", F.lit(0)) + 1).otherwise(F.col("consecutive_errors")),
        "backlog_attempts": F.when(hit, F.coalesce("backlog_attempts", F.lit(0)) + 1).otherwise(F.col("backlog_attempts")),
    }
    return both.withColumns(new).select(entries.columns)


def queue_after(queue: DataFrame, plan: DataFrame, now: str) -> DataFrame:
    """The queue after the run: caught up items start over, others stay queued at their new cursor with one more attempt."""
    status = F.when(F.col("status") == "caught_up", "caught_up").when(F.col("status") == "error", "retry").otherwise("queued")
    marks = plan.select("entry_key", status.alias("m_status"), F.col("new_cursor").alias("m_cursor"), F.when(F.col("status") == "caught_up", 0).alias("m_attempts"))
    tried = queue.join(F.broadcast(plan.select("entry_key", F.lit(1).alias("tried"))), "entry_key", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)) + F.coalesce("tried", F.lit(0))).drop("tried")
    return mark_queue(tried, F.broadcast(marks), now)


def run_totals(plan: DataFrame) -> DataFrame:
    """processed, total_batches (probes included), added and caught_up of a run."""
    return plan.agg(
        F.count("*").alias("processed"), F.coalesce(F.sum("reads"), F.lit(0)).cast("bigint").alias("total_batches"), F.coalesce(F.sum("added"), F.lit(0)).cast("bigint").alias("added"),
        F.count_if(F.col("status") == "caught_up").alias("caught_up"),
    )


@dataclass(frozen=True)
class DailyLimits:
    """The daily pass: messages a page, pages an entry, entries written, entries checked, messages read."""

    page: int = 30
    pages: int = 2
    written: int = 4
    checked: int = 6
    messages: int = 180


def daily_sync_plan(entries: DataFrame, queue: DataFrame, messages: DataFrame, limits: DailyLimits = DailyLimits()) -> DataFrame:
    """The daily pass over healthy entries that aren't in the active queue, oldest check first.

    A second page is read only after a full first one.  An entry whose pages are
    all full is marked partial and queued; so is one that the message cap cuts
    short.  Entries beyond the caps give no row.  behind counts all messages after
    the cursor, repeated ones once.
    """
    healthy = F.when(F.col("has_sync_status"), F.coalesce(F.col("sync_status") == "healthy", F.lit(False))).otherwise(True)
    e = entries.where(healthy & truthy("backlog_reason").isNull()).withColumn("cursor", F.coalesce(truthy("last_written_message_id"), truthy("last_message_id"))).where("cursor is not null")
    e = e.join(active_queue(queue).select("entry_key").where("entry_key is not null"), "entry_key", "left_anti")
    order = [F.coalesce(truthy("last_backup"), F.lit("0000-00-00")), F.col("entry_key")]
    checked = e.orderBy(*order).limit(limits.checked)
    checked = checked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over at most limits.checked rows
    checked, most = _kept(checked.select("rank", "entry_key", "channel_id", "cursor", id_number("cursor").alias("cursor_num"))), limits.page * limits.pages
    c = checked.join(F.broadcast(messages_behind(checked, messages)), "entry_key", "left").withColumn("behind", F.coalesce("behind", F.lit(0).cast("bigint")))
    c = c.withColumn("want", F.least("behind", F.lit(most)))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("used", F.coalesce(F.sum("want").over(before), F.lit(0))).withColumn("wrote", F.coalesce(F.sum(F.when(F.col("want") > 0, 1).otherwise(0)).over(before), F.lit(0)))
    c = c.where((F.col("used") < limits.messages) & (F.col("wrote") < limits.written)).withColumn("added", F.least("want", limits.messages - F.col("used")).cast("bigint"))
    capped = (F.col("added") < F.col("behind")) | (F.col("added") == most)
    return c.select("rank", "entry_key", "cursor", "behind", "added", F.when(capped, "partial").otherwise("healthy").alias("status"), F.when(capped, "page_limit_reached").alias("reason"))
