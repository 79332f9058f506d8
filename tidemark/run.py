"""Whole runs over a root folder: catch-up, audit, migration and discovery, each under the lock and committed by snapshot.

A root holds the snapshots `ledger` and `queue` and the `archive`.
"""

from __future__ import annotations

import contextlib
import json
import os
import subprocess
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import audit, catchup, discover, ledger, migrate, select
from .plans.cut import cut
from .plans.places import with_places
from .plans.schemas import QUEUE
from .sources import live
from .sources.archive import Archive, unwritten
from .sources.snapshots import TRIES, MissingSnapshot, Moved, Snapshots, lock

#: Characters of the hook's output that are kept.
OUTPUT = 4000


def tables(spark: SparkSession, root: str) -> tuple[Snapshots, Snapshots]:
    return Snapshots(spark, f"{root}/ledger"), Snapshots(spark, f"{root}/queue")


def numbered(queue: DataFrame) -> DataFrame:
    """New items (without a place) after all others, by entry."""
    top = queue.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("top"))  # one row
    new = with_places(queue.where("ordinal is null"), [F.col("entry_key")], "ordinal").crossJoin(F.broadcast(top))
    return queue.where("ordinal is not null").unionByName(new.withColumn("ordinal", F.col("top") + 1 + F.col("ordinal")).drop("top"))


def ordered(queue: DataFrame) -> DataFrame:
    """A migrated queue with its places from 0, instead of those it came with."""
    names = queue.columns
    placed = with_places(queue, migrate.queue_order(), "__place")
    return placed.withColumn("ordinal", F.col("__place")).select(names)


def after_run(spark: SparkSession, config: dict, dry_run: bool = False) -> DataFrame:
    """The hook that tells an external index of new messages: one row with status, code, output and manifest.

    config: enabled, folder, command, manifest (a JSON file that the command
    leaves, relative to the folder) and timeout in seconds.  Without enabled
    nothing runs (status skipped); a dry run says what would (planned).  The
    command runs on the driver, in its folder; of its output the last characters
    are kept (OUTPUT).  A manifest that can't be read is null.
    """
    status, code, output, manifest = "skipped", None, None, None
    if config.get("enabled"):
        folder = os.path.abspath(config["folder"])
        if dry_run:
            status, output = "planned", f"{config['command']} in {folder}"
        else:
            done = subprocess.run(config["command"], shell=True, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, errors="replace", timeout=config.get("timeout"))
            status, code, output = "ok" if done.returncode == 0 else "failed", done.returncode, done.stdout[-OUTPUT:]
            with contextlib.suppress(OSError, ValueError):
                with open(os.path.join(folder, config.get("manifest", "manifest.json")), encoding="utf-8") as f:
                    manifest = json.dumps(json.load(f), ensure_ascii=False, sort_keys=True)
    return spark.createDataFrame([(status, code, output, manifest)], "status string, code int, output string, manifest string")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A run's report as JSON lines: each table of it in a folder of its name, all else in one line in `summary`; what was there is replaced.

    Tables are written by the tasks that have them; nothing comes to the driver.
    """
    tables = {k: x for k, x in report.items() if isinstance(x, DataFrame)}
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    rest = json.dumps({"ok": True} | {k: x for k, x in report.items() if k not in tables}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(rest,)], "value string").write.mode("overwrite").text(f"{path}/summary")


def read_report(spark: SparkSession, path: str, name: str = "summary") -> DataFrame:
    return spark.read.json(f"{path}/{name}")


def catch_up(spark: SparkSession, root: str, messages: DataFrame, run_date: str, now: str, limits: catchup.Limits = catchup.Limits(), dry_run: bool = False) -> dict:
    """One catch-up run; without a ledger it fails before it takes the lock.

    Ledger and queue are read under the lock.  The run's messages are read from
    their source once, at most a bounded number of each entry, and go to the
    archive as a batch with an id of its own, whatever `now` is; it counts from
    the commit that moves the cursors past it.  So a run that ends anywhere has
    either written messages and moved cursors, or neither.  If a stream commits
    meanwhile, the run is made anew from what that left.  A dry run changes
    nothing and reports what it would do.
    """
    return _catch_up(spark, root, lambda chosen: (catchup.ranked_messages(chosen, messages, limits.pages * limits.page + 1), None), run_date, now, limits, dry_run)


def catch_up_live(spark: SparkSession, root: str, options: dict[str, str], run_date: str, now: str, limits: catchup.Limits = catchup.Limits(), dry_run: bool = False) -> dict:
    """A catch-up run from the paged API (options as of live.read_after): one task an entry reads its pages.

    A read that fails makes its entry an error; pages read before it count.
    What an entry's pages end with is read only if the run's budget of reads
    would let it, as if entries came one after the other; up to `limits.pages`
    pages and a probe are asked for of each all the same.
    """

    def read(chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = cut(live.read_after(chosen.select("entry_key", "channel_id", "cursor"), options, limits.page, limits.pages, tasks=limits.entries))
        rows = live.as_messages(found, keep=["entry_key"])
        ranks = Window.partitionBy("entry_key").orderBy("id_num")  # at most pages * page + 1 messages of an entry
        return rows.withColumn("rn", F.dense_rank().over(ranks)).dropDuplicates(["entry_key", "rn"]), live.errors_of(found)

    return _catch_up(spark, root, read, run_date, now, limits, dry_run)


def _catch_up(spark: SparkSession, root: str, read: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]], run_date: str, now: str, limits: catchup.Limits, dry_run: bool) -> dict:
    """read: the first messages of the chosen entries, ranked, and what reads failed."""
    state, work = tables(spark, root)
    if state.current() is None:
        raise MissingSnapshot(f"no snapshot under {state.root}")
    archive = Archive(spark, f"{root}/archive")
    with lock(spark, root):
        archive.settle()
        for _ in range(TRIES):
            entries = state.load()
            queue = cut(ledger.normalize_queue(work.load(spark.createDataFrame([], QUEUE)), entries, now).drop("group"))
            candidates = select.select_worker(entries, queue, run_date, limits.entries)
            if dry_run:
                return {"dry_run": True, "candidates": candidates}
            selected = cut(select.queue_after_selection(entries, queue, run_date, now, limits.entries))
            chosen = catchup.with_channels(candidates, entries, limits)
            rows, errors = read(chosen)
            rows = cut(rows)  # at most limits.entries * (limits.pages * limits.page + 1) of them
            plan = catchup.plan_rows(chosen, rows, limits, errors)
            written, batch = catchup.written_rows(plan, rows, limits), None
            if not written.isEmpty():
                batch = uuid.uuid4().hex
                archive.write(unwritten(archive, written) if state.recovered else written, batch, now)
                archive.announce(batch, state, state.at + 1)
            try:
                # The ledger first: a queue that lags behind is raised to it by the next normalisation.
                state.save(catchup.entries_after(entries, plan, run_date), expected=state.at, batch=batch)
            except Moved:
                if batch:
                    archive.drop(batch)
                continue
            if batch:
                archive.confirm(batch)
            work.save(numbered(catchup.queue_after(selected, plan, now)))
            left = work.load()
            return {"totals": catchup.run_totals(plan), "entries": plan, "warnings": audit.audit_warnings(state.load(), left), "active": audit.active_queue_count(left), "recovered": state.recovered + work.recovered}
    raise Moved(f"{state.root} moved {TRIES} times")


def audit_run(spark: SparkSession, root: str, messages: DataFrame, now: str, requeue: bool = False, errors: DataFrame | None = None) -> dict:
    """The audit's lists and counts; with requeue, entries that have new messages go back to the queue as partial.

    What is changed is read under the lock, so a catch-up that ends meanwhile
    keeps its changes; a stream, which takes no lock, does so since the change is
    made from what it left.
    """
    state, work = tables(spark, root)
    with lock(spark, root) if requeue else contextlib.nullcontext():
        entries, queue = state.load(), work.load(spark.createDataFrame([], QUEUE))
        new = cut(_found(entries, messages, errors))
        report, counts = cut(audit.audit_report(entries, messages, errors)), cut(audit.audit_counts(entries, queue))
        requeued = False
        if requeue and not new.isEmpty():
            found: list[DataFrame] = []

            def marked(entries: DataFrame) -> DataFrame | None:
                found[:] = [entries, cut(_found(entries, messages, errors))]
                hit = F.col("next_id").isNotNull()
                changed = {"sync_status": F.when(hit, "partial").otherwise(F.col("sync_status")), "has_sync_status": hit | F.col("has_sync_status"), "backlog_reason": F.when(hit, "live_probe_found_new_messages").otherwise(F.col("backlog_reason")), "last_seen_message_id": F.coalesce("next_id", "last_seen_message_id")}
                return None if found[1].isEmpty() else entries.join(found[1].select("entry_key", "next_id"), "entry_key", "left").withColumns(changed).select(entries.columns)

            requeued = state.update(marked) is not None
            if requeued:
                work.save(numbered(audit.audit_requeue(queue, *found, now)))
    return {"report": report, "counts": counts, "requeued": requeued}


def _found(entries: DataFrame, messages: DataFrame, errors: DataFrame | None) -> DataFrame:
    new = audit.live_new_after_cursor(entries, messages)
    return new if errors is None else new.join(errors.select("entry_key"), "entry_key", "left_anti")


def audit_live(spark: SparkSession, root: str, options: dict[str, str], now: str, requeue: bool = False, tasks: int = 8, rate: float | None = None) -> dict:
    """The audit with probes of the paged API: one message after each entry's cursor, from `tasks` tasks that share `rate` requests a second.

    An entry whose read fails is in the report with its error, and not taken for caught up.
    """
    places = audit.with_cursor(tables(spark, root)[0].load()).where("cursor is not null").select("entry_key", "channel_id", "cursor")
    found = cut(live.read_after(places, options, page=1, pages=1, tasks=tasks, rate=rate))
    return audit_run(spark, root, live.as_messages(found), now, requeue, live.errors_of(found).select("entry_key", "error"))


def migrate_run(spark: SparkSession, root: str, entries: DataFrame, queue: DataFrame, now: str, dry_run: bool = False, hot_paths: tuple[str, ...] = ()) -> DataFrame:
    """Commits migrated entries and the merged queue, in its stored order; returns the counts."""
    classified = cut(migrate.migrate_classify(entries, hot_paths))
    if not dry_run:
        merged = migrate.migrate_queue_merge(queue, classified, now).withColumn("has_status", F.lit(True))
        state, work = tables(spark, root)
        with lock(spark, root):
            state.save(classified.drop("class", "enqueue", "priority"))
            work.save(ordered(merged))
    return migrate.migrate_stats(classified)


def discover_run(spark: SparkSession, root: str, inventory: DataFrame, default: DataFrame, guild_id: str | None = None) -> DataFrame:
    """Patches an inventory into the ledger (default: the empty one to begin with); returns the counts."""
    state, _ = tables(spark, root)
    stats: list[DataFrame] = []

    def patched(entries: DataFrame) -> DataFrame:
        stats[:] = [cut(discover.inventory_stats(entries, inventory))]
        return discover.inventory_upsert(entries, inventory, guild_id)

    with lock(spark, root):
        state.update(patched, default)
    return stats[0]
