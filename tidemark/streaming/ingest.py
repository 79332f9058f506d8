"""Catch-up as a stream: messages in, archive and ledger out, each micro-batch once.

Every entry's cursor is a keyed state of the stream (transformWithState).  A
micro-batch keeps what is after the cursor that its entry had when the stream
began, and marks what its state has passed already; so files may come in any
order, and a message that lies before one of an earlier batch is written all the
same.  A batch goes to the archive under the stream's id and its own number and
counts from the commit of the ledger that moves the cursors of the entries it
touched, which is a delta: no other entry is written.  A batch that is repeated
after a crash finds itself committed, or begins anew.  The stream takes no lock:
if a catch-up or an audit commits first, the batch is made again from what that
left, and what it wrote already is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.cursors import id_number, newest_cursor, truthy
from ..operators.audit import messages_after
from ..plans.schemas import MESSAGES
from ..sources import live
from ..sources.archive import Archive, unwritten
from ..sources.files import Files
from ..sources.snapshots import TRIES, Moved, Snapshots

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What goes through the state beside its key; `rest` is the message as JSON, as only JVM code reads it.
STATED = "entry_key string, relative_path string, id_num long, rest string, passed boolean"


class Passed(StatefulProcessor):
    """One entry's cursor as the stream has moved it: marks messages at or before it as passed, and moves it to the largest id seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "top long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.top.get()[0] if self.top.exists() else None
        top = before
        for part in rows:
            ids = part["id_num"].fillna(-1).astype("int64")
            yield part.assign(passed=(ids <= before) & (ids >= 0) if before is not None else False)[["entry_key", "relative_path", "id_num", "rest", "passed"]]
            top = max([int(ids.max()), *([top] if top is not None else [])])
        if top is not None and top >= 0 and top != before:
            self.top.update((top,))

    def close(self) -> None:
        pass


def advance(entries: DataFrame, written: DataFrame) -> DataFrame:
    """The ledger with cursors at the largest id written (entry_key, id, id_num); such entries are partial until a read shows nothing is left."""
    top = written.groupBy("entry_key").agg(F.max_by("id", "id_num").alias("top"))
    both = entries.join(top, "entry_key", "left")
    hit = F.col("top").isNotNull()
    moved = {c: F.when(hit, newest_cursor(c, "top")).otherwise(F.col(c)) for c in ("last_written_message_id", "last_message_id")}
    moved |= {"sync_status": F.when(hit, "partial").otherwise(F.col("sync_status")), "has_sync_status": hit | F.col("has_sync_status"), "backlog_reason": F.when(hit, F.coalesce(truthy("backlog_reason"), F.lit("page_limit_reached"))).otherwise(F.col("backlog_reason"))}
    return both.withColumns(moved).select(entries.columns)


def settle(entries: DataFrame, pending: DataFrame, run_date: str) -> DataFrame:
    """Marks caught up every entry without a pending message after its cursor (pending: entry_key)."""
    left = entries.join(pending.select("entry_key", F.lit(True).alias("more")).distinct(), "entry_key", "left")
    done = F.col("more").isNull()
    return left.withColumns(_settled(done, run_date)).select(entries.columns)


def _settled(done, run_date: str) -> dict:
    return {"sync_status": F.when(done, "healthy").otherwise(F.col("sync_status")), "has_sync_status": done | F.col("has_sync_status"), "backlog_reason": F.when(done, None).otherwise(F.col("backlog_reason")), "last_backup": F.when(done, F.lit(run_date)).otherwise(F.col("last_backup")), "consecutive_errors": F.when(done, 0).otherwise(F.col("consecutive_errors"))}


def told(entries: DataFrame, said: DataFrame, run_date: str) -> DataFrame:
    """Entries after what a source said of reads without messages (entry_key, error): with an error they are in error once more, else caught up."""
    last = said.groupBy("entry_key").agg(F.max("error").alias("said_error"), F.lit(True).alias("said"))
    both = entries.join(last, "entry_key", "left")
    failed, done = F.col("said_error").isNotNull(), F.col("said").isNotNull() & F.col("said_error").isNull()
    both = both.withColumns(_settled(done, run_date))
    both = both.withColumns({"sync_status": F.when(failed, "error").otherwise(F.col("sync_status")), "has_sync_status": failed | F.col("has_sync_status"), "consecutive_errors": F.when(failed, F.coalesce("consecutive_errors", F.lit(0)) + 1).otherwise(F.col("consecutive_errors"))})
    return both.select(entries.columns)


def reading_places(entries: DataFrame) -> DataFrame:
    """entry_key, channel_id, relative_path, cursor: after what each entry's channel is read; 0 if nothing is written."""
    return entries.select("entry_key", "channel_id", "relative_path", F.coalesce(newest_cursor("last_written_message_id", "last_message_id"), F.lit("0")).alias("cursor"))


def places_at_start(spark: SparkSession, ledger: Snapshots, checkpoint: str) -> Snapshots:
    """The cursors that a stream began with, kept beside its checkpoint; entries that are new since then are added."""
    kept, now = Snapshots(spark, f"{checkpoint}.places"), reading_places(ledger.load())
    if kept.current() is not None:
        known = kept.load()
        now = known.unionByName(now.join(known, "entry_key", "left_anti"))
    kept.save(now)
    return kept


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The stream's own id: made once for a checkpoint."""
    files = Files(spark, f"{checkpoint}.places")
    files.put_new("ID", uuid.uuid4().hex)
    return files.read("ID").strip()


def stated(stream: DataFrame, places: DataFrame) -> DataFrame:
    """Messages after the cursor that their entry began with, with passed: whether the stream has been past them.

    stream: messages, and rows without an id that say of a channel that a read
    failed (error) or gave nothing.  Places are a row for each entry.
    """
    begin = places.select("entry_key", "relative_path", F.col("channel_id").alias("of_channel"), id_number("cursor").alias("began"))
    if "error" not in stream.columns:
        stream = stream.withColumn("error", F.lit(None).cast("string"))
    rest = F.to_json(F.struct("channel_id", "id", F.col("ts").cast("string").alias("ts"), "content", "author", "attachments", "error"))
    rows = stream.join(begin, (F.col("channel_id") == F.col("of_channel")) & (F.col("id_num").isNull() | (F.col("id_num") > F.col("began"))))
    keyed = rows.select("entry_key", "relative_path", "id_num", rest.alias("rest")).groupBy("entry_key")
    return keyed.transformWithStateInPandas(Passed(), STATED, "append", "none")


_REST = "channel_id string, id string, ts string, content string, author struct<global_name:string,username:string,id:string>, attachments array<struct<filename:string,url:string>>, error string"


def ingest_batch(spark: SparkSession, batch: DataFrame, number: int, ledger: Snapshots, archive: str, run_label: str, stream: str, run_date: str | None = None) -> None:
    """Commits one micro-batch of stated(): its messages, the cursors they move and what was said of reads.

    The batch's rows are put down once, under the archive, and everything is made
    from there; so the state is read and moved once.
    """
    to, name = Archive(spark, archive), f"{stream}-{number}."
    to.settle()
    if to.has_any(name):
        batch.write.format("noop").mode("overwrite").save()  # the state moves on all the same
        return
    staged = f"{archive}/staging/{name}"
    batch.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(STATED).parquet(staged).select("entry_key", "relative_path", "id_num", "passed", F.from_json("rest", _REST).alias("m"))
    rows = rows.select("entry_key", "relative_path", "id_num", "passed", "m.channel_id", "m.id", F.col("m.ts").cast("timestamp_ntz").alias("ts"), "m.content", "m.author", "m.attachments", "m.error")
    messages, said = rows.where("id is not null").drop("error"), rows.where("id is null").select("entry_key", "error")
    touched = rows.select("entry_key").distinct()
    for _ in range(TRIES):
        entries = ledger.peek().join(touched, "entry_key", "left_semi")
        if entries.isEmpty():
            break
        now = reading_places(entries).select("entry_key", id_number("cursor").alias("now"))
        new = messages.join(now, "entry_key").withColumn("passed", F.col("passed") | (F.col("id_num") <= F.col("now"))).drop("now")
        if not new.where("passed").isEmpty():
            new = new.where("not passed").unionByName(unwritten(to, new.where("passed")))
        moved, key = entries, None
        if not new.isEmpty():
            key = f"{name}{uuid.uuid4().hex}"
            to.write(new.drop("passed"), key, run_label)
            to.announce(key, ledger, ledger.at + 1)
            moved = advance(moved, new.select("entry_key", "id", "id_num"))
        if run_date and not said.isEmpty():
            moved = told(moved, said, run_date)
        if moved is entries:
            break
        try:
            ledger.patch(moved, expected=ledger.at, batch=key)
        except Moved:
            if key:
                to.drop(key)
            continue
        if key:
            to.confirm(name)
        break
    else:
        raise Moved(f"{ledger.root} moved {TRIES} times")
    to.files.delete(f"staging/{name}")


def start_from(spark: SparkSession, stream: DataFrame, ledger: Snapshots, archive: str, checkpoint: str, run_label: str, run_date: str | None = None, **trigger) -> StreamingQuery:
    """Ingests a stream of messages; trigger as of writeStream.trigger.

    run_date: entries of which the source says that a read gave nothing (live.py)
    are caught up on that day, and those whose read failed in error.  Cursors are
    kept in RocksDB, with the checkpoint.  Entries that the ledger gets after the
    stream has begun are read from its next start on.
    """
    places, name = places_at_start(spark, ledger, checkpoint), stream_id(spark, checkpoint)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings it was started with
    try:
        out = stated(stream, places.load()).writeStream.foreachBatch(lambda df, n: ingest_batch(spark, df, n, ledger, archive, run_label, name, run_date))
        return out.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(PROVIDER, before)


def start(spark: SparkSession, source: str, ledger: Snapshots, archive: str, checkpoint: str, run_label: str, files: int = 100) -> StreamingQuery:
    """Ingests all message files that are there (Parquet, the schema of messages), a bounded number a micro-batch, and stops."""
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files).parquet(source)
    return start_from(spark, stream, ledger, archive, checkpoint, run_label, availableNow=True)


def start_live(spark: SparkSession, options: dict[str, str], ledger: Snapshots, archive: str, checkpoint: str, run_label: str, run_date: str, **trigger) -> StreamingQuery:
    """Ingests from the paged API (options of live.PagedMessages, but for the cursors, which are the ledger's).

    It ends healthy: once a read after an entry's cursor gives nothing, the entry is caught up.
    """
    spark.dataSource.register(live.PagedMessages)
    cursors = live.cursors_option(reading_places(ledger.load()))
    stream = spark.readStream.format("paged_messages").options(**options, cursors=cursors).load()
    return start_from(spark, live.as_messages(stream, keep=["error"], only_messages=False), ledger, archive, checkpoint, run_label, run_date, **trigger)


def complete(ledger: Snapshots, messages: DataFrame, run_date: str) -> DataFrame:
    """Reads after every cursor once more, and commits that entries with nothing left are caught up; the ledger after it."""

    def settled(entries: DataFrame) -> DataFrame:
        pending = messages_after(reading_places(entries), messages.select("channel_id", "id_num")).select("entry_key").distinct()
        return settle(entries, pending, run_date)

    ledger.update(settled)
    return ledger.load()


def catch_up(spark: SparkSession, source: str, ledger: Snapshots, archive: str, checkpoint: str, run_label: str, run_date: str, files: int = 100) -> DataFrame:
    """Ingests all message files that are there and then settles the ledger: a file that comes meanwhile leaves its entries partial."""
    start(spark, source, ledger, archive, checkpoint, run_label, files).awaitTermination()
    return complete(ledger, spark.read.schema(MESSAGES).parquet(source), run_date)
