"""JSON documents of the ledger: state, queue and inventories, read into tables and written back.

Missing and null are told apart where that matters: has_sync_status and
has_status say whether the field was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut

#: Field names in the documents and columns here.
ENTRY_FIELDS = {
    "type": "type", "channelId": "channel_id", "guildId": "guild_id", "parentChannel": "parent_channel", "relativePath": "relative_path", "lastWrittenMessageId": "last_written_message_id",
    "lastMessageId": "last_message_id", "lastSeenMessageId": "last_seen_message_id", "syncStatus": "sync_status", "backlogReason": "backlog_reason", "deferredReason": "deferred_reason",
    "dailySyncStatus": "daily_sync_status", "dailySyncNote": "daily_sync_note", "hot": "hot", "lastBackup": "last_backup", "lastSuccessfulWriteAt": "last_successful_write_at",
    "consecutiveErrors": "consecutive_errors", "backlogAttempts": "backlog_attempts", "stateSchemaVersion": "state_schema_version", "updatedAt": "updated_at",
}
QUEUE_FIELDS = {
    "entryKey": "entry_key", "channelId": "channel_id", "relativePath": "relative_path", "type": "type", "cursorMessageId": "cursor_message_id", "targetHintMessageId": "target_hint_message_id",
    "priority": "priority", "reason": "reason", "status": "status", "attempts": "attempts", "createdAt": "created_at", "updatedAt": "updated_at",
}
_KINDS = {"hot": "boolean", "consecutive_errors": "int", "backlog_attempts": "int", "state_schema_version": "int", "priority": "int", "attempts": "int"}
_LISTS = ("items", "channels", "threads", "results")
_ALIASES = {"channel": (("name", "channelName"), ("id", "channelId")), "thread": (("name", "threadName"), ("id", "threadId", "channelId"))}
_PARENTS = ("parentChannel", "parentName", "parent")


def _field(fields: Column, name: str, column: str) -> Column:
    """A field of a map of JSON texts; JSON null reads as null."""
    return F.try_element_at(fields, F.lit(name)).cast(_KINDS.get(column, "string")).alias(column)


class Unusable(Exception):
    """A document that is no JSON, and so are all of its backups."""


def _best(spark: SparkSession, path: str) -> tuple[DataFrame, str] | None:
    """One row with the text (value) of a JSON document or of its newest backup that parses, and that file's name; None if there is no such document.

    Backups are files beside it whose names go on from its own with .bak.  All are
    read once, by tasks; the document itself comes first, then the newest by
    modification time.  Only what doesn't parse is passed over: a document of
    another form is an error of the reader.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    backups = [x.getPath().toString() for x in fs.listStatus(at.getParent()) if x.getPath().getName().startswith(f"{at.getName()}.bak")]
    read = spark.read.text([path, *backups], wholetext=True).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("changed"))
    sound = read.where(F.try_parse_json("value").isNotNull()).orderBy((F.col("name") == at.getName()).desc(), F.desc("changed"), F.desc("name")).limit(1)
    best = cut(sound.select("value", "name"))
    found = best.select("name").first()
    if found is None:
        raise Unusable(f"{path} and its backups don't parse")
    return best, found.name


def sound(spark: SparkSession, path: str, recovered: list[dict[str, str]] | None = None) -> str | None:
    """The path of a JSON document, or, if it doesn't parse, of its newest backup that does, noted in `recovered`; None if there is no such document."""
    best = _best(spark, path)
    if best is None:
        return None
    folder, _, name = path.rpartition("/")
    if best[1] == name:
        return path
    one = f"{folder}/{best[1]}" if folder else best[1]
    if recovered is not None:
        recovered.append({"path": path, "recovered_from": one})
    return one


class Missing(Exception):
    """There is no such document."""


def whole_text(spark: SparkSession, path: str, recovered: list[dict[str, str]] | None = None) -> DataFrame:
    """value: the text of a JSON document, or of its newest backup if it doesn't parse, which is noted in `recovered`."""
    best = _best(spark, path)
    if best is None:
        raise Missing(path)
    folder, _, name = path.rpartition("/")
    if best[1] != name and recovered is not None:
        recovered.append({"path": path, "recovered_from": f"{folder}/{best[1]}" if folder else best[1]})
    return best[0].select("value")


def read_state(spark: SparkSession, path: str, recovered: list[dict[str, str]] | None = None) -> DataFrame:
    """The entries of a state document, unknown fields kept in `extra`; a document without entries is an error.

    One that doesn't parse is recovered from its newest backup, which is noted in `recovered`.
    """
    return state_rows(whole_text(spark, path, recovered))


def state_rows(documents: DataFrame) -> DataFrame:
    """The entries of state documents (value)."""
    doc = documents.select(F.from_json("value", "entries map<string,string>", {"mode": "FAILFAST"}).alias("d"))
    doc = doc.select(F.when(F.col("d.entries").isNull(), F.raise_error(F.lit("unsupported state: no entries"))).otherwise(F.col("d.entries")).alias("entries"))
    rows = doc.select(F.explode("entries").alias("entry_key", "json")).withColumn("f", F.from_json("json", "map<string,string>"))
    extra = F.map_filter("f", lambda k, _: ~k.isin(*ENTRY_FIELDS))
    return rows.select("entry_key", *(_field(F.col("f"), n, c) for n, c in ENTRY_FIELDS.items()), F.map_contains_key("f", "syncStatus").alias("has_sync_status"), extra.alias("extra"))


def read_queue(spark: SparkSession, path: str, recovered: list[dict[str, str]] | None = None) -> DataFrame:
    """The items of a queue document with their place in it; no items, no rows.  Recovered as read_state()'s is."""
    doc = whole_text(spark, path, recovered).select(F.from_json("value", "items array<string>", {"mode": "FAILFAST"}).alias("d"))
    rows = doc.select(F.posexplode("d.items").alias("ordinal", "json")).withColumn("f", F.from_json("json", "map<string,string>"))
    return rows.select(F.col("ordinal").cast("bigint").alias("ordinal"), *(_field(F.col("f"), n, c) for n, c in QUEUE_FIELDS.items()), F.map_contains_key("f", "status").alias("has_status"))


def read_inventory(spark: SparkSession, path: str, kind: str, recovered: list[dict[str, str]] | None = None) -> DataFrame:
    """An inventory of channels or threads: a list, or an object with the list under one of four keys (the first that is a list)."""
    text = whole_text(spark, path, recovered)
    lists = F.from_json("value", ", ".join(f"{k} array<string>" for k in _LISTS))
    found = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.coalesce(*(lists[k] for k in _LISTS)))
    rows = text.select(F.when(found.isNull(), F.raise_error(F.lit("unsupported inventory"))).otherwise(found).alias("x")).select(F.posexplode("x").alias("ordinal", "json"))
    rows = rows.withColumn("f", F.from_json("json", "map<string,string>"))
    names, ids = _ALIASES[kind]
    get = lambda keys: F.coalesce(*(F.try_element_at("f", F.lit(k)) for k in keys))
    parent = get(_PARENTS) if kind == "thread" else F.lit(None).cast("string")
    return rows.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.lit(kind).alias("kind"), get(names).alias("name"), F.lit(None).cast("string").alias("channel_name"), get(ids).alias("id"), F.lit(None).cast("string").alias("other_id"), parent.alias("parent"))


def state_json(entries: DataFrame) -> DataFrame:
    """entry_key, json: each entry as it stands in a state document, without its null fields (unknown ones are in `extra`)."""
    known = F.struct(*(F.col(c).alias(n) for n, c in ENTRY_FIELDS.items() if c in entries.columns))
    return entries.select("entry_key", F.to_json(known).alias("json"))


def queue_json(queue: DataFrame) -> DataFrame:
    """ordinal, json: each item as it stands in a queue document."""
    return queue.select("ordinal", F.to_json(F.struct(*(F.col(c).alias(n) for n, c in QUEUE_FIELDS.items() if c in queue.columns))).alias("json"))
