"""Discovery: an inventory of channels and threads is patched into the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cursors import truthy


def inventory_entries(inventory: DataFrame, guild_id: str | None = None) -> DataFrame:
    """Valid rows of an inventory (ordinal, kind, name, channel_name, id, other_id, parent) as entries.

    The first alias that isn't null counts, an empty string too, which then makes
    the row invalid.  A thread needs a parent; its key is parent/name.
    """
    name, channel = F.coalesce("name", "channel_name"), F.coalesce("id", "other_id")
    thread = F.col("kind") == "thread"
    rows = inventory.where(truthy(name).isNotNull() & truthy(channel).isNotNull() & (~thread | truthy("parent").isNotNull()))
    key = F.when(thread, F.concat_ws("/", "parent", name)).otherwise(name)
    return rows.select("ordinal", key.alias("entry_key"), F.col("kind").alias("type"), channel.alias("channel_id"), F.when(thread, F.col("parent")).alias("parent_channel"), key.alias("relative_path"), F.lit(guild_id).cast("string").alias("guild_id"))


def inventory_upsert(entries: DataFrame, inventory: DataFrame, guild_id: str | None = None) -> DataFrame:
    """The ledger with the inventory patched in: a field of the last row that has it wins, null never overwrites, all else stays."""
    fields = ("type", "channel_id", "parent_channel", "relative_path", "guild_id")
    rows = inventory_entries(inventory, guild_id)
    new = rows.groupBy("entry_key").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(f"n_{c}") for c in fields))
    both = entries.join(new, "entry_key", "full_outer")
    old = lambda c: F.col(c) if c in entries.columns else F.lit(None).cast("string")
    columns = [c for c in entries.columns if c != "entry_key" and c not in fields]
    return both.select("entry_key", *(F.coalesce(F.col(f"n_{c}"), old(c)).alias(c) for c in fields), *columns)


def inventory_stats(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    """channels, threads, created, updated; a key's second row of a run counts as updated."""
    rows = inventory_entries(inventory).join(entries.select("entry_key", F.lit(True).alias("known")), "entry_key", "left")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("entry_key").orderBy("ordinal")))
    created = F.col("known").isNull() & (F.col("n") == 1)
    return rows.agg(F.count_if(F.col("type") == "channel").alias("channels"), F.count_if(F.col("type") == "thread").alias("threads"), F.count_if(created).alias("created"), F.count_if(~created).alias("updated"))
