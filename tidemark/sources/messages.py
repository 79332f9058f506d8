"""A table of messages by channel, whose reads open the files of the channels asked for and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schemas import MESSAGES

#: The folder's name for messages without a channel, as Spark has it.
PART = "channel_id"


def write_messages(messages: DataFrame, path: str, mode: str = "append", ranges: int | None = None) -> None:
    """Writes messages in a folder for each channel, in files by ranges of ids.

    Rows are dealt out by ranges of channel and id, so a channel with a third of
    all messages is many files, of ranges that don't overlap, and small channels
    share a task.  ranges: how many (Spark's own choice, by size).
    """
    rows = messages.repartitionByRange(*([ranges] if ranges else []), "channel_id", "id_num").sortWithinPartitions("channel_id", "id_num")
    rows.write.mode(mode).partitionBy(PART).parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The table; a filter on channel_id chooses folders, one on id_num files' row groups."""
    columns = [f.name for f in spark.createDataFrame([], MESSAGES).schema]
    return spark.read.schema(MESSAGES).parquet(path).select(*(F.col(c) for c in columns))
