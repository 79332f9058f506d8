"""Archives of messages by path and day, which grow batch by batch and lose and repeat nothing.

A batch has a folder of its own under an id that its writer makes anew for each
try: a random one, which for a stream begins with its id and the batch's number.  It counts once
the list of committed batches, one file each, has it, and readers see those only;
so an unfinished batch is never read, and a committed one never overwritten.

A batch that goes with cursors counts from the commit of the ledger that moves
them, and not otherwise: it is announced (pending) with that commit's number,
which says afterwards whether it came about.  A crash at any point leaves both or
neither, and settle() tidies up after it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import author_name, local_day, raw_block
from ..operators.digest import summary_blocks
from .files import Files
from .snapshots import Snapshots

RAW = "channel_id string, id string, id_num bigint, block string, batch string, relative_path string, day date"
SUMMARY = "block string, batch string, relative_path string, day date"
#: What makes a message one of its path.
IDENTITY = ["relative_path", "channel_id", "id"]


def raw_rows(messages: DataFrame) -> DataFrame:
    """relative_path, day, channel_id, id, id_num, block of planned messages, each once in a path."""
    rows = messages.dropDuplicates(IDENTITY)
    return rows.select("relative_path", local_day("ts").alias("day"), "channel_id", "id", "id_num", raw_block(F.col("ts"), author_name("author"), F.col("id"), F.col("content"), F.col("attachments")).alias("block"))


def headers(rows: DataFrame, run_label: str) -> DataFrame:
    """The header of each day's batch, before all its messages."""
    n = rows.groupBy("relative_path", "day").agg(F.count("*").alias("n"))
    block = F.concat(F.lit(f"\n\n---\n## V3 backlog append — {run_label} — "), F.col("n").cast("string"), F.lit(" messages\n"))
    return n.select("relative_path", "day", F.lit(None).cast("string").alias("channel_id"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("id_num"), block.alias("block"))


@dataclass
class Archive:
    """An archive under a root folder: raw and summary by batch, pending and commits."""

    spark: SparkSession
    root: str

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    def has(self, batch: str) -> bool:
        return self.files.exists(f"commits/{batch}")

    def has_any(self, prefix: str) -> bool:
        """Whether a batch whose id begins so is committed."""
        return any(x.startswith(prefix) for x in self.files.names("commits"))

    def write(self, messages: DataFrame, batch: str, run_label: str) -> None:
        """Writes raw and then summary of a batch that isn't committed; files of a path and day hold the messages in id order."""
        if self.has(batch):
            raise ValueError(f"batch {batch} is committed")
        rows = raw_rows(messages)
        out = rows.unionByName(headers(rows, run_label)).repartition("relative_path", "day").sortWithinPartitions("relative_path", "day", F.col("id_num").asc_nulls_first())
        out.write.mode("overwrite").partitionBy("relative_path", "day").parquet(f"{self.root}/raw/batch={batch}")
        summary_blocks(messages.dropDuplicates(IDENTITY), run_label).write.mode("overwrite").partitionBy("relative_path", "day").parquet(f"{self.root}/summary/batch={batch}")

    def announce(self, batch: str, ledger: Snapshots, commit: int) -> None:
        """Says, before that commit of the ledger, that the batch counts if it comes about.  Each try has a batch of its own, so that another process can drop one that failed."""
        self.files.put_new(f"pending/{batch}", json.dumps({"ledger": ledger.root, "commit": commit}))

    def confirm(self, batch: str) -> None:
        self.files.put_new(f"commits/{batch}", "")
        self.files.delete(f"pending/{batch}")

    def drop(self, batch: str) -> None:
        """Takes back a batch that isn't committed."""
        for name in (f"pending/{batch}", f"raw/batch={batch}", f"summary/batch={batch}"):
            self.files.delete(name)

    def _decided(self) -> dict[str, bool]:
        """Pending batches whose commit number is taken: by them or by another."""
        out = {}
        for batch in self.files.names("pending"):
            try:
                said = json.loads(self.files.read(f"pending/{batch}"))
            except Py4JJavaError as e:
                if "FileNotFound" in str(e.java_exception):  # another process has settled it meanwhile
                    continue
                raise
            ledger = Snapshots(self.spark, said["ledger"])
            if ledger.files.exists(f"_log/{said['commit']:012d}"):
                out[batch] = ledger.entry(said["commit"])["batch"] == batch
        return out

    def settle(self) -> None:
        """Confirms pending batches that the ledger has committed, and drops those whose commit went to another."""
        for batch, ours in self._decided().items():
            (self.confirm if ours else self.drop)(batch)

    def batches(self) -> list[str]:
        """The committed batches."""
        decided = self._decided()  # first: what is confirmed meanwhile is among the committed
        return sorted({*self.files.names("commits"), *(b for b, ours in decided.items() if ours)})

    def _read(self, kind: str, schema: str) -> DataFrame:
        batches = [b for b in self.batches() if self.files.exists(f"{kind}/batch={b}")]
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{kind}/batch={b}" for b in batches))

    def raw(self) -> DataFrame:
        """All raw messages of committed batches, without headers; each is there once in its path, so nothing is compared."""
        return self._read("raw", RAW).where("id is not null")

    def summaries(self) -> DataFrame:
        return self._read("summary", SUMMARY)


def unwritten(archive: Archive, messages: DataFrame) -> DataFrame:
    """Those of a batch's messages that no committed batch has: for messages at or before a cursor, which only an out-of-order source or a recovered ledger gives.

    Of the archive only the paths and ids of the batch are read.
    """
    paths = messages.select("relative_path").distinct()
    known = archive.raw().select(*IDENTITY, "id_num").join(F.broadcast(paths), "relative_path")
    return messages.join(known.select(*IDENTITY), IDENTITY, "left_anti")


def write_batch(messages: DataFrame, root: str, batch: str, run_label: str) -> None:
    """A batch without a ledger: written and committed, or nothing if it is committed already."""
    archive = Archive(messages.sparkSession, root)
    if not archive.has(batch):
        archive.write(messages, batch, run_label)
        archive.confirm(batch)


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    return Archive(spark, root).raw()
