"""What several operators share: the checkpoint folder, bounded Arrow batches, word hashes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch to a Python worker; texts may be a hundred thousand characters long.
BATCH_ROWS = 256
#: Ids up to which a list of ids is broadcast.
SMALL_IDS = 1_000_000
#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; a folder of our own only where it is unset and all tasks run in this process (tests)."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so a lost executor costs nothing.  The files go when the application ends."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    delete_at_end(df.sparkSession, df.sparkSession.sparkContext.getCheckpointDir())
    return out


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this application's own when its driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, where a checkpoint of wide rows would be larger.  They go when the application ends, if not before."""
    path = path or scratch_path(df.sparkSession)
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/tidemark-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored() wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_enough(ids: DataFrame, limit: int = SMALL_IDS) -> DataFrame:
    """Marks a list of ids for broadcast if it has at most `limit` rows, of 16 bytes each; a longer one is joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as no column of df is called."""
    while name.lower() in {x.lower() for x in df.columns}:
        name += "_"
    return name


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches whose memory is bounded."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # workers are used again

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def coded_words(column: pa.Array, strip: str = "") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a column of texts, A to Z lowered: the distinct ones, all of them as places in those, and where each text begins (one offset more than texts).

    strip: ASCII characters to take off both ends of words; words of nothing else go.
    """
    if column.offset:  # splitting reads a slice wrongly
        column = column.take(pa.array(np.arange(len(column))))
    texts = pc.fill_null(column, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    coded = flat.dictionary_encode()
    names = pc.ascii_trim(coded.dictionary, characters=strip) if strip else coded.dictionary
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(names).to_numpy(zero_copy_only=False) > 0)[codes]
    before = np.concatenate([[0], np.cumsum(real)])
    return names, codes[real], before[offsets - offsets[0]]


def as_list(names: pa.Array) -> list[str]:
    """Much faster than to_pylist for many short strings."""
    return names.to_numpy(zero_copy_only=False).tolist()


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a column of texts, and where each text begins in them; each distinct word is hashed once."""
    names, codes, offsets = coded_words(column)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, as_list(names)), np.uint64, len(names))
    return hashed[codes], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; with fewer words the whole sequence is one, without words none is."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return out
