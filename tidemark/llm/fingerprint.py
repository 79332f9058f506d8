"""Document fingerprints: the k smallest shingle hashes of a text, in DataFrame functions only.

Sketches of parts merge into the sketch of the whole (merge_sketches), and give
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, cut, unused

#: Words of a shingle and hashes kept; the standard error of a resemblance is at most 0.5 / sqrt(K).
SHINGLE, K = 5, 128


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def with_sketch(df: DataFrame, text: Column, out: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """Adds the sketch of a text as a sorted array<bigint>.

    Shingles are n words; a text of fewer words is one shingle, one without words has none.
    """
    w, size = f"__{out}_words", F.size(f"__{out}_words")
    at = lambda i, j: F.get(F.col(w), i + j)
    return (
        df.withColumn(w, F.transform(words(text), lambda x: F.xxhash64(x)))
        .withColumn(
            out,
            F.when(size == 0, F.array().cast("array<bigint>"))
            .when(size < n, F.array(F.xxhash64(F.col(w))))
            .otherwise(F.slice(F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*(at(i, j) for j in range(n)))))), 1, k)),
        )
        .drop(w)
    )


def merge_two(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts.

    The ranking by key is limited to k rows in each task before the shuffle, so a key with very many parts is no burden.
    """
    by = Window.partitionBy(*keys).orderBy("__h")
    rows = df.select(*keys, F.explode(F.array_distinct(sketch)).alias("__h"))
    ranked = rows.withColumn("__r", F.dense_rank().over(by)).where(F.col("__r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_set("__h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; exact while both together have at most k shingles.  Two empty sketches are alike, one is like nothing."""
    union = merge_two(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k, else from how low the k-th smallest hash lies."""
    lies = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / lies)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    union = distinct_shingles(merge_two(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(df: DataFrame, key: str, text: str, what: list[str] | None = None, need: Column | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds next: a struct of the key, text and columns `what` of the next document by ascending key, of the first after the last.

    need: so many code points of the next document's text are wanted, an
    expression of this row's text (none: all).  prepare: adds the columns `what`
    to rows like df's, if df hasn't them; it runs after the texts are shuffled, so
    what it adds isn't shuffled with them.  Documents that share a key
    follow each other by a hash of their texts; null keys come first.  Rows that
    share key and text are one document and have the same next one.  Keys are
    read as 64-bit integers.

    No window and no task sees all rows.  Keys and hashes alone are put in order
    by ranges, and a row's place gives the next one's; only the last places of
    the ranges, one for each partition, come to the driver.  Texts are shuffled
    once, by key and hash, and of the next text what is needed.  Keys may be as
    sparse as they like; null or repeated ones spread by the texts' hashes.
    """
    null, id_, tie = unused(df, "__null"), unused(df, "__id"), unused(df, "__tie")
    rows = df.withColumns({null: F.col(key).isNull(), id_: F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")), tie: F.xxhash64(text, F.col(key).isNull())})
    order = [F.col("null").desc(), F.col("id"), F.col("tie")]
    keys = rows.select(F.col(null).alias("null"), F.col(id_).alias("id"), F.col(tie).alias("tie"), (need if need is not None else F.lit(2**31 - 1)).cast("int").alias("need"))
    keys = keys.groupBy("null", "id", "tie").agg(F.max("need").alias("need"), F.count("*").alias("n"))
    placed = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "tie", "need", "n", F.monotonically_increasing_id().alias("at")))
    # A place is its partition's number and, in the lower 33 bits, its own within that.
    ends = sorted(r[0] for r in placed.groupBy(F.shiftright("at", 33)).agg(F.max("at").alias("end")).select("end").collect())
    jumps = df.sparkSession.createDataFrame([(end, ends[(k + 1) % len(ends)] >> 33 << 33) for k, end in enumerate(ends)], "end long, begin long")
    before = placed.join(F.broadcast(jumps), F.col("at") == F.col("end"), "left").select(F.coalesce("begin", F.col("at") + 1).alias("at"), F.col("id").alias("to_id"), F.col("tie").alias("to_tie"), "need")
    before = placed.select("at", F.col("id").alias("of_id"), F.col("tie").alias("of_tie")).join(before, "at").drop("at")
    sent = rows.join(before, (F.col(id_) == F.col("of_id")) & (F.col(tie) == F.col("of_tie")))
    sent = prepare(sent) if prepare else sent
    sent = sent.select("to_id", "to_tie", F.struct(F.col(key), F.substring(F.col(text), F.lit(1), F.col("need")).alias(text), *(what or [])).alias("next"))
    if not placed.where("n > 1").isEmpty():
        sent = sent.dropDuplicates(["to_id", "to_tie"])
    return rows.join(sent, (F.col(id_) == F.col("to_id")) & (F.col(tie) == F.col("to_tie"))).drop(null, id_, tie, "to_id", "to_tie")
