"""Mixing sources to target weights by hash thresholds; no document is sorted.

Words are summed by source and hash bucket; the bucket where a source's budget
runs out is split again until it is one hash, and a document is taken once more
if its hash lies below the threshold.  A larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, unused

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: A hash has 60 bits and is refined so many at a time.
HASH_BITS, LEVEL_BITS = 60, 12
#: Sources up to which the per-source tables are broadcast (32 bytes each and its name); beyond, they are joined by shuffle.
SMALL = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size to which rank, weight and target are added.

    Sources rank by code point, null last; weights repeat in that order.  The
    common level is found in one pass over the sources by how early they reach
    their cap, which is where sharing out the excess again and again ends.
    """
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (k % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", k).withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left / heavy)
    ranked = ranked.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(everything))
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """One row for each row of df: doc_id, source, size, source_size, target, taken, times (how often it is taken).

    keep: the columns of df are kept as well, but for those named like one of the
    results.  A null text has size 0.  Null sources are one source, the last.
    Rows with the same id and source have the same hash and share their fate.
    Empty sources have target 0.  The hash is taken from the id and source alone,
    so reruns agree.
    """
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(source_col))), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), hashed.alias("hash")))
    plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    n_sources = plan.count()
    small = F.broadcast if n_sources <= SMALL else (lambda x: x)
    full = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")))
    # budget: what is left of the target after whole rounds; low: the threshold so far; the boundary is [low, low + 2 ** bits).
    state = plan.select(F.col("source").alias("s"), (F.col("target") - full * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("low"), (F.col("target") > full * F.col("source_size")).alias("open"))
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright(F.col("hash"), bits)
        edge = F.shiftright(F.col("low"), bits + LEVEL_BITS)
        rows = sized.join(small(state.where("open")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright(F.col("hash"), bits + LEVEL_BITS) == edge))
        sums = rows.groupBy("s", "budget", bucket.alias("b")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("b"))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        # The first bucket that goes over; the budget shrinks by what lies below it.
        first = over.groupBy("s").agg(F.min(F.struct("b", (F.col("budget") - F.col("upto") + F.col("n")).alias("left"), "n")).alias("x"))
        first = first.select(F.col("s").alias("of"), F.shiftleft("x.b", bits).alias("to"), F.col("x.left").alias("left"), F.col("x.n").alias("n"))
        here = F.col("open") & F.col("to").isNotNull()
        low = F.when(here, F.col("to")).otherwise(F.col("low"))
        if not bits:  # one hash is left: it is taken if that comes nearer
            low = low + F.when(here & (F.col("left") * 2 > F.col("n")), 1).otherwise(0)
        # If no bucket of a source goes over, rounding alone is left of its budget and the threshold lies above all.
        top = F.col("open") & F.col("to").isNull()
        state = cut(state.join(first, F.col("s").eqNullSafe(F.col("of")), "left").select("s", F.when(here, F.col("left")).otherwise(F.col("budget")).alias("budget"), F.when(top, F.lit(2**HASH_BITS)).otherwise(low).alias("low"), here.alias("open")))
    rounds = plan.join(state, F.col("source").eqNullSafe(F.col("s"))).select(F.col("s").alias("__of"), "source_size", "target", full.alias("__full"), F.col("low").alias("__threshold"))
    if keep:
        own, own_size, own_hash = (unused(df, x) for x in ("__source", "__size", "__hash"))
        rows = df.withColumns({own: F.col(source_col), own_size: size, own_hash: hashed}).drop("size", "source_size", "target", "times", "taken").withColumnRenamed(own_size, "size")
    else:
        own, own_hash = "__source", "__hash"
        rows = sized.withColumnRenamed("hash", own_hash).withColumn(own, F.col("source"))
    of, full_rounds, threshold = (unused(rows, x) for x in ("__of", "__full", "__threshold"))
    rows = rows.join(small(rounds.withColumnsRenamed({"__of": of, "__full": full_rounds, "__threshold": threshold})), F.col(own).eqNullSafe(F.col(of)))
    times = (F.col(full_rounds) + F.when(F.col(own_hash) < F.col(threshold), 1).otherwise(0)).cast("long")
    return rows.withColumn("times", times).withColumn("taken", F.col("size") * F.col("times")).drop(own, own_hash, of, full_rounds, threshold)
