"""Grouped prefix join: documents whose sets of word shingles are alike, and the components they form.

Two sets that are alike enough share one of the first shingles of each in any
common order (prefix filter).  The order here puts rare shingles first.  How
rare is counted over all documents in a fixed number of hash buckets, once for
words and once for shingles; a shingle is at most as frequent as either bucket
says.  The order costs a byte a bucket to send, whatever the corpus, and any
order is right: a coarse one only tests more pairs.

Equal sets are one class, and classes with the same prefix and size one group.
Groups meet by shingle of their prefixes.  To find components it isn't needed
to test all pairs of a list: first each group is tested against its list's
pivot, which gathers nearly all copies (the pivot has the list's shingle
earliest, so the fewest rarer ones of its own: it is the least edited); then all pairs that are left
between different components are tested as well, so no link between components
is lost.  Every test counts the exact intersection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, map_arrow, scratch_path, shingle_hashes, small_enough, stored, word_hashes
from .components import components

#: Buckets of the counts of words and of shingles (powers of two), and words of a shingle.
WORD_BITS, SHINGLE_BITS, WORDS = 20, 21, 3
#: Groups of a list that meet those of another component in one key; longer lists are dealt out in squares of that side.
SIDE = 512
#: Buckets in a row of counts.
_CHUNK = 1 << 16
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 90


def _bucket(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of `size` buckets, a power of two."""
    return (hashes >> np.uint64(65 - size.bit_length())).astype(np.int32)


def levels(df: DataFrame, text_col: str, n: int, bits: tuple[int, int] = (WORD_BITS, SHINGLE_BITS)) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket of words, and of shingles, the logarithm of how often they occur in all texts, in eighths, as a byte.

    A task sends its counts in 2 ** bits places of each kind, compressed, and as
    many bytes come to the driver, whatever the corpus.
    """
    sizes = (1 << bits[0], 1 << bits[1])

    def packed(x: np.ndarray) -> bytes:
        return pa.compress(x.tobytes(), codec="zstd", asbytes=True)

    def unpacked(chunk: int, raw: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, 4 * min(_CHUNK, sum(sizes) - chunk), codec="zstd"), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting = np.zeros(sum(sizes), np.uint32), []

        def add():
            nonlocal counts, waiting
            if waiting:
                at, times = np.unique(np.concatenate(waiting), return_counts=True)
                counts[at] += times.astype(np.uint32)
                waiting = []

        for batch in batches:
            words, at = word_hashes(batch.column(0))
            waiting.append(_bucket(words, sizes[0]))
            if len(words) >= n:
                whole = np.ones(len(words) - n + 1, bool)  # shingles that lie within one text
                for i in range(1, n):
                    inner = at[1:-1] - i
                    whole[inner[(inner >= 0) & (inner < len(whole))]] = False
                waiting.append(_bucket(shingle_hashes(words, n)[whole], sizes[1]) + sizes[0])
            if sum(map(len, waiting)) > 500_000:
                add()
        add()
        parts = range(0, len(counts), _CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([packed(counts[i : i + _CHUNK]) for i in parts], pa.binary())], names=["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unpacked(chunk, raw).astype(np.int64)
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        rows = [packed(np.minimum(x, 2**32 - 1).astype(np.uint32)) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "counts"])

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in total(batches):
            rows = [np.minimum(255, 8 * np.log2(1 + unpacked(chunk, raw))).astype(np.uint8).tobytes() for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["chunk", "level"])

    # Added up in two steps, so that no task reads more than about the square root of the number of tasks.
    texts = df.select(text_col)
    steps = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    parts = map_arrow(texts, run, "chunk int, counts binary").withColumn("step", F.spark_partition_id() % steps)
    parts = map_arrow(parts.repartition("chunk", "step").select("chunk", "counts"), total, "chunk int, counts binary")
    got = map_arrow(parts.repartition("chunk"), level, "chunk int, level binary").toArrow()
    out = np.zeros(sum(sizes), np.uint8)
    for chunk, raw in zip(got["chunk"].to_pylist(), got["level"].to_pylist(), strict=True):
        out[chunk : chunk + _CHUNK] = np.frombuffer(raw, np.uint8)
    return out[: sizes[0]], out[sizes[0] :]


def ordered_set(words: np.ndarray, order: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The distinct shingles of a text, the rarest first."""
    shingles = shingle_hashes(words, n)
    if not len(shingles):
        return shingles
    own = order[0][_bucket(words, len(order[0]))]
    level = order[1][_bucket(shingles, len(order[1]))] if len(words) >= n else own[:1]
    for i in range(min(n, len(words))):
        level = np.minimum(level, own[i : len(shingles) + i])
    distinct, first = np.unique(shingles, return_index=True)
    return distinct[np.argsort(level[first], kind="stable")]


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _prefixes(df: DataFrame, order: tuple[np.ndarray, np.ndarray], n: int, percent: int) -> DataFrame:
    """doc_id, n (set size), class (digest of the set), sig (digest of prefix and size), prefix."""
    shared = df.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(batch.column(1))
            sizes, classes, sigs, parts = [], [], [], []
            for i in range(len(batch)):
                x = ordered_set(words[at[i] : at[i + 1]], shared.value, n)
                prefix = x[: prefix_length(len(x), percent)]
                sizes.append(len(x))
                classes.append(xxhash.xxh3_128_hexdigest(np.sort(x).tobytes()))
                sigs.append(xxhash.xxh3_128_hexdigest(prefix.tobytes() + len(x).to_bytes(8, "little")))
                parts.append(prefix)
            offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            values = pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes), pa.array(sigs), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "n", "class", "sig", "prefix"])

    return map_arrow(df, run, "doc_id long, n long, class string, sig string, prefix array<long>")


def _sets(df: DataFrame, n: int) -> DataFrame:
    """id, set: the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(batch.column(1))
            parts = [np.unique(shingle_hashes(words[at[i] : at[i + 1]], n)) for i in range(len(batch))]
            offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            values = pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "set"])

    return map_arrow(df, run, "id long, set array<long>")


def alike(common: Column, a: Column, b: Column, percent: int) -> Column:
    return common * 100 >= (a + b - common) * percent


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether two groups of sizes n that share a shingle at positions pos can be alike, if it is the first they share."""
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    return alike(F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos")), n, m, percent)


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose sets are alike.  Only texts of documents in pairs are read into sets."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cut(_sets(docs.join(small_enough(ids), "doc_id", "left_semi"), n))
    left, right = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    tested = pairs.join(left, "a").join(right, "b")
    return tested.where(alike(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b"), percent)).select("a", "b").distinct()


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of df of which the id is the smallest of its component, with all their columns; of repeated ids one row.

    Texts without words and rows without an id all stay.
    """
    found = cut(near_components(df, id_col, text_col, n, percent))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    out = df.join(small_enough(cut(gone)), id_col, "left_anti").select(df.columns)
    again = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col)))
    if again.isEmpty():
        return out
    again = small_enough(again)
    return out.join(again, id_col, "left_anti").select(df.columns).unionByName(out.join(again, id_col, "left_semi").select(df.columns).dropDuplicates([id_col]))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT, bits: tuple[int, int] = (WORD_BITS, SHINGLE_BITS)) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of df.

    Words are runs of characters other than ASCII white space, A to Z lowered.
    A text of fewer than n words is one shingle; null, empty and blank texts have
    none and link with nothing.  Rows that share an id are one document: they are
    linked.  A null id has a null component and links nothing.  Other columns
    aren't read.  bits: of the buckets in which words and shingles are counted.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(_prefixes(docs, levels(docs, "text", n, bits), n, percent))
    full = rows.where("n > 0 and doc_id is not null")
    # Prefixes are kept once and shuffled once, with their groups; classes are narrow.
    classes = cut(full.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    # One struct, of which nothing is pruned: counting the lists and filling them then read the same shuffle.
    groups = full.groupBy("sig").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("x")).select(F.col("x.doc_id").alias("g"), "x.n", "x.prefix")
    several = classes.groupBy("sig").agg(F.min("rep").alias("g"), F.count("*").alias("members")).where("members > 1").select("sig", "g")
    # Groups of one are their own only member and aren't listed.
    members = cut(classes.join(several, "sig").select("g", "rep"))

    # Narrow rows, counted before anything else is looked for: most shingles are of one group only.
    postings = groups.select("g", F.posexplode("prefix").alias("pos", "t"), F.col("n").cast("int").alias("n")).select("t", "g", "pos", "n")
    lists = postings.groupBy("t").agg(F.count("*").alias("k")).where("k > 1").select("t")
    shared_at, listed_at = scratch_path(df.sparkSession), scratch_path(df.sparkSession)
    shared = stored(postings.join(lists, "t").select("t", F.struct("g", "n", "pos").alias("x")), shared_at)

    # Each group against the pivots of its lists, each member against its group's smallest.
    pivots = shared.groupBy("t").agg(F.min(F.struct("x.pos", "x.g", "x.n")).alias("p"))
    with_pivot = shared.join(pivots, "t").where(F.col("x.g") != F.col("p.g")).where(_possible("x", "p", percent)).select(F.col("p.g").alias("a"), F.col("x.g").alias("b"))
    first = cut(with_pivot.unionByName(members.where("g <> rep").select(F.col("g").alias("a"), F.col("rep").alias("b"))).distinct())
    links = cut(_verified(first, docs, n, percent))

    # What is left: pairs in one list, or in one group, that aren't in one component yet.
    part = components(links)
    of_members = members.join(part, F.col("rep") == F.col("node"), "left").select("g", "rep", F.coalesce("component", "rep").alias("c"))
    spread = of_members.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    listed = shared.select("t", "x").join(spread, F.col("x.g") == F.col("g"), "left").drop("g").join(part, F.col("x.g") == F.col("node"), "left")
    listed = listed.select("t", "x", F.coalesce("low", "component", "x.g").alias("low"), F.coalesce("high", "component", "x.g").alias("high"))
    per_part = listed.groupBy("t", "low").agg(F.count("*").alias("k"), F.max("high").alias("high"))
    mixed = per_part.groupBy("t").agg(F.max(F.struct("k", "low")).alias("most"), F.min("low").alias("least"), F.max("high").alias("top"), F.sum("k").alias("k")).where("least < top").select("t", F.col("most.low").alias("most"), "k")
    # A long list is split into parts, and each pair of parts is a key of its own: no task gets the square of a list.
    parts = F.ceil(F.col("k") / SIDE).cast("int")
    listed = stored(listed.join(mixed, "t").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("x.g"), F.col("parts")).cast("int")).drop("k"), listed_at)
    discard(df.sparkSession, shared_at)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # The largest component of a list isn't paired with itself: one side is always of another.
    other = listed.where("low <> most or low <> high").select("t", F.col("x").alias("y"), F.col("low").alias("y_low"), F.col("high").alias("y_high"), F.col("part").alias("y_part"), every.alias("part"))
    near = listed.withColumn("y_part", every).join(other, ["t", "part", "y_part"]).where((F.col("x.g") != F.col("y.g")) & ~((F.col("low") == F.col("high")) & (F.col("y_low") == F.col("y_high")) & (F.col("low") == F.col("y_low"))) & _possible("x", "y", percent))
    near = near.select(F.least("x.g", "y.g").alias("g1"), F.greatest("x.g", "y.g").alias("g2")).unionByName(spread.where("low < high").select(F.col("g").alias("g1"), F.col("g").alias("g2"))).distinct()
    expand = lambda x, g, a: x.join(of_members.select(F.col("g").alias(g), F.col("rep").alias(a), F.col("c").alias(f"c_{a}")), g, "left").withColumn(a, F.coalesce(a, g))
    pairs = expand(expand(near, "g1", "a"), "g2", "b").where("a <> b and not coalesce(c_a = c_b, false)")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    pairs = cut(pairs)
    discard(df.sparkSession, listed_at)
    if not pairs.isEmpty():
        links = links.unionByName(_verified(pairs, docs, n, percent))

    # Rows that share an id but not a set are linked by the id.
    twice = full.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("doc_id")
    by_id = full.join(twice, "doc_id", "left_semi").join(classes.select("class", "rep"), "class").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    part = components(links.unionByName(by_id))
    final = classes.select("class", "rep").join(part, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class")).join(final, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
