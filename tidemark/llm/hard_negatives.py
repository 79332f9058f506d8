"""Hard-negative mining: product-quantised scores with rigorous bounds, and exact integer scores of what they leave.

Vectors become integers (floor(scale * x)).  Each is kept as one code for every
WIDTH components and the norm of what the codes miss.  For an anchor, the sum of
a table's entries gives every row's score to within the product of the anchor's
norm and that residual norm, so a row whose bounds can't reach a window, or whose
upper bound is below what enough rows of the window surely have, is left out
without its vector being looked at.  What is left is scored exactly.

Anchors and rows are dealt to tiles, a bounded number of each, which meet by a
shuffle; each tile gives the best few of its rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored
from .vectors import as_floats, by_length, matrix_of

#: Components of a code, codes, and rows (or components of rows) on which codebooks are fitted at most.
WIDTH, CODES, SAMPLE, SAMPLE_CELLS, ROUNDS = 2, 256, 4096, 1 << 21, 5
#: Rows and anchors of a tile, or components of them; anchors that are scored together.
ROWS, ANCHORS, CELLS, TOGETHER = 16384, 1024, 1 << 20, 32
#: Integers from here on are not coded; such rows are always scored exactly.
LARGE = 2.0**31


@dataclass(frozen=True)
class Codebook:
    """For each run of WIDTH components its centroids, (codes, components)."""

    centroids: list[np.ndarray]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and norms of what they miss."""
        codes, missed = np.zeros((len(rows), len(self.centroids)), np.uint8), np.zeros(len(rows))
        for m, c in enumerate(self.centroids):
            part = rows[:, m * WIDTH : m * WIDTH + c.shape[1]]
            codes[:, m] = nearest(part, c)
            missed += ((part - c[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(missed)

    def scores(self, anchors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of coded rows with anchors, (rows, anchors), by looking up each code."""
        out = np.zeros((len(codes), len(anchors)), np.float32)
        for m, c in enumerate(self.centroids):
            table = (c @ anchors[:, m * WIDTH : m * WIDTH + c.shape[1]].T).astype(np.float32)
            out += table[codes[:, m]]
        return out


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows @ centroids.T - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)


def fit(rows: np.ndarray) -> Codebook:
    """k-means in each subspace, begun at evenly spaced rows by their first component; the bounds hold whatever it finds."""
    out = []
    for at in range(0, rows.shape[1], WIDTH):
        part = rows[:, at : at + WIDTH]
        part = part[np.lexsort(part.T[::-1])]
        centroids = np.unique(part[np.linspace(0, len(part) - 1, CODES).astype(int)], axis=0)
        for _ in range(ROUNDS):
            of = nearest(part, centroids)
            sizes = np.bincount(of, minlength=len(centroids))
            sums = np.stack([np.bincount(of, weights=x, minlength=len(centroids)) for x in part.T], axis=1)
            centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        out.append(centroids)
    return Codebook(out)


def integers(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles, with the largest finite one where that overflows."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * scale), -np.finfo(float).max, np.finfo(float).max)


def exact(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; those beyond 64 bits count as the largest or smallest of 64 bits."""
    if not len(rows):
        return np.zeros(0, np.int64)
    if np.abs(anchor).max() < LARGE and np.abs(rows).max() < LARGE and np.abs(anchor).max() * np.abs(rows).max() * len(anchor) < 2.0**53:
        return (rows @ anchor).astype(np.int64)
    q, top = [int(x) for x in anchor], 2**63 - 1
    return np.array([max(-top, min(top, sum(a * int(b) for a, b in zip(q, row, strict=True)))) for row in rows], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id and then `more`."""
    return np.lexsort((more, ids, -scores))[:k]


def at_least(lower: np.ndarray, k: int) -> float:
    """What k of these surely reach; -inf if there are fewer."""
    return float(np.partition(lower, len(lower) - k)[len(lower) - k]) if len(lower) >= k else -np.inf


@dataclass
class Rows:
    """A tile's rows: row and vector ids, labels as codes, integers, codes, and norms for the bounds."""

    table: pa.Table
    ids: np.ndarray
    vec_ids: np.ndarray
    integers: np.ndarray
    codes: np.ndarray
    off: np.ndarray

    @staticmethod
    def of(table: pa.Table, scale: float) -> Rows:
        length = table["length"][0].as_py()
        whole = integers(matrix_of(table["vec"], length), scale)
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        missed = table["missed"].to_numpy()
        # What the sum of floats in scores() can be off by, as a share of both norms, counts as missed too.
        with np.errstate(over="ignore"):
            off = missed * (1 + 1e-9) + (codes.shape[1] + 8) * 2.4e-7 * (np.sqrt((whole * whole).sum(axis=1)) + missed)
        return Rows(table, table["row"].to_numpy(), table["id"].to_numpy(), whole, codes, off)


def bounds(book: Codebook, anchors: Rows, rows: Rows, labels: tuple[np.ndarray, np.ndarray], same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor: its place, the places of rows that count (of its label or of others, not itself), and the least and most that each can score."""
    for label in np.unique(labels[0]).tolist():
        own = np.flatnonzero(labels[0] == label)
        counted = np.flatnonzero((labels[1] == label) == same)
        if not len(counted):
            continue
        for at in range(0, len(own), TOGETHER):
            some = own[at : at + TOGETHER]
            q = anchors.integers[some]
            small = np.abs(q).max(axis=1) < LARGE
            scores = book.scores(np.where(small[:, None], q, 0.0), rows.codes[counted])
            for k, a in enumerate(some.tolist()):
                reach = np.sqrt(q[k] @ q[k]) * rows.off[counted] if small[k] else np.full(len(counted), np.inf)
                if same:
                    other = rows.ids[counted] != anchors.ids[a]
                    yield a, counted[other], (scores[:, k] - reach)[other], (scores[:, k] + reach)[other]
                else:
                    yield a, counted, scores[:, k] - reach, scores[:, k] + reach


def positives_of(book: Codebook, anchors: Rows, rows: Rows, labels: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple]:
    """(anchor row, anchor id, 0, row, id, score) of each anchor's k best rows of its own label."""
    for a, places, lower, upper in bounds(book, anchors, rows, labels, True):
        left = places[upper >= at_least(lower, k)]
        scores = exact(anchors.integers[a], rows.integers[left])
        for p in best(scores, rows.vec_ids[left], rows.ids[left], k):
            yield int(anchors.ids[a]), int(anchors.vec_ids[a]), 0, int(rows.ids[left[p]]), int(rows.vec_ids[left[p]]), int(scores[p])


def negatives_of(book: Codebook, anchors: Rows, rows: Rows, labels: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple]:
    """(anchor row, anchor id, place of the window, row, id, score) of the k best rows of other labels in each of an anchor's windows."""
    windows = anchors.table["windows"].to_pylist()
    for a, places, lower, upper in bounds(book, anchors, rows, labels, False):
        for w in windows[a]:
            low, high = w["low"], w["high"]
            if low > high:
                continue
            sure = at_least(lower[(lower >= low) & (upper <= high)], k)
            left = places[(upper >= max(low, sure)) & (lower <= high)]
            scores = exact(anchors.integers[a], rows.integers[left])
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            for p in inside[best(scores[inside], rows.vec_ids[left[inside]], rows.ids[left[inside]], k)]:
                yield int(anchors.ids[a]), int(anchors.vec_ids[a]), w["place"], int(rows.ids[left[p]]), int(rows.vec_ids[left[p]]), int(scores[p])


FOUND = "anchor long, anchor_id long, place int, row long, id long, score long"


def tiled(anchors: DataFrame, rows: DataFrame, sizes: DataFrame, books: dict[int, Codebook], scale: float, k: int, negatives: bool) -> DataFrame:
    """Every anchor against every row of its length, tile by tile; sizes: length, row_tiles, anchor_tiles."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            codes = pa.chunked_array([*left["label"].chunks, *right["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            labels = codes[: left.num_rows], codes[left.num_rows :]
            a, b = Rows.of(left, scale), Rows.of(right, scale)
            out = list((negatives_of if negatives else positives_of)(books[left["length"][0].as_py()], a, b, labels, k))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["anchor", "anchor_id", "place", "row", "id", "score"])

    def side(df: DataFrame, own: str, other: str) -> GroupedData:
        tiles = df.join(F.broadcast(sizes), "length").withColumn(f"{own}_tile", F.pmod(F.xxhash64("row"), F.col(f"{own}_tiles")))
        tiles = tiles.withColumn(f"{other}_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_tiles") - 1))).drop("row_tiles", "anchor_tiles")
        return tiles.toDF(*tiles.columns).groupBy("length", "row_tile", "anchor_tile")

    return side(anchors, "anchor", "row").cogroup(side(rows, "row", "anchor")).applyInArrow(run, FOUND)


def coded(rows: DataFrame, books: dict[int, Codebook], scale: float) -> DataFrame:
    """Rows (row, id, label, anchor, vec) that take part, with the length of the vector, its codes and the norm that they miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, vectors in by_length(batch.column("vec")):
                whole = integers(vectors, scale)
                large = np.abs(whole).max(axis=1) >= LARGE
                codes, missed = books[whole.shape[1]].encode(np.where(large[:, None], 0.0, whole))
                part = batch.take(pa.array(places))
                more = [pa.array(np.full(len(places), whole.shape[1], np.int32)), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(np.where(large, np.inf, missed))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=["row", "id", "label", "anchor", "vec", "length", "codes", "missed"])

    return map_arrow(rows, run, f"row long, id long, label string, anchor boolean, vec {dict(rows.dtypes)['vec']}, length int, codes binary, missed double")


def codebooks(rows: DataFrame, scale: float) -> dict[int, Codebook]:
    """A codebook for each length of vectors, fitted on a bounded sample by hash; one for a length outside the sample has zeros only."""
    sizes = rows.where("vec is not null").groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).collect()  # one row for each length
    longest = max((x.n for x in sizes), default=1)
    sample = rows.where("vec is not null").select("vec").orderBy(F.xxhash64("row"), "row").limit(max(1, min(SAMPLE, SAMPLE_CELLS // max(1, longest)))).toArrow()
    known = {}
    if sample.num_rows:
        for _, vectors in by_length(sample["vec"].combine_chunks()):
            whole = integers(vectors, scale)
            whole = whole[np.abs(whole).max(axis=1) < LARGE]
            if len(whole):
                known[whole.shape[1]] = fit(whole)
    return {x.n: known.get(x.n) or fit(np.zeros((1, x.n))) for x in sizes if x.n > 0}


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive the best rows of other labels that score nearly as high.

    Components x become floor(scale * x); a score is the integer inner product
    with the anchor (beyond 64 bits, the largest of 64 bits), higher first, ties
    by id.  anchors: which rows are; an anchor's positives are its first
    `positives` other rows of the same label, and its negatives are the first
    `negatives` rows of other labels whose score lies between `share` of the
    positive's and the positive's.  All, if there are fewer.  Rows with a null
    id or label, or a vector that is null, empty or holds a null or non-finite
    component, take no part.  Rows are told apart by their place, not their id:
    a repeated row is another row.  Vectors of another length than the anchor's
    don't count for it.

    Every anchor is held against every row; nothing is cut off but what the
    bounds rule out.  A tile has ROWS rows and ANCHORS anchors (fewer for long
    vectors), each row goes to as many tiles as there are of anchors.
    """
    spark = df.sparkSession
    rows = as_floats(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vec")), "vec")
    rows = rows.where("id is not null and label is not null")
    books = codebooks(rows, scale)
    rows = stored(coded(rows, books, scale))  # row numbers are settled by this
    counts = rows.groupBy("length").agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).collect()
    tiles = lambda n, most, length: max(1, -(-n // max(1, min(most, CELLS // length))))
    sizes = spark.createDataFrame([(x.length, tiles(x.rows, ROWS, x.length), tiles(x.anchors, ANCHORS, x.length)) for x in counts], "length int, row_tiles long, anchor_tiles long")
    queries = rows.where("anchor").drop("anchor")
    rows = rows.drop("anchor")
    ranked = lambda found, keys, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row"))).where(F.col("rank") <= k)
    near = stored(ranked(tiled(queries, rows, sizes, books, scale, positives, False), ["anchor"], positives))
    low = F.ceil(F.col("score").cast("decimal(38,0)") * share[0] / share[1]).cast("long")
    windows = near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("rank").alias("place"), low.alias("low"), F.col("score").alias("high"))).alias("windows"))
    asking = queries.join(windows, F.col("row") == F.col("anchor")).drop("anchor")
    hard = ranked(tiled(asking, rows, sizes, books, scale, negatives, True), ["anchor", "place"], negatives)
    of = near.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(of, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
