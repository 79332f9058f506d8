"""Embedding near-dedup: all pairs of a cosine or more, by cover trees of blocks and dual traversals of block pairs.

The upper levels of the tree are fitted on a bounded sample; every vector goes
down them as far as a centre covers it, and where it stops its node's vectors are
dealt to blocks of a bounded number.  Each block gets a cover tree of its own.
Pairs of blocks whose nodes' covering radii rule them out are never made; all
others meet in one task each, by a shuffle, and are traversed together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import cut, discard, map_arrow, scratch_path, stored
from .components import components
from .cover_tree import RADII, SLACK, Traversal, Tree, arrange, covering
from .vectors import as_floats, by_length, matrix_of, units

#: Vectors, and components of vectors, on which the upper levels are fitted at most; a node of them has at least one in SHARE of those.
SAMPLE, SAMPLE_CELLS, SHARE = 4096, 1 << 21, 256
#: Vectors of a block, and components of vectors.
BLOCK, BLOCK_CELLS = 4096, 1 << 20


@dataclass(frozen=True)
class Upper:
    """The upper levels for vectors of one length: centres, and each one's level and parent (-1: the root)."""

    centres: np.ndarray
    level: np.ndarray
    parent: np.ndarray

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest node that covers each unit vector (-1: the root), and the angle to its centre (that of the root: pi)."""
        node, angle = np.full(len(rows), -1), np.full(len(rows), math.pi)
        for level in np.unique(self.level).tolist():
            here = np.flatnonzero(self.level == level)
            cosines = np.where(self.parent[here] == node[:, None], rows @ self.centres[here].T, -2.0)
            best = cosines.argmax(axis=1)
            top = cosines[np.arange(len(rows)), best]
            hit = top >= math.cos(RADII[level])
            node, angle = np.where(hit, here[best], node), np.where(hit, np.arccos(np.clip(top, -1.0, 1.0)), angle)
        return node, angle


def fit_upper(rows: np.ndarray, share: int = SHARE) -> Upper:
    """The nodes of a cover tree over a sample of unit vectors that hold enough of it."""
    order, starts = arrange(rows)
    least, centres, level, parent, above = max(2, len(rows) // share), [], [], [], np.full(len(rows), -1)
    for k in range(len(RADII)):
        begins = starts[k + 1]
        sizes = np.diff(np.append(begins, len(rows)))
        for begin, size in zip(begins[sizes >= least].tolist(), sizes[sizes >= least].tolist(), strict=True):
            centres.append(order[begin])
            level.append(k)
            parent.append(above[begin])
            above[begin : begin + size] = len(centres) - 1
    return Upper(rows[np.asarray(centres, dtype=np.int64)], np.asarray(level, dtype=np.int64), np.asarray(parent, dtype=np.int64))


def _keys(batches: Iterator[pa.RecordBatch], with_vectors: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys: list = [None] * len(batch)
        for places, rows in by_length(batch.column(1)):
            some = units(rows)[1]
            for k, row in zip(places[some].tolist(), rows[some] + 0.0, strict=True):  # -0.0 is 0.0
                keys[k] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
        column = pa.array([k if i is not None else None for k, i in zip(keys, batch.column(0).to_pylist(), strict=True)], pa.binary())
        out = pa.RecordBatch.from_arrays([batch.column(0), column, batch.column(1)], names=["id", "key", "vec"])
        yield out.filter(column.is_valid()) if with_vectors else out.select(["id", "key"])


def sample_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors of the sample by length: those with the least hashes, a bounded number."""
    longest = vectors.agg(F.max(F.size("vec"))).first()[0] or 1
    rows = vectors.select("vec").orderBy(F.xxhash64("key"), "key").limit(max(1, min(SAMPLE, SAMPLE_CELLS // longest))).toArrow()
    return {x.shape[1]: units(x)[0] for _, x in by_length(rows["vec"].combine_chunks())} if rows.num_rows else {}


def placed(vectors: DataFrame, upper: dict[int, Upper]) -> DataFrame:
    """vectors with the length and node of each, and the angle to that node's centre."""
    kind = dict(vectors.dtypes)["vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, node, angle = np.zeros(len(batch), np.int32), np.full(len(batch), -1, np.int32), np.full(len(batch), math.pi)
            for places, rows in by_length(batch.column("vec")):
                length[places] = rows.shape[1]
                if rows.shape[1] in upper and len(upper[rows.shape[1]].centres):
                    node[places], angle[places] = upper[rows.shape[1]].place(units(rows)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), pa.array(node), pa.array(angle)], names=["node_id", "least_id", "copies", "vec", "length", "node", "angle"])

    return map_arrow(vectors.select("node_id", "least_id", "copies", "vec"), run, f"node_id long, least_id long, copies long, vec {kind}, length int, node int, angle double")


def block_pairs(nodes: list, upper: dict[int, Upper], least: float, size: dict[int, int]) -> tuple[dict[tuple[int, int], tuple[int, int]], list[tuple[int, int, int, int]]]:
    """First block and number of blocks of each (length, node); and the pairs of nodes, as ranges of blocks, whose vectors may be near enough.

    nodes: length, node, rows and largest angle; of those there is a bounded number.
    """
    first, at = {}, 0
    for x in nodes:
        n = -(-x.rows // size[x.length])
        first[x.length, x.node] = at, n
        at += n
    pairs = []
    for length in {x.length for x in nodes}:
        own = [x for x in nodes if x.length == length]
        radius = np.array([x.angle for x in own])
        centres = np.array([upper[length].centres[x.node] if x.node >= 0 else np.zeros(length) for x in own])
        root = np.array([x.node < 0 for x in own])
        apart = np.arccos(np.clip(centres @ centres.T, -1.0, 1.0))
        near = (apart <= math.acos(least) + radius[:, None] + radius + SLACK) | root | root[:, None]
        pairs += [(*first[length, own[i].node], *first[length, own[j].node]) for i, j in np.argwhere(np.triu(near)).tolist()]
    return first, pairs


ROW = "block int, place int, node_id long, copies long, linked long, own long, radii array<double>"


def _tree(table: pa.Table) -> tuple[pa.Table, Tree]:
    """A block's rows in tree order, and its tree."""
    table = table.sort_by("place")
    raw = matrix_of(table["vec"], len(table["vec"][0]))
    radii = matrix_of(table["radii"], len(RADII) + 1)  # -1: no node begins here
    starts = [np.flatnonzero(x >= 0) for x in radii.T]
    radius = [x[s] for x, s in zip(radii.T, starts, strict=True)]
    n = len(raw)
    return table, Tree(raw, units(raw)[0], table["copies"].to_numpy(), [*starts, np.arange(n)], [*radius, np.zeros(n)])


def in_blocks(rows: DataFrame, least: float) -> DataFrame:
    """Each block's vectors in the order of its tree, with the radii of nodes that begin there, how many vectors of the block are linked (itself too) and the least of those in its set."""
    kind = dict(rows.dtypes)["vec"]

    def run(table: pa.Table) -> pa.Table:
        vec = table["vec"].combine_chunks()
        raw = matrix_of(vec, len(vec[0]))
        order, starts = arrange(units(raw)[0])
        table, raw = table.take(pa.array(order)), raw[order]
        unit, n = units(raw)[0], len(raw)
        radius = [covering(unit, s) for s in starts]
        tree = Tree(raw, unit, table["copies"].to_numpy(), starts, radius)
        found = Traversal(tree, tree, least, np.arange(n))
        ids = table["node_id"].to_numpy()
        least_of = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least_of, found.labels, ids)
        radii = np.full((n, len(RADII) + 1), -1.0)
        for k in range(len(RADII) + 1):
            radii[starts[k], k] = radius[k]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (len(RADII) + 1)), pa.array(radii.ravel()))
        columns = [table["block"].combine_chunks(), pa.array(np.arange(n, dtype=np.int32)), table["node_id"].combine_chunks(), table["copies"].combine_chunks(), pa.array(found.found(0)), pa.array(least_of[found.labels]), lists, table["vec"].combine_chunks()]
        return pa.Table.from_arrays(columns, names=["block", "place", "node_id", "copies", "linked", "own", "radii", "vec"])

    return rows.groupBy("block").applyInArrow(run, f"{ROW}, vec {kind}")


def across(blocks: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """What pairs of different blocks add: (node_id, null, links) and, between least members of sets, (node_id, other, null)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"node_id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        (left, a), (right, b) = _tree(left), _tree(right)
        sets = np.concatenate([left["own"].to_numpy(), right["own"].to_numpy()])
        names, first, of = np.unique(sets, return_index=True, return_inverse=True)
        found = Traversal(a, b, least, first[of])
        ids, links = np.concatenate([left["node_id"].to_numpy(), right["node_id"].to_numpy()]), np.concatenate([found.found(0), found.found(1)])
        some = links > 0
        tops = sets[found.labels[first]]
        odd = tops != names
        return pa.table({
            "node_id": pa.array(np.concatenate([ids[some], names[odd]])),
            "other": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(tops[odd])]),
            "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(int(odd.sum()), pa.int64())]),
        })

    def side(of: str) -> GroupedData:
        rows = blocks.drop("linked").join(pairs.select(F.col(f"block_{of}").alias("block"), "block_a", "block_b"), "block")
        return rows.toDF(*rows.columns).groupBy("block_a", "block_b")  # renamed, as both sides are of one table

    return side("a").cogroup(side("b")).applyInArrow(run, "node_id long, other long, links long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept: how many other rows' vectors have a cosine of at least `least` (over 0) with a row's, and the smallest id that such links reach.

    One row for each row of df.  Cosines are computed in double precision.
    Vectors that are null, empty, zero or hold a null or non-finite component,
    and rows without an id, link with nothing and are a component of their own;
    so are vectors of another length to each other.  Rows with equal vectors are
    one vector with a count, whatever their number, and link with each other.
    Rows that share an id but not the vector are vectors of their own.  kept:
    whether the id is its component's smallest; true for rows without an id,
    whose component_id is null.

    What is shuffled besides the vectors themselves: those of each pair of
    blocks that the covering radii don't rule out.  For vectors without any
    structure that is every pair of blocks, so the work is then quadratic, in
    tasks of two blocks (BLOCK, BLOCK_CELLS).  Links are counted, never listed.
    """
    spark = df.sparkSession
    rows = as_floats(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")), "vec")
    kind = dict(rows.dtypes)["vec"]
    keyed = map_arrow(rows, lambda x: _keys(x, False), "id long, key binary")
    vectors = map_arrow(rows, lambda x: _keys(x, True), f"id long, key binary, vec {kind}")
    distinct = vectors.groupBy("key").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    paths = [scratch_path(spark) for _ in range(4)]
    distinct = stored(distinct.withColumn("node_id", F.monotonically_increasing_id()), paths[0])
    upper = {n: fit_upper(x) for n, x in sample_of(distinct).items()}
    where = stored(placed(distinct, upper), paths[1])
    nodes = where.groupBy("length", "node").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")).orderBy("length", "node").collect()  # at most those of the upper levels, and a root for each length
    first, near = block_pairs(nodes, upper, least, {x.length: max(2, min(BLOCK, BLOCK_CELLS // x.length)) for x in nodes})
    of_node = spark.createDataFrame([(*k, *v) for k, v in first.items()], "length int, node int, first int, n int")
    block = F.col("first") + F.pmod(F.xxhash64("node_id"), F.col("n")).cast("int")
    dealt = where.join(F.broadcast(of_node), ["length", "node"]).select(block.alias("block"), "node_id", "copies", "vec")
    blocks = stored(in_blocks(dealt, least), paths[2])
    discard(spark, paths[1])

    ranges = spark.createDataFrame(near, "first_a int, n_a int, first_b int, n_b int")
    pairs = ranges.select(F.explode(F.sequence("first_a", F.col("first_a") + F.col("n_a") - 1)).alias("block_a"), "first_a", "first_b", "n_b")
    pairs = pairs.select("block_a", "first_a", "first_b", F.explode(F.sequence("first_b", F.col("first_b") + F.col("n_b") - 1)).alias("block_b")).where("first_a <> first_b or block_a < block_b").select("block_a", "block_b")
    more = stored(across(blocks, pairs, least), paths[3])

    sets = components(more.where("other is not null").select(F.col("node_id").alias("a"), F.col("other").alias("b")))
    links = blocks.select("node_id", F.col("linked").alias("links")).unionByName(more.where("other is null").select("node_id", "links")).groupBy("node_id").agg(F.sum("links").alias("links"))
    known = blocks.select("node_id", "own").join(links, "node_id").join(distinct.select("node_id", "key", "least_id"), "node_id")
    known = known.join(sets.withColumnRenamed("node", "own"), "own", "left").select("key", "least_id", "links", F.coalesce("component", "own").alias("set"))
    known = cut(known)
    for path in (paths[0], *paths[2:]):
        discard(spark, path)
    smallest = known.groupBy("set").agg(F.min("least_id").alias("component_id"))
    of_key = known.join(smallest, "set").select("key", "links", "component_id")
    found = keyed.where("key is not null").join(of_key, "key").select("id", F.col("links") - 1, "component_id")
    alone = keyed.where("key is null").select("id", F.lit(0).cast("long"), "id")
    out = found.union(alone).toDF("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
