"""Operators on embeddings, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import DATA, against_oracle
from pyspark.sql import functions as F

from tidemark.llm import cover_tree, embedding_dedup, hard_negatives, queries
from tidemark.llm.vectors import units

SCHEMA = "vec_id long, embedding array<double>, label int"


def cosine(x, y):
    if x is None or y is None or len(x) != len(y) or not x or any(v is None or not math.isfinite(v) for v in (*x, *y)) or not any(x) or not any(y):
        return -2.0
    x, y = ([math.ldexp(a, -math.frexp(max(map(abs, v)))[1]) for a in v] for v in (x, y))
    return math.fsum(a * b for a, b in zip(x, y)) / (math.sqrt(math.fsum(a * a for a in x)) * math.sqrt(math.fsum(b * b for b in y)))


def linked(rows, least=0.9):
    """rows: (id, vector) -> a sorted list of (id, links, component, kept)."""
    n = len(rows)
    near = [[j for j in range(n) if j != i and rows[i][0] is not None and rows[j][0] is not None and cosine(rows[i][1], rows[j][1]) >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        top = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), top, rows[i][0] == top))
    return sorted(out, key=str)


def near_rows(df, **more):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in embedding_dedup.near_vectors(df, **more).collect()), key=str)


def clustered(rng, n, length):
    """Loose and tight groups, chains, exact and scaled copies."""
    out = []
    while len(out) < n:
        centre = rng.normal(size=length)
        for _ in range(int(rng.integers(1, 9))):
            x = centre + rng.normal(size=length) * rng.choice([0.0, 0.02, 0.2, 0.4])
            out.append((x * rng.choice([1.0, 1.0, 3.5])).tolist())
    return out[:n]


@pytest.mark.parametrize("seed, length", [(1, 3), (2, 8), (3, 40)])
def test_near_vectors_like_brute_force(spark, seed, length, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 60)
    rng = np.random.default_rng(seed)
    rows = list(enumerate(clustered(rng, 260, length)))
    rows += [(1000 + k, rows[5][1]) for k in range(70)]  # one vector that many rows share
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert near_rows(df) == linked(rows)


def test_near_vectors_with_odd_rows(spark):
    v, w = [1.0, 0.0, 0.0], [9.0, 3.0, 3.0]
    rows = [
        (1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [math.nan, 1.0, 0.0]), (8, [math.inf, 1.0, 0.0]), (None, v), (None, None),
        (9, [1.0, 0.0]), (10, [2.0, 0.0]), (11, [-0.0, 1e-300, 0.0]), (12, [0.0, 1e300, 0.0]), (13, w), (13, [-1.0, 0.0, 0.0]), (14, [9.0, 3.0, 3.0, 1.0]), (15, [1.0, 0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, x, "k") for i, x in rows], "vec_id long, embedding array<double>, key string")
    got = near_rows(df)
    want = [x if x[0] is not None else (None, 0, None, True) for x in linked(rows)]
    assert got == sorted(want, key=str)
    assert (14, 1, 14, True) in got  # a cosine of exactly 0.9
    assert near_rows(df.limit(0)) == []
    floats = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.26])], "vec_id long, embedding array<float>")
    assert near_rows(floats) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_tree_covers_and_nests():
    rng = np.random.default_rng(4)
    unit = units(np.array(clustered(rng, 300, 6)))[0]
    order, starts = cover_tree.arrange(unit)
    unit = unit[order]
    for k, radius in enumerate(cover_tree.RADII):
        assert set(starts[k]) <= set(starts[k + 1])  # nested centres
        assert cover_tree.covering(unit, starts[k + 1]).max() <= radius + 1e-3
    assert sorted(order) == list(range(300)) and len(starts) == len(cover_tree.RADII) + 2


def test_a_group_of_copies_is_one_comparison(monkeypatch):
    """Near copies are counted by whole nodes: far fewer cosines than pairs."""
    rng = np.random.default_rng(5)
    unit = units(rng.normal(size=12) + rng.normal(size=(2000, 12)) * 1e-3)[0]
    order, starts = cover_tree.arrange(unit)
    unit = unit[order]
    tree = cover_tree.Tree(unit, unit, np.ones(2000, dtype=np.int64), starts, [cover_tree.covering(unit, s) for s in starts])
    tested = []
    whole = cover_tree.Traversal.test
    monkeypatch.setattr(cover_tree.Traversal, "test", lambda self, level, ia, ib, c: (tested.append(len(ia)), whole(self, level, ia, ib, c))[1])
    found = cover_tree.Traversal(tree, tree, 0.9, np.arange(2000))
    assert (found.found(0) == 2000).all() and (found.labels == 0).all() and sum(tested) < 10


def test_block_pairs_are_left_out_by_radius(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 30))
    rows = np.repeat(units(centres)[0], 100, axis=0) + rng.normal(size=(400, 30)) * 1e-3
    upper = {30: embedding_dedup.fit_upper(units(rows)[0])}
    df = spark.createDataFrame([(k, k, 1, x.tolist()) for k, x in enumerate(rows)], "node_id long, least_id long, copies long, vec array<double>")
    nodes = embedding_dedup.placed(df, upper).groupBy("length", "node").agg(F.count("*").alias("rows"), F.max("angle").alias("angle")).orderBy("length", "node").collect()
    assert len(nodes) == 4 and all(x.node >= 0 for x in nodes)
    first, pairs = embedding_dedup.block_pairs(nodes, upper, 0.9, {30: 50})
    assert sum(n for _, n in first.values()) == 8 and len(pairs) == 4  # each node with itself only


def test_near_vectors_of_the_tables(spark):
    against_oracle(queries.op11_embedding_dedup(spark, f"{DATA}/sf0.001"), queries.OP11_SQL)


# ---- hard negatives ----


def mined(rows, anchors, k=5, scale=256):
    """rows: (id, vector, label) -> what mine() gives, by brute force in Python's integers."""
    part = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, label) in enumerate(part):
        if not anchors(i):
            continue
        scored = sorted((-max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True)))), j, b, other) for b, (j, v, other) in enumerate(part) if b != a and len(v) == len(q))
        for s, j, _, _ in [x for x in scored if x[3] == label][:k]:
            near = [(n, -t) for t, n, _, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, j, r, n, -s, t) for r, (n, t) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, length", [(1, 2), (2, 7), (3, 64)])
def test_mining_like_brute_force(spark, seed, length, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 90)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 9)
    rng = np.random.default_rng(seed)
    vectors = clustered(rng, 400, length)
    vectors[50:80] = [vectors[0]] * 30  # ties
    rows = [(k, v, int(rng.integers(0, 4)) if k < 300 else 7) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 20 == 0).collect()) == mined(rows, lambda i: i % 20 == 0)


def test_mining_with_odd_rows(spark):
    v = [0.5, 0.25]
    rows = [
        (0, v, 1), (0, v, 1), (1, v, 1), (2, [0.49, 0.25], 2), (3, v, None), (4, None, 2), (5, [0.5, None], 2), (6, [math.nan, 0.5], 2), (None, v, 2), (7, [], 2), (8, [0.4, 0.2], 2), (9, [0.45], 2),
        (10, [1e9, 3.0], 1), (11, [1e9, 1.0], 2), (12, [1e300, 0.0], 2), (13, [-1e300, 1e300], 3), (14, [0.0, 0.0], 2), (15, [0.45, 0.2], 2), (15, [0.45, 0.2], 2),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, score string")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect())
    assert got == mined(rows, lambda i: i % 5 == 0) and got
    assert hard_negatives.mine(df.limit(0), F.lit(True)).collect() == []


def test_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(7)
    whole = hard_negatives.integers(units(rng.normal(size=(3000, 64)))[0], 256.0)
    book = hard_negatives.fit(whole[:1000])
    codes, missed = book.encode(whole)
    scores, true = book.scores(whole[:20], codes), whole @ whole[:20].T
    reach = missed[:, None] * np.linalg.norm(whole[:20], axis=1)
    assert (np.abs(scores - true) <= reach * (1 + 1e-6) + 1).all()
    best = np.sort(true, axis=0)[-6]
    assert (scores + reach >= best).mean() < 0.1  # of all rows, those whose vectors are looked at


def test_mining_of_the_tables(spark):
    against_oracle(queries.op13_hard_negatives(spark, f"{DATA}/sf0.01"), queries.OP13_SQL, "sf0.01")
