"""Cover trees over unit vectors, and the dual traversal that finds all pairs of a cosine or more.

Distances are angles.  Levels are nested: a node's centre is its first vector and
stays the centre of a node on every level below; radii halve from one level to
the next, and vectors lie in the order of the tree, so that a node is a range of
them.  A pair of nodes is left out if its centres are further apart than the
threshold and both covering radii, which are measured, not those of the level;
it is taken whole if no two of its vectors can be further apart than the
threshold; else its children are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .vectors import scaled

#: Radii of the levels between the root, which covers all, and the vectors.
RADII = tuple(math.pi / 2**k for k in range(2, 7))
#: Slack of angles, which arccos gives to about 2e-8 where they are small.
SLACK = 1e-7
#: Cosines so near to the threshold are computed again from the vectors as they came.
NEAR = 1e-9
#: Pairs that are compared at once, and rows of a tile.
PAIRS, TILE = 1 << 16, 512


@dataclass
class Tree:
    """vectors as they came and units, in tree order; weights: what a vector counts for; starts and radius of each level's nodes."""

    vectors: np.ndarray
    units: np.ndarray
    weights: np.ndarray
    starts: list[np.ndarray]
    radius: list[np.ndarray]

    def __post_init__(self) -> None:
        n = len(self.units)
        self.narrow = self.units.astype(np.float32)
        self.ends = [np.append(s[1:], n) for s in self.starts]
        upto = np.concatenate([[0], np.cumsum(self.weights)])
        self.weight = [upto[e] - upto[s] for s, e in zip(self.starts, self.ends, strict=True)]

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node, and how many it has."""
        first = np.searchsorted(self.starts[level + 1], self.starts[level])
        return first, np.searchsorted(self.starts[level + 1], self.ends[level]) - first


def arrange(units: np.ndarray, radii: tuple[float, ...] = RADII) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of a tree over units, and where the nodes of each level begin in it; the last level is the vectors."""
    narrow = units.astype(np.float32)
    cosines = narrow @ narrow.T
    nodes, starts = [np.arange(len(units))], [np.zeros(1, dtype=np.int64)]
    for radius in radii:
        least, split = math.cos(radius), []
        for left in nodes:
            while len(left):
                if len(left) == 1:
                    split.append(left)
                    break
                covered = cosines[left[0], left] >= least
                covered[0] = True
                split.append(left[covered])
                left = left[~covered]
        nodes = split
        starts.append(np.cumsum([0, *(len(x) for x in nodes[:-1])]))
    starts.append(np.arange(len(units)))
    return np.concatenate(nodes), starts


def covering(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The largest angle between each node's centre and its vectors, in tree order."""
    sizes = np.diff(np.append(starts, len(units)))
    cosines = np.einsum("ij,ij->i", units, units[np.repeat(starts, sizes)])
    out = np.maximum.reduceat(np.arccos(np.clip(cosines, -1.0, 1.0)), starts)
    return np.where(sizes > 1, out, 0.0)


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the place of its set's first member) after the sets of a and of b are joined, pair by pair."""
    while len(a):
        a, b = labels[a], labels[b]
        odd = a != b
        a, b = a[odd], b[odd]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (deeper := labels[labels]).tobytes() != labels.tobytes():
            labels = deeper
    return labels


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Traversal:
    """Pairs of vectors of two trees (or of one with itself) whose cosine is at least `least`.

    found_a and found_b: for each vector the weight of the other tree's vectors
    it is linked with.  labels: sets of linked vectors, b's after a's; within
    one tree with itself b's are a's.
    """

    def __init__(self, a: Tree, b: Tree, least: float, labels: np.ndarray):
        self.a, self.b, self.least, self.angle, self.labels = a, b, least, math.acos(least), labels
        self.shift = 0 if a is b else len(a.units)
        self.counts = [[np.zeros(len(s), dtype=np.int64) for s in tree.starts] for tree in (a, b)]
        self.starred = [[np.zeros(len(s), dtype=bool) for s in tree.starts] for tree in (a, b)]
        self.run()

    def run(self) -> None:
        left = [np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)]
        cosines = np.einsum("ij,ij->i", self.a.units[:1], self.b.units[:1])
        left = self.test(0, *left, cosines)
        for level in range(1, len(self.a.starts)):
            kept = [self.test(level, *x) for x in self.expanded(level - 1, *left)]
            left = [np.concatenate([k[i] for k in kept]) if kept else np.zeros(0, dtype=np.int64) for i in (0, 1)]

    def expanded(self, level: int, ia: np.ndarray, ib: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of children, with their centres' cosines, of pairs of nodes; those that are certainly too far apart may be missing."""
        (fa, na), (fb, nb) = self.a.children(level), self.b.children(level)
        size = na[ia] * nb[ib]
        large = size >= TILE
        for i, j in zip(ia[large].tolist(), ib[large].tolist(), strict=True):
            yield from self.tiles(level + 1, fa[i], na[i], fb[j], nb[j])
        ia, ib, size = ia[~large], ib[~large], size[~large]
        upto = np.cumsum(size)
        at = 0
        while at < len(ia):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            i, j, n = ia[at:end], ib[at:end], size[at:end]
            within = ranges(np.zeros(len(n), dtype=np.int64), n)
            wide = np.repeat(nb[j], n)
            ca, cb = np.repeat(fa[i], n) + within // wide, np.repeat(fb[j], n) + within % wide
            yield ca, cb, self.cosines(level + 1, ca, cb)
            at = end

    def cosines(self, level: int, ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.a.units[self.a.starts[level][ca]], self.b.units[self.b.starts[level][cb]])

    def tiles(self, level: int, fa: int, na: int, fb: int, nb: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs of two ranges of nodes by matrix products, the tightest nodes first, so that most tiles have a high bound."""
        ra, rb = self.a.radius[level], self.b.radius[level]
        ca, cb = fa + np.argsort(ra[fa : fa + na], kind="stable"), fb + np.argsort(rb[fb : fb + nb], kind="stable")
        slack = 1e-6 + 2e-7 * self.a.units.shape[1]  # of a product of floats
        for i in range(0, na, TILE):
            rows = ca[i : i + TILE]
            own = self.a.starts[level][rows]
            for j in range(0, nb, 8 * TILE):
                columns = cb[j : j + 8 * TILE]
                other = self.b.starts[level][columns]
                reach = min(math.pi, self.angle + ra[rows].max() + rb[columns].max() + SLACK)
                x, y = np.nonzero(self.a.narrow[own] @ self.b.narrow[other].T >= math.cos(reach) - slack)
                exact = self.a.units[own] @ self.b.units[other].T if 8 * len(x) > len(rows) * len(columns) else None
                for k in range(0, len(x), PAIRS):
                    u, v = x[k : k + PAIRS], y[k : k + PAIRS]
                    pair = rows[u], columns[v]
                    yield *pair, exact[u, v] if exact is not None else self.cosines(level, *pair)

    def test(self, level: int, ia: np.ndarray, ib: np.ndarray, cosines: np.ndarray) -> list[np.ndarray]:
        """The pairs whose children must be compared; what is linked is noted."""
        a, b = self.a, self.b
        one = (a.ends[level][ia] - a.starts[level][ia] == 1) & (b.ends[level][ib] - b.starts[level][ib] == 1)
        linked = one & (cosines >= self.least)
        for k in np.flatnonzero(one & (np.abs(cosines - self.least) < NEAR)).tolist():
            x, y = scaled(a.vectors[a.starts[level][ia[k]]]), scaled(b.vectors[b.starts[level][ib[k]]])
            linked[k] = (x @ y) / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= self.least
        apart = np.arccos(np.clip(cosines, -1.0, 1.0))
        reach = a.radius[level][ia] + b.radius[level][ib]
        whole = linked | (~one & (apart + reach <= self.angle - SLACK))
        self.link(level, ia[whole], ib[whole])
        left = ~one & ~whole & (apart <= self.angle + reach + SLACK)
        return [ia[left], ib[left]]

    def link(self, level: int, ia: np.ndarray, ib: np.ndarray) -> None:
        a, b = self.a, self.b
        for side, tree, mine, other in ((0, a, ia, b.weight[level][ib]), (1, b, ib, a.weight[level][ia])):
            np.add.at(self.counts[side][level], mine, other)
            new = np.unique(mine[~self.starred[side][level][mine]])
            self.starred[side][level][new] = True
            starts, sizes = tree.starts[level][new], tree.ends[level][new] - tree.starts[level][new]
            # All vectors of the node are linked with those of the other one, and so are in one set.
            shift = self.shift * side
            self.labels = unite(self.labels, np.repeat(starts, sizes) + shift, ranges(starts, sizes) + shift)
        self.labels = unite(self.labels, a.starts[level][ia], b.starts[level][ib] + self.shift)

    def found(self, side: int) -> np.ndarray:
        tree = (self.a, self.b)[side]
        return sum(np.repeat(c, e - s) for c, s, e in zip(self.counts[side], tree.starts, tree.ends, strict=True))
