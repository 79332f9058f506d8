"""Benchmark decontamination by latent semantic retrieval.

Texts are read as passages of words.  The terms are those of the benchmark that
aren't common in the corpus.  One pass counts the passages with each term;
one sums the Gram matrix of their TF-IDF vectors times a random matrix, from
which the leading right singular vectors follow (randomised SVD of a positive
matrix, Nystroem form: Halko, Martinsson and Tropp, 2011; Tropp et al., 2017).
The benchmark's own vectors are added to that matrix with a large weight, so that
the latent space has their directions however rare a leak is.  The last pass
projects every window of every text, takes those whose cosine with an item is
high or that hold enough of the item's own weight, whatever else they hold, and
checks them word by word: the longest common subsequence with the item, and
whether the item's answer is there, which paraphrases keep.

The benchmark is taken in blocks with a latent space each, and a pass over the
texts, which are read whole, serves as many blocks as are sent to the tasks
together: what is sent is bounded whatever the benchmark's size, and three passes
do for GROUP * BLOCK_ITEMS items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_list, coded_words, map_arrow

#: Items of a block, and dimensions of the latent space beyond one for each of them.
BLOCK_ITEMS, EXTRA_RANK = 256, 32
#: Blocks that one pass over the texts serves; each has some 10 MB of a task's memory.
GROUP = 8
#: Words of a passage or window, and from one window's start to the next.
WINDOW, HOP = 48, 12
#: A term is common if more than this share of passages has it; each item keeps its rarest terms even so.
COMMON, KEPT_TERMS = 0.01, 6
COSINE = 0.5
#: Share of an item's squared weight that a window holds, however much its other words dilute the cosine: that of a part whose cosine is COSINE where it stands alone.
SHARE = COSINE**2
#: Share of an item's words, in order, that a leak has; or that a paraphrase has if the answer is there by ANSWER.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
#: Weight of the benchmark's own vectors, against the corpus's sum.
OWN_WEIGHT = 10.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WINDOWS_AT_ONCE = 1024


def _words(text: str) -> list[str]:
    names, codes, _ = coded_words(pa.array([text], pa.string()), PUNCTUATION)
    names = as_list(names)
    return [names[c] for c in codes]


def answer_of(text: str) -> str:
    """What follows the last question mark or "answer:", else the last sentence."""
    tail = re.split(r"\?|answer:", text, flags=re.I)
    if len(tail) > 1 and tail[-1].strip():
        return tail[-1]
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x.strip()]
    return sentences[-1] if sentences else ""


def lcs(masks: dict[int, int], length: int, sequence) -> int:
    """Length of the longest common subsequence of an item, as bit masks of its places by word, and a sequence of words."""
    full = (1 << length) - 1
    v = full
    for w in sequence:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


@dataclass
class Items:
    """A block of the benchmark: ids, words as numbers, and all words by number."""

    ids: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    vocabulary: list[str]

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        number = lambda text: [vocabulary.setdefault(w, len(vocabulary)) for w in _words(text)]
        return Items([i for i, _ in rows], [number(t or "") for _, t in rows], [number(answer_of(t or "")) for _, t in rows], list(vocabulary))

    def numbers(self, names: pa.Array) -> np.ndarray:
        """The number of each word, -1 if no item has it."""
        found = pc.index_in(names, value_set=pa.array(self.vocabulary, pa.large_string()))
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int32)


@dataclass
class Space:
    """The latent space: idf-weighted directions by term (0 for common ones), the items in it, of length 1, and the projection onto each of a window that holds all of it."""

    terms: np.ndarray
    items: np.ndarray
    whole: np.ndarray


def _joint(blocks: list[Items]) -> tuple[Items, list[np.ndarray]]:
    """All words of several blocks, as one vocabulary; and, for each block, its number of each of them, -1 if it hasn't the word (the last place is for words of no block)."""
    known = {w: k for k, w in enumerate(dict.fromkeys(w for x in blocks for w in x.vocabulary))}
    local = []
    for x in blocks:
        of = np.full(len(known) + 1, -1, np.int32)
        of[[known[w] for w in x.vocabulary]] = np.arange(len(x.vocabulary))
        local.append(of)
    return Items([], [], [], list(known)), local


def _passages(items: Items, batch: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Benchmark words of the texts: number and passage of each, and how many passages there are."""
    names, codes, at = coded_words(batch, PUNCTUATION)
    number = items.numbers(names)[codes]
    sizes = np.diff(at)
    per_text = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(per_text)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    passage = first[text] + (np.arange(len(codes)) - at[text]) // WINDOW
    real = number >= 0
    return number[real], passage[real], int(first[-1])


def passage_counts(docs: DataFrame, blocks: list[Items]) -> tuple[list[np.ndarray], int]:
    """Passages with each word, for each block, and all passages; in one pass."""
    joint, local = _joint(blocks)
    sent, size = docs.sparkSession.sparkContext.broadcast(joint), len(joint.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            number, passage, n = _passages(sent.value, batch.column(0))
            if size:
                counts[:-1] += np.bincount(np.unique(passage * size + number) % size, minlength=size)
            counts[-1] += n
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met])], names=["word", "n"])

    got = map_arrow(docs.select("text"), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[got["word"].to_numpy()] = got["n"].to_numpy()
    return [out[np.argsort(of[:-1], kind="stable")[np.sum(of[:-1] < 0) :]] for of in local], int(out[-1])


def _omega(d: int, rank: int, seed: int) -> np.ndarray:
    """The random matrix, which is made where it is needed and not sent."""
    return np.random.default_rng(seed).normal(size=(d, rank)).astype(np.float32)


def _grams(docs: DataFrame, blocks: list[Items], idfs: list[np.ndarray], shapes: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """For each block the Gram matrix of all passages' TF-IDF vectors, of length 1, times its random matrix; in one pass.

    Tasks send a row for each term that they met, and the sums come to the driver.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((*_joint(blocks), idfs))

    def one(number: np.ndarray, passage: np.ndarray, idf: np.ndarray, omega: np.ndarray, total: np.ndarray) -> None:
        keep = number >= 0
        number, passage = number[keep], passage[keep]
        keep, d = idf[number] > 0, len(idf)
        pairs, tf = np.unique(passage[keep] * d + number[keep], return_counts=True)
        for i in range(0, len(pairs), 8_000):
            row, term = np.unique(pairs[i : i + 8_000] // d, return_inverse=True)[1], pairs[i : i + 8_000] % d
            weight = (idf[term] * tf[i : i + 8_000]).astype(np.float32)
            norm = np.sqrt(np.bincount(row, weight * weight))
            weight /= norm[row].astype(np.float32)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            y = np.add.reduceat(omega[term] * weight[:, None], starts, axis=0)
            order = np.argsort(term, kind="stable")
            begin = np.flatnonzero(np.diff(term[order], prepend=-1))
            total[term[order][begin]] += np.add.reduceat(y[row[order]] * weight[order][:, None], begin, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, local, idfs = sent.value
        omegas = [_omega(*shape) for shape in shapes]
        totals = [np.zeros(x.shape, np.float32) for x in omegas]
        for batch in batches:
            number, passage, _ = _passages(joint, batch.column(0))
            for of, idf, omega, total in zip(local, idfs, omegas, totals, strict=True):
                one(of[number], passage, idf, omega, total)
        for k, total in enumerate(totals):
            met = np.flatnonzero(np.abs(total).sum(1))
            for i in range(0, len(met), 1024):
                part = met[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k), pa.int32()), pa.array(part, pa.int32()), pa.array([total[x].tobytes() for x in part], pa.binary())], names=["block", "term", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, term, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[k, term] = sums[k, term] + x if (k, term) in sums else x
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([x for _, x in sums], pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["block", "term", "row"])

    schema = "block int, term int, row binary"
    got = map_arrow(map_arrow(docs.select("text"), run, schema).repartition("block", "term"), add, schema).toArrow()
    out = [np.zeros(shape[:2]) for shape in shapes]
    for k, term, raw in zip(*(got[c].to_pylist() for c in ("block", "term", "row")), strict=True):
        out[k][term] = np.frombuffer(raw, np.float32)
    return out


def latent_spaces(docs: DataFrame, blocks: list[Items], seed: int = 17) -> list[Space]:
    """The space of each block; two passes over docs for all of them."""
    counts, n = passage_counts(docs, blocks)
    idfs = [_idf(x, c, n) for x, c in zip(blocks, counts, strict=True)]
    shapes = [(len(idf), min(len(idf), len(x.ids) + EXTRA_RANK), seed) for x, idf in zip(blocks, idfs, strict=True)]
    return [_space(*x) for x in zip(blocks, idfs, shapes, _grams(docs, blocks, idfs, shapes), strict=True)]


def _idf(items: Items, counts: np.ndarray, n: int) -> np.ndarray:
    kept = counts <= COMMON * max(n, 1)
    for words in items.words:
        kept[sorted(set(words), key=lambda w: (counts[w], w))[:KEPT_TERMS]] = True
    return np.where(kept, np.log((n + 1) / (counts + 1)) + 1e-6, 0.0)


def _space(items: Items, idf: np.ndarray, shape: tuple[int, int, int], y: np.ndarray) -> Space:
    d, rank, _ = shape
    own = np.zeros((len(items.ids), d))
    for k, words in enumerate(items.words):
        np.add.at(own[k], words, idf[words])
    length = np.linalg.norm(own, axis=1, keepdims=True)
    own = np.divide(own, length, out=np.zeros_like(own), where=length > 0)
    omega = _omega(*shape).astype(np.float64)
    # As much weight on each item as the corpus has on its heaviest direction.
    scale = OWN_WEIGHT * max(1.0, np.linalg.norm(y, 2) / max(1e-9, np.linalg.norm(omega, 2))) if d else 1.0
    y = y / scale + own.T @ (own @ omega)
    shift = 1e-7 * np.linalg.norm(y)
    y += shift * omega
    core = omega.T @ y
    root = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(core) / max(rank, 1) * np.eye(rank))
    directions = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)[0]
    terms = (idf[:, None] * directions).astype(np.float32)
    own = own @ directions
    norm = np.linalg.norm(own, axis=1, keepdims=True)
    whole = np.where(norm > 0, length * norm, np.inf)[:, 0]
    return Space(terms, np.divide(own, norm, out=np.zeros_like(own), where=norm > 0).astype(np.float32), whole.astype(np.float32))


def candidates(space: Space, number: np.ndarray, at: np.ndarray, cosine: float = COSINE, share: float = SHARE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, window start, item, cosine) arrays of what is near, for texts given as word numbers; in bounded parts."""
    live = np.abs(space.terms).sum(1) > 0
    place = np.flatnonzero((number >= 0) & live[number])
    if not len(place):
        return
    text = np.searchsorted(at, place, side="right") - 1
    within = place - at[text]
    last, first = within // HOP, np.maximum(0, -(-(within - WINDOW + 1) // HOP))
    most = int((last - first).max()) + 1
    grid = first[:, None] + np.arange(most)
    span = int(last.max()) + 1
    windows = np.unique((text[:, None] * span + grid)[grid <= last[:, None]])
    of, start = windows // span, windows % span * HOP
    low = at[of] + start
    high = np.minimum(low + WINDOW, at[of + 1])
    lo, hi = np.searchsorted(place, low), np.searchsorted(place, high)
    for i in range(0, len(windows), _WINDOWS_AT_ONCE):
        a, b = lo[i : i + _WINDOWS_AT_ONCE], hi[i : i + _WINDOWS_AT_ONCE]
        base = int(a.min())
        rows = space.terms[number[place[base : int(b.max())]]]
        sums = np.concatenate([np.zeros((1, rows.shape[1]), np.float32), np.cumsum(rows, axis=0)])
        z = sums[b - base] - sums[a - base]
        near = z @ space.items.T
        norm = np.linalg.norm(z, axis=1)
        w, item = np.nonzero(near >= np.minimum(cosine * np.maximum(norm, 1e-6)[:, None], share * space.whole))
        yield of[i + w], start[i + w], item, near[w, item] / norm[w]


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


class Checker:
    """Word-by-word check of windows against items."""

    def __init__(self, items: Items):
        self.items = items
        self.sizes = np.array([len(x) for x in items.words])
        self.masks = [_masks(x) for x in items.words]
        self.answer_masks = [_masks(x) for x in items.answers]
        # Whether an item has a word; the last column is for words of no item.
        self.has = np.zeros((len(items.ids), len(items.vocabulary) + 1), bool)
        for k, x in enumerate(items.words):
            self.has[k, x] = True
        self.margin = np.maximum(0, self.sizes - WINDOW) + WINDOW // 2

    def possible(self, number: np.ndarray, at: np.ndarray, text: np.ndarray, start: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which windows have enough of an item's words, in any order, around them; the others can't pass check()."""
        keep = np.zeros(len(text), bool)
        low, high = np.maximum(at[text], at[text] + start - self.margin[item]), np.minimum(at[text + 1], at[text] + start + WINDOW + self.margin[item])
        span = np.arange(int((high - low).max(initial=0)))
        for i in range(0, len(text), _WINDOWS_AT_ONCE):
            part = slice(i, i + _WINDOWS_AT_ONCE)
            place = low[part, None] + span
            there = self.has[item[part, None], number[np.minimum(place, len(number) - 1)]] & (place < high[part, None])
            keep[part] = there.sum(1) >= PARAPHRASE * self.sizes[item[part]]
        return keep

    def check(self, number: np.ndarray, start: int, item: int) -> tuple[float, float] | None:
        """Shares of the item's and of its answer's words that are there in order, if that makes it a leak.  number: a whole text's words."""
        size, margin = self.sizes[item], self.margin[item]
        near = number[max(0, start - margin) : start + WINDOW + margin]
        near = near[self.has[item, near]].tolist()
        share = lcs(self.masks[item], int(size), near) / size
        if share < PARAPHRASE:
            return None
        answer = self.items.answers[item]
        there = lcs(self.answer_masks[item], len(answer), near) / len(answer) if answer else 1.0
        return (share, there) if share >= COPY or there >= ANSWER else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, overlap, answer: the items that each document leaks, by its first window that proves it.

    One row for each row of docs and leaked item; documents without leaks, null
    and empty texts give none.  Items without words leak nowhere.  Repeated rows
    give rows each.  An empty benchmark gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, item_id long, cosine double, overlap double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    group: list[list[tuple[int, str]]] = [[]]
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if len(group[-1]) == BLOCK_ITEMS:
            if len(group) == GROUP:
                out, group = out.unionByName(_search(docs, group, schema)), []
            group.append([])
        group[-1].append((row[0], row[1]))
    return out.unionByName(_search(docs, group, schema)) if group[-1] else out


def _search(docs: DataFrame, group: list[list[tuple[int, str]]], schema: str) -> DataFrame:
    blocks = [Items.of(x) for x in group]
    spaces = latent_spaces(docs, blocks)
    sent = docs.sparkSession.sparkContext.broadcast((*_joint(blocks), blocks, spaces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, local, blocks, spaces = sent.value
        checkers = [Checker(x) for x in blocks]
        for batch in batches:
            names, codes, at = coded_words(batch.column(1), PUNCTUATION)
            numbers = joint.numbers(names)[codes]
            found: dict[tuple[int, int, int], tuple[float, float, float]] = {}
            for k, (of, space, checker) in enumerate(zip(local, spaces, checkers, strict=True)):
                number = of[numbers]
                for text, start, item, cosine in candidates(space, number, at):
                    good = checker.possible(number, at, text, start, item)
                    for text, start, item, cosine in zip(*(x[good].tolist() for x in (text, start, item, cosine)), strict=True):
                        if (text, k, item) not in found and (shares := checker.check(number[at[text] : at[text + 1]], start, item)):
                            found[text, k, item] = (round(cosine, 6), round(shares[0], 6), round(shares[1], 6))
            which = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([t for t, _, _ in which], pa.int64())), pa.array([blocks[k].ids[i] for _, k, i in which], pa.int64()), *(pa.array([found[x][j] for x in which], pa.float64()) for j in range(3))],
                names=["doc_id", "item_id", "cosine", "overlap", "answer"],
            )

    return map_arrow(docs, run, schema)
