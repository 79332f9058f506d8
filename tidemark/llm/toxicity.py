"""Toxicity by a classifier chain of linear models over words, their beginnings and the marks they end in.

Categories are columns of the labels and are predicted one after the other; a
later model also sees the probabilities of the earlier ones.  In training these
are out-of-fold predictions, so that a later model learns how far to trust them on
texts they weren't fitted on.  A word's weight is never negative: words are
evidence for a category or none, so that a long text can't hide it among other
words.  An earlier category may speak for or against a later one.

What the models see is chosen where the texts are: words are counted by fold and
category in the tasks, and only the words that are chosen come to the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_list, coded_words, cut, map_arrow, small_enough

FEATURE_BITS = 20
#: Characters of a word's beginning that are features besides the word.
BEGINNINGS = (4, 5)
#: Labelled rows that the models are fitted on at most, up to half of them of the last category; those whose id has the least hash.
SAMPLE = 10_000
#: Words kept for a category, the z-score they need, and texts they must be in.
FEATURES, LEAST_Z, LEAST_DOCS = 512, 5.0, 8
#: Positive examples below which a category is predicted as its rate.
LEAST_POSITIVE = 10
FOLDS, ROUNDS, L2, RATE = 3, 250, 1e-4, 0.2
THRESHOLD = 0.5
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The chain: a category's name, its column of the labels, and the value that counts as positive.  The last one decides.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def forms(word: str) -> list[str]:
    """The features of a word as it stands between blanks, in lower case: the word without marks at its ends, its beginnings, and two or more marks that it ends in."""
    plain, tail = word.strip(PUNCTUATION), word[len(word.rstrip(PUNCTUATION)) :]
    return ([plain, *(f"{plain[:n]}*" for n in BEGINNINGS)] if plain else []) + ([f"~{tail}"] if len(tail) > 1 else [])


def bucket(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form) >> (64 - FEATURE_BITS)


def features(column: pa.Array) -> list[np.ndarray]:
    """The distinct buckets of each text's features, in order; each different word is looked at once."""
    names, codes, at = coded_words(column)
    found = [[bucket(x) for x in forms(w)] for w in as_list(names)]
    ends = np.cumsum([0, *map(len, found)])
    flat = np.fromiter((x for f in found for x in f), np.int32, int(ends[-1]))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        words = np.unique(codes[a:b])
        n = ends[words + 1] - ends[words]
        place = np.repeat(ends[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(words) else np.zeros(0, np.int64)
        out.append(np.unique(flat[place]))
    return out


@dataclass
class Linear:
    """sum of the weights of a text's words, plus weights of earlier probabilities, plus bias."""

    weights: np.ndarray
    chained: np.ndarray
    bias: float
    #: Whether there were examples enough to fit it; if not, it gives the rate and predicts nothing.
    fitted: bool = True

    def margins(self, flat: np.ndarray, row: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.weights[flat], n) + earlier @ self.chained + self.bias


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def flatten(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(sets) if sets else np.zeros(0, np.int32)), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def chosen(docs: np.ndarray, hits: np.ndarray, n: int, n_hits: int) -> np.ndarray:
    """Which features a model uses: those that most exceed the category's rate, the lower number first if alike.  docs, hits: texts and positive texts with each."""
    p = n_hits / max(n, 1)
    z = (hits - docs * p) / np.sqrt(np.maximum(docs * p * (1 - p), 1e-9))
    z[docs < LEAST_DOCS] = 0
    best = np.argsort(-z, kind="stable")[:FEATURES]
    out = np.zeros(len(docs), bool)
    out[best[z[best] >= LEAST_Z]] = True
    return out


def fit_linear(flat: np.ndarray, row: np.ndarray, earlier: np.ndarray, y: np.ndarray, weight: np.ndarray, use: np.ndarray) -> Linear:
    """flat, row: the features of all texts and which text each is of; use: which features the model has; weight: how many labelled texts each stands for.

    A category without enough examples of both kinds is given its rate, and never predicted.
    """
    w8 = weight / weight.sum() if len(y) else weight
    rate = min(0.25, (float(w8 @ y) * len(y) + 0.5) / (len(y) + 10))
    weights, bias = np.zeros(len(use), np.float32), float(np.log(rate / (1 - rate)))
    if y.sum() < LEAST_POSITIVE or y.sum() > len(y) - LEAST_POSITIVE:
        return Linear(weights, np.zeros(earlier.shape[1]), bias, fitted=False)
    name, n = np.cumsum(use) - 1, int(use.sum())
    keep = use[flat]
    cols, rows = name[flat[keep]], row[keep]
    w = np.zeros(n + earlier.shape[1])
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, ROUNDS + 1):
        r = (_sigmoid(np.bincount(rows, w[cols], len(y)) + earlier @ w[n:] + bias) - y) * w8
        g = np.append(np.concatenate([np.bincount(cols, r[rows], n), earlier.T @ r]) + L2 * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
        w[:n] = np.maximum(0, w[:n])
    weights[use] = w[:n]
    return Linear(weights, w[n:], float(bias))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]

    @property
    def off(self) -> list[str]:
        """Categories that are never predicted, for want of examples."""
        return [name for name, model in zip(self.names, self.models, strict=True) if not model.fitted]

    def probabilities(self, sets: list[np.ndarray]) -> np.ndarray:
        """(texts, categories), each category seeing the earlier ones."""
        flat, row = flatten(sets)
        out = np.zeros((len(sets), 0))
        for model in self.models:
            out = np.column_stack([out, _sigmoid(model.margins(flat, row, len(sets), out))])
        return out


def fit_chain(flat: np.ndarray, row: np.ndarray, labels: dict[str, np.ndarray], weight: np.ndarray, fold: np.ndarray, use: dict[tuple[str, int | None], np.ndarray]) -> Chain:
    """use: the features of each category's model fitted without each fold, and (None) on all."""
    n = len(fold)
    earlier, models = np.zeros((n, 0)), []

    def part(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.cumsum(some, dtype=np.int32) - 1
        keep = some[row]
        return flat[keep], place[row[keep]]

    for name, y in labels.items():
        held_out = np.zeros(n)
        if name != list(labels)[-1]:
            for k in range(FOLDS):
                fit, rest = fold != k, fold == k
                model = fit_linear(*part(fit), earlier[fit], y[fit], weight[fit], use[name, k])
                held_out[rest] = _sigmoid(model.margins(*part(rest), int(rest.sum()), earlier[rest]))
        models.append(fit_linear(flat, row, earlier, y, weight, use[name, None]))
        earlier = np.column_stack([earlier, held_out])
    return Chain(list(labels), models)


def sampled(docs: DataFrame, labels: DataFrame, categories, sample: int) -> DataFrame:
    """doc_id, y0, y1, ... (0 or 1) and weight of at most `sample` labelled documents that docs has, for which all categories are known.

    An id with several labels has a category if any row says so.  Up to half are
    of the last category; weight is how many labelled documents a row stands for.
    """
    given = [F.max((F.col(column) == value).cast("int")).alias(f"y{k}") for k, (_, column, value) in enumerate(categories)]
    last = f"y{len(categories) - 1}"
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(*given).dropna()
    rows = cut(rows.join(docs.select("doc_id"), "doc_id", "left_semi"))
    n = {r[0]: r[1] for r in rows.groupBy(last).count().collect()}
    half = min(n.get(1, 0), max(sample // 2, sample - n.get(0, 0)))
    take = {1: half, 0: min(n.get(0, 0), sample - half)}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [rows.where(F.col(last) == y).orderBy(*order).limit(k).withColumn("weight", F.lit(n[y] / k)) for y, k in take.items() if k]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else rows.withColumn("weight", F.lit(1.0)).limit(0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories=CATEGORIES) -> Chain:
    """Fits the chain on at most `sample` labelled documents.

    Texts with equal features count once, with a category if one of them has it.
    The ids of the sample, a bounded list, are broadcast.  The sample's features
    are kept as a table; of it the driver gets the counts of features that some
    model may choose, and then, of each text, those only: at most FEATURES for
    each model, whatever the texts' lengths.

    A category with fewer than LEAST_POSITIVE positive or negative texts is never
    predicted; a warning says so, and the chain's `off` names it.
    """
    names, ys = [x[0] for x in categories], [f"y{k}" for k in range(len(categories))]
    found = docs.select("doc_id", "text").join(F.broadcast(sampled(docs, labels, categories, sample)), "doc_id").select("text", "weight", *ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = features(batch.column(0))
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
            keys = pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), *batch.columns[1:]], names=["key", "words", "weight", *ys])

    texts = map_arrow(found, run, f"key string, words array<int>, weight double, {', '.join(f'{y} int' for y in ys)}")
    texts = cut(texts.groupBy("key").agg(F.first("words").alias("words"), F.max("weight").alias("weight"), *(F.max(y).alias(y) for y in ys)).withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int")))

    # Texts, and positive ones, by fold; of all and of each feature.
    sums = [F.count_if(F.col("fold") == k).alias(f"n_{k}") for k in range(FOLDS)] + [F.count_if((F.col("fold") == k) & (F.col(y) == 1)).alias(f"{y}_{k}") for y in ys for k in range(FOLDS)]
    total = texts.agg(*sums).first().asDict()
    but = lambda x, k: sum((F.col(f"{x}_{j}") for j in range(FOLDS) if j != k), F.lit(0.0))
    total_but = lambda x, k: sum(total[f"{x}_{j}"] for j in range(FOLDS) if j != k)
    models = [(name, y, k) for name, y in zip(names, ys, strict=True) for k in (*range(FOLDS), None)]

    def may(y: str, k: int | None) -> Column:
        p = total_but(y, k) / max(total_but("n", k), 1)
        n = but("n", k)
        return (n >= LEAST_DOCS) & ((but(y, k) - n * p) / F.sqrt(F.greatest(n * p * (1 - p), F.lit(1e-9))) >= 0.99 * LEAST_Z)

    counts = texts.select(F.explode("words").alias("word"), "fold", *ys).groupBy("word").agg(*sums)
    likely = F.lit(False)
    for _, y, k in models:
        likely = likely | may(y, k)
    counts = counts.where(likely).toArrow().sort_by([("word", "ascending")])
    column = {x: counts[x].to_numpy().astype(np.float64) for x in counts.column_names if x != "word"}
    less = lambda x, k: sum((column[f"{x}_{j}"] for j in range(FOLDS) if j != k), np.zeros(counts.num_rows))
    words = counts["word"].to_numpy().astype(np.int64)
    use = {(name, k): chosen(less("n", k), less(y, k), total_but("n", k), total_but(y, k)) for name, y, k in models}
    any_ = np.any(list(use.values()), axis=0) if use else np.zeros(0, bool)
    words, use = words[any_], {k: x[any_] for k, x in use.items()}

    picked = small_enough(df_of(texts, words))
    kept = texts.select("key", F.explode("words").alias("word")).join(picked, "word").groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    got = texts.drop("words").join(kept, "key", "left").toArrow().sort_by([("key", "ascending")]).combine_chunks()
    lists = pc.fill_null(got["places"].combine_chunks(), pa.scalar([], pa.list_(pa.int32()))) if got.num_rows else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(got.num_rows, dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    chain = fit_chain(lists.flatten().to_numpy(), row, {name: got[y].to_numpy().astype(np.float64) for name, y in zip(names, ys, strict=True)}, got["weight"].to_numpy(), got["fold"].to_numpy(), use)
    if chain.off:
        warnings.warn(f"fewer than {LEAST_POSITIVE} examples, or all but that many, among {got.num_rows} labelled texts: {', '.join(chain.off)} will not be predicted", stacklevel=2)
    for model in chain.models:  # from places to buckets
        every = np.zeros(1 << FEATURE_BITS, np.float32)
        every[words] = model.weights
        model.weights = every
    return chain


def df_of(like: DataFrame, words: np.ndarray) -> DataFrame:
    """word, place: the chosen features, of which there are a few thousand at most."""
    return like.sparkSession.createDataFrame([(int(w), k) for k, w in enumerate(words)], "word int, place int")


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last one's probability is at least THRESHOLD), one row for each row of df.

    Null and empty texts have no words and get the base rates.  No shuffle; the
    models, FEATURE_BITS and some words, are broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.probabilities(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.round(p[:, k], 6)) for k in range(p.shape[1])), pa.array(p[:, -1] >= THRESHOLD)], names=["doc_id", *(f"p_{x}" for x in chain.names), "toxic"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, text_col), run, f"doc_id {kind}, {', '.join(f'p_{x} double' for x in chain.names)}, toxic boolean")


def keep_clean(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose text isn't toxic; null texts stay."""
    sent = df.sparkSession.sparkContext.broadcast(chain)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.probabilities(features(batch.column(at)))[:, -1]
            yield batch.filter(pa.array(p < THRESHOLD))

    return map_arrow(df, run, df.schema)
