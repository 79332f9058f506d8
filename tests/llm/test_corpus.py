"""Operators over a whole corpus, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, fingerprint, line_dedup, mixing, ngram_join, queries, toxicity
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], DOCS)


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---- fingerprints ----


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprint_query(spark):
    rows = queries.op2_fingerprints(spark, f"{DATA}/sf0.001").collect()
    got = {r.doc_id: r for r in rows}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect())
    errors = []
    for k, (i, text) in enumerate(docs):
        after, cut = docs[(k + 1) % len(docs)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            true = jaccard(grams(text), grams(other))
            if len(grams(text) | grams(other)) <= fingerprint.K:
                assert value == pytest.approx(true)
            errors.append(abs(value - true))
    assert len(rows) == len(docs) and max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    same = {}
    for i, text in docs:
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint


SPARSE = [random.Random(8).getrandbits(62) for _ in range(500)]


@pytest.mark.parametrize("ids", [[5], [0, 1, 2], [1023, 1024, 5000, 2**40, -3, 2**21, 2**21 + 1], [], SPARSE, [*range(300), 2**62]])
def test_next_of_any_ids(spark, ids):
    df = docs_of(spark, [(i, f"t{i}", "s") for i in ids]).repartition(3)
    got = {r.doc_id: tuple(r.next) for r in fingerprint.with_next(df, "doc_id", "text", ["lang"], need=F.lit(2)).collect()}
    order = sorted(ids)
    assert got == {i: (x, f"t{x}"[:2], "en") for k, i in enumerate(order) for x in [order[(k + 1) % len(order)]]}


def test_next_with_nulls_and_repeats(spark):
    rows = [(None, "n", "s"), (None, "m", "s"), (None, None, "s"), (1, "b", "s"), (1, "a", "s"), (2, "c", "s"), (2, "c", "s"), (2, "c", "t"), (9, "", "s")]
    df = docs_of(spark, rows).withColumn("__id", F.lit("mine"))
    got = [(r.doc_id, r.text, tuple(r.next)) for r in fingerprint.with_next(df, "doc_id", "text").collect()]
    # A ring over the different (id, text) in order of ids; repeated rows share their next.
    assert len(got) == len(rows) and all(len({n for i, t, n in got if (i, t) == x}) == 1 for x in {(i, t) for i, t, _ in got})
    after = {(i, t): n for i, t, n in got}
    ring, x = [], (None, "n")
    while x not in ring:
        ring.append(x)
        x = after[x]
    assert set(ring) == {(i, t) for i, t, _ in rows} and x == ring[0]
    k = max(k for k, x in enumerate(ring) if x[0] is not None)
    turned = [x[0] for x in ring[k + 1 :] + ring[: k + 1]]
    assert turned == [None] * 3 + [1, 1, 2, 9]


def test_next_has_no_window_over_all_rows(spark):
    plan = queries.op2_fingerprints(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_sketches_merge(spark):
    rng = random.Random(5)
    texts = [" ".join(words_of(rng, n)) for n in (0, 3, 5, 80, 2000)]
    df = fingerprint.with_sketch(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)]), F.col("text"), "fp")
    sets = [grams(t) for t in texts]
    for r in df.select("doc_id", fingerprint.distinct_shingles(F.col("fp")).alias("n"), F.size("fp").alias("k")).collect():
        n = len(sets[r.doc_id])
        assert r.k == min(n, fingerprint.K) and (r.n == n if n < fingerprint.K else abs(r.n / n - 1) < 0.4)
    merged = fingerprint.merge_sketches(df, ["source"], "fp").first().fp
    every = sorted({h for r in fingerprint.with_sketch(docs_of(spark, [(k, t, "s") for k, t in enumerate(texts)]), F.col("text"), "fp", k=10**6).collect() for h in r.fp})
    assert merged == every[: fingerprint.K]
    pair = df.alias("a").where("doc_id = 3").crossJoin(df.alias("b").where("doc_id = 3"))
    assert pair.select(fingerprint.containment(F.col("a.fp"), F.col("b.fp"))).first()[0] == 1.0


# ---- line dedup ----


def brute_lines(rows, ratio=line_dedup.RATIO, least=1):
    pages = {}
    for _, t, s in rows:
        if t is not None:
            pages.setdefault(s, set()).add(t)
    bad = {s: {x for x, n in Counter(x for t in ts for x in {y.strip(" ") for y in t.split("\n")} - {""}).items() if n >= least and n > ratio * len(ts)} for s, ts in pages.items()}
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not x.strip(" ") or x.strip(" ") not in bad[s]]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("small", [line_dedup.SMALL, 0])
def test_line_dedup_like_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rng = random.Random(6)
    pool = [f"line {k}" for k in range(40)]
    rows = [(k, "\n".join(rng.choice(pool + ["", "  menu ", "menu", f"own {k}", "é" * 50]) for _ in range(rng.randint(0, 6))), rng.choice(["a", "b", None])) for k in range(300)]
    rows += [(400, None, "a"), (401, "menu", "a"), (402, "menu", "a"), (403, "x\n" * 20_000, "a"), (5, rows[5][1], rows[5][2])]
    got = line_dedup.drop_boilerplate(docs_of(spark, rows), "source").select("doc_id", "text", "n_lines", "n_dropped").collect()
    key = lambda x: (x[0], x[1] or "")
    assert sorted(map(tuple, got), key=key) == sorted(brute_lines(rows), key=key)
    assert line_dedup.drop_boilerplate(docs_of(spark, []), "source").count() == 0
    alone = line_dedup.drop_boilerplate(docs_of(spark, rows), "source", least=2).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, alone), key=key) == sorted(brute_lines(rows, least=2), key=key)


def test_line_dedup_by_host_of_url(spark):
    urls = {"http://a.example.com/x": "a.example.com", "HTTPS://u:p@A.Example.COM.:8080?q#f": "a.example.com", "http://b.example.com": "b.example.com", "src1": "src1", "": "", "ftp:///x": "", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", line_dedup.host_of(F.col("u")).alias("h"))
    assert {r.u: r.h for r in df.collect()} == urls
    rows = [(k, f"menu\nown {k}", f"http://{'ab'[k % 2]}.example.com/{k}") for k in range(6)] + [(7, "menu\nown", "http://c.example.com/")]
    extra = {"n_lines": "mine", "n_dropped": "too", "__host": "h", "__bad": "b", "__split": "p", "__own": "o", "__kept": "k"}
    df = docs_of(spark, rows).withColumns({k: F.lit(x) for k, x in extra.items()})
    got = line_dedup.drop_boilerplate(df, "source", least=2)
    assert got.columns == [*df.columns, "n_lines_", "n_dropped_"]
    assert {r.doc_id: (r.text, r.n_lines_, r.n_dropped_) for r in got.collect()} == {**{k: (f"own {k}", 2, 1) for k in range(6)}, 7: ("menu\nown", 2, 0)}
    assert all(r[k] == x for r in got.collect() for k, x in extra.items())


def test_lines_of_html(spark):
    pages = {"<p>a <b>b</b></p><script>x</p></script><!-- <p> --><ul><li>c</li> <li>d\n\n e</li></ul>": "a b\nc\nd\ne", "": "", None: None, "<title>T</title>x<br/>y &amp; z<style>\np{}\n</style>": "T\nx\ny &amp; z"}
    df = spark.createDataFrame([(h,) for h in pages], "html string").select("html", line_dedup.lines_of_html(F.col("html")).alias("text"))
    assert {r.html: r.text.strip("\n") if r.text else r.text for r in df.collect()} == pages


# ---- toxicity ----


def test_chain_on_held_out_rows(spark):
    d = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fit, rest = labels.where("pmod(xxhash64(doc_id), 4) <> 0"), labels.where("pmod(xxhash64(doc_id), 4) = 0")
    chain = toxicity.train(docs, fit)
    both = toxicity.score(docs, chain).withColumnRenamed("toxic", "said").join(rest, "doc_id").groupBy("said", "toxic").count().collect()
    n = {(r.said, r.toxic): r["count"] for r in both}
    assert n[True, 1] / (n[True, 1] + n.get((False, 1), 0)) > 0.75
    assert n.get((True, 0), 0) / n[False, 0] < 0.01
    assert any(m.chained.any() for m in chain.models[1:])  # later categories use earlier ones


def brute_chain(rows, new, folds):
    """The chain over dense tables, in plain steps: probabilities of new texts.  rows: (text, low_quality, toxic); folds: by key_of."""
    sets = lambda t: frozenset(toxicity.bucket(f) for w in (t or "").lower().split() for f in toxicity.forms(w))
    by = {}
    for t, *y in rows:
        by[sets(t)] = [max(a, b) for a, b in zip(by.get(sets(t), [0, 0]), y, strict=True)]
    texts = sorted(by, key=key_of)
    n_toxic = sum(r[2] for r in rows)
    assert len(rows) <= toxicity.SAMPLE and n_toxic  # all are in the sample, with weight 1
    y, fold = np.array([by[s] for s in texts], float), np.array([folds[key_of(s)] for s in texts])
    words = sorted(set().union(*texts))
    has = np.array([[w in s for w in words] for s in texts], float)

    def fit(some, c, earlier):
        x, t = has[some], y[some, c]
        n, hits, p = x.sum(0), x[t == 1].sum(0), t.mean()
        z = np.where(n >= toxicity.LEAST_DOCS, (hits - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9)), 0)
        use = [k for k in np.argsort(-z, kind="stable")[: toxicity.FEATURES] if z[k] >= toxicity.LEAST_Z]
        x = np.column_stack([x[:, use], earlier[some]])
        rate = min(0.25, (t.sum() + 0.5) / (len(t) + 10))
        w, bias, m, v = np.zeros(x.shape[1]), np.log(rate / (1 - rate)), 0, 0
        for k in range(1, toxicity.ROUNDS + 1):
            r = (1 / (1 + np.exp(-(x @ w + bias))) - t) / len(t)
            g = np.append(x.T @ r + toxicity.L2 * w, r.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = toxicity.RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
            w, bias = w - step[:-1], bias - step[-1]
            w[: len(use)] = np.maximum(w[: len(use)], 0)
        return lambda h, e: 1 / (1 + np.exp(-(np.column_stack([h[:, use], e]) @ w + bias)))

    none = np.zeros((len(texts), 0))
    out_of_fold = np.zeros(len(texts))
    for k in range(toxicity.FOLDS):
        out_of_fold[fold == k] = fit(fold != k, 0, none)(has[fold == k], none[fold == k])
    first, last = fit(fold >= 0, 0, none), fit(fold >= 0, 1, out_of_fold[:, None])
    h = np.array([[w in sets(t) for w in words] for t in new], float)
    p = first(h, np.zeros((len(new), 0)))
    return np.column_stack([p, last(h, p[:, None])])


def key_of(buckets):
    return xxhash.xxh3_128_hexdigest(np.array(sorted(buckets), np.int32).tobytes())


def folds_of(spark, rows):
    keys = {key_of({toxicity.bucket(f) for w in (t or "").lower().split() for f in toxicity.forms(w)}) for t, _, _ in rows}
    return {r.k: r.f for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", F.pmod(F.xxhash64("k"), F.lit(toxicity.FOLDS)).alias("f")).collect()}


def labelled_rows():
    rng = random.Random(17)
    bad, junk = ["idiot", "scum!!", "clown,"], ["win$$$", "free!!", "click###"]
    rows = []
    for _ in range(260):
        low, toxic = rng.random() < 0.3, rng.random() < 0.3
        text = words_of(rng, rng.randint(3, 25), 60) + [rng.choice(junk) for _ in range(2) if low and rng.random() < 0.9] + [rng.choice(bad) for _ in range(2) if toxic and not low and rng.random() < 0.9]
        rng.shuffle(text)
        rows.append((" ".join(text), int(low), int(toxic and not low)))
    return [*rows, ("", 0, 0), ("", 1, 0), rows[0], ("scum!!", 0, 1)]


def test_chain_like_brute_force(spark):
    rows = labelled_rows()
    docs = docs_of(spark, [(k, t, "s") for k, (t, _, _) in enumerate(rows)])
    labels = spark.createDataFrame([(k, 1 - low, toxic) for k, (_, low, toxic) in enumerate(rows)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    new = ["w1 w2 idiot", "w3 click### scum", "", "w5", rows[3][0], rows[9][0]]
    got = toxicity.score(docs_of(spark, [(k, t, "s") for k, t in enumerate(new)]), chain).orderBy("doc_id").collect()
    want = brute_chain(rows, new, folds_of(spark, rows))
    assert np.allclose([[r.p_low_quality, r.p_toxic] for r in got], want, atol=2e-4)
    assert chain.models[1].chained[0] != 0 and want[0, 1] > 0.5 > want[3, 1]


def test_sample_is_by_class_and_of_known_documents(spark):
    docs = docs_of(spark, [(k, "w", "s") for k in range(1000)])
    labels = spark.createDataFrame([(k, 1, int(k % 100 == 0)) for k in range(-5000, 1000)], "doc_id long, quality int, toxic int")
    for sample, n in ((100, (10, 90)), (12, (6, 6)), (5000, (10, 990))):
        got = toxicity.sampled(docs, labels, toxicity.CATEGORIES, sample).collect()
        assert (sum(r.y1 for r in got), sum(1 - r.y1 for r in got)) == n and all(r.doc_id >= 0 for r in got)
        assert sum(r.weight for r in got if r.y1) == pytest.approx(10) and sum(r.weight for r in got if not r.y1) == pytest.approx(990)


def test_toxicity_cases(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(words_of(rng, 30)) + (" Idiot!" if k % 5 == 0 else ""), "s") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(400)] + [(3, None, 1), (None, 1, 1), (0, 0, 1)], "doc_id long, toxic int, quality int")
    docs = docs_of(spark, rows)
    chain = toxicity.train(docs, labels)
    new = docs_of(spark, [(0, None, "s"), (1, "", "s"), (2, "an idiot", "s"), (2, "an idiot", "s"), (3, " ".join(words_of(rng, 20_000)), "s"), (4, " ".join(words_of(rng, 20_000)) + " idiot", "s")])
    assert sorted((r.doc_id, r.toxic) for r in toxicity.score(new, chain).collect()) == [(0, False), (1, False), (2, True), (2, True), (3, False), (4, True)]
    assert sorted(r.doc_id for r in toxicity.keep_clean(new, chain).collect()) == [0, 1, 3]
    assert chain.off == ["low_quality"]
    few = labels.where("toxic = 0 or doc_id < 45")
    with pytest.warns(UserWarning, match="toxic will not be predicted"):
        assert toxicity.train(docs, few).off == ["low_quality", "toxic"]
    with pytest.warns(UserWarning, match="0 labelled texts"):
        none = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(new, none).where("toxic").count() == 0
    assert toxicity.score(docs_of(spark, []), chain).count() == 0


# ---- mixing ----


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s] + 1e-9} if total else set()
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over


def test_mixing_cases(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(words_of(rng, rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "é", "zz", None])) for k in range(900)]
    rows += [(5000, None, "a"), (5001, "", "empty"), rows[3], (5002, "w " * 20_000, "b")]
    docs = docs_of(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    kept = mixing.mix_sources(docs, keep=True)
    assert kept.count() == len(rows) and {"text", "lang", "times"} <= set(kept.columns)
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0


def test_larger_budgets_take_supersets(spark):
    rng = random.Random(9)
    docs = docs_of(spark, [(k, " ".join(words_of(rng, 20)), rng.choice("ab")) for k in range(300)])
    sets = []
    for share in (0.5, 0.8, 1.1):
        real = mixing.targets
        mixing.targets = lambda x, f=real, s=share: f(x, share=s)
        try:
            sets.append({r.doc_id: r.times for r in mixing.mix_sources(docs).collect()})
        finally:
            mixing.targets = real
    for a, b in zip(sets, sets[1:], strict=False):
        assert sum(a[i] > b[i] for i in a) == 0


# ---- n-gram join ----


def brute_components(rows, n=3, percent=90):
    sets = {i: (lambda b: {tuple(b[j : j + n]) for j in range(max(1, len(b) - n + 1))} if b else set())((t or "").encode().lower().split()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if j < i and common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("seed,n,percent,side", [(1, 3, 90, 512), (2, 3, 90, 512), (3, 5, 80, 512), (4, 3, 90, 512), (3, 5, 80, 2), (5, 3, 90, 3)])
def test_components_like_brute_force(spark, seed, n, percent, side, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE", side)
    rng, rows = random.Random(seed), []
    for _ in range(9):
        base = words_of(rng, rng.choice([1, 2, 5, 30, 60, 120, 300]), 200)
        for _ in range(rng.choice([1, 2, 30])):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(x if rng.random() < 0.8 else x + x[:3]).upper() if rng.random() < 0.2 else " ".join(x)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "x y")]
    got = ngram_join.near_components(docs_of(spark, [(i, t, "s") for i, t in rows]), n=n, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, n, percent)


def test_order_of_few_buckets_is_as_right(spark):
    """No shingle is known to be rare, so that lists are long; and a passage that all share."""
    rng, rows = random.Random(31), []
    shared = words_of(rng, 12, 10**6)
    pool = [words_of(rng, 9, 300) for _ in range(12)]
    for k in range(90):
        x = [w for p in rng.sample(pool, 4) for w in p]
        for _ in range(rng.choice([1, 1, 3])):
            y = list(x)
            y[rng.randrange(len(y))] = f"e{rng.randrange(9)}"
            rows.append((len(rows), " ".join(shared + y)))
    want = brute_components(rows, 3, 80)
    for bits in ((0, 0), (2, 3), (20, 21)):
        got = ngram_join.near_components(docs_of(spark, [(i, t, "s") for i, t in rows]), n=3, percent=80, bits=bits).collect()
        assert sorted(map(tuple, got)) == want
    assert 1 < len({c for _, _, c in want}) < len(rows)


def test_join_cases(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    docs = docs_of(spark, [(5, a, "s"), (5, b, "s"), (3, a, "s"), (9, b, "s"), (None, a, "s"), (7, "é " * 20_000, "s"), (7, "é " * 20_000, "s")])
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.near_components(docs).collect())
    assert got == {(5, 3): 2, (3, 3): 1, (9, 3): 1, (None, None): 1, (7, 7): 2}
    assert sorted((r.doc_id or 0) for r in ngram_join.one_of_each(docs).collect()) == [0, 3, 7]
    assert ngram_join.near_components(docs_of(spark, [])).count() == 0
    assert ngram_join.near_components(docs_of(spark, [(1, None, "s")])).first()[:] == (1, 0, 1)


def test_joins_by_shuffle_too(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common.small_enough, "__defaults__", (0,))
    rows = [(k, " ".join(f"a{j}" for j in range(60)) + f" t{k % 4}", "s") for k in range(12)]
    got = ngram_join.near_components(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute_components([(i, t) for i, t, _ in rows])


def test_connected_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- decontamination ----


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs():
    rng = random.Random(11)
    for _ in range(500):
        a, b = [rng.randrange(6) for _ in range(rng.randint(0, 12))], [rng.randrange(6) for _ in range(rng.randint(0, 12))]
        assert decontaminate.lcs(decontaminate._masks(a), len(a), b) == brute_lcs(a, b)


@pytest.mark.parametrize("block,group", [(256, 8), (3, 1), (2, 3)])
def test_leaks_planted_and_clean(spark, block, group, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    monkeypatch.setattr(decontaminate, "GROUP", group)
    rng = random.Random(12)
    items = [(k, " ".join([*words_of(rng, 12, 30), *(f"i{k}x{j}" for j in range(14)), *words_of(rng, 6, 30)]) + ".") for k in range(8)] + [(100, None), (101, ""), (102, "w1 w2")]
    noise = lambda n: " ".join(words_of(rng, n, 5000))
    rows = [(k, noise(rng.randint(1, 300)), "s") for k in range(200)]
    rows += [(1000 + k, f"{noise(150 + k)} {items[k][1].upper()} {noise(40)}", "s") for k in range(8)]
    paraphrase = items[0][1].split()
    paraphrase[2] = paraphrase[5] = paraphrase[9] = "other"
    rows += [(2000, f"{noise(60)} {' '.join(paraphrase)} {noise(9)}", "s"), (2001, " ".join(items[1][1].split()[:9]), "s"), (2002, None, "s"), (2003, "", "s"), (2004, f"{noise(20_000)} {items[2][1]}", "s"), (1000, rows[200][1], "s")]
    df = decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id) for r in df.collect())
    assert {k: v for k, v in got.items() if k[1] < 100} == {**{(1000 + k, k): 1 for k in range(8)}, (1000, 0): 2, (2000, 0): 1, (2004, 2): 1}
    assert decontaminate.find_leaks(docs_of(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_in_lists_of_short_items(spark):
    """Neighbours in the same window don't hide an item, though each has a small part of the window's weight."""
    rng = random.Random(13)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(n))) for k, n in enumerate([6, 7, 8, 9, 10, 12, 15] * 6)]
    rows = [(k, " ".join(words_of(rng, rng.randint(1, 300), 5000)), "s") for k in range(100)]
    lists = {1000 + k: items[a : a + 14] for k, a in enumerate((0, 14, 28))}
    lists |= {2000 + n: items[k::7] for k, n in enumerate([6, 7, 8, 9, 10, 12, 15])}
    rows += [(i, " ".join([*words_of(rng, 7, 5000), *(x for _, x in listed)]), "s") for i, listed in lists.items()]
    df = decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in df.collect()} == {(i, k) for i, listed in lists.items() for k, _ in listed}


def test_some_window_holds_an_item_of_36_words_whole(spark):
    items = decontaminate.Items.of([(0, " ".join(f"x{j}" for j in range(36)))])
    space = decontaminate.Space(np.eye(36, dtype=np.float32), np.full((1, 36), 1 / 6, np.float32), np.array([6], np.float32))
    for before in range(decontaminate.WINDOW):
        number = np.concatenate([np.full(before, -1), items.words[0], np.full(60, -1)]).astype(np.int32)
        parts = decontaminate.candidates(space, number, np.array([0, len(number)]), cosine=2.0, share=0.999)
        assert sum(len(part[0]) for part in parts), before


def test_search_recalls_paraphrases(spark, monkeypatch):
    """Paraphrases with a tenth to four tenths of their words replaced: the search finds what the word check alone, over all windows and items, accepts."""
    rng = random.Random(21)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").orderBy("item_id").collect()]
    vocabulary = [w for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").limit(60).collect() for w in (r.text or "").split()]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for k in range(160):
        words = rng.choice(items)[1].split()
        for i in range(len(words)):
            if rng.random() < 0.1 + 0.3 * (k % 40) / 40:
                words[i] = rng.choice(vocabulary)
        rows.append((k, f"{noise(rng.randint(0, 90))} {' '.join(words)} {noise(rng.randint(0, 90))}", "s"))
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    got = found()
    search = decontaminate.candidates
    monkeypatch.setattr(decontaminate, "candidates", lambda space, number, at: search(space, number, at, -2.0, -2.0))
    every = found()
    assert got <= every and len(every) >= 100 and len(got) >= 0.9 * len(every)


def plain_words(text):
    return [w for x in (text or "").split() if (w := "".join(c.lower() if c.isascii() else c for c in x).strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))]


def plain_leak(words, item, answer):
    """Whether some 96 words of a text (48 and 24 on either side, more for long items) have enough of an item in order: four fifths of it, or three fifths and as much of its answer."""
    beside = max(0, len(item) - 48) + 24
    for start in range(max(1, len(words) - 5)):
        near = [w for w in words[max(0, start - beside) : start + 48 + beside] if w in set(item)]
        if sum((Counter(near) & Counter(item)).values()) < 0.6 * len(item):
            continue
        share = brute_lcs(item, near) / len(item)
        if share >= 0.8 or share >= 0.6 and (not answer or brute_lcs(answer, near) / len(answer) >= 0.6):
            return True
    return False


def test_leaks_like_plain_brute_force(spark):
    """Nothing of the operator is used: every text against every item, at every place."""
    rng = random.Random(41)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").orderBy("item_id").limit(20).collect()]
    vocabulary = [w for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("text").limit(60).collect() for w in (r.text or "").split()]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))), "s") for k in range(40)]
    for k in range(80):
        words = rng.choice(items)[1].split()
        kept = [w if rng.random() > 0.1 + 0.5 * (k % 20) / 20 else rng.choice(vocabulary) for w in words][: len(words) if k % 3 else max(4, len(words) * 2 // 3)]
        rows.append((100 + k, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 70))), *kept, *(rng.choice(vocabulary) for _ in range(rng.randint(0, 70)))]), "s"))
    want = set()
    for item, text in items:
        tail = re.split(r"\?|answer:", text, flags=re.I)
        answer = tail[-1] if len(tail) > 1 and tail[-1].strip() else ([x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x.strip()] or [""])[-1]
        own, said = plain_words(text), plain_words(answer)
        want |= {(i, item) for i, t, _ in rows if plain_leak(plain_words(t), own, said)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) >= 30 and len(got) >= 0.9 * len(want)
    assert not {i for i, _ in got} & set(range(40))


def test_leaks_of_the_tables(spark):
    d = f"{DATA}/sf0.01"
    found = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, d).collect()}
    clean = lambda t: f" {' '.join(decontaminate._words(t))} "
    docs = {r.doc_id: clean(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r.item_id: clean(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    whole = {(i, k) for i, t in docs.items() for k, x in items.items() if x in t}
    assert whole <= found and len(found - whole) <= 0.1 * len(found)


def test_randomised_svd_finds_the_space(spark):
    """The latent space holds the items' own directions."""
    items = decontaminate.Items.of([(k, f"u{k} v{k} z{k}") for k in range(6)])
    space = decontaminate.latent_spaces(docs_of(spark, [(1, "u1 v1 z1 other words", "s"), (2, "u2 x y", "s")]), [items])[0]
    near = space.items @ space.items.T
    assert np.allclose(near, np.eye(6), atol=0.05)


# ---- pipeline ----


def test_pipeline(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    now, before = docs, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r.doc_id, r.text, r.source) for r in now.collect()]
        out = corpus_pipeline.stored(stage(spark, now, d))
        if k < 4:
            assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            chain = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
            said = {r.doc_id: r.toxic for r in toxicity.score(docs, chain).collect()}
            assert set(got) == {i for i, x in said.items() if not x}
            assert all(got[i].text == t for i, t, _ in rows if i in got)
        elif name == "line_dedup":
            assert {i: r.text for i, r in got.items()} == {i: t for i, t, _, _ in brute_lines(rows, least=2)} and all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_duplicates":
            assert set(got) == {i for i, _, c in brute_components([(i, t) for i, t, _ in rows], 5, 80) if i == c}
        elif name == "decontamination":
            leaks = {r.doc_id for r in decontaminate.find_leaks(now, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
            assert set(got) == {i for i, _, _ in rows} - leaks
        elif name == "mixing":
            assert all(r.times in (1, 2) and r.taken == r.times * r.size for r in got.values())
        now, before = out, got
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, d).collect()} == {(i, r.taken) for i, r in before.items()}


def test_toxicity_stage_like_brute_force(spark, tmp_path):
    rows = labelled_rows()
    new = [f"{t} idiot" for t, _, _ in rows[:40]] + [" ".join(t.split()[::-1]) for t, _, _ in rows] + ["", "win$$$ idiot"]
    known = [(k, t, "s") for k, (t, _, _) in enumerate(rows)]
    spark.createDataFrame([(k, 1 - low, toxic) for k, (_, low, toxic) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(spark, [*known, *((1000 + k, t, "s") for k, t in enumerate(new))])
    p = brute_chain(rows, [t for _, t, _ in known] + new, folds_of(spark, rows))[:, -1]
    ids = [k for k, _, _ in known] + [1000 + k for k in range(len(new))]
    got = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()}
    assert got == {i for i, x in zip(ids, p, strict=True) if x < toxicity.THRESHOLD} and abs(p - toxicity.THRESHOLD).min() > 1e-3
    assert sum(i in got for i in range(1000, 1040)) == 0 and len(got) > 200


def test_pipeline_on_odd_rows(spark, tmp_path):
    a = "one two three four five six seven eight"
    rows = [(1, None, "s"), (2, "", None), (3, a, "s"), (4, a, "s"), (4, a, "s"), (None, a, "s"), (6, "x " * 20_000, "s")]
    docs_of(spark, rows).withColumn("size", F.lit(1)).withColumn("__lines", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3, None, 6} and all(r.times > 0 for r in got)
