"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds the forms they miss.

The model is trained on generated labelled spans.  Every text is cut into
overlapping windows on one grid; their scores are averaged where they overlap,
weighted towards the windows' middles, and the best tag sequence of the whole text
under these scores reconciles them, so that no span depends on where a window
happened to begin.

An added span holds a digit or an @ (all four kinds do); spans without one are
dropped.  So the windows around these characters are scored first, and more on
either side until a place is found where every best sequence of the whole text has
tag O, whatever else the text says.  Between two such places the best sequence is
that of the whole text: the result is that of decoding all of it, and a test holds
one against the other.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bilstm_crf import BiLstmCrf, char_ids
from .common import map_arrow, sha256_hex

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one's start to the next; each HOP characters are a cell, covered by two windows.
WINDOW, HOP = 64, 32
#: Windows that go through the network at once, and cells of one text, and of several, that are decoded at once to begin with.
AT_ONCE, HELD = 512, 4096
#: Cells of a piece in which places of tag O are looked for, beside one more on either side.
PIECE = 14

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start and then kind; linear in the text."""
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        a = at
        while a > low and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        # Each character is stepped over at most twice: the run before an @ ends at the @ before it.
        low = m.end() if m else at + 1
        if m:
            out.append(("email", a, m.end()))
        at = text.find("@", low)
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# ---- labelled spans to train on ----


def _luhn_number(rng: random.Random, n: int) -> str:
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


def _entity(rng: random.Random, kind: str, word) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        name, host = rng.choice([word(), f"{word()}.{word()}", f"{word()}{d(2)}", f"{word()}_{word()}", d(2)]), f"{word()}{rng.choice(['', d(1)])}"
        return rng.choice([f"{name}@{host}.{rng.choice(['com', 'org', 'de', 'example.com'])}"] * 4 + [f"{name} @ {host}.com", f"{name}@{host} dot com"])
    if kind == "ip":
        part = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice([".".join(part)] * 4 + [" . ".join(part), "[.]".join(part)])
    if kind == "card":
        x = _luhn_number(rng, 16)
        return rng.choice([x, x, " ".join(x[i : i + 4] for i in (0, 4, 8, 12)), "-".join(x[i : i + 4] for i in (0, 4, 8, 12)), ".".join(x[i : i + 4] for i in (0, 4, 8, 12))])
    return rng.choice([f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"] * 3 + [f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}"])


def labelled_spans(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts with their spans: invented words, entities in plain and unusual forms, and numbers that are none."""
    rng = random.Random(seed)
    syllables = "the and tion re in er on at en is it or le de ing ed es an th ha ch ver ung ía ño çon éau".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(4, 12)):
            r = rng.random()
            if r < 0.22:
                kind = rng.choice(KINDS)
                x = _entity(rng, kind, word)
                spans.append((kind, len(text), len(text) + len(x)))
            elif r < 0.36:
                x = rng.choice([str(rng.randint(0, 9999)), f"{rng.randint(1, 99)}.{rng.randint(0, 99)}", f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"version {rng.randint(1, 9)}.0.", "4.0.", f"page={rng.randint(1, 9)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"@{word()}", f"{rng.randint(1, 12)}:{rng.randint(10, 59)}"])
            else:
                x = rng.choice([word(), word(), word().capitalize(), word() + ",", word() + "."])
            text += x + rng.choice([" ", " ", " ", " ", "\n", ", "])
        out.append((text, spans))
    return out


def last_window(n: int) -> int:
    """Number of the last window over n characters; windows start every HOP."""
    return max(0, -(-(n - WINDOW) // HOP))


def tagged_windows(data) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = [], []
    for text, spans in data:
        x = char_ids(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64))
        y = np.zeros(len(x), np.int64)
        for kind, a, b in spans:
            y[a], y[a + 1 : b] = 1 + 2 * KINDS.index(kind), 2 + 2 * KINDS.index(kind)
        for s in range(0, last_window(len(x)) * HOP + 1, HOP):
            pad = max(0, WINDOW - (len(x) - s))
            ids.append(np.pad(x[s : s + WINDOW], (0, pad)))
            tags.append(np.pad(y[s : s + WINDOW], (0, pad)))
    return np.array(ids), np.array(tags)


@lru_cache(maxsize=2)
def trained_model(examples: int = 1500, seed: int = 5) -> BiLstmCrf:
    model = BiLstmCrf(1 + 2 * len(KINDS))
    model.fit(*tagged_windows(labelled_spans(examples, seed)))
    return model


# ---- decoding ----

_SHAPE = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)


@dataclass
class _Job:
    """Some places of one text that hold a digit or an @."""

    text: int
    ids: np.ndarray
    anchors: np.ndarray


def _symbols(text: str) -> np.ndarray:
    return char_ids(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))


def model_spans(texts: list[str], model: BiLstmCrf) -> list[list[tuple[str, int, int]]]:
    """Spans that the model finds in each text."""
    found: list[set] = [set() for _ in texts]
    jobs: list[_Job] = []
    held = 0

    def done():
        nonlocal jobs, held
        for k, a, tags in _decoded(jobs, model):
            found[k].update(_spans_of(tags, a, texts[k]))
        jobs, held = [], 0

    for k, text in enumerate(texts):
        anchors = np.array([m.start() for m in _ANCHOR.finditer(text)], np.int64)
        if not len(anchors):
            continue
        ids, cells = _symbols(text), anchors // HOP
        new = np.cumsum(np.diff(cells, prepend=-1) > 0) // HELD  # a text of very many such cells is several jobs
        for part in range(int(new[-1]) + 1):
            jobs.append(_Job(k, ids, anchors[new == part]))
            held += len(np.unique(cells[new == part]))
            if held >= HELD:
                done()
    if jobs:
        done()
    return [sorted(x) for x in found]


def _decoded(jobs: list[_Job], model: BiLstmCrf) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, first place, tags) of stretches that hold all places of the jobs which may be in a span."""
    size = np.array([len(j.ids) for j in jobs])
    n_cells, last = -(-size // HOP), np.array([last_window(n) for n in size])
    first = np.concatenate([[0], np.cumsum(n_cells + 1)])[:-1]  # a cell is left free after each text, so that texts don't touch
    job = np.repeat(np.arange(len(jobs)), [len(j.anchors) for j in jobs])
    spot = np.concatenate([j.anchors for j in jobs]) + first[job] * HOP
    of_cell = lambda c: np.searchsorted(first, c, side="right") - 1
    inside = lambda c: c[(c >= 0) & (c - first[(o := of_cell(np.maximum(c, 0)))] < n_cells[o])]
    near = lambda c: inside(np.unique(np.concatenate([c - 1, c, c + 1])))
    have, scores = np.zeros(0, np.int64), np.zeros((0, WINDOW, model.tags), np.float32)
    cells = near(np.unique(spot // HOP))
    while len(spot):
        # Windows are numbered like the cells that they begin with.
        of = of_cell(cells)
        local = cells - first[of]
        pairs = [(cells, local <= last[of], 0), (cells - 1, (local >= 1) & (local - 1 <= last[of]), HOP)]
        new = np.setdiff1d(np.concatenate([w[ok] for w, ok, _ in pairs]), have)
        have, at = np.unique(np.concatenate([have, new]), return_index=True)
        scores = np.concatenate([scores, *_windows(jobs, new, of_cell, first, model)])[at]
        em, weight = np.zeros((len(cells), HOP, model.tags), np.float32), np.zeros((len(cells), HOP, 1), np.float32)
        for w, ok, part in pairs:
            shape = _SHAPE[part : part + HOP, None]
            em[ok] += scores[np.searchsorted(have, w[ok]), part : part + HOP] * shape
            weight[ok] += shape
        em /= weight
        lengths = np.minimum(HOP, size[of] - local * HOP)
        sure = _sure(em, cells, lengths, local == 0, local == n_cells[of] - 1, model)

        # The stretch of places not known to be O around each spot, and whether it ends within what has scores.
        flat, place = sure.ravel(), (cells[:, None] * HOP + np.arange(HOP)).ravel()
        begins, ends = np.repeat(np.diff(cells, prepend=-9) > 1, HOP), np.repeat(np.diff(cells, append=cells[-1] + 9) > 1, HOP)
        inner = np.tile(np.arange(HOP), len(cells))
        stop_left, stop_right = begins & (inner == 0), ends & (inner == np.repeat(lengths - 1, HOP)) | (inner >= np.repeat(lengths, HOP))
        index = np.arange(len(flat))
        low = np.maximum.accumulate(np.where(flat, index + 1, np.where(stop_left, index, 0)))
        high = np.minimum.accumulate(np.where(flat, index - 1, np.where(stop_right, index, len(flat)))[::-1])[::-1]
        here = np.searchsorted(place, spot)
        open_ = ~flat[here]
        spot, here = spot[open_], here[open_]
        a, b = low[here], high[here]
        more_left, more_right = stop_left[a] & ~np.repeat(local == 0, HOP)[a], stop_right[b] & ~np.repeat(local == n_cells[of] - 1, HOP)[b]
        ready = ~(more_left | more_right)
        if ready.any():
            yield from _best(em.reshape(-1, model.tags), np.unique(np.stack([a[ready], b[ready]], 1), axis=0), stop_left, stop_right, place, of_cell, first, jobs, model)
        # What is left goes on with its own stretches, wider by as many cells as they have.
        spot, a, b, more_left, more_right = spot[~ready], a[~ready], b[~ready], more_left[~ready], more_right[~ready]
        if len(spot):
            lo, hi = place[a] // HOP, place[b] // HOP
            wide = np.minimum(hi - lo + 1, 8)
            o = of_cell(spot // HOP)
            lo, hi = np.maximum(first[o], lo - np.where(more_left, wide, 1)), np.minimum(first[o] + n_cells[o] - 1, hi + np.where(more_right, wide, 1))
            cells = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in np.unique(np.stack([lo, hi], 1), axis=0)]))


def _windows(jobs: list[_Job], windows: np.ndarray, of_cell, first: np.ndarray, model: BiLstmCrf) -> Iterator[np.ndarray]:
    for i in range(0, len(windows), AT_ONCE):
        part = windows[i : i + AT_ONCE]
        ids = np.zeros((len(part), WINDOW), np.int16)
        for r, (w, j) in enumerate(zip(part, of_cell(part), strict=True)):
            x = jobs[j].ids[(w - first[j]) * HOP :][:WINDOW]
            ids[r, : len(x)] = x
        yield model.emissions(ids)


def _sure(em: np.ndarray, cells: np.ndarray, lengths: np.ndarray, begins: np.ndarray, ends: np.ndarray, model: BiLstmCrf) -> np.ndarray:
    """Places (cells, HOP) that are O in any case.  Runs of cells are taken in pieces, each with a cell more on either side, which all are looked at together."""
    start = np.flatnonzero(np.diff(cells, prepend=-9) > 1)
    stop = np.append(start[1:], len(cells))
    own = np.array([(x, min(x + PIECE, b), a, b) for a, b in zip(start, stop, strict=True) for x in range(a, b, PIECE)])
    lo, hi = np.maximum(own[:, 0] - 1, own[:, 2]), np.minimum(own[:, 1] + 1, own[:, 3])
    n = (hi - lo - 1) * HOP + lengths[hi - 1]
    order = np.argsort(-n, kind="stable")
    own, lo, hi, n = own[order], lo[order], hi[order], n[order]
    out = np.zeros((len(cells), HOP), bool)
    for i in range(0, len(n), 2048):
        part = slice(i, i + 2048)
        grid = np.minimum(lo[part, None] + np.arange(int((hi - lo)[part].max())), len(cells) - 1)
        piece = em[grid].reshape(len(grid), -1, em.shape[2])[:, : n[i]]
        found = model.surely_outside(piece, n[part], begins[lo[part]], ends[hi[part] - 1])
        for r, (x, y, l) in enumerate(zip(own[part, 0], own[part, 1], lo[part], strict=True)):
            mine = found[r, (x - l) * HOP : (y - l) * HOP]
            out[x:y].reshape(-1)[: len(mine)] = mine
    return out


def _best(em, stretches, stop_left, stop_right, place, of_cell, first, jobs, model) -> Iterator[tuple[int, int, np.ndarray]]:
    stretches = stretches[np.argsort(stretches[:, 0] - stretches[:, 1], kind="stable")]  # the longest first
    n = stretches[:, 1] - stretches[:, 0] + 1
    i = 0
    while i < len(n):
        part = slice(i, i + max(1, HELD * HOP // int(n[i])))
        a, b = stretches[part].T
        piece = em[np.minimum(a[:, None] + np.arange(n[i]), len(em) - 1)]
        tags = model.best_tags(piece, n[part], ~stop_left[a], ~stop_right[b])
        for r in np.flatnonzero(tags.any(1)):
            j = of_cell(place[a[r]] // HOP)
            yield jobs[j].text, int(place[a[r]] - first[j] * HOP), tags[r, : n[part][r]]
        i = part.stop


def full_spans(text: str, model: BiLstmCrf) -> list[tuple[str, int, int]]:
    """The same by scoring every window and decoding the whole text: what model_spans is held against."""
    ids = _symbols(text)
    total, weight = np.zeros((len(ids), model.tags), np.float32), np.zeros(len(ids), np.float32)
    for s in range(0, last_window(len(ids)) * HOP + 1, HOP) if len(ids) else ():
        x = np.zeros((1, WINDOW), np.int16)
        x[0, : len(ids) - s] = ids[s : s + WINDOW]
        n = min(WINDOW, len(ids) - s)
        total[s : s + n] += model.emissions(x)[0, :n] * _SHAPE[:n, None]
        weight[s : s + n] += _SHAPE[:n]
    return _spans_of(model.viterbi(total / weight[:, None]), 0, text) if len(ids) else []


def _spans_of(tags: np.ndarray, at: int, text: str) -> list[tuple[str, int, int]]:
    out, end = [], 0
    for t in np.flatnonzero(tags).tolist():
        if t < end:
            continue
        kind, end = (int(tags[t]) - 1) // 2, t + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        span = text[at + t : at + end]
        if _ANCHOR.search(span):
            out.append((KINDS[kind], at + t, at + t + len(span.rstrip())))
    return out


def plausible(kind: str, span: str) -> bool:
    """What an added span must have besides the model's word; broken fragments and failed checksums go."""
    digits = _DIGITS.findall(span)
    if kind == "email":
        return "@" in span and len(span) >= 6
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn("".join(digits))
    return 9 <= len(digits) <= 15


def all_spans(texts: list[str], model: BiLstmCrf) -> tuple[list[list], list[list]]:
    """Of each text the base spans, and all spans: those and the model's that overlap none of them."""
    base, out = [base_spans(x) for x in texts], []
    for text, fixed, added in zip(texts, base, model_spans(texts, model), strict=True):
        taken = bytearray(len(text)) if added else b""
        for _, a, b in fixed if added else ():
            taken[a:b] = b"\1" * (b - a)
        out.append(sorted(fixed + [x for x in added if plausible(x[0], text[x[1] : x[2]]) and not any(taken[x[1] : x[2]])], key=lambda x: (x[1], KINDS.index(x[0]))))
    return base, out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: BiLstmCrf | None = None) -> DataFrame:
    """One row for each row of df: id, counts of the base kinds, digest of the base spans, all spans.

    Spans that the model adds never overlap a base span.  Null and empty texts
    have none (digest of the empty string).  Repeated rows and ids give a row
    each.  Other columns are not read.  No shuffle; the model's weights, some
    20 kB, go with the task.
    """
    model = model or trained_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            base, spans = all_spans(texts, model)
            counts = {k: [sum(s[0] == k for s in b) for b in base] for k in KINDS}
            join = lambda x: ",".join(f"{k}:{a}:{e}" for k, a, e in x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array([sha256_hex(join(b)) for b in base], pa.string()), pa.array([join(s) for s in spans], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, text_col), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
