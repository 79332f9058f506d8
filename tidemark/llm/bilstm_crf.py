"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Trained by Adam on the negative log likelihood of the tag sequences.  Windows
are equally long, padded with character 0 and tag 0.
"""

from __future__ import annotations

import numpy as np

ALPHABET = 128


def char_ids(codes: np.ndarray) -> np.ndarray:
    """Code points to input symbols: ASCII as is, other letters 1, what is above U+2000 2; 0 pads."""
    return np.where(codes < ALPHABET, np.maximum(codes, 3), np.where(codes < 0x2000, 1, 2)).astype(np.int16)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiLstmCrf:
    def __init__(self, tags: int, embed: int = 12, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.tags, self.hidden = tags, hidden
        self.p = {"E": f(ALPHABET, embed) * 3, "T": np.zeros((tags, tags), np.float32), "O": f(2 * hidden, tags), "o": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(embed + hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1  # remember at first

    def _run(self, d: str, x: np.ndarray, keep: bool):
        """Hidden states (steps, batch, hidden) over embedded x (steps, batch, embed)."""
        h_n, (steps, batch, e) = self.hidden, x.shape
        W, h, c = self.p[f"W{d}"], np.zeros((batch, self.hidden), np.float32), np.zeros((batch, self.hidden), np.float32)
        pre = (x.reshape(-1, e) @ W[:e] + self.p[f"b{d}"]).reshape(steps, batch, -1)
        out, cache = np.empty((steps, batch, h_n), np.float32), []
        for t in range(steps) if d == "f" else reversed(range(steps)):
            z = pre[t] + h @ W[e:]
            s = _sigmoid(z[:, : 3 * h_n])
            i, f, o, g = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :], np.tanh(z[:, 3 * h_n :])
            old_c, old_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                cache.append((t, i, f, o, g, old_c, old_h, tc))
        return out, cache

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (windows, steps, tags)."""
        e, h_n, both = self.p["E"].shape[1], self.hidden, []
        for d in "fb":
            # What each symbol adds to the gates, and rows of a half, so that tanh(x / 2) serves as the sigmoid of x.
            half = np.repeat(np.array([0.5, 1], np.float32), [3 * h_n, h_n])
            table, U = (self.p["E"] @ self.p[f"W{d}"][:e] + self.p[f"b{d}"]) * half, self.p[f"W{d}"][e:] * half
            h = c = np.zeros((len(ids), h_n), np.float32)
            out = np.empty((ids.shape[1], len(ids), h_n), np.float32)
            for t in range(ids.shape[1]) if d == "f" else reversed(range(ids.shape[1])):
                z = h @ U
                z += table[ids[:, t]]
                np.tanh(z, out=z)
                s = z[:, : 3 * h_n]
                s += 1
                s *= 0.5
                c = s[:, h_n : 2 * h_n] * c + s[:, :h_n] * z[:, 3 * h_n :]
                h = np.multiply(s[:, 2 * h_n :], np.tanh(c), out=out[t])
            both.append(out)
        h = np.concatenate(both, axis=2)
        return np.ascontiguousarray((h @ self.p["O"] + self.p["o"]).transpose(1, 0, 2))

    def _crf(self, em: np.ndarray, tags: np.ndarray):
        """Mean loss, its gradient by emissions (steps, batch, tags) and by transitions; forward and backward in log space."""
        steps, batch, _ = em.shape
        T = self.p["T"]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        a, b = np.empty_like(em), np.zeros_like(em)
        a[0] = em[0]
        for t in range(1, steps):
            a[t] = em[t] + lse(a[t - 1][:, :, None] + T, 1)
        for t in range(steps - 2, -1, -1):
            b[t] = lse(T + (em[t + 1] + b[t + 1])[:, None, :], 2)
        z = lse(a[-1], 1)
        rows = np.arange(batch)
        gold = sum(em[t, rows, tags[t]] for t in range(steps)) + sum(T[tags[t - 1], tags[t]] for t in range(1, steps))
        d_em = np.exp(a + b - z[:, None])
        for t in range(steps):
            d_em[t, rows, tags[t]] -= 1
        pair = np.exp(a[:-1, :, :, None] + T + (em[1:] + b[1:])[:, :, None, :] - z[:, None, None])
        d_T = pair.sum((0, 1))
        np.subtract.at(d_T, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        return float((z - gold).mean()), d_em / batch, d_T / batch

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x = self.p["E"][ids.T]
        e, h_n = x.shape[2], self.hidden
        runs = {d: self._run(d, x, True) for d in "fb"}
        h = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        em = h @ self.p["O"] + self.p["o"]
        loss, d_em, d_T = self._crf(em, tags.T)
        g = {"T": d_T, "O": h.reshape(-1, 2 * h_n).T @ d_em.reshape(-1, self.tags), "o": d_em.sum((0, 1))}
        d_h, d_x = d_em @ self.p["O"].T, np.zeros_like(x)
        for k, d in enumerate("fb"):
            W, own = self.p[f"W{d}"], d_h[:, :, k * h_n : (k + 1) * h_n]
            dW, db = np.zeros_like(W), np.zeros_like(self.p[f"b{d}"])
            dh = np.zeros((x.shape[1], h_n), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, gg, old_c, old_h, tc in reversed(runs[d][1]):
                dh = dh + own[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dW[:e] += x[t].T @ dz
                dW[e:] += old_h.T @ dz
                db += dz.sum(0)
                d_x[t] += dz @ W[:e].T
                dh, dc = dz @ W[e:].T, dc * f
            g[f"W{d}"], g[f"b{d}"] = dW, db
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], ids.T, d_x)
        return loss, g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 220, batch: int = 48, rate: float = 0.02, seed: int = 11) -> list[float]:
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for n in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, g = self.gradients(ids[pick], tags[pick])
            scale = min(1, 5 / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
            now = rate * min(1, 2 * (1 - n / (steps + 1)))
            for k, x in g.items():
                x = x * scale
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] -= (now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    def surely_outside(self, em: np.ndarray, lengths: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places (pieces, steps) where every best path has tag 0, whatever stands before and after the piece.

        em: scores of pieces of texts, sorted by falling lengths.  begins, ends:
        whether the text begins, ends with the piece.  For each place and tag an
        upper bound of how far the best path up to it that ends in that tag can be
        ahead of the one that ends in 0 is carried forward, and the same backward;
        where the sum is below 0 for all other tags, no best path has them.
        """
        T, margin = self.p["T"], 1e-3
        delta = em - em[:, :, :1]
        n, steps, _ = em.shape
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]
        ahead = (T - T[:, :1]).max(0)  # of any path that goes on to a tag, before one that goes on to 0
        fore = np.empty_like(delta)
        x = np.where(begins[:, None], 0, ahead) + delta[:, 0]
        fore[:, 0] = x
        for t in range(1, steps):
            k = active[t]
            x = np.minimum((x[:k, :, None] + T).max(1) - T[0, 0], ahead) + delta[:k, t]
            fore[:k, t] = x
        behind = (T - T[:1]).max(1)
        back = np.empty_like(delta)
        rows, at = np.arange(n), lengths - 1
        x = np.where(ends[:, None], 0, np.broadcast_to(behind, (n, len(behind)))).astype(np.float32)
        back[rows, at] = x
        for t in range(1, steps):
            k = active[t]
            at = lengths[:k] - 1 - t
            x = np.minimum((T + (x[:k] + delta[rows[:k], at + 1])[:, None, :]).max(2) - T[0, 0], behind)
            back[rows[:k], at] = x
        total = (fore + back)[:, :, 1:].max(2)
        return (total < -margin) & (np.arange(steps) < lengths[:, None])

    def best_tags(self, em: np.ndarray, lengths: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The best tags (pieces, steps), of pieces sorted by falling lengths.  after, before: whether the piece stands after, before a place of tag 0 (else the text begins, ends there)."""
        T = self.p["T"]
        n, steps, _ = em.shape
        back = np.zeros(em.shape, np.int8)
        score = em[:, 0] + np.where(after[:, None], T[0], 0)
        for t in range(1, steps):
            k = int(np.searchsorted(-lengths, -t, side="left"))
            all_ = score[:k, :, None] + T
            back[:k, t] = all_.argmax(1)
            score[:k] = all_.max(1) + em[:k, t]
        out, rows = np.zeros((n, steps), np.int8), np.arange(n)
        last = (score + np.where(before[:, None], T[:, 0], 0)).argmax(1)
        out[rows, lengths - 1] = last
        for t in range(1, steps):
            k = int(np.searchsorted(-lengths, -t, side="left"))
            at = lengths[:k] - 1 - t
            last = back[rows[:k], at + 1, last[:k]]
            out[rows[:k], at] = last
        return out

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """The best tags of one sequence of scores (steps, tags)."""
        T, score = self.p["T"], em[0]
        back = np.empty(em.shape, np.int16)
        for t in range(1, len(em)):
            all_ = score[:, None] + T
            back[t] = all_.argmax(0)
            score = all_.max(0) + em[t]
        out = np.empty(len(em), np.int16)
        out[-1] = score.argmax()
        for t in range(len(em) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out
