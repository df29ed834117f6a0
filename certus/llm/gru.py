"""A gated recurrent language model with a class-factored softmax, in numpy.

Words 0..n-1 are in classes of equal size by rank; the numbers from n on are
classes of rare words, whose members the model doesn't tell apart. P(word |
state) is P(class | state) times P(word | class, state). Training runs back-propagation through windows of fixed length and
carries the state from window to window; scoring carries it through whole
documents.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASS_SIZE, EMBEDDED, HIDDEN = 32, 24, 32
STREAMS, WINDOW = 64, 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def _chosen_logs(h: np.ndarray, w: np.ndarray, b: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen column's log-softmax of h @ w + b in each row. States lie between -1 and 1."""
    z = h @ w
    z += b
    out = z[np.arange(len(z)), chosen]
    reach = np.abs(w).sum(0)
    if (b + reach).max() > 80 or (b - reach).max() < -80:  # else exponentials neither overflow nor all vanish
        top = z.max(1)
        z -= top[:, None]
        out -= top
    np.exp(z, out=z)
    return out - np.log(z @ np.ones(z.shape[1], np.float32))


class GRU:
    """counts: of the frequent words, by rank, then of each of the last ``rare`` classes."""

    def __init__(self, counts: np.ndarray, rare: int = 1, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.words, self.rare = len(counts) - rare, rare
        self.classes = -(-self.words // CLASS_SIZE)
        c = np.asarray(counts, np.float64) + 0.5
        own = np.zeros(self.classes * CLASS_SIZE)
        own[: self.words] = c[: self.words]
        mass = [*own.reshape(-1, CLASS_SIZE).sum(1), *c[self.words :]]
        inner = np.full((self.classes, CLASS_SIZE), -1e4)
        inner.ravel()[: self.words] = np.log(c[: self.words])
        normal = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.p = {
            "embed": normal(self.words + rare, EMBEDDED) * 3,
            "input": normal(EMBEDDED, 3 * HIDDEN),
            "state": normal(HIDDEN, 3 * HIDDEN),
            "bias": np.zeros(3 * HIDDEN, np.float32),
            "class_w": np.zeros((HIDDEN, self.classes + rare), np.float32),
            "class_b": np.log(np.array(mass) / np.sum(mass)).astype(np.float32),
            "word_w": np.zeros((self.classes, CLASS_SIZE, HIDDEN), np.float32),
            "word_b": (_log_softmax(inner) if self.classes else inner).astype(np.float32),
        }

    def _class(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.words, words // CLASS_SIZE, self.classes + words - self.words)

    def _window(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """States of a window; x and keep are (time, stream), keep 0 where a document begins."""
        p, steps = self.p, []
        gates = (p["embed"] @ p["input"] + p["bias"])[x]
        out = np.empty((*x.shape, HIDDEN), np.float32)
        for t in range(len(x)):
            before = h * keep[t][:, None]
            s = before @ p["state"]
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gates[t, :, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            h = z * before + (1 - z) * new
            steps.append((before, z, r, new, s[:, 2 * HIDDEN :]))
            out[t] = h
        return steps, out

    def train(self, documents: list[np.ndarray], start: int, passes: int = 2, rate: float = 0.01) -> int:
        """Number of words learned from. documents: word numbers. start: the word before a first one."""
        flat = np.concatenate(documents)
        before = np.r_[start, flat[:-1]]
        keep = np.ones(len(flat), np.float32)
        firsts = np.r_[0, np.cumsum([len(d) for d in documents])[:-1]]
        before[firsts], keep[firsts] = start, 0
        n = -(-len(flat) // (STREAMS * WINDOW)) * WINDOW
        if not n:
            return 0
        blank = n * STREAMS - len(flat)  # the last stream is filled up with words that count for nothing
        shape = lambda a, fill: np.r_[a, np.full(blank, fill, a.dtype)].reshape(STREAMS, n).T.copy()
        x, y, keep, real = shape(before, start), shape(flat, start), shape(keep, 0), shape(np.ones(len(flat), np.float32), 0)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        total, step = passes * (n // WINDOW), 0
        for _ in range(passes):
            h = np.zeros((STREAMS, HIDDEN), np.float32)
            for i in range(0, n, WINDOW):
                step += 1
                grads, h = self._gradients(x[i : i + WINDOW], y[i : i + WINDOW], keep[i : i + WINDOW], h, real[i : i + WINDOW])
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                lr = rate * (1 - step / (total + 1))
                for k, g in grads.items():
                    g = g / max(1.0, size)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return len(flat)

    def packed(self) -> bytes:
        """All weights, one after another."""
        return b"".join(self.p[k].astype("<f4").tobytes() for k in sorted(self.p))

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            w = self.p[k]
            self.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def _gradients(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p = self.p
        steps, out = self._window(x, keep, h)
        flat, want = out.reshape(-1, HIDDEN), y.ravel()
        n = len(flat)
        share = np.full((n, 1), 1 / n, np.float32) if real is None else real.reshape(-1, 1) / np.float32(max(1, real.sum()))
        cls = self._class(want)
        d_class = np.exp(_log_softmax(flat @ p["class_w"] + p["class_b"]))
        d_class[np.arange(n), cls] -= 1
        d_class *= share
        g = {"class_w": flat.T @ d_class, "class_b": d_class.sum(0), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
        d_out = d_class @ p["class_w"].T
        for c in np.unique(cls[cls < self.classes]):
            rows = np.flatnonzero(cls == c)
            d = np.exp(_log_softmax(flat[rows] @ p["word_w"][c].T + p["word_b"][c]))
            d[np.arange(len(rows)), want[rows] - c * CLASS_SIZE] -= 1
            d *= share[rows]
            g["word_w"][c], g["word_b"][c] = d.T @ flat[rows], d.sum(0)
            d_out[rows] += d @ p["word_w"][c]
        d_out = d_out.reshape(out.shape)
        d_gates = np.empty((*x.shape, 3 * HIDDEN), np.float32)
        g["state"], carried = np.zeros_like(p["state"]), np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, new, s = steps[t]
            dh = d_out[t] + carried
            dz = dh * (before - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new * new)
            dr = dn * s * r * (1 - r)
            ds = np.hstack([dz, dr, dn * r])
            d_gates[t] = np.hstack([dz, dr, dn])
            g["state"] += before.T @ ds
            carried = (dh * z + ds @ p["state"].T) * keep[t][:, None]
        per_word = np.zeros((self.words + self.rare, 3 * HIDDEN), np.float32)
        np.add.at(per_word, x.ravel(), d_gates.reshape(-1, 3 * HIDDEN))
        g["bias"], g["input"], g["embed"] = per_word.sum(0), p["embed"].T @ per_word, per_word @ p["input"].T
        return g, out[-1]

    def score(self, documents: list[np.ndarray], start: int, slots: int = 256) -> np.ndarray:
        """Natural log-likelihood of each whole document, rare words by class.

        Documents stand one after another in slots of about equal length, and
        all slots advance together; the state begins anew with a document and
        is carried through all windows of it.
        """
        p = self.p
        lengths = np.array([len(d) for d in documents], np.int64)
        result = np.zeros(len(documents))
        if not len(documents):
            return result
        slots = min(slots, len(documents))
        heap, held = [(0, k) for k in range(slots)], [[] for _ in range(slots)]
        for i in np.argsort(-lengths, kind="stable").tolist():
            size, k = heapq.heappop(heap)
            held[k].append(i)
            heapq.heappush(heap, (size + int(lengths[i]), k))
        held.sort(key=lambda own: -int(lengths[own].sum()))
        sizes = np.array([lengths[own].sum() for own in held])
        flat = np.concatenate([documents[i] for own in held for i in own])
        doc = np.repeat([i for own in held for i in own], lengths[[i for own in held for i in own]])
        first = np.r_[True, doc[1:] != doc[:-1]]
        before = np.where(first, start, np.r_[start, flat[:-1]])
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        gates_of = (p["embed"] @ p["input"] + p["bias"]).astype(np.float32)
        h = np.zeros((slots, HIDDEN), np.float32)
        span = 64
        for t0 in range(0, int(sizes[0]), span):
            states, places = [], []
            for t in range(t0, min(t0 + span, int(sizes[0]))):
                n = int(np.searchsorted(-sizes, -t))  # slots that are longer than t
                at = begins[:n] + t
                h = np.where(first[at][:, None], np.float32(0), h[:n])
                gates, s = gates_of[before[at]], h @ p["state"]
                zr = gates[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                new = zr[:, HIDDEN:] * s[:, 2 * HIDDEN :]
                new += gates[:, 2 * HIDDEN :]
                np.tanh(new, out=new)
                h = new + zr[:, :HIDDEN] * (h - new)
                states.append(h)
                places.append(at)
            at = np.concatenate(places)
            np.add.at(result, doc[at], self._word_logs(np.concatenate(states), flat[at]))
        return result

    def _word_logs(self, h: np.ndarray, want: np.ndarray) -> np.ndarray:
        p = self.p
        cls = self._class(want)
        out = _chosen_logs(h, p["class_w"], p["class_b"], cls).astype(np.float64)
        order = np.argsort(cls.astype(np.int16), kind="stable")  # short numbers are sorted by digits
        edges = np.searchsorted(cls[order], np.arange(self.classes + 1))
        h, member = h[order], want[order] % CLASS_SIZE
        for c in range(self.classes):
            s = slice(edges[c], edges[c + 1])
            if s.stop > s.start:
                out[order[s]] += _chosen_logs(h[s], p["word_w"][c].T, p["word_b"][c], member[s])
        return out
