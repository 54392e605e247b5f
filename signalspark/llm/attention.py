"""A small causal self-attention model in numpy, over words given as vectors.

One layer, one head. A position sees the words before it in windows of two blocks: its own block and the one
before, so windows overlap by a block and every word is scored once, in the later block of its window. What it
predicts is the class of the next word; the classes' shares of the corpus are the starting point, which the
attention corrects.
"""

from __future__ import annotations

import math

import numpy as np

#: Words of a block, width of a word's vector and of the model, classes (the last one is the end of a text).
BLOCK, WIDTH, CLASSES = 16, 24, 48

SHAPES = {
    "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "place": (BLOCK, 2 * BLOCK),
    "own": (WIDTH, WIDTH), "seen": (WIDTH, WIDTH), "shift": (WIDTH,), "out": (WIDTH, CLASSES),
}
SPANS, SIZE = {}, 0
for _name, _shape in SHAPES.items():
    SPANS[_name] = slice(SIZE, SIZE := SIZE + math.prod(_shape))
#: A position sees the positions before and itself (whose input is the word before).
CAUSAL = np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {name: flat[SPANS[name]].reshape(shape) for name, shape in SHAPES.items()}


def start(seed: int = 7) -> np.ndarray:
    """Weights before training: every word has the classes' shares."""
    flat = np.zeros(SIZE, np.float32)
    random, p = np.random.default_rng(seed), views(flat)
    for name in ("query", "key", "value", "own", "seen"):
        p[name][:] = random.normal(0, 0.5 / np.sqrt(WIDTH), p[name].shape)
    p["shift"][:] = 0.1  # so that a text's first word, which sees only zeros, teaches too
    return flat


def prior(counts: np.ndarray) -> np.ndarray:
    """Log shares of the classes, from their counts; one never seen has a small share."""
    full = counts + 0.5
    return np.log(full / full.sum()).astype(np.float32)


def windows(x: np.ndarray) -> np.ndarray:
    """Overlapping windows of two blocks over rows whose first block is context."""
    n, s = len(x) // BLOCK - 1, x.strides
    return np.lib.stride_tricks.as_strided(x, (n, 2 * BLOCK, x.shape[1]), (BLOCK * s[0], s[0], s[1]))


def sums_of(x: np.ndarray) -> np.ndarray:
    """Of each row, as a product, which takes a fraction of the time that ``sum`` takes on short rows."""
    return x @ np.ones(x.shape[1], np.float32)


class Pass:
    """One pass over a run of words: for each the vector of the word before, its class, and the index of its text's
    first word. All start with a block of context, which is seen but not scored, and fill whole blocks.

    Keys and values are linear in the vectors, so queries are compared with, and weights applied to, the vectors themselves:
    (x query) (y key)' = (x query key') y', and sum a (y value) seen = (sum a y) (value seen)."""

    def __init__(self, flat: np.ndarray, bias: np.ndarray, before: np.ndarray, classes: np.ndarray, first: np.ndarray):
        p = self.p = views(flat)
        n = len(classes) - BLOCK
        self.target, self.x = classes[BLOCK:], windows(before)
        a = (before[BLOCK:] @ (p["query"] @ p["key"].T)).reshape(-1, BLOCK, WIDTH) @ self.x.transpose(0, 2, 1)
        a += np.where(CAUSAL, p["place"], np.float32(-np.inf))
        np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        starts = np.arange(len(a)) * BLOCK
        cut = np.flatnonzero(first[BLOCK:].reshape(-1, BLOCK)[:, -1] > starts)
        a[cut] *= (starts[cut, None] + np.arange(2 * BLOCK))[:, None, :] >= first[BLOCK:].reshape(-1, BLOCK)[cut][:, :, None]
        self.a, self.total = a, sums_of(a.reshape(n, -1))[:, None]
        self.both = np.empty((n, 2 * WIDTH), np.float32)  # the word before, and what is seen
        self.both[:, :WIDTH] = before[BLOCK:]
        np.divide((a @ self.x).reshape(n, WIDTH), self.total, out=self.both[:, WIDTH:])
        self.mixed = p["value"] @ p["seen"]
        self.h = self.both @ np.concatenate([p["own"], self.mixed])
        self.h += p["shift"]
        np.maximum(self.h, 0, out=self.h)
        z = self.h @ p["out"]
        z += bias
        picked = z[np.arange(n), self.target]
        np.exp(z, out=z)
        self.z, self.sums = z, sums_of(z)
        self.logs = picked - np.log(self.sums)

    def gradient(self, scored: np.ndarray) -> np.ndarray:
        """Of the mean negative log likelihood over the ``scored`` words (a mask)."""
        p, n = self.p, len(self.h)
        flat = np.zeros(SIZE, np.float32)
        g = views(flat)
        weight = (scored / max(1, scored.sum())).astype(np.float32)
        dz = self.z * (weight / self.sums)[:, None]
        dz[np.arange(n), self.target] -= weight
        np.matmul(self.h.T, dz, out=g["out"])
        dh = dz @ p["out"].T
        dh *= self.h > 0
        g["shift"][:] = sums_of(dh.T)
        both = self.both.T @ dh
        g["own"][:] = both[:WIDTH]
        g["value"][:], g["seen"][:] = both[WIDTH:] @ p["seen"].T, p["value"].T @ both[WIDTH:]
        dc = dh @ self.mixed.T
        dc /= self.total
        da = dc.reshape(-1, BLOCK, WIDTH) @ self.x.transpose(0, 2, 1)
        da -= sums_of(dc * self.both[:, WIDTH:]).reshape(-1, BLOCK, 1)
        da *= self.a
        g["place"][:] = np.where(CAUSAL, da.sum(axis=0), 0)
        product = self.both[:, :WIDTH].T @ (da @ self.x).reshape(n, WIDTH)  # of the query by the key
        g["query"][:], g["key"][:] = product @ p["key"], product.T @ p["query"]
        return flat


def runs(vectors: np.ndarray, classes: np.ndarray, first: np.ndarray, run: int):
    """Runs of words (start, stop, and what a :class:`Pass` takes), each with a block of context in front and filled
    up to whole blocks. What precedes a text's first word is the zero vector."""
    for low in range(0, len(classes), run):
        high = min(low + run, len(classes))
        size = BLOCK + (high - low) + -(high - low) % BLOCK
        before, own, where = np.zeros((size, WIDTH), np.float32), np.zeros(size, np.int64), np.full(size, -BLOCK - 1)
        lead = min(BLOCK, low)
        at, held = slice(BLOCK - lead, BLOCK + high - low), slice(low - lead, high)
        before[at][:1], before[at][1:] = vectors[low - lead - 1], vectors[low - lead : high - 1]
        before[at][first[held] == np.arange(low - lead, high)] = 0
        own[at] = classes[held]
        where[at] = first[held] - (low - BLOCK)
        where[BLOCK + high - low :] = high - low + BLOCK
        yield low, high, (before, own, where)


def score(flat: np.ndarray, bias: np.ndarray, vectors: np.ndarray, classes: np.ndarray, first: np.ndarray, run: int = 2048) -> np.ndarray:
    """Natural log of the probability of each word's class, given the words before it in its window."""
    out = np.empty(len(classes))
    for low, high, own in runs(vectors, classes, first, run):
        out[low:high] = Pass(flat, bias, *own).logs[: high - low]
    return out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.steps, self.m, self.s = rate, 0, np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)

    def step(self, flat: np.ndarray, gradient: np.ndarray) -> None:
        self.steps += 1
        self.m += 0.1 * (gradient - self.m)
        self.s += 0.01 * (gradient**2 - self.s)
        flat -= self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.s / (1 - 0.99**self.steps)) + 1e-8)


def train(flat: np.ndarray, bias: np.ndarray, vectors: np.ndarray, classes: np.ndarray, first: np.ndarray, adam: Adam, run: int = 2048) -> None:
    """One walk over the words, in place."""
    for low, high, own in runs(vectors, classes, first, run):
        done = Pass(flat, bias, *own)
        adam.step(flat, done.gradient(np.arange(len(done.h)) < high - low))
