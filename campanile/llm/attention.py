"""A small causal self-attention model over subword ids, in numpy: probabilities and gradients."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

#: Tokens a window scores; it sees as many before them.
BLOCK = 8
#: Width of the vectors, and side of the square of known symbols: a class and a place in it.
WIDTH, SIDE = 16, 32

_SCALE = WIDTH**-0.5
_BACK = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]  # steps from each query back to each key
_CAUSAL = (_BACK >= 0).astype(np.float32)
#: Scores are held within these bounds, which a trained model does not reach, so that no exponential runs over or vanishes.
_MOST = 60.0
#: The row after the known symbols.
PAD = SIDE * SIDE
#: Where each symbol's row of two vectors lies in a table of such rows, in pairs of numbers.
_CELLS = np.arange((PAD + 1) * WIDTH).reshape(PAD + 1, WIDTH)
#: Rows of output weights: a vector's, the biases', and as many zeros as make the rows of products lie evenly in memory.
_ROWS = WIDTH + 4


@dataclass
class Parameters:
    """Vectors of the known symbols as query, key, value and in themselves; a bias for each distance; output weights of the classes and of the places in each."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    self_: np.ndarray
    distance: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_place: np.ndarray
    place_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        table = (SIDE * SIDE, WIDTH)
        return [table, table, table, table, (2 * BLOCK,), (WIDTH, SIDE), (SIDE,), (SIDE, WIDTH, SIDE), (SIDE, SIDE)]

    @classmethod
    def of(cls, flat: np.ndarray) -> Parameters:
        """Views of `flat` where that is of 32-bit numbers."""
        sizes = np.cumsum([int(np.prod(s)) for s in cls.shapes()])[:-1]
        return cls(*(part.reshape(s).astype(np.float32, copy=False) for part, s in zip(np.split(flat, sizes), cls.shapes())))

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 7) -> Parameters:
        """Small random vectors; the biases make the symbols as likely as `counts` says."""
        rng = np.random.default_rng(seed)
        drawn = [rng.normal(0, 0.1, s) for s in cls.shapes()]
        p = cls(*(a.astype(np.float32) for a in drawn))
        share = (counts + 0.5) / (counts + 0.5).sum()
        p.distance[:] = 0
        p.class_bias[:] = np.log(share.reshape(SIDE, SIDE).sum(1))
        p.place_bias[:] = np.log(share.reshape(SIDE, SIDE) / share.reshape(SIDE, SIDE).sum(1, keepdims=True))
        return p


def blocks(sequences: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of overlapping windows: (windows, 2 BLOCK) symbols seen, (windows, BLOCK) symbols to score, and each target's sequence.

    The symbols before a target are its inputs, with `first` before the first. A window scores its last BLOCK places; PAD fills what is not there, and each target is scored once.
    """
    seen, wanted, owner = [], [], []
    for i, s in enumerate(sequences):
        n = -(-len(s) // BLOCK)
        x = np.full((n + 1) * BLOCK, PAD, np.int32)
        x[BLOCK] = first
        x[BLOCK + 1 : BLOCK + len(s)] = s[:-1]
        y = np.full(n * BLOCK, PAD, np.int32)
        y[: len(s)] = s
        x = x.reshape(-1, BLOCK)
        seen.append(np.concatenate([x[:-1], x[1:]], 1))
        wanted.append(y.reshape(-1, BLOCK))
        owner.append(np.full(n, i))
    return np.concatenate(seen), np.concatenate(wanted), np.concatenate(owner)


def keep_memory() -> None:
    """Lets this process keep the memory of freed arrays of up to 8 MB (glibc learns the bound from the first one freed); else it is handed back and asked for at each step."""
    np.empty(8 << 20, np.uint8)


def _exp(x: np.ndarray) -> np.ndarray:
    """In place."""
    flat = x.reshape(-1)
    if flat.size and not (flat.max() <= _MOST and flat.min() >= -_MOST):
        np.clip(x, -_MOST, _MOST, out=x)
    return np.exp(x, out=x)


def _total(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis; one product with ones is the quick way for short rows."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32)).reshape(x.shape[:-1])


def _turned(x: np.ndarray) -> np.ndarray:
    """Each matrix transposed and copied; small products with views that are only turned are slower than the copy."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _table(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two vectors of each symbol side by side, and PAD's row of zeros."""
    out = np.zeros((PAD + 1, 2 * WIDTH), np.float32)
    out[:PAD, :WIDTH], out[:PAD, WIDTH:] = left, right
    return out


def _factor(p: Parameters) -> np.ndarray:
    """Distances and causality as factors of the weights."""
    return np.exp(np.clip(p.distance, -_MOST, _MOST))[np.maximum(_BACK, 0)] * _CAUSAL


def _leave_pads(a: np.ndarray, seen: np.ndarray) -> None:
    """Takes the weight of what is not there; a window of `blocks` that has such places has one at its beginning or its end."""
    padded = np.flatnonzero((seen[:, 0] == PAD) | (seen[:, -1] == PAD))
    a[padded] *= (seen[padded] != PAD)[:, None, :]


def _weights(p: Parameters) -> np.ndarray:
    """For each class the output weights of all classes and of its own places side by side, with the biases as the row after them."""
    out = np.zeros((SIDE, _ROWS, 2 * SIDE), np.float32)
    out[:, :WIDTH, :SIDE], out[:, WIDTH, :SIDE], out[:, :WIDTH, SIDE:], out[:, WIDTH, SIDE:] = p.to_class, p.class_bias, p.to_place, p.place_bias
    return out


def _outputs(weights: np.ndarray, h: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the targets that are there, those of a class together: their places in `wanted`; each class with where its targets begin and end; their vectors
    with a one for the biases; the exponentials of the classes and of the places, a row for each; and where in these the target's own are."""
    y = wanted.ravel()
    group = (y // SIDE).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=SIDE + 1))[:SIDE].tolist()  # PAD comes after all classes
    order = order[: ends[-1]]
    rows = np.zeros((len(order), _ROWS), np.float32)
    rows[:, :WIDTH] = h.take(order, axis=0)
    rows[:, WIDTH] = 1
    parts = [(c, begin, end) for c, (begin, end) in enumerate(zip([0, *ends[:-1]], ends)) if begin < end]
    logits = np.empty((len(order), 2 * SIDE), np.float32)
    for c, begin, end in parts:
        np.matmul(rows[begin:end], weights[c], out=logits[begin:end])
    cells = np.arange(0, logits.size, SIDE)
    cells[::2] += group.take(order)
    cells[1::2] += y.take(order) % SIDE
    return order, parts, rows, _exp(logits).reshape(-1, SIDE), cells


class Scorer:
    """Log-probabilities by fixed parameters, whose tables are prepared once: each symbol's weight for each one before it, PAD's row, distances and causality as factors."""

    def __init__(self, p: Parameters):
        keep_memory()
        none = np.zeros((1, WIDTH), np.float32)
        self.weights, self.factor = _weights(p), _factor(p)
        query, key, self.value, self.own = (np.concatenate([t, none]) for t in (p.query * np.float32(_SCALE), p.key, p.value, p.self_))
        self.pairs = _exp(query @ key.T).ravel()

    def attend(self, seen: np.ndarray) -> np.ndarray:
        seen = seen.astype(np.intp)
        here = seen[:, BLOCK:]
        a = self.pairs.take((here * (PAD + 1))[:, :, None] + seen[:, None, :], mode="clip")  # none is out of bounds
        a *= self.factor
        _leave_pads(a, seen)
        h = a @ self.value.take(seen, axis=0)
        h /= np.maximum(_total(a), 1e-30)[:, :, None]
        h += self.own.take(here, axis=0)
        return h.reshape(-1, WIDTH)

    def __call__(self, seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        order, _, _, found, cells = _outputs(self.weights, self.attend(seen), wanted)
        share = found.ravel().take(cells)
        share /= _total(found)
        result = np.zeros(wanted.size, np.float32)
        result[order] = np.log(share[::2] * share[1::2])
        return result.reshape(wanted.shape)


def log_probability(p: Parameters, seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Natural logarithms of the targets' probabilities, 0 at PAD."""
    return Scorer(p)(seen, wanted)


def _gather(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each symbol, which have two vectors; PAD has none. Two neighbouring numbers are added at a time, as one complex number."""
    out = np.zeros((PAD + 1, 2 * WIDTH), np.float32)
    np.add.at(out.view(np.complex64).ravel(), _CELLS.take(ids.ravel(), axis=0).ravel(), rows.view(np.complex64).ravel())
    return out[:PAD]


def gradient(p: Parameters, seen: np.ndarray, wanted: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log-probability of the targets, and its gradient in the order of `flat`."""
    g = np.empty_like(p.flat())
    terms = _slope(p, seen, wanted, Parameters.of(g))
    return float(-np.log(terms).sum() / (len(terms) // 2)), g


def _slope(p: Parameters, seen: np.ndarray, wanted: np.ndarray, to: Parameters) -> np.ndarray:
    """Two factors of the probability of each target; the gradient of the mean goes to `to`."""
    here = seen[:, BLOCK:]
    at_here, at_seen = _table(p.query * np.float32(_SCALE), p.self_).take(here, axis=0), _table(p.key, p.value).take(seen, axis=0)
    (q, own), (k, v) = ((x[:, :, :WIDTH], x[:, :, WIDTH:]) for x in (at_here, at_seen))
    a = _exp(q @ _turned(k))
    a *= _factor(p)
    _leave_pads(a, seen)
    a /= np.maximum(_total(a), 1e-30)[:, :, None]
    h = a @ v
    h += own
    weights = _weights(p)
    order, parts, rows, outer, cells = _outputs(weights, h.reshape(-1, WIDTH), wanted)
    outer /= _total(outer)[:, None]
    terms = outer.ravel().take(cells)
    outer.ravel()[cells] = terms - 1
    outer = outer.reshape(-1, 2 * SIDE)
    back = _turned(weights[:, :WIDTH])
    d_weights, d_rows = np.zeros_like(weights), np.zeros((len(rows) + 1, WIDTH), np.float32)
    for c, begin, end in parts:
        some = outer[begin:end]
        np.matmul(rows[begin:end].T, some, out=d_weights[c])
        np.matmul(some, back[c], out=d_rows[begin:end])
    place = np.full(wanted.size, len(rows))
    place[order] = np.arange(len(rows))
    d_here, d_seen = np.empty_like(at_here), np.empty_like(at_seen)
    d_out = d_rows.take(place, axis=0).reshape(h.shape)
    d_s = d_out @ _turned(v)
    d_s *= a
    d_s -= a * _total(d_s)[:, :, None]
    np.matmul(d_s, k, out=d_here[:, :, :WIDTH])
    d_here[:, :, WIDTH:] = d_out
    np.matmul(d_s.transpose(0, 2, 1), q, out=d_seen[:, :, :WIDTH])
    np.matmul(a.transpose(0, 2, 1), d_out, out=d_seen[:, :, WIDTH:])
    d_here, d_seen = _gather(here, d_here), _gather(seen, d_seen)
    d_distance = np.bincount(np.maximum(_BACK, 0).ravel(), d_s.sum(0).ravel() * (_BACK >= 0).ravel(), 2 * BLOCK)
    d_class, d_place, share = d_weights[:, :, :SIDE].sum(0), d_weights[:, :, SIDE:], np.float32(1 / len(rows))
    found = [
        d_here[:, :WIDTH] * np.float32(_SCALE), d_seen[:, :WIDTH], d_seen[:, WIDTH:], d_here[:, WIDTH:],
        d_distance.astype(np.float32), d_class[:WIDTH], d_class[WIDTH], d_place[:, :WIDTH], d_place[:, WIDTH],
    ]
    for x, out in zip(found, to.arrays()):
        np.multiply(x, share, out=out)
    return terms


class Adam:
    """Parameters on their way: one step for each call."""

    def __init__(self, p: Parameters):
        self.x = p.flat().astype(np.float32)
        self.g = np.empty_like(self.x)
        self.now, self.slope = Parameters.of(self.x), Parameters.of(self.g)
        # ten times the running mean of the gradient, and a hundred times that of its square
        self.m, self.s, self.steps = np.zeros_like(self.x), np.zeros_like(self.x), 0

    def step(self, seen: np.ndarray, wanted: np.ndarray, rate: float) -> None:
        g = self.g
        _slope(self.now, seen, wanted, self.slope)
        self.steps += 1
        self.m *= np.float32(0.9)
        self.m += g
        self.s *= np.float32(0.99)
        g *= g
        self.s += g
        scale = math.sqrt(0.01 / (1 - 0.99**self.steps))
        np.sqrt(self.s, out=g)
        g += np.float32(1e-8 / scale)
        np.divide(self.m, g, out=g)
        g *= np.float32(0.1 * rate / (1 - 0.9**self.steps) / scale)
        self.x -= g


def fit(p: Parameters, seen: np.ndarray, wanted: np.ndarray, steps: int, rate: float, batch: int = 128, seed: int = 0) -> Parameters:
    """Adam over the windows in random order, as often as `steps` needs; the rate falls to a tenth on the way."""
    rng = np.random.default_rng(seed)
    adam = Adam(p)
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < min(batch, len(seen)):
            order = np.concatenate([order, rng.permutation(len(seen))])
        rows, order = order[:batch], order[batch:]
        adam.step(seen[rows], wanted[rows], rate * (1 - 0.9 * t / steps))
    return Parameters.of(adam.x)


class Stream:
    """Learning from windows that come in parts and are kept only for a while: each is learned from once, in random order among those of a buffer.

    The rate falls as 1 / (1 + t / `least`), to a tenth. Where all windows fit into the buffer, `fit` goes over them, for `least` steps at least.
    """

    def __init__(self, p: Parameters, rate: float, least: int, batch: int = 512, seed: int = 0):
        self.begin, self.rate, self.least, self.batch, self.rng = p, rate, least, batch, np.random.default_rng(seed)
        self.adam, self.parts, self.held, self.tokens = None, [], 0, 0
        keep_memory()

    def add(self, seen: np.ndarray, wanted: np.ndarray) -> None:
        self.parts.append((seen, wanted))
        self.held += len(seen)
        self.tokens += int((wanted != PAD).sum())
        if self.held >= 2 * self.least * self.batch:
            self._learn(self.least * self.batch)

    def _learn(self, most_left: int) -> None:
        """Steps over the windows in the buffer until at most so many are left, which go back to it."""
        self.adam = self.adam or Adam(self.begin)
        seen, wanted = (np.concatenate(x) for x in zip(*self.parts))
        order = self.rng.permutation(len(seen))
        while len(order) > most_left:
            rows, order = order[: self.batch], order[self.batch :]
            self.adam.step(seen[rows], wanted[rows], self.rate * max(0.1, 1 / (1 + self.adam.steps / self.least)))
        self.parts, self.held = [(seen[order], wanted[order])], len(order)

    def end(self) -> Parameters:
        if self.adam:
            self._learn(0)
            return Parameters.of(self.adam.x)
        seen, wanted = (np.concatenate(x) for x in zip(*self.parts))
        batch = min(self.batch, max(128, len(seen) // self.least))
        return fit(self.begin, seen, wanted, max(self.least, -(-len(seen) // batch)), self.rate, batch)
