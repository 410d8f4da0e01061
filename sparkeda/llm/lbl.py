"""A log-bilinear language model in numpy, trained by noise-contrastive estimation (NCE).

score(w | x1, x2, x3) = q_w . (C1 r_x1 + C2 r_x2 + C3 r_x3) + b_w. Each of the CONTEXT positions before
a token has a matrix C of its own, context tokens have vectors r and the tokens to predict have vectors q and
biases b. Scores become probabilities by one matrix product and a sum over all classes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

CONTEXT, DIMS = 3, 24
#: Tokens of a step, noise draws that they share, and the learning rate of Adagrad.
BATCH, NOISE, RATE = 512, 32, 0.12
#: A unit of fewer tokens is gone through several times, at most so often.
ENOUGH, REPEATS = 400_000, 8


@dataclass
class Model:
    r: np.ndarray  # inputs x DIMS
    c: np.ndarray  # CONTEXT x DIMS x DIMS
    q: np.ndarray  # classes x DIMS
    b: np.ndarray  # classes
    own: np.ndarray  # the noise distribution: shares of the classes

    def copy(self) -> Model:
        return Model(self.r.copy(), self.c.copy(), self.q.copy(), self.b.copy(), self.own)

    def hidden(self, before: np.ndarray) -> np.ndarray:
        """Predicted vector of each row of context inputs, the nearest first."""
        return self.r[before.reshape(-1)].reshape(len(before), -1) @ self.c.reshape(-1, DIMS)


def initial(n_inputs: int, counts: np.ndarray, seed: int = 7) -> Model:
    """Random vectors, and biases that give each class its share of the tokens."""
    own = ((counts + 1.0) / (counts.sum() + len(counts))).astype(np.float32)
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.normal(0, 0.1, (n, DIMS)).astype(np.float32)
    return Model(draw(n_inputs), np.stack([np.eye(DIMS, dtype=np.float32) / (i + 1) for i in range(CONTEXT)]), draw(len(counts)), np.log(own), own)


def contexts(ids: np.ndarray, start: int, end: int, stop: int) -> np.ndarray:
    """Inputs before tokens start to end; before the first token of a document, and at places beyond it, stands `stop`.

    ids are documents one after another, each closed by `stop`.
    """
    padded = np.concatenate([np.full(max(0, CONTEXT - start), stop, ids.dtype), ids[max(0, start - CONTEXT) : end]])
    n = end - start
    out = np.empty((n, CONTEXT), ids.dtype)
    ended = np.zeros(n, bool)
    for i in range(CONTEXT):
        x = padded[CONTEXT - 1 - i : CONTEXT - 1 - i + n]
        out[:, i] = np.where(ended, ids.dtype.type(stop), x)
        ended |= x == stop
    return out


def _rows(of: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of g for each)."""
    order = np.argsort(of, kind="stable")
    sorted_ = of[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return sorted_[first], np.add.reduceat(g[order], first, axis=0)


def train_unit(model: Model, ids: np.ndarray, class_of: np.ndarray, stop: int, seed: int = 0) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model after all tokens of a unit, and how often each input and each class were seen.

    Noise is drawn from the classes' shares, by a seed that depends on the unit's tokens alone. Each step is one
    of Adagrad on the NCE objective: tell a token from NOISE draws.
    """
    m = model.copy()
    rng = np.random.default_rng([seed, zlib.crc32(ids.tobytes()), len(ids)])
    sums = [np.full(len(m.r), 1e-2, np.float32), np.full(CONTEXT, 1e-2, np.float32), np.full(len(m.q), 1e-2, np.float32), np.full(len(m.b), 1e-2, np.float32)]
    log_noise = np.log(NOISE * m.own)
    cum = np.cumsum(m.own, dtype=np.float64)

    def row_step(p: np.ndarray, s: np.ndarray, of: np.ndarray, g: np.ndarray) -> None:
        of, g = _rows(of, g)
        s[of] += (g * g).mean(1) if g.ndim == 2 else g * g
        scale = RATE / np.sqrt(s[of])
        p[of] += scale[:, None] * g if g.ndim == 2 else scale * g

    before, target = contexts(ids, 0, len(ids), stop), class_of[ids].astype(np.int16)
    c = m.c.reshape(-1, DIMS)  # a view: one product serves all positions
    for _ in range(max(1, min(REPEATS, ENOUGH // max(1, len(ids))))):
        for a in range(0, len(ids), BATCH):
            x, w = before[a : a + BATCH].reshape(-1), target[a : a + BATCH]
            noise = np.minimum(np.searchsorted(cum, rng.random(NOISE) * cum[-1], "right"), len(cum) - 1).astype(np.int16)
            rx = m.r[x].reshape(len(w), -1)
            h = rx @ c
            qw, qn = m.q[w], m.q[noise]
            true = np.einsum("ij,ij->i", h, qw) + m.b[w] - log_noise[w]
            fake = h @ qn.T + (m.b[noise] - log_noise[noise])
            dt = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # 1 - sigmoid
            df = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
            gh = dt[:, None] * qw + df @ qn
            both = np.concatenate([w, noise])
            gb = np.concatenate([dt, df.sum(0)])
            row_step(m.q, sums[2], both, np.concatenate([dt[:, None] * h, df.T @ h]))
            row_step(m.b, sums[3], both, gb)
            gx, gc = (gh @ c.T).reshape(-1, DIMS), rx.T @ gh
            by_place = gc.reshape(CONTEXT, -1)
            sums[1] += (by_place * by_place).mean(1)
            c += np.repeat(0.3 * RATE / np.sqrt(sums[1]), DIMS)[:, None] * gc
            row_step(m.r, sums[0], x, gx)
    return m, np.bincount(ids, minlength=len(m.r)).astype(np.float64), np.bincount(target, minlength=len(m.b)).astype(np.float64)


def weighed(m: Model, seen: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """A unit's model as one vector of sums: each row times how often it was seen, and the counts."""
    n = hit.sum()
    return np.concatenate([(m.r * seen[:, None]).ravel(), seen, (m.q * hit[:, None]).ravel(), m.b * hit, hit, m.c.ravel().astype(np.float64) * n, [n]])


def averaged(m: Model, total: np.ndarray) -> Model:
    """The mean of many units' models; a row that none has seen stays as it was in m."""
    r, n_in, q, b, n_out, c, n = np.split(total, np.cumsum([m.r.size, len(m.r), m.q.size, len(m.b), len(m.b), m.c.size]))
    if not n.any():
        return m
    mean = lambda x, k, old: np.where(k > 0, x / np.maximum(k, 1), old).astype(np.float32)
    return Model(mean(r.reshape(m.r.shape), n_in[:, None], m.r), (c.reshape(m.c.shape) / n[0]).astype(np.float32), mean(q.reshape(m.q.shape), n_out[:, None], m.q), mean(b, n_out, m.b), m.own)


def log10_probabilities(model: Model, ids: np.ndarray, class_of: np.ndarray, stop: int, block: int = 2048) -> np.ndarray:
    """log10 of P(class | context) of each token, mixed with a thousandth of the classes' shares so that none is impossible."""
    out = np.empty(len(ids), np.float64)
    before, target = contexts(ids, 0, len(ids), stop), class_of[ids]
    both = np.concatenate([model.q, model.b[:, None]], 1).T.copy()  # the bias is one more factor
    ones = np.ones(len(model.q), np.float32)
    widest = float(np.sqrt((model.q.astype(np.float64) ** 2).sum(1).max()))
    for a in range(0, len(ids), block):
        w = target[a : a + block]
        h = np.concatenate([model.hidden(before[a : a + block]), np.ones((len(w), 1), np.float32)], 1)
        s = h @ both
        if widest * float(np.sqrt((h * h).sum(1).max())) + float(np.abs(model.b).max()) > 80:  # else exp() can neither overflow nor lose a row
            s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        p = s[np.arange(len(w)), w].astype(np.float64) / (s @ ones)
        out[a : a + block] = np.log10(0.999 * p + 0.001 * model.own[w])
    return out
