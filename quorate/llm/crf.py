"""Linear-chain conditional random field with two labels, over many sequences at once (numpy).

Label 1 is "bad" (boilerplate), label 0 "good" (content).  Sequences are ragged: ``first[d]`` is where sequence d's rows begin.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _steps(first: np.ndarray):
    """For each position t, the rows at t of all sequences that are longer than t."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begins, falling = first[:-1][order], -sizes[order]
    for t in range(int(sizes.max(initial=0))):
        k = int(np.searchsorted(falling, -t, side="left"))
        yield t, begins[:k] + t


@dataclass
class Chain:
    weights: np.ndarray  # features -> score of label 1
    moves: np.ndarray  # 2 x 2, score of label a followed by label b

    def emit(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.weights
        return np.stack([np.zeros_like(s), s], axis=1)

    def marginals(self, x: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label 1) of each row, expected label pairs summed over all neighbours (times the row's weight), and the sum of log Z."""
        e = self.emit(x)
        a, b = np.zeros_like(e), np.zeros_like(e)
        steps = [rows for _, rows in _steps(first)]
        for t, rows in enumerate(steps):
            a[rows] = e[rows] + (_lse(a[rows - 1][:, :, None] + self.moves, 1) if t else 0)
        for t in range(len(steps) - 2, -1, -1):
            rows = steps[t + 1] - 1
            b[rows] = _lse(self.moves + (e[rows + 1] + b[rows + 1])[:, None, :], 2)
        z = _lse(a + b, 1)
        p = np.exp(a + b - z[:, None])
        pairs = np.zeros((2, 2))
        if len(steps) > 1:
            rows = np.concatenate(steps[1:])
            each = np.exp(a[rows - 1][:, :, None] + self.moves + (e[rows] + b[rows])[:, None, :] - z[rows][:, None, None])
            pairs = (each if weight is None else each * weight[rows][:, None, None]).sum(0)
        return p[:, 1], pairs, float(z[first[:-1]].sum())

    def viterbi(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label sequence; ties go to label 0."""
        e = self.emit(x)
        best, back = np.zeros_like(e), np.zeros(e.shape, np.int8)
        steps = [rows for _, rows in _steps(first)]
        for t, rows in enumerate(steps):
            if t:
                way = best[rows - 1][:, :, None] + self.moves
                back[rows] = way.argmax(1)
                best[rows] = e[rows] + way.max(1)
            else:
                best[rows] = e[rows]
        label = np.zeros(len(e), np.int8)
        last = first[1:] - 1
        label[last] = best[last].argmax(1)
        for t in range(len(steps) - 2, -1, -1):
            rows = steps[t + 1] - 1
            label[rows] = back[rows + 1, label[rows + 1]]
        return label


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / weight.sum() + l2 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / weight.sum() + (l2 + 1e-9) * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-6:
            break
    return w


#: Strength of the Gaussian prior of a chain's weights, around the line model's for features and around 0 for transitions.
PRIOR = 0.03


def fit_chain(x: np.ndarray, y: np.ndarray, first: np.ndarray, start: np.ndarray, prior: float = PRIOR, rounds: int = 400, rate: float = 0.1, weight: np.ndarray | None = None) -> Chain:
    """Maximise the conditional likelihood of the label sequences, under the prior, until it no longer rises (Adam on all of the bounded
    sample). start: features' weights that the prior is centred on; weight: of each row, the same within a sequence."""
    weight = np.ones(len(y)) if weight is None else weight
    n = weight.sum()
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), weight[at])
    target = x.T @ (weight * y)
    centre = np.concatenate([start, np.zeros(4)])
    theta = centre.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        chain = Chain(theta[:-4], theta[-4:].reshape(2, 2))
        p, pairs, _ = chain.marginals(x, first, weight)
        g = np.concatenate([x.T @ (weight * p) - target, (pairs - seen).ravel()]) / n + prior * (theta - centre)
        if np.abs(g).max() < 5e-4:
            break
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * 0.5 ** (k / 60) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


def line_model(x: np.ndarray, first: np.ndarray, size: np.ndarray, bad: np.ndarray, stands_for: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights that tell bad lines without a look at their neighbours, and the line labels: lines of good documents are good; of a bad
    document, those that the model finds bad, one at least."""
    doc = np.repeat(np.arange(len(bad)), np.diff(first))
    line = np.sqrt(size + 1.0) * stands_for[doc]
    of_class = np.bincount(bad[doc], line, 2)
    y = bad[doc].astype(np.int64)
    w = fit_logistic(x, y, line / np.maximum(of_class, 1e-9)[y])
    for _ in range(2):
        s = x @ w
        top = np.full(len(bad), -np.inf)
        np.maximum.at(top, doc, s)
        y = ((bad[doc] == 1) & ((s > 0) | (s >= top[doc]))).astype(np.int64)
        of = np.bincount(y, line, 2)
        w = fit_logistic(x, y, line / np.maximum(of, 1e-9)[y])
    return w, y


def fit_lines(x: np.ndarray, first: np.ndarray, size: np.ndarray, bad: np.ndarray, stands_for: np.ndarray | None = None) -> Chain:
    """Learn a chain from document labels: line_model() labels the lines of bad documents, and the chain is fitted to those sequences.

    bad[d] is 1 for a bad document.  stands_for[d] is the number of documents that d stands for.  Both classes weigh the same in the chain,
    and its prior holds it near the line model, so that transitions are added only as far as the sequences ask for them.
    """
    stands_for = np.ones(len(bad)) if stands_for is None else stands_for
    doc = np.repeat(np.arange(len(bad)), np.diff(first))
    w, y = line_model(x, first, size, bad, stands_for)
    weight = (stands_for / np.maximum(np.bincount(bad, stands_for, 2), 1e-9)[bad])[doc]
    return fit_chain(x, y, first, w, weight=weight / weight.mean())
