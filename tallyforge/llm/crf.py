"""A linear-chain conditional random field with two labels, over many chains at once.

Label 0 has unary score 0, label 1 has features @ weights; transition[a, b] is added for a label b after a label a.
Chains lie one after another in one array, chain i from start[i] to start[i + 1]; each step works on all chains that
are long enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    weights: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]) @ self.weights

    def decode(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The best labels of every chain, by Viterbi; ties go to label 0."""
        return viterbi(self.unary(x), self.transition, start)


def _by_length(start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions of the chains, longest first, and how many chains reach each step."""
    size = np.diff(start)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    reach = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    return start[:-1][order], size, reach


def viterbi(u: np.ndarray, t: np.ndarray, start: np.ndarray) -> np.ndarray:
    first, size, reach = _by_length(start)
    label = np.zeros(len(u), np.int8)
    back = np.zeros((len(u), 2), np.int8)
    best = np.zeros((len(first), 2))
    for k, n in enumerate(reach):
        at = first[:n] + k
        if k == 0:
            best[:n, 0], best[:n, 1] = 0, u[at]
            continue
        via = best[:n, :, None] + t[None]
        back[at] = from_ = (via[:, 1] > via[:, 0]).astype(np.int8)
        best[:n] = np.where(from_ == 1, via[:, 1], via[:, 0])
        best[:n, 1] += u[at]
    held = np.count_nonzero(size)
    now = (best[:held, 1] > best[:held, 0]).astype(np.int8)
    for k in range(len(reach) - 1, -1, -1):
        n = reach[k]
        at = first[:n] + k
        label[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return label


def marginals(u: np.ndarray, t: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at every position, and the expected number of each transition."""
    first, _, reach = _by_length(start)
    alpha, beta = np.zeros((len(u), 2)), np.zeros((len(u), 2))
    score = np.stack([np.zeros(len(u)), u], axis=1)
    for k, n in enumerate(reach):
        at = first[:n] + k
        alpha[at] = score[at] if k == 0 else score[at] + np.logaddexp(*np.moveaxis(alpha[at - 1][:, :, None] + t, 1, 0))
    pairs = np.zeros((2, 2))
    for k in range(len(reach) - 1, 0, -1):
        n = reach[k]
        at = first[:n] + k
        ahead = score[at] + beta[at]
        beta[at - 1] = np.logaddexp(*np.moveaxis(t[None] + ahead[:, None, :], 2, 0))
        joint = alpha[at - 1][:, :, None] + t + ahead[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), pairs


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adam on the full gradient."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model = Crf(np.zeros(x.shape[1] + 1), np.zeros((2, 2)), mean, scale)
    xs = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    inner = np.ones(len(x), bool)
    inner[start[:-1][np.diff(start) > 0]] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at - 1], y[at]), 1)
    m = [np.zeros_like(model.weights), np.zeros((2, 2))]
    v = [np.zeros_like(model.weights), np.zeros((2, 2))]
    for k in range(1, steps + 1):
        p, pairs = marginals(xs @ model.weights, model.transition, start)
        grads = xs.T @ (y - p) / len(x) - ridge * model.weights, (seen - pairs) / len(x) - ridge * model.transition
        for i, (w, g) in enumerate(zip((model.weights, model.transition), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    return model
