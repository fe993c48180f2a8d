"""Gradient-boosted trees over binned features, with Platt's calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 32, 4, 60, 0.2, 1.0, 8


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Boosted:
    """Trees of one depth as arrays: for each inner node a feature and a bound (go right above it),
    for each leaf a value."""

    start: float
    features: np.ndarray
    bounds: np.ndarray
    leaves: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.start), np.arange(len(x))
        for f, b, v in zip(self.features, self.bounds, self.leaves, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[row, f[at]] > b[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Trees for the log-odds of ``y`` (0 or 1), each fitted to gradient and curvature of the loss by
    histograms of bins."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(d)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = codes + np.arange(d) * BINS
    start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    odds, inner = np.full(n, start), 2**DEPTH - 1
    features, bounds, leaves = [], [], []
    for _ in range(trees):
        p = sigmoid(odds)
        grad, curve = y - p, p * (1 - p)
        at, f, b = np.zeros(n, int), np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            key = (flat + ((at - first) * d * BINS)[:, None]).ravel()
            g, h, m = (np.bincount(key, np.repeat(w, d), nodes * d * BINS).reshape(nodes, d, BINS).cumsum(axis=2) for w in (grad, curve, np.ones(n)))
            all_g, all_h, all_m = g[:, :, -1:], h[:, :, -1:], m[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(m < LEAST) | (all_m - m < LEAST)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                j, c = divmod(int(best[k]), BINS)
                if gain[k, j, c] > 1e-9 and c < len(edges[j]):
                    f[first + k], b[first + k] = j, edges[j][c]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > b[at])
        at -= inner
        v = RATE * np.bincount(at, grad, inner + 1) / (np.bincount(at, curve, inner + 1) + RIDGE)
        odds += v[at]
        features.append(f)
        bounds.append(b)
        leaves.append(v)
    return Boosted(start, np.array(features), np.array(bounds), np.array(leaves))


def platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make probabilities of log-odds, by Newton's steps on smoothed labels."""
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    w = np.array([1.0, 0.0])
    z = np.stack([odds, np.ones(len(odds))], axis=1)
    for _ in range(50):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (t - p))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def least_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on at least so large a share is positive; 2 if there is none."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    # Equal probabilities stand or fall together.
    last = np.r_[p[order][:-1] != p[order][1:], True] if len(p) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 2.0
