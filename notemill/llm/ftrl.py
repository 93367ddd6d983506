"""FTRL-proximal logistic regression over hashed binary features: per-coordinate rates and L1 sparsity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 20


@dataclass
class Sparse:
    """What training leaves: a bias and the few weights that L1 has not kept at zero."""

    bias: float
    index: np.ndarray
    weight: np.ndarray

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS, np.float32)
        full[self.index] = self.weight
        return full


class Ftrl:
    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias, without L1

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        l1 = np.where(index == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, label: float, importance: float = 1.0) -> None:
        """index: the distinct features of one document."""
        index = np.append(index, 1 << BITS)
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * importance
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += g * g

    def fit(self, documents: list[np.ndarray], labels: np.ndarray, passes: int, seed: int = 7, importance: np.ndarray | None = None) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(passes):
            for i in order.permutation(len(documents)):
                self.learn(documents[i], labels[i], 1.0 if importance is None else importance[i])
        return self

    def sparse(self) -> Sparse:
        w = self.weights(np.arange((1 << BITS) + 1))
        index = np.flatnonzero(w[:-1])
        return Sparse(float(w[-1]), index.astype(np.int32), w[index].astype(np.float32))


def summed(rows: np.ndarray, index: np.ndarray, table: np.ndarray, count: int) -> np.ndarray:
    """Sum of the weights of each row's distinct features; only features with a weight are made distinct."""
    hit = table[index] != 0
    key = np.unique(rows[hit].astype(np.int64) << BITS | index[hit])
    return np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=count)[:count]


def per_row(rows: np.ndarray, index: np.ndarray, count: int) -> list[np.ndarray]:
    """Each row's distinct features."""
    key = np.unique(rows.astype(np.int64) << BITS | index)
    cuts = np.searchsorted(key >> BITS, np.arange(count + 1))
    low = (key & ((1 << BITS) - 1)).astype(np.int32)
    return [low[cuts[i] : cuts[i + 1]] for i in range(count)]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
