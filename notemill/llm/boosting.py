"""Gradient-boosted trees over a table of counted feature patterns, applied as a DataFrame expression.

With few small integer features all documents' candidates fall into a bounded number of patterns, so Spark counts
positives and totals of each pattern over all data, and boosting on those counts equals boosting on every candidate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Row = tuple[tuple[int, ...], float, float]  # features, positives, total
Tree = tuple | float  # (feature, threshold, below or equal, above) or a leaf


def _leaf(rows: list, l2: float) -> float:
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return g / (h + l2)


def _grow(rows: list, depth: int, l2: float, least: float) -> Tree:
    """rows: (features, gradient, hessian) sums of a pattern."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-9, None, None)
    for f in range(len(rows[0][0])) if depth and rows else ():
        by: dict[int, list[float]] = {}
        for x, gi, hi in rows:
            s = by.setdefault(x[f], [0.0, 0.0])
            s[0] += gi
            s[1] += hi
        lg = lh = 0.0
        for value in sorted(by)[:-1]:
            lg, lh = lg + by[value][0], lh + by[value][1]
            if lh < least or h - lh < least:
                continue
            gain = lg * lg / (lh + l2) + (g - lg) ** 2 / (h - lh + l2) - g * g / (h + l2)
            if gain > best[0]:
                best = (gain, f, value)
    if best[1] is None:
        return _leaf(rows, l2) if rows else 0.0
    _, f, value = best
    return (f, value, _grow([r for r in rows if r[0][f] <= value], depth - 1, l2, least), _grow([r for r in rows if r[0][f] > value], depth - 1, l2, least))


def _apply(tree: Tree, x: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _chance(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@dataclass
class Boosted:
    bias: float
    rate: float
    trees: list[Tree]
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: tuple[int, ...]) -> float:
        return self.bias + self.rate * sum(_apply(t, x) for t in self.trees)

    def probability(self, x: tuple[int, ...]) -> float:
        return _chance(self.slope * self.raw(x) + self.offset)

    def column(self, features: list[Column]) -> Column:
        def grown(tree: Tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(features[tree[0]] <= tree[1], grown(tree[2])).otherwise(grown(tree[3]))

        total = F.lit(self.bias)
        for t in self.trees:
            total = total + F.lit(self.rate) * grown(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * total + F.lit(self.offset))))


def boost(rows: list[Row], trees: int = 20, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 0.5) -> Boosted:
    """Newton boosting of the logistic loss. No rows: a model that says one half."""
    total = sum(r[2] for r in rows)
    if not total:
        return Boosted(0.0, rate, [])
    share = (sum(r[1] for r in rows) + 0.5) / (total + 1)
    model = Boosted(math.log(share / (1 - share)), rate, [])
    scores = [model.bias] * len(rows)
    for _ in range(trees):
        parts = []
        for (x, positives, n), z in zip(rows, scores, strict=True):
            p = _chance(z)
            parts.append((x, positives - n * p, n * p * (1 - p)))
        tree = _grow(parts, depth, l2, least)
        model.trees.append(tree)
        scores = [z + rate * _apply(tree, x) for z, (x, _, _) in zip(scores, rows, strict=True)]
    return model


def calibrate(model: Boosted, rows: list[Row]) -> Boosted:
    """Platt scaling on counts that the trees were not grown on, pulled weakly towards no change."""
    a, b = 1.0, 0.0
    seen = [(model.raw(x), positives, n) for x, positives, n in rows]
    for _ in range(25):
        ga, gb, haa, hab, hbb = a - 1.0, b, 1.0, 0.0, 1.0
        for z, positives, n in seen:
            p = _chance(a * z + b)
            r, w = n * p - positives, n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + r * z, gb + r, haa + w * z * z, hab + w * z, hbb + w
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    return Boosted(model.bias, model.rate, model.trees, a, b)


def threshold(model: Boosted, rows: list[Row], precision: float) -> float:
    """The lowest calibrated probability from which on the rows reach the precision; above 1 if none does."""
    scored = sorted(((model.probability(x), positives, n) for x, positives, n in rows), reverse=True)
    best, hit, total = 1.01, 0.0, 0.0
    for i, (p, positives, n) in enumerate(scored):
        hit, total = hit + positives, total + n
        if hit >= precision * total and (i + 1 == len(scored) or scored[i + 1][0] < p):
            best = p
    return best
