"""Sparse logistic regression on hashed features: what two classifiers of this package share.

Features are hashed where the rows are; only a bounded sample of labelled rows
reaches the driver, as lists of feature numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CACHED = 300_000


class TokenHasher(dict):
    """Feature numbers of a blank-separated token: the lower-case word without marks, then its beginnings. Bounded memory."""

    def __init__(self, bits: int, beginnings: tuple[int, ...] = (4, 6), most: int = MOST_CACHED):
        super().__init__()
        self.mask, self.beginnings, self.most = (1 << bits) - 1, beginnings, most

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        word = "".join(ch for ch in token if ch.isalnum())
        names = [word] + [f"{word[:n]}*" for n in self.beginnings if len(word) > n] if word else []
        self[token] = out = tuple(zlib.crc32(x.encode()) & self.mask for x in names)
        return out

    def of(self, text: str | None) -> list[int]:
        """Distinct feature numbers of a whole text, ascending."""
        return sorted(set().union(*map(self.__getitem__, set((text or "").lower().split()))))


class Rows:
    """Sparse 0/1 rows, one behind another."""

    def __init__(self, rows: list[list[int]]):
        self.lengths = np.array([len(x) for x in rows], np.int64)
        self.flat = np.concatenate([np.array(x, np.int64) for x in rows]) if len(rows) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.lengths)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], minlength=len(self.lengths))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling_features(rows: Rows, labels: np.ndarray, size: int, least: float = 25.0, most: int = 500) -> np.ndarray:
    """Features whose presence depends on the label: chi-square from ``least`` on, the ``most`` strongest, ascending."""
    n, pos = len(labels), float(labels.sum())
    if not n or pos in (0.0, float(n)):
        return np.zeros(0, np.int64)
    there = np.bincount(rows.flat, minlength=size).astype(float)
    hits = np.bincount(rows.flat, labels[rows.owner], minlength=size)
    expected = there * pos / n
    spread = expected * (1 - pos / n) * (1 - there / n)
    chi = np.where(spread > 0, (hits - expected) ** 2 / np.maximum(spread, 1e-12), 0.0)
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] >= least])


def telling_in_table(rows: DataFrame, features: str, label: str, least: float = 25.0, most: int = 500) -> list[int]:
    """As ``telling_features``, counted where the rows are: at most ``most`` features come to the driver."""
    n, pos = rows.agg(F.count(label), F.coalesce(F.sum(label), F.lit(0))).first()
    if not pos or pos == n:
        return []
    counts = rows.filter(F.col(label).isNotNull()).select(F.explode(features).alias("f"), label)
    counts = counts.groupBy("f").agg(F.count("*").alias("there"), F.sum(label).alias("hits"))
    expected = F.col("there") * (pos / n)
    chi = F.pow(F.col("hits") - expected, 2) / F.nullif(expected * (1 - pos / n) * (1 - F.col("there") / n), F.lit(0.0))
    best = counts.withColumn("chi", chi).filter(F.col("chi") >= least).orderBy(F.desc("chi"), "f").limit(most)
    return sorted(r["f"] for r in best.collect())


def only(features: str, chosen: list[int]) -> Column:
    """The chosen ones of an array of feature numbers."""
    return F.array_intersect(features, F.lit(np.array(sorted(chosen), np.int32)) if chosen else F.array().cast("array<int>"))


def dense(rows: Rows, features: np.ndarray) -> np.ndarray:
    """0/1 matrix of the given features (ascending), one row each."""
    out = np.zeros((len(rows.lengths), len(features)), np.float32)
    at = np.searchsorted(features, rows.flat)
    known = at < len(features)
    known[known] = features[at[known]] == rows.flat[known]
    out[rows.owner[known], at[known]] = 1
    return out


def newton(
    x: np.ndarray, labels: np.ndarray, l2: float = 1.0, gaps: np.ndarray | None = None, penalty: float = 0.0,
    share: np.ndarray | None = None, steps: int = 25,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with l2, by Newton's method with halved steps.

    ``gaps``: rows of feature differences; ``penalty`` times the number of rows
    times the mean squared log-odds difference over them is added to the loss.
    ``labels`` may be probabilities, ``share`` weighs rows. With one class only,
    or no rows, all weights are zero and the bias is that of the labels' mean.
    """
    n, width = x.shape
    share = np.ones(n) if share is None else share
    weights, total = np.zeros(width + 1), float(share.sum())
    mean = float((share * labels).sum() / total) if n else 0.5
    mean = min(1 - 1e-3, max(1e-3, mean))
    weights[-1] = np.log(mean / (1 - mean))
    if not n or not width or labels.min() == labels.max():
        return weights[:-1], float(weights[-1])
    ridge = np.full(width + 1, l2)
    ridge[-1] = 1e-6
    extra = np.zeros((width, width))
    if gaps is not None and len(gaps):
        extra = 2 * penalty * total / len(gaps) * (gaps.T.astype(float) @ gaps.astype(float))

    def loss(w: np.ndarray) -> float:
        odds = x @ w[:-1] + w[-1]
        fit = float((share * (np.logaddexp(0, odds) - labels * odds)).sum())
        return fit + 0.5 * float((ridge * w * w).sum()) + 0.5 * float(w[:-1] @ extra @ w[:-1])

    now = loss(weights)
    for _ in range(steps):
        p = sigmoid(x @ weights[:-1] + weights[-1])
        error, curve = share * (p - labels), share * p * (1 - p)
        grad = np.append(x.T @ error, error.sum()) + ridge * weights
        grad[:-1] += extra @ weights[:-1]
        weighed = x * curve[:, None]
        hess = np.zeros((width + 1, width + 1))
        hess[:-1, :-1] = x.T @ weighed + extra
        hess[:-1, -1] = hess[-1, :-1] = weighed.sum(axis=0)
        hess[-1, -1] = curve.sum()
        move = np.linalg.solve(hess + np.diag(ridge + 1e-9), grad)
        size = 1.0
        while size > 1e-3 and (new := loss(weights - size * move)) > now:
            size /= 2
        if size <= 1e-3 or now - new < 1e-6 * abs(now):
            break
        weights, now = weights - size * move, new
    return weights[:-1], float(weights[-1])
