"""Labelled rows and the logistic curve that turns a raw figure into a score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.texts import column
from corpusloom.operators.lookups import lookup_join


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, text, label) of the rows with a label 0 or 1.

    A key with several labels has the larger one. Only rows that bear a label move: the
    labels are broadcast within a checked size, else the text is joined by shuffle.
    """
    marks = (
        labels.where(column(label).isin(0, 1) & column(key).isNotNull())
        .groupBy(column(key).alias("key"))
        .agg(F.max(column(label)).cast("int").alias("label"))
    )
    return lookup_join(docs.select(column(key).alias("key"), column(text).alias("text")), marks, "key", "inner", ["text"])


def within(n: int, key: str, limit: int, seed: int) -> Column:
    """True for about ``limit`` of ``n`` rows at most, chosen by a hash of the key; for all if there are fewer."""
    if n <= limit:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * limit / n)


def bounded(rows: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """About ``limit`` rows at most, chosen by a hash of the key; all of them if there are fewer."""
    return rows.where(within(rows.count(), key, limit, seed))


def fit_logistic(features: np.ndarray, labels: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights (intercept last) of a logistic curve over the figures; Newton's method."""
    n, k = features.shape
    if n == 0 or labels.min() == labels.max():
        # nothing to tell apart: the curve is flat at the share of ones, kept off 0 and 1
        share = (labels.sum() + 1) / (n + 2)
        return np.append(np.zeros(k), np.log(share / (1 - share)))
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale == 0] = 1.0
    x = np.concatenate([(features - mean) / scale, np.ones((n, 1))], axis=1)
    w = np.zeros(k + 1)
    penalty = np.full(k + 1, l2 * n)
    penalty[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / scale
    return np.append(slopes, w[-1] - (slopes * mean).sum())


def logistic(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))
