"""Labelled documents, all or a bounded sample, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums over tables are sums of this many parts of one, so that their order changes nothing.
PARTS = 2**32


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, folds: Column) -> DataFrame:
    """(doc_id, y) of all labelled documents of those folds.

    A doc_id labelled twice counts once, with the larger label; null labels count for nothing.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(folds)
    rows = rows.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` of the labelled_ids(), the smallest hashes of doc_id first.

    The ids are `most` at most, so they may be broadcast.
    """
    ids = labelled_ids(docs, labels, label, folds).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression with an intercept (last), by Newton steps; x: (rows, features)."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 6.0 if len(y) and y.min() == 1 else -6.0 if len(y) else 0.0
        return w
    ridge = np.full(len(w), l2 * len(y) / 100 + 1e-3)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic_table(rows: DataFrame, x: list[str], y: str, l2: float = 1e-2, rounds: int = 60, *, collected: int = 500_000) -> np.ndarray:
    """fit_logistic() on a (written) table of any length, the same in any order of its rows.

    Up to `collected` rows are fitted on the driver; beyond, only exact sums go through it.
    """
    if rows.limit(collected + 1).count() <= collected:
        table = rows.select(*x, y).toArrow()
        values = np.stack([table.column(c).to_numpy() for c in (*x, y)], axis=1).astype(float)
        values = values[np.lexsort(values.T)]
        return fit_logistic(values[:, :-1], values[:, -1], l2, rounds)
    n, low, high = rows.agg(F.count("*"), F.min(y), F.max(y)).first()
    w = np.zeros(len(x) + 1)
    if not n or low == high:
        w[-1] = 6.0 if n and low == 1 else -6.0 if n else 0.0
        return w
    ridge = np.full(len(w), l2 * n / 100 + 1e-3)
    ridge[-1] = 1e-6
    a, (i, j) = [*(F.col(c) for c in x), F.lit(1.0)], np.triu_indices(len(w))
    total = lambda v: F.sum(F.rint(v * PARTS).cast("decimal(28,0)"))
    for _ in range(rounds):
        logit = sum((c * float(k) for c, k in zip(a, w)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(40.0)), F.lit(-40.0))))
        sums = rows.withColumn("__p", p).agg(*(total((F.col("__p") - F.col(y)) * c) for c in a), *(total((F.col("__p") * (1 - F.col("__p")) + 1e-9) * a[r] * a[c]) for r, c in zip(i.tolist(), j.tolist()))).first()
        sums = np.array([float(s) / PARTS for s in sums])
        hessian = np.diag(ridge)
        hessian[i, j] += sums[len(w) :]
        hessian = np.triu(hessian) + np.triu(hessian, 1).T
        step = np.linalg.solve(hessian, sums[: len(w)] + ridge * w)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
