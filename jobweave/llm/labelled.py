"""Bounded samples of labelled documents, and logistic regression on a few numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is kept from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def training_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, longest: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts of at most ``longest`` characters, chosen by a hash of the id, not held out.

    The driver gets this sample only; its size is bounded by the two parameters.
    Labels other than 0 and 1 and ids with contradicting labels are left out.
    """
    spread = F.xxhash64(F.lit(label), "doc_id")
    marked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label")).where(~held_out())
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other and label in (0, 1)").orderBy(spread, "doc_id").limit(rows)
    )
    found = (
        documents.select("doc_id", F.col("text").cast("string").alias("text"))
        .where(F.col("text").isNotNull() & (F.length("text") <= longest))
        .join(F.broadcast(marked.select("doc_id", "label")), "doc_id")
    )
    return sorted({(r.text, r.label) for r in found.orderBy(spread, "doc_id").limit(rows).collect()})


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last one is the constant) by Newton's method with an L2 penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
