"""Bounded labelled samples, and the measures of a classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import crc32_of_id


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(crc32_of_id(id_col), F.lit(modulus))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    most: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[list[str], np.ndarray, float]:
    """Texts, labels, and the share of label 1 among all labelled rows.

    At most ``most`` labelled texts of each class, outside the held-out remainder.
    Rows are taken by a hash of the id, so the sample is the same every time; their
    texts are whole. Ids with contradicting labels are left out; of an id with several
    texts, the least counts.
    """
    clean = (
        labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
        .filter((F.col("_y") == F.col("_z")) & (remainder("_id", modulus) != held_out))
    )
    counts = {r["_y"]: r["count"] for r in clean.groupBy("_y").count().collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    # the least hashes of each class: at most 2 * most ids, chosen without their texts
    order = F.xxhash64("_id")
    chosen = [clean.filter(F.col("_y") == y).orderBy(order, "_id").limit(most) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select("_id", "_y"))
    rows = (
        docs.select(docs[id_col].alias("_i"), docs[text_col].cast("string").alias("_t"))
        .join(ids, F.col("_i") == F.col("_id"))
        .groupBy("_i", "_y")
        .agg(F.min("_t").alias("_t"))
        .collect()
    )
    rows = sorted(((r["_i"], r["_y"], r["_t"] or "") for r in rows))
    return [r[2] for r in rows], np.array([r[1] for r in rows], int), share


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give label 1 the share it has among all labelled rows."""
    return np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last: the constant) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    weight = class_weights(y, share)
    for _ in range(steps):
        p = logistic(x @ w)
        g = x.T @ (weight * (p - y)) / len(y) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
