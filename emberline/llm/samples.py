"""Bounded, repeatable samples of labelled observations for fitting small models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_fold(obs_id: Column | str, folds: int = 5) -> Column:
    """Whether CRC-32 of the id as text is divisible by ``folds``; a NULL id is not in the fold."""
    col = F.col(obs_id) if isinstance(obs_id, str) else obs_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(obs_id, label): some ``per_label`` ids of every label value, or all where there are fewer.

    An id is taken if its hash lies below the share that makes ``per_label`` of the value's ids, so the
    choice is repeatable and needs no sorting; the number taken varies as a draw does, by a few times its
    square root. Rows with a NULL id or label are left out; an id with several labels counts under the
    smallest. The table of label values, one short row each, is broadcast: values are names of classes.
    """
    known = labels.where(F.col("obs_id").isNotNull() & F.col(label).isNotNull()).groupBy("obs_id").agg(F.min(label).alias(label))
    depth = known.groupBy(F.col(label).alias("__v")).agg(F.count("*").alias("__n"))
    place = F.shiftrightunsigned(F.xxhash64("obs_id"), 11) / F.lit(float(1 << 53))
    return known.join(F.broadcast(depth), F.col(label) == F.col("__v")).where(place * F.col("__n") < per_label).select("obs_id", label)


def squared_hinge(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights (bias last) of a linear SVM, classes -1 and 1 weighted alike, by accelerated gradient."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)).astype(x.dtype)
    probe = np.ones(x1.shape[1], x.dtype)
    for _ in range(15):  # the largest curvature, by power iteration
        probe = x1.T @ (weight * (x1 @ probe))
        norm = float(np.linalg.norm(probe)) or 1.0
        probe /= norm
    step = 1.0 / (2.2 * norm + reg)
    w = np.zeros(x1.shape[1], x.dtype)
    ahead, t = w, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        grad = -2 * (x1.T @ (weight * slack * y)) + reg * ahead
        new = ahead - step * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w
