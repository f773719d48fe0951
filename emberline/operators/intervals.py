"""Interval overlap as an equi-join on slots of the axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.spatial import tile_pairs


def overlap_join(left: DataFrame, right: DataFrame, width: float, keys: list[str] = ()) -> DataFrame:
    """Pairs whose closed intervals [lo, hi] and [rlo, rhi] meet, each pair once.

    Both sides list the slots they span; a pair is kept only in the slot where the
    later of the two starts, so no distinct is needed.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    a = left.withColumn("__s", span("lo", "hi"))
    b = right.withColumn("__s", span("rlo", "rhi"))
    both = tile_pairs(a, b, [*keys, "__s"]).where((F.col("rlo") <= F.col("hi")) & (F.col("rhi") >= F.col("lo")))
    return both.where(F.col("__s") == F.floor(F.greatest("lo", "rlo") / width)).drop("__s")
