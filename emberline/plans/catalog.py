"""Registry of runnable queries: a Spark function and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Decimal ties (…5 at the seventh place) fall on either side by the last bit of a double;
# this relative nudge, applied by both engines before rounding, settles them alike. Values
# of a million and more (epoch seconds) have no such ties and are left alone.
NUDGE = 3e-13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, rounded: str = ""):
    """Register a query. ``rounded`` lists the oracle's double columns, compared at six places."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return six_places(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            cols = rounded.split()
            fixed = ", ".join(f"round({c} + CASE WHEN abs({c}) < 1e6 THEN {c} * {NUDGE} ELSE 0 END, 6) + 0.0e0 AS {c}" for c in cols)
            ORACLES[name] = f"SELECT * REPLACE ({fixed}) FROM ({oracle})" if cols else oracle
        return fn

    return wrap


def six_places(df: DataFrame) -> DataFrame:
    def fixed(c: str):
        nudge = F.when(F.abs(c) < 1e6, F.col(c) * F.lit(NUDGE)).otherwise(0.0)
        return (F.round(F.col(c) + nudge, 6) + F.lit(0.0)).alias(c)

    return df.select(*[fixed(c) if t == "double" else F.col(c) for c, t in df.dtypes])
