"""Source health, cycle history and plausibility checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.frames import M2_PER_ACRE
from emberline.functions.ordered import previous_row

# Fixed values.
STATUSES = ("ok", "no_data", "unavailable")
MAX_HEAD_ROS_M_MIN = 200.0
FLOOR_RADIUS_M = 200.0
GROWTH_RATIO_LIMIT = 8.0
CONFORMAL_LO, CONFORMAL_HI = -0.34, 0.29


def checked_health(df: DataFrame) -> DataFrame:
    """Fail on a status outside the three allowed; a missing reason is empty."""
    bad = F.concat(F.lit("unknown source_health status "), F.coalesce("status", F.lit("NULL")))
    status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(bad))
    return df.withColumns({"status": status, "reason": F.coalesce("reason", F.lit(""))})


def source_health_summary(log: DataFrame, since: Column, keys: list[str] = ("source",), rollup: bool = False) -> DataFrame:
    """Attempts, outcome counts, success rate, latency and last error per source.

    Last values are ``max_by`` over (t, seq), so a source with most of the log still
    aggregates map-side.
    """
    recent = log.where(F.col("t") >= since)
    n = lambda s: F.count_if(F.col("status") == s)
    when = F.struct("t", "seq")
    err = F.when(F.col("status") == "unavailable", when)
    grouped = recent.rollup(*keys) if rollup else recent.groupBy(*keys)
    out = grouped.agg(
        F.count("*").alias("attempts"),
        n("ok").alias("ok"),
        n("no_data").alias("no_data"),
        n("unavailable").alias("unavailable"),
        F.round(F.avg("latency_s"), 2).alias("mean_latency_s"),
        F.max_by("reason", err).alias("last_error"),
        F.max(F.when(F.col("status") == "unavailable", F.col("t"))).alias("last_error_t"),
        F.max_by("record_count", F.when(F.col("record_count").isNotNull(), when)).alias("last_record_count"),
    )
    return out.withColumn("success_rate", F.round((F.col("ok") + F.col("no_data")) / F.col("attempts"), 3))


def worst_first(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.asc_nulls_first("success_rate"), "source")


def feasible_growth(acres: Column, minutes: Column, ros: float = MAX_HEAD_ROS_M_MIN) -> Column:
    """Largest plausible new area: the whole outline of a disc advancing at the head rate."""
    base_m2 = F.greatest(acres, F.lit(0.0)) * F.lit(M2_PER_ACRE)
    r0 = F.greatest(F.sqrt(base_m2 / F.lit(math.pi)), F.lit(FLOOR_RADIUS_M))
    r1 = r0 + F.lit(ros) * F.greatest(minutes, F.lit(0.0))
    return F.greatest(F.lit(math.pi) * r1 * r1 - base_m2, F.lit(0.0)) / F.lit(M2_PER_ACRE)


def cycle_deltas(history: DataFrame, slot: Column) -> DataFrame:
    """Change since the previous cycle and whether it outruns the feasible bound.

    ``history``: (fire, t seconds, seq, pred_acres). Deltas are NULL without a
    previous cycle; the bound is NULL when no time has passed.
    """
    rows = previous_row(history, ["fire"], ["t", "seq"], ["pred_acres", "t"], slot)
    minutes = (F.col("t") - F.col("prev_t")) / F.lit(60.0)
    delta = F.col("pred_acres") - F.col("prev_pred_acres")
    rows = rows.withColumns({"elapsed_min": minutes, "delta_acres": delta})
    bound = F.when(F.col("elapsed_min") > 0, feasible_growth(F.col("prev_pred_acres"), F.col("elapsed_min")))
    rows = rows.withColumn("feasible_acres", bound)
    alert = F.coalesce(F.col("delta_acres") > F.col("feasible_acres"), F.lit(False))
    return rows.withColumn("physics_alert", alert).drop("prev_t")


def growth_flag(history: DataFrame) -> DataFrame:
    ratio = F.col("pred_acres") / F.greatest(F.col("base_acres"), F.lit(1.0))
    return history.withColumns({"growth_ratio": ratio, "growth_flag": ratio > GROWTH_RATIO_LIMIT})


def conformal_interval(df: DataFrame) -> DataFrame:
    """Log-acre interval round the prediction; NULL under persistence."""
    learned = F.col("mode") != "persistence"
    return df.withColumns(
        {
            "lo_acres": F.when(learned, F.col("pred_acres") * F.lit(math.exp(CONFORMAL_LO))),
            "hi_acres": F.when(learned, F.col("pred_acres") * F.lit(math.exp(CONFORMAL_HI))),
        }
    )


def latest_per_fire(history: DataFrame) -> DataFrame:
    """Newest copy of each fire's record."""
    cols = [c for c in history.columns if c not in ("fire", "t", "seq")]
    row = F.max(F.struct("t", "seq", *cols)).alias("r")
    return history.groupBy("fire").agg(row).select("fire", "r.*")
