"""Nearest reporting station for a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import frames
from emberline.operators.spatial import geo_nearest

HPA_PER_INHG = 33.8639


def nearest_station(points: DataFrame, metar: DataFrame, point_id: list[str], reach_km: float = 111.0) -> DataFrame:
    """Closest station with an altimeter setting; none within reach gives NULL, never standard pressure.

    ``metar``: (station, lat, lon, altim_hpa). The flat 111.32 km frame decides nearness.
    """
    right = metar.where(F.col("altim_hpa").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "station", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), (F.col("altim_hpa") / F.lit(HPA_PER_INHG)).alias("altim_inhg")
    )
    d = frames.flat_km(F.col("rlat"), F.col("rlon"), F.col("lat"), F.col("lon"))
    # Tiles of a little more than the reach hold what is within it in either frame.
    best = geo_nearest(points, right, reach_km * 1.02, d, point_id, "station", ["altim_inhg"], flat=True).where(F.col("d") <= reach_km)
    return points.join(best, point_id, "left")
