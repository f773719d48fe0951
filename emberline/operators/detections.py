"""Satellite detections and geostationary pixels: cleaning, states, coverage and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import frames
from emberline.functions.ordered import exact_quantiles, neighbours, top_n

# Mask codes of the geostationary fire product.
FIRE_MASK_CODES = [10, 11, 12, 13, 14, 15, 30, 31, 32, 33, 34, 35]
SATURATED_MASK_CODES = [11, 31]
PIXEL_M2 = 4.0e6
BAD_RECORD = "missing_or_invalid_acquisition_record"
TOO_LATE = "post_cutoff_acquisition"
VIIRS_FAMILIES = ("VIIRS_SNPP", "VIIRS_NOAA20", "VIIRS_NOAA21")


def bbox_filter(df: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Closed lon/lat box; plain comparisons, so they reach the Parquet scan."""
    west, south, east, north = bbox
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def buffer_bbox(df: DataFrame, km: float = 50.0) -> DataFrame:
    """Widen (west, south, east, north) columns by ``km``."""
    dlat = F.lit(km / frames.QUICK_KM_PER_DEG)
    mid = F.radians((F.col("south") + F.col("north")) / 2)
    dlon = F.lit(km) / (F.lit(frames.QUICK_KM_PER_DEG) * F.cos(mid))
    return df.withColumns(
        {
            "west": F.col("west") - dlon,
            "south": F.col("south") - dlat,
            "east": F.col("east") + dlon,
            "north": F.col("north") + dlat,
        }
    )


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def judge_cutoff(dets: DataFrame, cutoff: Column) -> DataFrame:
    """Adds ``reject_reason``: NULL for rows usable at the cutoff (equal time is kept)."""
    frp = F.coalesce(F.col("frp"), F.lit(0.0))
    valid = (
        F.col("acq").isNotNull()
        & F.col("lon").between(-180, 180)
        & F.col("lat").between(-90, 90)
        & finite(frp)
        & (frp >= 0)
    )
    reason = F.when(~F.coalesce(valid, F.lit(False)), F.lit(BAD_RECORD)).when(F.col("acq") > cutoff, F.lit(TOO_LATE))
    return dets.withColumn("reject_reason", reason)


def cutoff_detections(dets: DataFrame, cutoff: Column, keep: list[str] = ("fire", "det_id")) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected). Kept rows carry only prediction-time fields."""
    judged = judge_cutoff(dets, cutoff)
    kept = judged.where(F.col("reject_reason").isNull()).select(
        *keep, "acq", "lon", "lat", F.coalesce("frp", F.lit(0.0)).alias("frp"), F.coalesce("sensor", F.lit("")).alias("sensor")
    )
    return kept, judged.where(F.col("reject_reason").isNotNull()).select(*keep, "reject_reason")


def dedup_detections(df: DataFrame, order: list[str], decimals: int = 4) -> DataFrame:
    """First row by ``order`` per rounded location and time.

    An aggregate, not a row_number window: copies collapse before the shuffle.
    """
    key = [F.bround("lat", decimals).alias("__la"), F.bround("lon", decimals).alias("__lo"), F.col("acq").alias("__t")]
    row = F.min(F.struct(*[F.col(o) for o in order], *[F.col(c) for c in df.columns if c not in order])).alias("r")
    return df.groupBy(*key).agg(row).select("r.*").select(*df.columns)


def covering_products(steps: DataFrame, availability: DataFrame, families=VIIRS_FAMILIES) -> DataFrame:
    """Sorted products whose advertised window meets each step's window (closed intervals).

    The catalogue has one row per product (tens); the join is a non-equi join on it.
    """
    wanted = availability.where(F.col("product").rlike("^(" + "|".join(families) + ")"))
    hit = (F.col("min_date") <= F.col("end_date")) & (F.col("max_date") >= F.col("start_date"))
    return (
        steps.join(wanted, hit)
        .groupBy(*steps.columns)
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("product"))).alias("products"))
    )


def abi_state(df: DataFrame) -> DataFrame:
    """Tri-state reading of a pixel: fire beats unavailable beats observed_nonfire."""
    fire = F.col("mask").isin(FIRE_MASK_CODES)
    missing = (F.col("mask") <= 0) | (F.col("dqf").isNotNull() & (F.col("dqf") >= 2))
    if "footprint" in df.columns:
        bad = F.exists("footprint", lambda p: ~finite(p["lon"]) | ~finite(p["lat"]))
        missing = missing | F.coalesce(bad, F.lit(False))
    state = F.when(fire, "fire").when(missing, "unavailable").otherwise("observed_nonfire")
    return df.withColumns({"state": state, "saturated": F.col("mask").isin(SATURATED_MASK_CODES)})


def fill_fraction(df: DataFrame) -> DataFrame:
    """Active share of a nominal pixel; NULL where area is missing or censored by saturation."""
    usable = F.col("area_m2").isNotNull() & ~F.col("mask").isin(SATURATED_MASK_CODES)
    return df.withColumn("fill_fraction", F.when(usable, F.least(F.col("area_m2") / F.lit(PIXEL_M2), F.lit(1.0))))


def latest_fill_per_tile(pixels: DataFrame, tile_km: float = 2.0) -> DataFrame:
    """Newest pixel per tile; on equal time the first read (smallest seq) stays."""
    i = F.bround(F.col("lat") / F.lit(tile_km / frames.KM_PER_DEG), 0).cast("bigint")
    j = F.bround(
        F.col("lon") / (F.lit(tile_km) / (F.lit(frames.KM_PER_DEG) * F.cos(F.radians("lat")))), 0
    ).cast("bigint")
    row = F.max(
        F.struct("t", (-F.col("seq")).alias("nseq"), "lat", "lon", F.when(~F.col("saturated"), F.col("fill_fraction")).alias("fill"), "saturated")
    ).alias("r")
    return pixels.groupBy(i.alias("tile_i"), j.alias("tile_j")).agg(row).select(
        "tile_i", "tile_j", "r.lat", "r.lon", "r.fill", "r.t", "r.saturated"
    )


def live_detections(goes: DataFrame, viirs: DataFrame) -> DataFrame:
    """One detection table from geostationary fire pixels and polar detections."""
    power = F.when(finite(F.col("power_mw")), F.col("power_mw")).otherwise(F.lit(1.0))
    g = goes.where(F.col("state") == "fire").select(
        "lat", "lon", F.greatest(power, F.lit(0.0)).alias("frp"), F.col("platform").alias("sensor"), "t"
    )
    v = viirs.where(F.col("lat").isNotNull()).select(
        "lat", "lon", F.coalesce("frp", F.lit(0.0)).alias("frp"), F.lit("VIIRS").alias("sensor"), "t"
    )
    return g.unionByName(v)


def sensor_counts(dets: DataFrame) -> DataFrame:
    return dets.groupBy("fire", "sensor").agg(F.count("*").alias("n"))


def sensor_count_map(dets: DataFrame) -> DataFrame:
    """Counts per sensor as a map; only one row per sensor reaches the second grouping."""
    entries = F.array_sort(F.collect_list(F.struct("sensor", "n")))
    return sensor_counts(dets).groupBy("fire").agg(F.map_from_entries(entries).alias("dets_by_sensor"))


def warm_pixels(cells: DataFrame, lo: float = 320.0, hi: float = 400.0) -> DataFrame:
    hot = frames.clip((F.col("bt") - F.lit(lo)) / F.lit(hi - lo), 0.05, 1.0)
    return cells.where(F.col("bt") >= lo).withColumn("hotness", hot).withColumn("radius_km", F.lit(0.5) + F.col("hotness"))


def multispectral_fire_mask(cells: DataFrame, scene: str = "scene", min_pixels: int = 2) -> DataFrame:
    """Very bright shortwave pixels; a scene needs at least two."""
    b12, b11, b4 = F.col("b12"), F.col("b11"), F.col("b4")
    hits = cells.where((b12 > 0.30) & (b12 > F.lit(1.4) * b11) & (b12 > F.lit(2.0) * b4))
    enough = hits.groupBy(scene).count().where(F.col("count") >= min_pixels).select(scene)
    return hits.join(enough, scene, "left_semi")


def burn_scar_mask(cells: DataFrame) -> DataFrame:
    nir, swir = F.col("nir"), F.col("swir")
    return cells.withColumn("nbr", (nir - swir) / (nir + swir + F.lit(1e-6))).where(F.col("nbr") < 0.05)


def smoke_direction(pixels: DataFrame, min_pixels: int = 2) -> DataFrame:
    """Bearing from the fire centre (lat0, lon0) to the mean smoke position."""
    east = (F.col("mlon") - F.col("lon0")) * F.cos(F.radians("lat0"))
    return (
        pixels.groupBy("fire", "lat0", "lon0")
        .agg(F.count("*").alias("n"), F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
        .where(F.col("n") >= min_pixels)
        .select("fire", "n", frames.wrap_360(F.degrees(F.atan2(east, F.col("mlat") - F.col("lat0")))).alias("bearing"))
    )


def rank_detections_frp(dets: DataFrame, n: int = 1500) -> DataFrame:
    return top_n(dets, ["fire"], [F.desc("frp"), F.col("det_id")], n, F.col("det_id"))


def latest_age(fires: DataFrame, dets: DataFrame, now_s: float) -> DataFrame:
    """Hours since each fire's newest acquisition; 99 when it has none."""
    newest = dets.groupBy("fire").agg(F.max("t").alias("last_t"))
    age = F.greatest((F.lit(now_s) - F.col("last_t")) / F.lit(3600.0), F.lit(0.0))
    return fires.select("fire").join(newest, "fire", "left").select("fire", F.coalesce(age, F.lit(99.0)).alias("age_h"))


def first_centroid(hotspots: DataFrame, n: int = 20) -> DataFrame:
    """Median position of the earliest ``n`` hotspots per fire; n rows per fire at most."""
    first = top_n(hotspots, ["fire"], [F.col("t"), F.col("det_id")], n, F.col("det_id"))
    return first.groupBy("fire").agg(
        F.percentile("lat", F.lit(0.5)).alias("lat"), F.percentile("lon", F.lit(0.5)).alias("lon"), F.min("t").alias("t")
    )


def systematic_sample(catalog: DataFrame, key: str, name: str, step: int, slot: Column) -> DataFrame:
    """Every ``step``-th name of each key's sorted catalogue, from the first to the last.

    ``slot`` cuts the names into stretches that ascend with them, so a key is numbered in parallel.
    """
    numbered = neighbours(catalog, [key], [name], [name], slot, prev=False, starts=lambda row, before: F.lit(True))
    return numbered.where((F.col("run") - 1) % step == 0).drop("run")


def granules_in_window(catalog: DataFrame, sat_tag: str, start_s: float, end_s: float) -> DataFrame:
    """File names whose scan interval ``_sYYYYDDDHHMMSS…_e…`` meets the closed window."""
    out = catalog.where(F.col("name").contains(f"_{sat_tag}_"))
    for col, mark in (("scan_start", "s"), ("scan_end", "e")):
        digits = F.substring(F.regexp_extract("name", rf"_{mark}(\d{{14}})_", 1), 1, 13)
        out = out.withColumn(col, frames.seconds(F.try_to_timestamp(digits, F.lit("yyyyDDDHHmmss"))))
    return out.where((F.col("scan_end") >= F.lit(start_s)) & (F.col("scan_start") <= F.lit(end_s)))


def dual_sensor_cross(cells: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Where both satellites see fire; falls back to their union, or to the only one present.

    ``cells``: (keys, ix, iy, platform). ``attempts``: (keys, tried, failed) reads.
    Fires without cells report ``unavailable`` when every read failed, else ``no_data``.
    """
    seen = cells.groupBy(*keys, "ix", "iy").agg(F.count_distinct("platform").alias("sats"))
    depth = seen.groupBy(*keys).agg(F.max("sats").alias("best"))
    kept = seen.join(depth, keys).where((F.col("sats") == F.col("best"))).select(*keys, "ix", "iy")
    counts = kept.groupBy(*keys).agg(F.count("*").alias("cells"))
    status = (
        F.when(F.col("cells") > 0, F.lit("ok"))
        .when((F.col("failed") > 0) & (F.col("failed") >= F.col("tried")), F.lit("unavailable"))
        .otherwise(F.lit("no_data"))
    )
    report = attempts.join(counts, keys, "left").select(*keys, F.coalesce("cells", F.lit(0)).alias("cells"), status.alias("status"))
    return kept, report


def active_detections(dets: DataFrame, now_s: float) -> DataFrame:
    """Detections marking a running front: top-quartile heat, or a very recent geostationary cell."""
    q = exact_quantiles(dets.withColumn("__f", F.coalesce("frp", F.lit(0.0))), ["fire"], "__f", {"p75": 0.75})
    hot = (F.coalesce("frp", F.lit(0.0)) >= F.col("p75")) & (F.col("p75") > 0)
    age_h = F.coalesce((F.lit(now_s) - F.col("t")) / 3600.0, F.lit(99.0))
    return dets.join(q, "fire").where(hot | (F.col("sensor").startswith("GOES") & (age_h < 0.75)))
