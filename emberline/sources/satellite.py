"""Landed satellite files: active-fire CSV, feature pages, geostationary pixels, spectral cells.

Each source is a plain Spark read with a fixed schema plus a ``*_rows`` projection that
cleans it; the projection also accepts any DataFrame of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIIRS_CSV = "latitude string, longitude string, acq_date string, acq_time string, frp string, confidence string, product string"
NGFS_PAGE = (
    "features array<struct<id:string, properties:struct<id:string, satellite:string, latitude:double, longitude:double, "
    "frp:double, acq_date_time:string, confidence:string, known_incident_name:string>>>"
)


def _acquired(date: str = "acq_date", time: str = "acq_time") -> Column:
    hhmm = F.lpad(F.coalesce(F.col(time), F.lit("0000")), 4, "0")
    return F.try_to_timestamp(F.concat(F.col(date), F.lit(" "), hhmm), F.lit("yyyy-MM-dd HHmm"))


def viirs_rows(raw: DataFrame) -> DataFrame:
    """Polar detections; rows whose place, time or heat do not parse are dropped, empty heat is zero."""
    blank = F.col("frp").isNull() | (F.trim("frp") == "")
    rows = raw.select(
        F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), _acquired().alias("acq"),
        F.when(blank, F.lit(0.0)).otherwise(F.col("frp").try_cast("double")).alias("frp"), F.lit("VIIRS").alias("sensor"), "product",
    )
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL AND acq IS NOT NULL AND frp IS NOT NULL")


def read_viirs(spark: SparkSession, path) -> DataFrame:
    return viirs_rows(spark.read.option("header", True).schema(VIIRS_CSV).csv(path))


def firms_24h_rows(raw: DataFrame, bbox=None) -> DataFrame:
    """Day feeds of several satellites as one table; confidence defaults to nominal."""
    conf = raw.select("latitude", "longitude", "acq_date", "acq_time", "frp", "product", F.coalesce("confidence", F.lit("n")).alias("confidence"))
    out = conf.select(
        F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), _acquired().alias("acq"),
        F.coalesce(F.col("frp").try_cast("double"), F.lit(0.0)).alias("frp"), "confidence",
    ).where("lat IS NOT NULL AND lon IS NOT NULL AND acq IS NOT NULL")
    if bbox is not None:
        out = out.where(F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3]))
    return out


def read_firms_24h(spark: SparkSession, paths, bbox=None) -> DataFrame:
    return firms_24h_rows(spark.read.option("header", True).schema(VIIRS_CSV).csv(paths), bbox)


def hotspot_rows(raw: DataFrame) -> DataFrame:
    """Archive hotspots of every product with an ISO time string."""
    rows = viirs_rows(raw)
    return rows.withColumn("datetime", F.date_format("acq", "yyyy-MM-dd'T'HH:mm:ss")).select("lat", "lon", "frp", "product", "acq", "datetime")


def read_hotspots(spark: SparkSession, path) -> DataFrame:
    return hotspot_rows(spark.read.option("header", True).schema(VIIRS_CSV).csv(path))


def ngfs_rows(pages: DataFrame) -> DataFrame:
    """Detections of one satellite, unique on their id over all pages and collections."""
    f = pages.select(F.explode("features").alias("f")).where(F.col("f.properties.satellite") == "GOES-19")
    p = "f.properties."
    rows = f.select(
        F.coalesce(f"{p}id", "f.id").alias("id"), F.col(f"{p}latitude").alias("lat"), F.col(f"{p}longitude").alias("lon"), F.col(f"{p}frp").alias("frp"),
        F.col(f"{p}acq_date_time").alias("acq_date_time"), F.col(f"{p}confidence").alias("confidence"), F.col(f"{p}known_incident_name").alias("incident_name"),
    )
    cols = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", "r.*")


def read_ngfs(spark: SparkSession, path) -> DataFrame:
    return ngfs_rows(spark.read.schema(NGFS_PAGE).option("multiLine", True).json(path))


def abi_pixel_rows(raw: DataFrame) -> DataFrame:
    """Platform from its id, else from the file name; time from coverage text, else seconds since J2000 noon."""
    by_id = F.when(F.col("platform_id") == "G19", "GOES-19").when(F.col("platform_id") == "G18", "GOES-18")
    by_file = F.when(F.col("granule").contains("_G19_"), "GOES-19").otherwise("GOES-18")
    epoch = F.timestamp_seconds(F.lit(946728000) + F.col("t_j2000"))
    start = F.coalesce(F.try_to_timestamp("coverage_start"), epoch)
    return raw.withColumns({"platform": F.coalesce(by_id, by_file), "t_start": start, "t_end": F.coalesce(F.try_to_timestamp("coverage_end"), epoch)}).drop(
        "platform_id", "t_j2000", "coverage_start", "coverage_end"
    )


def read_abi_pixels(spark: SparkSession, path) -> DataFrame:
    rows = spark.read.parquet(path)
    if "granule" not in rows.columns:
        rows = rows.withColumn("granule", F.col("_metadata.file_name"))
    return abi_pixel_rows(rows)


def fixed_grid_geolocate(pixels: DataFrame, projections: DataFrame) -> DataFrame:
    """Scan angles (x, y in radians) to lat/lon; angles that miss the Earth give NULL.

    ``projections`` has one row per satellite: platform, h, r_eq, r_pol, lon0_deg.
    """
    p = pixels.join(F.broadcast(projections), "platform")  # one row per satellite
    sx, cx, sy, cy = F.sin("x"), F.cos("x"), F.sin("y"), F.cos("y")
    big_h, k = F.col("h") + F.col("r_eq"), F.pow(F.col("r_eq") / F.col("r_pol"), F.lit(2.0))
    p = p.withColumns({"qa": sx * sx + cx * cx * (cy * cy + k * sy * sy), "qb": -2 * big_h * cx * cy, "qc": big_h * big_h - F.col("r_eq") * F.col("r_eq")})
    disc = F.col("qb") * F.col("qb") - 4 * F.col("qa") * F.col("qc")
    p = p.withColumn("rs", F.when(disc >= 0, (-F.col("qb") - F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * F.col("qa"))))
    px, py, pz = F.col("rs") * cx * cy, -F.col("rs") * sx, F.col("rs") * cx * sy
    lat = F.degrees(F.atan(k * (pz / F.sqrt((big_h - px) * (big_h - px) + py * py))))
    lon = F.col("lon0_deg") - F.degrees(F.atan(py / (big_h - px)))
    return p.withColumns({"lat": lat, "lon": lon}).drop("h", "r_eq", "r_pol", "lon0_deg", "qa", "qb", "qc", "rs")


def pixel_footprints(pixels: DataFrame, projections: DataFrame, step: float) -> DataFrame:
    """Four projected corners half a scan step from each centre, in ring order."""
    h = step / 2
    out = fixed_grid_geolocate(pixels, projections)
    for i, (dx, dy) in enumerate([(-h, -h), (h, -h), (h, h), (-h, h)]):
        c = fixed_grid_geolocate(
            out.withColumns({"__x": F.col("x"), "__y": F.col("y"), "__lat": F.col("lat"), "__lon": F.col("lon")}).withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}),
            projections,
        )
        out = c.withColumn(f"c{i}", F.struct("lon", "lat")).withColumns({"x": F.col("__x"), "y": F.col("__y"), "lat": F.col("__lat"), "lon": F.col("__lon")}).drop("__x", "__y", "__lat", "__lon")
    return out.withColumn("footprint", F.array("c0", "c1", "c2", "c3")).drop("c0", "c1", "c2", "c3")


def spectral_rows(raw: DataFrame) -> DataFrame:
    """Reflectance counts to unit reflectance."""
    bands = [c for c in ("b12", "b11", "b4", "nir") if c in raw.columns]
    return raw.withColumns({b: F.col(b) / F.lit(10000.0) for b in bands})


def read_multispectral_cells(spark: SparkSession, path) -> DataFrame:
    return spectral_rows(spark.read.parquet(path))


def read_source_availability(spark: SparkSession, path) -> DataFrame:
    """Advertised (min_date, max_date) per product."""
    raw = spark.read.option("header", True).schema("product string, min_date string, max_date string").csv(path)
    return availability_rows(raw)


def availability_rows(raw: DataFrame) -> DataFrame:
    d = lambda c: F.trim(c).try_cast("date").alias(c)
    return raw.where(F.col("max_date").isNotNull()).select(F.trim("product").alias("product"), d("min_date"), d("max_date"))
