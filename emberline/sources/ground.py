"""Landed perimeter, weather, aircraft and reference files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.weather import latest_by_family

# Polygon and multipolygon coordinates are read as text: their nesting depth differs.
FEATURES = "features array<struct<properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"
RINGS, POLYGONS = "array<array<array<double>>>", "array<array<array<array<double>>>>"
EDGE_COLUMNS = ["part", "ring", "seq", "x1", "y1", "x2", "y2"]

# Property names that carry one meaning in different services, in order of preference.
PERIMETER_NAMES = {
    "name": ["poly_IncidentName", "incidentname", "IncidentName", "incident_name"],
    "acres": ["poly_GISAcres", "gisacres", "GISAcres", "NIFC_GISAcres", "area_acres"],
    "t_current": ["poly_DateCurrent", "datecurrent", "DateCurrent"],
    "t_polygon": ["poly_PolygonDateTime", "perimeterdatetime", "PolygonDateTime"],
    "t_discovery": ["attr_FireDiscoveryDateTime"],
    "t_out": ["attr_FireOutDateTime"],
    "t_contained": ["attr_ContainmentDateTime"],
    "t_control": ["attr_ControlDateTime"],
    "pct_contained": ["attr_PercentContained"],
    "state": ["attr_POOState", "state"],
    "irwin_id": ["poly_IRWINID", "IRWINID", "attr_IrwinID"],
    "mission": ["mission"],
    "category": ["FeatureCategory"],
}


def epoch_or_iso(text: Column) -> Column:
    """Epoch milliseconds above 1e9, else an ISO date-time or date; UTC throughout."""
    ms = text.try_cast("double")
    return F.when(ms > 1e9, F.timestamp_millis(ms.cast("bigint"))).otherwise(
        F.coalesce(
            F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
            F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")),
            F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")),
        )
    )


def perimeter_rows(pages: DataFrame, source: str) -> DataFrame:
    """One row per feature with a geometry, service-specific names reconciled."""
    f = pages.select(F.explode("features").alias("f")).where(F.col("f.geometry").isNotNull())
    out = []
    for name, spellings in PERIMETER_NAMES.items():
        value = F.coalesce(*[F.col("f.properties")[s] for s in spellings])
        if name.startswith("t_"):
            value = epoch_or_iso(value)
        elif name in ("acres", "pct_contained"):
            value = value.try_cast("double")
        out.append(value.alias(name))
    return f.select(*out, F.lit(source).alias("source"), F.col("f.geometry").alias("geometry"))


def read_perimeters(spark: SparkSession, path, source: str) -> DataFrame:
    rows = perimeter_rows(spark.read.schema(FEATURES).option("multiLine", True).json(path), source)
    return rows.withColumn("perim_id", F.xxhash64("source", "name", "t_current", "acres", "geometry.coordinates"))


def json_props(df: DataFrame, text: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Nested properties by JSON path, cast to a type; ``ts`` accepts epoch milliseconds or ISO text."""
    cols = {}
    for name, (path, kind) in paths.items():
        raw = F.get_json_object(text, path)
        cols[name] = epoch_or_iso(raw) if kind == "ts" else raw.try_cast(kind)
    return df.withColumns(cols)


def perimeter_edges(perims: DataFrame, keys: list[str]) -> DataFrame:
    """Ring edges of polygons and multipolygons; an unclosed ring gets its closing edge."""
    g = F.col("geometry")
    poly = F.array(F.from_json(g["coordinates"], RINGS))
    parts = F.when(g["type"] == "Polygon", poly).when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], POLYGONS))
    p = perims.select(*keys, F.posexplode(parts).alias("part", "rings")).select(*keys, "part", F.posexplode("rings").alias("ring", "pts"))
    pairs = F.zip_with("pts", F.concat(F.slice("pts", 2, F.size("pts") - 1), F.slice("pts", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    e = p.where(F.size("pts") >= 3).select(*keys, "part", "ring", F.posexplode(pairs).alias("seq", "e"))
    xy = [F.col(f"e.{s}")[i].alias(f"{c}{n}") for n, s in ((1, "a"), (2, "b")) for c, i in (("x", 0), ("y", 1))]
    return e.select(*keys, "part", "ring", "seq", *xy).where("x1 <> x2 OR y1 <> y2")


STATION_CSV = "station string, valid string, lon string, lat string, tmpf string, dwpf string, sknt string, drct string"


def station_rows(raw: DataFrame) -> DataFrame:
    """Hourly station text: M, T and blanks are missing; place, time, temperature and wind are required."""
    clean = lambda c: F.when(~F.trim(c).isin("M", "T", ""), F.trim(c))
    rows = raw.select(
        F.trim("station").alias("id"), F.try_to_timestamp(F.trim("valid"), F.lit("yyyy-MM-dd HH:mm")).alias("t"),
        *[clean(c).try_cast("double").alias(c) for c in ("lon", "lat", "tmpf", "dwpf", "sknt", "drct")],
    )
    return rows.where(F.length("id") > 0).dropna(subset=["t", "lon", "lat", "tmpf", "sknt", "drct"])


def read_station_csv(spark: SparkSession, path) -> DataFrame:
    return station_rows(spark.read.option("header", True).option("comment", "#").schema(STATION_CSV).csv(path))


RAWS_JSON = "STATION array<struct<STID:string, NAME:string, LATITUDE:string, LONGITUDE:string, OBSERVATIONS:map<string,array<double>>>>"
RAWS_FAMILIES = {
    "temp_f": "air_temp", "rh": "relative_humidity", "wind_mph": "wind_speed", "wind_dir": "wind_direction", "fuel_moisture_pct": "fuel_moisture",
}


def raws_rows(pages: DataFrame) -> DataFrame:
    s = pages.select(F.explode("STATION").alias("s")).select(
        F.col("s.STID").alias("id"), F.col("s.NAME").alias("name"), F.col("s.LATITUDE").try_cast("double").alias("lat"),
        F.col("s.LONGITUDE").try_cast("double").alias("lon"), F.col("s.OBSERVATIONS").alias("observations"),
    )
    return latest_by_family(s, RAWS_FAMILIES)


def read_raws(spark: SparkSession, path) -> DataFrame:
    return raws_rows(spark.read.schema(RAWS_JSON).option("multiLine", True).json(path))


def hourly_rows(points: DataFrame, time: str, series: dict[str, str]) -> DataFrame:
    """Parallel hourly arrays to one row per hour; a missing series gives NULLs."""
    idx = F.explode_outer(F.sequence(F.lit(0), F.size(time) - 1))
    rows = points.where(F.size(time) > 0).withColumn("__i", idx)
    keep = [c for c in points.columns if c != time and c not in series]
    return rows.select(*keep, F.get(F.col(time), F.col("__i")).alias("ts"), *[F.get(F.col(c), F.col("__i")).alias(n) for c, n in series.items()])


HOURLY = {"temperature_2m": "temp", "relativehumidity_2m": "rh", "windspeed_10m": "ws", "winddirection_10m": "wd", "windgusts_10m": "gust", "precipitation": "precip"}
PROFILE = {"cape": "cape", "lifted_index": "lifted_index", "relative_humidity_500hPa": "rh_500", "wind_speed_500hPa": "ws_500", "geopotential_height_500hPa": "z_500"}


def _hourly(spark: SparkSession, path, series: dict[str, str]) -> DataFrame:
    fields = ", ".join(f"{c}:array<double>" for c in series)
    raw = spark.read.schema(f"latitude double, longitude double, hourly struct<time:array<string>, {fields}>").option("multiLine", True).json(path)
    return hourly_rows(raw.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "hourly.*"), "time", series)


def read_weather_hourly(spark: SparkSession, path) -> DataFrame:
    return _hourly(spark, path, HOURLY)


def read_atmos_profile(spark: SparkSession, path) -> DataFrame:
    return _hourly(spark, path, PROFILE)


def road_rows(ways: DataFrame) -> DataFrame:
    """Major roads with at least two points as ordered polyline vertices."""
    rows = ways.where(F.col("highway").isin("motorway", "trunk", "primary") & (F.size("points") >= 2))
    return rows.select("way_id", "highway", F.posexplode("points").alias("seq", "p")).select("way_id", "highway", "seq", "p.lon", "p.lat")


def read_roads(spark: SparkSession, path) -> DataFrame:
    schema = "elements array<struct<id:bigint, tags:map<string,string>, geometry:array<struct<lat:double, lon:double>>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    return road_rows(e.select(F.col("e.id").alias("way_id"), F.col("e.tags")["highway"].alias("highway"), F.col("e.geometry").alias("points")))


AIRPORT_CSV = "ident string, type string, latitude_deg string, longitude_deg string, elevation_ft string"


def airport_rows(raw: DataFrame, bucket_deg: float = 0.5) -> DataFrame:
    """Charted fields; closed and balloon ports and bad places are dropped, bad elevation is 0 ft."""
    kind = F.trim(F.coalesce("type", F.lit("")))
    rows = raw.where(~kind.isin("closed", "balloonport", "")).select(
        "ident", kind.alias("type"), F.col("latitude_deg").try_cast("double").alias("lat"), F.col("longitude_deg").try_cast("double").alias("lon"),
        F.coalesce(F.col("elevation_ft").try_cast("double"), F.lit(0.0)).alias("elev_ft"),
    ).where("lat IS NOT NULL AND lon IS NOT NULL")
    b = lambda c: F.bround(F.col(c) / bucket_deg, 0).cast("int")
    return rows.withColumns({"bucket_y": b("lat"), "bucket_x": b("lon")})


def read_airports(spark: SparkSession, path) -> DataFrame:
    """Columns are taken by header name: the file has more than are used."""
    raw = spark.read.option("header", True).csv(path)
    return airport_rows(raw.select(*[F.col(c.split()[0]) for c in AIRPORT_CSV.split(", ")]))


def read_registry(spark: SparkSession, path) -> DataFrame:
    """Global aircraft registry reduced to fire-fleet airframes with roles."""
    from emberline.operators.aircraft import fire_fleet

    raw = spark.read.option("header", True).csv(path)
    maker = F.coalesce(F.nullif(F.col("manufacturericao"), F.lit("")), F.col("manufacturername"))
    seq = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return fire_fleet(raw.select("icao24", "registration", maker.alias("manufacturer"), "model", "typecode", "icaoaircrafttype", "operator", "owner", seq.alias("seq")))


def opensky_states(raw: DataFrame) -> DataFrame:
    """Positional state vectors (one array of text per aircraft) to the common shape."""
    at = lambda i: F.get(F.col("s"), F.lit(i))
    num = lambda i: at(i).try_cast("double")
    rows = raw.select(
        at(0).alias("icao"), F.trim(F.coalesce(at(1), F.lit(""))).alias("callsign"), num(6).alias("lat"), num(5).alias("lon"), num(7).alias("baro_alt_m"),
        num(13).alias("geo_alt_m"), num(9).alias("spd_ms"), num(10).alias("hdg"), at(8).try_cast("boolean").alias("on_ground"),
    )
    return _altitude(rows.where("lat IS NOT NULL AND lon IS NOT NULL"))


def community_states(raw: DataFrame) -> DataFrame:
    """Feet and knots records of the community feeds; a 'ground' altitude marks a parked aircraft."""
    ground = F.coalesce(F.col("alt_baro") == "ground", F.lit(False))
    ft = lambda c: F.col(c).try_cast("double") * F.lit(0.3048)
    key = F.lower(F.trim(F.coalesce("hex", F.lit(""))))
    rows = raw.select(
        key.alias("icao"), F.trim(F.coalesce("flight", F.lit(""))).alias("callsign"), "lat", "lon", F.when(~ground, ft("alt_baro")).alias("baro_alt_m"),
        ft("alt_geom").alias("geo_alt_m"), (F.col("gs") * F.lit(0.514444)).alias("spd_ms"), F.col("track").alias("hdg"), ground.alias("on_ground"),
    )
    return _altitude(rows.where((F.length("icao") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()))


def _altitude(rows: DataFrame) -> DataFrame:
    source = F.when(F.col("geo_alt_m").isNotNull(), "geo").when(F.col("baro_alt_m").isNotNull(), "baro")
    return rows.withColumns({"alt_m": F.coalesce("geo_alt_m", "baro_alt_m"), "alt_source": source})


def read_states(spark: SparkSession, path, feed: str) -> DataFrame:
    if feed == "opensky":
        raw = spark.read.schema("time bigint, states array<array<string>>").option("multiLine", True).json(path)
        return opensky_states(raw.select(F.explode("states").alias("s"))).withColumn("feed", F.lit(feed))
    ac = "array<struct<hex:string, flight:string, lat:double, lon:double, alt_baro:string, alt_geom:string, gs:double, track:double>>"
    raw = spark.read.schema(f"ac {ac}, aircraft {ac}").option("multiLine", True).json(path)
    return community_states(raw.select(F.explode(F.coalesce("ac", "aircraft")).alias("a")).select("a.*")).withColumn("feed", F.lit(feed))


def metar_rows(raw: DataFrame) -> DataFrame:
    rows = raw.where("altim IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    return rows.select(F.col("icaoId").alias("station"), "lat", "lon", F.col("altim").alias("altim_hpa"), (F.col("altim") / F.lit(33.8639)).alias("altim_inhg"), F.timestamp_seconds("obsTime").alias("obs_t"))


def read_metar(spark: SparkSession, path) -> DataFrame:
    return metar_rows(spark.read.schema("icaoId string, lat double, lon double, altim double, obsTime bigint").option("multiLine", True).json(path))


def read_cameras(spark: SparkSession, path) -> DataFrame:
    from emberline.operators.cameras import clean_cameras

    schema = "features array<struct<properties:struct<id:string, az_current:double, fov:double>, geometry:struct<coordinates:array<double>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    c = F.col("f.geometry.coordinates")
    return clean_cameras(f.select(F.col("f.properties.id").alias("id"), F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon"), F.col("f.properties.az_current").alias("az"), F.col("f.properties.fov").alias("fov")))


TRACK = "fire string, icao string, callsign string, t double, lat double, lon double, alt_m double, spd_ms double, alt_source string, on_ground boolean, agl_m double, drop boolean, kind string"


def read_tracks(spark: SparkSession, path, now_s: float, hours: float) -> DataFrame:
    """Stored track lines of the lookback; broken lines are skipped."""
    rows = spark.read.schema(TRACK).option("mode", "DROPMALFORMED").json(path)
    return rows.where((F.col("t") >= F.lit(now_s - hours * 3600)) & F.col("lat").isNotNull())


STEP = "fire string, step int, start string, end string, base_wkb string, real_wkb string, base_acres double, real_acres double, gr double, stratum string"


def read_steps(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(STEP).json(path)


def prediction_rows(raw: DataFrame, model_id: str) -> DataFrame:
    """One geometry per step for a model; the newest file (then line) wins."""
    rows = raw.where((F.col("model_id") == model_id) & (F.length("prediction_wkb") > 0))
    return rows.groupBy("step_key").agg(F.max_by("prediction_wkb", F.struct("file", "seq")).alias("prediction_wkb"))


def read_predictions(spark: SparkSession, path, model_id: str) -> DataFrame:
    raw = spark.read.schema("model_id string, step_key string, prediction_wkb string").json(path)
    return prediction_rows(raw.withColumns({"file": F.col("_metadata.file_name"), "seq": F.monotonically_increasing_id()}), model_id)


IGNITION = "struct<comment:string, fires:map<string,struct<name:string, year:int, state:string, lat:double, lon:double, datetime:string, confidence:string>>>"


def ignition_rows(text: DataFrame) -> DataFrame:
    return text.select(F.explode(F.from_json("value", IGNITION)["fires"]).alias("key", "f")).select("key", "f.*")


def read_ignitions(spark: SparkSession, path) -> DataFrame:
    return ignition_rows(spark.read.text(path, wholetext=True))


def burn_point_rows(raw: DataFrame, min_year: int = 1984) -> DataFrame:
    """Burn points with a place; the year comes from epoch milliseconds and may stay unknown."""
    year = F.when(F.col("ig_date") > 1e9, F.year(F.timestamp_millis("ig_date")))
    rows = raw.withColumns({"lat": F.coalesce("latitude", "y"), "lon": F.coalesce("longitude", "x"), "year": year})
    return rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("year").isNull() | (F.col("year") >= min_year)))


def read_burn_points(spark: SparkSession, path, min_year: int = 1984) -> DataFrame:
    schema = "features array<struct<attributes:struct<fire_id:string, fire_name:string, ig_date:bigint, acres:double, latitude:double, longitude:double>, geometry:struct<x:double, y:double>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return burn_point_rows(f.select("f.attributes.*", "f.geometry.*"), min_year)


def alert_zone_rows(features: DataFrame) -> DataFrame:
    return features.where(F.col("geometry").isNotNull())


def read_alert_zones(spark: SparkSession, path) -> DataFrame:
    f = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return alert_zone_rows(f.select("f.*"))


def zones_per_box(zones: DataFrame, boxes: DataFrame) -> DataFrame:
    """Number of zones (west..north extents) meeting each fire's box."""
    from emberline.operators.intervals import overlap_join

    a = boxes.select("fire", F.col("west").alias("lo"), F.col("east").alias("hi"), "south", "north")
    b = zones.select(F.col("west").alias("rlo"), F.col("east").alias("rhi"), F.col("south").alias("z_south"), F.col("north").alias("z_north"))
    hits = overlap_join(a, b, 0.5).where((F.col("z_south") <= F.col("north")) & (F.col("z_north") >= F.col("south")))
    n = hits.groupBy("fire").agg(F.count("*").alias("zones"))
    return boxes.select("fire").join(n, "fire", "left").select("fire", F.coalesce("zones", F.lit(0)).alias("zones"))


def read_raster_cells(spark: SparkSession, path, layer: str) -> DataFrame:
    from emberline.operators.raster import clean_layer

    return clean_layer(spark.read.parquet(path).where(F.col("layer") == layer), layer)
