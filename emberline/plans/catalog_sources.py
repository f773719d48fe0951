"""Queries over source normalisers (fed with rows spelled from the driver tables) and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberline.operators import detections as D
from emberline.operators.health import FLOOR_RADIUS_M, MAX_HEAD_ROS_M_MIN
from emberline.plans.catalog import query
from emberline.plans.catalog_aircraft import DROPS
from emberline.plans.fixtures import VIEWS, _split, _spell, cte, table, view
from emberline.session import checkpoint_root
from emberline.sources import ground as G
from emberline.sources import satellite as S
from emberline.sources import sinks as K
from emberline.streaming import jobs as J
from emberline.streaming import stateful as T


def viirs_csv(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    return e.select(
        F.when(k % 41 == 0, "bad").otherwise((F.lit(38.0) + (k % 400) / F.lit(1e4)).cast("string")).alias("latitude"), F.lit("-122.5").alias("longitude"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), F.hour("ts").cast("string").alias("acq_time"),
        F.when(k % 7 == 0, "").when(k % 43 == 0, "x").otherwise(F.col("value").cast("string")).alias("frp"),
        F.when(k % 5 > 0, "h").alias("confidence"), F.col("event_type").alias("product"),
    )


VIIRS_SQL = """SELECT 38e0 + (event_id % 400)/1e4 AS lat, -122.5e0 AS lon, CAST(ts AS DATE) + to_minutes(CAST(hour(ts) AS INTEGER)) AS acq, {frp} AS frp, {x} FROM events WHERE event_id % 41 <> 0"""


@query("s01_viirs_rows", VIIRS_SQL.format(frp="CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE value END", x="'VIIRS' AS sensor, event_type AS product") + " AND (event_id % 43 <> 0 OR event_id % 7 = 0)", "lat lon frp")
def _(spark, sf):
    return S.viirs_rows(viirs_csv(spark, sf))


@query("s02_firms_24h_rows", VIIRS_SQL.format(frp="CASE WHEN event_id % 7 = 0 OR event_id % 43 = 0 THEN 0e0 ELSE value END", x="CASE WHEN event_id % 5 > 0 THEN 'h' ELSE 'n' END AS confidence") + " AND 38e0 + (event_id % 400)/1e4 BETWEEN 38.01e0 AND 38.03e0", "lat lon frp")
def _(spark, sf):
    return S.firms_24h_rows(viirs_csv(spark, sf), (-123.0, 38.01, -122.0, 38.03))


@query("s03_hotspot_rows", "SELECT product, count(*) AS n, min(datetime) AS first FROM (SELECT event_type AS product, strftime(CAST(ts AS DATE) + to_minutes(CAST(hour(ts) AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS datetime FROM events WHERE event_id % 41 <> 0 AND (event_id % 43 <> 0 OR event_id % 7 = 0)) GROUP BY product")
def _(spark, sf):
    return S.hotspot_rows(viirs_csv(spark, sf)).groupBy("product").agg(F.count("*").alias("n"), F.min("datetime").alias("first"))


@query("s04_ngfs_rows", "SELECT CAST(event_id % 3000 AS VARCHAR) AS id, min(value) AS frp FROM events WHERE event_id % 3 <> 0 GROUP BY 1", "frp")
def _(spark, sf):
    e = table(spark, sf, "events")
    k = (F.col("event_id") % 3000).cast("string")
    props = F.struct(
        F.when(F.col("event_id") % 2 == 0, k).alias("id"), F.when(F.col("event_id") % 3 == 0, "GOES-18").otherwise("GOES-19").alias("satellite"), F.lit(38.0).alias("latitude"),
        F.lit(-122.0).alias("longitude"), F.col("value").alias("frp"), F.lit("t").alias("acq_date_time"), F.lit("h").alias("confidence"), F.lit(None).cast("string").alias("known_incident_name"),
    )
    feature = F.struct(k.alias("id"), props.alias("properties"))
    # One page per row: a page is a small landed document.
    return S.ngfs_rows(e.select(F.array(feature).alias("features"))).select("id", "frp")


@query("s05_abi_pixel_rows", """SELECT l_orderkey AS k, l_linenumber AS ln, CASE WHEN l_linenumber % 3 = 0 THEN 'GOES-19' WHEN l_linenumber % 3 = 1 THEN 'GOES-18' WHEN l_orderkey % 2 = 0 THEN 'GOES-19' ELSE 'GOES-18' END AS platform,
  CASE WHEN l_orderkey % 4 = 0 THEN 946728000 + l_orderkey ELSE epoch(l_shipdate)::BIGINT END AS t FROM lineitem""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    raw = l.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.when(F.col("l_linenumber") % 3 == 0, "G19").when(F.col("l_linenumber") % 3 == 1, "G18").otherwise("??").alias("platform_id"),
        F.concat(F.lit("OR_ABI_"), F.when(F.col("l_orderkey") % 2 == 0, "G19").otherwise("G18"), F.lit("_s1.nc")).alias("granule"), F.col("l_orderkey").alias("t_j2000"),
        F.when(F.col("l_orderkey") % 4 != 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("coverage_start"), F.lit(None).cast("string").alias("coverage_end"),
    )
    return S.abi_pixel_rows(raw).select("k", "ln", "platform", F.unix_seconds("t_start").alias("t"))


PROJ = "SELECT * FROM VALUES ('GOES-19', 35786023D, 6378137D, 6356752.31414D, -75.2D), ('GOES-18', 35786023D, 6378137D, 6356752.31414D, -137.2D) AS p(platform, h, r_eq, r_pol, lon0_deg)"


@query("x01_abi_geolocate", """WITH px AS (SELECT l_orderkey AS k, l_linenumber AS ln, ((l_partkey*7 % 300) - 150)/1e3 AS x, ((l_suppkey*13 % 300) - 150)/1e3 AS y, CASE WHEN l_linenumber % 2 = 0 THEN -137.2e0 ELSE -75.2e0 END AS lon0, 42164160e0 AS hh, 6378137e0 AS re, 6356752.31414e0 AS rp FROM lineitem),
  q AS (SELECT *, pow(sin(x),2)+pow(cos(x),2)*(pow(cos(y),2)+pow(re/rp,2)*pow(sin(y),2)) AS a, -2*hh*cos(x)*cos(y) AS b, hh*hh-re*re AS c FROM px), r AS (SELECT *, CASE WHEN b*b-4*a*c >= 0 THEN (-b-sqrt(greatest(b*b-4*a*c,0)))/(2*a) END AS rs FROM q)
  SELECT k, ln, degrees(atan(pow(re/rp,2)*(rs*cos(x)*sin(y)/sqrt(pow(hh-rs*cos(x)*cos(y),2)+pow(rs*sin(x),2))))) AS lat, lon0 - degrees(atan(-rs*sin(x)/(hh-rs*cos(x)*cos(y)))) AS lon FROM r""", "lat lon")
def _(spark, sf):
    px = table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS ln", "((l_partkey*7 % 300) - 150)/1e3 AS x", "((l_suppkey*13 % 300) - 150)/1e3 AS y", "CASE WHEN l_linenumber % 2 = 0 THEN 'GOES-18' ELSE 'GOES-19' END AS platform")
    return S.fixed_grid_geolocate(px, spark.sql(PROJ)).select("k", "ln", "lat", "lon")


@query("s27_spectral_rows", "SELECT l_orderkey AS k, l_linenumber AS ln, l_quantity*100/10000e0 AS b12, l_extendedprice/10000e0 AS nir FROM lineitem", "b12 nir")
def _(spark, sf):
    return S.spectral_rows(table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS ln", "l_quantity*100 AS b12", "l_extendedprice AS nir"))


@query("s28_availability_rows", "SELECT 'P' || n_nationkey AS product, DATE '2024-01-01' AS min_date, DATE '2024-02-01' AS max_date FROM nation WHERE n_nationkey % 4 > 0")
def _(spark, sf):
    raw = table(spark, sf, "nation").selectExpr("' P' || n_nationkey AS product", "'2024-01-01 ' AS min_date", "CASE WHEN n_nationkey % 4 > 0 THEN '2024-02-01' END AS max_date")
    return S.availability_rows(raw)


def features(spark, sf):
    """Feature pages spelled as landed JSON text and parsed with the source's own schema."""
    o = table(spark, sf, "orders")
    ms = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("bigint").cast("string")
    geom = F.when(F.col("o_orderkey") % 7 > 0, F.struct(F.lit("Polygon").alias("type"), F.concat(F.lit("[[[0,0],["), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(",0],[1,2],[0,0]]]")).alias("coordinates")))
    name = F.when(F.col("o_orderkey") % 3 == 0, "poly_IncidentName").otherwise("incidentname")
    props = F.create_map(name, F.concat(F.lit("F"), (F.col("o_custkey") % 50).cast("string")), F.lit("gisacres"), F.col("o_totalprice").cast("string"), F.lit("poly_DateCurrent"), ms, F.lit("oid"), F.col("o_orderkey").cast("string"))
    return o.select(F.array(F.struct(props.alias("properties"), geom.alias("geometry"))).alias("features"))


@query("s07_perimeter_rows", "SELECT 'F' || (o_custkey % 50) AS name, count(*) AS n, sum(o_totalprice) AS acres, max(epoch(o_orderdate)::BIGINT) AS last FROM orders WHERE o_orderkey % 7 > 0 GROUP BY 1", "acres")
def _(spark, sf):
    rows = G.perimeter_rows(features(spark, sf), "wfigs")
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("acres").alias("acres"), F.max(F.unix_seconds("t_current")).alias("last"))


@query("s08_perimeter_edges", "SELECT 'F' || (o_custkey % 50) AS name, s.seq::INTEGER AS seq, sum(s.x1 + s.x2)*1e0 AS sx FROM orders, LATERAL (SELECT unnest([0,1,2]) AS seq, unnest([0, o_orderkey % 9 + 1, 1]) AS x1, unnest([o_orderkey % 9 + 1, 1, 0]) AS x2) s WHERE o_orderkey % 7 > 0 GROUP BY ALL", "sx")
def _(spark, sf):
    e = G.perimeter_edges(G.perimeter_rows(features(spark, sf), "wfigs"), ["name"])
    return e.groupBy("name", "seq").agg(F.sum(F.col("x1") + F.col("x2")).alias("sx"))


@query("x16_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, sf):
    return G.json_props(table(spark, sf, "events"), "props", {"k": ("$.k", "int")}).select("event_id", "k")


@query("s09_station_rows", "SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS n, avg(o_orderkey % 70)*1e0 AS tmpf, count(*) FILTER (o_orderkey % 3 > 0) AS n_dew FROM orders WHERE o_orderkey % 5 > 0 GROUP BY 1", "tmpf")
def _(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("station"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("valid"), F.lit("-120.5").alias("lon"), F.lit("38").alias("lat"),
        (k % 70).cast("string").alias("tmpf"), F.when(k % 3 > 0, "40").otherwise("M").alias("dwpf"), F.when(k % 5 > 0, "7").otherwise("T").alias("sknt"), F.lit("270").alias("drct"),
    )
    return G.station_rows(raw).groupBy("id").agg(F.count("*").alias("n"), F.avg("tmpf").alias("tmpf"), F.count("dwpf").alias("n_dew"))


@query("s10_raws_rows", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 60e0 + s_suppkey END AS temp_f, s_suppkey % 70 * 1e0 AS rh FROM supplier", "temp_f rh")
def _(spark, sf):
    n = F.col("s_suppkey").cast("double")
    obs = F.create_map(F.lit("air_temp_set_1"), F.array(F.lit(1.0), F.when(F.col("s_suppkey") % 2 == 0, n + 60.0), F.lit(None)), F.lit("relative_humidity_set_1"), F.array(F.lit(5.0), (F.col("s_suppkey") % 70).cast("double")))
    obs = F.when(F.col("s_suppkey") % 2 == 0, obs).otherwise(F.map_concat(F.map_filter(obs, lambda k, v: ~k.startswith("air")), F.create_map(F.lit("air_temp_set_1"), F.array(F.lit(None).cast("double")))))
    st = F.struct(F.col("s_suppkey").cast("string").alias("STID"), F.col("s_name").alias("NAME"), F.lit("38.5").alias("LATITUDE"), F.lit("-121").alias("LONGITUDE"), obs.alias("OBSERVATIONS"))
    return G.raws_rows(table(spark, sf, "supplier").select(F.array(st).alias("STATION"))).select("id", "temp_f", "rh")


@query("s11_weather_hourly_rows", "SELECT o_orderkey AS k, i AS hour, (o_orderkey % 50 + i)*1e0 AS temp, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE i*1e0 END AS rh FROM orders, range(0,3) r(i)", "temp rh")
def _(spark, sf):
    k = F.col("o_orderkey")
    hours = F.array(*[F.lit(i).cast("bigint") for i in range(3)])
    pts = table(spark, sf, "orders").select(
        k.alias("k"), hours.alias("time"), F.transform(hours, lambda i: (k % 50 + i).cast("double")).alias("temperature_2m"),
        F.when(k % 3 > 0, F.transform(hours, lambda i: i.cast("double"))).alias("relativehumidity_2m"),
    )
    return G.hourly_rows(pts, "time", {"temperature_2m": "temp", "relativehumidity_2m": "rh"}).withColumnRenamed("ts", "hour")


@query("s12_atmos_profile_rows", "SELECT o_orderkey AS k, i AS hour, (o_orderkey % 900 + i)*1e0 AS cape, CAST(NULL AS DOUBLE) AS lifted_index FROM orders, range(0,2) r(i)", "cape lifted_index")
def _(spark, sf):
    k = F.col("o_orderkey")
    hours = F.array(*[F.lit(i).cast("bigint") for i in range(2)])
    pts = table(spark, sf, "orders").select(k.alias("k"), hours.alias("time"), F.transform(hours, lambda i: (k % 900 + i).cast("double")).alias("cape"), F.lit(None).cast("array<double>").alias("lifted_index"))
    return G.hourly_rows(pts, "time", {"cape": "cape", "lifted_index": "lifted_index"}).withColumnRenamed("ts", "hour")


@query("s14_road_rows", "SELECT l_orderkey*8 + l_linenumber AS way_id, CAST(i AS INTEGER) AS seq, -122e0 + i AS lon FROM lineitem, range(0,7) r(i) WHERE l_suppkey % 4 < 3 AND i < l_quantity % 5 + 1 AND l_quantity % 5 >= 1", "lon")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("motorway", "trunk", "primary", "footway")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    pts = F.transform(F.sequence(F.lit(0), (F.col("l_quantity") % 5).cast("int")), lambda i: F.struct(F.lit(38.0).alias("lat"), (F.lit(-122.0) + i).alias("lon")))
    return G.road_rows(l.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("way_id"), kind.alias("highway"), pts.alias("points"))).select("way_id", "seq", "lon")


@query("s15_airport_rows", "SELECT c_custkey AS ident, CASE WHEN c_custkey % 6 = 0 THEN 0e0 ELSE c_acctbal END AS elev_ft FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 13 > 0 AND c_custkey % 17 > 0", "elev_ft")
def _(spark, sf):
    k = F.col("c_custkey")
    raw = table(spark, sf, "customer").select(
        k.alias("ident"), F.when(k % 11 == 0, "closed").when(k % 13 > 0, "small_airport").alias("type"), F.when(k % 17 > 0, "38.5").otherwise("n/a").alias("latitude_deg"),
        F.lit("-121").alias("longitude_deg"), F.when(k % 6 > 0, F.col("c_acctbal").cast("string")).otherwise("").alias("elevation_ft"),
    )
    return G.airport_rows(raw).select("ident", "elev_ft")


@query("s17_states", "SELECT pt, CASE WHEN pt % 3 = 0 THEN NULL WHEN pt % 2 = 0 THEN 1000e0 + pt % 50 ELSE (pt % 900)*0.3048e0 END AS alt_m, CASE WHEN pt % 3 = 0 THEN NULL WHEN pt % 2 = 0 THEN 'geo' ELSE 'baro' END AS alt_source, pt % 3 = 0 AS on_ground FROM (SELECT event_id AS pt FROM events)", "alt_m")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("pt"))
    txt = lambda c: c.cast("string")
    even = e.where("pt % 2 = 0").select("pt", F.array(
        txt(F.col("pt")), F.lit(" CS "), F.lit(None), F.lit(None), F.lit(None), F.lit("-122"), F.lit("38"), F.when(F.col("pt") % 3 > 0, "900"), txt(F.col("pt") % 3 == 0), F.lit("50"), F.lit("90"), F.lit("0"), F.lit(None),
        F.when(F.col("pt") % 3 > 0, txt(F.lit(1000) + F.col("pt") % 50))).alias("s"))
    odd = e.where("pt % 2 = 1").select(
        txt(F.col("pt")).alias("hex"), F.lit("X").alias("flight"), F.lit(38.0).alias("lat"), F.lit(-122.0).alias("lon"), F.when(F.col("pt") % 3 == 0, "ground").otherwise(txt(F.col("pt") % 900)).alias("alt_baro"),
        F.lit(None).cast("string").alias("alt_geom"), F.lit(100.0).alias("gs"), F.lit(0.0).alias("track"))
    both = G.opensky_states(even.select("s")).unionByName(G.community_states(odd))
    return both.select(F.col("icao").cast("bigint").alias("pt"), "alt_m", "alt_source", "on_ground")


@query("s18_metar_rows", "SELECT s_name AS station, (1000e0 + s_suppkey)/33.8639e0 AS altim_inhg FROM supplier WHERE s_suppkey % 4 > 0", "altim_inhg")
def _(spark, sf):
    raw = table(spark, sf, "supplier").selectExpr("s_name AS icaoId", "38e0 AS lat", "-121e0 AS lon", "CASE WHEN s_suppkey % 4 > 0 THEN 1000e0 + s_suppkey END AS altim", "1700000000L AS obsTime")
    return G.metar_rows(raw).select("station", "altim_inhg")


@query("s21_prediction_rows", "SELECT step_key, arg_max(w, (f, seq)) AS prediction_wkb FROM (SELECT CAST(o_custkey AS VARCHAR) AS step_key, 'w' || o_orderkey AS w, o_orderpriority AS f, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 4 > 0) GROUP BY step_key")
def _(spark, sf):
    raw = table(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 3 > 0 THEN 'v3' ELSE 'v2' END AS model_id", "CAST(o_custkey AS STRING) AS step_key", "CASE WHEN o_orderkey % 4 > 0 THEN 'w' || o_orderkey END AS prediction_wkb", "o_orderpriority AS file", "o_orderkey AS seq")
    return G.prediction_rows(raw, "v3")


@query("s22_ignition_rows", "SELECT c_name || '_' || (2000 + c_custkey % 20) AS key, CAST(2000 + c_custkey % 20 AS INTEGER) AS year, 38e0 + c_nationkey AS lat FROM customer", "lat")
def _(spark, sf):
    c = table(spark, sf, "customer")
    year = F.lit(2000) + F.col("c_custkey") % 20
    text = F.concat(F.lit('{"comment":"x","fires":{"'), F.col("c_name"), F.lit("_"), year.cast("string"), F.lit('":{"name":"n","year":'), year.cast("string"), F.lit(',"lat":'), (F.lit(38) + F.col("c_nationkey")).cast("string"), F.lit("}}}"))
    return G.ignition_rows(c.select(text.alias("value"))).select("key", "year", "lat")


@query("s23_burn_point_rows", "SELECT o_orderkey AS fire_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS year, CASE WHEN o_orderkey % 2 = 0 THEN 39e0 ELSE 38e0 END AS lat FROM orders WHERE (o_orderkey % 5 = 0 OR year(o_orderdate) >= 1995) AND NOT (o_orderkey % 2 = 1 AND o_orderkey % 9 = 0)", "lat")
def _(spark, sf):
    k = F.col("o_orderkey")
    ms = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("bigint")
    raw = table(spark, sf, "orders").select(
        k.alias("fire_id"), F.when(k % 5 > 0, ms).alias("ig_date"), F.when(k % 2 == 0, 39.0).alias("latitude"), F.when(k % 2 == 0, -120.0).alias("longitude"),
        F.when(k % 9 > 0, 38.0).alias("y"), F.when(k % 9 > 0, -121.0).alias("x"),
    )
    return G.burn_point_rows(raw, 1995).select("fire_id", "year", "lat")


@query("s25_zones_per_box", cte("fires", "airport") + """ SELECT f.fire, count(a.ident) AS zones FROM fires f LEFT JOIN airport a ON a.lon - 0.05e0 <= f.lon0 + 0.1e0 AND a.lon + 0.05e0 >= f.lon0 - 0.1e0 AND a.lat - 0.05e0 <= f.lat0 + 0.1e0 AND a.lat + 0.05e0 >= f.lat0 - 0.1e0 GROUP BY f.fire""")
def _(spark, sf):
    boxes = view(spark, sf, "fires").selectExpr("fire", "lon0 - 0.1e0 AS west", "lat0 - 0.1e0 AS south", "lon0 + 0.1e0 AS east", "lat0 + 0.1e0 AS north")
    zones = view(spark, sf, "airport").selectExpr("ident", "lon - 0.05e0 AS west", "lat - 0.05e0 AS south", "lon + 0.05e0 AS east", "lat + 0.05e0 AS north")
    return G.zones_per_box(zones, boxes)


@query("k02_cell_feature")
def _(spark, sf):
    cells = view(spark, sf, "detections").select("fire", "det_id", "lon", "lat", F.lit(0.001).alias("dlon"), F.lit(0.001).alias("dlat"))
    return K.cell_feature(cells, ["fire", "det_id"])


# ---- round trips: written to the shared folder by the sink, read back by the reader ------


def landed(spark):
    return f"{checkpoint_root(spark)}/landed-{uuid.uuid4().hex}"


@query("k06_s20_track_round_trip", cte("track") + " SELECT pt, CAST(icao AS VARCHAR) AS icao, callsign, lat, lon, alt_m, drop FROM track WHERE t >= 1706400000e0 - 480*3600", "lat lon alt_m")
def _(spark, sf):
    path = landed(spark)
    K.append_tracks(view(spark, sf, "track").withColumns({"fire": F.lit("f"), "kind": F.col("pt").cast("string")}), path)
    back = G.read_tracks(spark, path, 1706400000.0, 480.0)
    return back.select(F.col("kind").cast("bigint").alias("pt"), "icao", "callsign", "lat", "lon", "alt_m", "drop")


@query("k01_summary_round_trip", cte("perimeter") + " SELECT perim_id, acres, pct_contained AS lo_acres FROM perimeter", "acres lo_acres")
def _(spark, sf):
    path = landed(spark)
    K.write_summary(view(spark, sf, "perimeter").select("perim_id", "acres", F.col("pct_contained").alias("lo_acres")), path)
    return spark.read.schema("perim_id bigint, acres double, lo_acres double").json(path)


@query("k03_snapshot_round_trip", cte("detections", "fires") + " SELECT f.fire, count(det_id) AS n, min(acq) AS first_acq FROM fires f LEFT JOIN detections d USING (fire) GROUP BY f.fire")
def _(spark, sf):
    path = landed(spark)
    K.write_snapshot({n: view(spark, sf, n) for n in ("detections", "fires")}, path, "run")
    back = K.read_snapshot(spark, path, "run", ["detections", "fires"])
    joined = back["fires"].select("fire").join(back["detections"], "fire", "left")
    return joined.groupBy("fire").agg(F.count("det_id").alias("n"), F.min("acq").cast("timestamp_ntz").alias("first_acq"))


@query("k05_health_round_trip", cte("source_health") + " SELECT seq, status, coalesce(reason,'') AS reason, record_count FROM source_health")
def _(spark, sf):
    path = landed(spark)
    K.append_health(view(spark, sf, "source_health"), path)
    return spark.read.parquet(path).select("seq", "status", "reason", "record_count")


# ---- streams: the driver table is the stream source --------------------------------------


def raw_stream(spark, sf, source):
    # A glob reaches the table whether it is one file or a folder of files.
    schema = table(spark, sf, source).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/{source}.parque[t]")


def stream(spark, sf, name):
    """A fixture view as a stream over its source table, one file per trigger."""
    source, exprs = VIEWS[name]
    schema = table(spark, sf, source).schema
    raw = raw_stream(spark, sf, source).select(*schema.names)
    out = raw.selectExpr(*_split(_spell(exprs, "spark")))
    for c, kind in out.dtypes:
        if kind == "timestamp_ntz":
            out = out.withColumn(c, F.col(c).cast("timestamp"))
    return out


@query("t01_stream_detections", cte("detections") + " SELECT det_id, fire FROM detections WHERE det_id % 9 > 0")
def _(spark, sf):
    d = stream(spark, sf, "detections").withColumn("frp", F.when(F.col("det_id") % 9 == 0, -1.0).otherwise(F.col("frp")))
    return J.drain(J.stream_detections(d)).select("det_id", "fire")


@query("t03_stream_loitering", cte("track") + """, w AS (SELECT CAST(floor(t/43200) AS BIGINT)*43200 + o*43200 - 43200 AS ws, icao, lat, lon, spd_ms, t FROM track, range(0,2) r(o)),
  g AS (SELECT ws, icao, count(*) AS n, sqrt(pow((max(lon)-min(lon))*111.32e0*cos(radians(avg(lat))),2)+pow((max(lat)-min(lat))*111.32e0,2)) AS s FROM w GROUP BY ALL)
  SELECT ws, icao, n, s AS spread_km FROM g WHERE n >= 2 AND s <= 4""", "spread_km")
def _(spark, sf):
    job = lambda points: J.stream_loitering(points, 2, 4.0, lookback="24 hours", every="12 hours")
    return J.drain_closed(job, stream(spark, sf, "track"), "ts", "icao").select(F.unix_seconds("window.start").alias("ws"), "icao", "n", "spread_km")


@query("t05_stream_health", cte("source_health") + """, w AS (SELECT CAST(floor(epoch_us(t)/1e6/43200) AS BIGINT)*43200 + o*43200 - 43200 AS ws, source, status FROM source_health, range(0,2) r(o))
  SELECT ws, source, count(*) AS attempts, count(*) FILTER (status='ok') AS ok, count(*) FILTER (status='unavailable') AS unavailable FROM w GROUP BY ALL""")
def _(spark, sf):
    job = lambda log: J.stream_health(log, every="12 hours")
    return J.drain_closed(job, stream(spark, sf, "source_health"), "t", "source").select(F.unix_seconds("window.start").alias("ws"), "source", "attempts", "ok", "unavailable")


@query("t06_stream_cycle_alerts", f"""WITH h AS (SELECT o_orderkey AS seq, o_custkey % 700 AS fire, epoch_us(o_orderdate)/1e6 AS t, o_totalprice/1e1 AS pred_acres FROM orders),
  p AS (SELECT *, lag(pred_acres) OVER w AS pa, (t - lag(t) OVER w)/60e0 AS mins FROM h WINDOW w AS (PARTITION BY fire ORDER BY t, seq)),
  b AS (SELECT *, CASE WHEN mins > 0 THEN greatest(pi()*pow(greatest(sqrt(greatest(pa,0)*4046.86e0/pi()), {FLOOR_RADIUS_M}) + {MAX_HEAD_ROS_M_MIN}*mins, 2) - greatest(pa,0)*4046.86e0, 0)/4046.86e0 END AS bound FROM p)
  SELECT fire, seq, pred_acres - pa AS delta_acres, bound/1e9 AS bound, coalesce(pred_acres - pa > bound, false) AS physics_alert FROM b""", "delta_acres bound")
def _(spark, sf):
    raw = raw_stream(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    c = raw.select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 700).alias("fire"), at.alias("ts"), (F.unix_micros(at) / F.lit(1e6)).alias("t"), (F.col("o_totalprice") / 10).alias("pred_acres"))
    out = J.drain_closed(lambda cycles: T.stream_cycle_alerts(cycles, "3000 days"), c, "ts", "fire")  # orders come in no order
    return out.select("fire", "seq", "delta_acres", (F.col("feasible_acres") / 1e9).alias("bound"), "physics_alert")


@query("t07_stream_drop_runs", cte("track") + f", {DROPS} SELECT icao, count(*) AS hits, min(t) AS t0, max(t) AS t1, arg_max(drop_kind, pt) AS kind FROM rr WHERE drop_kind IS NOT NULL GROUP BY icao, run", "t0 t1")
def _(spark, sf):
    t = stream(spark, sf, "track").select("icao", "ts", "t", "pt", (F.col("alt_m") - 20.0).alias("agl_m"), "spd_ms", F.col("callsign").startswith("COPTER").alias("heli"))
    out = J.drain_closed(lambda tracks: T.stream_drop_runs(tracks, gap_s=90 * 86400.0), t, "ts", "icao")
    return out.select("icao", "hits", "t0", "t1", "kind")


@query("t04_stream_reachability")
def _(spark, sf):
    d = stream(spark, sf, "detections").select("fire", F.col("acq").alias("ts"), "det_id", "t", "lat", "lon", "frp", (F.col("frp") * 900.0).alias("area_m2"), (F.col("det_id") < 150).alias("seed"))
    out = J.drain_closed(lambda dets: T.stream_reachability(dets, 38.5, max_speed_kmh=0.05, tolerance_m=900.0), d, "ts", "fire")
    return out.select("fire", "det_id", "accepted", "distance_m")


@query("t08_split_rejects", cte("detections") + " SELECT det_id, 'post_cutoff_acquisition' AS reject_reason FROM detections WHERE acq > TIMESTAMP '2024-01-20 00:00:00'")
def _(spark, sf):
    _, rejected = J.split_rejects(view(spark, sf, "detections"), F.lit("2024-01-20").cast("timestamp"))
    return rejected.select("det_id", "reject_reason")


@query("t02_track_batch", cte("track") + """, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY pt % 3, pt) AS rn FROM track) WHERE rn = 1 AND NOT on_ground AND regexp_matches(callsign, '^(TANKER|COPTER)')),
  a AS (SELECT *, CASE WHEN alt_source = 'baro' THEN alt_m + (30e0-29.92e0)*304.8e0 ELSE alt_m END - 20e0 AS agl FROM m) SELECT icao, agl AS agl_m, coalesce(agl <= 600 AND ((starts_with(callsign,'COPTER') AND spd_ms BETWEEN 0 AND 45) OR spd_ms BETWEEN 55 AND 100), false) AS drop FROM a""", "agl_m")
def _(spark, sf):
    feeds = ["opensky", "adsb.lol", "adsb.fi"]
    feed = F.element_at(F.array(*[F.lit(f) for f in feeds]), (F.col("pt") % 3 + 1).cast("int"))
    states = view(spark, sf, "track").withColumns({"feed": feed, "seq": F.col("pt")}).drop("drop")
    fleet = spark.sql("SELECT '' AS icao24, '' AS operator, '' AS model, '' AS role WHERE false")
    alt = states.select("icao").distinct().withColumn("altim_inhg", F.lit(30.0))
    return J.track_batch(states, fleet, alt, feeds, F.lit(20.0)).select("icao", "agl_m", "drop")


@query("t10_stream_latest_fill", cte("abi_pixel") + """ SELECT tile_i, tile_j, t FROM (SELECT *, row_number() OVER (PARTITION BY tile_i, tile_j ORDER BY t DESC, seq) AS rn FROM (SELECT t, granule*8+line AS seq, CAST(round_even(lat/(2e0/111.32e0),0) AS BIGINT) AS tile_i,
  CAST(round_even(lon/(2e0/(111.32e0*cos(radians(lat)))),0) AS BIGINT) AS tile_j FROM abi_pixel)) WHERE rn = 1""", "t")
def _(spark, sf):
    px = D.fill_fraction(D.abi_state(stream(spark, sf, "abi_pixel"))).withColumn("seq", F.col("granule") * 8 + F.col("line"))
    rows = J.drain(J.stream_latest_fill(px), "update")
    return rows.groupBy("tile_i", "tile_j").agg(F.max_by("t", "batch").alias("t"))


