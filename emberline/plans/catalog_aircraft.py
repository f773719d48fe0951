"""Queries over aircraft tracks, registries and airports."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import aircraft as A
from emberline.plans.catalog import query
from emberline.plans.fixtures import SQUARE_DEG, cte, table, view

DAY = lambda: F.floor(F.col("t") / 86400)

# Registry rows spelled from part: operators, owners, models and repeats of one airframe.
REGISTRY_COLS = [
    "CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE ' ' || CAST(p_partkey % 1500 AS STRING) END AS icao24",
    "p_partkey AS seq", "p_name AS registration", "p_brand AS manufacturer",
    "CASE p_partkey % 8 WHEN 0 THEN 'DC-10' WHEN 1 THEN 'C-130 Hercules' WHEN 2 THEN 'AT-802' WHEN 3 THEN 'CL-415' WHEN 4 THEN 'King Air 200' WHEN 5 THEN '206B (Bell)' WHEN 6 THEN 'UH-1H' ELSE 'unknown' END AS model",
    "p_type AS typecode", "CASE WHEN p_size > 25 THEN 'L1P' ELSE NULL END AS icaoaircrafttype",
    "CASE p_partkey % 5 WHEN 0 THEN 'Coulson Aviation' WHEN 1 THEN '' WHEN 2 THEN 'Delta' ELSE 'US Forest Service' END AS operator",
    "CASE WHEN p_partkey % 3 = 0 THEN 'Conair Group Inc' ELSE 'Private' END AS owner",
]
REG = "reg AS (SELECT " + ", ".join(c.replace("AS STRING", "AS VARCHAR") for c in REGISTRY_COLS) + " FROM part)"
_ops = "|".join(A.FIRE_OPERATORS)
_roles = " ".join(f"WHEN regexp_matches(hay, '{'|'.join(toks)}') THEN '{role}'" for role, toks in A.ROLE_TOKENS)
FLEET = f"""fleet AS (SELECT icao24, registration, manufacturer, model, typecode, icaoaircrafttype, operator, CASE {_roles} ELSE 'unclassified_fire_operator' END AS role FROM (
  SELECT *, regexp_replace(upper(concat_ws(' ', model, typecode, icaoaircrafttype)), '[^A-Z0-9]', '', 'g') AS hay FROM (
  SELECT lower(trim(icao24)) AS icao24, registration, manufacturer, model, typecode, icaoaircrafttype, coalesce(nullif(operator, ''), owner) AS operator,
  row_number() OVER (PARTITION BY lower(trim(icao24)) ORDER BY seq DESC) AS rn FROM reg
  WHERE regexp_matches(upper(operator) || chr(10) || upper(owner), '{_ops}') AND trim(icao24) <> '') WHERE rn = 1))"""


def fleet(spark, sf):
    return A.fire_fleet(table(spark, sf, "part").selectExpr(*REGISTRY_COLS))


@query("s16_fire_fleet", f"WITH {REG}, {FLEET} SELECT icao24, model, operator, role FROM fleet")
def _(spark, sf):
    return fleet(spark, sf).select("icao24", "model", "operator", "role")


@query("a22_role_counts", f"WITH {REG}, {FLEET} SELECT role, count(*) AS n FROM fleet GROUP BY role")
def _(spark, sf):
    return A.role_counts(fleet(spark, sf))


@query("x08_classify_role", f"WITH {REG} SELECT seq, CASE {_roles} ELSE 'unclassified_fire_operator' END AS role FROM (SELECT seq, regexp_replace(upper(concat_ws(' ', model, typecode, icaoaircrafttype)), '[^A-Z0-9]', '', 'g') AS hay FROM reg)")
def _(spark, sf):
    return A.classify_role(table(spark, sf, "part").selectExpr(*REGISTRY_COLS)).select("seq", "role")


@query("j11_registry_lookup", cte("track") + f", {REG}, {FLEET} SELECT pt, registry_operator, registry_role FROM (SELECT t.pt, f.operator AS registry_operator, f.role AS registry_role FROM track t LEFT JOIN fleet f ON CAST(t.icao AS VARCHAR) = f.icao24)")
def _(spark, sf):
    return A.registry_lookup(view(spark, sf, "track"), fleet(spark, sf)).select("pt", "registry_operator", "registry_role")


@query("g15_multi_feed_merge", cte("track") + """ SELECT icao, feed, seq, alt_m FROM (SELECT icao, pt AS seq, alt_m, ['opensky','adsb.lol','adsb.fi'][CAST(pt % 3 AS INTEGER) + 1] AS feed,
  row_number() OVER (PARTITION BY icao ORDER BY pt % 3, pt) AS rn FROM track) WHERE rn = 1""", "alt_m")
def _(spark, sf):
    feeds = ["opensky", "adsb.lol", "adsb.fi"]
    feed = F.element_at(F.array(*[F.lit(f) for f in feeds]), (F.col("pt") % 3 + 1).cast("int"))
    st = view(spark, sf, "track").select("icao", F.col("pt").alias("seq"), feed.alias("feed"), "alt_m")
    return A.multi_feed_merge(st, feeds).select("icao", "feed", "seq", "alt_m")


@query("x09_baro_to_msl", cte("track") + """, k AS (SELECT *, CASE WHEN pt % 4 = 3 THEN NULL ELSE 29.5e0 + (pt % 9)/1e1 END AS altim FROM track)
  SELECT pt, CASE WHEN alt_source = 'baro' AND altim IS NOT NULL THEN alt_m + (altim - 29.92e0)*304.8e0 ELSE alt_m END AS alt_m,
  coalesce(alt_source = 'baro' AND alt_m IS NOT NULL AND altim IS NOT NULL, false) AS alt_msl_corrected FROM k""", "alt_m")
def _(spark, sf):
    t = view(spark, sf, "track").withColumn("altim", F.when(F.col("pt") % 4 != 3, F.lit(29.5) + (F.col("pt") % 9) / F.lit(10.0)))
    return A.baro_to_msl(t, "altim").select("pt", "alt_m", "alt_msl_corrected")


@query("f17_low_slow_points", cte("track") + " SELECT pt FROM track WHERE alt_m IS NOT NULL AND alt_m - 30e0 <= 300 AND (spd_ms IS NULL OR spd_ms <= 90)")
def _(spark, sf):
    return A.low_slow_points(view(spark, sf, "track"), F.lit(30.0), 300.0).select("pt")


LOIT = """loit AS (SELECT icao, day, n, sqrt(pow((lon1-lon0)*111.32e0*cos(radians(mlat)),2)+pow((lat1-lat0)*111.32e0,2)) AS spread_km, mean_spd FROM (
  SELECT icao, CAST(floor(t/86400) AS BIGINT) AS day, count(*) AS n, avg(lat) AS mlat, avg(spd_ms) AS mean_spd, min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1 FROM track GROUP BY icao, day))"""


def daily_track(spark, sf):
    return view(spark, sf, "track").withColumn("day", F.floor(F.col("t") / 86400))


@query("a10_loitering", cte("track") + f", {LOIT} SELECT * FROM loit WHERE n >= 2 AND spread_km <= 4 AND mean_spd <= 110", "spread_km mean_spd")
def _(spark, sf):
    return A.loitering(daily_track(spark, sf), ["icao", "day"], min_points=2, max_spread_km=4.0)


@query("f21_is_firefighting", cte("track") + f", {REG}, {FLEET}, {LOIT} " + """SELECT pt FROM track t LEFT JOIN fleet f ON CAST(t.icao AS VARCHAR) = f.icao24 WHERE NOT on_ground AND (f.icao24 IS NOT NULL
  OR (regexp_matches(upper(callsign), '^(TANKER|TNKR|AIRATK|AIRAT|ATTACK|LEAD|BRONCO|COPTER|HELITK|CALFIRE|GRIZZLY|MALIBU|NEPTUNE)') AND length(callsign) >= 4)
  OR t.icao IN (SELECT icao FROM loit WHERE n >= 2 AND spread_km <= 4 AND mean_spd <= 110))""")
def _(spark, sf):
    loit = A.loitering(daily_track(spark, sf), ["icao", "day"], min_points=2, max_spread_km=4.0)
    return A.is_firefighting(view(spark, sf, "track"), fleet(spark, sf), loit).select("pt")


NEAR_APT = """near AS (SELECT pt, ident, d, elev_ft FROM (SELECT *, row_number() OVER (PARTITION BY pt ORDER BY d, ident) AS rn FROM (
  SELECT t.pt, a.ident, a.elev_ft, 12742e0*asin(least(1e0, sqrt(pow(sin(radians(a.lat-t.lat)/2),2)+cos(radians(t.lat))*cos(radians(a.lat))*pow(sin(radians(a.lon-t.lon)/2),2)))) AS d
  FROM track t, airport a WHERE a.type NOT IN ('closed','balloonport','')) WHERE d <= 8e0) WHERE rn = 1)"""


def open_airports(spark, sf):
    return view(spark, sf, "airport").where("type NOT IN ('closed', 'balloonport', '')")


@query("j02_nearest_airport", cte("track", "airport") + f", {NEAR_APT} SELECT pt, ident, d FROM near", "d")
def _(spark, sf):
    return A.nearest_airport(view(spark, sf, "track"), open_airports(spark, sf), 8.0, ["pt"]).select("pt", "ident", "d")


@query("j12_airport_pattern_exclusion", cte("track", "airport") + ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icao ORDER BY t DESC, pt DESC) AS rn FROM track) WHERE rn = 1), " + NEAR_APT.replace("FROM track t,", "FROM latest t,") + """
  SELECT DISTINCT icao FROM track WHERE icao NOT IN (SELECT l.icao FROM latest l JOIN near USING (pt) WHERE l.alt_m - elev_ft*0.3048e0 <= 500e0)""")
def _(spark, sf):
    t = view(spark, sf, "track")
    last = t.groupBy("icao").agg(F.max(F.struct("t", "pt", "lat", "lon", "alt_m")).alias("r")).select("icao", "r.*")
    return A.airport_pattern_exclusion(t.select("icao").distinct(), last, open_airports(spark, sf))


RUNS = """flips AS (SELECT *, CASE WHEN lag(drop) OVER w IS NOT NULL AND lag(drop) OVER w <> drop THEN 1 ELSE 0 END AS flip FROM track WINDOW w AS (PARTITION BY icao ORDER BY t, pt)),
  runs AS (SELECT *, CAST(sum(flip) OVER (PARTITION BY icao ORDER BY t, pt) AS BIGINT) AS run FROM flips),
  segs AS (SELECT icao, run, count(*) AS n_pts, min(t) AS t0, max(t) AS t1, first(drop) AS drop, arg_max(callsign, pt) AS callsign, avg(lat) AS clat, avg(lon) AS clon FROM runs GROUP BY icao, run HAVING count(*) >= 2)"""


def segments(spark, sf):
    return A.segment_summary(view(spark, sf, "track").withColumn("kind", F.lit("unknown")), DAY())


@query("w01_path_segments", cte("track") + f", {RUNS} SELECT icao, run, n_pts, t0, t1, drop, callsign, clat, clon FROM segs", "t0 t1 clat clon")
def _(spark, sf):
    return segments(spark, sf).select("icao", "run", "n_pts", "t0", "t1", "drop", "callsign", "clat", "clon")


DROPS = """agl AS (SELECT *, alt_m - 20e0 AS agl FROM track), nb AS (SELECT *, lag(agl) OVER w AS p, lead(agl) OVER w AS n FROM agl WINDOW w AS (PARTITION BY icao ORDER BY t, pt)),
  drops AS (SELECT *, CASE WHEN (p IS NULL OR agl <= p + 40) AND (n IS NULL OR agl <= n + 40) THEN CASE
   WHEN regexp_matches(callsign, '^(COPTER|HELI|HELO)') AND agl <= 90 AND spd_ms BETWEEN 0 AND 42 THEN 'water(heli)'
   WHEN NOT regexp_matches(callsign, '^(COPTER|HELI|HELO)') AND agl <= 180 AND spd_ms BETWEEN 48 AND 108 THEN 'retardant(tanker)' END END AS drop_kind FROM nb),
  st AS (SELECT *, CASE WHEN drop_kind IS NOT NULL AND lag(drop_kind) OVER w IS NULL THEN 1 ELSE 0 END AS s, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM drops WINDOW w AS (PARTITION BY icao ORDER BY t, pt)),
  rr AS (SELECT *, CAST(sum(s) OVER (PARTITION BY icao ORDER BY t, pt) AS BIGINT) AS run FROM st)"""


def drops(spark, sf):
    return A.classify_drops(view(spark, sf, "track").withColumn("agl_m", F.col("alt_m") - 20.0), DAY())


@query("w02_classify_drops", cte("track") + f", {DROPS} SELECT pt, drop_kind FROM drops WHERE drop_kind IS NOT NULL")
def _(spark, sf):
    return drops(spark, sf).where("drop_kind IS NOT NULL").select("pt", "drop_kind")


@query("w03_drop_runs", cte("track") + f", {DROPS} " + """SELECT icao, run, count(*) AS hits, min(t) AS t0, max(t) AS t1, arg_max(drop_kind, pt) AS kind,
  greatest(CAST(count(*) + (CASE WHEN arg_min_null(plon, pt) IS NULL THEN 0 ELSE 1 END) + (CASE WHEN arg_max_null(nlon, pt) IS NULL THEN 0 ELSE 1 END) AS INTEGER), 2) AS n_coords FROM rr WHERE drop_kind IS NOT NULL GROUP BY icao, run""", "t0 t1")
def _(spark, sf):
    return A.drop_runs(drops(spark, sf), DAY()).select("icao", "run", "hits", "t0", "t1", "kind", F.size("coords").alias("n_coords"))


LEGS = DROPS + """, lg AS (SELECT *, sqrt(pow((lon-plon)*111.32e0*cos(radians(plat)),2)+pow((lat-plat)*111.32e0,2)) AS km_in, sqrt(pow(lon-plon,2)+pow(lat-plat,2)) AS w_in,
   sqrt(pow((nlon-lon)*111.32e0*cos(radians(lat)),2)+pow((nlat-lat)*111.32e0,2)) AS km_out, sqrt(pow(nlon-lon,2)+pow(nlat-lat,2)) AS w_out FROM rr WHERE drop_kind IS NOT NULL),
  ln AS (SELECT icao, run, count(*) AS hits, coalesce(sum(km_in),0) + coalesce(arg_max_null(km_out,pt),0) AS length_km, coalesce(sum(w_in),0)+coalesce(arg_max_null(w_out,pt),0) AS w,
   (coalesce(sum(w_in*(lon+plon)/2),0)+coalesce(arg_max_null(w_out*(lon+nlon)/2,pt),0)) AS wx, (coalesce(sum(w_in*(lat+plat)/2),0)+coalesce(arg_max_null(w_out*(lat+nlat)/2,pt),0)) AS wy FROM lg GROUP BY icao, run)"""


@query("w04_recent_drop_paths", cte("track", "fires") + f", {LEGS} " + """SELECT icao, run, fire, hits, length_km FROM ln, fires WHERE length_km <= 8 AND
  sqrt(pow(greatest(abs(wx/w-lon0)-0.01e0,0),2)+pow(greatest(abs(wy/w-lat0)-0.01e0,0),2)) <= 6e0/111e0""", "length_km")
def _(spark, sf):
    bases = view(spark, sf, "fires").withColumn("half_deg", F.lit(SQUARE_DEG["base"]))
    out = A.guarded_drop_paths(A.drop_runs(drops(spark, sf), DAY()), bases, 8.0, 6.0)
    return out.select("icao", "run", "fire", "hits", "length_km")


@query("w05_instant_drop_flag", cte("track") + f", {REG}, {FLEET} " + """, x AS (SELECT t.pt, t.spd_ms, t.callsign, CASE WHEN t.pt % 6 = 0 THEN NULL ELSE t.alt_m - 10e0 END AS agl, f.role FROM track t LEFT JOIN fleet f ON CAST(t.icao AS VARCHAR) = f.icao24),
  h AS (SELECT *, CASE WHEN role IS NOT NULL THEN starts_with(role, 'helitanker_') ELSE regexp_matches(callsign, '^(COPTER|HELI|H)') AND NOT starts_with(callsign, 'HL') END AS heli FROM x),
  d AS (SELECT *, coalesce(agl <= 600 AND heli AND spd_ms BETWEEN 0 AND 45, false) AS water, coalesce(agl <= 600 AND spd_ms BETWEEN 55 AND 100, false) AS tank FROM h)
  SELECT pt, water OR tank AS drop, CASE WHEN role IS NOT NULL THEN role WHEN water THEN 'water(heli)' WHEN tank THEN 'retardant(tanker)' ELSE 'unknown' END AS kind FROM d""")
def _(spark, sf):
    t = A.registry_lookup(view(spark, sf, "track").drop("drop"), fleet(spark, sf))
    t = t.withColumn("agl_m", F.when(F.col("pt") % 6 != 0, F.col("alt_m") - 10.0))
    return A.instant_drop_flag(t).select("pt", "drop", "kind")


def drop_segments(spark, sf):
    t = view(spark, sf, "track").withColumn("kind", F.lit("unknown"))
    return A.segment_summary(t, DAY()).where("drop")


@query("c02_greedy_cluster")
def _(spark, sf):
    return A.greedy_cluster(drop_segments(spark, sf), 1.2).select("icao", "run", "cluster", "cluster_n", "cluster_lon", "cluster_lat")


@query("w09_shuttle_detection")
def _(spark, sf):
    out = A.shuttle_detection(drop_segments(spark, sf), 2, 1.2)
    return out.select("icao", "callsign", "n_round_trips", F.col("away.spread_km").alias("away_spread_km"), F.col("away.visits").alias("away_visits"))


@query("g13_drop_line_orientation", cte("track") + """ SELECT icao, n, deg - 180e0*floor(deg/180e0) AS bearing FROM (SELECT icao, count(*) AS n, degrees(0.5e0*atan2(2*covar_samp(lon*87e0, lat*111.32e0), var_samp(lon*87e0) - var_samp(lat*111.32e0))) AS deg FROM track WHERE drop GROUP BY icao HAVING count(*) >= 3)""", "bearing")
def _(spark, sf):
    pts = view(spark, sf, "track").where("drop").select("icao", (F.col("lon") * 87.0).alias("x"), (F.col("lat") * 111.32).alias("y"))
    return A.drop_line_orientation(pts, ["icao"])


@query("g13_drop_point_hull")
def _(spark, sf):
    pts = view(spark, sf, "track").where("drop").select("icao", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return A.convex_hulls(pts, ["icao"])
