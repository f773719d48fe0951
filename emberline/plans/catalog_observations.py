"""Queries over detections, geostationary pixels, source health and cycle history."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import detections as D
from emberline.operators import health as H
from emberline.plans.catalog import query
from emberline.plans.fixtures import cte, table, view

CUTOFF = "2024-01-25 00:00:00"
NOW_S = 1706659200.0  # 2024-01-31T00:00:00Z
SINCE = "2024-01-29 00:00:00"
BBOX = (-121.5, 38.5, -120.5, 39.5)
TSLOT = lambda: F.floor(F.col("t") / 86400)  # noqa: E731  one slot per day of epoch seconds

# Rows with damaged fields, so the reject rules have something to do.
RAW_DETS = """raw AS (SELECT det_id, fire, CASE WHEN det_id % 101 = 0 THEN NULL ELSE acq END AS acq, t,
  CASE WHEN det_id % 97 = 0 THEN 190.0e0 ELSE lon END AS lon, lat,
  CASE WHEN det_id % 89 = 0 THEN -1.0e0 WHEN det_id % 83 = 0 THEN NULL ELSE frp END AS frp, sensor FROM detections)"""
JUDGED = """judged AS (SELECT *, CASE
  WHEN NOT coalesce(acq IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND coalesce(frp,0) >= 0, false)
  THEN 'missing_or_invalid_acquisition_record' WHEN acq > TIMESTAMP '2024-01-25 00:00:00' THEN 'post_cutoff_acquisition' END AS reject_reason FROM raw)"""


def raw_detections(spark, sf):
    d = view(spark, sf, "detections")
    m = lambda n: F.col("det_id") % n == 0
    return d.withColumns(
        {
            "acq": F.when(~m(101), F.col("acq")),
            "lon": F.when(m(97), F.lit(190.0)).otherwise(F.col("lon")),
            "frp": F.when(m(89), F.lit(-1.0)).when(~m(83), F.col("frp")),
        }
    )


def cutoff():
    return F.lit(CUTOFF).cast("timestamp")


def kept_detections(spark, sf):
    kept, _ = D.cutoff_detections(raw_detections(spark, sf), cutoff())
    return D.dedup_detections(kept, ["det_id"], 4)


@query("f01_bbox_filter", cte("detections") + f""" SELECT det_id, fire, lat, lon FROM detections
  WHERE lon BETWEEN {BBOX[0]}e0 AND {BBOX[2]}e0 AND lat BETWEEN {BBOX[1]}e0 AND {BBOX[3]}e0""", "lat lon")
def _(spark, sf):
    return D.bbox_filter(view(spark, sf, "detections"), BBOX).select("det_id", "fire", "lat", "lon")


@query("f02_buffer_bbox", cte("detections") + """ SELECT fire, west - 50e0/(111.0e0*cos(radians((south+north)/2))) AS west, south - 50e0/111.0e0 AS south,
  east + 50e0/(111.0e0*cos(radians((south+north)/2))) AS east, north + 50e0/111.0e0 AS north FROM (
  SELECT fire, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM detections GROUP BY fire)""", "west south east north")
def _(spark, sf):
    boxes = view(spark, sf, "detections").groupBy("fire").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")
    )
    return D.buffer_bbox(boxes, 50.0)


@query("f08_cutoff_kept", cte("detections") + f", {RAW_DETS}, {JUDGED} " + """SELECT fire, det_id, acq, lon, lat, coalesce(frp,0) AS frp, sensor
  FROM judged WHERE reject_reason IS NULL""", "lon lat frp")
def _(spark, sf):
    return D.cutoff_detections(raw_detections(spark, sf), cutoff())[0]


@query("f08_cutoff_rejected", cte("detections") + f", {RAW_DETS}, {JUDGED} SELECT fire, det_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL")
def _(spark, sf):
    return D.cutoff_detections(raw_detections(spark, sf), cutoff())[1]


@query("f09_dedup_detections", cte("detections") + """ SELECT det_id, fire, lat, lon, acq, frp FROM (
  SELECT *, row_number() OVER (PARTITION BY round_even(lat,3), round_even(lon,3), acq ORDER BY det_id) AS rn FROM (
  SELECT det_id, fire, lat + 0.00003e0 AS lat, lon + 0.00003e0 AS lon, date_trunc('month', acq) AS acq, frp FROM detections)) WHERE rn = 1""", "lat lon frp")
def _(spark, sf):
    # The shift keeps fixture coordinates away from rounding ties, where the two engines' decimals differ.
    off = lambda c: (F.col(c) + F.lit(0.00003)).alias(c)
    coarse = view(spark, sf, "detections").select("det_id", "fire", off("lat"), off("lon"), F.date_trunc("month", "acq").alias("acq"), "frp")
    return D.dedup_detections(coarse, ["det_id"], 3)


@query("f10_covering_products", """WITH steps AS (SELECT DISTINCT user_id % 40 AS step, CAST(ts AS DATE) AS start_date, CAST(ts AS DATE) + CAST(user_id % 4 AS INTEGER) AS end_date FROM events),
  avail AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'VIIRS_SNPP_' WHEN 1 THEN 'VIIRS_NOAA20_' WHEN 2 THEN 'VIIRS_NOAA21_' ELSE 'MODIS_' END || n_nationkey AS product,
  DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS min_date, DATE '2024-01-01' + CAST(n_nationkey + 3 AS INTEGER) AS max_date FROM nation)
  SELECT step, start_date, end_date, string_agg(DISTINCT product, ',' ORDER BY product) AS products FROM steps JOIN avail
  ON min_date <= end_date AND max_date >= start_date WHERE NOT starts_with(product, 'MODIS') GROUP BY ALL""")
def _(spark, sf):
    day = F.to_date("ts")
    steps = table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("step"), day.alias("start_date"), F.date_add(day, (F.col("user_id") % 4).cast("int")).alias("end_date")
    ).distinct()
    n = F.col("n_nationkey")
    fam = F.when(n % 4 == 0, "VIIRS_SNPP_").when(n % 4 == 1, "VIIRS_NOAA20_").when(n % 4 == 2, "VIIRS_NOAA21_").otherwise("MODIS_")
    start = F.lit("2024-01-01").cast("date")
    avail = table(spark, sf, "nation").select(
        F.concat(fam, n.cast("string")).alias("product"), F.date_add(start, n.cast("int")).alias("min_date"), F.date_add(start, (n + 3).cast("int")).alias("max_date")
    )
    return D.covering_products(steps, avail)


PIX = """pix AS (SELECT *, CASE WHEN mask IN (10,11,12,13,14,15,30,31,32,33,34,35) THEN 'fire' WHEN mask <= 0 OR dqf >= 2 THEN 'unavailable' ELSE 'observed_nonfire' END AS state,
  mask IN (11,31) AS saturated, CASE WHEN area_m2 IS NULL OR mask IN (11,31) THEN NULL ELSE least(area_m2/4e6, 1e0) END AS fill_fraction FROM abi_pixel)"""


def pixels(spark, sf):
    return D.fill_fraction(D.abi_state(view(spark, sf, "abi_pixel")))


@query("f12_abi_state", cte("abi_pixel") + f", {PIX} SELECT platform, state, saturated, count(*) AS n FROM pix GROUP BY ALL")
def _(spark, sf):
    return pixels(spark, sf).groupBy("platform", "state", "saturated").agg(F.count("*").alias("n"))


@query("f13_fill_fraction", cte("abi_pixel") + f", {PIX} SELECT granule, line, fill_fraction FROM pix WHERE state = 'fire'", "fill_fraction")
def _(spark, sf):
    return pixels(spark, sf).where("state = 'fire'").select("granule", "line", "fill_fraction")


SPEC = """CASE WHEN l_orderkey % 5 = 0 THEN 0.5e0 ELSE l_discount * 5e0 END AS b12, l_tax * 4e0 AS b11, l_discount * 1.5e0 AS b4, l_tax * 5e0 AS nir"""


def spectral(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_suppkey AS scene", "l_orderkey AS px", "l_linenumber AS line", *[s for s in
        ["CASE WHEN l_orderkey % 5 = 0 THEN 0.5e0 ELSE l_discount * 5e0 END AS b12", "l_tax * 4e0 AS b11", "l_discount * 1.5e0 AS b4", "l_tax * 5e0 AS nir", "l_discount * 5e0 AS swir"]])


@query("f18_multispectral_fire_mask", f"""WITH s AS (SELECT l_suppkey AS scene, l_orderkey AS px, l_linenumber AS line, {SPEC} FROM lineitem),
  h AS (SELECT * FROM s WHERE b12 > 0.3e0 AND b12 > 1.4e0*b11 AND b12 > 2*b4), e AS (SELECT scene FROM h GROUP BY scene HAVING count(*) >= 2)
  SELECT scene, count(*) AS n, avg(b12) AS b12 FROM h WHERE scene IN (SELECT scene FROM e) GROUP BY scene""", "b12")
def _(spark, sf):
    return D.multispectral_fire_mask(spectral(spark, sf)).groupBy("scene").agg(F.count("*").alias("n"), F.avg("b12").alias("b12"))


@query("f19_burn_scar_mask", f"""WITH s AS (SELECT l_suppkey AS scene, l_tax * 5e0 AS nir, l_discount * 5e0 AS swir FROM lineitem),
  n AS (SELECT scene, (nir-swir)/(nir+swir+1e-6) AS nbr FROM s) SELECT scene, count(*) AS n, min(nbr) AS lowest FROM n WHERE nbr < 0.05e0 GROUP BY scene""", "lowest")
def _(spark, sf):
    return D.burn_scar_mask(spectral(spark, sf)).groupBy("scene").agg(F.count("*").alias("n"), F.min("nbr").alias("lowest"))


@query("f20_warm_pixel_filter", cte("abi_pixel") + """ SELECT granule, line, bt, greatest(least((bt-320e0)/80e0, 1e0), 0.05e0) AS hotness,
  0.5e0 + greatest(least((bt-320e0)/80e0, 1e0), 0.05e0) AS radius_km FROM abi_pixel WHERE bt >= 320""", "bt hotness radius_km")
def _(spark, sf):
    return D.warm_pixels(view(spark, sf, "abi_pixel")).select("granule", "line", "bt", "hotness", "radius_km")


@query("f24_live_detections", cte("abi_pixel", "detections") + f", {PIX} " + """SELECT sensor, count(*) AS n, sum(frp) AS frp FROM (
  SELECT platform AS sensor, greatest(coalesce(power_mw, 1e0), 0e0) AS frp FROM pix WHERE state = 'fire'
  UNION ALL SELECT 'VIIRS', coalesce(frp, 0e0) FROM detections WHERE sensor = 'VIIRS') GROUP BY sensor""", "frp")
def _(spark, sf):
    viirs = view(spark, sf, "detections").where("sensor = 'VIIRS'")
    live = D.live_detections(pixels(spark, sf), viirs)
    return live.groupBy("sensor").agg(F.count("*").alias("n"), F.sum("frp").alias("frp"))


@query("a07_sensor_counts", cte("detections") + """ SELECT fire, string_agg(sensor || '=' || n, ',' ORDER BY sensor) AS dets_by_sensor FROM (
  SELECT fire, sensor, count(*) AS n FROM detections GROUP BY ALL) GROUP BY fire""")
def _(spark, sf):
    m = D.sensor_count_map(view(spark, sf, "detections"))
    pairs = F.transform(F.array_sort(F.map_entries("dets_by_sensor")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return m.select("fire", F.concat_ws(",", pairs).alias("dets_by_sensor"))


@query("a08_latest_fill_per_tile", cte("abi_pixel") + f", {PIX} " + """SELECT tile_i, tile_j, lat, lon, fill, t, saturated FROM (
  SELECT *, CASE WHEN saturated THEN NULL ELSE fill_fraction END AS fill, row_number() OVER (PARTITION BY tile_i, tile_j ORDER BY t DESC, seq) AS rn FROM (
  SELECT *, granule * 8 + line AS seq, CAST(round_even(lat/(2e0/111.32e0),0) AS BIGINT) AS tile_i,
  CAST(round_even(lon/(2e0/(111.32e0*cos(radians(lat)))),0) AS BIGINT) AS tile_j FROM pix)) WHERE rn = 1""", "lat lon fill t")
def _(spark, sf):
    rows = pixels(spark, sf).withColumn("seq", F.col("granule") * 8 + F.col("line"))
    return D.latest_fill_per_tile(rows)


@query("a18_smoke_direction", cte("abi_pixel") + """ SELECT fire, n, deg - 360e0*floor(deg/360e0) AS bearing FROM (
  SELECT fire, n, degrees(atan2((mlon+121.9e0)*cos(radians(38.1e0)), mlat-38.1e0)) AS deg FROM (
  SELECT granule % 50 AS fire, count(*) AS n, avg(lat) AS mlat, avg(lon) AS mlon FROM abi_pixel WHERE mask % 3 = 1 GROUP BY 1 HAVING count(*) >= 2))""", "bearing")
def _(spark, sf):
    px = view(spark, sf, "abi_pixel").where("mask % 3 = 1").withColumns({"fire": F.col("granule") % 50, "lat0": F.lit(38.1), "lon0": F.lit(-121.9)})
    return D.smoke_direction(px)


@query("a26_first_centroid", cte("detections") + """ SELECT fire, median(lat) AS lat, median(lon) AS lon, min(t) AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY fire ORDER BY t, det_id) AS rn FROM detections) WHERE rn <= 20 GROUP BY fire""", "lat lon t")
def _(spark, sf):
    return D.first_centroid(view(spark, sf, "detections"))


@query("w11_rank_detections_frp", cte("detections") + """ SELECT fire, det_id, frp, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY fire ORDER BY frp DESC, det_id) AS rn FROM detections) WHERE rn <= 15""", "frp")
def _(spark, sf):
    return D.rank_detections_frp(view(spark, sf, "detections"), 15).select("fire", "det_id", "frp", "rank")


@query("w12_latest_age", cte("detections", "fires") + f""" SELECT f.fire, coalesce(greatest(({NOW_S}e0 - m)/3600e0, 0e0), 99e0) AS age_h FROM fires f LEFT JOIN (
  SELECT fire, max(t) AS m FROM detections WHERE sensor = 'VIIRS' GROUP BY fire) d USING (fire)""", "age_h")
def _(spark, sf):
    viirs = view(spark, sf, "detections").where("sensor = 'VIIRS'")
    return D.latest_age(view(spark, sf, "fires"), viirs, NOW_S)


@query("l03_systematic_sample", """SELECT sat, name FROM (SELECT *, row_number() OVER (PARTITION BY sat ORDER BY name) AS rn FROM (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'G18' ELSE 'G19' END AS sat, lpad(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), 14, '0') AS name FROM lineitem))
  WHERE (rn-1) % 2 = 0""")
def _(spark, sf):
    cat = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "G18").otherwise("G19").alias("sat"),
        F.lpad((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string"), 14, "0").alias("name"),
    )
    return D.systematic_sample(cat, "sat", "name", 2, F.substring("name", 1, 11)).select("sat", "name")


@query("s06_granules_in_window", """SELECT name, epoch_us(s)/1e6 AS scan_start, epoch_us(e)/1e6 AS scan_end FROM (
  SELECT 'ABI-L2-FDCC_' || CASE WHEN user_id % 2 = 0 THEN 'G19' ELSE 'G18' END || '_s' || strftime(ts, '%Y%j%H%M%S') || '0_e' || strftime(ts + INTERVAL 300 SECOND, '%Y%j%H%M%S') || '0_c' || event_id AS name,
  date_trunc('second', ts) AS s, date_trunc('second', ts) + INTERVAL 300 SECOND AS e, user_id FROM events)
  WHERE user_id % 2 = 0 AND e >= TIMESTAMP '2024-01-10 00:00:00' AND s <= TIMESTAMP '2024-01-12 00:00:00'""", "scan_start scan_end")
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stamp = lambda c: F.date_format(c, "yyyyDDDHHmmss")
    tag = F.when(F.col("user_id") % 2 == 0, "G19").otherwise("G18")
    name = F.concat(F.lit("ABI-L2-FDCC_"), tag, F.lit("_s"), stamp(F.col("ts")), F.lit("0_e"), stamp(F.col("ts") + F.expr("INTERVAL 300 SECOND")), F.lit("0_c"), F.col("event_id").cast("string"))
    return D.granules_in_window(ev.select(name.alias("name")), "G19", 1704844800.0, 1705017600.0)


@query("j09_interval_overlap", """WITH s AS (SELECT DISTINCT user_id AS fire, CAST(ts AS DATE) AS day FROM events),
  g AS (SELECT DISTINCT CAST(o_orderkey % 2000 AS BIGINT) AS gran, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS d0, DATE '2024-01-01' + CAST(o_orderkey % 30 + o_orderkey % 3 AS INTEGER) AS d1 FROM orders)
  SELECT fire, day, count(*) AS granules FROM s JOIN g ON d0 <= day AND d1 >= day GROUP BY ALL""")
def _(spark, sf):
    from emberline.operators.intervals import overlap_join

    start = F.lit("2024-01-01").cast("date")
    k = F.col("o_orderkey")
    s = table(spark, sf, "events").select(F.col("user_id").alias("fire"), F.to_date("ts").alias("day")).distinct()
    s = s.withColumns({"lo": F.unix_date("day"), "hi": F.unix_date("day")})
    g = table(spark, sf, "orders").select((k % 2000).alias("gran"), F.date_add(start, (k % 30).cast("int")).alias("d0"), F.date_add(start, (k % 30 + k % 3).cast("int")).alias("d1")).distinct()
    g = g.select("gran", F.unix_date("d0").alias("rlo"), F.unix_date("d1").alias("rhi"))
    return overlap_join(s, g, width=4).groupBy("fire", "day").agg(F.count("*").alias("granules"))


CROSS = """c AS (SELECT DISTINCT granule % 60 AS fire, CAST(floor((lon+122e0)*50) AS BIGINT) AS ix, CAST(floor((lat-38e0)*50) AS BIGINT) AS iy, platform FROM abi_pixel WHERE mask IN (10,11,12,13,14,15,30,31,32,33,34,35) AND granule % 60 <> 7),
  k AS (SELECT fire, ix, iy, count(*) AS sats FROM c GROUP BY ALL), b AS (SELECT fire, max(sats) AS best FROM k GROUP BY fire)"""


def cross_cells(spark, sf):
    px = pixels(spark, sf).where("state = 'fire' AND granule % 60 <> 7")
    return px.select((F.col("granule") % 60).alias("fire"), F.floor((F.col("lon") + 122.0) * 50).alias("ix"), F.floor((F.col("lat") - 38.0) * 50).alias("iy"), "platform")


def cross_attempts(spark, sf):
    px = view(spark, sf, "abi_pixel")
    return px.groupBy((F.col("granule") % 60).alias("fire")).agg(
        F.count("*").alias("tried"), F.sum(F.when((F.col("granule") % 60 == 7) | (F.col("line") == 1), 1).otherwise(0)).alias("failed")
    )


@query("g05_dual_sensor_cells", cte("abi_pixel") + f", {CROSS} SELECT k.fire, ix, iy FROM k JOIN b USING (fire) WHERE sats = best")
def _(spark, sf):
    return D.dual_sensor_cross(cross_cells(spark, sf), cross_attempts(spark, sf), ["fire"])[0]


@query("g05_dual_sensor_status", cte("abi_pixel") + f", {CROSS}, a AS (SELECT granule % 60 AS fire, count(*) AS tried, CAST(sum(CASE WHEN granule % 60 = 7 OR line = 1 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM abi_pixel GROUP BY 1), " + """
  n AS (SELECT k.fire, count(*) AS cells FROM k JOIN b USING (fire) WHERE sats = best GROUP BY 1)
  SELECT a.fire, coalesce(cells, 0) AS cells, CASE WHEN cells > 0 THEN 'ok' WHEN failed > 0 AND failed >= tried THEN 'unavailable' ELSE 'no_data' END AS status FROM a LEFT JOIN n USING (fire)""")
def _(spark, sf):
    return D.dual_sensor_cross(cross_cells(spark, sf), cross_attempts(spark, sf), ["fire"])[1]


@query("g12_active_detections", cte("detections") + f""", q AS (SELECT fire, quantile_cont(frp, 0.75) AS p75 FROM detections GROUP BY fire)
  SELECT fire, det_id, p75 FROM detections JOIN q USING (fire) WHERE (frp >= p75 AND p75 > 0) OR (starts_with(sensor,'GOES') AND ({NOW_S}e0 - t)/3600e0 < 0.75e0)""", "p75")
def _(spark, sf):
    return D.active_detections(view(spark, sf, "detections"), NOW_S).select("fire", "det_id", "p75")


# ---- health and history -------------------------------------------------------

SUMMARY = """SELECT source, count(*) AS attempts, count(*) FILTER (status='ok') AS ok, count(*) FILTER (status='no_data') AS no_data,
  count(*) FILTER (status='unavailable') AS unavailable, round(avg(latency_s), 2) AS mean_latency_s,
  arg_max(reason, seq) FILTER (status='unavailable') AS last_error, max(t) FILTER (status='unavailable') AS last_error_t,
  arg_max(record_count, seq) FILTER (record_count IS NOT NULL) AS last_record_count,
  round((count(*) FILTER (status='ok') + count(*) FILTER (status='no_data'))/count(*), 3) AS success_rate
  FROM source_health WHERE t >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY source"""


@query("a09_source_health_summary", cte("source_health") + " " + SUMMARY)
def _(spark, sf):
    return H.source_health_summary(view(spark, sf, "source_health"), F.lit(SINCE).cast("timestamp"))


@query("l05_worst_first", cte("source_health") + f" SELECT source, success_rate, CAST(row_number() OVER (ORDER BY success_rate NULLS FIRST, source) AS BIGINT) AS place FROM ({SUMMARY})")
def _(spark, sf):
    ranked = H.worst_first(H.source_health_summary(view(spark, sf, "source_health"), F.lit(SINCE).cast("timestamp")))
    # One row per source reaches this numbering.
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.asc_nulls_first("success_rate"), "source"))
    return ranked.select("source", "success_rate", place.cast("bigint").alias("place"))


@query("k05_checked_health", cte("source_health") + " SELECT seq, status, coalesce(reason,'') AS reason FROM source_health")
def _(spark, sf):
    return H.checked_health(view(spark, sf, "source_health")).select("seq", "status", "reason")


HIST = """hist AS (SELECT o_orderkey AS seq, o_custkey % 700 AS fire, epoch_us(o_orderdate)/1e6 AS t, o_totalprice/1e1 AS pred_acres, o_totalprice/1e1/(1 + o_orderkey % 12) AS base_acres,
  CASE WHEN o_orderkey % 6 = 0 THEN 'persistence' ELSE 'learned_field' END AS mode FROM orders)"""


def history(spark, sf):
    o = table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 700).alias("fire"), (F.unix_micros("ts") / F.lit(1e6)).alias("t"),
        (F.col("o_totalprice") / 10).alias("pred_acres"), (F.col("o_totalprice") / 10 / (1 + F.col("o_orderkey") % 12)).alias("base_acres"),
        F.when(F.col("o_orderkey") % 6 == 0, "persistence").otherwise("learned_field").alias("mode"),
    )


FEAS = """greatest(pi()*pow(greatest(sqrt(greatest({a},0e0)*4046.86e0/pi()),200e0)+200e0*greatest({m},0e0),2) - greatest({a},0e0)*4046.86e0, 0e0)/4046.86e0"""


@query("w06_cycle_deltas", f"WITH {HIST}, p AS (SELECT *, lag(pred_acres) OVER w AS prev_pred_acres, (t - lag(t) OVER w)/60e0 AS elapsed_min FROM hist WINDOW w AS (PARTITION BY fire ORDER BY t, seq)), " + f"""
  d AS (SELECT fire, seq, prev_pred_acres, elapsed_min, pred_acres - prev_pred_acres AS delta_acres, CASE WHEN elapsed_min > 0 THEN {FEAS.format(a='prev_pred_acres', m='elapsed_min')} END AS feasible_acres FROM p)
  SELECT *, coalesce(delta_acres > feasible_acres*1e6, false) AS physics_alert FROM (SELECT fire, seq, prev_pred_acres, elapsed_min, delta_acres, round(feasible_acres/1e6, 3) AS feasible_acres FROM d)""",
  "prev_pred_acres elapsed_min delta_acres feasible_acres")
def _(spark, sf):
    rows = H.cycle_deltas(history(spark, sf), F.floor(F.col("t") / (90 * 86400)))
    return rows.select("fire", "seq", "prev_pred_acres", "elapsed_min", "delta_acres", F.round(F.col("feasible_acres") / F.lit(1e6), 3).alias("feasible_acres"), "physics_alert")


@query("w07_feasible_growth", f"WITH {HIST} SELECT seq, round({FEAS.format(a='pred_acres', m='CAST(seq % 60 AS DOUBLE)')}, 4) AS feasible FROM hist", "feasible")
def _(spark, sf):
    return history(spark, sf).select("seq", F.round(H.feasible_growth(F.col("pred_acres"), (F.col("seq") % 60).cast("double")), 4).alias("feasible"))


@query("w08_growth_flag", f"WITH {HIST} SELECT seq, pred_acres/greatest(base_acres,1e0) AS growth_ratio, pred_acres/greatest(base_acres,1e0) > 8 AS growth_flag FROM hist", "growth_ratio")
def _(spark, sf):
    return H.growth_flag(history(spark, sf)).select("seq", "growth_ratio", "growth_flag")


@query("a25_conformal_interval", f"WITH {HIST} SELECT seq, CASE WHEN mode <> 'persistence' THEN pred_acres*exp(-0.34e0) END AS lo_acres, CASE WHEN mode <> 'persistence' THEN pred_acres*exp(0.29e0) END AS hi_acres FROM hist", "lo_acres hi_acres")
def _(spark, sf):
    return H.conformal_interval(history(spark, sf)).select("seq", "lo_acres", "hi_acres")


@query("k04_latest_per_fire", f"WITH {HIST} SELECT fire, seq, t, pred_acres, mode FROM (SELECT *, row_number() OVER (PARTITION BY fire ORDER BY t DESC, seq DESC) AS rn FROM hist) WHERE rn = 1", "t pred_acres")
def _(spark, sf):
    return H.latest_per_fire(history(spark, sf)).select("fire", "seq", "t", "pred_acres", "mode")


