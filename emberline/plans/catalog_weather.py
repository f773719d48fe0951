"""Queries over stations, gridded weather, fuel moisture, fire behaviour and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import raster as R
from emberline.operators import weather as W
from emberline.plans.catalog import query
from emberline.plans.fixtures import cte, table, view

# Station readings spelled from orders: one station per customer, hours from the order key.
ASOS = """asos AS (SELECT o_custkey % 900 AS id, o_orderkey AS seq, epoch_us(o_orderdate)/1e6 % 604800 + (o_orderkey % 24)*3600e0 AS t, CAST(o_orderkey % 30 AS DOUBLE) AS sknt,
  CAST(o_orderkey * 47 % 360 AS DOUBLE) AS drct, 40e0 + o_orderkey % 70 AS tmpf, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 20e0 + o_orderkey % 50 END AS dwpf FROM orders)"""


def asos(spark, sf):
    o = table(spark, sf, "orders").withColumn("s", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6))
    return o.selectExpr("o_custkey % 900 AS id", "o_orderkey AS seq", "s % 604800 + (o_orderkey % 24)*3600e0 AS t", "CAST(o_orderkey % 30 AS DOUBLE) AS sknt",
                        "CAST(o_orderkey * 47 % 360 AS DOUBLE) AS drct", "40e0 + o_orderkey % 70 AS tmpf", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 20e0 + o_orderkey % 50 END AS dwpf")


MAGNUS = "exp(17.625e0*(({c}-32)*5/9)/(243.04e0+({c}-32)*5/9))"


@query("x04_wind_components", f"WITH {ASOS} SELECT seq, -sknt*1.15078e0*sin(radians(drct)) AS u, -sknt*1.15078e0*cos(radians(drct)) AS v, CASE WHEN dwpf IS NOT NULL THEN 100e0*{MAGNUS.format(c='dwpf')}/{MAGNUS.format(c='tmpf')} END AS rh FROM asos", "u v rh")
def _(spark, sf):
    return W.station_components(asos(spark, sf)).select("seq", "u", "v", "rh")


@query("j07_asof_nearest_time", f"WITH {ASOS} SELECT id, seq, delta FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delta, seq) AS rn FROM (SELECT *, abs(t - 302400e0) AS delta FROM asos) WHERE delta <= 86400) WHERE rn = 1", "delta")
def _(spark, sf):
    return W.closest_observation(asos(spark, sf), F.lit(302400.0), ["id"], 86400.0).select("id", "seq", "delta")


@query("j08_nearest_hour", cte("weather") + """, targets AS (SELECT o_custkey AS point_id, o_orderkey AS target_id, epoch_us(o_orderdate)/1e6 + 5*3600e0 AS t FROM orders),
  hit AS (SELECT g.target_id, w.seq, w.temp_f, abs(g.t - w.t) AS gap_s, row_number() OVER (PARTITION BY g.target_id ORDER BY abs(g.t - w.t), w.seq) AS rn FROM targets g JOIN weather w USING (point_id) WHERE abs(g.t - w.t) < 7200)
  SELECT g.target_id, h.seq, h.temp_f, h.gap_s FROM targets g LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h USING (target_id)""", "temp_f gap_s")
def _(spark, sf):
    w = view(spark, sf, "weather").select("point_id", "seq", "t", "temp_f").withColumn("sq", F.col("seq"))
    o = table(spark, sf, "orders")
    targets = o.select(F.col("o_custkey").alias("point_id"), F.col("o_orderkey").alias("target_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6) + 18000.0).alias("t"))
    return W.nearest_hour(w, targets, ["point_id"]).select("target_id", F.col("sq").alias("seq"), "temp_f", "gap_s")


@query("f23_within_km", cte("station_obs") + " SELECT id FROM station_obs WHERE sqrt(pow((lat-38.5e0)*111e0,2)+pow((lon+121.5e0)*(111e0*cos(radians(38.5e0))),2)) <= 60")
def _(spark, sf):
    return W.stations_within(view(spark, sf, "station_obs"), (-122.0, 38.0, -121.0, 39.0), 60.0).select("id")


UV = """st AS (SELECT id, lat, lon, temp_f, rh, -spd_mph*sin(radians(dir_deg)) AS u, -spd_mph*cos(radians(dir_deg)) AS v FROM station_obs),
  cells AS (SELECT ident AS cell, lat*1.4e0 - 15.2e0 AS lat, lon FROM airport)"""


def idw_inputs(spark, sf):
    st = view(spark, sf, "station_obs").selectExpr("id", "lat", "lon", "temp_f", "rh", "-spd_mph*sin(radians(dir_deg)) AS u", "-spd_mph*cos(radians(dir_deg)) AS v")
    cells = view(spark, sf, "airport").selectExpr("ident AS cell", "lat*1.4e0 - 15.2e0 AS lat", "lon")
    return cells, st


@query("a11_idw", cte("station_obs", "airport") + f", {UV}" + """, p AS (SELECT c.cell, s.*, 1e0/pow(greatest(sqrt(pow(s.lat-c.lat,2)+pow(s.lon-c.lon,2)),0.001e0),2) AS w FROM cells c JOIN st s ON greatest(sqrt(pow(s.lat-c.lat,2)+pow(s.lon-c.lon,2)),0.001e0) < 1.5e0),
  g AS (SELECT cell, sum(w*u)/sum(w) AS u, sum(w*v)/sum(w) AS v, sum(w*temp_f)/sum(w) AS temp_f, sum(CASE WHEN rh IS NOT NULL THEN w*rh END)/sum(CASE WHEN rh IS NOT NULL THEN w END) AS rh FROM p GROUP BY cell),
  o AS (SELECT c.cell, coalesce(u,0) AS u, coalesce(v,0) AS v, coalesce(g.temp_f, (SELECT avg(temp_f) FROM g)) AS temp_f, coalesce(g.rh, 40e0) AS rh FROM cells c LEFT JOIN g USING (cell))
  SELECT cell, sqrt(u*u+v*v) AS wind_mph, (degrees(atan2(u,v))+180) - 360*floor((degrees(atan2(u,v))+180)/360) AS wind_from, temp_f, rh FROM o""", "wind_mph wind_from temp_f rh")
def _(spark, sf):
    cells, st = idw_inputs(spark, sf)
    return W.idw(cells, st, ["cell"]).select("cell", "wind_mph", "wind_from", "temp_f", "rh")


EMC = "greatest(least(1.03e0*(CASE WHEN {h} < 10 THEN 0.03229e0+0.281073e0*{h}-0.000578e0*{h}*{t} WHEN {h} < 50 THEN 2.22749e0+0.160107e0*{h}-0.014784e0*{t} ELSE 21.0606e0+0.005565e0*{h}*{h}-0.00035e0*{h}*{t}-0.483199e0*{h} END),35e0),1e0)/100e0"


@query("x03_moisture_columns", cte("weather") + f" SELECT seq, fm_1h, least(fm_1h+0.01e0,0.4e0) AS fm_10h, least(fm_1h+0.03e0,0.4e0) AS fm_100h, vpd_kpa FROM (SELECT seq, {EMC.format(h='rh', t='temp_f')} AS fm_1h, greatest(0.6108e0*exp(17.27e0*((temp_f-32)*5/9)/((temp_f-32)*5/9+237.3e0))*(1-rh/100e0),0) AS vpd_kpa FROM weather)", "fm_1h fm_10h fm_100h vpd_kpa")
def _(spark, sf):
    return W.moisture_columns(view(spark, sf, "weather")).select("seq", "fm_1h", "fm_10h", "fm_100h", "vpd_kpa")


KBDI_SQL = """daily AS (SELECT point_id % 40 AS p, CAST(floor(t/86400) AS BIGINT) AS day, max(temp_f) AS t_max, sum(precip) AS rain FROM weather GROUP BY 1, 2),
  series AS (SELECT p, list({'t': t_max, 'r': rain} ORDER BY day) AS s FROM daily GROUP BY p),
  idx AS (SELECT p, list_reduce(list_prepend({'t': 400e0, 'r': 0e0}, s), lambda a, d: {'t':
    least(800e0, greatest(0e0, a.t - (CASE WHEN d.r > 0 AND a.r + d.r > 0.2e0 THEN least(greatest(a.r + d.r - 0.2e0, 0e0), d.r) ELSE 0e0 END)*100e0)
    + CASE WHEN d.t > 50 THEN greatest(0e0, (800e0 - greatest(0e0, a.t - (CASE WHEN d.r > 0 AND a.r + d.r > 0.2e0 THEN least(greatest(a.r + d.r - 0.2e0, 0e0), d.r) ELSE 0e0 END)*100e0))*(0.968e0*exp(0.0486e0*d.t)-8.30e0)/(1e0+10.88e0*exp(-0.0441e0*25e0))*1e-3) ELSE 0e0 END),
    'r': CASE WHEN d.r > 0 THEN a.r + d.r ELSE 0e0 END}) AS k FROM series)"""


@query("w10_kbdi", cte("weather") + f", {KBDI_SQL} SELECT p, k.t AS kbdi FROM idx", "kbdi")
def _(spark, sf):
    w = view(spark, sf, "weather").withColumn("p", F.col("point_id") % 40)
    return W.kbdi(W.daily_extremes(w, ["p"]), ["p"])


@query("a21_daily_noon_reading", cte("weather") + """ SELECT p, day, seq, temp_f FROM (SELECT *, row_number() OVER (PARTITION BY p, day ORDER BY off, t, seq) AS rn FROM (
  SELECT point_id % 40 AS p, CAST(floor(t/86400) AS BIGINT) AS day, abs(floor((t - floor(t/86400)*86400)/3600) - 12) AS off, t, seq, temp_f FROM weather)) WHERE rn = 1""", "temp_f")
def _(spark, sf):
    w = view(spark, sf, "weather").select((F.col("point_id") % 40).alias("p"), "t", "seq", "temp_f")
    return W.daily_noon_reading(w, ["p"]).select("p", "day", "seq", "temp_f")


@query("x07_danger_class", cte("weather") + """ SELECT seq, danger_score, ['low','moderate','high','extreme'][least(danger_score // 2, 3) + 1] AS danger FROM (
  SELECT seq, CAST((temp_f > 90)::INT + (temp_f > 100)::INT + (rh < 25)::INT + (rh < 15)::INT + (ws > 20)::INT + (ws > 35)::INT AS INTEGER) AS danger_score FROM weather)""")
def _(spark, sf):
    return W.danger_class(view(spark, sf, "weather")).select("seq", "danger_score", "danger")


FUELS_SQL = "fuels(code,load_1h,load_herb,sav,depth,mx) AS (VALUES " + ",".join("(" + ",".join([str(r[0])] + [f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in r[1:]]) + ")" for r in [(c, *map(float, v)) for c, *v in W.FUELS]) + ")"


@query("j15_fuel_params", cte("raster") + f", {FUELS_SQL} SELECT cell, load_1h, sav, mx FROM raster LEFT JOIN fuels ON fuel + (cell % 3) * 20 = code", "load_1h sav mx")
def _(spark, sf):
    cells = view(spark, sf, "raster").withColumn("fuel", (F.col("fuel") + (F.col("cell") % 3) * 20).cast("int"))
    return W.fuel_params(cells).select("cell", "load_1h", "sav", "mx")


BEHAVE_IN = """r0 AS (SELECT o_orderkey AS seq, o_custkey % 50 AS fire, [101,122,145,165,185,202,91,98,93,108][o_orderkey % 10 + 1] AS fuel, 0.03e0 + (o_orderkey % 20)/100e0 AS fm_1h,
  CAST(o_orderkey * 7 % 40 AS DOUBLE) AS wind_mph, CAST(o_orderkey * 47 % 360 AS DOUBLE) AS wind_to, CAST(o_orderkey % 35 AS DOUBLE) AS slope_deg, CAST(o_orderkey * 13 % 360 AS DOUBLE) AS aspect_deg, CAST(o_orderkey % 90 AS DOUBLE) AS canopy_pct FROM orders)"""
BEHAVE = f"""{BEHAVE_IN}, {FUELS_SQL},
  r1 AS (SELECT r0.*, sav, depth, mx, (load_1h + 0.667e0*load_herb)*0.0459137e0 AS w0 FROM r0 LEFT JOIN fuels ON fuel = code),
  r2 AS (SELECT *, w0/depth/32e0 AS beta, least(greatest(fm_1h,0.01e0), mx/100e0*0.99e0) AS mf FROM r1),
  r3 AS (SELECT *, beta/(3.348e0*pow(sav,-0.8189e0)) AS ratio, 133e0*pow(sav,-0.7913e0) AS a, mf/(mx/100e0) AS rm FROM r2),
  r4 AS (SELECT *, pow(sav,1.5e0)/(495e0+0.0594e0*pow(sav,1.5e0))*pow(ratio,a)*exp(a*(1-ratio))*w0*(1-0.0555e0)*8000e0*greatest(0.05e0,1-2.59e0*rm+5.11e0*rm*rm-3.52e0*rm*rm*rm)*0.42e0 AS ir FROM r3),
  r5 AS (SELECT *, ir*exp((0.792e0+0.681e0*sqrt(sav))*(beta+0.1e0))/(192e0+0.2595e0*sav)/(w0/depth*exp(-138e0/sav)*(250e0+1116e0*mf)) AS r0_ft, 1.83e0/ln((20e0+0.36e0*greatest(depth,0.1e0))/(0.13e0*greatest(depth,0.1e0))) AS unsh, least(greatest(canopy_pct/100e0,0e0),1e0) AS cov,
   7.47e0*exp(-0.133e0*pow(sav,0.55e0)) AS cc, 0.02526e0*pow(sav,0.54e0) AS bb, 0.715e0*exp(-3.59e-4*sav) AS ee FROM r4),
  r6 AS (SELECT *, least(greatest(wind_mph,0)*(CASE WHEN cov < 0.05e0 THEN unsh ELSE unsh*(1-cov)+0.12e0*cov END)*88e0, 0.9e0*ir) AS u_mid FROM r5),
  r7 AS (SELECT *, CASE WHEN u_mid > 0 THEN cc*pow(u_mid,bb)*pow(ratio,-ee) ELSE 0 END AS pw, 5.275e0*pow(beta,-0.3e0)*pow(tan(radians(slope_deg)),2) AS ps FROM r6),
  r8 AS (SELECT *, pw*sin(radians(wind_to))+ps*sin(radians(aspect_deg+180)) AS vx, pw*cos(radians(wind_to))+ps*cos(radians(aspect_deg+180)) AS vy FROM r7),
  r9 AS (SELECT *, sqrt(vx*vx+vy*vy) AS pe FROM r8),
  r10 AS (SELECT *, CASE WHEN w0 IS NULL THEN NULL WHEN pe > 1e-9 THEN degrees(atan2(vx,vy)) - 360*floor(degrees(atan2(vx,vy))/360) ELSE wind_to END AS theta, r0_ft*(1+pe) AS head_ft,
   least((CASE WHEN pe > 0 AND cc > 0 THEN pow(pe*pow(ratio,ee)/cc,1/bb) ELSE 0 END)/88e0,60e0)*0.44704e0 AS u_ms FROM r9),
  r11 AS (SELECT *, CASE WHEN w0 IS NOT NULL THEN least(greatest(0.936e0*exp(0.2566e0*u_ms)+0.461e0*exp(-0.1548e0*u_ms)-0.397e0,1e0),8e0) END AS lb FROM r10),
  b AS (SELECT *, sqrt(1-1/(lb*lb)) AS ecc, head_ft*0.3048e0 AS ros, ir*head_ft*(384e0/sav)/60e0 AS byram FROM r11)"""


def behave_rows(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "o_custkey % 50 AS fire", "element_at(array(101,122,145,165,185,202,91,98,93,108), CAST(o_orderkey % 10 + 1 AS INT)) AS fuel", "0.03e0 + (o_orderkey % 20)/100e0 AS fm_1h",
        "CAST(o_orderkey * 7 % 40 AS DOUBLE) AS wind_mph", "CAST(o_orderkey * 47 % 360 AS DOUBLE) AS wind_to", "CAST(o_orderkey % 35 AS DOUBLE) AS slope_deg", "CAST(o_orderkey * 13 % 360 AS DOUBLE) AS aspect_deg", "CAST(o_orderkey % 90 AS DOUBLE) AS canopy_pct")


@query("x05_fire_behavior", f"WITH {BEHAVE} SELECT seq, ros AS ros_head_m_min, theta AS theta_head_deg, lb, ros*(1-ecc)/(1+ecc) AS ros_back_m_min, round(byram*3.4613e0,3) AS intensity_kw_m, CASE WHEN byram IS NOT NULL THEN 0.45e0*pow(greatest(byram,0),0.46e0)*0.3048e0 END AS flame_len_m FROM b",
       "ros_head_m_min theta_head_deg lb ros_back_m_min intensity_kw_m flame_len_m")
def _(spark, sf):
    b = W.fire_behavior(behave_rows(spark, sf))
    return b.select("seq", "ros_head_m_min", "theta_head_deg", "lb", "ros_back_m_min", F.round("intensity_kw_m", 3).alias("intensity_kw_m"), "flame_len_m")


@query("x05_behavior_by_hour", f"WITH {BEHAVE} SELECT fire, max(ros) AS max_ros, avg(ros) AS mean_ros, max(0.45e0*pow(greatest(byram,0),0.46e0)*0.3048e0) AS max_flame_m, count(ros) AS burnable FROM b GROUP BY fire", "max_ros mean_ros max_flame_m")
def _(spark, sf):
    return W.behavior_by_hour(W.fire_behavior(behave_rows(spark, sf)), ["fire"])


@query("x06_spread_reach", f"WITH {BEHAVE} " + """SELECT seq, round(ea,4) AS ellipse_a, round(CASE WHEN ea IS NOT NULL THEN greatest(ea/lb,0.5e0) END,4) AS ellipse_b, round(ea-bk,4) AS ellipse_c, round(CASE WHEN byram IS NULL THEN NULL WHEN byram > 0 AND wind_mph > 0 THEN least(0.077e0*pow(wind_mph*0.44704e0,0.6e0)*pow(byram*3.4613e0/1000e0,0.3e0),3e0)*1000e0 ELSE 0 END,4) AS spot_m FROM (
  SELECT *, (ros*30 + ros*(1-ecc)/(1+ecc)*30)/2 AS ea, ros*(1-ecc)/(1+ecc)*30 AS bk FROM b)""", "ellipse_a ellipse_b ellipse_c spot_m")
def _(spark, sf):
    out = W.spread_reach(W.fire_behavior(behave_rows(spark, sf)), 30.0)
    return out.select("seq", *[F.round(c, 4).alias(c) for c in ("ellipse_a", "ellipse_b", "ellipse_c", "spot_m")])


@query("a12_fuel_moisture", cte("airport", "station_obs") + f""", cells AS (SELECT ident AS cell, lat*2.2e0 - 45.6e0 AS lat, lon, CAST(ident % 800 AS DOUBLE) AS kbdi, CASE WHEN ident % 3 = 0 THEN NULL ELSE (ident % 21)/10e0 - 1e0 END AS ndmi FROM airport),
  s AS (SELECT lat, lon, CASE WHEN id % 2 = 0 THEN (4 + id % 20)/100e0 WHEN rh IS NOT NULL THEN {EMC.format(h='rh', t='temp_f')} END AS s_fm FROM station_obs),
  n AS (SELECT c.cell, sum(w*s_fm)/sum(w) AS st FROM (SELECT c.cell, s.s_fm, sqrt(pow((c.lat-s.lat)*111e0,2)+pow((c.lon-s.lon)*(111e0*cos(radians(s.lat))),2)) AS d, 1/pow(greatest(d,0.5e0),2) AS w FROM cells c, s WHERE s_fm IS NOT NULL) c WHERE d < 75 GROUP BY c.cell),
  bl AS (SELECT *, 0.04e0+(1-least(greatest(kbdi,0),800)/800e0)*0.21e0 AS base, greatest(least(0.03e0+(ndmi+1)/2*0.25e0,0.35e0),0.02e0) AS nd FROM cells)
  SELECT cell, greatest(least(coalesce(st, CASE WHEN ndmi IS NOT NULL THEN 0.5e0*base+0.5e0*nd ELSE base END),0.35e0),0.02e0) AS fm_1h, CASE WHEN st IS NOT NULL THEN 'raws' WHEN ndmi IS NOT NULL THEN 'kbdi+ndmi' ELSE 'kbdi' END AS fm_source FROM bl LEFT JOIN n USING (cell)""", "fm_1h")
def _(spark, sf):
    cells = view(spark, sf, "airport").selectExpr("ident AS cell", "lat*2.2e0 - 45.6e0 AS lat", "lon", "CAST(ident % 800 AS DOUBLE) AS kbdi", "CASE WHEN ident % 3 = 0 THEN NULL ELSE (ident % 21)/10e0 - 1e0 END AS ndmi")
    raws = view(spark, sf, "station_obs").selectExpr("lat", "lon", "temp_f", "rh", "CASE WHEN id % 2 = 0 THEN CAST(4 + id % 20 AS DOUBLE) END AS fuel_moisture_pct")
    return W.fuel_moisture(cells, raws, ["cell"]).select("cell", "fm_1h", "fm_source")


@query("s13_gridded_analysis", """WITH g AS (SELECT s_suppkey AS id, 230e0 + s_suppkey % 40 AS lon, CAST(s_suppkey % 13 AS DOUBLE) - 6 AS u, CAST(s_suppkey % 17 AS DOUBLE) - 8 AS v, 280e0 + s_suppkey % 30 AS tmp, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 270e0 + s_suppkey % 20 END AS dpt,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 15 AS DOUBLE) END AS gust, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 > 0 THEN CAST(s_suppkey % 130 AS DOUBLE) END AS rh, CASE WHEN s_suppkey % 2 = 0 THEN 'hrrr' ELSE 'rtma' END AS kind FROM supplier),
  k AS (SELECT *, tmp - 273.15e0 AS tc, coalesce(dpt, tmp-10) - 273.15e0 AS dc FROM g)
  SELECT id, CASE WHEN lon > 180 THEN lon-360 ELSE lon END AS lon, sqrt(u*u+v*v)*2.23694e0 AS wind_mph, degrees(atan2(-u,-v)) - 360*floor(degrees(atan2(-u,-v))/360) AS wind_from, coalesce(gust, sqrt(u*u+v*v)*1.4e0)*2.23694e0 AS gust_mph, tc*9/5+32 AS temp_f,
  greatest(least(coalesce(rh, CASE WHEN kind='rtma' THEN 100e0*exp(17.67e0*dc/(dc+243.5e0))/exp(17.67e0*tc/(tc+243.5e0)) END, 40e0),100e0),1e0) AS rh FROM k""", "lon wind_mph wind_from gust_mph temp_f rh")
def _(spark, sf):
    g = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS id", "230e0 + s_suppkey % 40 AS lon", "CAST(s_suppkey % 13 AS DOUBLE) - 6 AS u", "CAST(s_suppkey % 17 AS DOUBLE) - 8 AS v", "280e0 + s_suppkey % 30 AS tmp",
        "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 270e0 + s_suppkey % 20 END AS dpt", "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 15 AS DOUBLE) END AS gust",
        "CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 > 0 THEN CAST(s_suppkey % 130 AS DOUBLE) END AS rh", "CASE WHEN s_suppkey % 2 = 0 THEN 'hrrr' ELSE 'rtma' END AS kind")
    return W.gridded_analysis(g).select("id", "lon", "wind_mph", "wind_from", "gust_mph", "temp_f", "rh")


@query("e03_wind_direction_evidence", cte("weather") + """ SELECT seq, 'direction' AS kind, CASE WHEN wd IS NOT NULL THEN 'ok' ELSE 'unavailable' END AS status, (wd+180) - 360*floor((wd+180)/360) AS bearing FROM (
  SELECT seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE wd END AS wd FROM weather)""", "bearing")
def _(spark, sf):
    w = view(spark, sf, "weather").withColumn("wd", F.when(F.col("seq") % 9 != 0, F.col("wd")))
    return W.wind_direction_evidence(w).select("seq", "kind", "status", "bearing")


# ---- rasters ---------------------------------------------------------------------

DEM = "dem AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, elev AS value FROM raster)"


def dem(spark, sf):
    return view(spark, sf, "raster").select(F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("col"), F.col("elev").alias("value"))


GRAD = """nb AS (SELECT a.row, a.col, a.value, u.value AS up, d.value AS down, l.value AS lf, r.value AS rt FROM {src} a LEFT JOIN {src} u ON u.row=a.row-1 AND u.col=a.col LEFT JOIN {src} d ON d.row=a.row+1 AND d.col=a.col
  LEFT JOIN {src} l ON l.row=a.row AND l.col=a.col-1 LEFT JOIN {src} r ON r.row=a.row AND r.col=a.col+1),
  gr AS (SELECT row, col, value, coalesce((rt-lf)/(2*{x}), (rt-value)/{x}, (value-lf)/{x}, 0) AS dx, coalesce((down-up)/(2*{y}), (down-value)/{y}, (value-up)/{y}, 0) AS dr FROM nb)"""


@query("r04_slope_aspect", cte("raster") + f", {DEM}, {GRAD.format(src='dem', x='25e0', y='30e0')} " + "SELECT row, col, degrees(atan(sqrt(dx*dx+dr*dr))) AS slope_deg, degrees(atan2(-dx,dr))+360 - 360*floor((degrees(atan2(-dx,dr))+360)/360) AS aspect_deg FROM gr", "slope_deg aspect_deg")
def _(spark, sf):
    return R.slope_aspect(dem(spark, sf), [], 25.0, 30.0).select("row", "col", "slope_deg", "aspect_deg")


@query("r05_tpi", cte("raster") + f", {DEM}, " + """m AS (SELECT max(row) AS mr, max(col) AS mc FROM dem), f AS (SELECT d.row, d.col, d.value, avg(n.value) AS mean FROM dem d, m, range(-2,3) a(i), range(-2,3) b(j) JOIN dem n ON n.row = greatest(0, least(mr, d.row + i)) AND n.col = greatest(0, least(mc, d.col + j)) GROUP BY d.row, d.col, d.value)
  SELECT row, col, value - mean AS tpi FROM f""", "tpi")
def _(spark, sf):
    return R.tpi(dem(spark, sf), [], 2)


@query("r06_curvature", cte("raster") + f", {DEM}, {GRAD.format(src='dem', x='25e0', y='30e0')}, " + """sx AS (SELECT a.row, a.col, coalesce((r.dx-l.dx)/50e0,(r.dx-a.dx)/25e0,(a.dx-l.dx)/25e0,0) AS zxx FROM gr a LEFT JOIN gr l ON l.row=a.row AND l.col=a.col-1 LEFT JOIN gr r ON r.row=a.row AND r.col=a.col+1),
  sy AS (SELECT a.row, a.col, coalesce((d.dr-u.dr)/60e0,(d.dr-a.dr)/30e0,(a.dr-u.dr)/30e0,0) AS zyy FROM gr a LEFT JOIN gr u ON u.row=a.row-1 AND u.col=a.col LEFT JOIN gr d ON d.row=a.row+1 AND d.col=a.col)
  SELECT row, col, zxx + zyy AS curvature FROM sx JOIN sy USING (row, col)""", "curvature")
def _(spark, sf):
    return R.curvature(dem(spark, sf), [], 25.0, 30.0)


SAMPLE = "pts AS (SELECT det_id, lat - 38e0 - (fire % 50)*0.05e0 AS lat, lon + 122e0 - (fire % 40)*0.05e0 AS lon FROM detections)"


def unit_points(spark, sf):
    return view(spark, sf, "detections").selectExpr("det_id", "lat - 38e0 - (fire % 50)*0.05e0 AS lat", "lon + 122e0 - (fire % 40)*0.05e0 AS lon")


@query("j13_cell_sample", cte("raster", "detections") + f", {DEM}, {SAMPLE} SELECT det_id, value FROM (SELECT det_id, CAST(floor((lon-0.00005e0)/0.001e0) AS INTEGER) AS col, CAST(floor((0.03e0-lat+0.00005e0)/0.001e0) AS INTEGER) AS row FROM pts) LEFT JOIN dem USING (row, col)", "value")
def _(spark, sf):
    return R.cell_sample(unit_points(spark, sf), dem(spark, sf), 0.00005, 0.03005, 0.001, 0.001, 4, 50).select("det_id", "value")


@query("j14_bilinear_sample", cte("raster", "detections") + f", {DEM}, {SAMPLE}, " + """w AS (SELECT det_id, lat/0.04e0*3 AS fi, lon/0.04e0*49 AS fj, greatest(0, least(2, CAST(trunc(lat/0.04e0*3) AS INTEGER))) AS i0, greatest(0, least(48, CAST(trunc(lon/0.04e0*49) AS INTEGER))) AS j0 FROM pts)
  SELECT det_id, a.value*(1-(fi-i0))*(1-(fj-j0)) + b.value*(1-(fi-i0))*(fj-j0) + c.value*(fi-i0)*(1-(fj-j0)) + d.value*(fi-i0)*(fj-j0) AS value FROM w JOIN dem a ON a.row=i0 AND a.col=j0 JOIN dem b ON b.row=i0 AND b.col=j0+1 JOIN dem c ON c.row=i0+1 AND c.col=j0 JOIN dem d ON d.row=i0+1 AND d.col=j0+1""", "value")
def _(spark, sf):
    return R.bilinear_sample(unit_points(spark, sf), dem(spark, sf), 0.0, 0.0, 0.04, 0.04, 4, 50, ["det_id"])


@query("a13_resample_average", cte("raster") + f", {DEM} SELECT row // 3 AS row, col // 3 AS col, avg(value) AS value FROM dem GROUP BY 1, 2", "value")
def _(spark, sf):
    return R.resample(dem(spark, sf), 3, "average")


FUELC = "fc AS (SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, fuel AS value FROM raster)"


def fuel_cells(spark, sf):
    return view(spark, sf, "raster").select(F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("col"), F.col("fuel").alias("value"))


@query("a13_resample_majority", cte("raster") + f", {FUELC} SELECT row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) AS rn FROM (SELECT row // 3 AS row, col // 3 AS col, value, count(*) AS n FROM fc GROUP BY ALL)) WHERE rn = 1")
def _(spark, sf):
    return R.resample(fuel_cells(spark, sf), 3, "majority")


@query("a13_resample_nearest", cte("raster") + f", {FUELC} SELECT row // 3 AS row, col // 3 AS col, value FROM fc WHERE row % 3 = 1 AND col % 3 = 1")
def _(spark, sf):
    return R.resample(fuel_cells(spark, sf), 3, "nearest")


TILES = "tiles AS (SELECT l_partkey // 50 AS row, l_partkey % 50 AS col, l_orderkey * 8 + l_linenumber AS tile_order, CASE WHEN l_orderkey % 4 = 0 OR l_partkey % 9 = 0 THEN NULL ELSE l_quantity END AS value FROM lineitem)"


def tiles(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_partkey DIV 50 AS row", "l_partkey % 50 AS col", "l_orderkey * 8 + l_linenumber AS tile_order", "CASE WHEN l_orderkey % 4 = 0 OR l_partkey % 9 = 0 THEN NULL ELSE l_quantity END AS value")


@query("a14_mosaic_last", f"WITH {TILES}, m AS (SELECT row, col, arg_max(value, tile_order) FILTER (value IS NOT NULL) AS value FROM tiles GROUP BY ALL) SELECT row, col, coalesce(value, (SELECT avg(value) FROM m), 0) AS value FROM m", "value")
def _(spark, sf):
    return R.mosaic(tiles(spark, sf), [], "last")


@query("a14_mosaic_first", f"WITH {TILES}, m AS (SELECT row, col, arg_min(value, tile_order) FILTER (value IS NOT NULL) AS value FROM tiles GROUP BY ALL) SELECT row, col, coalesce(value, (SELECT avg(value) FROM m), 0) AS value FROM m", "value")
def _(spark, sf):
    return R.mosaic(tiles(spark, sf), [], "first")


@query("a15_newest_tile_per_key", """WITH c AS (SELECT 'https://host/dem/USGS_13_n' || (o_custkey % 90) || 'w' || (o_custkey % 70) || '_' || strftime(o_orderdate, '%Y%m%d') || '.tif' AS url FROM orders)
  SELECT tile_key, max(fname) AS fname FROM (SELECT regexp_replace(split_part(url,'/',5), '_[^_]*$', '') AS tile_key, split_part(url,'/',5) AS fname FROM c) GROUP BY tile_key""")
def _(spark, sf):
    url = F.concat(F.lit("https://host/dem/USGS_13_n"), (F.col("o_custkey") % 90).cast("string"), F.lit("w"), (F.col("o_custkey") % 70).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".tif"))
    return R.newest_tile_per_key(table(spark, sf, "orders").select(url.alias("url"))).select("tile_key", "fname")


@query("s26_read_raster_rules", cte("raster") + " SELECT cell, CASE WHEN v >= -1000 THEN v END AS dem, least(greatest(v/10,0),100) AS canopy, least(greatest(v/20,0),50) AS cbd FROM (SELECT cell, elev*20 - 3000e0 AS v FROM raster)", "dem canopy cbd")
def _(spark, sf):
    v = view(spark, sf, "raster").select("cell", (F.col("elev") * 20 - 3000.0).alias("v"))
    out = R.clean_layer(v.withColumn("value", F.col("v")), "dem").withColumnRenamed("value", "dem")
    out = R.clean_layer(out.withColumn("value", F.col("v") / 10), "canopy").withColumnRenamed("value", "canopy")
    return R.clean_layer(out.withColumn("value", F.col("v") / 20), "cbd").withColumnRenamed("value", "cbd").drop("v")


@query("g01_make_grid", cte("fires") + """, b AS (SELECT fire, lon0 - 0.01e0 AS west, lat0 - 0.01e0 AS south, lon0 + 0.01e0 AS east, lat0 + 0.01e0 AS north, 200e0/111320e0 AS dlat, 200e0/(111320e0*cos(radians(((lat0-0.01e0)+(lat0+0.01e0))/2))) AS dlon FROM fires)
  SELECT fire, CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, north - i*dlat AS lat, west + j*dlon AS lon FROM b, range(0, 40) r(i), range(0, 40) c(j) WHERE i < ceil((north-south)/dlat) AND j < ceil((east-west)/dlon)""", "lat lon")
def _(spark, sf):
    boxes = view(spark, sf, "fires").selectExpr("fire", "lon0 - 0.01e0 AS west", "lat0 - 0.01e0 AS south", "lon0 + 0.01e0 AS east", "lat0 + 0.01e0 AS north")
    return R.make_grid(boxes, 200.0, ["fire"])
