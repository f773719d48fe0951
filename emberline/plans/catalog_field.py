"""Queries over the learned field: grid, features, labels, model and perimeter."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from emberline.operators import boosting as B
from emberline.operators import cells as C
from emberline.operators import detections as D
from emberline.operators import field as M
from emberline.operators import perimeters as P
from emberline.operators import spatial as S
from emberline.plans.catalog import query
from emberline.plans.catalog_observations import JUDGED, NOW_S, RAW_DETS, kept_detections
from emberline.plans.fixtures import cte, square_edges, view
from emberline.session import by_shuffle, checkpoint_root, cut_lineage
from emberline.sources.sinks import read_snapshot, write_snapshot

START_T, CUTOFF_T = 1704067200.0, 1706140800.0
PER_CELL = 250.0**2 / 4046.86


_MADE: dict = {}


def data_state(spark, sf) -> tuple:
    """What lies in a data folder now: names, sizes and times, through whatever file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def made(spark, sf, what, build):
    """Tables several queries start from are written once per session and state of the data folder."""
    key = (spark.sparkContext.applicationId, sf, data_state(spark, sf), what)
    if key not in _MADE:
        _MADE[key] = build()
    return _MADE[key]


def forget() -> None:
    """Drop the shared tables, so that a timed query pays for its own inputs."""
    _MADE.clear()


def inputs(spark, sf):
    return made(spark, sf, "inputs", lambda: build_inputs(spark, sf))


def build_inputs(spark, sf):
    """Step tables built from the driver data: one step per fire."""
    dets = kept_detections(spark, sf).withColumns({"step": F.lit(0), "t": F.unix_micros("acq") / F.lit(1e6)})
    fires = view(spark, sf, "fires")
    steps = fires.select("fire", F.lit(0).alias("step")).withColumns({"start_t": F.lit(START_T), "cutoff_t": F.lit(CUTOFF_T)})
    base = square_edges(fires).withColumn("step", F.lit(0))
    target = square_edges(fires, "target").withColumn("step", F.lit(0))
    # One row per step; and the accepted detections. Every later join starts from these.
    frame = cut_lineage(M.step_frames(base, steps))
    local = cut_lineage(M.local_detections(dets, frame))
    grid = cut_lineage(M.grid_frames(frame, local))
    return SimpleNamespace(dets=dets, steps=steps, frame=frame, local=local, grid=grid, base=M.edges_km(base, frame), target=M.edges_km(target, frame))


def cells(i):
    if not hasattr(i, "cells"):
        i.cells = cut_lineage(M.prediction_cells(i.grid, i.base))
    return by_shuffle(i.cells)


def sites(i):
    if not hasattr(i, "sites"):
        i.sites = cut_lineage(M.sites(i.local))
    return by_shuffle(i.sites)


FRAME = cte("detections", "fires") + f""", {RAW_DETS}, {JUDGED},
  kept AS (SELECT * FROM (SELECT det_id, fire, t, lon, lat, coalesce(frp,0) AS frp, sensor, row_number() OVER (PARTITION BY round_even(lat,4), round_even(lon,4), acq ORDER BY det_id) AS rn FROM judged WHERE reject_reason IS NULL) WHERE rn = 1),
  f AS (SELECT fire, lon0, lat0, kl, 0.02e0*0.02e0*kl*111.32e0 AS area, greatest(sqrt(0.02e0*0.02e0*kl*111.32e0/pi()),0.1e0) AS base_r, 0.01e0*kl AS hx, 0.01e0*111.32e0 AS hy FROM (SELECT fire, lon0, lat0, 111.32e0*cos(radians(lat0)) AS kl FROM fires)),
  d AS (SELECT k.fire, det_id, (lon-lon0)*kl AS x, (lat-lat0)*111.32e0 AS y, frp, (t-{START_T}e0)/{CUTOFF_T - START_T}e0 AS tau, (sensor='VIIRS')::INT AS v FROM kept k JOIN f USING (fire)),
  g AS (SELECT fire, least(-hx, x0)-2 AS x0, greatest(hx, x1)+2 AS x1, least(-hy, y0)-2 AS y0, greatest(hy, y1)+2 AS y1, n_dets FROM f JOIN (SELECT fire, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n_dets FROM d GROUP BY fire) USING (fire)),
  gg AS (SELECT *, 0.25e0 AS gk, CAST(trunc((x1-x0)/0.25e0) AS BIGINT) AS nx, CAST(trunc((y1-y0)/0.25e0) AS BIGINT) AS ny FROM g),
  lat AS (SELECT fire, ix, iy, x0+(ix+0.5e0)*gk AS x, y0+(iy+0.5e0)*gk AS y FROM gg, LATERAL (SELECT unnest(range(0, nx)) AS ix), LATERAL (SELECT unnest(range(0, ny)) AS iy)),
  c AS (SELECT l.* FROM lat l JOIN f USING (fire) WHERE NOT (abs(x) < hx AND abs(y) < hy)),
  pr AS (SELECT c.fire, c.ix, c.iy, c.x, c.y, d.det_id, d.x AS qx, d.y AS qy, d.frp, d.tau, d.v, sqrt((d.x-c.x)*(d.x-c.x)+(d.y-c.y)*(d.y-c.y)) AS dd FROM c JOIN d USING (fire))"""
RADII = ", ".join(
    f"count(*) FILTER (dd<={r})*1e0 AS n{r}, coalesce(max(frp) FILTER (dd<={r}),0) AS frpmax{r}, coalesce(sum(frp) FILTER (dd<={r}),0) AS frpsum{r}, coalesce(max(tau) FILTER (dd<={r}),0) AS tmax{r}, coalesce(sum(v) FILTER (dd<={r}),0)*1e0 AS viirs{r}"
    for r in (1, 2, 3, 5)
)
TURNS = ", ".join(
    f"CASE WHEN count(*) FILTER (dd<={r}) = 0 THEN 0 WHEN count(*) FILTER (dd<={r} AND dd>1e-8) = 0 THEN 1 ELSE 1-sqrt(pow(avg((qx-x)/dd) FILTER (dd<={r} AND dd>1e-8),2)+pow(avg((qy-y)/dd) FILTER (dd<={r} AND dd>1e-8),2)) END AS {n}"
    for n, r in M.TURN_RADII
)
AGG = f"ag AS (SELECT fire, ix, iy, {RADII}, {TURNS}, coalesce(min(tau) FILTER (dd<=2),1) AS t_first2, arg_min({{'id':det_id,'d':dd,'x':qx,'y':qy,'f':frp,'t':tau}}, (dd, det_id)) AS q FROM pr GROUP BY fire, ix, iy)"
CHEAP_AGG = "ag AS (SELECT fire, ix, iy, count(*) FILTER (dd<=2)*1e0 AS n2, count(*) FILTER (dd<=5)*1e0 AS n5, min(dd) AS d_near FROM pr GROUP BY fire, ix, iy)"


@query("g02_prediction_cells", FRAME + " SELECT fire, ix, iy, x, y FROM c", "x y")
def _(spark, sf):
    return cells(inputs(spark, sf)).select("fire", F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"), "x", "y")


@query("g02_adaptive_grid", FRAME + """, a AS (SELECT fire, list_reduce(list_prepend(0.25e0, list_transform(range(1,65), lambda z: z*1e0)), lambda s, z: CASE WHEN greatest(trunc((x1-x0)/s),1)*greatest(trunc((y1-y0)/s),1) > 200 THEN s*1.4e0 ELSE s END) AS grid_km, x0, x1, y0, y1 FROM gg)
  SELECT fire, grid_km, CAST(greatest(trunc((x1-x0)/grid_km),1) AS BIGINT) AS nx, CAST(greatest(trunc((y1-y0)/grid_km),1) AS BIGINT) AS ny FROM a""", "grid_km")
def _(spark, sf):
    i = inputs(spark, sf)
    return M.grid_frames(i.frame, i.local, max_cells=200).select("fire", "grid_km", "nx", "ny")


RADIUS_COLS = " ".join(f"n{r} frpmax{r} frpsum{r} tmax{r} viirs{r}" for r in (1, 2, 3, 5))


@query("a01_radius_aggs", FRAME + f", ag AS (SELECT fire, ix, iy, {RADII} FROM pr GROUP BY fire, ix, iy) SELECT fire, ix, iy, {', '.join(RADIUS_COLS.split())} FROM ag", RADIUS_COLS)
def _(spark, sf):
    i = inputs(spark, sf)
    return M.radius_features(cells(i), sites(i), RADIUS_COLS.split()).selectExpr("fire", "CAST(ix AS BIGINT) AS ix", "CAST(iy AS BIGINT) AS iy", *RADIUS_COLS.split())


@query("a02_surroundedness", FRAME + f", ag AS (SELECT fire, ix, iy, {TURNS} FROM pr GROUP BY fire, ix, iy) SELECT * FROM ag", " ".join(n for n, _ in M.TURN_RADII))
def _(spark, sf):
    i = inputs(spark, sf)
    turns = [n for n, _ in M.TURN_RADII]
    return M.radius_features(cells(i), sites(i), turns).selectExpr("fire", "CAST(ix AS BIGINT) AS ix", "CAST(iy AS BIGINT) AS iy", *turns)


@query("a03_first_seen", FRAME + ", ag AS (SELECT fire, ix, iy, coalesce(min(tau) FILTER (dd<=2),1) AS t_first2, arg_min(tau, (dd, det_id)) AS t_first_near FROM pr GROUP BY fire, ix, iy) SELECT * FROM ag", "t_first2 t_first_near")
def _(spark, sf):
    i = inputs(spark, sf)
    out = M.cell_features(cells(i), sites(i), ["radius", "nearest"], ["t_first2", "t_near"])
    return out.selectExpr("fire", "CAST(ix AS BIGINT) AS ix", "CAST(iy AS BIGINT) AS iy", "t_first2", "t_near AS t_first_near")


@query("j01_radius_join", FRAME + " SELECT c.fire, ix, iy, det_id, dd AS d FROM pr c WHERE dd <= 0.5", "d")
def _(spark, sf):
    i = inputs(spark, sf)
    right = i.local.select(*M.KEYS, "det_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    out = S.radius_join(cells(i), right, 0.5, M.KEYS, many=True)
    return out.selectExpr("fire", "CAST(ix AS BIGINT) AS ix", "CAST(iy AS BIGINT) AS iy", "det_id", "d")


@query("j02_nearest_detection", FRAME + ", ag AS (SELECT fire, ix, iy, arg_min(det_id, (dd, det_id)) AS q_id, min(dd) AS d_near FROM pr GROUP BY fire, ix, iy) SELECT * FROM ag", "d_near")
def _(spark, sf):
    i = inputs(spark, sf)
    out = M.nearest_site(cells(i), sites(i), ["q_id", "d_near"])
    return out.selectExpr("fire", "CAST(ix AS BIGINT) AS ix", "CAST(iy AS BIGINT) AS iy", "q_id", "d_near")


ANGLE = "CAST(floor((atan2(y,x)+pi())/(2*pi())*72) AS BIGINT) % 72"


@query("a04_angular_reach", FRAME + f", b AS (SELECT fire, CAST({ANGLE} AS INTEGER) AS bin, quantile_cont(sqrt(x*x+y*y), 0.9) AS p FROM d GROUP BY ALL) SELECT fire, bin, greatest(base_r, p) AS push FROM b JOIN f USING (fire)", "push")
def _(spark, sf):
    i = inputs(spark, sf)
    return M.angular_reach(i.local, i.frame).select("fire", "bin", "push")


AXIS = """ax AS (SELECT fire, CASE WHEN count(*) > 2 THEN cos(0.5e0*atan2(2*covar_samp(x,y), var_samp(x)-var_samp(y))) ELSE 1 END AS axis_x, CASE WHEN count(*) > 2 THEN sin(0.5e0*atan2(2*covar_samp(x,y), var_samp(x)-var_samp(y))) ELSE 0 END AS axis_y,
  avg(x)/(sqrt(pow(avg(x),2)+pow(avg(y),2))+1e-9) AS dir_x, avg(y)/(sqrt(pow(avg(x),2)+pow(avg(y),2))+1e-9) AS dir_y FROM d GROUP BY fire)"""


@query("a05_principal_axis", FRAME + f", {AXIS} SELECT * FROM ax", "axis_x axis_y dir_x dir_y")
def _(spark, sf):
    return M.principal_axis(inputs(spark, sf).local).drop("step")


CONSTS = f"""kc AS (SELECT g.fire, base_r, ln(1+greatest(area*247.105e0,0)) AS log_base, ln(1+{CUTOFF_T - START_T}e0/3600e0) AS log_win, ln(1+n_dets) AS log_ndet, frp_med, frp_p90, gk AS grid_km
  FROM gg g JOIN f USING (fire) JOIN (SELECT fire, median(frp) AS frp_med, quantile_cont(frp,0.9) AS frp_p90 FROM d GROUP BY fire) q USING (fire))"""


@query("a06_fire_constants", FRAME + f", {CONSTS} SELECT * FROM kc", "base_r log_base log_win log_ndet frp_med frp_p90 grid_km")
def _(spark, sf):
    i = inputs(spark, sf)
    return M.fire_constants(i.grid, i.local).drop("step")


@query("j06_label_cells", FRAME + " SELECT fire, count(*) AS n_cells, sum((abs(x) < 0.014e0/0.01e0*hx AND abs(y) < 0.014e0/0.01e0*hy)::BIGINT)::BIGINT AS n_pos FROM c JOIN f USING (fire) GROUP BY fire")
def _(spark, sf):
    i = inputs(spark, sf)
    return M.label_cells(cells(i), i.target).groupBy("fire").agg(F.count("*").alias("n_cells"), F.sum("label").alias("n_pos"))


EDGE = "CASE WHEN abs({x}) < hx AND abs({y}) < hy THEN least(hx-abs({x}), hy-abs({y})) ELSE sqrt(pow(greatest(abs({x})-hx,0),2)+pow(greatest(abs({y})-hy,0),2)) END"
FEATURE_SQL = f"""{AGG}, {AXIS}, {CONSTS}, b AS (SELECT fire, CAST({ANGLE} AS INTEGER) AS bin, quantile_cont(sqrt(x*x+y*y), 0.9) AS p FROM d GROUP BY ALL),
  m AS (SELECT ag.*, c.x, c.y, hx, hy, axis_x, axis_y, dir_x, dir_y, kc.* EXCLUDE (fire), sqrt(c.x*c.x+c.y*c.y) AS r, greatest(kc.base_r, coalesce(b.p, kc.base_r)) AS push_here, {EDGE.format(x='c.x', y='c.y')} AS d_edge, {EDGE.format(x='q.x', y='q.y')} AS d_edge_q,
    (c.x-q.x)*(-q.x)+(c.y-q.y)*(-q.y) AS dot, sqrt(q.x*q.x+q.y*q.y)+1e-9 AS tn, sqrt(pow(c.x-q.x,2)+pow(c.y-q.y,2))+1e-9 AS on_
    FROM ag JOIN c USING (fire, ix, iy) JOIN f USING (fire) JOIN ax USING (fire) JOIN kc USING (fire) LEFT JOIN b ON b.fire = ag.fire AND b.bin = {ANGLE.replace('y,x', 'c.y,c.x')}),
  ft AS (SELECT *, q.d AS d_near, q.f AS frp_near, q.t AS t_near, q.t AS t_first_near, d_edge/base_r AS d_edge_rel, q.d/base_r AS d_near_rel, d_edge-d_edge_q AS d_edge_minus_det, dot/tn AS toward_base, dot/(tn*on_) AS toward_base_norm,
    push_here/base_r AS push_rel, (r <= push_here)::INT*1e0 AS in_champ, abs((x*axis_x+y*axis_y)/(r+1e-9)) AS aniso_axis, (x*dir_x+y*dir_y)/(r+1e-9) AS aniso_centroid, n1/(n2+1) AS dens_r12, n2/(n5+1) AS dens_r25,
    q.f/greatest(frp_med,1e-6) AS frp_near_rel, frpmax2/greatest(frp_med,1e-6) AS frpmax2_rel, 0e0 AS elev_rel, 0e0 AS slope_deg, 0e0 AS elev_minus_det FROM m)"""


def features(spark, sf, dem=None):
    i = inputs(spark, sf)
    return i, M.field_features(i.frame, i.local, i.base, i.grid, dem)


@query("m01_field_features", FRAME + f", {FEATURE_SQL} SELECT fire, count(*) AS n_cells, " + ", ".join(f"round(avg({c}),6) AS {c}" for c in M.FEATURES) + " FROM ft GROUP BY fire", " ".join(M.FEATURES))
def _(spark, sf):
    # Every cell and feature is computed; per-fire means keep the comparison readable.
    _, ft = features(spark, sf)
    return ft.groupBy("fire").agg(F.count("*").alias("n_cells"), *[F.avg(c).alias(c) for c in M.FEATURES])


DEM_SQL = """dem AS (SELECT gx, gy, 500e0 + ((gx*37 + gy*91) % 700 + 700) % 700 AS elev, (((gx+gy) % 30) + 30) % 30 * 1e0 AS slope_deg FROM (
  SELECT DISTINCT CAST(floor(l_suppkey % 400 / 1e0) AS BIGINT) - 12250 AS gx, CAST(3750 + l_partkey % 400 AS BIGINT) AS gy FROM lineitem))"""


@query("m02_elevation_features", FRAME + f", {DEM_SQL}, ag AS (SELECT fire, ix, iy, arg_min({{'x':qx,'y':qy,'id':det_id}}, (dd, det_id)) AS q FROM pr GROUP BY fire, ix, iy), " + """
  pt AS (SELECT ag.fire, ix, iy, CAST(floor((lon0+c.x/kl)/0.01e0) AS BIGINT) AS cx, CAST(floor((lat0+c.y/111.32e0)/0.01e0) AS BIGINT) AS cy, CAST(floor(k.lon/0.01e0) AS BIGINT) AS qx, CAST(floor(k.lat/0.01e0) AS BIGINT) AS qy, CAST(floor(lon0/0.01e0) AS BIGINT) AS bx, CAST(floor(lat0/0.01e0) AS BIGINT) AS by_
    FROM ag JOIN c USING (fire, ix, iy) JOIN f USING (fire) JOIN kept k ON k.det_id = q.id)
  SELECT fire, count(*) AS n, avg(coalesce(c1.elev,0)-coalesce(b1.elev,0)) AS elev_rel, avg(coalesce(c1.slope_deg,0)) AS slope_deg, avg(coalesce(c1.elev,0)-coalesce(q1.elev,0)) AS elev_minus_det
  FROM pt LEFT JOIN dem c1 ON c1.gx=cx AND c1.gy=cy LEFT JOIN dem q1 ON q1.gx=qx AND q1.gy=qy LEFT JOIN dem b1 ON b1.gx=bx AND b1.gy=by_ GROUP BY fire""", "elev_rel slope_deg elev_minus_det")
def _(spark, sf):
    from emberline.plans.fixtures import table

    d = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 400 - 12250).alias("gx"), (F.col("l_partkey") % 400 + 3750).alias("gy")).distinct()
    d = d.select("gx", "gy", (F.pmod(F.col("gx") * 37 + F.col("gy") * 91, F.lit(700)) + 500).cast("double").alias("elev"), F.pmod(F.col("gx") + F.col("gy"), F.lit(30)).cast("double").alias("slope_deg"))
    i = inputs(spark, sf)
    rows = M.cell_features(cells(i), sites(i), ["nearest"])
    out = M.elevation_features(rows, i.frame, d)
    return out.groupBy("fire").agg(F.count("*").alias("n"), F.avg("elev_rel").alias("elev_rel"), F.avg("slope_deg").alias("slope_deg"), F.avg("elev_minus_det").alias("elev_minus_det"))


SCORED = FRAME + f", {CHEAP_AGG}, sc AS (SELECT *, round(n2/(n5+1)*exp(-d_near),9) AS p FROM ag), tk AS (SELECT *, CAST(trunc(sum(p) OVER (PARTITION BY fire)) AS BIGINT) AS take, row_number() OVER (PARTITION BY fire ORDER BY p DESC, iy, ix) AS rn FROM sc)"


def rule_scored(i):
    if not hasattr(i, "scored"):
        i.scored = build_scores(i)
    return i.scored


def build_scores(i):
    rows = M.cell_features(cells(i), sites(i), ["radius", "nearest"], ["n2", "n5", "d_near"])
    return cut_lineage(rows.select(*M.CELL, M.rule_score(F.col("n2"), F.col("n5"), F.col("d_near")).alias("p")))


@query("l01_topk_mass", SCORED + " SELECT fire, ix, iy, p FROM tk WHERE rn <= take", "p")
def _(spark, sf):
    return M.topk_mass(rule_scored(inputs(spark, sf))).selectExpr("fire", "CAST(ix AS BIGINT) AS ix", "CAST(iy AS BIGINT) AS iy", "p")


@query("perimeter_rule_score", SCORED + f""", s AS (SELECT fire, count(*) AS n_cells, count(*) FILTER (rn <= take) AS cells_taken FROM tk GROUP BY fire)
  SELECT fire, n_dets, n_cells, cells_taken, area*1e6/4046.86e0 AS base_acres, area*1e6/4046.86e0 + cells_taken*{PER_CELL!r}e0 AS pred_acres, (area*1e6/4046.86e0 + cells_taken*{PER_CELL!r}e0)/(area*1e6/4046.86e0) AS growth FROM s JOIN f USING (fire) JOIN gg USING (fire)""", "base_acres pred_acres growth")
def perimeter_rule_score(spark, sf):
    """Flagship slice: detections to a growth perimeter per fire with the rule score."""
    i = inputs(spark, sf)
    scored = rule_scored(i)
    taken = M.topk_mass(scored).groupBy(*M.KEYS).agg(F.count("*").alias("cells_taken"))
    totals = scored.groupBy(*M.KEYS).agg(F.count("*").alias("n_cells")).join(taken, M.KEYS, "left")
    acres = F.col("area_km2") * F.lit(1e6) / F.lit(4046.86)
    per = F.pow(F.col("grid_km") * 1000.0, F.lit(2.0)) / F.lit(4046.86)
    out = i.grid.join(totals, M.KEYS).select(
        "fire", "n_dets", "n_cells", F.coalesce("cells_taken", F.lit(0)).alias("cells_taken"), acres.alias("base_acres"),
        (acres + F.coalesce("cells_taken", F.lit(0)) * per).alias("pred_acres"),
    )
    return out.withColumn("growth", F.col("pred_acres") / F.col("base_acres"))


LABELS = FRAME + ", lb AS (SELECT c.fire, ix, iy, (abs(x) < 0.014e0/0.01e0*hx AND abs(y) < 0.014e0/0.01e0*hy)::INT AS label FROM c JOIN f USING (fire))"
BALANCE = """pos AS (SELECT fire, sum(label) AS np, count(*) - sum(label) AS nn FROM lb GROUP BY fire), q AS (SELECT *, least(nn, greatest(CAST(trunc(np*6e0) AS BIGINT), 200)) AS keep FROM pos)"""


@query("l04_negative_sample", LABELS + f", {BALANCE} SELECT fire, CAST(np AS BIGINT) AS n_pos, CAST(keep AS BIGINT) AS n_neg FROM q")
def _(spark, sf):
    i = inputs(spark, sf)
    kept = M.negative_sample(M.label_cells(cells(i), i.target))
    return kept.groupBy("fire").agg(F.sum("label").alias("n_pos"), F.sum(1 - F.col("label")).alias("n_neg"))


@query("a23_cohort_balance", LABELS + f", {BALANCE} SELECT CAST(sum(nn) AS BIGINT) AS all_negative, CAST(sum(keep) AS BIGINT) AS kept_negative, sum(keep)/sum(nn) AS retained FROM q", "retained")
def _(spark, sf):
    i = inputs(spark, sf)
    labelled = M.label_cells(cells(i), i.target)
    return M.cohort_balance(labelled, M.negative_sample(labelled))


@query("m05_prior_correction", SCORED + " SELECT fire, ix, iy, pc*0.3e0/(pc*0.3e0+1-pc) AS p FROM (SELECT *, greatest(least(p,1-1e-9),1e-9) AS pc FROM sc)", "p")
def _(spark, sf):
    rows = rule_scored(inputs(spark, sf))
    return rows.selectExpr("fire", "CAST(ix AS BIGINT) AS ix", "CAST(iy AS BIGINT) AS iy", "p").withColumn("p", M.prior_corrected(F.col("p"), F.lit(0.3)))


def training_rows(spark, sf):
    def build():
        i, ft = features(spark, sf)
        return cut_lineage(M.label_cells(ft, i.target))

    return inputs(spark, sf), made(spark, sf, "labelled", build)


@query("m03_fit_and_score")
def _(spark, sf):
    """Fit on every fire with the full settings and score every cell."""
    i, labelled = training_rows(spark, sf)
    kept = M.negative_sample(labelled)
    r = M.cohort_balance(labelled, kept).first()["retained"]
    model = M.fit_field(kept)
    scored = M.predict_field(model, labelled, r)
    rows = scored.join(by_shuffle(labelled.select(*M.CELL, "label")), M.CELL)
    return rows.groupBy("fire").agg(F.count("*").alias("n_cells"), F.sum("label").alias("n_pos"), F.sum("p").alias("p_mass"))


LEAST_IOU = 0.5  # what held-out growth must reach on average; labels here follow from the distance to the base


@query("m04_lofo_evaluate", LABELS + " SELECT fire, count(*) AS n_cells, sum(label)::BIGINT AS n_pos, true AS reached FROM lb GROUP BY fire")
def _(spark, sf):
    """Every fire held out once, full settings; the trees' own results are held to a floor of mean growth IoU."""
    _, labelled = training_rows(spark, sf)
    each = made(spark, sf, "lofo", lambda: cut_lineage(B.lofo_folds(labelled)))
    mean = each.agg(F.avg("growth_iou").alias("mean_iou"))
    out = each.join(F.broadcast(mean), F.lit(True))
    return out.select("fire", "n_cells", "n_pos", (F.col("mean_iou") >= LEAST_IOU).alias("reached"))


@query("m04_lofo_scores")
def _(spark, sf):
    """The evaluation itself: growth IoU of each held-out fire."""
    _, labelled = training_rows(spark, sf)
    return made(spark, sf, "lofo", lambda: cut_lineage(B.lofo_folds(labelled))).drop("step")


@query("m06_predict_perimeter")
def _(spark, sf):
    i = inputs(spark, sf)
    perim = M.predict_perimeter(rule_scored(i), i.base, i.grid, i.local)
    return C.acres(perim, ["fire"], 0.05, "pred_acres")


def drop_legs(i):
    """Every detection of one satellite stands for a drop leg half a kilometre long."""
    return i.local.where("sensor = 'GOES-19'").select(*M.KEYS, F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 0.5).alias("x2"), (F.col("y") - 0.3).alias("y2"))


@query("g11_edge_from_drops", FRAME + """, leg AS (SELECT d.fire, x, y FROM d JOIN kept k USING (fire, det_id) WHERE k.sensor = 'GOES-19'),
  b AS (SELECT l.fire, ix, iy FROM lat l JOIN f USING (fire) WHERE abs(x) < hx AND abs(y) < hy),
  n AS (SELECT DISTINCT l.fire, l.ix, l.iy, l.x, l.y FROM lat l JOIN b ON b.fire = l.fire AND pow(l.ix-b.ix,2)+pow(l.iy-b.iy,2) <= pow(0.6e0/0.25e0,2) + 1e-9),
  q AS (SELECT n.fire, n.ix, n.iy, n.x - leg.x AS px, n.y - leg.y AS py FROM n JOIN leg USING (fire)),
  u AS (SELECT *, greatest(0e0, least(1e0, (px*0.5e0 - py*0.3e0)/0.34e0)) AS t FROM q)
  SELECT DISTINCT fire, ix, iy FROM u WHERE sqrt(pow(px - t*0.5e0, 2) + pow(py + t*0.3e0, 2)) <= 0.3e0""")
def _(spark, sf):
    i = inputs(spark, sf)
    near = C.dilate(M.base_cells(i.base, i.grid, 1), M.KEYS, 0.6 / M.GRID_KM)
    return C.intersect(M.drop_cells(drop_legs(i), i.grid, M.GRID_KM), near, M.KEYS).select("fire", "ix", "iy")


@query("g12_edge_activity", FRAME + f""", q AS (SELECT fire, quantile_cont(frp, 0.75) AS p75 FROM detections GROUP BY fire),
  a AS (SELECT d.fire, (d.lon-lon0)*kl AS x, (d.lat-lat0)*111.32e0 AS y FROM detections d JOIN q USING (fire) JOIN f USING (fire) WHERE (frp >= p75 AND p75 > 0) OR (starts_with(sensor,'GOES') AND ({NOW_S}e0 - t)/3600e0 < 0.75e0)),
  v AS (SELECT fire, s, hx * [-1e0,1e0,1e0,-1e0,-1e0][s+1] AS x1, hy * [-1e0,-1e0,1e0,1e0,-1e0][s+1] AS y1, hx * [-1e0,1e0,1e0,-1e0,-1e0][s+2] AS x2, hy * [-1e0,-1e0,1e0,1e0,-1e0][s+2] AS y2 FROM f, range(0, 4) r(s))
  SELECT v.fire, count(DISTINCT s) AS edges, count(DISTINCT s) FILTER (least(pow(a.x-x1,2)+pow(a.y-y1,2), pow(a.x-x2,2)+pow(a.y-y2,2)) < 1) AS active FROM v LEFT JOIN a USING (fire) GROUP BY v.fire""")
def _(spark, sf):
    i = inputs(spark, sf)
    hot = D.active_detections(view(spark, sf, "detections"), NOW_S).withColumn("step", F.lit(0)).join(i.frame.select(*M.KEYS, "lon0", "lat0", "km_lon"), M.KEYS)
    hot = hot.select(*M.KEYS, ((F.col("lon") - F.col("lon0")) * F.col("km_lon")).alias("x"), ((F.col("lat") - F.col("lat0")) * 111.32).alias("y"))
    flagged = P.edge_activity(i.base, hot, M.KEYS)
    return flagged.groupBy("fire").agg(F.count("*").alias("edges"), F.count_if("active").alias("active"))


def cycle(i, scored, drops):
    """From scored cells to one summary row per fire."""
    perim = cut_lineage(M.predict_perimeter(scored, i.base, i.grid, i.local, drops=drops))
    return M.predict_run(perim, scored, i.grid, i.local, M.GRID_KM / 5, drops)


def fitted(spark, sf, i):
    """Cells scored by a model fitted on every kept row of all fires with the full settings."""
    _, labelled = training_rows(spark, sf)
    kept = cut_lineage(M.negative_sample(labelled))
    r = M.cohort_balance(labelled, kept).first()["retained"]
    return cut_lineage(B.score_cells(labelled, B.fit_sampled(kept), r))


RUN_SQL = FRAME + f""" SELECT fire, area*1e6/4046.86e0 AS base_acres, n_dets::BIGINT AS n_dets, (SELECT sum(v) FROM d WHERE d.fire = g.fire)::BIGINT AS n_viirs,
  (SELECT count(*) FROM kept k WHERE k.fire = g.fire AND sensor = 'GOES-19')::BIGINT AS n_drop_legs, 'learned_field' AS mode, true AS ordered, true AS grown FROM g JOIN f USING (fire)"""


def predict_run(spark, sf):
    """A whole cycle, run from the snapshot that was written of its inputs."""
    live, drops = inputs(spark, sf), drop_legs(inputs(spark, sf))
    scored = fitted(spark, sf, live)
    path = f"{checkpoint_root(spark)}/snapshots"
    tables = {"scored": scored, "base": live.base, "grid": live.grid, "local": live.local, "drops": drops}
    run_id = uuid.uuid4().hex
    write_snapshot(tables, path, run_id)
    back = SimpleNamespace(**read_snapshot(spark, path, run_id, list(tables)))
    return cycle(back, back.scored, back.drops).drop("step")


@query("m07_predict_run", RUN_SQL, "base_acres")
def _(spark, sf):
    """The summary of a cycle; of what the trees decide, its order and its sign."""
    run = predict_run(spark, sf)
    inside = (F.col("lo_acres") <= F.col("pred_acres")) & (F.col("pred_acres") <= F.col("hi_acres"))
    return run.select("fire", "base_acres", "n_dets", "n_viirs", "n_drop_legs", "mode", inside.alias("ordered"), (F.col("pred_acres") >= 0.98 * F.col("base_acres")).alias("grown"))


@query("m07_run_summary")
def _(spark, sf):
    return predict_run(spark, sf)


@query("a24_growth_metrics", SCORED + """, b AS (SELECT fire, ix, iy, (abs(x) < hx AND abs(y) < hy) AS b, (abs(x) < 1.4e0*hx AND abs(y) < 1.4e0*hy) AS r FROM lat JOIN f USING (fire)),
  j AS (SELECT b.*, coalesce(rn <= take, false) AS p FROM b LEFT JOIN tk USING (fire, ix, iy))
  SELECT fire, CASE WHEN count(*) FILTER (NOT b AND (r OR p)) > 0 THEN count(*) FILTER (NOT b AND r AND p)/count(*) FILTER (NOT b AND (r OR p)) ELSE 0 END AS growth_iou, count(*) FILTER (NOT b AND r AND NOT p)*15.444072688454751e0 AS missed_acres, count(*) FILTER (NOT b AND p AND NOT r)*15.444072688454751e0 AS over_acres
  FROM j GROUP BY fire""", "growth_iou missed_acres over_acres")
def _(spark, sf):
    i = inputs(spark, sf)
    every = M.lattice(i.grid)
    inside = lambda e: S.points_inside(every, e, M.KEYS, ["ix", "iy"], M.GRID_KM, balance=False)
    m = C.growth_metrics(inside(i.base), inside(i.target), M.topk_mass(rule_scored(i)), ["fire"], 0.25)
    return m.select("fire", "growth_iou", "missed_acres", "over_acres")


