"""Queries over the burn-belief grid, evidence sources and cell-set algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import belief as B
from emberline.operators import cells as C
from emberline.plans.catalog import query
from emberline.plans.catalog_observations import pixels
from emberline.plans.fixtures import cte, view

BOX = 0.03
GRID = """gr AS (SELECT fire, lon0-0.03e0 AS west, lat0-0.03e0 AS south, lon0+0.03e0 AS east, dlat, 100e0/(111320e0*cos(radians(((lat0-0.03e0)+(lat0+0.03e0))/2))) AS dlon, ((lat0-0.03e0)+(lat0+0.03e0))/2 AS latc,
  CAST(ceil(((lat0+0.03e0)-(lat0-0.03e0))/dlat) AS BIGINT) AS h, CAST(ceil(((lon0+0.03e0)-(lon0-0.03e0))/(100e0/(111320e0*cos(radians(((lat0-0.03e0)+(lat0+0.03e0))/2))))) AS BIGINT) AS w FROM fires, (SELECT 100e0/111320e0 AS dlat)),
  gc AS (SELECT fire, ix, iy, west+ix*dlon AS lon, south+iy*dlat AS lat FROM gr, LATERAL (SELECT unnest(range(0,w)) AS ix), LATERAL (SELECT unnest(range(0,h)) AS iy)),
  vm AS (SELECT DISTINCT c.fire, c.ix, c.iy FROM gc c JOIN (SELECT * FROM detections WHERE sensor='VIIRS') d ON d.fire=c.fire AND pow(c.lon-d.lon,2)+pow(c.lat-d.lat,2) <= pow(0.1875e0/111.32e0,2))"""
FIRES_DETS = cte("detections", "fires")


def grid(spark, sf):
    boxes = view(spark, sf, "fires").selectExpr("fire", "lon0 - 0.03e0 AS west", "lat0 - 0.03e0 AS south", "lon0 + 0.03e0 AS east", "lat0 + 0.03e0 AS north")
    return B.belief_grid(boxes)


def viirs(spark, sf):
    return view(spark, sf, "detections").where("sensor = 'VIIRS'")


@query("e01_viirs_evidence", FIRES_DETS + f", {GRID} SELECT fire, ix, iy FROM vm")
def _(spark, sf):
    return B.viirs_evidence(viirs(spark, sf), grid(spark, sf))


@query("e01_viirs_status", FIRES_DETS + """, n AS (SELECT fire, count(*) AS n FROM detections WHERE sensor='VIIRS' AND fire % 4 <> 1 GROUP BY fire)
  SELECT f.fire, coalesce(n,0) AS n, CASE WHEN n > 0 THEN 'ok' WHEN f.fire % 8 = 1 THEN 'unavailable' ELSE 'no_data' END AS status FROM fires f LEFT JOIN n USING (fire)""")
def _(spark, sf):
    counts = viirs(spark, sf).where("fire % 4 <> 1").groupBy("fire").agg(F.count("*").alias("n"))
    fires = view(spark, sf, "fires")
    return B.statused(fires, counts, fires.where("fire % 8 = 1").select("fire", F.lit(2).alias("errors")))


def kern_sql(sigma):
    return "(VALUES " + ",".join(f"({k},{w!r}::DOUBLE)" for k, w in B.kernel(sigma)) + ")"


def blur_sql(src, out, sigma):
    k = kern_sql(sigma)
    img = "LATERAL (SELECT unnest([{a}, -1-{a}, 2*{n}-1-{a}]) AS im)"
    return f"""{out}x AS (SELECT s.fire, im-k AS ix, iy, sum(v*kw) AS v FROM {src} s JOIN gr USING (fire), {img.format(a='s.ix', n='w')}, {k} kk(k,kw) WHERE im-k >= 0 AND im-k < w GROUP BY s.fire, im-k, iy),
  {out} AS (SELECT s.fire, ix, im-k AS iy, sum(v*kw) AS v FROM {out}x s JOIN gr USING (fire), {img.format(a='s.iy', n='h')}, {k} kk(k,kw) WHERE im-k >= 0 AND im-k < h GROUP BY s.fire, ix, im-k)"""


VB = f"v0 AS (SELECT *, 1e0 AS v FROM vm), {blur_sql('v0', 'vb', 3.75)}"


@query("r01_gaussian_blur", FIRES_DETS + f", {GRID}, {VB} SELECT fire, ix, iy, v FROM vb", "v")
def _(spark, sf):
    g = grid(spark, sf)
    mask = B.viirs_evidence(viirs(spark, sf), g).withColumn("v", F.lit(1.0))
    return B.gaussian_blur(mask, g, 375.0).select("fire", "ix", "iy", "v")


BURN = "bc AS (SELECT fire, ix, iy, 'viirs' AS source, 2.5e0*0.9e0*v/mx AS add, 0e0 AS fl FROM vb JOIN (SELECT fire, max(v) AS mx FROM vb GROUP BY fire) USING (fire))"
ORIG = f"om AS (SELECT c.fire, c.ix, c.iy, 1e0 AS v FROM gc c JOIN fires f USING (fire) WHERE fire % 3 = 0 AND pow(c.lon-lon0,2)+pow(c.lat-lat0,2) <= pow(500e0/111320e0,2)), {blur_sql('om', 'ob', 1.0)}, oc AS (SELECT fire, ix, iy, 'origin' AS source, ln(0.95e0/(1-0.95e0))*v/mx AS add, 0.95e0*v/mx AS fl FROM ob JOIN (SELECT fire, max(v) AS mx FROM ob GROUP BY fire) USING (fire))"
WIND = "wc AS (SELECT c.fire, ix, iy, 'wind' AS source, 2.5e0*0.5e0*0.6e0*tanh((((lon-(west+east)/2)*111320e0*cos(radians(latc)))*sin(radians(fire*37%360)) + (lat-latc)*111320e0*cos(radians(fire*37%360)))/1000e0/3e0) AS add, 0e0 AS fl FROM gc c JOIN gr USING (fire))"
EDGEC = f"e0 AS (SELECT fire, CAST(trunc((lon-west)/dlon) AS BIGINT) AS ix, CAST(trunc((lat-south)/dlat) AS BIGINT) AS iy, count(*)*1e0 AS v FROM detections JOIN gr USING (fire) WHERE sensor='GOES-18' AND trunc((lon-west)/dlon) BETWEEN 0 AND w-1 AND trunc((lat-south)/dlat) BETWEEN 0 AND h-1 GROUP BY 1,2,3), {blur_sql('e0', 'eb', 2.0)}, ec AS (SELECT fire, ix, iy, 'edge' AS source, 2.5e0*0.4e0*v/mx AS add, 0e0 AS fl FROM eb JOIN (SELECT fire, max(v) AS mx FROM eb GROUP BY fire) USING (fire))"
FOLD = f"{VB}, {BURN}, {ORIG}, {WIND}, {EDGEC}, al AS (SELECT * FROM bc UNION ALL SELECT * FROM oc UNION ALL SELECT * FROM wc UNION ALL SELECT * FROM ec)"


def contributions(spark, sf, g):
    fires = view(spark, sf, "fires")
    burned = B.mask_contribution(B.viirs_evidence(viirs(spark, sf), g), g, "viirs", "burned", 375.0, 0.9)
    org = fires.where("fire % 3 = 0").select("fire", F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), F.lit(False).alias("has_base"), F.lit(20.0).alias("viirs_age_h"))
    origin = B.mask_contribution(B.origin_evidence(org, g), g, "origin", "anchor", 100.0, 1.0, anchor_p=0.95)
    wind = B.direction_contribution(fires.select("fire", (F.col("fire") * 37 % 360).cast("double").alias("bearing")), g, "wind", 0.5)
    edge = B.edge_contribution(view(spark, sf, "detections").where("sensor = 'GOES-18'"), g, "edge", 200.0, 0.4)
    return burned.unionByName(origin).unionByName(wind).unionByName(edge)


@query("r02_r03_belief_fold", FIRES_DETS + f", {GRID}, {FOLD}, s AS (SELECT fire, ix, iy, sum(add) AS a, max(fl) AS fl FROM al GROUP BY ALL), z AS (SELECT c.fire, c.ix, c.iy, ln(0.15e0/0.85e0)+coalesce(a,0) AS l, coalesce(fl,0) AS fl FROM gc c LEFT JOIN s USING (fire, ix, iy)) SELECT fire, ix, iy, l AS log_odds, greatest(1/(1+exp(-l)), fl) AS p FROM z", "log_odds p")
def _(spark, sf):
    g = grid(spark, sf)
    return B.fold(contributions(spark, sf, g), g).select("fire", "ix", "iy", "log_odds", "p")


@query("r03_touched_cells", FIRES_DETS + f", {GRID}, {FOLD} SELECT fire, source, count(*) AS cells FROM al WHERE abs(add) > 0.05e0 GROUP BY ALL")
def _(spark, sf):
    g = grid(spark, sf)
    return B.touched_cells(contributions(spark, sf, g))


@query("r08_condition_weight", """SELECT event_id, greatest(w, 0.05e0) AS cond_w FROM (SELECT event_id, CASE event_type WHEN 'click' THEN (CASE WHEN hour(ts) BETWEEN 14 AND 23 THEN 1e0 ELSE 0.2e0 END)*(CASE WHEN event_id % 4 = 0 THEN 0.3e0 ELSE 1e0 END)
  WHEN 'view' THEN CASE WHEN hour(ts) BETWEEN 14 AND 23 THEN 1e0 ELSE 0.25e0 END WHEN 'error' THEN CASE WHEN event_id % 4 = 0 THEN 0.2e0 ELSE 1e0 END WHEN 'signup' THEN greatest(0.2e0, 1e0-value/12e0) ELSE 1e0 END AS w FROM events)""", "cond_w")
def _(spark, sf):
    from emberline.plans.fixtures import table

    src = F.when(F.col("event_type") == "click", "camera").when(F.col("event_type") == "view", "aircraft").when(F.col("event_type") == "error", "sentinel2").when(F.col("event_type") == "signup", "viirs").otherwise("other")
    obs = table(spark, sf, "events").select("event_id", src.alias("source"), F.hour("ts").alias("hour_utc"), (F.col("event_id") % 4 == 0).alias("smoke"), F.col("value").alias("overpass_age_h"))
    return B.condition_weight(obs).select("event_id", "cond_w")


@query("r07_anisotropic_elongate", FIRES_DETS + f", {GRID}" + """, wn AS (SELECT fire, radians(fire*37%360) AS b, pow(1e0 + 1.2e0*least(fire % 3, 3), 2) + 0.49e0 AS va FROM fires),
  o AS (SELECT x.i AS dx, y.i AS dy FROM range(-19, 20) x(i), range(-19, 20) y(i)),
  kq AS (SELECT fire, dx, dy, pow(dx*sin(b) + dy*cos(b), 2)/va + pow(dx*cos(b) - dy*sin(b), 2)/1.49e0 AS q FROM wn, o),
  kk AS (SELECT fire, dx, dy, exp(-0.5e0*q)/sum(exp(-0.5e0*q)) OVER (PARTITION BY fire) AS k FROM kq WHERE q <= 16),
  st AS (SELECT a.fire, a.ix, a.iy, sum(0.9e0*k) AS s FROM vm a JOIN kk ON kk.fire = a.fire JOIN vm b ON b.fire = a.fire AND b.ix = a.ix - dx AND b.iy = a.iy - dy GROUP BY ALL)
  SELECT fire, count(*) AS cells, 0.9e0 AS peak, sum(s/mx*0.9e0) AS mass FROM st JOIN (SELECT fire, max(s) AS mx FROM st GROUP BY fire) USING (fire) GROUP BY fire""", "peak mass")
def _(spark, sf):
    g = grid(spark, sf)
    fires = view(spark, sf, "fires")
    winds = fires.select("fire", (F.col("fire") * 37 % 360).cast("double").alias("bearing"), (1.0 + F.col("fire") % 3).alias("lb"))
    mask = B.viirs_evidence(viirs(spark, sf), g).withColumn("p", F.lit(0.9))
    out = B.elongate(mask, winds)
    return out.groupBy("fire").agg(F.count("*").alias("cells"), F.max("p").alias("peak"), F.sum("p").alias("mass"))


@query("e02_warm_pixel_evidence", cte("abi_pixel", "detections", "fires") + f", {GRID}" + """, wp AS (SELECT granule % 15 AS fire, line % 2 AS sat_rank, granule, (38.02e0 + (granule % 15 % 50)*0.05e0) + (lat-38.1e0)/5 AS lat, (-121.98e0 + (granule % 15 % 40)*0.05e0) + (lon+121.95e0)/5 AS lon, 0.5e0 + greatest(least((bt-320e0)/80e0,1e0),0.05e0) AS rk FROM abi_pixel WHERE bt >= 320),
  b AS (SELECT fire, sat_rank, granule FROM (SELECT DISTINCT fire, sat_rank, granule, row_number() OVER (PARTITION BY fire ORDER BY sat_rank, granule DESC) AS rn FROM wp) WHERE rn = 1)
  SELECT DISTINCT c.fire, c.ix, c.iy FROM gc c JOIN wp USING (fire) JOIN b ON b.fire=wp.fire AND b.sat_rank=wp.sat_rank AND b.granule=wp.granule WHERE pow(c.lon-wp.lon,2)+pow(c.lat-wp.lat,2) <= pow(rk*1000e0/111320e0,2)""")
def _(spark, sf):
    px = pixels(spark, sf).where("bt >= 320").selectExpr(
        "granule % 15 AS fire", "line % 2 AS sat_rank", "granule", "(38.02e0 + (granule % 15 % 50)*0.05e0) + (lat-38.1e0)/5 AS lat", "(-121.98e0 + (granule % 15 % 40)*0.05e0) + (lon+121.95e0)/5 AS lon",
        "0.5e0 + greatest(least((bt-320e0)/80e0,1e0),0.05e0) AS radius_km")
    return B.warm_pixel_evidence(px, grid(spark, sf))


@query("e08_origin_evidence", FIRES_DETS + f", {GRID} SELECT c.fire, c.ix, c.iy FROM gc c JOIN fires f USING (fire) WHERE fire % 2 = 1 AND fire % 24 >= 12 AND pow(c.lon-lon0,2)+pow(c.lat-lat0,2) <= pow(500e0/111320e0,2)")
def _(spark, sf):
    f = view(spark, sf, "fires").select("fire", F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), (F.col("fire") % 2 == 0).alias("has_base"), (F.col("fire") % 24).cast("double").alias("viirs_age_h"))
    return B.origin_evidence(f, grid(spark, sf))


@query("e06_shuttle_evidence", FIRES_DETS + f", {GRID} SELECT DISTINCT c.fire, c.ix, c.iy FROM gc c JOIN detections d USING (fire) WHERE pow(c.lon-d.lon,2)+pow(c.lat-d.lat,2) <= pow(greatest((det_id%5)/1e1,0.3e0)/111e0,2)")
def _(spark, sf):
    pts = view(spark, sf, "detections").select("fire", "lat", "lon", (F.col("det_id") % 5 / F.lit(10.0)).alias("spread_km"))
    return B.shuttle_evidence(pts, grid(spark, sf))


@query("e06_shuttle_weight", cte("detections") + " SELECT fire, CAST(sum(det_id % 3) AS BIGINT) AS trips, 0.65e0*least(1e0, 0.4e0+0.15e0*sum(det_id % 3)) AS weight FROM detections GROUP BY fire", "weight")
def _(spark, sf):
    sh = view(spark, sf, "detections").select("fire", (F.col("det_id") % 3).alias("n_round_trips"))
    return B.shuttle_weight(sh)


@query("e07_drop_path_evidence", FIRES_DETS + f", {GRID}" + """, l AS (SELECT DISTINCT fire, lon AS x1, lat AS y1, 0.004e0 AS dx, -0.003e0 AS dy FROM detections WHERE sensor = 'GOES-19'),
  q AS (SELECT c.fire, ix, iy, c.lon - x1 AS px, c.lat - y1 AS py, dx, dy FROM gc c JOIN l ON l.fire = c.fire AND c.lon BETWEEN x1 - 0.01e0 AND x1 + 0.01e0 AND c.lat BETWEEN y1 - 0.01e0 AND y1 + 0.01e0),
  u AS (SELECT *, greatest(0e0, least(1e0, (px*dx + py*dy)/(dx*dx + dy*dy))) AS t FROM q)
  SELECT DISTINCT fire, ix, iy FROM u WHERE pow(px - t*dx, 2) + pow(py - t*dy, 2) <= pow(400e0/111320e0, 2)""")
def _(spark, sf):
    seg = view(spark, sf, "detections").where("sensor = 'GOES-19'").selectExpr("fire", "lon AS x1", "lat AS y1", "lon + 0.004e0 AS x2", "lat - 0.003e0 AS y2")
    return B.path_evidence(seg, grid(spark, sf))


@query("e05_camera_wedge_cells", FIRES_DETS + f", {GRID}" + """, z AS (SELECT c.fire, ix, iy, c.lat, c.lon, lat0, lon0, lat0-0.1e0 AS clat, lon0-0.05e0 AS clon FROM gc c JOIN fires USING (fire)),
  q AS (SELECT *, degrees(atan2(sin(radians(lon-clon))*cos(radians(lat)), cos(radians(clat))*sin(radians(lat))-sin(radians(clat))*cos(radians(lat))*cos(radians(lon-clon)))) AS b, 12742e0*asin(least(1e0,sqrt(pow(sin(radians(lat-clat)/2),2)+cos(radians(clat))*cos(radians(lat))*pow(sin(radians(lon-clon)/2),2)))) AS d FROM z)
  SELECT fire, ix, iy FROM q WHERE b - 360*floor(b/360) BETWEEN 10 AND 30 AND d >= 4e0 AND d <= 20e0 AND sqrt(pow(lon-lon0,2)+pow(lat-lat0,2)) <= 0.06e0""")
def _(spark, sf):
    w = view(spark, sf, "fires").selectExpr("fire", "lat0 - 0.1e0 AS lat", "lon0 - 0.05e0 AS lon", "10e0 AS left_deg", "30e0 AS right_deg", "12e0 AS range_km", "lat0 AS olat", "lon0 AS olon")
    return B.camera_wedge_cells(w, grid(spark, sf))


@query("x17_anchor_report", cte("abi_pixel") + """, p AS (SELECT granule % 60 AS fire, area_m2, mask IN (11,31) AS sat FROM abi_pixel WHERE mask IN (10,11,12,13,14,15,30,31,32,33,34,35)),
  q AS (SELECT fire, area_m2 IS NULL OR sat OR area_m2 <= 0 AS mis, sqrt(area_m2/pi()) AS r FROM p) SELECT fire, count(*) AS cells, count(*) FILTER (mis) AS fallbacks, count(*) FILTER (NOT mis AND r < 250) AS floored, max(CASE WHEN mis THEN 250e0 ELSE greatest(r,250e0) END) AS max_radius_m FROM q GROUP BY fire""", "max_radius_m")
def _(spark, sf):
    return B.anchor_report(B.anchor_discs(pixels(spark, sf).where("state = 'fire'").withColumn("fire", F.col("granule") % 60)))


@query("x15_evidence_provenance", cte("detections") + " SELECT det_id, 'https://example.org/' || sensor AS source_url, CAST(fire AS VARCHAR) AS incident FROM detections")
def _(spark, sf):
    d = view(spark, sf, "detections").select("det_id", F.concat(F.lit("https://example.org/"), "sensor").alias("source_url"), F.col("fire").alias("incident"))
    out = B.evidence_provenance(d, ["source_url", "incident"])
    return out.select("det_id", F.col("provenance")["source_url"].alias("source_url"), F.col("provenance")["incident"].alias("incident"))


@query("g14_union_evidence", cte("detections", "fires") + """ SELECT source, count(*) AS n FROM (SELECT fire, sensor AS source FROM detections UNION ALL SELECT fire, 'origin' FROM fires) GROUP BY source""")
def _(spark, sf):
    a = view(spark, sf, "detections").select("fire", F.col("sensor").alias("source"), "frp")
    b = view(spark, sf, "fires").select("fire", F.lit("origin").alias("source"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


# ---- cell sets ------------------------------------------------------------------------

CA = "ca AS (SELECT DISTINCT fire, CAST(floor((lon+122)*250) AS BIGINT) AS ix, CAST(floor((lat-38)*250) AS BIGINT) AS iy FROM detections WHERE det_id % 3 < 2), cb AS (SELECT DISTINCT fire, CAST(floor((lon+122)*250) AS BIGINT) AS ix, CAST(floor((lat-38)*250) AS BIGINT) AS iy FROM detections WHERE det_id % 3 > 0)"


def sets(spark, sf):
    d = view(spark, sf, "detections")
    ij = [F.floor((F.col("lon") + 122) * 250).alias("ix"), F.floor((F.col("lat") - 38) * 250).alias("iy")]
    return d.where("det_id % 3 < 2").select("fire", *ij).distinct(), d.where("det_id % 3 > 0").select("fire", *ij).distinct()


K = ["fire"]


@query("g04_cells_union", cte("detections") + f", {CA} SELECT * FROM ca UNION SELECT * FROM cb")
def _(spark, sf):
    return C.union(*sets(spark, sf), K)


@query("g04_cells_intersect", cte("detections") + f", {CA} SELECT * FROM ca INTERSECT SELECT * FROM cb")
def _(spark, sf):
    return C.intersect(*sets(spark, sf), K)


@query("g04_cells_except", cte("detections") + f", {CA} SELECT * FROM ca EXCEPT SELECT * FROM cb")
def _(spark, sf):
    return C.subtract(*sets(spark, sf), K)


DIL = "{out} AS (SELECT DISTINCT fire, ix+i AS ix, iy+j AS iy FROM {src}, range(-{n},{n}+1) a(i), range(-{n},{n}+1) b(j) WHERE i*i+j*j <= {r2})"
ERO2 = "{out} AS (SELECT fire, ix, iy FROM (SELECT s.fire, s.ix, s.iy, count(t.fire) AS n FROM {src} s CROSS JOIN range(-{n},{n}+1) a(i) CROSS JOIN range(-{n},{n}+1) b(j) LEFT JOIN {src} t ON t.fire=s.fire AND t.ix=s.ix+i AND t.iy=s.iy+j WHERE i*i+j*j <= {r2} GROUP BY ALL) WHERE n = {full})"


@query("g06_dilate", cte("detections") + f", {CA}, {DIL.format(out='x', src='ca', n=3, r2=9)} SELECT * FROM x")
def _(spark, sf):
    return C.dilate(sets(spark, sf)[0], K, 3.0)


@query("g06_close", cte("detections") + f", {CA}, {DIL.format(out='x', src='ca', n=2, r2=4)}, {ERO2.format(out='y', src='x', n=2, r2=4, full=13)} SELECT * FROM y")
def _(spark, sf):
    return C.close(sets(spark, sf)[0], K, 2.0)


@query("g06_erode", cte("detections") + f", {CA}, {DIL.format(out='x', src='ca', n=3, r2=9)}, {ERO2.format(out='y', src='x', n=1, r2=1, full=5)} SELECT * FROM y")
def _(spark, sf):
    return C.erode(C.dilate(sets(spark, sf)[0], K, 3.0), K, 1.0)


@query("g07_components", cte("detections") + f", {CA}, " + """lk AS (SELECT a.fire, a.iy*2147483648+a.ix AS s, b.iy*2147483648+b.ix AS t FROM ca a JOIN ca b ON a.fire=b.fire AND abs(a.ix-b.ix)+abs(a.iy-b.iy)=1),
  rc AS (WITH RECURSIVE w AS (SELECT fire, iy*2147483648+ix AS id, iy*2147483648+ix AS root FROM ca UNION SELECT w.fire, lk.t, w.root FROM w JOIN lk ON lk.fire=w.fire AND lk.s=w.id) SELECT fire, id, min(root) AS comp FROM w GROUP BY fire, id)
  SELECT fire, comp, count(*) AS size FROM rc GROUP BY fire, comp""")
def _(spark, sf):
    return C.components(sets(spark, sf)[0], K).groupBy("fire", "comp").agg(F.count("*").alias("size"))


@query("g08_drop_stray")
def _(spark, sf):
    a, _b = sets(spark, sf)
    parts = C.components(a, K)
    base = view(spark, sf, "fires").select("fire", F.floor((F.col("lon0") + 122) * 250).alias("ix"), F.floor((F.col("lat0") - 38) * 250).alias("iy"))
    dets = view(spark, sf, "detections").select("fire", F.floor((F.col("lon") + 122) * 250).alias("ix"), F.floor((F.col("lat") - 38) * 250).alias("iy"), "sensor")
    return C.drop_stray(parts, base, dets, K, 1.0).groupBy("fire").agg(F.count("*").alias("cells"), F.count_distinct("comp").alias("parts"))


@query("g09_nearest_component")
def _(spark, sf):
    parts = C.components(sets(spark, sf)[0], K)
    origin = view(spark, sf, "fires").select("fire", F.floor((F.col("lon0") + 122) * 250).alias("ox"), F.floor((F.col("lat0") - 38) * 250).alias("oy"))
    return C.nearest_component(parts, origin, K).select("fire", "ix", "iy")


@query("j17_cells_near", cte("detections") + f", {CA} SELECT fire, ix, iy FROM ca a WHERE EXISTS (SELECT 1 FROM cb b WHERE b.fire=a.fire AND sqrt(pow(a.ix-b.ix,2)+pow(a.iy-b.iy,2)) < 1.5e0)")
def _(spark, sf):
    from emberline.operators.spatial import semi_within

    a, b = sets(spark, sf)
    right = b.select("fire", F.col("ix").alias("rx"), F.col("iy").alias("ry"))
    return semi_within(a, right, 1.5, ["fire", "ix", "iy"], keys=["fire"], left_xy=("ix", "iy"), inclusive=False)


def km_cells(spark, sf):
    """Everything the growth decisions need, on the belief grid (0.1 km cells)."""
    g = grid(spark, sf)
    cells = B.grid_cells(g)
    f = view(spark, sf, "fires")
    disc = lambda km: B.disc_mask(f.select("fire", F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), F.lit(km / 111.0).alias("radius_deg")), g)
    facts = f.select(
        "fire", (F.col("fire") % 9 + 1.0).alias("ros_m_min"), (F.col("fire") % 6 + 0.5).alias("hours"), (1.0 + F.col("fire") % 3).alias("lb"),
        (F.col("fire") * 37 % 360).cast("double").alias("bearing"), F.col("lat0").alias("clat"), F.col("lon0").alias("clon"), F.lit(0.8).alias("r_base_km"),
    )
    return g, cells, disc(0.8), facts


@query("g16_reachable_growth")
def _(spark, sf):
    g, cells, base, facts = km_cells(spark, sf)
    goes = B.disc_mask(view(spark, sf, "detections").where("sensor = 'GOES-19'").select("fire", "lat", "lon", F.lit(0.004).alias("radius_deg")), g)
    out = B.reachable_growth(base, goes, B.viirs_evidence(viirs(spark, sf), g), facts, cells, 0.1)
    return out.groupBy("fire").agg(F.count("*").alias("cells"))


@query("g17_fresh_fire_ellipse", FIRES_DETS + f", {GRID}" + """, s AS (SELECT fire, lat0, lon0, radians(fire*37%360) AS b, 1e0 + fire % 3 AS lb, sqrt(greatest(300e0, 200e0 + fire % 400)*4046.86e0/pi()*(1e0 + fire % 3))/1000e0 AS sl FROM fires WHERE fire % 2 = 1 AND fire % 24 >= 12 AND fire % 5 <> 0),
  q AS (SELECT c.fire, ix, iy, sl, sl/lb AS ss, b, (lon-lon0)*111e0 - 0.4e0*sl*sin(b) AS dx, (lat-lat0)*111e0 - 0.4e0*sl*cos(b) AS dy FROM gc c JOIN s USING (fire))
  SELECT fire, ix, iy FROM q WHERE pow((dx*sin(b)+dy*cos(b))/sl,2)+pow((dx*cos(b)-dy*sin(b))/ss,2) <= 1""")
def _(spark, sf):
    f = view(spark, sf, "fires").selectExpr("fire", "lat0 AS lat", "lon0 AS lon", "200e0 + fire % 400 AS near_acres", "1e0 + fire % 3 AS lb", "CAST(fire*37%360 AS DOUBLE) AS bearing", "fire % 2 = 0 AS has_base",
                                            "CAST(fire % 24 AS DOUBLE) AS viirs_age_h", "CASE WHEN fire % 5 = 0 THEN 'unavailable' ELSE 'not_found' END AS base_status")
    return B.fresh_fire_ellipse(f, grid(spark, sf))


@query("g18_belief_fallback")
def _(spark, sf):
    g, _cells, _base, facts = km_cells(spark, sf)
    belief = B.fold(contributions(spark, sf, g), g)
    out = B.belief_fallback(belief, B.viirs_evidence(viirs(spark, sf), g), facts, 0.1)
    return out.groupBy("fire").agg(F.count("*").alias("cells"))
