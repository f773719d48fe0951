"""Queries over mapped perimeters and their outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import perimeters as P
from emberline.operators import spatial as S
from emberline.plans.catalog import query
from emberline.plans.fixtures import cte, edges_cte, square_edges, table, view

YEAR_SLOT = lambda: F.floor(F.col("t") / (120 * 86400))

BOXED = """boxed AS (SELECT *, clon - 0.02e0 AS west, clat - 0.02e0 AS south, clon + 0.02e0 AS east, clat + 0.02e0 AS north FROM perimeter WHERE clat IS NOT NULL)"""


def boxed(spark, sf):
    p = view(spark, sf, "perimeter").where("clat IS NOT NULL")
    return p.selectExpr("*", "clon - 0.02e0 AS west", "clat - 0.02e0 AS south", "clon + 0.02e0 AS east", "clat + 0.02e0 AS north")


NAMED = """named AS (SELECT *, upper(['camp', 'dixie fire', 'creek', 'august complex', 'lake', 'bear'][perim_id % 6 + 1]) || ' ' || (perim_id % 5) AS name,
  CASE WHEN perim_id % 3 = 0 THEN 'US-CA' ELSE 'US-OR' END AS state, 'ID-' || (fire % 400) AS irwin_id FROM perimeter)"""


def named(spark, sf):
    names = "upper(element_at(array('camp', 'dixie fire', 'creek', 'august complex', 'lake', 'bear'), cast(perim_id % 6 + 1 AS INT))) || ' ' || (perim_id % 5) AS name"
    return view(spark, sf, "perimeter").selectExpr("*", names, "CASE WHEN perim_id % 3 = 0 THEN 'US-CA' ELSE 'US-OR' END AS state",
                                                    "'ID-' || (fire % 400) AS irwin_id", "ts AS t_current", "ts - INTERVAL 400 DAY AS t_discovery")


@query("f03_geojson_bbox", cte("fires") + f", {edges_cte()} SELECT fire, min(least(x1,x2)) - 0.05e0 AS west, min(least(y1,y2)) - 0.05e0 AS south, max(greatest(x1,x2)) + 0.05e0 AS east, max(greatest(y1,y2)) + 0.05e0 AS north FROM edges GROUP BY fire", "west south east north")
def _(spark, sf):
    return P.edges_bbox(square_edges(view(spark, sf, "fires")), ["fire"])


@query("f04_adaptive_bbox", cte("perimeter") + f", {BOXED}" + """, p AS (SELECT perim_id, west, south, east, north,
  greatest(least(2e0*sqrt(greatest(acres,1e0)*4046.86e0/pi())/1000e0/111e0*1.5e0, 0.6e0), 0.08e0) AS pad FROM boxed)
  SELECT perim_id, pad, west - pad AS west, south - pad AS south, east + pad AS east, north + pad AS north FROM p""", "pad west south east north")
def _(spark, sf):
    return P.adaptive_bbox(boxed(spark, sf)).select("perim_id", "pad", "west", "south", "east", "north")


@query("f05_active_fires", cte("perimeter") + " SELECT perim_id, acres FROM perimeter WHERE acres > 1000 AND NOT ended AND (pct_contained IS NULL OR pct_contained < 90) ORDER BY acres DESC, perim_id LIMIT 50", "acres")
def _(spark, sf):
    return P.active_fires(view(spark, sf, "perimeter"), 1000, 50).select("perim_id", "acres")


@query("f06_find_fire", cte("perimeter") + f", {NAMED} SELECT perim_id, name, acres FROM named WHERE upper(name) LIKE '%DIXIE%' ORDER BY acres DESC NULLS LAST, name LIMIT 1", "acres")
def _(spark, sf):
    return P.find_fire(named(spark, sf), "Dixie").select("perim_id", "name", "acres")


@query("f07_containment_status", cte("perimeter", "fires") + f", {BOXED} " + """SELECT fire, pct_contained, ended FROM fires LEFT JOIN (
  SELECT fire, pct_contained, ended FROM (SELECT f.fire, b.pct_contained, b.ended, row_number() OVER (PARTITION BY f.fire ORDER BY b.acres DESC, b.perim_id) AS rn
  FROM fires f JOIN boxed b ON west <= lon0 + 0.06e0 AND east >= lon0 - 0.06e0 AND south <= lat0 + 0.06e0 AND north >= lat0 - 0.06e0) WHERE rn = 1) USING (fire)""", "pct_contained")
def _(spark, sf):
    pts = view(spark, sf, "fires").select("fire", F.col("lat0").alias("lat"), F.col("lon0").alias("lon"))
    return P.containment_status(boxed(spark, sf).drop("fire"), pts)


@query("f14_unchanged_snapshots", cte("perimeter") + """ SELECT fire, perim_id, bucket FROM (SELECT fire, perim_id, bucket, lag(bucket) OVER (PARTITION BY fire ORDER BY t, perim_id) AS pb FROM (
  SELECT fire % 300 AS fire, perim_id, t, round_even(coalesce(floor(acres/2000e0)*2000e0 + 1e0,0)/10,0)*10 AS bucket FROM perimeter)) WHERE pb IS NULL OR bucket <> pb""", "bucket")
def _(spark, sf):
    p = view(spark, sf, "perimeter").select((F.col("fire") % 300).alias("fire"), "perim_id", "t", (F.floor(F.col("acres") / 2000) * F.lit(2000.0) + 1.0).alias("acres"))
    return P.unchanged_snapshot_filter(p, YEAR_SLOT()).select("fire", "perim_id", "bucket")


@query("f15_largest_matching_fire", cte("perimeter") + f", {NAMED} SELECT perim_id, name, acres FROM named WHERE name LIKE '%CREEK%' AND (acres IS NULL OR acres >= 100) AND state LIKE '%OR%' AND (year(ts) = 1998 OR year(ts - INTERVAL 400 DAY) = 1998) ORDER BY acres DESC, perim_id LIMIT 1", "acres")
def _(spark, sf):
    return P.largest_matching_fire(named(spark, sf), "Creek Fire", 1998, "OR").select("perim_id", "name", "acres")


@query("f16_perimeter_timestamp", """WITH p AS (SELECT o_orderkey AS perim_id, CASE WHEN o_orderkey % 3 = 0 THEN 5e0 WHEN o_orderkey % 3 = 1 THEN NULL ELSE epoch_ms(o_orderdate) END AS a,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE epoch_ms(o_orderdate) + 1000 END AS b FROM orders)
  SELECT perim_id, CAST(coalesce(CASE WHEN a > 1e11 THEN a END, CASE WHEN b > 1e11 THEN b END) / 1000 AS BIGINT) AS t_map FROM p""")
def _(spark, sf):
    k = F.col("o_orderkey")
    ms = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("double")
    p = table(spark, sf, "orders").select(k.alias("perim_id"), F.when(k % 3 == 0, F.lit(5.0)).when(k % 3 == 2, ms).alias("a"), F.when(k % 2 == 1, ms + 1000).alias("b"))
    return P.perimeter_timestamp(p, ["a", "b"]).select("perim_id", F.unix_seconds("t_map").alias("t_map"))


@query("x10_mission_name", """WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Camp' END AS incident_name,
  CASE o_orderkey % 3 WHEN 0 THEN 'CA-PMQ-' || upper(split_part(o_orderpriority, '-', 2)) || '-N57B' WHEN 1 THEN 'SOLO' ELSE NULL END AS mission FROM orders)
  SELECT id, trim(coalesce(incident_name, CASE WHEN t <> '' THEN array_to_string(list_transform(string_split(t, ' '), lambda w: upper(left(w,1)) || lower(substr(w,2))), ' ') END, 'Unnamed')) AS name FROM (
  SELECT *, trim(CASE WHEN len(string_split(mission,'-')) >= 3 THEN string_split(mission,'-')[3] ELSE mission END) AS t FROM m)""")
def _(spark, sf):
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, F.concat(F.lit("CA-PMQ-"), F.upper(F.element_at(F.split("o_orderpriority", "-"), 2)), F.lit("-N57B"))).when(k % 3 == 1, "SOLO")
    rows = table(spark, sf, "orders").select(k.alias("id"), F.when(k % 4 == 0, "Camp").alias("incident_name"), code.alias("mission"))
    return P.mission_name(rows).select("id", "name")


@query("x12_normalize_fire_name", cte("perimeter") + f", {NAMED}" + r""", n AS (SELECT perim_id, ' ' || name || CASE perim_id % 4 WHEN 0 THEN ' Fire' WHEN 1 THEN ' complex ' WHEN 2 THEN ' Incident' ELSE '' END AS name, CASE WHEN perim_id % 7 = 0 THEN NULL ELSE CAST(2000 + perim_id % 20 AS INTEGER) END AS year FROM named)
  SELECT perim_id, trim(upper(name)) || '_' || coalesce(CAST(year AS VARCHAR), 'X') AS slug, regexp_replace(trim(upper(name)), '\s+(FIRE|COMPLEX|INCIDENT)\s*$', '') || '_' || coalesce(CAST(year AS VARCHAR), 'X') AS norm_slug FROM n""")
def _(spark, sf):
    n = named(spark, sf).selectExpr("perim_id", "' ' || name || CASE perim_id % 4 WHEN 0 THEN ' Fire' WHEN 1 THEN ' complex ' WHEN 2 THEN ' Incident' ELSE '' END AS name",
                                    "CASE WHEN perim_id % 7 = 0 THEN NULL ELSE CAST(2000 + perim_id % 20 AS INT) END AS year")
    return P.normalize_fire_name(n).select("perim_id", "slug", "norm_slug")


@query("j10_perimeter_fusion", cte("perimeter") + """, a AS (SELECT * FROM perimeter WHERE perim_id % 4 = 0), b AS (SELECT * FROM perimeter WHERE perim_id % 4 <> 0)
  SELECT perim_id, acres, 'primary' AS origin FROM a UNION ALL SELECT perim_id, acres, 'secondary' FROM b WHERE clat IS NULL OR NOT EXISTS (
  SELECT 1 FROM a WHERE a.clat IS NOT NULL AND sqrt(pow((b.clat-a.clat)*111e0,2) + pow((b.clon-a.clon)*111e0*cos(radians(b.clat)),2)) < 3e0)""", "acres")
def _(spark, sf):
    p = view(spark, sf, "perimeter").select("perim_id", "acres", "clat", "clon")
    return P.perimeter_fusion(p.where("perim_id % 4 = 0"), p.where("perim_id % 4 <> 0"), 3.0).select("perim_id", "acres", "origin")


@query("a16_cluster_dedup")
def _(spark, sf):
    # Order-dependent greedy thinning: tested against brute force in tests/test_perimeters.py.
    return P.cluster_dedup(view(spark, sf, "perimeter"), 2.0).select("perim_id", "fire", "acres")


@query("a17_vertex_centroid", cte("fires") + f", {edges_cte()} SELECT fire, avg(x1) AS clon, avg(y1) AS clat FROM edges GROUP BY fire", "clon clat")
def _(spark, sf):
    return P.vertex_centroid(square_edges(view(spark, sf, "fires")), ["fire"])


@query("a17_area_acres", cte("fires") + f", {edges_cte('target')} " + """SELECT fire, abs(sum((x1-lon0)*111320e0*cos(radians(lat0))*(y2-lat0)*111320e0 - (x2-lon0)*111320e0*cos(radians(lat0))*(y1-lat0)*111320e0))/2/4046.86e0 AS acres
  FROM edges JOIN fires USING (fire) GROUP BY fire""", "acres")
def _(spark, sf):
    fires = view(spark, sf, "fires")
    return P.area_acres(square_edges(fires, "target").join(fires, "fire"), ["fire"])


@query("a20_report_stats", cte("perimeter", "detections") + """ SELECT p.fire, snapshots, peak_acres, first_t, last_t, coalesce(hotspots, 0) AS hotspots FROM (
  SELECT fire, count(*) AS snapshots, max(acres) AS peak_acres, min(t) AS first_t, max(t) AS last_t FROM perimeter GROUP BY fire) p
  LEFT JOIN (SELECT fire, count(*) AS hotspots FROM detections GROUP BY fire) d ON p.fire = d.fire""", "peak_acres first_t last_t")
def _(spark, sf):
    return P.report_stats(view(spark, sf, "perimeter"), view(spark, sf, "detections"))


@query("w13_perimeter_growth_series", cte("perimeter") + " SELECT fire, perim_id, acres, acres - lag(acres) OVER (PARTITION BY fire ORDER BY t, perim_id) AS delta_acres FROM perimeter", "acres delta_acres")
def _(spark, sf):
    return P.perimeter_growth_series(view(spark, sf, "perimeter"), YEAR_SLOT()).select("fire", "perim_id", "acres", "delta_acres")


@query("j18_stage_join", cte("perimeter") + """, s AS (SELECT fire, CAST(perim_id % 5 AS INTEGER) AS step, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN perim_id % 2 = 0 THEN '+00:00' ELSE 'Z' END AS start, acres FROM perimeter),
  k AS (SELECT *, fire || ':' || step || ':' || replace(start, '+00:00', 'Z') AS step_key FROM s), p AS (SELECT DISTINCT fire || ':' || CAST(perim_id % 5 AS INTEGER) || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS step_key FROM perimeter WHERE perim_id % 3 = 0)
  SELECT step_key, fire, step, acres FROM k JOIN p USING (step_key)""", "acres")
def _(spark, sf):
    p = view(spark, sf, "perimeter").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    steps = p.selectExpr("fire", "CAST(perim_id % 5 AS INT) AS step", "iso || CASE WHEN perim_id % 2 = 0 THEN '+00:00' ELSE 'Z' END AS start", "acres")
    preds = p.where("perim_id % 3 = 0").selectExpr("fire || ':' || CAST(perim_id % 5 AS INT) || ':' || iso || 'Z' AS step_key").distinct()
    return P.stage_join(steps, preds).select("step_key", "fire", "step", "acres")


@query("j20_perimeter_history", cte("perimeter") + f", {NAMED}" + """, best AS (SELECT * FROM named WHERE perim_id % 3 = 1 AND name LIKE '%DIXIE%' AND acres >= 100 ORDER BY acres DESC, perim_id LIMIT 1)
  SELECT perim_id, irwin_id, acres, 'consolidated' AS source FROM best UNION ALL
  SELECT perim_id, irwin_id, acres, 'daily' FROM named WHERE perim_id % 3 = 0 AND irwin_id IN (SELECT irwin_id FROM best)""", "acres")
def _(spark, sf):
    n = named(spark, sf)
    arch = n.where("perim_id % 3 = 2").withColumn("category", F.lit("Wildfire Daily Fire Perimeter"))
    out = P.perimeter_history(n.where("perim_id % 3 = 1"), n.where("perim_id % 3 = 0"), arch, "Dixie Fire")
    return out.select("perim_id", "irwin_id", "acres", "source")


@query("j20_history_by_name", cte("perimeter") + f", {NAMED}" + """, d AS (SELECT * FROM named WHERE perim_id % 3 = 1 AND name LIKE '%LAKE%' AND acres >= 100 AND year(ts) = 1999)
  SELECT perim_id, irwin_id, acres, 'daily' AS source FROM d""", "acres")
def _(spark, sf):
    n = named(spark, sf)
    arch = n.where("perim_id % 3 = 2").withColumn("category", F.lit("Wildfire Daily Fire Perimeter"))
    out = P.perimeter_history(n.where("perim_id % 3 = 0 AND NOT contains(name, 'LAKE')"), n.where("perim_id % 3 = 1"), arch, "Lake", 1999)
    return out.select("perim_id", "irwin_id", "acres", "source")


@query("s24_complex_perimeters", """WITH p AS (SELECT o_orderkey AS perim_id, CASE WHEN o_orderkey % 3 = 0 THEN 'LNU Lightning Complex' WHEN o_orderkey % 3 = 1 THEN 'Southern LNU Complex' ELSE NULL END AS complex_name,
  year(o_orderdate) AS year, CASE WHEN o_custkey % 2 = 0 THEN 'ca' ELSE 'NV' END AS state, o_totalprice AS acres FROM orders)
  SELECT perim_id, acres FROM p WHERE upper(complex_name) = 'LNU LIGHTNING COMPLEX' AND year = 1998 AND upper(state) = 'CA'""", "acres")
def _(spark, sf):
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select(
        k.alias("perim_id"), F.when(k % 3 == 0, "LNU Lightning Complex").when(k % 3 == 1, "Southern LNU Complex").alias("complex_name"),
        F.year("o_orderdate").alias("year"), F.when(F.col("o_custkey") % 2 == 0, "ca").otherwise("NV").alias("state"), F.col("o_totalprice").alias("acres"),
    )
    return P.complex_perimeters(p, "lnu lightning complex", 1998, "CA").select("perim_id", "acres")


@query("j04_point_in_polygon", cte("detections", "fires") + f", {edges_cte()} " + """SELECT fire, det_id FROM (SELECT d.fire, d.det_id, count(*) AS n FROM detections d JOIN edges e ON d.fire = e.fire
  AND (e.y1 > d.lat) <> (e.y2 > d.lat) AND d.lon < (e.x2-e.x1)*(d.lat-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY ALL) WHERE n % 2 = 1""")
def _(spark, sf):
    return S.points_inside(view(spark, sf, "detections"), square_edges(view(spark, sf, "fires")), ["fire"], ["det_id"], 0.005, ("lon", "lat"))


SEG = """least(greatest(CASE WHEN pow(e.x2-e.x1,2)+pow(e.y2-e.y1,2)=0 THEN 0 ELSE ((d.lon-e.x1)*(e.x2-e.x1)+(d.lat-e.y1)*(e.y2-e.y1))/(pow(e.x2-e.x1,2)+pow(e.y2-e.y1,2)) END,0e0),1e0)"""


@query("j05_boundary_distance", cte("detections", "fires") + f", {edges_cte()} SELECT fire, det_id, min(1e3*sqrt(pow(lon-(x1+u*(x2-x1)),2)+pow(lat-(y1+u*(y2-y1)),2))) AS d_edge FROM (SELECT d.fire, d.det_id, d.lon, d.lat, e.*, {SEG} AS u FROM detections d JOIN edges e ON d.fire = e.fire) GROUP BY ALL".replace("e.*", "e.x1, e.x2, e.y1, e.y2"), "d_edge")
def _(spark, sf):
    out = S.boundary_distance(view(spark, sf, "detections"), square_edges(view(spark, sf, "fires")), ["fire"], ["det_id"], F.floor(F.col("seq") / 2), ("lon", "lat"))
    return out.select("fire", "det_id", (F.col("d_edge") * 1e3).alias("d_edge"))


@query("l02_nearest_k", cte("airport", "fires") + """ SELECT center_id, id, d, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY d, id) AS rn FROM (
  SELECT f.fire AS center_id, a.ident AS id, 12742e0*asin(least(1e0, sqrt(pow(sin(radians(f.lat0-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(f.lat0))*pow(sin(radians(f.lon0-a.lon)/2),2)))) AS d
  FROM airport a, fires f) WHERE d <= 40e0) WHERE rn <= 9""", "d")
def _(spark, sf):
    cams = view(spark, sf, "airport").select(F.col("ident").alias("id"), "lat", "lon")
    centers = view(spark, sf, "fires").select(F.col("fire").alias("center_id"), F.col("lat0").alias("rlat"), F.col("lon0").alias("rlon"))
    return P.nearest_k(cams, centers, 40.0, 9).select("center_id", "id", "d", "rank")
