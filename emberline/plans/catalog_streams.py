"""Queries over streams that come in several files: the late-row gate, feed polls, kept cycles; and perimeter outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.plans.catalog import query
from emberline.plans.catalog_aircraft import FLEET, REG, fleet
from emberline.plans.catalog_sources import landed
from emberline.plans.fixtures import cte, table, view
from emberline.session import cut_lineage
from emberline.sources import sinks as K
from emberline.streaming import cycles as Y
from emberline.streaming import gate as Q
from emberline.streaming import jobs as J


def in_files(spark, df, part, files):
    """The rows of ``df`` landed file by file, those of part 0 first, and read as a stream of one file per trigger."""
    path = landed(spark)
    for k in range(files):
        df.where(part == k).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


HALF_S = 1705363200.0  # detections from here on land first, so that older ones can be late


@query("t01_gated_detections", cte("detections") + f""", m AS (SELECT max(acq) - INTERVAL 5 DAY AS mark FROM detections WHERE t >= {HALF_S}e0)
  SELECT det_id, CASE WHEN det_id % 9 = 0 THEN 'invalid_record' WHEN det_id % 31 = 0 THEN 'unknown_time' WHEN t < {HALF_S}e0 AND acq < mark THEN 'late' WHEN rn > 1 THEN 'duplicate' END AS reject_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY round_even(lat, 4), round_even(lon, 4), acq, det_id % 9 = 0, det_id % 31 = 0 ORDER BY det_id) AS rn FROM detections), m""")
def _(spark, sf):
    d = view(spark, sf, "detections").withColumn("frp", F.when(F.col("det_id") % 9 == 0, -1.0).otherwise(F.col("frp")))
    d = d.withColumns({"part": F.when(F.col("t") >= HALF_S, 0).otherwise(1), "acq": F.when((F.col("det_id") % 31 == 0) & (F.col("det_id") % 9 > 0), F.lit(None)).otherwise(F.col("acq"))})
    source = in_files(spark, d.drop("t"), F.col("part"), 2).drop("part")
    return J.drain(Q.gated_detections(source, "5 days")).select("det_id", "reject_reason")


FEEDS = ["opensky", "adsb.lol", "adsb.fi"]


@query("t02_stream_tracks", cte("track") + f", {REG}, {FLEET}" + """, m AS (SELECT * FROM (SELECT *, CAST(floor(t/43200) AS BIGINT)*43200 AS poll, row_number() OVER (PARTITION BY icao, floor(t/43200) ORDER BY pt % 3, pt) AS rn FROM track) WHERE rn = 1 AND NOT on_ground),
  a AS (SELECT m.*, f.role, f.operator, CASE WHEN alt_source = 'baro' AND icao % 4 > 0 THEN alt_m + (30e0-29.92e0)*304.8e0 ELSE alt_m END - 20e0 AS agl FROM m LEFT JOIN fleet f ON CAST(m.icao AS VARCHAR) = f.icao24),
  h AS (SELECT *, CASE WHEN role IS NOT NULL THEN starts_with(role, 'helitanker_') ELSE starts_with(callsign, 'COPTER') END AS heli FROM a WHERE role IS NOT NULL OR regexp_matches(callsign, '^(TANKER|COPTER)'))
  SELECT poll, icao, ['opensky','adsb.lol','adsb.fi'][CAST(pt % 3 AS INTEGER) + 1] AS feed, operator AS registry_operator, agl AS agl_m, coalesce(agl <= 600 AND ((heli AND spd_ms BETWEEN 0 AND 45) OR spd_ms BETWEEN 55 AND 100), false) AS drop FROM h""", "agl_m")
def _(spark, sf):
    feed = F.element_at(F.array(*[F.lit(f) for f in FEEDS]), (F.col("pt") % 3 + 1).cast("int"))
    states = view(spark, sf, "track").withColumns({"feed": feed, "seq": F.col("pt")}).drop("drop", "t", "pt")
    source = in_files(spark, states, F.pmod(F.xxhash64("seq"), F.lit(4)), 4)  # polls of all feeds and times in every file
    settings = view(spark, sf, "track").where("icao % 4 > 0").select("icao").distinct().withColumn("altim_inhg", F.lit(30.0))
    job = lambda s: J.stream_tracks(s, fleet(spark, sf), settings, FEEDS, F.lit(20.0), "12 hours", "60 days")
    out = J.drain_closed(job, source, "ts", "icao")
    return out.select(F.unix_seconds("poll.start").alias("poll"), "icao", "feed", "registry_operator", "agl_m", "drop")


@query("t09_stream_snapshot", """WITH h AS (SELECT o_orderkey AS seq, o_custkey % 700 AS fire, epoch_us(o_orderdate)/1e6 AS t, o_totalprice/1e1 AS pred_acres FROM orders)
  SELECT fire, arg_max(seq, (t, seq)) AS seq, arg_max(pred_acres, (t, seq)) AS pred_acres, count(*) AS cycles, (SELECT count(*) FROM h)::BIGINT AS kept_inputs FROM h GROUP BY fire""", "pred_acres")
def _(spark, sf):
    """Cycles over five files, the last one run a second time: newest row per fire, its cycles, and the inputs kept."""
    at = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 700).alias("fire"), (F.unix_micros(at) / F.lit(1e6)).alias("t"), (F.col("o_totalprice") / 10).alias("pred_acres"))
    folder = landed(spark)
    Y.snapshot_writer(in_files(spark, rows, F.pmod(F.xxhash64("seq"), F.lit(5)), 5), folder).trigger(availableNow=True).start().awaitTermination()
    last = Y.committed(spark, f"{folder}/latest")[-1]
    Y.keep_cycle(cut_lineage(Y.replay_cycle(spark, folder, last)), last, folder)
    counts = Y.cycle_history(spark, folder).groupBy("fire").agg(F.count("*").alias("cycles"))
    kept = Y.cycle_history(spark, folder, "inputs").agg(F.count("*").alias("kept_inputs"))
    out = Y.latest_cycles(spark, folder).select("fire", "seq", "pred_acres").join(counts, "fire").join(F.broadcast(kept), F.lit(True))
    return out.select("fire", "seq", "pred_acres", "cycles", "kept_inputs")


CELL_DEG = 0.005
SPREAD = "c AS (SELECT DISTINCT fire, CAST(floor(lon/0.005e0) AS BIGINT) + dx AS ix, CAST(floor(lat/0.005e0) AS BIGINT) + dy AS iy FROM detections, range(-1,2) a(dx), range(-1,2) b(dy))"


def spread_cells(spark, sf):
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    rows = view(spark, sf, "detections").select("fire", F.floor(F.col("lon") / CELL_DEG).alias("i"), F.floor(F.col("lat") / CELL_DEG).alias("j"), F.explode(around).alias("o"))
    return rows.select("fire", (F.col("i") + F.col("o.dx")).alias("ix"), (F.col("j") + F.col("o.dy")).alias("iy")).distinct()


@query("k02_outline_feature", cte("detections") + f""", {SPREAD}, w AS (SELECT fire, ix + a AS vx, iy + b AS vy, 1 + a + 2*b AS q FROM c, range(0,2) x(a), range(0,2) y(b)),
  v AS (SELECT fire, vx, vy, count(*) AS n, sum(q) AS q FROM w GROUP BY ALL),
  e AS (SELECT fire, sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND q = 5 THEN 2 ELSE 0 END)/4e0 AS euler FROM v GROUP BY fire),
  s AS (SELECT fire, count(*) AS sides FROM (SELECT c.fire, c.ix + dx AS ix, c.iy + dy AS iy FROM c, (VALUES (1,0),(-1,0),(0,1),(0,-1)) d(dx,dy)) o ANTI JOIN c USING (fire, ix, iy) GROUP BY fire)
  SELECT fire, count(*) AS cells, min(sides)::BIGINT AS sides, min(euler)::BIGINT AS parts_less_holes FROM c JOIN e USING (fire) JOIN s USING (fire) GROUP BY fire""")
def _(spark, sf):
    """One MultiPolygon per fire, measured from its text: area in cells, length in sides, parts less holes."""
    place = lambda x, y: (x * CELL_DEG, y * CELL_DEG)
    features = K.outline_feature(spread_cells(spark, sf), ["fire"], place)
    shape = "struct<geometry:struct<type:string,coordinates:array<array<array<array<double>>>>>>"
    poly = features.select("fire", F.from_json("value", shape)["geometry"]["coordinates"].alias("c")).select("fire", F.explode("c").alias("polygon"))
    ring = poly.select("fire", F.posexplode("polygon").alias("k", "line"))
    cell = lambda v: F.round(v / CELL_DEG)
    pair = ring.select("fire", "k", F.monotonically_increasing_id().alias("r"), F.posexplode(F.arrays_zip(F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b"))).alias("s", "p"))
    ax, ay, bx, by = (cell(F.col(f"p.{e}")[i]) for e in "ab" for i in (0, 1))
    one = F.when(F.col("s") == 0, F.when(F.col("k") == 0, 1).otherwise(-1)).otherwise(0)
    out = pair.groupBy("fire").agg(F.sum(ax * by - bx * ay).alias("area2"), F.sum(F.abs(ax - bx) + F.abs(ay - by)).alias("sides"), F.sum(one).alias("parts_less_holes"))
    return out.select("fire", (F.col("area2") / 2).cast("bigint").alias("cells"), F.col("sides").cast("bigint").alias("sides"), "parts_less_holes")
