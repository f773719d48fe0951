"""Domain views over the driver tables.

Every view is plain arithmetic written once and used by both engines: Spark reads
it through ``selectExpr`` and the oracle receives the same text as a CTE. ``{s:c}``
marks epoch seconds of timestamp column c, the one spelling that differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import configure

VIEWS: dict[str, tuple[str, str]] = {
    "detections": (
        "events",
        """event_id AS det_id, user_id AS fire, ts AS acq, {s:ts} AS t,
        38.0e0 + (user_id % 50)*0.05e0 + ((event_id*7919) % 400)/1e4 AS lat,
        -122.0e0 + (user_id % 40)*0.05e0 + ((event_id*104729) % 400)/1e4 AS lon,
        value AS frp,
        CASE event_type WHEN 'view' THEN 'GOES-19' WHEN 'click' THEN 'GOES-18' ELSE 'VIIRS' END AS sensor""",
    ),
    "source_health": (
        "events",
        """event_id AS seq, ts AS t, user_id % 7 AS fire, event_type AS source,
        CASE WHEN event_id % 10 < 7 THEN 'ok' WHEN event_id % 10 < 9 THEN 'no_data' ELSE 'unavailable' END AS status,
        props AS reason, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value/1e2 END AS latency_s,
        CASE WHEN event_id % 3 = 0 THEN event_id % 50 ELSE NULL END AS record_count""",
    ),
    "track": (
        "events",
        """event_id AS pt, user_id AS icao, ts, {s:ts} AS t, 38.0e0 + ((event_id*7919) % 400)/1e4 AS lat,
        -122.0e0 + ((event_id*104729) % 400)/1e4 AS lon,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE 20.0e0 + (event_id*37) % 400 END AS alt_m,
        10.0e0 + (event_id*31) % 100 AS spd_ms,
        CASE WHEN event_id % 2 = 0 THEN 'geo' ELSE 'baro' END AS alt_source,
        event_id % 23 = 0 AS on_ground,
        (event_id*37) % 400 < 160 AS drop,
        CASE WHEN user_id % 3 = 0 THEN 'COPTER' || user_id WHEN user_id % 3 = 1 THEN 'TANKER' || user_id ELSE 'N' || user_id END AS callsign""",
    ),
    "abi_pixel": (
        "lineitem",
        """l_orderkey AS granule, l_linenumber AS line, {s:l_shipdate} AS t,
        CASE WHEN l_linenumber % 2 = 0 THEN 'GOES-18' ELSE 'GOES-19' END AS platform,
        38.0e0 + (l_partkey % 200)/1e3 AS lat, -122.0e0 + (l_suppkey % 200)/1e3 AS lon,
        CAST(l_quantity AS INT) % 40 AS mask, l_linenumber % 4 AS dqf,
        CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice*50e0 END AS area_m2,
        CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount*1e3 - 5e0 END AS power_mw,
        300.0e0 + CAST(l_quantity AS INT) * 3 AS bt""",
    ),
    "perimeter": (
        "orders",
        """o_orderkey AS perim_id, o_custkey AS fire, o_orderdate AS ts, {s:o_orderdate} AS t, o_totalprice/1e1 AS acres,
        o_orderpriority AS source,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 36.0e0 + (o_orderkey * 7919 % 60000)/1e4 END AS clat,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE -122.0e0 + (o_orderkey * 104729 % 60000)/1e4 END AS clon,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 101) * 1.0e0 END AS pct_contained,
        o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS ended""",
    ),
    "airport": (
        "customer",
        """c_custkey AS ident, 38.0e0 + (c_custkey*37 % 3000)/1e3 AS lat, -122.0e0 + (c_custkey*53 % 3000)/1e3 AS lon,
        c_acctbal/1e1 AS elev_ft, CASE WHEN c_custkey % 11 = 0 THEN 'closed' WHEN c_custkey % 13 = 0 THEN '' ELSE 'small_airport' END AS type""",
    ),
    "station_obs": (
        "supplier",
        """s_suppkey AS id, 38.0e0 + (s_suppkey*17 % 2000)/1e3 AS lat, -122.0e0 + (s_suppkey*29 % 2000)/1e3 AS lon,
        60.0e0 + s_suppkey % 40 AS temp_f, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 10.0e0 + s_suppkey % 70 END AS rh,
        5.0e0 + s_suppkey % 25 AS spd_mph, (s_suppkey*47) % 360 AS dir_deg""",
    ),
    "raster": (
        "part",
        """p_partkey AS cell, p_partkey // 50 AS r, p_partkey % 50 AS c,
        100.0e0 + (p_partkey * 7919 % 1000)/1e1 + p_size AS elev, 101 + p_size % 9 AS fuel""",
    ),
    "weather": (
        "orders",
        """o_custkey AS point_id, o_orderkey AS seq, o_orderdate AS ts, {s:o_orderdate} + (o_orderkey % 24) * 3600 AS t,
        40.0e0 + o_orderkey % 70 AS temp_f, 5.0e0 + o_orderkey % 90 AS rh, (o_orderkey * 7 % 45) * 1.0e0 AS ws,
        (o_orderkey * 47 % 360) * 1.0e0 AS wd, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 13)/1e1 ELSE 0.0e0 END AS precip""",
    ),
    # One base perimeter per fire: a 0.02 degree square in the middle of its detection box.
    "fires": (
        "(SELECT DISTINCT user_id AS fire FROM events)",
        """fire, 38.02e0 + (fire % 50)*0.05e0 AS lat0, -121.98e0 + (fire % 40)*0.05e0 AS lon0""",
    ),
}
SQUARE_DEG = {"base": 0.010, "target": 0.014}


def _spell(text: str, dialect: str) -> str:
    if dialect == "spark":
        text = re.sub(r"\{s:(\w+)\}", r"(unix_micros(CAST(\1 AS TIMESTAMP))/1e6)", text)
        return re.sub(r"(\w+) // (\d+)", r"(\1 DIV \2)", text)
    return re.sub(r"\{s:(\w+)\}", r"(epoch_us(\1)/1e6)", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(exprs: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in exprs:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = VIEWS[name]
    if source.startswith("("):
        base = table(spark, sf_dir, "events").select(F.col("user_id").alias("fire")).distinct()
    else:
        base = table(spark, sf_dir, source)
    out = base.selectExpr(*_split(_spell(exprs, "spark")))
    for name_, kind in out.dtypes:
        if kind == "timestamp_ntz":
            out = out.withColumn(name_, F.col(name_).cast("timestamp"))
    return out


def square_edges(fires: DataFrame, which: str = "base", perim_id: str = "fire") -> DataFrame:
    """The four edges of each fire's square perimeter, in lon/lat degrees."""
    h = SQUARE_DEG[which]
    corners = [(-h, -h), (h, -h), (h, h), (-h, h)]
    edges = [
        F.struct(
            F.lit(i).alias("seq"),
            (F.col("lon0") + F.lit(ax)).alias("x1"),
            (F.col("lat0") + F.lit(ay)).alias("y1"),
            (F.col("lon0") + F.lit(bx)).alias("x2"),
            (F.col("lat0") + F.lit(by)).alias("y2"),
        )
        for i, ((ax, ay), (bx, by)) in enumerate(zip(corners, corners[1:] + corners[:1]))
    ]
    return fires.select(
        F.col(perim_id), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.explode(F.array(*edges)).alias("e")
    ).select(perim_id, "part", "ring", "e.*")


def cte(*names: str) -> str:
    """``WITH`` clause text (without a trailing comma) defining the named views for the oracle."""
    defs = []
    for n in names:
        source, exprs = VIEWS[n]
        defs.append(f"{n} AS (SELECT {_spell(exprs, 'duckdb')} FROM {source})")
    return "WITH " + ", ".join(defs)


def edges_cte(which: str = "base", name: str = "edges") -> str:
    h = SQUARE_DEG[which]
    return (
        f"{name} AS (SELECT fire, seq, lon0 + ax AS x1, lat0 + ay AS y1, lon0 + bx AS x2, lat0 + by_ AS y2 FROM fires, "
        f"(VALUES (0,-{h}e0,-{h}e0,{h}e0,-{h}e0),(1,{h}e0,-{h}e0,{h}e0,{h}e0),(2,{h}e0,{h}e0,-{h}e0,{h}e0),"
        f"(3,-{h}e0,{h}e0,-{h}e0,-{h}e0)) s(seq,ax,ay,bx,by_))"
    )
