"""The nearest station in the point's flat frame, without a row per pair."""

import math
import random

from pyspark.sql import functions as F

from emberline.operators.stations import HPA_PER_INHG, nearest_station


def test_nearest_station_sorts_no_pairs(spark):
    rng = random.Random(4)
    fires = [(i, rng.uniform(58, 62), rng.uniform(-150, -146)) for i in range(60)] + [(90, 10.0, 10.0), (91, None, -148.0), (92, 60.0, -148.0)]
    posts = [(i, round(rng.uniform(58, 62), 1), round(rng.uniform(-150, -146), 1), None if i % 9 == 0 else 1000.0 + i) for i in range(80)]
    posts += [(200, 60.1, -148.0, 1001.0), (199, 59.9, -148.0, 1002.0), (198, 60.1, -148.0, 1003.0), (300, None, -148.0, 1.0)]
    points = spark.createDataFrame(fires, "fire long, lat double, lon double")
    metar = spark.createDataFrame(posts, "station long, lat double, lon double, altim_hpa double")

    def flat(p, q):
        return math.hypot((q[2] - p[2]) * 111.32 * math.cos(math.radians(p[1])), (q[1] - p[1]) * 111.32)

    out = nearest_station(points, metar, ["fire"])
    got = {r.fire: (r.station, r.altim_inhg and round(r.altim_inhg, 9)) for r in out.collect()}
    for p in fires:
        near = [] if p[1] is None else sorted((round(flat(p, q), 9), q[0], q[3]) for q in posts if q[1] is not None and q[3] is not None and flat(p, q) <= 111.0)
        assert got[p[0]] == ((near[0][1], round(near[0][2] / HPA_PER_INHG, 9)) if near else (None, None)), p
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_outline_rounds_broadcast_no_segments(spark):
    from emberline.operators import outlines as O

    cells = spark.range(400).select(F.lit(1).alias("fire"), (F.col("id") % 20).alias("ix"), F.floor(F.col("id") / 20).alias("iy"))
    for made in (O.segments(cells, ["fire"]), O.rings(cells, ["fire"], 8)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert O.rings(cells, ["fire"], 8).count() == 4
