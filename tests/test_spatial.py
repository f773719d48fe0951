"""Tile joins against brute force, with tiny tile limits so that dense tiles are split."""

import math
import random

from pyspark.sql import functions as F

from emberline.functions import frames
from emberline.operators import spatial as S


def scene(spark, seed=3, n=120, m=90):
    rng = random.Random(seed)
    left = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(n)]
    right = [(100 + i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(m)] + [(300 + i, 1.0, 1.0) for i in range(60)]
    return left, right, spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "rid long, rx double, ry double")


def test_radius_join_equals_brute_force_with_split_tiles(spark):
    left, right, a, b = scene(spark)
    want = sorted((i, j) for i, x, y in left for j, u, v in right if math.hypot(u - x, v - y) <= 1.5)
    for limit in (7, 10_000):
        got = sorted((r["id"], r["rid"]) for r in S.radius_join(a, b, 1.5, tile_rows=limit).collect())
        assert got == want


def test_radius_is_inclusive_and_can_be_strict(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(2, 2.0, 0.0)], "rid long, rx double, ry double")
    assert S.radius_join(a, b, 2.0).count() == 1
    assert S.radius_join(a, b, 2.0, inclusive=False).count() == 0


def test_nearest_ties_go_to_smallest_id(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(9, 1.0, 0.0), (4, -1.0, 0.0)], "rid long, rx double, ry double")
    assert S.nearest_within(S.radius_join(a, b, 2.0), ["id"], "rid", []).first()["rid"] == 4


def test_nearest_pruned_is_exact_at_any_distance(spark):
    left, right, a, b = scene(spark, seed=8)
    a, b = a.withColumn("k", F.lit(1)), b.withColumn("k", F.lit(1))
    d = F.sqrt((F.col("rx") - F.col("x")) * (F.col("rx") - F.col("x")) + (F.col("ry") - F.col("y")) * (F.col("ry") - F.col("y")))
    block = F.struct(F.floor("rx").alias("u"), F.floor("ry").alias("v"))
    got = {r["id"]: r["rid"] for r in S.nearest_pruned(a, b, ["k"], ["id"], "rid", block, ("rx", "ry", "rx", "ry"), d, []).collect()}
    want = {i: min((math.sqrt((u - x) * (u - x) + (v - y) * (v - y)), j) for j, u, v in right)[1] for i, x, y in left}
    assert got == want


def test_geo_join_matches_haversine_at_high_latitude(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(60, 71), rng.uniform(-150, -148)) for i in range(150)]
    a = spark.createDataFrame(pts, "id long, lat double, lon double")
    b = a.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    d = frames.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    got = {(r["id"], r["rid"]) for r in S.geo_radius_join(a, b, 40.0, d, tile_rows=11).collect()}

    def hav(p, q):
        p1, p2 = math.radians(p[1]), math.radians(q[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    assert got == {(p[0], q[0]) for p in pts for q in pts if hav(p, q) <= 40.0}


def ring(points, ring_no, key=1):
    return [(key, 0, ring_no, i, *p, *points[(i + 1) % len(points)]) for i, p in enumerate(points)]


def test_point_in_polygon_honours_holes_and_boundary_distance(spark):
    rows = ring([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 0) + ring([(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], 1)
    edges = spark.createDataFrame([r[:3] + (i,) + r[4:] for i, r in enumerate(rows)], "k int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 2.0, 2.0), (1, 3, 5.0, 2.0), (1, 4, 3.5, 2.0)], "k int, id int, x double, y double")
    assert {r["id"] for r in S.points_inside(pts, edges, ["k"], ["id"], 0.5).collect()} == {1, 4}
    d = {r["id"]: r["d_edge"] for r in S.boundary_distance(pts, edges, ["k"], ["id"], F.floor(F.col("seq") / 2)).collect()}
    assert d == {1: 0.5, 2: 1.0, 3: 1.0, 4: 0.5}


def test_points_in_boxes_lists_wide_boxes(spark):
    pts = spark.createDataFrame([(1, 0.1, 0.1), (2, 1.9, 0.9), (3, 2.1, 0.5)], "id int, lon double, lat double")
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 1.0)], "b string, west double, south double, east double, north double")
    assert {r["id"] for r in S.points_in_boxes(pts, boxes).collect()} == {1, 2}
