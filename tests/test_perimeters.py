import math
import random

from pyspark.sql import functions as F

from emberline.operators import perimeters as P


def quick(a, b):
    return math.hypot((a[2] - b[2]) * 111.0, (a[3] - b[3]) * 111.0 * math.cos(math.radians(a[2])))


def greedy(rows, km):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if r[2] is None or not any(k[2] is not None and quick(r, k) < km for k in kept):
            kept.append(r)
    return {k[0] for k in kept}


def run(spark, rows):
    df = spark.createDataFrame(rows, "perim_id long, t double, clat double, clon double")
    return {r["perim_id"] for r in P.cluster_dedup(df, 2.0).collect()}


def test_chain_keeps_third(spark):
    step = 1.5 / 111.0
    rows = [(1, 30.0, 38.0, -120.0), (2, 20.0, 38.0 + step, -120.0), (3, 10.0, 38.0 + 2 * step, -120.0), (4, 5.0, None, None)]
    assert run(spark, rows) == {1, 3, 4}


def test_random_scene_and_pile_of_copies_match_greedy(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.randint(0, 50)), rng.uniform(38, 38.15), rng.uniform(-120.15, -120)) for i in range(160)]
    rows += [(500 + i, float(i), 38.05, -120.05) for i in range(150)]
    assert run(spark, rows) == greedy(rows, 2.0)


def test_fusion_is_strict_at_three_km(spark):
    at = lambda km: 38.0 + km / 111.0
    cols = "perim_id long, acres double, clat double, clon double"
    a = spark.createDataFrame([(1, 5.0, 38.0, -120.0), (9, 5.0, None, None)], cols)
    b = spark.createDataFrame([(2, 1.0, at(2.99), -120.0), (3, 1.0, at(3.01), -120.0), (4, 1.0, None, None)], cols)
    assert {r["perim_id"] for r in P.perimeter_fusion(a, b).collect()} == {1, 9, 3, 4}


def test_active_gate_and_timestamp(spark):
    f = spark.createDataFrame([(1, 900.0, 89.0, False), (2, 800.0, 90.0, False), (3, 700.0, None, False), (4, 600.0, None, True)], "perim_id long, acres double, pct_contained double, ended boolean")
    assert [r["perim_id"] for r in P.active_fires(f).collect()] == [1, 3]
    t = spark.createDataFrame([(5.0, 1.7e12), (None, None)], "a double, b double")
    got = P.perimeter_timestamp(t, ["a", "b"]).select(F.unix_seconds("t_map")).collect()
    assert [r[0] for r in got] == [1700000000, None]
