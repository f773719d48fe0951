"""Work on pairs as matrix products by block: against brute force, across blocks and shares, with no row per pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import belief as B
from emberline.operators import spatial as S
from emberline.operators import weather as W


def test_idw_across_shares_against_brute_force(spark):
    rng = random.Random(5)
    cells = [(i, rng.uniform(36, 42), rng.uniform(-124, -118)) for i in range(60)] + [(60, 70.0, 10.0), (61, None, -120.0)]
    stations = [(rng.uniform(37, 41), rng.uniform(-123, -119), rng.choice([None, rng.uniform(-5, 5)]), rng.uniform(-5, 5), rng.choice([None, rng.uniform(40, 90)]), rng.choice([None, rng.uniform(5, 90)])) for _ in range(40)]
    c = spark.createDataFrame(cells, "cell int, lat double, lon double")
    s = spark.createDataFrame(stations, "lat double, lon double, u double, v double, temp_f double, rh double")
    one = F.lit(1.0)
    right = s.select(F.col("lon").alias("rx"), F.col("lat").alias("ry"), one.alias("sx"), one.alias("sy"), "u", "temp_f")
    for block in (3, 10_000):
        sums = S.inverse_distance_sums(c.select("cell", "lon", "lat"), right, ["cell"], ["u", "temp_f"], 1.5, 0.001, 2.0, block=block)
        got = {r["cell"]: (r["__w"], r["u"], r["temp_f"]) for r in sums.collect()}
        for cell, lat, lon in cells:
            near = [(1 / max(math.hypot(y - lat, x - lon), 0.001) ** 2, u, t) for y, x, u, _, t, _ in stations if lat is not None and math.hypot(y - lat, x - lon) < 1.5]
            assert (cell in got) == bool(near)
            if near:
                assert got[cell][0] == pytest.approx(sum(w for w, _, _ in near))
                for k in (1, 2):
                    some = [row[0] * row[k] for row in near if row[k] is not None]
                    assert (got[cell][k] is None and not some) or got[cell][k] == pytest.approx(sum(some), abs=1e-9)
    out = W.idw(c, s, ["cell"])
    assert out.count() == len(cells)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_elongate_across_blocks_against_brute_force(spark):
    rng = random.Random(3)
    field = {(f, rng.randrange(-40, 60), rng.randrange(-40, 60)): rng.uniform(0.1, 1.0) for f in (1, 2, 3) for _ in range(60)}
    winds = {1: [(30.0, 3.0)], 2: [(200.0, 1.0), (80.0, 2.0)]}  # fire 3 has no wind: no rows
    df = spark.createDataFrame([(*k, v) for k, v in field.items()], "fire bigint, ix bigint, iy bigint, p double")
    wf = spark.createDataFrame([(f, b, lb) for f, rows in winds.items() for b, lb in rows], "fire bigint, bearing double, lb double")
    want = {}
    for f, rows in winds.items():
        kern = {}
        for bearing, lb in rows:
            b, va = math.radians(bearing), (1 + 1.2 * min(lb - 1, 3)) ** 2 + 0.49
            for dx in range(-19, 20):
                for dy in range(-19, 20):
                    q = (dx * math.sin(b) + dy * math.cos(b)) ** 2 / va + (dx * math.cos(b) - dy * math.sin(b)) ** 2 / 1.49
                    if q <= 16:
                        kern[dx, dy] = kern.get((dx, dy), 0.0) + math.exp(-0.5 * q)
        total = sum(kern.values())
        s = {(x, y): sum(field.get((f, x - dx, y - dy), 0.0) * k / total for (dx, dy), k in kern.items()) for g, x, y in field if g == f}
        peak = max(v for (g, _, _), v in field.items() if g == f)
        want |= {(f, *xy): v / max(s.values()) * peak for xy, v in s.items()}
    for block in (16, 128):
        out = B.elongate(df, wf, block=block)
        got = {(r["fire"], r["ix"], r["iy"]): r["p"] for r in out.collect()}
        assert got == pytest.approx(want)


def test_wedges_of_a_grid_shuffle_no_cells_of_a_fire_with_one_wedge(spark):
    boxes = spark.createDataFrame([(f, -120.03, 38.0, -119.97, 38.06) for f in (1, 2)], "fire bigint, west double, south double, east double, north double")
    w = [(1, 37.93, -120.05, 10.0, 30.0, 12.0, 38.03, -120.0), (2, 37.93, -120.05, 10.0, 30.0, 12.0, 38.03, -120.0), (2, 37.93, -120.05, 15.0, 40.0, 12.0, 38.03, -120.0)]
    wedges = spark.createDataFrame(w, "fire bigint, lat double, lon double, left_deg double, right_deg double, range_km double, olat double, olon double")
    grid = B.belief_grid(boxes)
    got = sorted(map(tuple, B.camera_wedge_cells(wedges, grid).collect()))
    assert got == sorted(map(tuple, B.camera_wedge_cells(wedges, B.grid_cells(grid)).collect()))
    assert len(got) == len(set(got)) and {r[0] for r in got} == {1, 2}
    plan = B.camera_wedge_cells(wedges.where("fire = 1"), grid)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.index("Union"):plan.index("Generate")]
    assert "Exchange" not in first and "Aggregate" not in first  # from the union down to the layout
