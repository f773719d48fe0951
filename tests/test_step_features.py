"""Features of cells in one pass per step: against plain loops, against the tile joins, and without shuffling a pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import field as M

CELL_DDL = "fire long, step int, ix int, iy int, x double, y double"
LOCAL_DDL = "fire long, step int, det_id long, x double, y double, frp double, tau double, viirs double, lon double, lat double"


def scene(spark, odd=False):
    rng = random.Random(11)
    cells = [(f, 0, i, j, -4 + 0.9 * i, -3 + 0.7 * j) for f in (1, 2, 3, 4) for i in range(9) for j in range(8)]
    dets = [(f, 0, 100 * f + k, round(rng.uniform(-9, 9), 1), round(rng.uniform(-9, 9), 1), None if k % 7 == 0 else float(k % 5), rng.random(), float(k % 2), 0.0, 0.0)
            for f in (1, 2, 4) for k in range(40 if f < 4 else 3)]
    dets += [(1, 0, 190 + k, -4.0, -3.0, 9.0, 0.5, 1.0, 0.0, 0.0) for k in range(3)]  # one place, on a cell's centre
    dets += [(2, 0, 290, 0.4, 0.4, 1.0, 0.1, 0.0, 0.0, 0.0), (2, 0, 289, 0.6, 0.4, 1.0, 0.2, 0.0, 0.0, 0.0), (2, 0, 291, None, 0.4, 1.0, 0.2, 0.0, 0.0, 0.0)]
    if odd:
        dets.append((2, 0, 292, 1.0, 1.0, math.nan, 0.3, 0.0, 0.0, 0.0))
    return cells, dets, spark.createDataFrame(cells, CELL_DDL), M.sites(spark.createDataFrame(dets, LOCAL_DDL))


def expected(cells, dets):
    out = {}
    for f, s, i, j, x, y in cells:
        near = sorted((math.sqrt((d[3] - x) ** 2 + (d[4] - y) ** 2), d) for d in dets if d[0] == f and d[3] is not None)
        got = {}
        for r in M.COUNT_RADII:
            inside = [d for q, d in near if q <= r]
            heat = [d[5] for d in inside if d[5] is not None]
            got |= {f"n{r}": len(inside), f"frpmax{r}": max(heat, default=0), f"frpsum{r}": sum(heat), f"tmax{r}": max((d[6] for d in inside), default=0), f"viirs{r}": sum(d[7] for d in inside)}
        got["t_first2"] = min((d[6] for q, d in near if q <= 2), default=1)
        for name, r in M.TURN_RADII:
            to = [((d[3] - x) / q, (d[4] - y) / q) for q, d in near if 1e-8 < q <= r]
            any_in = any(q <= r for q, _ in near)
            got[name] = 1 - math.hypot(sum(a for a, _ in to), sum(b for _, b in to)) / len(to) if to else float(any_in)
        out[f, i, j] = got, (min((q, d[2]) for q, d in near) if near else None)
    return out


@pytest.mark.parametrize("most", [10_000, 20, 0])
def test_features_are_those_of_plain_loops(spark, monkeypatch, most):
    monkeypatch.setattr(M, "STEP_SITES", most)  # 20: some steps whole and some by tiles; 0: all by tiles
    monkeypatch.setattr(M, "PAIRS", 100)
    cells, dets, c, s = scene(spark)
    want = expected(cells, dets)
    rows = M.radius_features(c, s).collect()
    assert len(rows) == len(cells)
    for r in rows:
        got = want[r.fire, r.ix, r.iy][0]
        assert {k: round(r[k], 9) for k in M.RADIUS_COLS} == {k: pytest.approx(got[k], abs=1e-9) for k in M.RADIUS_COLS}, (r.fire, r.ix, r.iy)
    near = {(r.fire, r.ix, r.iy): (pytest.approx(r.d_near), r.q_id) for r in M.nearest_site(c, s).collect()}
    assert near == {k: v[1] for k, v in want.items() if v[1]}
    both = M.cell_features(c, s, ["radius", "nearest"], ["n2", "q_id"])
    assert {(r.fire, r.ix, r.iy): (r.n2, r.q_id) for r in both.collect()} == {k: (v[0]["n2"], v[1][1]) for k, v in want.items() if v[1]}


def test_values_that_are_no_numbers_stay_where_they_are(spark):
    cells, _, c, s = scene(spark, odd=True)
    rows = {(r.fire, r.ix, r.iy): r for r in M.radius_features(c, s).collect()}
    for f, _, i, j, x, y in cells:
        if f == 2:
            assert math.isnan(rows[f, i, j].frpsum2) == (math.hypot(x - 1, y - 1) <= 2)


def test_no_pair_or_ring_is_shuffled(spark):
    _, _, c, s = scene(spark)
    plan = M.cell_features(c, s, ["radius", "nearest"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ring" not in plan and plan.count("SortMergeJoin") == 1
    assert "BroadcastExchange" not in plan


@pytest.mark.parametrize("most", [10_000, 0])
def test_all_features_are_the_same_whole_or_by_tiles(spark, monkeypatch, most):
    cells, dets, c, s = scene(spark)
    edges = [(f, 0, 0, 0, k, *e) for f in (1, 2) for k, e in enumerate([(-1.0, -1.0, 1.0, -1.0), (1.0, -1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0), (1.0, 1.0, -1.0, -1.0)])]
    base = spark.createDataFrame(edges, "fire long, step int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    facts = spark.createDataFrame([(f, 0, float(f)) for f in (1, 2, 3)], "fire long, step int, base_r double")
    reach = spark.createDataFrame([(1, 0, b, float(b)) for b in range(0, 72, 2)], "fire long, step int, bin int, push double")
    monkeypatch.setattr(M, "STEP_EDGES", most)
    rows = M.cell_features(c, s, ["radius", "nearest"], base=(base, facts, reach)).withColumn("bin", M.angle_bin(F.col("x"), F.col("y"))).collect()
    assert {r.fire for r in rows} == {1, 2} and len(rows) == 2 * 72  # fires 3 and 4 have no outline

    def apart(x, y):
        def one(x1, y1, x2, y2):
            n = (x2 - x1) ** 2 + (y2 - y1) ** 2
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n)) if n else 0.0
            return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

        return min(one(*e[5:]) for e in edges[:4])

    for r in rows:
        assert r.d_edge == pytest.approx(apart(r.x, r.y)) and r.d_edge_q == pytest.approx(apart(r.qx, r.qy)) and r.base_r == r.fire
        assert r.push == (float(r.bin) if r.fire == 1 and r.bin % 2 == 0 else None)
