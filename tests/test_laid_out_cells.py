"""Tables with a row per cell are joined by shuffle: collected for a broadcast, a lattice fills the driver."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from emberline.operators import belief as B
from emberline.operators import cells as C
from emberline.operators import field as M

SIDE = 40.0


@pytest.fixture(scope="module")
def step(spark):
    grid = spark.createDataFrame(
        [(f, 0, -SIDE, -SIDE, 0.25, int(8 * SIDE), int(8 * SIDE), -1.0, 1.0, -1.0, 1.0) for f in (1, 2)],
        "fire bigint, step int, x0 double, y0 double, grid_km double, nx bigint, ny bigint, bx0 double, bx1 double, by0 double, by1 double",
    )

    def square(h):
        corners = [(-h, -h), (h, -h), (h, h), (-h, h)]
        rows = [(f, 0, 0, 0, i, *a, *b) for f in (1, 2) for i, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1]))]
        return spark.createDataFrame(rows, "fire bigint, step int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")

    return SimpleNamespace(grid=grid, base=square(1.0), target=square(1.4))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lattice_is_not_broadcast(step):
    cells = M.prediction_cells(step.grid, step.base)
    assert "Broadcast" not in planned(cells)
    assert "Broadcast" not in planned(M.label_cells(cells, step.target))
    got = {(r["fire"], r["ix"], r["iy"]) for r in cells.select("fire", "ix", "iy").collect()}
    n = int(8 * SIDE)
    mid = lambda i: -SIDE + (i + 0.5) * 0.25
    assert got == {(f, i, j) for f in (1, 2) for i in range(n) for j in range(n) if not (abs(mid(i)) < 1 and abs(mid(j)) < 1)}
    labels = M.label_cells(cells, step.target).where("label = 1")
    assert labels.count() == 2 * sum(1 for i in range(n) for j in range(n) if abs(mid(i)) < 1.4 and abs(mid(j)) < 1.4 and not (abs(mid(i)) < 1 and abs(mid(j)) < 1))


def test_too_few_cells_outside_the_base_give_no_grid(spark, step):
    small = step.grid.withColumns({"x0": F.lit(-1.0), "y0": F.lit(-1.0), "nx": F.when(F.col("fire") == 1, 9).otherwise(10).cast("bigint"), "ny": F.when(F.col("fire") == 1, 8).otherwise(9).cast("bigint")})
    got = M.prediction_cells(small, step.base).groupBy("fire").count().collect()
    assert [tuple(r) for r in got] == [(2, 26)]


def test_grid_meets_facts_before_it_is_laid_out(spark):
    grid = B.belief_grid(spark.createDataFrame([(1, -120.03, 38.0, -119.97, 38.06)], "fire bigint, west double, south double, east double, north double"))
    winds = spark.createDataFrame([(1, 90.0)], "fire bigint, bearing double")
    shapes = spark.createDataFrame([(1, 38.03, -120.0, 1.0, 0.5, 90.0, 0.2)], "fire bigint, elat double, elon double, semilong double, semishort double, bearing double, shift_km double")
    wind = planned(B.direction_contribution(winds, grid, "wind", 0.5))
    assert wind.index("Generate") < wind.index("Join")  # printed from the result down: the join lies below
    ellipse = planned(B.ellipse_cells(shapes, grid))
    assert ellipse.index("Generate") < ellipse.index("Join")
    plain = B.ellipse_cells(shapes, B.grid_cells(grid))
    assert "Broadcast" not in planned(plain)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, B.ellipse_cells(shapes, grid).collect())) != []


def test_cell_sets_are_not_broadcast(spark):
    a = spark.range(1000).selectExpr("1 AS fire", "id % 50 AS ix", "id DIV 50 AS iy")
    b = spark.range(1000).selectExpr("1 AS fire", "id % 40 AS ix", "id DIV 40 AS iy")
    x, y = ({(i % w, i // w) for i in range(1000)} for w in (50, 40))
    for op, want in ((C.intersect, x & y), (C.subtract, x - y)):
        out = op(a, b, ["fire"])
        assert "Broadcast" not in planned(out)
        assert {(r["ix"], r["iy"]) for r in out.collect()} == want
