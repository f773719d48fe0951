"""Boxes, tiles and bounds of the unbounded nearest search grow with the input: none is collected on the driver."""

import math

import pytest
from pyspark.sql import functions as F

from emberline.operators import spatial as S


def nearest(spark, points, members):
    p = spark.createDataFrame(points, "fire bigint, id bigint, x double, y double")
    m = spark.createDataFrame(members, "fire bigint, mid bigint, mx double, my double")
    dx, dy = F.col("mx") - F.col("x"), F.col("my") - F.col("y")
    block = F.struct(F.floor("mx").alias("bx"), F.floor("my").alias("by"))
    return S.nearest_pruned(p, m, ["fire"], ["id"], "mid", block, ("mx", "my", "mx", "my"), F.sqrt(dx * dx + dy * dy), [])


@pytest.mark.parametrize("key_boxes", [2_000, 3])
def test_nearest_search_broadcasts_no_boxes(spark, monkeypatch, key_boxes):
    monkeypatch.setattr(S, "KEY_BOXES", key_boxes, raising=False)
    monkeypatch.setattr(S, "TILE_POINTS", 8)
    place = lambda i, a, b: (float(i * a % 97) / 7, float(i * b % 89) / 7)
    # The second fire is one place seen again and again, the third has no members.
    points = [(f, i, *place(i, 37, 61)) for f in (1, 2, 3) for i in range(150)]
    members = [(1, i, *place(i, 53, 41)) for i in range(120)] + [(2, i, 3.5, 3.5) for i in range(40)]
    out = nearest(spark, points, members)
    got = {(r["fire"], r["id"]): (r["mid"], round(r["d"], 9)) for r in out.collect()}
    want = {}
    for f, i, x, y in points:
        near = [(math.sqrt((mx - x) ** 2 + (my - y) ** 2), m) for g, m, mx, my in members if g == f]
        if near:
            d, m = min(near)
            want[f, i] = (m, round(d, 9))
    assert got == want
    if key_boxes > 1_000:  # with dense keys only the short list of them may be sent
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
