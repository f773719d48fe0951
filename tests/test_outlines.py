"""Outlines of cell sets: closed rings that enclose the cells, on either side of tile borders."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberline.operators.outlines import multipolygons, rings
from emberline.sources.sinks import outline_feature


def area2(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax:
            odd = not odd
    return odd


def scene(seed):
    rng = random.Random(seed)
    cells = {("a", x, y) for x in range(-9, 14) for y in range(-7, 9) if rng.random() < 0.55}
    cells |= {("b", x, y) for x in range(20) for y in range(20) if max(abs(x - 10), abs(y - 10)) in (3, 4, 8)}  # rings in rings
    cells |= {("c", 0, 0), ("c", 1, 1), ("c", 2, 0), (None, 5, 5), ("d", 3, 3)}
    return cells | {("e", x, 0) for x in range(150)}


@pytest.mark.parametrize("tile", [3, 64])
def test_outlines_enclose_exactly_the_cells(spark, tile):
    cells = scene(tile)
    df = spark.createDataFrame([*cells, ("d", 3, 3)], "fire string, ix int, iy int")
    got = {r.fire: r.coordinates for r in multipolygons(df, ["fire"], lambda x, y: (x, y), tile).collect()}
    want = defaultdict(set)
    for f, x, y in cells:
        want[f].add((x, y))
    assert got.keys() == want.keys() - {None}
    for f, shape in got.items():
        every = [r for polygon in shape for r in polygon]
        assert all(r[0] == r[-1] and len(r) >= 5 for r in every)
        assert all(area2(p[0]) > 0 and all(area2(h) < 0 for h in p[1:]) for p in shape)
        assert sum(map(area2, every)) == 2 * len(want[f])
        for x in range(-12, 24):
            for y in range(-10, 24):
                hits = sum(inside(p[0], x + 0.5, y + 0.5) and not any(inside(h, x + 0.5, y + 0.5) for h in p[1:]) for p in shape)
                assert hits == ((x, y) in want[f])
    assert len(got["c"]) == 3 and len(got["e"][0][0]) == 5


def test_ring_order_and_empty_set(spark):
    df = spark.createDataFrame([("a", x, y) for x in range(9) for y in range(9) if (x + y) % 3], "fire string, ix int, iy int")
    by_ring = defaultdict(list)
    for r in rings(df, ["fire"], 2).collect():
        by_ring[r.ring].append((r.seq, (r.x, r.y), (r.x2, r.y2)))
    for seg in by_ring.values():
        seg.sort()
        assert [s[0] for s in seg] == list(range(len(seg)))
        assert all(a[2] == b[1] for a, b in zip(seg, seg[1:] + seg[:1]))
    assert multipolygons(df.limit(0), ["fire"], lambda x, y: (x, y)).count() == 0


def test_one_feature_per_perimeter(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 2, 0), (2, 5, 5)], "fire int, ix int, iy int")
    rows = outline_feature(df, ["fire"], lambda x, y: (F.lit(-122.0) + x * 0.01, F.lit(38.0) + y * 0.01)).collect()
    shapes = {r.fire: json.loads(r.value) for r in rows}
    assert len(rows) == 2 and shapes[1]["type"] == "Feature" and shapes[1]["properties"] == {"fire": 1}
    assert shapes[1]["geometry"]["type"] == "MultiPolygon" and len(shapes[1]["geometry"]["coordinates"]) == 2
    assert shapes[2]["geometry"]["coordinates"][0][0][0] == [-121.95, 38.05]
