"""Containment is looked up on arrays: no row per pair of point and box."""

import math
import random

from emberline.operators import perimeters as P


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_containment_is_that_of_the_largest_box(spark):
    rng = random.Random(5)
    acres = [None, float("nan"), 10.0, 20.0, 30.0]
    # Many boxes are in no point's reach, and the wide ones lie in several tiles.
    rows = [(i, rng.choice(acres[2:]), rng.choice([None, 5.0, 90.0]), rng.choice([True, False, None]), w, s, w + rng.choice([0.01, 0.6]), s + 0.01)
            for i in range(900) for w, s in [(-122 + rng.random() * 3, 38 + rng.random() * 3)]]
    rows += [(2000, None, 1.0, True, -110.0, 30.0, -109.9, 30.1), (2001, float("nan"), 2.0, False, -110.0, 31.0, -109.9, 31.1), (2002, 9.0, 3.0, True, -110.0, 31.0, -109.9, 31.1)]
    pts = [(i, 38 + rng.random() * 3, -122 + rng.random() * 3) for i in range(50)] + [(100, 30.05, -109.95), (101, 31.05, -109.95), (102, 0.0, 0.0), (None, 38.5, -121.5)]
    perims = spark.createDataFrame(rows, "perim_id bigint, acres double, pct_contained double, ended boolean, west double, south double, east double, north double")
    out = P.containment_status(perims, spark.createDataFrame(pts, "fire bigint, lat double, lon double"))
    assert "CoGroup" in planned(out)
    size = lambda r: -1.0 if r[1] is None else math.inf if math.isnan(r[1]) else r[1]
    want = {}
    for fire, lat, lon in pts:
        met = [r for r in rows if fire is not None and r[4] <= lon + 0.06 and r[6] >= lon - 0.06 and r[5] <= lat + 0.06 and r[7] >= lat - 0.06]
        best = max(met, key=lambda r: (size(r), -r[0]), default=(0, 0, None, None))
        want[fire] = (best[2], best[3])
    assert {r["fire"]: (r["pct_contained"], r["ended"]) for r in out.collect()} == want
    assert want[100] == (1.0, True) and want[101] == (2.0, False)
