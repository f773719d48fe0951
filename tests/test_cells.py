import random

from emberline.operators import cells as C


def cells(spark, pts, k=1):
    return spark.createDataFrame([(k, x, y) for x, y in pts], "k int, ix long, iy long")


def as_set(df):
    return {(r["ix"], r["iy"]) for r in df.collect()}


def test_morphology_matches_definition(spark):
    rng = random.Random(1)
    s = {(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(130)}
    for r in (1.0, 2.0, 2.5):
        disc = C.disc_offsets(r)
        grown = {(x + a, y + b) for x, y in s for a, b in disc}
        assert as_set(C.dilate(cells(spark, s), ["k"], r)) == grown
        shrunk = {p for p in s if all((p[0] + a, p[1] + b) in s for a, b in disc)}
        assert as_set(C.erode(cells(spark, s), ["k"], r)) == shrunk


def test_components_and_stray_parts(spark):
    a = [(0, 0), (1, 0), (1, 1)]
    b = [(10, 10), (11, 10)]
    diag = [(2, 2)]
    df = cells(spark, a + b + diag)
    assert C.components(df, ["k"]).select("comp").distinct().count() == 3
    parts = C.components(df, ["k"], eight=True)
    assert parts.select("comp").distinct().count() == 2
    base = cells(spark, [(0, 0)])
    dets = spark.createDataFrame([(1, 10, 10, s) for s in ("VIIRS", "VIIRS", "VIIRS")], "k int, ix long, iy long, sensor string")
    assert as_set(C.drop_stray(parts, base, dets, ["k"], 1.0)) == set(a + diag)
    more = spark.createDataFrame([(1, 10, 10, s) for s in ("VIIRS", "VIIRS", "VIIRS", "GOES-18")], "k int, ix long, iy long, sensor string")
    assert as_set(C.drop_stray(parts, base, more, ["k"], 1.0)) == set(a + diag + b)


def test_growth_metrics_counts(spark):
    m = C.growth_metrics(cells(spark, [(0, 0)]), cells(spark, [(0, 0), (1, 0), (2, 0)]), cells(spark, [(1, 0), (5, 5)]), ["k"], 1.0).first()
    assert abs(m["growth_iou"] - 1 / 3) < 1e-12
