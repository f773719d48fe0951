import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions.ordered import exact_quantiles, neighbours, top_n


def rows(spark, n=400):
    rng = np.random.default_rng(2)
    # one key owns most rows
    data = [(int(rng.integers(0, 3)) if i % 4 == 0 else 0, int(rng.integers(0, 5000)), i, float(rng.integers(0, 40))) for i in range(n)]
    return data, spark.createDataFrame(data, "k int, t int, id int, v double")


def test_neighbours_and_runs_match_plain_windows(spark):
    _, df = rows(spark)
    big = lambda r, p: (r["v"] > 20) & (p.isNull() | ~(p["v"] > 20))
    got = neighbours(df, ["k"], ["t", "id"], ["v"], F.floor(F.col("t") / 70), following=True, starts=big)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumns({"p": F.lag("v").over(w), "n": F.lead("v").over(w)})
    want = want.withColumn("run", F.sum(((F.col("v") > 20) & (F.col("p").isNull() | ~(F.col("p") > 20))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = lambda r: r["id"]
    a = [(r["id"], r["prev_v"], r["next_v"], r["run"]) for r in sorted(got.collect(), key=key)]
    b = [(r["id"], r["p"], r["n"], r["run"]) for r in sorted(want.collect(), key=key)]
    assert a == b


def test_exact_quantiles_match_linear_interpolation(spark):
    data, df = rows(spark)
    got = {r["k"]: (r["q1"], r["q2"], r["q3"]) for r in exact_quantiles(df, ["k"], "v", {"q1": 0.5, "q2": 0.9, "q3": 0.0}, slots=8).collect()}
    for k in {d[0] for d in data}:
        v = [d[3] for d in data if d[0] == k]
        assert np.allclose(got[k], [np.percentile(v, 50), np.percentile(v, 90), min(v)])


def test_top_n_equals_full_sort(spark):
    data, df = rows(spark)
    got = {(r["k"], r["id"]) for r in top_n(df, ["k"], [F.desc("v"), F.col("id")], 7, F.col("id"), parts=5).collect()}
    want = set()
    for k in {d[0] for d in data}:
        want |= {(k, d[2]) for d in sorted((d for d in data if d[0] == k), key=lambda d: (-d[3], d[2]))[:7]}
    assert got == want
