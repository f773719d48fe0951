"""Cut points and slots of exact quantiles have rows per key: with many keys they must not be collected on the driver."""

import numpy as np
from pyspark.sql import functions as F

from emberline.functions.ordered import exact_quantiles


def test_quantiles_of_many_keys_broadcast_nothing(spark):
    rows = [(k, float(k * 31 + i * i * 7 % 53)) for k in range(60) for i in range(1 + k % 9)] + [(60, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3, F.rand(1))
    out = exact_quantiles(df, ["k"], "v", {"mid": 0.5, "p90": 0.9}, slots=4)
    got = {r["k"]: (r["mid"], r["p90"]) for r in out.collect()}
    assert sorted(got) == list(range(60))
    for k, (mid, p90) in got.items():
        np.testing.assert_allclose((mid, p90), np.quantile([v for q, v in rows if q == k], (0.5, 0.9)))
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
