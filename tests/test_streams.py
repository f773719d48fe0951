"""Streams over several files in shuffled order give the answer of one ordered pass."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.streaming import jobs as J
from emberline.streaming import stateful as T

START = datetime(2024, 1, 1)


def as_stream(spark, df, folder, files=6):
    """The rows dealt at random to files that arrive in no order, one per trigger."""
    parts = df.withColumn("__f", F.pmod(F.xxhash64(*df.columns), F.lit(files))).collect()
    for k in random.Random(3).sample(range(files), files):
        rows = [tuple(r)[:-1] for r in parts if r["__f"] == k]
        spark.createDataFrame(rows, df.schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_cycle_alerts_over_shuffled_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k % 3, START + timedelta(minutes=7 * k), k, 1000.0 + rng.random() * 500 + (900000 if k == 31 else 0)) for k in range(60)]
    df = spark.createDataFrame(rows, "fire bigint, ts timestamp, seq bigint, pred_acres double").withColumn("t", F.unix_micros("ts") / F.lit(1e6))
    out = J.drain_closed(lambda c: T.stream_cycle_alerts(c, "1 day"), as_stream(spark, df, tmp_path / "s"), "ts", "fire").collect()
    before = F.lag("pred_acres").over(Window.partitionBy("fire").orderBy("t", "seq"))
    want = {r.seq: r.d for r in df.withColumn("d", F.col("pred_acres") - before).collect()}
    assert {r.seq: r.delta_acres for r in out} == want
    assert [r.seq for r in out if r.physics_alert] == [31]


def test_drop_runs_over_shuffled_files(spark, tmp_path):
    low, high = 50.0, 500.0
    track = [(1, k, low if k % 5 in (1, 2) else high) for k in range(20)] + [(2, k, low) for k in range(4)]
    rows = [(i, START + timedelta(seconds=30 * k), 100 * i + k, agl, 60.0, False) for i, k, agl in track]
    df = spark.createDataFrame(rows, "icao bigint, ts timestamp, pt bigint, agl_m double, spd_ms double, heli boolean").withColumn("t", F.unix_micros("ts") / F.lit(1e6))
    out = J.drain_closed(lambda s: T.stream_drop_runs(s, gap_s=600.0, late="1 day"), as_stream(spark, df, tmp_path / "s"), "ts", "icao").collect()
    t = lambda k: START.timestamp() + 30 * k
    got = sorted((r.icao, r.hits, r.t0, r.t1) for r in out)
    want = sorted([(1, 2, t(5 * b + 1), t(5 * b + 2)) for b in range(4)] + [(2, 4, t(0), t(3))])
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs((g[3] - g[2]) - (w[3] - w[2])) < 1e-6 for g, w in zip(got, want))
