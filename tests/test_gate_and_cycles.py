"""Late rows leave with a reason, cycles are kept once, and feed polls over several files equal one batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.streaming import cycles as Y
from emberline.streaming import gate as Q
from emberline.streaming import jobs as J

START = datetime(2024, 1, 1)


def landed(spark, df, folder, part, files):
    for k in range(files):
        df.where(part == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    schema = df.drop("part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_kept_and_rejected_are_all_rows(spark, tmp_path):
    rng, rows = random.Random(2), []
    for k in range(300):
        t = START + timedelta(hours=rng.randrange(240))
        lat = 38.0 + (rng.randrange(3) if k % 2 else 0) / 10  # half of all rows lie in one tile
        rows.append((k, t if k % 17 else None, lat, -122.0 + rng.randrange(40) / 1000, (-1.0, float("nan"), None, 5.0)[k % 4] if k % 11 == 0 else 5.0, rng.randrange(6)))
    rows += [(1000 + k, *r[1:]) for k, r in enumerate(rows[:40])]
    df = spark.createDataFrame(rows, "det_id bigint, acq timestamp, lat double, lon double, frp double, part int")
    source = landed(spark, df, tmp_path / "in", F.col("part"), 6)
    Q.gate_writer(Q.gated_detections(source, "2 days"), f"{tmp_path}/kept", f"{tmp_path}/rejected").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    kept = {r.det_id: r for r in spark.read.parquet(f"{tmp_path}/kept").collect()}
    rejected = {r.det_id: r.reject_reason for r in spark.read.parquet(f"{tmp_path}/rejected").collect()}
    assert kept.keys() | rejected.keys() == {r[0] for r in rows} and not kept.keys() & rejected.keys()
    mark, seen, want = datetime.min, set(), {}
    for part in range(6):  # files come in this order; the watermark moves between them
        mine = sorted((r for r in rows if r[5] == part), key=lambda r: (r[1] or datetime.max, r[0]))
        for i, t, lat, lon, frp, _ in mine:
            place = (t, round(lat, 4), round(lon, 4))
            if t is None:
                want[i] = Q.UNTIMED
            elif frp is not None and not frp >= 0:
                want[i] = Q.BAD
            elif t < mark:
                want[i] = Q.LATE
            elif place in seen:
                want[i] = Q.COPY
            else:
                seen.add(place)
        mark = max([mark, *(r[1] - timedelta(days=2) for r in mine if r[1] is not None)])
    assert rejected == want and Q.LATE in want.values() and Q.COPY in want.values()


def cycle_rows(spark, epoch):
    rng = random.Random(epoch)
    return spark.createDataFrame([(k % 7, float(100 * rng.randrange(50)), epoch * 100 + k, float(k)) for k in range(20)], "fire bigint, t double, seq bigint, pred_acres double")


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "c")
    job = lambda df: df.withColumn("pred_acres", F.col("pred_acres") * 2)
    assert Y.latest_cycles(spark, folder) is None and Y.cycle_history(spark, folder) is None
    for epoch in range(4):
        Y.keep_cycle(cycle_rows(spark, epoch), epoch, folder, job)
    state = lambda: [sorted(map(tuple, df.collect())) for df in (Y.latest_cycles(spark, folder), Y.cycle_history(spark, folder), Y.cycle_history(spark, folder, "inputs"))]
    before = state()
    Y.keep_cycle(cycle_rows(spark, 3), 3, folder, job)  # the engine runs the last batch again
    assert state() == before and Y.committed(spark, f"{folder}/latest") == [2, 3]
    every = [r for e in range(4) for r in cycle_rows(spark, e).collect()]
    newest = {}
    for r in every:
        newest[r.fire] = max(newest.get(r.fire, (-1.0,)), (r.t, r.seq, 2 * r.pred_acres))
    assert {r.fire: (r.t, r.seq, r.pred_acres) for r in Y.latest_cycles(spark, folder).collect()} == newest
    assert len(before[1]) == len(before[2]) == 80
    again = Y.replay_cycle(spark, folder, 1, job)
    assert sorted(map(tuple, again.collect())) == sorted(r[:-1] for r in before[1] if r[-1] == 1)


def test_a_cycle_cut_short_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "c")
    Y.keep_cycle(cycle_rows(spark, 0), 0, folder)

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        Y.keep_cycle(cycle_rows(spark, 1), 1, folder, fails)
    assert Y.cycle_history(spark, folder).count() == 20 and Y.cycle_history(spark, folder, "inputs").count() == 20
    Y.keep_cycle(cycle_rows(spark, 1), 1, folder)
    assert Y.cycle_history(spark, folder).count() == 40


def test_stream_of_polls_equals_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for poll in range(5):
        for icao in ("a1", "b2", "c3"):
            for feed in rng.sample(["x", "y", "z", "other"], 3):
                rows.append((icao, feed, len(rows), START + timedelta(minutes=poll, seconds=rng.randrange(60)), rng.choice(["TANKER7", "N1"]), 38.0, -122.0,
                             float(rng.randrange(100, 900)), float(rng.randrange(120)), rng.choice(["geo", "baro"]), rng.random() < 0.1, rng.randrange(4)))
    ddl = "icao string, feed string, seq int, ts timestamp, callsign string, lat double, lon double, alt_m double, spd_ms double, alt_source string, on_ground boolean, part int"
    df = spark.createDataFrame(rows, ddl)
    fleet = spark.createDataFrame([("a1", "op", "m", "helitanker_x")], "icao24 string, operator string, model string, role string")
    settings = spark.createDataFrame([("b2", 30.1)], "icao string, altim_inhg double")
    job = lambda s: J.stream_tracks(s, fleet, settings, ["x", "y", "z"], F.lit(20.0), late="1 hour")
    cols = ["icao", "feed", "seq", "agl_m", "registry_role", "drop", "kind"]
    got = sorted(map(tuple, J.drain_closed(job, landed(spark, df, tmp_path / "s", F.col("part"), 4), "ts", "icao").select(*cols).collect()), key=str)
    want = []
    for poll in range(5):
        here = df.drop("part").where((F.col("ts") >= F.lit(START + timedelta(minutes=poll))) & (F.col("ts") < F.lit(START + timedelta(minutes=poll + 1))))
        want += map(tuple, J.track_batch(here, fleet, settings, ["x", "y", "z"], F.lit(20.0)).select(*cols).collect())
    assert got == sorted(want, key=str) and len(got) > 5
