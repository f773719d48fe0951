"""Structured Streaming forms of the detection, track, health and cycle jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from emberline.functions import frames
from emberline.operators import aircraft as A
from emberline.operators import detections as D
from emberline.session import checkpoint_root


def stream_detections(raw: DataFrame, cutoff_delay: str = "1 day") -> DataFrame:
    """Valid detections, first copy per rounded place and time within the watermark."""
    ok = raw.where(
        F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & D.finite(F.coalesce("frp", F.lit(0.0))) & (F.coalesce("frp", F.lit(0.0)) >= 0)
    )
    keyed = ok.withColumns({"k_lat": F.bround("lat", 4), "k_lon": F.bround("lon", 4)})
    return keyed.withWatermark("acq", cutoff_delay).dropDuplicatesWithinWatermark(["k_lat", "k_lon", "acq"]).drop("k_lat", "k_lon")


def split_rejects(batch: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """Late and invalid rows go to their own sink with a reason; unknown times are never imputed."""
    judged = D.judge_cutoff(batch, cutoff)
    return judged.where(F.col("reject_reason").isNull()).drop("reject_reason"), judged.where(F.col("reject_reason").isNotNull())


def detection_writer(raw: DataFrame, cutoff, kept_path: str, reject_path: str) -> DataStreamWriter:
    def write(batch: DataFrame, epoch: int) -> None:
        kept, rejected = split_rejects(batch, cutoff)
        kept.write.mode("overwrite").parquet(f"{kept_path}/epoch={epoch}")
        rejected.write.mode("overwrite").parquet(f"{reject_path}/epoch={epoch}")

    return raw.writeStream.foreachBatch(write)


def track_batch(states: DataFrame, fleet: DataFrame, altimeters: DataFrame, priority: list[str], ground_m) -> DataFrame:
    """One poll: merge feeds, look up the registry, correct altitude, flag drops.

    ``altimeters``: (icao, altim_inhg), the nearest setting per aircraft, possibly missing.
    """
    return classify_states(A.multi_feed_merge(states, priority), fleet, altimeters, ground_m)


def classify_states(merged: DataFrame, fleet: DataFrame, altimeters: DataFrame, ground_m) -> DataFrame:
    """Airborne fire aircraft of merged states, with registry entry, corrected altitude and drop flag; joins with static tables only."""
    side = altimeters.select(F.col("icao").alias("__i"), "altim_inhg")
    rows = A.registry_lookup(merged.where(~F.col("on_ground")), fleet).join(side, F.col("icao") == F.col("__i"), "left").drop("__i")
    rows = A.baro_to_msl(rows).withColumn("agl_m", F.col("alt_m") - ground_m)
    fire = rows.where(F.col("registry_role").isNotNull() | A.fire_callsign(F.col("callsign")))
    return A.instant_drop_flag(fire)


def stream_tracks(states: DataFrame, fleet: DataFrame, altimeters: DataFrame, priority: list[str], ground_m, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Polls of several feeds as a stream: per aircraft and poll window the best feed, then as in ``track_batch``.

    ``states``: (icao, feed, seq, ts, callsign, lat, lon, alt_m, spd_ms, alt_source, on_ground). The state of an aircraft and
    window is one row, the best so far by feed and ``seq``; it leaves when the watermark passes the window, so
    feeds may come in any order. Registry and altimeter settings are static tables of the trigger.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("feed"))
    cols = [c for c in states.columns if c not in ("icao", "seq", "feed")]
    best = F.min(F.struct(rank.alias("p"), "seq", "feed", *cols)).alias("r")
    # A row without an aircraft only moves the watermark.
    polls = states.where((rank > 0) | F.col("icao").isNull()).withWatermark("ts", late).groupBy(F.window("ts", every).alias("poll"), "icao").agg(best)
    merged = polls.select("poll", "icao", "r.feed", "r.seq", *[f"r.{c}" for c in cols])
    return classify_states(merged, fleet, altimeters, ground_m)


def stream_loitering(points: DataFrame, min_points: int = 4, max_spread_km: float = 10.0, max_spd: float = 110.0,
                     lookback: str = "20 minutes", every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Loitering over a sliding lookback; needs an event-time column ``ts``."""
    span = F.hypot(
        (F.col("lon1") - F.col("lon0")) * F.lit(frames.KM_PER_DEG) * F.cos(F.radians("mlat")), (F.col("lat1") - F.col("lat0")) * F.lit(frames.KM_PER_DEG)
    )
    agg = points.withWatermark("ts", late).groupBy(F.window("ts", lookback, every), "icao").agg(
        F.count("*").alias("n"), F.avg("lat").alias("mlat"), F.avg("spd_ms").alias("mean_spd"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"),
        F.min("lon").alias("lon0"), F.max("lon").alias("lon1"),
    ).withColumn("spread_km", span)
    slow = F.col("mean_spd").isNull() | (F.col("mean_spd") <= max_spd)
    return agg.where((F.col("n") >= min_points) & (F.col("spread_km") <= max_spread_km) & slow).select("window", "icao", "n", "spread_km")


def stream_health(log: DataFrame, lookback: str = "24 hours", every: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Rolling outcome counts per source."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return log.withWatermark("t", late).groupBy(F.window("t", lookback, every), "source").agg(
        F.count("*").alias("attempts"), n("ok"), n("no_data"), n("unavailable"), F.avg("latency_s").alias("mean_latency_s")
    )


def stream_latest_fill(pixels: DataFrame, tile_km: float = 2.0) -> DataFrame:
    """Newest pixel per tile as a running aggregate (update mode)."""
    return D.latest_fill_per_tile(pixels, tile_km)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    Output and progress live in the shared checkpoint folder; rows carry the batch number.
    """
    root = f"{checkpoint_root(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    _run(stream, root, mode)
    return stream.sparkSession.read.parquet(f"{root}/rows")


def _run(stream: DataFrame, root: str, mode: str) -> None:
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={epoch}")  # a batch that runs again replaces itself

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()


def drain_closed(job: Callable[[DataFrame], DataFrame], source: DataFrame, ts: str, key: str) -> DataFrame:
    """``drain`` of ``job(source)``, then one closing row far in the future, so that windows, frames and runs
    still open behind the watermark are released too. The closing row has no ``key`` and leaves no row.
    """
    spark: SparkSession = source.sparkSession
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    end = spark.range(1).select(*[
        (F.to_timestamp(F.lit("2200-01-01")) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema
    ])
    end.limit(0).write.parquet(f"{root}/closing/a")
    closing = spark.readStream.schema(source.schema).parquet(f"{root}/closing/*")
    out = job(source.unionByName(closing))
    _run(out, root, "append")
    end.write.parquet(f"{root}/closing/b")
    _run(out, root, "append")
    return spark.read.parquet(f"{root}/rows").where(F.col(key).isNotNull())
