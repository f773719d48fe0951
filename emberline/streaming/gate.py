"""A gate for streamed detections: every row leaves it once, kept or with the reason why not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StringType, StructType

LATE, COPY = "late", "duplicate"
BAD, UNTIMED = "invalid_record", "unknown_time"


def _judge(columns: list[str]):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() / 1000.0
        seen = set(zip(*state.get)) if state.exists else set()
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["__t", "det_id"], kind="stable")
        reasons = []
        for t, lat, lon, fault in zip(rows["__t"], rows["__lat"], rows["__lon"], rows["reject_reason"]):
            place = (t, lat, lon)
            if isinstance(fault, str):
                reasons.append(fault)
            elif t < mark:
                reasons.append(LATE)
            elif place in seen:
                reasons.append(COPY)
            else:
                seen.add(place)
                reasons.append(None)
        rows["reject_reason"] = np.array(reasons, dtype=object)
        open_ = sorted(x for x in seen if x[0] >= mark)  # what the watermark has passed can only be late
        state.update(tuple([x[k] for x in open_] for k in range(3)))
        yield rows[columns]

    return step


def gated_detections(raw: DataFrame, late: str = "1 day", tile_deg: float = 0.1, shares: int = 8) -> DataFrame:
    """The rows of ``raw`` (det_id, acq, lat, lon, frp, ...) with ``reject_reason``, NULL for those to keep.

    A row is an invalid record (coordinates out of range, a negative or non-finite power), of unknown time, late
    (acquired before the watermark when it comes), or a duplicate of a row kept before (place to four decimals
    and time). Judging and deduplication are one step, so a late row is never dropped unseen: kept and
    rejected rows are all rows. State is kept per share of a tile and holds the places seen since the watermark; a
    tile that falls idle keeps its last ones, so state is bounded by the lattice of tiles. (A state timeout in event
    time would have the engine drop late rows first, one in processing time never lets a finite run end.)
    """
    power = F.coalesce(F.col("frp"), F.lit(0.0))
    sound = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & ~F.isnan(power) & (power >= 0) & (power < float("inf"))
    fault = F.when(F.col("acq").isNull(), UNTIMED).when(~F.coalesce(sound, F.lit(False)), BAD)
    places = {"__lat": F.bround("lat", 4), "__lon": F.bround("lon", 4)}
    tile = {f"__tile{c}": F.floor(F.col(c) / tile_deg) for c in places}
    tile["__share"] = F.pmod(F.xxhash64(*places), F.lit(shares))
    judged = raw.withWatermark("acq", late).withColumns({"reject_reason": fault, "__t": F.unix_micros("acq") / F.lit(1e6), **places}).withColumns(tile)
    out = StructType([*raw.schema.fields, StructField("reject_reason", StringType())])
    return judged.groupBy(*tile).applyInPandasWithState(
        _judge(out.names), out, "t array<double>, lat array<double>, lon array<double>", "append", GroupStateTimeout.NoTimeout)


def gate_writer(gated: DataFrame, kept_path: str, reject_path: str) -> DataStreamWriter:
    """Kept and rejected rows to sinks of their own, a batch under its number, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.where("reject_reason IS NULL").drop("reject_reason").write.mode("overwrite").parquet(f"{kept_path}/epoch={epoch}")
        batch.where("reject_reason IS NOT NULL").write.mode("overwrite").parquet(f"{reject_path}/epoch={epoch}")
        batch.unpersist()

    return gated.writeStream.outputMode("append").foreachBatch(write)
