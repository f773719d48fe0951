"""Cycles of a stream, kept exactly once: inputs, history and the newest row of every fire.

Everything of a cycle lies under its batch number and is replaced as a whole, so a batch that the engine
runs again after a failure changes nothing. A folder counts once its ``_SUCCESS`` marker is there; the
newest complete ``latest`` says up to which cycle history is valid.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from emberline.operators.health import latest_per_fire

_NAME = re.compile(r"epoch=(\d+)$")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete cycles under ``path``, ascending."""
    at, files = _folder(spark, path)
    if not files.exists(at):
        return []
    found = []
    for status in files.listStatus(at):
        name = _NAME.search(status.getPath().toString())
        if name and files.exists(_folder(spark, f"{status.getPath()}/_SUCCESS")[0]):
            found.append(int(name[1]))
    return sorted(found)


def _cycle(spark: SparkSession, folder: str, kind: str, epoch: int, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{kind}/epoch={epoch}")


def keep_cycle(batch: DataFrame, epoch: int, folder: str, job: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Keep one batch as cycle ``epoch``: its exact inputs, what ``job`` makes of them, and the newest rows so far.

    The job reads the inputs as they were written, so a cycle can be run again from them. Newest rows (by t,
    then seq) are those of the cycle before merged with this cycle's; history is never reread. Of the newest
    rows the last two versions are kept, so that a batch that runs again finds the one it started from.
    """
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{folder}/inputs/epoch={epoch}")
    inputs = _cycle(spark, folder, "inputs", epoch, batch.schema)
    made = inputs if job is None else job(inputs)
    made.write.mode("overwrite").parquet(f"{folder}/history/epoch={epoch}")
    newest = _cycle(spark, folder, "history", epoch, made.schema)
    before = [e for e in committed(spark, f"{folder}/latest") if e < epoch]
    if before:
        newest = newest.unionByName(_cycle(spark, folder, "latest", before[-1], made.schema))
    latest_per_fire(newest).select(*made.columns).write.mode("overwrite").parquet(f"{folder}/latest/epoch={epoch}")
    for old in before[:-1]:
        at, files = _folder(spark, f"{folder}/latest/epoch={old}")
        files.delete(at, True)


def snapshot_writer(cycles: DataFrame, folder: str, job: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A stream writer that keeps every batch as a cycle of ``folder``; progress lies beside the cycles."""
    return cycles.writeStream.foreachBatch(lambda batch, epoch: keep_cycle(batch, epoch, folder, job)).option("checkpointLocation", f"{folder}/progress")


def latest_cycles(spark: SparkSession, folder: str) -> DataFrame | None:
    """Newest row per fire as of the newest complete cycle; None before the first."""
    done = committed(spark, f"{folder}/latest")
    return spark.read.parquet(f"{folder}/latest/epoch={done[-1]}") if done else None


def cycle_history(spark: SparkSession, folder: str, kind: str = "history") -> DataFrame | None:
    """Rows of all complete cycles with their ``epoch``; ``kind`` ``"inputs"`` gives what they were made from."""
    done = committed(spark, f"{folder}/latest")
    if not done:
        return None
    return spark.read.option("basePath", f"{folder}/{kind}").parquet(*[f"{folder}/{kind}/epoch={e}" for e in committed(spark, f"{folder}/{kind}") if e <= done[-1]]).withColumn(
        "epoch", F.col("epoch").cast("bigint"))


def replay_cycle(spark: SparkSession, folder: str, epoch: int, job: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What ``job`` makes of the inputs of a kept cycle."""
    inputs = spark.read.parquet(f"{folder}/inputs/epoch={epoch}")
    return inputs if job is None else job(inputs)
