"""Session conventions: UTC everywhere, and one way to reach the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime SQL settings the jobs rely on; leaves cluster sizing alone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A kilobyte of cells can meet thousands of detections: keep small shuffles parallel.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a scratch folder of its own: on a
    cluster a machine-local path would be lost together with its executor.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="emberline-ckpt-")
    context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    checkpoint_root(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read it back; survives lost executors.

    Unlike a checkpointed plan, the files carry true sizes, so the joins of later rounds are
    planned from what is there and not from estimates multiplied round by round.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # less disk, and less memory beside the heap than snappy
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """Rows that the next join must shuffle and never collect on the driver for a broadcast.

    For tables with a row per cell: those laid out by ``explode`` are estimated at the size of what
    they are laid out from, and those read back from files at their compressed size, a tenth of what
    a broadcast of them holds in memory. A join's result carries no such mark; mark it anew.
    """
    return df.hint("merge")


def release(df: DataFrame) -> None:
    """Delete the files of a ``cut_lineage`` result that nothing will read again."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/cut-" in folder and folder.split("/cut-")[0].endswith(root.rstrip("/").rsplit("/", 1)[-1]):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Store ``data`` beside the checkpoints and hand it to every executor; returns its name.

    Executors open their copy through ``SparkFiles.get(name)``; an executor that joins later
    fetches it again. The name must change with the content.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
    spark.sparkContext.addFile(path.toString())
    return name
