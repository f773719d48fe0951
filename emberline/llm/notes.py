"""Reading observation notes inside tasks: bounded slices of (ids, UTF-8 bytes).

The text-bearing record of the data model is the ``observation``: ``obs_id`` names it and ``note`` is
its free text. Every operator here reads those two columns and ignores whatever else comes along.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are maximal runs without ASCII white space, as ``bytes.split()`` cuts them.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SLICE_BYTES = 1 << 20


def noted(observations: DataFrame, *more: str | Column) -> DataFrame:
    """The id and the note (NULL read as empty), nothing else unless named."""
    empty = F.lit(b"" if observations.schema["note"].dataType.typeName() == "binary" else "")
    return observations.select("obs_id", F.coalesce(F.col("note"), empty).alias("note"), *more)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Have Spark hand whole notes to Python in batches of ``rows`` at most; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def give_back() -> None:
    """Hand the memory that a task has freed back to the system: workers outlive their task, and several idle ones add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice holds about ``most`` bytes of notes, and a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("note")), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def map_notes(observations: DataFrame, make: Callable[[], Callable[..., dict]], columns: str, *more: str, given: list[str] = (), most: int = SLICE_BYTES) -> DataFrame:
    """Per observation, the columns that ``make()(notes)`` returns beside ``obs_id`` (and ``more``).

    ``make`` runs once a task. It gets the notes of a slice as bytes, then the values of the ``given``
    columns, and returns one value list or array per column of the DDL string ``columns``; a key
    ``"rows"`` with source row numbers turns the map into one of zero or more rows per note.
    """
    small_batches(observations.sparkSession)
    source = noted(observations, *more, *given).withColumn("note", F.col("note").cast("binary"))
    kept = StructType([f for f in source.schema.fields if f.name not in ("note", *given)])
    made = observations.sparkSession.range(0).select(F.lit(None).cast(f"struct<{columns}>").alias("x")).schema["x"].dataType
    schema = StructType(kept.fields + made.fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for part in slices(batches, most):
            out = work(part.column("note").to_pylist(), *[part.column(g).to_pylist() for g in given])
            rows = out.pop("rows", None)
            ids = [part.column(f.name) for f in kept]
            if rows is not None:
                ids = [c.take(pa.array(rows, pa.int64())) for c in ids]
            cols = ids + [pa.array(out[f.name], arrow.field(len(ids) + k).type) for k, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
            del out, cols, ids, part
        del work
        give_back()

    return source.mapInArrow(run, schema)


HERE = ("obs_id", "note_hash")


def placed(observations: DataFrame, carry: list[str] = ()) -> DataFrame:
    """obs_id, note, note_hash and the ``carry`` columns in a struct of their own.

    Rows are known by id and hash of the note, so that rows with one id stay apart, and rows that agree
    in both are alike in everything an operator decides.
    """
    extra = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("_"))
    return observations.select("obs_id", "note", F.xxhash64(F.coalesce(F.col("note"), F.lit(""))).alias("note_hash"), extra.alias("__carry"))


def map_notes_beside(source: DataFrame, table: DataFrame, how: str, make: Callable[[], Callable[..., dict]], columns: str, *more: str) -> DataFrame:
    """``map_notes`` over ``placed`` notes joined to a table of decisions by id and hash of the note.

    The notes cross the network compressed. ``make()`` gets the notes and the table's last column.
    """

    def squeeze():
        pack = zstandard.ZstdCompressor(level=1)
        return lambda notes: {"z": [pack.compress(n) for n in notes]}

    def opened():
        work, unpack = make(), zstandard.ZstdDecompressor()
        return lambda notes, given: work([unpack.decompress(n) for n in notes], given)

    given = table.columns[-1]
    side = table.select(F.col("obs_id").alias("__i"), F.col("note_hash").alias("__h"), given)
    packed = map_notes(source, squeeze, "z binary", "note_hash", "__carry")
    both = packed.join(side, F.col("obs_id").eqNullSafe(F.col("__i")) & (F.col("note_hash") == F.col("__h")), how)
    return map_notes(both.withColumnRenamed("z", "note"), opened, columns, *more, given=[given])
