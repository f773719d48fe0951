"""Near-duplicate feature vectors of grid cells, found through a pivot-permutation index."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from emberline.functions.graph import components
from emberline.llm.simhash import _forest
from emberline.session import cut_lineage


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Reference points far from one another: from the first on, always the one least alike to those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    alike = sample @ sample[0]
    while len(chosen) < min(pivots, len(sample)):
        far = int(alike.argmin())
        if alike[far] > 1 - 1e-9:
            break
        chosen.append(far)
        alike = np.maximum(alike, sample @ sample[far])
    return sample[chosen]


def _unit(values: list | None) -> np.ndarray | None:
    """The vector in double precision at length one; None if it is NULL, empty, zero or holds NULL or non-finite parts."""
    if not values or any(v is None for v in values):
        return None
    v = np.array(values, float)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def link_list(vectors: np.ndarray, prefix: np.ndarray, pivot: int, pivots: int, least: float, shared: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one inverted list: enough shared pivots, then a cosine of ``least`` or more.

    A pair shares several lists; it belongs to that of its smallest shared pivot. With ``side`` only
    pairs from different sides count.
    """
    n = len(vectors)
    sign = np.zeros((n, pivots), np.float32)
    sign[np.arange(n)[:, None], prefix] = 1
    count = sign @ sign.T
    ok = (count >= shared) & (sign[:, :pivot] @ sign[:, :pivot].T == 0)
    ok &= vectors @ vectors.T >= least
    if side is not None:
        ok &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    return i, j


def near_duplicate_cells(
    cells: DataFrame, least: float = 0.93, pivots: int = 128, ordered: int = 8, shared: int = 2, share: int = 1024, sample: int = 2048,
) -> DataFrame:
    """cell_id, n_links, component_id, kept per row of ``cells`` (cell_id, fire, features).

    Feature vectors of the same ``fire`` and length whose cosine is ``least`` or more are linked.
    ``n_links`` counts the other rows a row is linked to, ``component_id`` is the smallest cell_id that
    links reach, itself included, and the row with that id is ``kept``.

    Each vector is described by the ``ordered`` nearest of ``pivots`` reference points, which come from the
    ``sample`` vectors of lowest id hash (a bounded fit; every vector is indexed). Inverted lists by fire
    and pivot retrieve the candidates: pairs that share at least ``shared`` pivots, whose cosine is then
    computed in double precision. Found links are always right; of pairs at the limit some 0.1 % may be
    missed (tests measure it). Equal vectors are one entry of the index with a count. A long list is
    dealt into shares that meet two by two, so no task holds a list and every pair of it is still
    compared; a task returns counts and a spanning forest, not the pairs.

    A row whose fire is NULL, or whose vector is NULL, empty, zero or holds NULL or non-finite parts, is
    linked with nothing. Repeated rows are linked with one another. A NULL cell_id is never the smallest.
    Other columns are ignored; an empty table gives an empty one.
    """
    spark = cells.sparkSession
    picked = cells.where(F.col("fire").isNotNull() & F.col("features").isNotNull()).select("cell_id", "features").orderBy(F.xxhash64("cell_id"), "cell_id").limit(sample)
    by_length: dict[int, list[np.ndarray]] = {}
    for r in picked.collect():  # at most ``sample`` vectors
        u = _unit(r.features)
        if u is not None:
            by_length.setdefault(len(u), []).append(u)
    # A length the sample does not hold has one pivot, hence one list: slower, not different.
    points = spark.sparkContext.broadcast({n: choose_pivots(np.stack(v), pivots) for n, v in by_length.items()})

    source = cells.select("cell_id", "fire", "features")
    more = "digest binary, unit binary, nearest array<int>"
    made = spark.range(0).select(F.lit(None).cast(f"struct<{more}>").alias("x")).schema["x"].dataType
    schema = StructType([StructField("cell_id", source.schema["cell_id"].dataType), StructField("fire", source.schema["fire"].dataType), *made.fields])

    def describe(batches):
        for batch in batches:
            digest, unit, nearest = [], [], []
            fires = batch.column("fire").to_pylist()
            for fire, values in zip(fires, batch.column("features").to_pylist()):
                u = _unit(values) if fire is not None else None
                if u is None:
                    digest.append(None), unit.append(None), nearest.append(None)
                    continue
                p = points.value.get(len(u))
                data = np.array(values, "<f8").tobytes()
                digest.append(hashlib.blake2b(data, digest_size=16).digest())
                unit.append(u.astype("<f8").tobytes())
                nearest.append([0] if p is None else np.argsort(-(p @ u), kind="stable")[:ordered].astype(int).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cell_id"), batch.column("fire"), pa.array(digest, pa.binary()), pa.array(unit, pa.binary()), pa.array(nearest, pa.list_(pa.int32()))],
                names=["cell_id", "fire", "digest", "unit", "nearest"])

    rows = cut_lineage(source.mapInArrow(describe, schema))
    good = rows.where(F.col("digest").isNotNull())
    entries = good.groupBy("fire", "digest").agg(F.min("cell_id").alias("first_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("nearest").alias("nearest"))
    entries = cut_lineage(entries.withColumn("node", F.monotonically_increasing_id()))

    listed = entries.select("node", "fire", F.length("unit").alias("size"), F.explode("nearest").alias("pivot"))
    length = cut_lineage(listed.groupBy("fire", "size", "pivot").agg(F.count("*").alias("n")).where("n > 1"))
    length = length.select(F.col("fire").alias("__f"), F.col("size").alias("__s"), F.col("pivot").alias("__p"), F.ceil(F.col("n") / share).cast("int").alias("shares"))
    full = entries.select("node", "fire", "copies", "unit", "nearest", F.length("unit").alias("size"), F.explode("nearest").alias("pivot"))
    dealt = full.join(length, (F.col("fire") == F.col("__f")) & (F.col("size") == F.col("__s")) & (F.col("pivot") == F.col("__p")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("lo"), F.greatest(k, F.col("part")).alias("hi")))
    dealt = dealt.select("node", "copies", "unit", "nearest", "size", "pivot", "part", "fire", F.explode(meets).alias("m"))
    dealt = dealt.select("node", "copies", "unit", "nearest", "pivot", "part", (F.col("m.lo") != F.col("m.hi")).alias("across"), F.struct("fire", "size", "pivot", "m").alias("list"))
    dealt = dealt.withColumn("run", F.xxhash64("list")).repartition(F.col("run")).sortWithinPartitions("run", "list").drop("list")

    def link(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            run = table.column("run").to_numpy()
            edges = np.flatnonzero(np.diff(run)) + 1
            for lo, hi in zip([0, *edges[:-1]], edges):
                yield from pairs(table.slice(lo, hi - lo))
            held = table.slice(edges[-1] if len(edges) else 0)  # the last run may go on
        if held is not None and held.num_rows:
            yield from pairs(held)

    def pairs(table: pa.Table):
        if table.num_rows < 2:
            return
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        vectors = np.stack([np.frombuffer(u, "<f8") for u in table.column("unit").to_pylist()])
        prefix = table.column("nearest").to_pylist()
        width = min(map(len, prefix))
        near = np.array([p[:width] for p in prefix])
        side = table.column("part").to_numpy() if table.column("across")[0].as_py() else None
        pivot = int(table.column("pivot")[0].as_py())
        i, j = link_list(vectors, near, pivot, max(pivots, int(near.max()) + 1), least, min(shared, width), side)
        if not len(i):
            return
        n = len(node)
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root = _forest(i, j, n)
        got = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(node[root[got]]), pa.array(links[got].astype(np.int64))], names=["a", "b", "links"])

    found = cut_lineage(dealt.mapInArrow(link, "a bigint, b bigint, links bigint"))
    degree = found.groupBy("a").agg(F.sum("links").alias("others"))
    parts = components(found)
    placed = entries.select("node", "fire", "digest", "copies", "first_id").join(parts.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    placed = placed.join(degree, F.col("node") == F.col("a"), "left").select(
        "fire", "digest", "first_id", F.coalesce("component", "node").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lowest = placed.groupBy("component").agg(F.min("first_id").alias("lowest"))
    named = cut_lineage(placed.join(lowest, "component").select(F.col("fire").alias("__f"), F.col("digest").alias("__d"), "n_links", "lowest"))
    out = rows.select("cell_id", "fire", "digest").join(named, (F.col("fire") == F.col("__f")) & (F.col("digest") == F.col("__d")), "left")
    component = F.when(F.col("__d").isNull(), F.col("cell_id")).otherwise(F.col("lowest"))
    return out.select("cell_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("cell_id").eqNullSafe(component).alias("kept"))
