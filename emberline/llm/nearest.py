"""Nearest feature vectors of grid cells by multiprobe p-stable hashing."""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from emberline.session import cut_lineage, release

LADDER = sorted({*(2**n for n in range(12)), *(3 * 2**n for n in range(11))})  # numbers of probes that are tried


def perturbations(hashes: int, most: int) -> np.ndarray:
    """Sets of distance ranks, most promising first: a 0/1 matrix of up to ``most`` rows and 2 x ``hashes`` columns.

    A query lies at 2 x ``hashes`` distances from the walls of its bucket. Stepping over the walls of a set
    leads to another bucket, and the sum of their squared distances orders these buckets by how likely they
    hold a neighbour. The order is that of the expected squares; a set holding the wall opposite to one of
    its own (ranks j and 2 x hashes + 1 - j) leads nowhere. The first set is empty: the bucket itself.
    """
    n = 2 * hashes
    k1 = (hashes + 1) * (hashes + 2)
    rank = np.arange(1, n + 1)
    back = n + 1 - rank
    square = np.where(rank <= hashes, rank * (rank + 1) / (4 * k1), 1 - back / (hashes + 1) + back * (back + 1) / (4 * k1))
    out = [()]
    heap = [(square[0], (0,))]
    while heap and len(out) < most:
        score, walls = heapq.heappop(heap)
        if not any(n - 1 - w in walls for w in walls):
            out.append(walls)
        last = walls[-1] + 1
        if last < n:
            heapq.heappush(heap, (score - square[last - 1] + square[last], (*walls[:-1], last)))
            heapq.heappush(heap, (score + square[last], (*walls, last)))
    sets = np.zeros((len(out), n), np.int8)
    for r, walls in enumerate(out):
        sets[r, list(walls)] = 1
    return sets


@dataclass
class Hashing:
    """``tables`` groups of ``hashes`` functions floor((a.v + b) / width), a normal and b uniform, for vectors of one length."""

    direction: np.ndarray  # tables x hashes x length
    shift: np.ndarray  # tables x hashes, in widths
    width: float
    sets: np.ndarray
    probes: int

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Tables x vectors x hashes, in widths."""
        return np.einsum("thd,nd->tnh", self.direction, vectors) / self.width + self.shift[:, None, :]

    @staticmethod
    def key(table: int, cells: np.ndarray) -> np.ndarray:
        """64-bit bucket keys of rows of whole numbers; two buckets with one key are searched together."""
        key = np.full(cells.shape[:-1], table + 1, np.uint64)
        for column in np.moveaxis(cells, -1, 0):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + column.astype(np.int64).view(np.uint64)
        return (key ^ (key >> np.uint64(32))).view(np.int64)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors x tables: the bucket of each vector in each table."""
        return np.stack([self.key(t, np.floor(p)) for t, p in enumerate(self.places(vectors))], 1)

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors x probes: the buckets with the least estimated distance, over all tables; the own ones come first."""
        keys, scores = [], []
        sets = self.sets.astype(np.float32)
        rows = np.arange(len(vectors))[:, None, None]
        for t, p in enumerate(self.places(vectors)):
            cell = np.floor(p)
            inside = p - cell
            walls = np.concatenate([inside, 1 - inside], 1)  # below, then above
            order = np.argsort(walls, 1, kind="stable")
            scores.append(np.take_along_axis(walls, order, 1).astype(np.float32) ** 2 @ sets.T)
            hashes = p.shape[1]
            step = np.zeros((len(vectors), len(sets), 2 * hashes), np.int8)
            step[rows, np.arange(len(sets))[None, :, None], order[:, None, :]] = self.sets[None]
            keys.append(self.key(t, cell[:, None, :] - step[:, :, :hashes] + step[:, :, hashes:]))
        score, key = np.concatenate(scores, 1), np.concatenate(keys, 1)
        return np.take_along_axis(key, np.argsort(score, 1, kind="stable")[:, : self.probes], 1)


def _nearest_in(sample: np.ndarray, k: int, asked: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest others of the first ``asked`` sample vectors, and their distances."""
    own = sample[:asked]
    apart = (own**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * own @ sample.T
    apart[np.arange(len(own)), np.arange(len(own))] = np.inf
    near = np.argsort(apart, 1, kind="stable")[:, :k]
    return near, np.sqrt(np.maximum(np.take_along_axis(apart, near, 1), 0))


def fit_hashing(sample: np.ndarray, rows: int, k: int, tables: int, in_bucket: int, least_found: float, seed: int) -> Hashing:
    """Hash functions for vectors like those of ``sample``, of which the index holds ``rows``.

    The width is 1.75 times the median distance to the k-th neighbour in the sample; the number of hashes
    makes buckets of about ``in_bucket`` vectors, and the number of probes is the smallest of a ladder that
    finds ``least_found`` of the neighbours within the sample; where the whole ladder finds fewer, there are
    fewer hashes, then wider ones (dense places among sparse ones). Neighbours in the whole table are nearer than those in a sample of it, hence found more often.
    """
    rng = np.random.default_rng(seed)
    length = sample.shape[1]
    near, apart = _nearest_in(sample, max(min(k, len(sample) - 1), 0), 256)
    width = 1.75 * float(np.median(apart[:, -1])) if apart.size else 0.0
    reach = float(np.abs(sample).max() * np.sqrt(length)) or 1.0
    if not width > 0:
        width = reach
    trial = np.floor(sample @ rng.normal(size=(length, 64)) / width + rng.uniform(size=64))
    half = len(trial) // 2
    together = float((trial[:half] == trial[half : 2 * half]).mean()) if half else 0.5
    together = min(max(together, 0.02), 0.98)
    hashes = int(np.clip(np.ceil(np.log(max(rows / in_bucket, 1)) / -np.log(together)), 1, 24))
    while True:
        made = Hashing(rng.normal(size=(tables, hashes, length)), rng.uniform(size=(tables, hashes)), width, perturbations(hashes, LADDER[-1] // tables), 0)
        home = made.buckets(sample)[near]
        for made.probes in [n for n in LADDER if tables <= n <= tables * len(made.sets)]:
            asked = made.probed(sample[: len(near)])
            if not near.size or (home[:, :, :, None] == asked[:, None, None, :]).any((2, 3)).mean() >= least_found:
                return made
        if hashes > 1:
            hashes -= 1
        elif width < 4 * reach:
            width *= 2
        else:
            return made


def _vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows hold a usable vector, and those vectors in double precision, of any lengths."""
    ok, out = [], []
    for values in column.to_pylist():
        v = None if not values or any(x is None for x in values) else np.array(values, float)
        fine = v is not None and bool(np.isfinite(v).all() and v.any())
        ok.append(fine)
        if fine:
            out.append(v)
    return np.array(ok, bool), out


def _runs(batches):
    """Whole runs of equal ``run``, which rows are sorted by, as one table each."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        edges = [0, *(np.flatnonzero(np.diff(table.column("run").to_numpy())) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield table.slice(lo, hi - lo)
        held = table.slice(edges[-1]) if table.num_rows else None
    if held is not None and held.num_rows:
        yield held


def closest(asked: np.ndarray, held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row asked, row held, distance) of at least the ``most`` nearest per row asked, ties at the end included.

    A matrix product finds who can be among them, with room for its rounding; the distances returned
    are summed squares of differences, in double precision.
    """
    a, b, d = [], [], []
    norm = (held**2).sum(1)
    for lo in range(0, len(asked), 256):
        part = asked[lo : lo + 256]
        own = (part**2).sum(1)[:, None]
        rough = own + norm - 2 * part @ held.T
        room = 1e-9 * (own + norm.max())
        if rough.shape[1] > most:
            edge = np.partition(rough, most - 1, 1)[:, most - 1 : most]
            i, j = np.nonzero(rough <= edge + room)
        else:
            i, j = (x.ravel() for x in np.indices(rough.shape))
        for s in range(0, len(i), 1 << 16):
            d.append(np.sqrt(((part[i[s : s + (1 << 16)]] - held[j[s : s + (1 << 16)]]) ** 2).sum(1)))
        a.append(i + lo)
        b.append(j)
    return np.concatenate(a), np.concatenate(b), np.concatenate(d)


def _meet(entries: DataFrame, asked: DataFrame, k: int, share: int) -> DataFrame:
    """cell_id, neighbour, distance: for each asked vector its nearest entries in every bucket that both name.

    ``entries`` (bucket, node, vector, ids) and ``asked`` (bucket, cell_id, vector). Only buckets that are asked
    for are read. A bucket with more than ``share`` entries is cut into shares by hash, and what asks for it
    goes to each of them, so no task holds a bucket; a task answers with the ``k`` nearest neighbours per query of
    all its shares, never with all pairs.
    """
    many = entries.groupBy("bucket").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
    wanted = cut_lineage(asked.select("bucket").distinct().join(many, "bucket").select(F.col("bucket").alias("__b"), "shares"))
    held = entries.join(wanted, F.col("bucket") == F.col("__b"))
    held = held.select(
        F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.col("shares"))).alias("run"), "vector", "ids", F.lit(None).cast(asked.schema["cell_id"].dataType).alias("cell_id"))
    queries = asked.join(wanted, F.col("bucket") == F.col("__b")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    queries = queries.select(
        F.xxhash64("bucket", F.col("part").cast("bigint")).alias("run"), "vector", F.lit(None).cast(entries.schema["ids"].dataType).alias("ids"), "cell_id")
    together = held.unionByName(queries).repartition(F.col("run")).sortWithinPartitions("run")
    id_type = asked.schema["cell_id"].dataType
    schema = StructType([StructField("cell_id", id_type), StructField("neighbour", id_type), *StructType.fromDDL("distance double").fields])
    arrow = to_arrow_schema(schema)

    def answer(batches):
        held = []
        for table in _runs(batches):
            held += in_run(table)
            if sum(map(len, held)) > 1 << 17:
                held = [best(held)]
                if len(held[0]) > 1 << 16:
                    yield as_batch(held.pop())
        if held:
            yield as_batch(best(held))

    def best(held: list[pd.DataFrame]) -> pd.DataFrame:
        """Of what a task has found, the k nearest different neighbours of each query."""
        rows = pd.concat(held).sort_values(["distance", "neighbour"], kind="stable")
        return rows.drop_duplicates(["cell_id", "neighbour"]).groupby("cell_id", sort=False).head(k)

    def as_batch(rows: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name].tolist(), f.type) for f in arrow], schema=arrow)

    def in_run(table: pa.Table) -> list[pd.DataFrame]:
        out = []
        is_asked = table.column("ids").is_null().to_numpy()
        if is_asked.all() or not is_asked.any():
            return out
        data = table.column("vector").to_pylist()
        ids = table.column("ids").to_pylist()
        names = table.column("cell_id").to_pylist()
        size = np.fromiter(map(len, data), np.int64, len(data))
        for n in np.unique(size):  # two buckets may share a key, lengths do not mix
            q, e = (np.flatnonzero((size == n) & x) for x in (is_asked, ~is_asked))
            if not len(q) or not len(e):
                continue
            i, j, d = closest(*(np.stack([np.frombuffer(data[r], "<f8") for r in x]) for x in (q, e)), k + 1)
            rows = [(names[a], x, y) for a, b, y in zip(q[i].tolist(), e[j].tolist(), d.tolist()) for x in ids[b] if x != names[a]]
            if rows:
                out.append(pd.DataFrame(rows, columns=[f.name for f in arrow]))
        return out

    return together.mapInArrow(answer, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest different neighbours of each cell, ties to the smaller id; each is named once, at its least distance."""
    once = found.groupBy("cell_id", "neighbour").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("cell_id").orderBy("distance", "neighbour")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_cells(
    cells: DataFrame, queries: DataFrame, k: int = 10, tables: int = 4, in_bucket: int = 512, least_found: float = 0.94,
    sample: int = 2048, share: int = 4096, seed: int = 13,
) -> DataFrame:
    """cell_id, rank, neighbour, distance: the ``k`` nearest ``cells`` (cell_id, features) of each of ``queries`` (cell_id, features).

    Nearness is the Euclidean distance of the feature vectors, in double precision; ranks start at 1, ties go to
    the smaller id. A cell is not its own neighbour. Vectors that are NULL, empty, zero or hold NULL or
    non-finite parts take no part, nor do rows with a NULL cell_id; vectors of different lengths are not
    compared. Repeated rows count once; if a cell_id has several vectors, it is as near as the nearest of them, and
    asks with the smallest. Other columns are ignored; an empty table gives an empty one.

    Each of ``tables`` tables hashes every vector by p-stable functions into a bucket. A query visits its own
    buckets and perturbed ones in the order of estimated success, over all tables, and the candidates
    of all buckets are ranked by exact distance. Hash functions and the number of probes come from ``sample``
    vectors of lowest id hash (a bounded fit, collected; every row is indexed): probes are added until
    ``least_found`` of the sample's own neighbours are found. A query that finds fewer than ``k`` neighbours is
    compared with all vectors, in blocks. Distances are always exact; recall is measured by the tests.

    Equal vectors are one entry with their k + 1 smallest ids, which is all that an answer can name.
    """
    spark = cells.sparkSession
    id_type = cells.schema["cell_id"].dataType
    schema = StructType([StructField("cell_id", id_type), *StructType.fromDDL("length int, digest binary, vector binary, asks boolean").fields])
    arrow = to_arrow_schema(schema)

    def usable(batches):
        for batch in batches:
            batch = batch.filter(batch.column("cell_id").is_valid())
            ok, vectors = _vectors(batch.column("features"))
            ids, asks = (batch.column(c).filter(pa.array(ok)) for c in ("cell_id", "asks"))
            data = [v.astype("<f8").tobytes() for v in vectors]
            made = [pa.array([len(v) for v in vectors], pa.int32()), pa.array([hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), *made, asks], schema=arrow)

    both = cells.select("cell_id", "features", F.lit(False).alias("asks")).unionByName(
        queries.select(F.col("cell_id").cast(id_type).alias("cell_id"), "features", F.lit(True).alias("asks")))
    rows = cut_lineage(both.mapInArrow(usable, schema))
    # Copies: the k + 1 smallest ids of each vector, ranked before the shuffle as well.
    ids = rows.where("NOT asks").select("length", "digest", "cell_id", "vector").dropDuplicates(["length", "digest", "cell_id"])
    place = F.row_number().over(Window.partitionBy("length", "digest").orderBy("cell_id"))
    entries = ids.withColumn("__r", place).where(F.col("__r") <= k + 1).groupBy("length", "digest").agg(
        F.first("vector").alias("vector"), F.sort_array(F.collect_list("cell_id")).alias("ids"))
    entries = cut_lineage(entries.withColumn("node", F.monotonically_increasing_id()))
    asked = rows.where("asks").groupBy("cell_id").agg(F.min(F.struct("digest", "length", "vector")).alias("v")).select("cell_id", "v.length", "v.vector")
    asked = cut_lineage(asked)

    depth = {r["length"]: r["count"] for r in entries.groupBy("length").count().orderBy(F.desc("count"), "length").limit(64).collect()}
    picked: dict[int, list[np.ndarray]] = {}
    for r in entries.select("digest", "length", "vector").orderBy(F.xxhash64("digest"), "digest").limit(sample).collect():
        picked.setdefault(r.length, []).append(np.frombuffer(r.vector, "<f8"))
    fitted = {n: fit_hashing(np.stack(v), depth.get(n, len(v)), k, tables, in_bucket, least_found, seed) for n, v in picked.items()}
    sent = spark.sparkContext.broadcast(fitted)

    def hashed(which: str):
        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    length, data = part.column("length").to_numpy(), part.column("vector").to_pylist()
                    out = np.full(len(data), None, object)
                    for n in np.unique(length):
                        at = np.flatnonzero(length == n)
                        made = sent.value.get(int(n))
                        vectors = np.stack([np.frombuffer(data[r], "<f8") for r in at])
                        # A length that the sample lacks has one bucket: slower, not different.
                        keys = np.full((len(at), 1), n, np.int64) if made is None else getattr(made, which)(vectors)
                        for r, row in zip(at.tolist(), keys):
                            out[r] = row
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out.tolist(), pa.list_(pa.int64()))], names=[*part.schema.names, "buckets"])

        return run

    def spread(df: DataFrame, which: str) -> DataFrame:
        made = df.mapInArrow(hashed(which), StructType([*df.schema.fields, *StructType.fromDDL("buckets array<bigint>").fields]))
        return made.withColumn("bucket", F.explode("buckets")).drop("buckets")

    placed = cut_lineage(spread(entries.select("node", "length", "vector", "ids"), "buckets"))
    probes = cut_lineage(spread(asked, "probed"))
    found = cut_lineage(_ranked(_meet(placed, probes, k, share), k))
    release(placed)
    release(probes)
    full = found.groupBy("cell_id").count().where(F.col("count") >= k).select(F.col("cell_id").alias("__c"))
    short = cut_lineage(asked.join(full, F.col("cell_id") == F.col("__c"), "left_anti"))
    if not short.isEmpty():
        everywhere = F.col("length").cast("bigint").alias("bucket")
        whole = _meet(entries.select("node", "vector", "ids", everywhere), short.select("cell_id", "vector", everywhere), k, share)
        again = _ranked(whole, k)
        found = found.join(full, F.col("cell_id") == F.col("__c"), "left_semi").unionByName(again)
    return found.select("cell_id", "rank", "neighbour", "distance")
