"""SimHash near-duplicates of notes, found by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.graph import components
from emberline.llm.notes import map_notes, noted
from emberline.session import cut_lineage

SEED = 42


def shingle_hashes(notes: list[bytes], shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 values of the word shingles of all notes in a row, and how many each note has (none if blank)."""
    cut = [n.lower().split() for n in notes]  # bytes: lowers A-Z only, cuts at ASCII white space
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    if not size.sum():
        return np.zeros(0, np.uint64), np.zeros(len(notes), np.int64)
    words = [w for c in cut for w in c]
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    many = np.where(size > 0, np.maximum(size - shingle_words + 1, 1), 0)
    begin_doc = np.cumsum(size) - size
    begin = np.cumsum(many) - many
    first = np.repeat(begin_doc - begin, many) + np.arange(many.sum())
    last = first + np.repeat(np.minimum(size, shingle_words), many) - 1
    shingles = [joined[a:b] for a, b in zip(start[first].tolist(), end[last].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)), many


def simhash(notes: list[bytes], shingle_words: int) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half the XXH64 values of the word shingles."""
    hashes, many = shingle_hashes(notes, shingle_words)
    out = np.zeros(len(notes), np.uint64)
    if not len(hashes):
        return out
    begin = np.cumsum(many) - many
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    full = np.flatnonzero(many)
    ones = np.add.reduceat(bits, begin[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * ones > many[full, None], axis=1).reshape(-1).view(np.uint64)
    return out


def fingerprint_notes(observations: DataFrame, shingle_words: int = 4) -> DataFrame:
    """obs_id, note_hash, fingerprint (64 bits as a bigint) per observation; the whole note is read.

    Words are runs without ASCII white space, lower-cased in A-Z. A note with fewer words than a
    shingle is one shingle; a NULL, empty or blank note has fingerprint zero.
    """

    def make():
        return lambda notes: {"fingerprint": simhash(notes, shingle_words).view(np.int64)}

    keyed = observations.select("obs_id", "note", F.xxhash64(F.coalesce(F.col("note"), F.lit(""))).alias("note_hash"))
    return map_notes(noted(keyed, "note_hash"), make, "fingerprint bigint", "note_hash")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits such that two words within ``radius`` agree under one at least.

    Bit i carries the non-zero vector m(i) of radius + 1 bits, dealt out in turn; mask v holds the bits
    with an odd inner product of m(i) and v. At most ``radius`` differing bits give that many linear
    equations <m(i), v> = 0 in one more unknown, so some v other than zero solves them all and its
    mask leaves every differing bit out.
    """
    top = (1 << radius + 1) - 1
    vector = [i % top + 1 for i in range(64)]
    masks = [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable row of each of ``n`` rows under the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_sorted(group: np.ndarray, part: np.ndarray, across: np.ndarray, fingerprint: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the rows within ``radius`` bits of one another in each run of equal ``group``.

    Where ``across`` is set the run holds two shares of a large bucket and only pairs from different
    shares are compared; each share has a run of its own. Pairs are compared by their distance in the
    run, all runs at once, and reduced to one link per row, so a run of n rows yields fewer than n links.
    """
    n = len(group)
    change = np.flatnonzero(np.diff(group)) + 1
    stop = np.repeat(np.r_[change, n], np.diff(np.r_[0, change, n]))  # end of each row's run
    found_i, found_j = [], []
    live = np.arange(n)
    step = 0
    label = np.arange(n)
    held = 0
    while len(live):
        step += 1
        live = live[live + step < stop[live]]
        other = live + step
        close = np.bitwise_count(fingerprint[live] ^ fingerprint[other]) <= radius
        close &= ~across[live] | (part[live] != part[other])
        close &= label[live] != label[other]
        found_i.append(live[close])
        found_j.append(other[close])
        held += int(close.sum())
        if held > 1 << 16:
            i, j = np.concatenate([*found_i, np.arange(n)]), np.concatenate([*found_j, label])
            label = _forest(i, j, n)
            found_i, found_j, held = [], [], 0
    label = _forest(np.concatenate([*found_i, np.arange(n)]), np.concatenate([*found_j, label]), n)
    row = np.flatnonzero(label != np.arange(n))
    return row, label[row]


def close_fingerprints(fingerprints: DataFrame, radius: int = 4, share: int = 512) -> DataFrame:
    """(a, b): links between different fingerprints whose components are those of all pairs within ``radius`` bits.

    ``fingerprints`` has one row per different value. Each value goes to one bucket per covering mask;
    a bucket held by one value is left out by a count. A larger bucket is cut into shares of about
    ``share`` values and every two shares meet in a task of their own, so no task holds a bucket, yet
    each pair of a bucket is compared. No list of pairs leaves a task, only a spanning forest of them.
    """
    buckets = F.array(*[F.xxhash64(F.lit(k), F.col("fingerprint").bitwiseAND(F.lit(m))) for k, m in enumerate(covering_masks(radius))])
    spread = fingerprints.select("fingerprint", F.explode(buckets).alias("bucket"))
    shared = cut_lineage(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("bucket", "__b"))
    rows = spread.join(shared, F.col("bucket") == F.col("__b")).drop("__b")
    rows = rows.withColumn("shares", F.ceil(F.col("n") / share).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("shares")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("lo"), F.greatest(k, F.col("part")).alias("hi")))
    rows = rows.select("fingerprint", "bucket", "part", F.explode(meets).alias("m")).select("fingerprint", "part", (F.col("m.lo") != F.col("m.hi")).alias("across"), F.xxhash64("bucket", "m").alias("run"))
    dealt = rows.repartition(F.col("run")).sortWithinPartitions("run", "fingerprint")

    def link(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            run = table.column("run").to_numpy()
            edge = int(np.searchsorted(run, run[-1], "left")) if len(run) else 0  # the last run may go on
            held = table.slice(edge)
            if edge:
                yield emit(table.slice(0, edge))
        if held is not None and held.num_rows:
            yield emit(held)

    def emit(table: pa.Table) -> pa.RecordBatch:
        fp = table.column("fingerprint").to_numpy()
        i, j = link_sorted(table.column("run").to_numpy(), table.column("part").to_numpy(), table.column("across").to_numpy(zero_copy_only=False), fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    return dealt.mapInArrow(link, "a bigint, b bigint")


def fingerprint_components(rows: DataFrame, radius: int) -> DataFrame:
    """(__f, component): of the different fingerprints of ``rows``."""
    nodes = cut_lineage(rows.select("fingerprint").distinct())
    parts = components(close_fingerprints(nodes, radius))
    placed = nodes.join(parts, F.col("fingerprint") == F.col("node"), "left")
    return cut_lineage(placed.select(F.col("fingerprint").alias("__f"), F.coalesce("component", "fingerprint").alias("component")))


def group_notes(observations: DataFrame, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """obs_id, fingerprint (16 lowercase hex digits), component_id per observation.

    Notes whose fingerprints differ in ``radius`` bits or fewer are linked; ``component_id`` is the
    smallest obs_id that links can reach, itself included. Copies share a fingerprint and are one node
    of the search, so they cost nothing beyond their row. Blank notes have fingerprint zero and are
    linked like any other. Repeated rows each get their row; a NULL obs_id stays and is never the
    smallest (a component without any id has a NULL one); other columns are ignored; an empty table
    gives an empty one.
    """
    rows = cut_lineage(fingerprint_notes(observations, shingle_words))
    parts = fingerprint_components(rows, radius)
    first = rows.groupBy("fingerprint").agg(F.min("obs_id").alias("first_id"))
    placed = first.join(parts, F.col("fingerprint") == F.col("__f"))
    lowest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(placed.select("component", F.col("fingerprint").alias("__f")).join(lowest, "component").select("__f", "component_id"))
    out = rows.join(named, F.col("fingerprint") == F.col("__f"))
    return out.select("obs_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_group(observations: DataFrame, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``observations``, all columns, that stay when each group of near-duplicate notes keeps one.

    Groups are those of ``group_notes``. The row of the smallest obs_id stays (NULL last, then the
    smaller hash of the note); of rows that agree in id and note, one.
    """
    rows = cut_lineage(fingerprint_notes(observations, shingle_words))
    return keep_first(observations, rows, fingerprint_components(rows, radius))


def keep_first(observations: DataFrame, rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of ``observations`` that come first in their component, by ``rows`` (obs_id, note_hash, fingerprint) and ``parts``."""
    named = rows.join(parts, F.col("fingerprint") == F.col("__f"))
    order = F.struct(F.col("obs_id").isNull().alias("none"), F.col("obs_id").alias("id"), F.col("note_hash").alias("hash"))
    kept = named.groupBy("component").agg(F.min(order).alias("first")).select("first.*")
    kept = cut_lineage(kept.select("id", "hash"))
    # All columns travel in a struct, so none can clash with the keys.
    tagged = observations.select(F.struct("*").alias("row"), F.col("obs_id").alias("own"), F.xxhash64(F.coalesce(F.col("note"), F.lit(""))).alias("text"))
    stay = tagged.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("text") == F.col("hash")), "left_semi")
    return stay.dropDuplicates(["own", "text"]).select("row.*")
