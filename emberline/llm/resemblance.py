"""Notes that share most of their word shingles: MinHash bands retrieve pairs, the exact Jaccard similarity decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.graph import components
from emberline.llm.notes import give_back, map_notes, map_notes_beside, noted, placed
from emberline.llm.simhash import fingerprint_components, keep_first, shingle_hashes, simhash
from emberline.session import cut_lineage, release

BANDS, BAND_ROWS = 24, 5
_DRAWN = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS, BAND_ROWS), np.uint64)
_ODD, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def minhash_bands(notes: list[bytes], words: int) -> list[list[int]]:
    """One signed 64-bit value per band of five minima; a blank note has none.

    Notes of Jaccard similarity s agree in a band with probability s^5: at 0.8 in one of 24 or more
    with 0.9999.
    """
    hashes, many = shingle_hashes(notes, words)
    full = np.flatnonzero(many)
    out: list[list[int]] = [[] for _ in notes]
    if not len(full):
        return out
    begin = (np.cumsum(many) - many)[full]
    bands = np.empty((len(full), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(full), b + 1, np.uint64)
        for odd, plus in zip(_ODD[b], _PLUS[b]):
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.minimum.reduceat(hashes * odd + plus, begin)
        bands[:, b] = value ^ (value >> np.uint64(32))
    for k, row in zip(full.tolist(), bands.view(np.int64).tolist()):
        out[k] = row
    return out


def shingle_sets(notes: list[bytes], words: int) -> list[bytes]:
    """The different shingle hashes of each note, ascending, as bytes."""
    hashes, many = shingle_hashes(notes, words)
    return [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(many)[:-1])] if len(notes) else []


def link_run(component: np.ndarray, part: np.ndarray, across: bool, grams: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (components) between the rows of a run whose shingle sets have Jaccard similarity ``least`` or more.

    Rows that links have joined already are not compared again. With ``across`` the run holds two shares
    of a large bucket and only pairs from different shares are compared.
    """
    label, links = component.copy(), []
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    for i in range(len(grams) - 1):
        rest = np.arange(i + 1, len(grams))
        fit = (label[rest] != label[i]) & (np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i]))
        if across:
            fit &= part[rest] != part[i]
        for j in rest[fit].tolist():
            if label[j] == label[i]:
                continue
            a, b = (grams[i], grams[j]) if size[i] < size[j] else (grams[j], grams[i])
            at = np.searchsorted(b, a)
            both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if both >= least * (len(a) + len(b) - both) - 1e-9:
                links.append((int(component[i]), int(component[j])))
                label[label == label[j]] = label[i]
    return links


def shared_buckets(nodes: DataFrame, bands: Column, share: int) -> DataFrame:
    """note_hash, component, bucket, shares: the rows of buckets that notes of different components hold."""
    spread = nodes.select("note_hash", "component", F.explode(bands).alias("bucket"))
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    shared = counts.where("lo <> hi").select(F.col("bucket").alias("__b"), F.ceil(F.col("n") / share).cast("int").alias("shares"))
    return spread.join(shared, F.col("bucket") == F.col("__b")).drop("__b")


def shingle_table(observations: DataFrame, nodes: DataFrame, words: int, share: int) -> DataFrame:
    """(__h, grams): the shingle set of every different note that shares a bucket with a note of another component."""
    held = shared_buckets(nodes, F.col("bands"), share).select(F.col("note_hash").alias("__h")).distinct()
    wanted = cut_lineage(nodes.select("obs_id", "note_hash").join(held, F.col("note_hash") == F.col("__h")).drop("__h").withColumn("given", F.lit(1)))

    def make():
        return lambda notes, given: {"grams": shingle_sets(notes, words)}

    sets = map_notes_beside(placed(observations), wanted, "inner", make, "grams binary", "note_hash")
    return cut_lineage(sets.groupBy("note_hash").agg(F.first("grams").alias("grams")).select(F.col("note_hash").alias("__h"), "grams"))


def resembling_links(nodes: DataFrame, sets: DataFrame, bands: Column, least: float, share: int) -> DataFrame:
    """(a, b): links between components of ``nodes`` (note_hash, component, bands), one row per different note, by some of its ``bands``.

    Only buckets with notes of different components are looked at. A large bucket is cut into shares and
    every two shares meet in a run of their own; a run yields fewer links than rows. Shingle sets are
    compared whole.
    """
    rows = shared_buckets(nodes, bands, share).withColumn("part", F.pmod(F.xxhash64("note_hash", F.lit(7)), F.col("shares")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("lo"), F.greatest(k, F.col("part")).alias("hi")))
    rows = rows.select("note_hash", "component", "bucket", "part", F.explode(meets).alias("m"))
    rows = rows.select("note_hash", "component", "part", (F.col("m.lo") != F.col("m.hi")).alias("across"), F.xxhash64("bucket", "m").alias("run"))
    rows = rows.join(sets, F.col("note_hash") == F.col("__h")).drop("__h", "note_hash")
    dealt = rows.repartition(F.col("run")).sortWithinPartitions("run", "component")

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
        del held
        give_back()

    def emit(table: pa.Table) -> pa.RecordBatch:
        run, component, part = (table.column(c).to_numpy() for c in ("run", "component", "part"))
        across, grams = table.column("across"), table.column("grams")
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        links = []
        for lo, hi in zip(edges, edges[1:]):
            if component[lo] != component[hi - 1]:
                links += link_run(component[lo:hi], part[lo:hi], across[lo].as_py(), [np.frombuffer(g, np.uint64) for g in grams.slice(lo, hi - lo).to_pylist()], least)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(link, "a bigint, b bigint")


def keep_one_of_resembling(
    observations: DataFrame, shingle_words: int = 4, radius: int = 4, share_words: int = 5, least_share: float = 0.8, rounds: int = 3, share: int = 256,
) -> DataFrame:
    """The rows of ``observations`` that stay when each group of near-duplicate notes keeps one, as in ``keep_one_of_group``.

    Notes are linked if their fingerprints differ in ``radius`` bits or fewer, or if their sets of
    ``share_words``-word shingles have a Jaccard similarity of ``least_share`` or more. Words are as in
    ``fingerprint_notes``; a note with fewer than a shingle's words is one shingle, a blank one has none.

    The bands are looked at in ``rounds``: what one round has linked is one component for the next, so
    that most buckets of copies have nothing left to compare and their shingle sets are not sent again.
    """

    def make():
        return lambda notes: {"fingerprint": simhash(notes, shingle_words).view(np.int64), "bands": minhash_bands(notes, share_words)}

    keyed = observations.select("obs_id", "note", F.xxhash64(F.coalesce(F.col("note"), F.lit(""))).alias("note_hash"))
    rows = cut_lineage(map_notes(noted(keyed, "note_hash"), make, "fingerprint bigint, bands array<bigint>", "note_hash", most=1 << 19))
    parts = fingerprint_components(rows, radius)
    one = rows.groupBy("note_hash", "fingerprint").agg(F.min("obs_id").alias("obs_id"), F.first("bands").alias("bands"))
    nodes = cut_lineage(one.join(parts, F.col("fingerprint") == F.col("__f")).select("obs_id", "note_hash", "component", "bands"))
    sets = shingle_table(observations, nodes, share_words, share)
    for k in range(rounds):
        lo, hi = k * BANDS // rounds, (k + 1) * BANDS // rounds
        links = cut_lineage(resembling_links(nodes, sets, F.slice("bands", lo + 1, hi - lo), least_share, share))
        far = cut_lineage(components(links).select(F.col("node").alias("__n"), F.col("component").alias("__c")))
        moved = lambda df: cut_lineage(df.join(far, F.col("component") == F.col("__n"), "left").withColumn("component", F.coalesce("__c", "component")).drop("__n", "__c"))
        old, parts, nodes = (parts, nodes), moved(parts), moved(nodes)
        for done in (*old, links, far):
            release(done)
    kept = keep_first(observations, rows.drop("bands"), parts)
    for done in (sets, nodes):
        release(done)
    return kept
