"""Repeated passages of notes: anchored blocks of word windows, in place of a relative Lempel-Ziv parse.

Every note is compared with all notes. They are indexed in blocks that the text itself delimits, so that equal passages fall into equal blocks wherever they stand: each
window of ``window`` words is represented by an anchor, the seed of ``seed`` consecutive words within
it that has the smallest hash (the leftmost of equals), and the consecutive windows with one anchor
form a block. Two equal windows have the same anchor, hence they lie in blocks of the same anchor.

Comparing a note with all blocks at once then takes two steps. A block that occurs again as a whole is
repeated entirely. Other blocks share an anchor but not all of their words; there every single window is
checked against those of the other blocks. The union of these spans, each ``window`` words or more, is
what is repeated. No match is extended and no note is factored greedily.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.notes import HERE, map_notes, map_notes_beside, placed
from emberline.session import cut_lineage, release

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two rolling hashes
_WRAP = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any run of words of a list, modulo 2^64, from two arrays of prefix sums."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, which: int):
        n, base = len(hashes), _BASE[which]
        power, inverse = self._powers.get(base, (np.zeros(0, np.uint64),) * 2)
        if len(power) <= n:
            size = max(2 * n, 1 << 16)
            step = np.full(size, base, np.uint64)
            back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            power, inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)
            self._powers[base] = power, inverse
        if which:
            hashes = _mix(hashes)
        self.inverse = inverse
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by minima running both ways within strips."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks_of(cut: list[list[bytes]], window: int, seed: int) -> dict:
    """Blocks of a slice of notes: source row, anchor and block hashes, first window, number of windows."""
    size = np.fromiter(map(len, cut), np.int64, len(cut))
    total = int(size.sum())
    none = np.zeros(0, np.int64)
    empty = {"rows": none, "anchor": none, "block": none, "first": none, "windows": none}
    if total < window:
        return empty
    hashes = word_hashes([w for c in cut for w in c])
    spans = Spans(hashes, 0)
    at = np.arange(total - seed + 1)
    seeds = spans.of(at, at + seed)
    ranked = (seeds >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    anchor = (sliding_min(ranked, window - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(cut)), size)[: len(anchor)]
    inside = np.flatnonzero(np.arange(len(anchor)) + window <= (begin + size)[row])  # windows within one note
    if not len(inside):
        return empty
    turn = np.flatnonzero((np.diff(anchor[inside]) != 0) | (np.diff(inside) != 1)) + 1
    lo = inside[np.r_[0, turn]]
    hi = inside[np.r_[turn, len(inside)] - 1]
    return {
        "rows": row[lo], "anchor": seeds[anchor[lo]].view(np.int64), "block": spans.of(lo, hi + window).view(np.int64),
        "first": lo - begin[row[lo]], "windows": hi - lo + 1,
    }


def kept_text(note: bytes, words: list[bytes], gone: np.ndarray, keep_gaps: bool) -> bytes:
    if not keep_gaps:
        return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words)
    if not gone.any():
        return note
    out, at, skip = [], 0, False
    for w, g in zip(words, gone.tolist()):
        found = note.index(w, at)
        if not g:
            out += [note[at:found] if not skip else b" " if out else b"", w]
        skip = g
        at = found + len(w)
    return b"".join([*out, note[at:]])


def drop_repeated_passages(observations: DataFrame, window: int = 35, seed: int = 6, keep_gaps: bool = False, carry: list[str] = ()) -> DataFrame:
    """obs_id, note, n_words, n_removed (and the ``carry`` columns) per observation.

    Words are runs without ASCII white space, taken as they are. A word goes if it is covered by a window
    of ``window`` consecutive words whose sequence starts at any other place too, in the same note or in
    another; all windows are judged on the input. ``note`` is what is left: the words with one space
    between them, or with ``keep_gaps`` the text with its white space.

    A NULL or blank note has no words and comes back empty (with ``keep_gaps``, a note that loses nothing
    comes back as it was, NULL as empty). Notes shorter than the window lose nothing. Repeated rows are
    places of their own, so they lose what they share; a NULL obs_id is kept; an empty table gives an
    empty one. Blocks travel as pairs of 64-bit hashes and single windows as 128 bits.

    A passage in many notes is counted before it is joined to anything, its occurrences are never paired
    with one another, and the joins are between stored tables, so that a hot key can be split. The text
    crosses the network twice, compressed: where boundaries are checked, and for the result.
    """
    if not 0 < seed <= window:
        raise ValueError("a seed lies within the window")
    source = placed(observations, carry)
    here = list(HERE)

    def index():
        return lambda notes: blocks_of([n.split() for n in notes], window, seed)

    blocks = cut_lineage(map_notes(source, index, "anchor bigint, block bigint, first int, windows int", "note_hash"))
    seen = blocks.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi"))
    shared = cut_lineage(seen.where("n > 1").select(F.col("anchor").alias("__a"), (F.col("lo") != F.col("hi")).alias("mixed")))
    found = cut_lineage(blocks.join(shared, F.col("anchor") == F.col("__a")).drop("__a"))
    release(blocks)
    release(shared)
    mixed = found.where("mixed")
    kinds = cut_lineage(mixed.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(F.struct(*here, "first", "windows")).alias("one")))
    again = kinds.where("n > 1").select(F.col("anchor").alias("__a"), F.col("block").alias("__b"))
    whole = found.where("NOT mixed").unionByName(mixed.join(again, (F.col("anchor") == F.col("__a")) & (F.col("block") == F.col("__b")), "left_semi"))
    spans = whole.select(*here, F.col("first").alias("lo"), (F.col("first") + F.col("windows") + (window - 1)).alias("hi"))

    opened = kinds.select("one.*").groupBy(*here).agg(F.collect_set(F.struct("first", "windows")).alias("open"))

    def boundary():
        def check(notes: list[bytes], opened: list) -> dict:
            cut = [n.split() for n in notes]
            hashes = word_hashes([w for c in cut for w in c])
            begin = np.cumsum([0, *map(len, cut)])
            asked = [(r, o["first"], o["windows"]) for r, of in enumerate(opened) for o in of]
            r, first, n = np.array(asked, np.int64).reshape(-1, 3).T
            rows = np.repeat(r, n)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            lo = begin[rows] + at
            return {"rows": rows, "at": at, "w1": Spans(hashes, 0).of(lo, lo + window).view(np.int64), "w2": Spans(hashes, 1).of(lo, lo + window).view(np.int64)}

        return check

    windows = cut_lineage(map_notes_beside(source, opened, "inner", boundary, "at int, w1 bigint, w2 bigint", "note_hash"))
    twice = cut_lineage(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("w1").alias("__1"), F.col("w2").alias("__2")))
    edges = windows.join(twice, (F.col("w1") == F.col("__1")) & (F.col("w2") == F.col("__2")), "left_semi")
    spans = spans.unionByName(edges.select(*here, F.col("at").alias("lo"), (F.col("at") + window).alias("hi")))
    factors = spans.groupBy(*here).agg(F.collect_set(F.struct("lo", "hi")).alias("factors"))

    def remove():
        def cover(notes: list[bytes], factors: list) -> dict:
            out = {"note": [], "n_words": [], "n_removed": []}
            for note, of in zip(notes, factors):
                words = note.split()
                edge = np.zeros(len(words) + 1, np.int64)
                for f in of or ():
                    edge[f["lo"]] += 1
                    edge[f["hi"]] -= 1
                gone = edge.cumsum()[:-1] > 0
                out["note"].append(kept_text(note, words, gone, keep_gaps).decode("utf-8", "replace"))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
            return out

        return cover

    left = map_notes_beside(source, factors, "left", remove, "note string, n_words bigint, n_removed bigint", "__carry")
    return left.select("obs_id", "note", "n_words", "n_removed", *[F.col(f"__carry.`{c}`") for c in carry])
