"""Fingerprints of notes: threshold-scaled sketches of word shingles, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAPS = " \t\n\r\x0b\x0c"
WIDTH = 12  # hexadecimal digits of a retained hash
MOST_SLOTS = 4096


def words_of(note: Column) -> Column:
    """Runs without ASCII white space; none for a NULL or blank note."""
    inner = F.btrim(note, F.lit(GAPS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def with_sketch(df: DataFrame, note: str, sketch: str, fraction: float = 0.25, shingle_words: int = 5) -> DataFrame:
    """Adds ``sketch``: the sorted hashes of all shingles of ``note`` that lie below ``fraction`` of the hash range.

    A shingle is ``shingle_words`` words in a row, a note with fewer words being one shingle; its hash is
    the first 12 hexadecimal digits of the MD5 of the words with one space between them. The threshold is
    the same for every note, so the sketch of several notes together is the union of theirs, and what a
    small note shares with a very large one can be read off the two sketches. A note none of whose hashes
    is below the threshold keeps its smallest one; a note without words has an empty sketch.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction lies in (0, 1]")
    limit = format(min(int(fraction * 16**WIDTH), 16**WIDTH - 1), f"0{WIDTH}x")
    w, h = f"__w_{sketch}", f"__h_{sketch}"
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle_words - 1), F.lit(1)))
    hashes = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(F.col(w), i, shingle_words), " ").cast("binary")), 1, WIDTH))
    low = F.filter(F.col(h), lambda x: x < limit if fraction < 1 else F.lit(True))
    kept = F.when(F.size(h) == 0, F.col(h)).when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(h)))
    out = df.withColumn(w, words_of(F.col(note)))
    out = out.withColumn(h, F.when(F.size(w) > 0, hashes).otherwise(F.array().cast("array<string>")))
    return out.withColumn(sketch, kept).drop(w, h)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller sketch's shingles that the other has: 0 to 1, 1 for two empty sketches."""
    smaller = F.least(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(smaller == 0, F.lit(0.0)).otherwise(both / smaller)


def _slots(ids: DataFrame, per_slot: int) -> Column:
    """A number for ``obs_id``, ascending with it, of at most MOST_SLOTS ranges with like numbers of rows.

    Only the bounds of the ranges reach the driver. Rows without an id are dealt to slots below zero.
    """
    n = ids.where(F.col("obs_id").isNotNull()).count()
    slots = max(1, min(MOST_SLOTS, -(-n // per_slot)))
    side = max(1, round(slots**0.5))
    cuts: list[int] = []
    if slots > 1:
        cuts = sorted(set(ids.agg(F.percentile_approx("obs_id", [k / slots for k in range(1, slots)], 4 * slots)).first()[0]))
    # Two short searches: the block of bounds, then the place in the block.
    blocks = [cuts[k : k + side] for k in range(0, len(cuts), side)]
    below = lambda bounds: F.size(F.filter(bounds, lambda c: c < F.col("obs_id")))
    if not blocks:
        slot = F.lit(0)
    else:
        kind = ids.schema["obs_id"].dataType.simpleString()
        table = F.lit(cuts).cast(f"array<{kind}>") if len(cuts) else F.array()
        block = below(F.lit([b[-1] for b in blocks]).cast(f"array<{kind}>"))
        slot = block * side + below(F.slice(table, block * side + 1, F.lit(side)))
    return F.when(F.col("obs_id").isNull(), -1 - F.pmod(F.xxhash64("note"), F.lit(64)).cast("int")).otherwise(slot.cast("int"))


def in_ring(observations: DataFrame, per_slot: int = 512) -> DataFrame:
    """(obs_id, note, next_note, ...): every note beside the next one in descending obs_id; after the last comes the first.

    Equal ids follow the order of their notes; rows without an id come last, in an order of their own.
    A note on its own is its own next one. Notes are dealt to ranges of ids once; each range also gets a
    copy of the first note of the range after it, so no second exchange is needed. All other columns of
    ``observations`` come along, those of the next row in the struct ``next``.
    """
    source = observations.withColumn("slot", _slots(observations.select("obs_id", "note"), per_slot))
    firsts = source.groupBy("slot").agg(F.max("obs_id").alias("id"))  # at most MOST_SLOTS + 64 rows
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("slot"))
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = firsts.select(F.col("slot").alias("s"), "id", F.coalesce(F.lag("slot").over(order), F.last("slot").over(ends)).alias("before"))
    found = source.join(F.broadcast(ahead), (F.col("slot") == F.col("s")) & F.col("obs_id").eqNullSafe(F.col("id")))
    guests = found.groupBy("before").agg(F.min("note").alias("note"), F.min("obs_id").alias("obs_id"))
    rows = source.select("slot", "obs_id", "note", F.lit(0).alias("guest")).unionByName(guests.select(F.col("before").alias("slot"), "obs_id", "note", F.lit(1).alias("guest")))
    return rows.repartition("slot")


def next_of(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``in_ring`` with ``next_*`` for each of ``columns``, guests gone."""
    inside = Window.partitionBy("slot").orderBy("guest", F.col("obs_id").desc_nulls_last(), "note")
    led = rows.withColumn("next", F.lead(F.struct(*columns)).over(inside)).where("guest = 0")
    return led.select(*[c for c in led.columns if c not in ("next", "guest", "slot")], *[F.col(f"next.{c}").alias(f"next_{c}") for c in columns])


def fingerprint_edits(observations: DataFrame, fraction: float = 0.25, shingle_words: int = 5) -> DataFrame:
    """Fingerprints of every note and of an edited copy, and how alike they are.

    obs_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint (the sketches' hashes
    end to end), near_edited and near_next per observation. The edited copy has the last floor(n_chars/3)
    code points replaced by the first as many (or all) of the next note in descending obs_id; after the
    last comes the first. ``near_*`` is the containment estimate of the note's sketch against that of the
    edited copy and of the next note.

    A NULL note is empty; two notes without words are alike (1), one beside a note with words is not (0).
    Equal notes have equal fingerprints. obs_id must be numeric; equal ids follow the order of their
    notes, NULL ids come last. Other columns are ignored; an empty table gives an empty one.
    """
    notes = observations.select("obs_id", F.coalesce("note", F.lit("")).alias("note"))
    rows = with_sketch(in_ring(notes), "note", "sketch", fraction, shingle_words)
    both = next_of(rows, "note", "sketch")
    n = F.length("note")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("note"), F.lit(1), n - third), F.substring(F.col("next_note"), F.lit(1), third))
    both = both.select("obs_id", n.cast("bigint").alias("n_chars"), "sketch", edited.alias("edited"), containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
    both = with_sketch(both, "edited", "changed", fraction, shingle_words)
    return both.select(
        "obs_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("changed", "").alias("edited_fingerprint"), containment(F.col("sketch"), F.col("changed")).alias("near_edited"), "near_next",
    )
