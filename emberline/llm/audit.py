"""How filters of notes interact: a sparse document-term matrix and flags, aggregated over every order of the filters."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from emberline.llm.notes import noted, slices, small_batches
from emberline.session import cut_lineage, release

FILTERS = "ABCDE"
ID_BITS = 62
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = np.isin(np.arange(256), np.arange(65, 91))
_FOLLOWS = np.isin(np.arange(256), np.arange(128, 192))  # bytes that do not begin a code point
_MARKS = np.isin(np.arange(256), list(b"#$%&*|"))


def _fields(columns: str) -> list[StructField]:
    return StructType.fromDDL(columns).fields


def _words(note: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a note, about ``most`` bytes of it at a time, so that a very long one needs no list of all."""
    at = 0
    while at < len(note):
        gap = _GAP.search(note, at + most) if len(note) - at > most else None
        stop = gap.start() if gap else len(note)
        yield note[at:stop].split()
        at = stop


class CsrRows:
    """Rows of a document-term matrix, one a note, with columns by first appearance of the word."""

    def __init__(self):
        self.column: dict[bytes, int] = defaultdict(count().__next__)
        self.bounds, self.columns, self.counts = [0], [], []

    def add(self, note: bytes) -> None:
        parts = [np.fromiter(map(self.column.__getitem__, words), np.int32, len(words)) for words in _words(note)]
        here, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
        self.columns.append(here)
        self.counts.append(n.astype(np.int32))
        self.bounds.append(self.bounds[-1] + len(here))

    def arrays(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Words, row bounds, column of each entry, its count."""
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        return list(self.column), np.array(self.bounds, np.int64), join(self.columns), join(self.counts)


def term_shards(observations: DataFrame, part: str, most: int, bits: int = ID_BITS) -> DataFrame:
    """One row per some ``most`` bytes of notes: their CSR arrays, the words and ids of its columns, and the notes with what the text alone shows.

    A word's id is ``bits`` bits of its XXH64; ``term_matrix`` sees to words that share one.
    """
    small_batches(observations.sparkSession)
    source = noted(observations, F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")).withColumn("note", F.col("note").cast("binary"))
    row = StructType([source.schema["obs_id"], source.schema["part"], *_fields("digest binary, capitals boolean, marks boolean")])
    schema = StructType([*_fields("shard bigint, words array<string>, term_ids array<bigint>, bounds binary, columns binary, counts binary"), StructField("rows", ArrayType(row))])
    arrow = to_arrow_schema(schema)
    row_type = arrow.field("rows").type.value_type

    def run(batches):
        number = count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        matrix, rows, size = CsrRows(), [], 0
        for batch in slices(batches, most):
            notes = batch.column("note").to_pylist()
            for note in notes:
                matrix.add(note)
            seen = np.stack([np.bincount(np.frombuffer(n, np.uint8), minlength=256) for n in notes])
            capitals = 100 * seen[:, _CAPITALS].sum(1) > 5 * (seen.sum(1) - seen[:, _FOLLOWS].sum(1))
            digests = [hashlib.blake2b(n, digest_size=16).digest() for n in notes]
            fields = [batch.column("obs_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(capitals), pa.array(seen[:, _MARKS].any(1))]
            rows.append(pa.StructArray.from_arrays([f.cast(t.type) for f, t in zip(fields, row_type)], fields=list(row_type)))
            size += sum(map(len, notes))
            if size >= most:
                yield shard(next(number), matrix, rows)
                matrix, rows, size = CsrRows(), [], 0
        if rows:
            yield shard(next(number), matrix, rows)

    def shard(number: int, matrix: CsrRows, rows: list) -> pa.RecordBatch:
        words, *arrays = matrix.arrays()
        notes = pa.concat_arrays(rows)
        ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - bits)
        one = [
            pa.array([number]), pa.array([[w.decode("utf-8", "replace") for w in words]], arrow.field("words").type),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids.view(np.int64))).cast(arrow.field("term_ids").type),
            *[pa.array([x.tobytes()], pa.binary()) for x in arrays],
            pa.ListArray.from_arrays(pa.array([0, len(notes)], pa.int32()), notes).cast(arrow.field("rows").type),
        ]
        return pa.RecordBatch.from_arrays(one, schema=arrow)

    return source.mapInArrow(run, schema)


def term_matrix(shards: DataFrame) -> DataFrame:
    """The shards with the ids that a dictionary of the whole corpus gives their words.

    The dictionary holds every different word of all shards, by id. A word keeps the id of its hash unless
    another word has it too; all words of such an id get new ones beyond the range of hashes. Shards
    that hold none of them, as a rule all, are used as they are stored.
    """
    placed = shards.select("shard", F.posexplode(F.arrays_zip("words", "term_ids")).alias("at", "t")).select("shard", "at", F.col("t.words").alias("word"), F.col("t.term_ids").alias("term_id"))
    dictionary = placed.select("word", "term_id").repartition(F.col("term_id")).groupBy("term_id", "word").agg(F.count("*").alias("shards"))
    shared = cut_lineage(dictionary.groupBy("term_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("term_id").alias("__i")))
    if shared.isEmpty():
        return shards.drop("words")
    clash = placed.join(shared, F.col("term_id") == F.col("__i"))
    renamed = cut_lineage(clash.select("word").distinct().withColumn("new_id", F.lit(1 << ID_BITS) + F.monotonically_increasing_id()))
    fixes = clash.join(renamed, "word").groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("at", "new_id"))).alias("fixes"))
    told = shards.drop("words").join(fixes, "shard", "left")
    fixed = F.transform("term_ids", lambda i, at: F.coalesce(F.try_element_at("fixes", at), i))
    return told.withColumn("term_ids", F.when(F.col("fixes").isNull(), F.col("term_ids")).otherwise(fixed)).drop("fixes")


def term_counts(matrix: DataFrame) -> DataFrame:
    """obs_id, part, digest, capitals, marks and the row's ``n_words`` (its sum) and ``n_distinct`` (its entries)."""
    row = matrix.schema["rows"].dataType.elementType
    schema = StructType([*row.fields, *_fields("n_words bigint, n_distinct bigint")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k] for c in batch.schema.names}
                bounds = np.frombuffer(one["bounds"].as_py(), np.int64)
                columns, counts = (np.frombuffer(one[c].as_py(), np.int32) for c in ("columns", "counts"))
                ids = one["term_ids"].values
                ids = np.zeros(0, np.int64) if ids is None else ids.to_numpy()
                if len(np.unique(ids)) != (int(columns.max()) + 1 if len(columns) else 0):
                    raise ValueError("the dictionary does not give every word of a shard an id of its own")
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                rows = one["rows"].values
                made = [pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(np.diff(bounds))]
                yield pa.RecordBatch.from_arrays([rows.field(j).cast(arrow.field(j).type) for j in range(len(row.fields))] + made, schema=arrow)

    return matrix.mapInArrow(run, schema)


def _total(test: Column, n: str = "n") -> Column:
    return F.sum(F.when(test, F.col(n)).otherwise(0)).cast("bigint")


def audit_filters(
    observations: DataFrame, ratings: DataFrame, part: str = "source", reliable: str = "reliable", harmful: str = "harmful",
    least_words: int = 50, most: int = 8 << 20,
) -> DataFrame:
    """What five filters take from ``observations`` (obs_id, note and ``part``), in each of their 120 orders.

    Words are runs without ASCII white space, as they are. A note fails A with fewer than ``least_words`` words, B if
    under 65 % of its words are different, C if more than 5 % of its characters are A-Z, D if it holds one of
    ``# $ % & * |``, and E if another observation with a smaller obs_id has the same note.

    One row per part, ``filter_order`` and ``step``: ``kept`` after the step, ``removed`` by it, ``redundant`` (fails the
    step's filter but was removed before), ``unique_fails`` (fails this filter only), ``good_lost`` and ``toxic_lost``
    (removed here and rated 1 in ``reliable`` or ``harmful`` of ``ratings``, by obs_id; an id rated several times counts if
    one rating is 1) and ``shapley``, the notes its filter removes summed over all orders.

    A NULL note is empty, a NULL part is the empty string. A row with a NULL obs_id fails E never, makes nobody fail it,
    and is unrated. Repeated rows are counted each; rows of one id do not fail E for one another. Other columns are
    ignored, an empty table gives an empty one.

    A and B are read off a document-term matrix: every ``most`` bytes of notes become a CSR shard whose words are
    encoded by a dictionary of the whole corpus. E needs no join: rows are counted by note, part, rating and
    id, then by note, so a text that stands in a third of all rows is a few sums.
    """
    shards = cut_lineage(term_shards(observations, part, most))
    rows = cut_lineage(term_counts(term_matrix(shards)))
    release(shards)
    fails = {"A": F.col("n_words") < least_words, "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"), "C": F.col("capitals"), "D": F.col("marks")}
    text = F.concat(*[F.when(t, F.lit(k)).otherwise(F.lit("")) for k, t in fails.items()])
    each = rows.groupBy("digest", "part", "obs_id", text.alias("text")).agg(F.count("*").alias("n"))
    rated = ratings.where(F.col("obs_id").isNotNull()).groupBy(F.col("obs_id").alias("__id")).agg(
        F.max((F.col(reliable) == 1).cast("int")).alias("good"), F.max((F.col(harmful) == 1).cast("int")).alias("toxic"))
    named = each.where(F.col("obs_id").isNotNull()).join(rated, F.col("obs_id") == F.col("__id"), "left").drop("__id")
    nameless = each.where(F.col("obs_id").isNull()).withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    each = named.unionByName(nameless).withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    keys = ["digest", "part", "text", "good", "toxic"]
    # Of each group of equal notes, the number of rows that carry its smallest id.
    alike = cut_lineage(each.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("obs_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("obs_id").isNotNull(), F.struct("obs_id", "n"))).alias("low")))
    lowest = alike.groupBy("digest").agg(F.min("low.obs_id").alias("lowest")).withColumnRenamed("digest", "__d")
    judged = alike.join(lowest, F.col("digest") == F.col("__d"))
    first = F.col("nameless") + F.when(F.col("low.obs_id") == F.col("lowest"), F.col("low.n")).otherwise(0)
    judged = judged.withColumn("halves", F.array(
        F.struct(F.col("text").alias("fails"), first.alias("n")), F.struct(F.concat("text", F.lit("E")).alias("fails"), (F.col("n") - first).alias("n"))))
    patterns = judged.select("part", "good", "toxic", F.explode("halves").alias("h")).groupBy("part", "h.fails", "good", "toxic").agg(F.sum("h.n").alias("n"))
    patterns = patterns.groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    patterns = cut_lineage(patterns)
    release(rows)
    release(alike)

    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = patterns.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumns({"letter": F.expr("substring(filter_order, step, 1)"), "before": F.expr("substring(filter_order, 1, step - 1)")})
    there = F.expr("translate(before, fails, '') = before")  # no earlier filter has removed it
    failing = F.expr("instr(fails, letter) > 0")
    n_orders = len(list(permutations(FILTERS)))
    # In 1 of m orders is one of m failed filters the first of them.
    shares = F.when(failing, F.col("n") * F.floor(F.lit(n_orders) / F.length("fails"))).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        _total(there & ~failing).alias("kept"), _total(there & failing).alias("removed"), _total(~there & failing).alias("redundant"),
        _total(F.col("fails") == F.col("letter")).alias("unique_fails"), _total(there & failing, "good").alias("good_lost"),
        _total(there & failing, "toxic").alias("toxic_lost"), F.sum(shares).cast("bigint").alias("shapley"))
