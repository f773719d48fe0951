"""Recurring lines of notes, found by a log-template tree."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.notes import HERE, map_notes, map_notes_beside, placed
from emberline.session import cut_lineage, release

_FIELD = re.compile(rb"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_DIGIT = re.compile(rb"[0-9]")
_WRAP = (1 << 64) - 1
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
PARTS = len(_ODD)
LEVELS = [4**k for k in range(14)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_keys(line: bytes, depth: int, least_general: int) -> tuple[int, list[int], bytes | None]:
    """The leaf of a line in the tree, the templates it fits, as 64-bit hashes, and the tokens after the leading ones.

    Tokens with a digit are fields and read ``<*>``. The tree branches by the number of tokens, then by
    the first ``depth`` of them. Within the leaf the first template is the line itself; a line of
    ``least_general`` tokens or more also fits five with one contiguous fifth of its remaining tokens left
    open. Open positions elsewhere are found from counts, by ``open_templates``; for that come the remaining
    tokens, if the line is long enough to have one.
    """
    tokens = (_FIELD.sub(b"<*>", line) if _DIGIT.search(line) else line).split()
    leaf = xxhash.xxh64_intdigest(b"%d %s" % (len(tokens), b" ".join(tokens[:depth])), 1)
    rest = tokens[depth:]
    tail = b" ".join(rest) if len(tokens) >= PARTS and rest else None
    if len(tokens) < least_general:
        return leaf, [xxhash.xxh64_intdigest(b" ".join(rest), leaf)], tail
    n = len(rest)
    each = [xxhash.xxh64_intdigest(b" ".join(rest[k * n // PARTS : (k + 1) * n // PARTS]), leaf) * odd & _WRAP for k, odd in enumerate(_ODD)]
    total = sum(each)
    return leaf, [xxhash.xxh64_intdigest(b"%d %d" % (k, (total - e) & _WRAP), leaf) for k, e in enumerate([0, *each])], tail


def note_lines(note: bytes, depth: int, least_tokens: int, least_general: int) -> list[tuple[int, int, list[int], bytes | None]]:
    """(line number, leaf, templates, tokens after the leading ones) of every line that is not blank.

    A line of fewer than ``least_tokens`` tokens is its own leaf and only template, digits and all.
    """
    lines = note.split(b"\n")
    out = []
    for k, line in enumerate(lines):
        tokens = line.split(None, least_tokens - 1)
        if not tokens:
            continue
        if len(tokens) < least_tokens:
            leaf = xxhash.xxh64_intdigest(b" ".join(line.split()), 2)
            keys, tail = [leaf], None
        else:
            leaf, keys, tail = line_keys(line, depth, least_general)
        out.append((k, leaf, keys, tail))
    return out


def open_templates(lines: DataFrame, depth: int, least_docs: int) -> DataFrame:
    """(exact, template): for the different ``lines`` (exact, leaf, tail), templates with scattered open positions.

    Tokens are counted by leaf and position over the different texts that hold the line (``n``). At each
    level, ``least_docs`` times a power of four, a line's tokens that are rarer there are left open; it is
    a template if one token or more, and at most a fifth of the line's, are open, so that names and
    sections that are each frequent still open below the level of the words around them. Templates that
    one line alone fits are left out.
    """
    tokens = lines.select("exact", "leaf", "n", F.posexplode(F.split(F.col("tail").cast("string"), " ")).alias("at", "word"))
    tokens = cut_lineage(tokens.select("exact", "leaf", "n", "at", F.xxhash64("word").alias("word")))
    counts = cut_lineage(tokens.groupBy("leaf", "at", "word").agg(F.sum("n").alias("seen")).select(*[F.col(c).alias(f"__{c}") for c in ("leaf", "at", "word")], "seen"))
    counted = tokens.join(counts, (F.col("leaf") == F.col("__leaf")) & (F.col("at") == F.col("__at")) & (F.col("word") == F.col("__word")))
    whole = counted.groupBy("exact", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "word", "seen"))).alias("words"))

    def at_level(level):
        kept = F.transform("words", lambda w: F.when(w["seen"] >= level, w["word"]).otherwise(F.lit(0).cast("bigint")))
        opened = F.size(F.filter("words", lambda w: w["seen"] < level))
        return F.when((opened > 0) & (opened * PARTS <= F.size("words") + depth), F.xxhash64(F.lit("open"), "leaf", kept))

    found = F.array_distinct(F.array_compact(F.transform(F.array(*[F.lit(k * least_docs).cast("bigint") for k in LEVELS]), at_level)))
    fits = cut_lineage(whole.select("exact", F.explode(found).alias("template")))
    several = cut_lineage(fits.groupBy("template").agg(F.count("*").alias("n")).where("n > 1").select(F.col("template").alias("__t")))
    out = cut_lineage(fits.join(several, F.col("template") == F.col("__t")).drop("__t"))
    for done in (tokens, counts, fits, several):
        release(done)
    return out


def drop_recurring_lines(
    observations: DataFrame, depth: int = 3, least_docs: int = 5, least_tokens: int = 3, least_general: int = 10, carry: list[str] = (),
) -> DataFrame:
    """obs_id, note, n_lines, n_dropped (and the ``carry`` columns) per observation.

    Lines end at a line feed. A template recurs when lines that fit it stand in notes of ``least_docs``
    different texts, whatever stands around them, so the lines of a note that was only copied as a whole do
    not count as recurring. Every line of a recurring template is dropped but the
    first: that of the smallest obs_id (NULL last), then of the smallest hash of the note and line number. Lines of fewer than
    ``least_tokens`` tokens recur only as they are, their digits included; blank lines stay.

    A NULL note is empty; an empty note has no lines; a note that loses nothing comes back unchanged, and
    one that loses every line comes back empty, its row is kept. Repeated rows are one note here: they
    keep or lose the same lines. Other columns are ignored, an empty table gives an empty one.

    Leaves are counted first and only lines in leaves with enough lines go on to the templates, which are
    counted by partial aggregation; a line common to a third of all notes is a count, not a group.
    """
    source, here = placed(observations, carry), list(HERE)

    def parse():
        def lines(notes: list[bytes]) -> dict:
            found = [(r, *x) for r, n in enumerate(notes) for x in note_lines(n, depth, least_tokens, least_general)]
            return {
                "rows": [f[0] for f in found], "line": [f[1] for f in found], "leaf": [_signed(f[2]) for f in found],
                "templates": [[_signed(k) for k in f[3]] for f in found], "tail": [f[4] for f in found],
            }

        return lines

    parsed = cut_lineage(map_notes(source, parse, "line int, leaf bigint, templates array<bigint>, tail binary", "note_hash", most=1 << 18))
    busy = cut_lineage(parsed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select(F.col("leaf").alias("__l")))
    inside = cut_lineage(parsed.join(busy, F.col("leaf") == F.col("__l")).drop("__l"))
    fits = cut_lineage(inside.select(*here, "line", F.explode("templates").alias("template")))
    varied = inside.where("tail IS NOT NULL").select(*here, "line", "leaf", "tail", F.col("templates")[0].alias("exact"))
    alike = varied.select("exact", "leaf", "tail", "note_hash").distinct().groupBy("exact", "leaf", "tail").agg(F.count("*").alias("n"))
    opened = open_templates(cut_lineage(alike), depth, least_docs).withColumnRenamed("exact", "__e")
    wider = varied.join(opened, F.col("exact") == F.col("__e")).select(*here, "line", "template")
    counted = fits.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select(F.col("template").alias("__t"))
    counted = cut_lineage(counted)
    often = cut_lineage(fits.join(counted, F.col("template") == F.col("__t")).drop("__t").unionByName(wider))
    for done in (parsed, busy, inside, fits, counted):
        release(done)
    texts = often.select("template", "note_hash").distinct().groupBy("template").agg(F.count("*").alias("texts"))
    order = F.struct(F.col("obs_id").isNull().alias("x"), *[F.col(c) for c in here], F.col("line"))
    first = often.groupBy("template").agg(F.min(order).alias("first"))
    recurring = first.join(texts.where(F.col("texts") >= least_docs), "template")
    recurring = cut_lineage(recurring.select(F.col("template").alias("__t"), "first"))
    gone = often.join(recurring, F.col("template") == F.col("__t")).where(order != F.col("first")).groupBy(*here).agg(F.collect_set("line").alias("gone"))

    def remove():
        def cut(notes: list[bytes], gone: list) -> dict:
            out = {"note": [], "n_lines": [], "n_dropped": []}
            for note, numbers in zip(notes, gone):
                lines = note.split(b"\n") if note else []
                drop = set(numbers or ())
                kept = b"\n".join([x for k, x in enumerate(lines) if k not in drop]) if drop else note
                out["note"].append(kept.decode("utf-8", "replace"))
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(drop))
            return out

        return cut

    left = map_notes_beside(source, gone, "left", remove, "note string, n_lines bigint, n_dropped bigint", "__carry")
    return left.select("obs_id", "note", "n_lines", "n_dropped", *[F.col(f"__carry.`{c}`") for c in carry])
