"""Exact public-tokenizer ids of note pieces, and the frequent pieces of a whole corpus.

A note is cut only where the tokenizer itself always cuts, so the ids of the pieces in order are the
ids of the note:

* ``words``: the word tokenizer lowers case and drops white space. A piece is one of its pre-tokens.
* ``spaced``: the byte tokenizer keeps white space as the start of what follows. A piece is one of its
  pre-tokens.

Both hold for plain text: ASCII without the information separators, and the letters of the Latin-1 and
Latin Extended-A blocks. A note with anything else, or with the mark that special strings begin with,
is cut at ASCII white space only, which is a cut for both tokenizers; the parts that are not plain go
to the library whole. For ``spaced``, where engines differ on what white space is, the note does.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm.merges import Merger
from emberline.llm.notes import noted, slices

_UPPER, _LOWER = "A-Z\u00c0-\u00d6\u00d8-\u00de", "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f"
_ODD = re.compile(f"[^\x00-\x1b\x20-\x7f{_UPPER}{_LOWER}]|<\\|")
_GAP = "\\x20\\x09-\\x0D"
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = re.compile(f"{_SUFFIX}|[{_LOWER}]+|[0-9]|[^{_GAP}0-9{_LOWER}]+")
_SPACED = re.compile(f"{_SUFFIX}| ?[{_UPPER}{_LOWER}]+| ?[0-9]+| ?[^{_GAP}0-9{_UPPER}{_LOWER}]+|[{_GAP}]+(?![^{_GAP}])|[{_GAP}]+")
_CHUNK = re.compile(f"[^{_GAP}]+")
_SPACED_CHUNK = re.compile(f"[{_GAP}]*[^{_GAP}]+|[{_GAP}]+")
_SPACED_WIDE = re.compile(r"\s*\S+|\s+")
# The information separators and U+180E, which some engines call white space.
_UNSURE = re.compile("[\x1c-\x1f\u180e]")
_LONG = 64
#: Pieces of a slice are made distinct before they are looked up, so slices are larger here.
SLICE = 2 << 20


def plain(piece: str) -> bool:
    return _ODD.search(piece) is None


def words(note: str) -> list[str]:
    if plain(note):
        return _WORDS.findall(note.lower())
    out: list[str] = []
    for chunk in _CHUNK.findall(note):
        if plain(chunk):
            out.extend(_WORDS.findall(chunk.lower()))
        else:
            out.append(chunk)
    return out


def spaced(note: str) -> list[str]:
    if plain(note):
        return _SPACED.findall(note)
    if _UNSURE.search(note):
        return [note]
    out: list[str] = []
    for chunk in (_SPACED_WIDE if not note.isascii() else _SPACED_CHUNK).findall(note):
        if plain(chunk):
            out.extend(_SPACED.findall(chunk))
        else:
            out.append(chunk)
    return out


CUTS = {"words": words, "spaced": spaced}


def read_spec(tokenizer_file: str) -> str:
    """The tokenizer file's text; a few MB, sent to the executors with the job."""
    with open(tokenizer_file, encoding="utf-8") as f:
        return f.read()


def texts(notes: list[bytes]) -> list[str]:
    return [n.decode("utf-8", "replace") for n in notes]


_ENCODERS: dict[tuple, Encoder] = {}


class Encoder:
    """Ids of single pieces, merged many at a time, with caches that live as long as the worker.

    Plain pieces are single pre-tokens and go through the merge table; long and other pieces go to the
    library. A cache that would outgrow ``most`` pieces keeps those of the current slice, which holds the
    frequent ones, so a worker's memory stays bounded however many different pieces a task meets.
    """

    def __init__(self, spec: str, most: int = 250_000):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merger = Merger(spec)
        self.most = most
        self.cache: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    @classmethod
    def shared(cls, spec: str) -> Encoder:
        key = (hash(spec), len(spec))
        if key not in _ENCODERS:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
            _ENCODERS[key] = cls(spec)
        return _ENCODERS[key]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every piece."""
        out: list[bytes] = [b""] * len(pieces)
        easy = [i for i, p in enumerate(pieces) if len(p) <= _LONG and plain(p)]
        for i, ids in zip(easy, self.merger.merge([pieces[i].encode() for i in easy])):
            out[i] = ids
        rest = sorted(set(range(len(pieces))).difference(easy))
        if rest:
            run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            for i, e in zip(rest, run([pieces[i] for i in rest], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def ids(self, pieces: set[str], known: Callable[[list[str]], list[bytes | None]] | None = None) -> dict[str, bytes]:
        """A table that holds at least ``pieces`` with their ids; ``known`` is asked for new ones first."""
        new = list(pieces.difference(self.cache))
        if len(self.cache) + len(new) > self.most:
            self.cache = {p: self.cache[p] for p in pieces if p in self.cache}
        if known is not None:
            answers = known(new)
            self.cache.update((p, a) for p, a in zip(new, answers) if a is not None)
            new = [p for p, a in zip(new, answers) if a is None]
        self.cache.update(zip(new, self.encode(new)))
        return self.cache

    def lengths(self, pieces: set[str], known: dict[str, int]) -> dict[str, int]:
        """A table that holds at least ``known`` and ``pieces`` with the number of their ids."""
        new = list(pieces.difference(self.counts))
        if not self.counts or len(self.counts) + len(new) > self.most:
            self.counts = dict(known) | {p: self.counts[p] for p in pieces if p in self.counts}
            new = list(pieces.difference(self.counts))
        self.counts.update(zip(new, (len(i) // 4 for i in self.encode(new))))
        return self.counts


def _trim(counts: Counter, capacity: int) -> None:
    """Keep at most ``capacity`` counters, each less by the largest one that goes (Misra-Gries)."""
    if len(counts) <= capacity:
        return
    values = np.fromiter(counts.values(), np.int64, len(counts))
    floor = int(np.partition(values, len(values) - capacity - 1)[len(values) - capacity - 1])
    kept = {k: v - floor for k, v in counts.items() if v > floor}
    counts.clear()
    counts.update(kept)


def _pack(counts: Counter) -> dict:
    keys = list(counts)
    utf8 = [k.encode() for k in keys]
    return {
        "pieces": b"".join(utf8), "sizes": np.fromiter(map(len, utf8), "<u4", len(keys)).tobytes(),
        "counts": np.fromiter((counts[k] for k in keys), "<i8", len(keys)).tobytes(),
    }


def _unpack(pieces: bytes, sizes: bytes, counts: bytes) -> Counter:
    ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
    return Counter(dict(zip((pieces[a:b].decode() for a, b in zip([0, *ends], ends)), np.frombuffer(counts, "<i8").tolist())))


def frequent_pieces(observations: DataFrame, cut: str, capacity: int) -> list[str]:
    """The most frequent pieces of all notes, at most ``capacity``, most frequent first.

    Every task sums its whole input into one summary of bounded size and only summaries travel, in
    three merging rounds of fixed width, so no piece is ever shuffled. A piece whose share is above
    1 / capacity is always among them. Ties go by the piece.
    """
    summary = "part bigint, pieces binary, sizes binary, counts binary"
    arrow = pa.schema([("part", pa.int64()), ("pieces", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())])
    source = noted(observations).select(F.col("note").cast("binary").alias("note"))

    def row(part: int, counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"part": part, **_pack(counts)}], schema=arrow)

    def count(batches):
        from pyspark import TaskContext

        total, pieces_of = Counter(), CUTS[cut]
        for part in slices(batches, SLICE):
            for note in texts(part.column("note").to_pylist()):
                total.update(pieces_of(note))
            if len(total) > 8 * capacity:
                _trim(total, capacity)
        for piece in [p for p in total if len(p) > _LONG]:
            del total[piece]
        _trim(total, capacity)
        yield row(TaskContext.get().partitionId(), total)

    def merge(table: pa.Table) -> pa.Table:
        total, part = Counter(), 0
        for batch in table.to_batches(max_chunksize=1):
            for r in batch.to_pylist():
                total.update(_unpack(r["pieces"], r["sizes"], r["counts"]))
                part = r["part"]
            _trim(total, capacity)
        return pa.Table.from_batches([row(part, total)])

    parts = source.mapInArrow(count, summary)
    for width in (256, 16, 1):
        parts = parts.withColumn("part", F.pmod("part", F.lit(width))).groupBy("part").applyInArrow(merge, summary)
    total = Counter()
    for r in parts.collect():  # one row at most: the summary of bounded size
        total.update(_unpack(bytes(r.pieces), bytes(r.sizes), bytes(r.counts)))
    return [k for k, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))]
