"""Packing notes into training sequences: vector bin packing by the dot-product rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.notes import give_back, noted, slices
from emberline.llm.pretokens import SLICE, Encoder, read_spec, texts, words

PIECE = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint")


def place(tokens: np.ndarray, loss: np.ndarray, room: int, segments: int, most_loss: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length) under limits on tokens, segments and loss-bearing tokens.

    ``loss[i]`` of example i's tokens bear loss, spread evenly over it. A sequence is one bin with a
    remaining capacity in each of the three dimensions; the next example is the one whose demand has
    the largest dot product with that remainder, each measured as a share of the limit, ties to the
    smaller index. Examples can be cut: pieces of a whole sequence go first, and when no remainder
    fits, the largest one that may be cut fills the gap. Whatever is open at the end is laid out in
    sequences of power-of-two length.
    """
    cap = np.array([room, segments, most_loss], float)
    start = np.zeros(len(tokens), np.int64)
    left = tokens.astype(np.int64).copy()
    rate = np.where(tokens > 0, loss / np.maximum(tokens, 1), 0.0)
    bins: list[list[tuple[int, int, int]]] = []

    def loss_of(i, at, n):  # cumulative rounding: the parts add up to the whole
        return np.floor(rate[i] * (at + n) + 1e-9) - np.floor(rate[i] * at + 1e-9)

    for i in np.flatnonzero(left >= room):
        while left[i] >= room and loss_of(i, start[i], room) <= most_loss:
            bins.append([(int(i), int(start[i]), room)])
            start[i] += room
            left[i] -= room
    open_ = left > 0
    while open_.any():
        rest, used = cap.copy(), []
        while rest[1] >= 1 and rest[0] >= 1:
            at = np.flatnonzero(open_)
            if not len(at):
                break
            need = np.stack([left[at], np.ones(len(at)), loss_of(at, start[at], left[at])], 1)
            fits = (need <= rest).all(1)
            score = np.where(fits, (need / cap) @ (rest / cap), -1.0)
            best = int(score.argmax())
            if score[best] >= 0:
                i, n = int(at[best]), int(left[at[best]])
            else:
                i = int(at[int(left[at].argmax())])
                n = int(min(left[i], rest[0]))
                if rate[i] > 0:
                    n = min(n, int(rest[2] / rate[i]))
                while n > 0 and loss_of(i, start[i], n) > rest[2]:
                    n -= 1
                if n <= 0:
                    break
            used.append((i, int(start[i]), n))
            rest -= [n, 1, loss_of(i, start[i], n)]
            start[i] += n
            left[i] -= n
            open_[i] = left[i] > 0
        bins.append(used)
    return [b for x in bins for b in even(x, room)]


def even(sequence: list[tuple[int, int, int]], room: int) -> list[list[tuple[int, int, int]]]:
    """Cut a sequence that is not full into sequences of power-of-two length."""
    total = sum(n for _, _, n in sequence)
    if total == room or total & (total - 1) == 0:
        return [sequence]
    out, queue = [], list(sequence)[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        want, now = total & (1 << bit), []
        while want:
            i, at, n = queue.pop()
            now.append((i, at, take := min(n, want)))
            want -= take
            if take < n:
                queue.append((i, at + take, n - take))
        if now:
            out.append(now)
    return out


def pack_notes(
    observations: DataFrame, tokenizer_file: str, end_id: int = 2, room: int = 4096, segments: int = 512,
    most_loss: int | None = None, loss: str | None = None, window_docs: int = 1024, window_tokens: int = 1 << 21,
    slice_bytes: int = 2 * SLICE, cache: int = 250_000,
) -> DataFrame:
    """Pieces of all notes in sequences of at most ``room`` tokens.

    obs_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset per piece. A note's
    ids are the tokenizer's, then ``end_id``; a NULL or empty note is the end id alone. ``loss`` names a
    column with the number of loss-bearing tokens of each note (NULL, or no such column: all of them;
    held between 0 and the note's tokens); ``most_loss`` is the limit per sequence (default: ``room``)
    and ``segments`` the limit on pieces per sequence.

    Every task packs its own rows in windows of ``window_docs`` notes or ``window_tokens`` tokens, so
    nothing is shuffled and memory is bounded; a note larger than a window is a window of its own.
    Only the last sequences of a window are not full and those have power-of-two lengths. Sequence ids
    are the partition number times 2^33 plus a counter: they depend on how the input is split, the
    pieces' contents do not. Repeated rows are packed as often as they occur, a NULL obs_id is kept,
    other columns are ignored and an empty table gives no piece.
    """
    most_loss = room if most_loss is None else most_loss
    if not (room > 0 and room & (room - 1) == 0 and segments > 0 and most_loss > 0):
        raise ValueError("room must be a power of two, the limits positive")
    from pyspark.sql import functions as F

    weigh = F.lit(None).cast("bigint") if loss is None else F.col(loss).cast("bigint")
    source = noted(observations, weigh.alias("__loss")).withColumn("note", F.col("note").cast("binary"))
    sent = observations.sparkSession.sparkContext.broadcast(read_spec(tokenizer_file))
    end = np.array([end_id], "<u4").tobytes()
    ddl = f"struct<{PIECE}>"
    schema = source.select("obs_id", F.lit(None).cast(ddl).alias("p")).select("obs_id", "p.*").schema

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def windows(batches) -> Iterator[tuple[list, list[bytes], list]]:
        encoder = Encoder.shared(sent.value)
        encoder.most = cache
        ids, packed, losses, held = [], [], [], 0
        for part in slices(batches, slice_bytes):
            cut = [words(n) for n in texts(part.column("note").to_pylist())]
            table = encoder.ids(set().union(*cut))
            for i, pieces, w in zip(part.column("obs_id").to_pylist(), cut, part.column("__loss").to_pylist()):
                data = b"".join(map(table.__getitem__, pieces)) + end
                if ids and (len(ids) >= window_docs or held + len(data) // 4 > window_tokens):
                    yield ids, packed, losses
                    ids, packed, losses, held = [], [], [], 0
                ids.append(i)
                packed.append(data)
                losses.append(w)
                held += len(data) // 4
        if ids:
            yield ids, packed, losses

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        for ids, packed, losses in windows(batches):
            tokens = np.array([len(d) // 4 for d in packed], np.int64)
            bear = np.array([t if w is None else min(max(w, 0), t) for w, t in zip(losses, tokens)], float)
            rows = {f.name: [] for f in arrow}
            for pieces in place(tokens, bear, room, segments, most_loss):
                offset = 0
                for i, at, n in pieces:
                    rate = bear[i] / tokens[i]
                    rows["obs_id"].append(ids[i])
                    rows["start"].append(at)
                    rows["length"].append(n)
                    rows["ids_crc32"].append(zlib.crc32(memoryview(packed[i])[4 * at:4 * (at + n)]))
                    rows["doc_tokens"].append(int(tokens[i]))
                    rows["loss_tokens"].append(int(np.floor(rate * (at + n) + 1e-9) - np.floor(rate * at + 1e-9)))
                    rows["sequence_id"].append(sequence)
                    rows["offset"].append(offset)
                    offset += n
                sequence += 1
            yield pa.RecordBatch.from_pydict(rows, schema=arrow)
        give_back()

    return source.mapInArrow(run, schema)
