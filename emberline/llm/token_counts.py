"""Token counts of notes by a public tokenizer, looked up on the map side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.notes import map_notes
from emberline.llm.pretokens import SLICE, Encoder, frequent_pieces, read_spec, texts, words


class LengthTable:
    """Piece -> token count, packed: the pieces end to end in UTF-8, their sizes and their counts."""

    def __init__(self, pieces: list[str], lengths: list[int]):
        utf8 = [p.encode() for p in pieces]
        self.pieces = b"".join(utf8)
        self.sizes = np.array([len(p) for p in utf8], "<u4").tobytes()
        self.lengths = np.array(lengths, "<u4").tobytes()

    def unpack(self) -> dict[str, int]:
        ends = np.cumsum(np.frombuffer(self.sizes, "<u4")).tolist()
        words = (self.pieces[a:b].decode() for a, b in zip([0, *ends], ends))
        return dict(zip(words, np.frombuffer(self.lengths, "<u4").tolist()))


def count_tokens(observations: DataFrame, tokenizer_file: str, limit: int = 2048, table_size: int = 1 << 15) -> DataFrame:
    """obs_id, n_bytes, n_tokens, over_limit per observation, exact for the whole note.

    Two tiers, both on the map side: a broadcast table of the ``table_size`` most frequent pieces of
    all notes (at most 64 characters a piece, so some 2 MB) answers most lookups, the rest is encoded
    once per worker and kept in the worker's bounded cache. No piece is shuffled, and
    what the table holds changes the speed only.

    A NULL or empty note has 0 bytes and 0 tokens. Special strings of the tokenizer inside a note
    count as the library counts them. Repeated rows each get their row; a NULL obs_id stays NULL;
    an empty table gives an empty one; other columns are ignored.
    """
    spec = read_spec(tokenizer_file)
    frequent = frequent_pieces(observations, "words", table_size)
    table = LengthTable(frequent, [len(i) // 4 for i in Encoder.shared(spec).encode(frequent)])
    sent = observations.sparkSession.sparkContext.broadcast((spec, table))

    def make():
        spec, table = sent.value
        encoder, known = Encoder.shared(spec), table.unpack()

        def count(notes: list[bytes]) -> dict:
            cut = [words(n) for n in texts(notes)]
            found = encoder.lengths(set().union(*cut), known)
            return {"n_bytes": list(map(len, notes)), "n_tokens": [sum(map(found.__getitem__, c)) for c in cut]}

        return count

    counted = map_notes(observations, make, "n_bytes bigint, n_tokens bigint", most=SLICE)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
