"""Byte-level BPE encoding and decoding of notes through a minimal acyclic word automaton."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from emberline.llm.merges import BYTE_CHAR
from emberline.llm.notes import map_notes
from emberline.llm.pretokens import SLICE, Encoder, frequent_pieces, read_spec, spaced, texts
from emberline.session import shared_file


class Lexicon:
    """Minimal acyclic automaton of pieces, transducing each to its token ids.

    Equal suffixes share states. Walking a piece adds up the number of accepted pieces that sort
    before it, which is its row in the id table: the output of the transducer. All of it is flat
    arrays, so a file of them can be memory-mapped and shared by the workers of a machine.
    """

    PARTS = (("edge_key", "<u4"), ("edge_to", "<u4"), ("edge_skip", "<u4"), ("final", "<u1"), ("ends", "<u4"), ("ids", "<u4"))

    def __init__(self, arrays: dict[str, np.ndarray], longest: int, start: int):
        self.arrays, self.longest, self.start = arrays, longest, start

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """From pieces and their ids; suffixes are merged while the sorted pieces are added."""
        order = sorted(p for p in entries if p)
        register: dict[tuple, int] = {}
        edges: list[list[tuple[int, int]]] = []
        accept: list[bool] = []

        def settle(path: list, depth: int) -> None:
            while len(path) > depth + 1:
                is_final, out = path.pop()
                key = (is_final, tuple(out))
                if key not in register:
                    register[key] = len(edges)
                    edges.append(out)
                    accept.append(is_final)
                parent = path[-1][1]
                parent[-1] = (parent[-1][0], register[key])

        path: list = [[False, []]]
        before = b""
        for piece in order:
            common = 0
            while common < min(len(before), len(piece)) and before[common] == piece[common]:
                common += 1
            settle(path, common)
            for byte in piece[common:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            before = piece
        settle(path, 0)
        start = len(edges)
        edges.append(path[0][1])
        accept.append(False)
        # A state's edges lead to states settled earlier, so one pass in order counts what each accepts.
        below = [0] * len(edges)
        keys, to, skip = [], [], []
        for state, out in enumerate(edges):
            seen = int(accept[state])
            for byte, target in out:
                keys.append(state << 8 | byte)
                to.append(target)
                skip.append(seen)
                seen += below[target]
            below[state] = seen
        ids = [entries[p] for p in order]
        arrays = {
            "edge_key": np.array(keys, "<u4"), "edge_to": np.array(to, "<u4"), "edge_skip": np.array(skip, "<u4"),
            "final": np.array(accept, "<u1"), "ends": np.cumsum([0, *map(len, ids)]).astype("<u4"),
            "ids": np.array([i for x in ids for i in x], "<u4"),
        }
        return cls(arrays, max(map(len, order), default=0), start)

    def to_bytes(self) -> bytes:
        head = np.array([self.longest, self.start, *(len(self.arrays[n]) for n, _ in self.PARTS)], "<i8").tobytes()
        body = b""
        for name, _ in self.PARTS:
            data = self.arrays[name].tobytes()
            body += data + b"\0" * (-len(data) % 8)
        return head + body

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        raw = np.memmap(path, np.uint8, "r")
        head = np.frombuffer(raw[: 8 * (2 + len(cls.PARTS))].tobytes(), "<i8")
        at, arrays = 8 * len(head), {}
        for (name, kind), n in zip(cls.PARTS, head[2:]):
            size = int(n) * np.dtype(kind).itemsize
            arrays[name] = raw[at : at + size].view(kind)
            at += size + -size % 8
        return cls(arrays, int(head[0]), int(head[1]))

    def rows(self, pieces: list[bytes]) -> np.ndarray:
        """The id-table row of every piece, -1 for those the automaton does not accept."""
        out = np.full(len(pieces), -1, np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        keys, n = self.arrays["edge_key"], len(self.arrays["edge_key"])
        live = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        if not n or not len(live):
            return out
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(sizes) - sizes
        live = live[np.argsort(sizes[live], kind="stable")]  # those that end early leave from the front
        state = np.full(len(live), self.start, np.int64)
        rank = np.zeros(len(live), np.int64)
        for step in range(self.longest):
            if not len(live):
                break
            want = (state << 8 | flat[begin[live] + step]).astype(np.uint32)
            at = np.minimum(np.searchsorted(keys, want), n - 1)
            ok = keys[at] == want
            live, at, rank = live[ok], at[ok], rank[ok] + self.arrays["edge_skip"][at[ok]]
            state = self.arrays["edge_to"][at].astype(np.int64)
            done = sizes[live] == step + 1
            if done.any():
                good = done & (self.arrays["final"][state] == 1)
                out[live[good]] = rank[good]
                live, state, rank = live[~done], state[~done], rank[~done]
        return out

    def ids(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of the pieces as little-endian unsigned 32-bit numbers, None for those not accepted."""
        rows = self.rows([p.encode() for p in pieces])
        data, ends = self.arrays["ids"].tobytes(), self.arrays["ends"]
        lo, hi = ends[np.maximum(rows, 0)] * 4, ends[np.maximum(rows, 0) + 1] * 4 if len(ends) > 1 else ends[rows * 0]
        return [data[a:b] if r >= 0 else None for r, a, b in zip(rows.tolist(), lo.tolist(), hi.tolist())]


class Decoder:
    """Bytes of id sequences; a token outside the byte alphabet (none in a byte-level vocabulary) is its text."""

    def __init__(self, encoder: Encoder):
        back = {c: b for b, c in BYTE_CHAR.items()}
        vocab = encoder.tokenizer.get_vocab(with_added_tokens=True)
        stands = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            stands[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.size = np.array([len(x) for x in stands], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(stands), np.uint8)

    def decode(self, packed: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(packed), "<u4")
        size = self.size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        data = self.flat[np.repeat(self.begin[ids] - (end - size), size) + np.arange(total)].tobytes()
        stop = np.concatenate([[0], end])[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
        cut = [data[a:b] for a, b in zip(stop, stop[1:])]
        return [d if d.isascii() else d.decode("utf-8", "replace").encode() for d in cut]


def encode_notes(observations: DataFrame, tokenizer_file: str, lexicon_size: int = 1 << 15, keep_ids: bool = True) -> DataFrame:
    """obs_id, n_tokens, ids_sha256, decoded_sha256 (and with ``keep_ids`` the ids) per observation.

    The ``lexicon_size`` most frequent pieces of all notes and their ids are compiled into a minimal
    acyclic transducer whose file (a few MB) executors fetch from the shared folder and memory-map.
    A worker keeps a bounded table of the pieces it has met and walks new ones through the automaton, all
    those of a slice at once; pieces it does not accept are merged exactly, many at a time. Decoding goes from the ids back through the vocabulary's bytes, with
    bytes that form no character replaced as the library does. Ids are hashed as little-endian
    unsigned 32-bit integers, decoded text as UTF-8, in lowercase hex.

    A NULL or empty note has no ids and decodes to the empty text. Special strings inside a note are
    the special tokens, as in the library. Repeated rows each get their row, a NULL obs_id stays, other
    columns are ignored, an empty table gives an empty one.
    """
    spark = observations.sparkSession
    spec = read_spec(tokenizer_file)
    frequent = frequent_pieces(observations, "spaced", lexicon_size)
    known = {p.encode(): np.frombuffer(i, "<u4").tolist() for p, i in zip(frequent, Encoder.shared(spec).encode(frequent))}
    compiled = Lexicon.compile(known).to_bytes()
    name = shared_file(spark, f"lexicon-{hashlib.sha256(compiled).hexdigest()[:24]}.bin", compiled)
    sent = spark.sparkContext.broadcast(spec)

    def make():
        from pyspark import SparkFiles

        encoder, lexicon = Encoder.shared(sent.value), Lexicon.mapped(SparkFiles.get(name))
        decoder = Decoder(encoder)

        def encode(notes: list[bytes]) -> dict:
            cut = [spaced(n) for n in texts(notes)]
            ids = encoder.ids(set().union(*cut), lexicon.ids)
            packed = [b"".join(map(ids.__getitem__, c)) for c in cut]
            decoded = decoder.decode(packed)
            out = {
                "n_tokens": [len(p) // 4 for p in packed],
                "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
            }
            if keep_ids:
                out["ids"] = [np.frombuffer(p, "<i4") for p in packed]
            return out

        return encode

    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return map_notes(observations, make, columns, most=SLICE)
