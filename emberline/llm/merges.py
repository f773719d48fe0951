"""Exact byte-pair merging of many words at once."""

from __future__ import annotations

import json

import numpy as np

#: Printable Latin-1 bytes stand for themselves in a byte-level vocabulary, the others follow from U+0100.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHAR = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
_NONE = np.int32(2**31 - 1)


class Merger:
    """Merge table of a byte-level vocabulary: words become ids by the lowest-ranked pair first, the leftmost of equals."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        n = max(vocab.values()) + 1
        self.first = np.array([vocab[BYTE_CHAR[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[BYTE_CHAR[b] + end] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.n, self.keys, self.rank = n, keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.rank[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit numbers; an empty word has none."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        order = order[np.searchsorted(size[order], 1):]
        while len(order):
            width = int(size[order[0]] * 1.125)  # words of like length share a table
            n = min(int(np.searchsorted(size[order], width, "right")), max(1, (1 << 21) // width))
            self._merge_block(words, order[:n], size, out)
            order = order[n:]
        return out

    def _merge_block(self, words: list[bytes], rows: np.ndarray, size: np.ndarray, out: list[bytes]) -> None:
        length = size[rows]
        width = int(length.max())
        flat = np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8)
        inside = np.arange(width) < length[:, None]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[inside] = self.first[flat]
        ids[np.arange(len(rows)), length - 1] = self.last[flat[np.cumsum(length) - 1]]
        rank = np.full((len(rows), width), _NONE, np.int32)
        rank[:, :-1] = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        live = rows
        while True:
            at = rank.argmin(1)
            k = np.arange(len(live))
            best = rank[k, at]
            done = best == _NONE
            if done.any():
                ended = np.flatnonzero(done)
                count = (ids[ended] >= 0).sum(1)
                data, stop = ids[ended][ids[ended] >= 0].astype("<u4").tobytes(), np.cumsum(count) * 4
                for r, a, b in zip(live[ended].tolist(), np.r_[0, stop[:-1]].tolist(), stop.tolist()):
                    out[r] = data[a:b]
                keep = np.flatnonzero(~done)
                if not len(keep):
                    return
                live, ids, rank, at, best = live[keep], ids[keep], rank[keep], at[keep], best[keep]
                k = np.arange(len(live))
            # The pair becomes one symbol and everything right of it moves up one place.
            width = ids.shape[1] - 1
            place = np.arange(width)
            move = place + (place > at[:, None]) + (k * (width + 1))[:, None]
            ids = ids.take(move)
            rank = rank.take(move)
            cell = k * width + at
            merged = self.made[best]
            ids.put(cell, merged)
            rank.put(cell, _NONE)
            right = np.flatnonzero(at < width - 1)
            rank.put(cell[right], self._ranks(merged[right], ids.take(cell[right] + 1)))
            left = np.flatnonzero(at > 0)
            rank.put(cell[left] - 1, self._ranks(ids.take(cell[left] - 1), merged[left]))
