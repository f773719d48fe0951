"""Token counts, packing and encoding against the public libraries on whole notes."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberline.llm.lexicon import Lexicon, encode_notes
from emberline.llm.packing import even, pack_notes, place
from emberline.llm.pretokens import frequent_pieces, spaced
from emberline.llm.token_counts import count_tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  \t", "a", "  lead and trail  ", "a\n b", "a\n\n  b\t\tc", "x\x0b\x0cy \x0b z", "it's we'll they'RE 'S",
    "a\x1cb !\x1c? \x1f x", "nb sp   b   c", "　wide  space    x\u0085  y", "é ́x ñ",
    "ΣΊΣΥΦΟΣ ΟΔΟΣ", "İstanbul ǅ ß", "hello <|endoftext|> there<|endoftext|>x  <|endoftext|>  y <|startoftext|>z", "日本語 テキスト 123 ４５",
    "🔥🔥 fire‍🔥 ﻿", "᠎ a᠎ b", "word " * 3000, "x" * 5000, "!!!??? ... --- ###", "0123 4 56.7e8", "\r\n line\r\n", "a   b  b",
]


@pytest.fixture(scope="module")
def observations(spark):
    rng = random.Random(5)
    alphabet = "ab é'ñ\n\t .,! 　\x1c0Σ<|>́"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + k, "".join(rng.choice(alphabet) for _ in range(60))) for k in range(150)]
    rows += [(3, "  lead and trail  "), (None, "no id"), (3, "  lead and trail  ")]
    return spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "obs_id long, note string, n_tokens int, start string")


def test_counts_are_the_library_s(observations):
    tok = Tokenizer.from_file(WORD)
    got = count_tokens(observations, WORD, limit=50, table_size=8).collect()
    expect = [(r.obs_id, len((r.note or "").encode()), len(tok.encode(r.note or "", add_special_tokens=False).ids)) for r in observations.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.obs_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(expect, key=key)
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)


def test_codec_is_the_library_s(observations):
    tok = Tokenizer.from_file(BYTE)
    got = encode_notes(observations, BYTE, lexicon_size=40).collect()
    expect = []
    for r in observations.collect():
        ids = tok.encode(r.note or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        expect.append((r.obs_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.obs_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expect)
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_pieces_join_to_the_note():
    for t in ODD:
        assert "".join(spaced(t or "")) == (t or "")


def test_lexicon_accepts_its_words_only_and_shares_suffixes(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["ing", "sing", "ringing", "ringings", "a", "é", "\x00b", "stinging"])}
    path = tmp_path / "l.bin"
    path.write_bytes(Lexicon.compile(words).to_bytes())
    lex = Lexicon.mapped(str(path))
    asked = [*words, b"", b"in", b"rings", b"ringingsx", b"\xc3", b"z" * 100]
    rows = lex.rows(asked)
    assert lex.ids([w.decode() for w in words] + ["in"]) == [np.array(v, "<u4").tobytes() for v in words.values()] + [None]
    assert (rows[len(words):] == -1).all()
    assert len(lex.arrays["final"]) < sum(map(len, words))  # fewer states than a trie
    assert Lexicon.compile({}).ids(["a", ""]) == [None, None]


def test_frequent_pieces_finds_heavy_ones(spark):
    rows = [(i, "common " + chr(97 + i % 26) * (2 + i // 26)) for i in range(400)]
    assert frequent_pieces(spark.createDataFrame(rows, "obs_id long, note string").repartition(7), "words", 16)[0] == "common"
    assert frequent_pieces(spark.createDataFrame([], "obs_id long, note string"), "words", 16) == []


def check_packing(rows, expect, room):
    """Every id of every note in one piece, sequences gapless and within the limit."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= room
    left = {}
    for r in rows:
        left.setdefault((r.obs_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for key, parts in left.items():
        ids, copies = expect[key]
        cover = np.zeros(len(ids) + 1, int)
        for at, n, crc in parts:
            assert zlib.crc32(ids[at:at + n].tobytes()) == crc
            cover[at:at + n] += 1
        assert (cover[:-1] == copies).all()
    assert set(left) == set(expect)
    return by_seq


def test_packing_covers_every_id_once(observations):
    tok = Tokenizer.from_file(WORD)
    rows = pack_notes(observations, WORD, room=256, window_docs=40).collect()
    expect = {}
    for r in observations.collect():
        ids = np.array([*tok.encode(r.note or "", add_special_tokens=False).ids, 2], "<u4")
        expect[(r.obs_id, len(ids))] = (ids, expect.get((r.obs_id, len(ids)), (0, 0))[1] + 1)
    by_seq = check_packing(rows, expect, 256)
    totals = [sum(r.length for r in v) for v in by_seq.values()]
    assert all(t & (t - 1) == 0 for t in totals)  # no padding at all


def test_packing_limits_and_loss(spark):
    rows = [(i, "w " * (i % 30), i % 40 if i % 7 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "obs_id long, note string, bear int")
    got = pack_notes(df, WORD, room=64, segments=3, most_loss=20, loss="bear").collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert all(len(v) <= 3 and sum(r.loss_tokens for r in v) <= 20 and sum(r.length for r in v) <= 64 for v in by_seq.values())
    total = sum(min(b, 30) if b is not None else (i % 30) + 1 for i, _, b in [(i, n, min(b, (i % 30) + 1) if b is not None else None) for i, n, b in rows])
    assert sum(r.loss_tokens for r in got) == total


def test_place_prefers_what_fits_and_even_splits():
    bins = place(np.array([60, 40, 30, 4]), np.array([60, 40, 30, 4.0]), 64, 8, 64)
    assert bins[0] == [(0, 0, 60), (3, 0, 4)]
    assert [sum(n for _, _, n in b) for b in even([(0, 0, 13)], 64)] == [8, 4, 1]
    assert pytest.approx(134) == sum(n for b in bins for _, _, n in b)


def test_empty_table(spark):
    none = spark.createDataFrame([], "obs_id long, note string")
    assert count_tokens(none, WORD).count() == 0
    assert encode_notes(none, BYTE).count() == 0
    assert pack_notes(none, WORD).count() == 0
