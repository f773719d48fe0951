"""Fingerprints against a plain Python version, the ring of next notes, and odd rows."""

import hashlib
import random
import re

import pytest

from emberline.llm import fingerprints as module
from emberline.llm.fingerprints import fingerprint_edits, in_ring, next_of, with_sketch


def sketch(text, fraction=0.25):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    if not w:
        return []
    h = {hashlib.md5(" ".join(w[i:i + 5]).encode()).hexdigest()[:12] for i in range(max(1, len(w) - 4))}
    return sorted(x for x in h if x < format(int(fraction * 16**12), "012x")) or [min(h)]


def near(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / min(len(a), len(b)) if a and b else 0.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        e = t[: n - n // 3] + nxt[: n // 3]
        a, b, c = sketch(t), sketch(e), sketch(nxt)
        out.append((i, n, hashlib.sha256(e.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_slot", [3, 7, 10_000])
def test_matches_python(spark, monkeypatch, per_slot):
    rng = random.Random(per_slot)
    rows = [(rng.randrange(10**9) if k % 3 else k, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 60)))) for k in range(80)]
    rows += [(2_000, None), (2_001, ""), (2_002, " \n "), (2_003, "𝔘𝔫𝔦 ço dé \x0b x🔥" * 5), (2_003, "same id"), (2_003, "same id"), (1 << 40, "far away"), (-5, "below zero")]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "obs_id long, note string, n_chars int, slot string")
    ring = in_ring
    monkeypatch.setattr(module, "in_ring", lambda notes: ring(notes, per_slot))
    assert sorted((tuple(r) for r in fingerprint_edits(df).collect()), key=str) == expected(rows)


def test_null_ids_keep_their_rows(spark):
    rows = [(None, f"note {k}") for k in range(9)] + [(1, "one"), (2, "two")]
    got = fingerprint_edits(spark.createDataFrame(rows, "obs_id long, note string")).collect()
    assert len(got) == 11 and sum(r.obs_id is None for r in got) == 9


def test_single_row_is_its_own_next(spark):
    rows = [(4, "a b c d e f g")]
    got = fingerprint_edits(spark.createDataFrame(rows, "obs_id long, note string")).collect()
    assert [tuple(r) for r in got] == expected(rows) and got[0].near_next == 1.0
    assert fingerprint_edits(spark.createDataFrame([], "obs_id long, note string")).count() == 0


def test_sketches_merge_and_see_a_small_note_in_a_large_one(spark):
    rng = random.Random(1)
    words = [f"t{rng.randrange(10**6)}" for _ in range(20_000)]
    whole, part = " ".join(words), " ".join(words[5000:5400])
    halves = " ".join(words[:10_000]), " ".join(words[9_996:])
    df = with_sketch(spark.createDataFrame([(k, t) for k, t in enumerate([whole, part, *halves])], "obs_id long, note string"), "note", "s", 0.1)
    s = {r.obs_id: set(r.s) for r in df.collect()}
    assert s[1] <= s[0] and 20 < len(s[1]) < 65
    assert s[2] | s[3] == s[0]


def test_ring_covers_all(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(100)], "obs_id long, note string")
    got = {r.note: r.next_note for r in next_of(in_ring(df, 9), "note").collect()}
    assert got == {str(i): str((i - 1) % 100) for i in range(100)}
