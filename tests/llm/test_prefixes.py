"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from emberline.llm import prefixes
from emberline.llm.prefixes import NodeTable, prefix_trie

DDL = "conv_id long, turn int, role string, text string, depth string, n int"


def brute(rows, group=20, shared=3):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % (shared + 1)
        made[c] = own.get(c - int(np.fmod(c, group)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in sorted(made.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(who) - 1) * words
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in who if len(made[c]) == len(p))
        out.append((who[0], len(p), members[p[:-1]][0] if p else None, len(who), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def scene(seed, convs=150, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), convs):
        same = rng.random() < 0.4
        for t in range(rng.choice([1, 2, longest])):
            text = f"turn {t}" if same or rng.random() < 0.3 else f"{rng.randrange(9)} said\x0b{'x ' * rng.randrange(4)}é"
            rows.append((c, rng.choice([t, t, None]) if t == 0 else t, rng.choice(["user", "user", None]), text if rng.random() < 0.95 else None))
    return rows + [(None, 0, "user", "a b"), (None, None, None, None), rows[0], rows[0]]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(5)
    return sorted((tuple(r) for r in prefix_trie(df, **kw).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = scene(seed)
    got = run(spark, rows, shard_rows=50)
    assert got == brute(rows)
    assert max(r[3] for r in got if r[1] == 2) > 5


def test_long_conversations_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SEGMENT", 4)
    rng = random.Random(3)
    rows = scene(4, 40, 11)
    for c in (500, 501, 502, 520, 521):  # half of all rows; two and two are alike for long
        rows += [(c, t, "user", f"line {t} {c % 2 if t > 90 else ''}") for t in range(rng.choice([97, 100]))]
    rows += [(540 + k, t, "a", "same words") for k in range(30) for t in range(9)]  # one very common conversation
    assert run(spark, rows, shard_rows=64) == brute(rows)


def test_other_groups_and_empty_table(spark):
    rows = scene(5, 60)
    assert run(spark, rows, group=7, shared=5) == brute(rows, 7, 5)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []
    assert run(spark, [(4, None, None, None)]) == brute([(4, None, None, None)])


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, (5000, 3)), axis=0)
    table = NodeTable(keys[:4000])
    assert sorted(table.slots(keys[:4000]).tolist()) == list(range(4000))
    assert (table.slots(keys[4000:]) == -1).all()
    assert (table.keys[table.slots(keys[:4000])] == keys[:4000]).all()
    assert len(NodeTable(keys[:0]).slots(keys[:3])) == 3
