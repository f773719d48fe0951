"""SimHash groups against a brute-force pass over all pairs."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from emberline.llm.queries import QUERIES
from emberline.llm.simhash import close_fingerprints, covering_masks, group_notes, link_sorted
from brute import union_find

SF = "/root/testdata/sf0.01"


def fingerprint(text, k=4):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            value |= 1 << bit
    return value


def expected(rows):
    prints = {}
    for i, t in rows:
        prints.setdefault(fingerprint(t), []).append(i)
    links = [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4]
    root = union_find(prints, links)
    low = {}
    for f, ids in prints.items():
        known = [i for i in ids if i is not None] + ([low[root[f]]] if low.get(root[f]) is not None else [])
        low[root[f]] = min(known, default=None)
    return sorted(((i, format(f, "016x"), low[root[f]]) for f, ids in prints.items() for i in ids), key=str)


def test_query_matches_brute_force(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE n_chars < 3000").fetchall()
    got = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert len(got) == 1000
    for i, t in rows[:150]:
        assert got[i].fingerprint == format(fingerprint(t), "016x")
    prints = {r.fingerprint: [] for r in got.values()}
    for r in got.values():
        prints[r.fingerprint].append(r.doc_id)
    links = [(a, b) for a, b in combinations(prints, 2) if (int(a, 16) ^ int(b, 16)).bit_count() <= 4]
    root = union_find(prints, links)
    low = {}
    for f, ids in prints.items():
        low[root[f]] = min([*ids, low.get(root[f], 1 << 60)])
    assert all(r.component_id == low[root[r.fingerprint]] for r in got.values())


def test_odd_rows(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(40)}" for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "alone here"), (4, "One two"), (5, "one\ttwo"), (5, "one\ttwo"), (6, "One Two"), (7, "ÉTÉ two"), (8, "été two")]
    for k in range(30):
        words = list(base)
        words[rng.randrange(300)] = f"edit{k}"
        rows.append((20 + k, " ".join(words)))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "obs_id long, note string, fingerprint int, component_id string")
    got = sorted(((r.obs_id, r.fingerprint, r.component_id) for r in group_notes(df).collect()), key=str)
    assert got == expected(rows)
    assert group_notes(df.limit(0)).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(3)
    for radius in (1, 4, 6):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            flip = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not flip & m % (1 << 64) for m in masks)


@pytest.mark.parametrize("share", [3, 1000])
def test_shares_of_a_hot_bucket_lose_no_link(spark, share):
    rng = random.Random(4)
    chain, f = [], rng.getrandbits(63)
    for _ in range(120):
        f ^= sum(1 << b for b in rng.sample(range(10), 3))
        chain.append(f)
    values = sorted({*chain, *(rng.getrandbits(63) for _ in range(50))})
    links = close_fingerprints(spark.createDataFrame([(v,) for v in values], "fingerprint long"), 4, share=share).collect()
    assert all((r.a ^ r.b).bit_count() <= 63 for r in links)
    got = union_find(values, [(r.a, r.b) for r in links])
    want = union_find(values, [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 4])
    assert got == want


def test_link_sorted_keeps_runs_apart():
    i, j = link_sorted(np.array([1, 1, 2, 2]), np.zeros(4, int), np.zeros(4, bool), np.array([0, 255, 0, 1], np.uint64), 4)
    assert list(zip(i, j)) == [(3, 2)]
