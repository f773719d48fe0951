"""Near-duplicate groups by shared shingles, against a brute-force pass over all pairs."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from brute import union_find
from emberline.llm.resemblance import keep_one_of_resembling, link_run
from emberline.llm.simhash import keep_one_of_group
from test_simhash import fingerprint

SF = "/root/testdata/sf0.01"


def grams(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def survivors(rows):
    """Ids that stay, and the pairs of 0.8 or more that the fingerprints alone leave unlinked."""
    text = dict(rows)
    prints, sets = {i: fingerprint(t) for i, t in rows}, {i: grams(t) for i, t in rows}
    near = [(a, b) for a, b in combinations(text, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    far = [(a, b) for a, b in combinations(text, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    root = union_find(text, near + far)
    return {i for i in text if root[i] == i}, set(far) - set(near)


def staged(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())


def edited(rng, words, edits):
    words = list(words)
    for k in range(edits):
        words[(2 * k + 1) * len(words) // (2 * edits)] = f"edit{rng.randrange(1 << 30)}"
    return " ".join(words)


def test_pairs_beyond_the_fingerprint_radius_are_linked(spark):
    rng, rows = random.Random(6), []
    for k in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows += [(4 * k + 1, " ".join(base)), (4 * k + 2, edited(rng, base, 3)), (4 * k + 3, edited(rng, base, 4)), (4 * k + 4, edited(rng, base, 7))]
    rows += [(500, None), (501, " "), (502, "one two"), (503, "One  Two"), (504, "one two three")]
    want, beyond = survivors(rows)
    assert len(beyond) > 20
    assert staged(spark, rows) == sorted(want)


def test_driver_documents(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE n_chars < 3000 ORDER BY doc_id LIMIT 400").fetchall()
    want, beyond = survivors(rows)
    assert beyond
    assert staged(spark, rows) == sorted(want)


@pytest.mark.parametrize("across", [False, True])
def test_link_run_compares_shares_and_sets(across):
    sets = [np.arange(0, 10), np.arange(1, 10), np.arange(50, 60), np.arange(51, 60)]
    links = link_run(np.arange(4), np.array([0, 1, 0, 0]), across, [s.astype(np.uint64) for s in sets], 0.8)
    assert links == ([(0, 1)] if across else [(0, 1), (2, 3)])


@pytest.mark.parametrize("keep", [keep_one_of_group, keep_one_of_resembling])
def test_string_ids_and_clashing_names_survive(spark, keep):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [("b", text, 1, "x"), ("a", text, 2, None), (None, text, 3, "y"), ("a", text, 4, "z"), ("c", "quite another text", 5, "v"), (None, None, 6, None)]
    df = spark.createDataFrame(rows, "obs_id string, note string, __id int, __hash string")
    got = keep(df).collect()
    assert got[0].__fields__ == df.columns
    assert sorted(((r.obs_id, r.note) for r in got), key=str) == sorted([("a", text), ("c", "quite another text"), (None, None)], key=str)
    assert keep(df.limit(0)).count() == 0
