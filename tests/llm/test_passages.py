"""Repeated passages against a brute-force count of all windows."""

import random
from collections import Counter

import pytest

from emberline.llm.passages import drop_repeated_passages


def brute(rows, window):
    cut = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(c[i:i + window]) for c in cut for i in range(len(c) - window + 1))
    out = []
    for (i, _), c in zip(rows, cut):
        gone = set()
        for k in range(len(c) - window + 1):
            if seen[tuple(c[k:k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, b" ".join(w for k, w in enumerate(c) if k not in gone).decode(), len(c), len(gone)))
    return sorted(out, key=str)


def scene(seed, vocabulary=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(5, 30))] for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [[word() for _ in range(rng.randrange(0, 12))]]
        for _ in range(rng.randrange(0, 4)):
            piece = list(rng.choice(passages))
            if rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = word()
            parts += [piece[rng.randrange(0, 3):], [word() for _ in range(rng.randrange(0, 9))]]
        rows.append((k, " ".join(w for p in parts for w in p)))
    rows += [(200 + k, rows[3][1]) for k in range(4)] + [(5, rows[5][1]), (None, rows[6][1]), (None, "x y"), (300, None), (301, ""), (302, " \n\t ")]
    rows += [(400, "a " * 50), (401, "a b " * 20), (402, "é\tü\x0b" * 15), (403, "é ü " * 15), (404, " ".join(map(str, range(8))))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window", [8, 13])
def test_matches_brute_force(spark, seed, window):
    rows = scene(seed)
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "obs_id long, note string, n_words int, anchor string")
    got = drop_repeated_passages(df, window=window, seed=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, window)


def test_small_vocabulary_and_window_of_one_seed(spark):
    rows = scene(3, vocabulary=3)
    df = spark.createDataFrame(rows, "obs_id long, note string")
    assert sorted((tuple(r) for r in drop_repeated_passages(df, window=6, seed=6).collect()), key=str) == brute(rows, 6)


def test_gaps_and_carried_columns(spark):
    shared = " ".join(f"s{k}" for k in range(10))
    rows = [(1, f"one\n{shared}\n\ntwo  three\n", "x"), (2, f"{shared} end", "y"), (3, "kept\n as is ", None), (4, None, "z")]
    got = drop_repeated_passages(spark.createDataFrame(rows, "obs_id long, note string, note_hash string"), window=10, seed=3, keep_gaps=True, carry=["note_hash"])
    assert sorted(map(tuple, got.collect())) == [(1, "one two  three\n", 13, 10, "x"), (2, "end", 11, 10, "y"), (3, "kept\n as is ", 3, 0, None), (4, "", 0, 0, "z")]


def test_very_long_note_and_empty_table(spark):
    long = " ".join(f"v{k * k % 977}" for k in range(60_000))
    rows = [(1, long), (2, "t " + long[5000:9000])]
    df = spark.createDataFrame(rows, "obs_id long, note string")
    assert sorted((tuple(r) for r in drop_repeated_passages(df).collect()), key=str) == brute(rows, 35)
    assert drop_repeated_passages(df.limit(0)).count() == 0
