"""Filter interactions against a plain pass over every order of the filters."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from emberline.llm.audit import CsrRows, audit_filters, term_matrix, term_shards

SHOWN = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails_of(rows):
    low = {}
    for i, t, *_ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        tests = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": any(c in t for c in "#$%&*|"), "E": i is not None and i > low[t],
        }
        out.append({k for k, v in tests.items() if v})
    return out


def brute(rows, ratings):
    good, toxic = ({i for i, *r in ratings if i is not None and r[c] == 1} for c in (0, 1))
    fails, out = fails_of(rows), {}
    shapley = defaultdict(int)
    for order in permutations("ABCDE"):
        for step, letter in enumerate(order, 1):
            for (i, _, part), f in zip(rows, fails):
                key = (part or "", "".join(order), step)
                row = out.setdefault(key, dict.fromkeys(SHOWN, 0))
                there = not f & set(order[: step - 1])
                row["kept"] += there and letter not in f
                row["redundant"] += not there and letter in f
                row["unique_fails"] += f == {letter}
                if there and letter in f:
                    row["removed"] += 1
                    row["good_lost"] += i in good
                    row["toxic_lost"] += i in toxic
                    shapley[part or "", letter] += 1
    for (part, order, step), row in out.items():
        row["shapley"] = shapley[part, order[step - 1]]
    return out


def scene():
    rng = random.Random(4)
    rows = []
    for k in range(120):
        n = rng.choice([3, 49, 50, 51, 80])
        words = [rng.choice("abcdefgh") + str(rng.randrange(rng.choice([5, 400]))) for _ in range(n)]
        if k % 4 == 0:
            words = [w.upper() for w in words]
        if k % 5 == 0:
            words[0] = rng.choice(["a#", "|", "50%", "$"])
        rows.append((k, rng.choice([" ", "\n", "\x0b ", " \t"]).join(words), f"s{k % 3}"))
    rows += [(200 + k, rows[0][1], f"s{k % 2}") for k in range(30)]  # copies in several parts
    rows += [(5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (None, rows[0][1], "s0"), (None, "x é\x85y", None), (300, None, "s1"), (301, "", None), (302, " \n", "s1")]
    rows += [(303, "É" * 20 + "A", "s1"), (304, "É" * 19 + "A", "s1"), (305, "long " * 60_000, "s1")]
    ratings = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 240, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    return rows, ratings


def frames(spark, rows, ratings):
    notes = spark.createDataFrame([(i, t, p, "z", 1) for i, t, p in rows], "obs_id long, note string, source string, part string, n int")
    return notes, spark.createDataFrame(ratings, "obs_id long, reliable int, harmful int")


def test_matches_every_order(spark):
    rows, ratings = scene()
    notes, rated = frames(spark, rows, ratings)
    for most in (1 << 12, 8 << 20):
        got = {(r.part, r.filter_order, r.step): {c: r[c] for c in SHOWN} for r in audit_filters(notes, rated, most=most).collect()}
        assert got == brute(rows, ratings)
    assert any(r["shapley"] and r["good_lost"] for r in got.values())


def test_empty_tables_and_string_ids(spark):
    rows, ratings = scene()
    notes, rated = frames(spark, rows[:3], ratings)
    assert audit_filters(notes.limit(0), rated).count() == 0
    got = audit_filters(notes.withColumn("obs_id", notes.obs_id.cast("string")), rated.limit(0)).collect()
    assert len(got) == 3 * 600 and all(r.good_lost == r.toxic_lost == 0 for r in got)


@pytest.mark.parametrize("bits", [5, 9, 62])
def test_words_have_one_id_in_all_shards(spark, bits):
    rows, _ = scene()
    notes, _ = frames(spark, rows, [(1, 1, 1)])
    shards = term_shards(notes.coalesce(1), "source", 1 << 12, bits)
    matrix = {r.shard: r for r in term_matrix(shards).collect()}
    ids = defaultdict(set)
    for r in shards.collect():
        for at, w in enumerate(r.words):
            ids[w].add(matrix[r.shard].term_ids[at])
    assert len(matrix) > 3 and all(len(x) == 1 for x in ids.values())
    assert len(set.union(*ids.values())) == len(ids)


def test_rows_of_the_matrix():
    rows = CsrRows()
    for note in (b"b a b", b"", b" c\x0ba ", b"x " * 2_000_000):
        rows.add(note)
    words, bounds, columns, counts = rows.arrays()
    assert words == [b"b", b"a", b"c", b"x"] and bounds.tolist() == [0, 2, 2, 4, 5]
    assert columns.tolist() == [0, 1, 1, 2, 3] and counts.tolist() == [2, 1, 1, 1, 2_000_000]
    assert np.add.reduceat(counts, [0, 2, 4]).tolist() == [3, 2, 2_000_000]
