"""Near-duplicate cells against brute force over all pairs."""

import numpy as np
import pytest

from brute import union_find
from emberline.llm.vectors import choose_pivots, near_duplicate_cells

DDL = "cell_id long, fire int, features array<double>, n_links string, unit int"


def brute(rows, least=0.93):
    good = [k for k, (_, f, v) in enumerate(rows) if f is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][2]) / np.linalg.norm(np.array(rows[k][2]) / np.abs(rows[k][2]).max()) / np.abs(rows[k][2]).max() for k in good}
    links = [(a, b) for x, a in enumerate(good) for b in good[:x] if rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    root = union_find(range(len(rows)), links)
    low, count = {}, [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for k, r in root.items():
        ids = [x for x in (low.get(r), rows[k][0]) if x is not None]
        low[r] = min(ids, default=None)
    return sorted(((rows[k][0], count[k], low[root[k]], rows[k][0] == low[root[k]]) for k in range(len(rows))), key=str)


def scene(seed, n=400, d=24):
    rng = np.random.default_rng(seed)
    rows, centre = [], rng.normal(size=d)
    for k in range(n):
        kind = k % 5
        if kind == 0 and rows:
            v = np.array(rows[rng.integers(len(rows))][2]) * rng.choice([1.0, 3.0]) + rng.normal(size=d) * 0.05
        elif kind == 1:
            v = centre + rng.normal(size=d) * 0.25
        else:
            v = rng.normal(size=d)
        rows.append((int(k * 7 % 997), int(k % 3), v.tolist()))
    rows += [rows[5], (5000, rows[5][1], rows[5][2]), (5001, rows[5][1], rows[5][2])]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL)
    return sorted((tuple(r) for r in near_duplicate_cells(df, **kw).collect()), key=str)


@pytest.mark.parametrize("share", [16, 1024])
def test_recall_and_precision(spark, share):
    rows = scene(share)
    got, want = run(spark, rows, share=share, pivots=32), brute(rows)
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) > 1000
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(want)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, 1, v), (1, 1, v), (2, 1, [2.0, 4.0, 6.0]), (3, 2, v), (4, None, v), (5, 1, None), (6, 1, []), (7, 1, [0.0, 0.0, 0.0]), (8, 1, [1.0, None, 3.0]),
            (9, 1, [1.0, float("nan"), 3.0]), (10, 1, [1.0, float("inf"), 3.0]), (None, 1, [1.0, 2.0, 3.1]), (None, 3, v), (11, 1, [1.0, 2.0]), (12, 1, [1.0, 2.0]),
            (13, 1, [1e200, 2e200, 3e200]), (14, 1, [1e-200, 2e-200, 3e-200]), (15, 1, [-1.0, -2.0, -3.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, sample=1) == brute(rows)
    assert run(spark, []) == []


def test_pivots_are_spread():
    x = np.eye(4)[[0, 0, 1, 2, 2, 3]]
    assert len(choose_pivots(x, 10)) == 4
