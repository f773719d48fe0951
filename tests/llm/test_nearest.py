"""Nearest vectors against brute force: exact distances, and recall."""

import numpy as np
import pytest

from emberline.llm.nearest import nearest_cells, perturbations

DDL = "cell_id long, features array<double>, distance string, rank int"


def brute(rows, asked, k=10):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in asked:
        own = [v for i, v in good if i == q]
        if not own:
            continue
        near = {}
        for i, v in good:
            if i != q and len(v) == len(own[0]):
                d = float(np.sqrt(((v - own[0]) ** 2).sum()))
                near[i] = min(d, near.get(i, d))
        out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def run(spark, rows, asks, **kw):
    cells = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], DDL)
    out = {}
    for r in nearest_cells(cells, cells.where(asks), **kw).collect():
        out.setdefault(r.cell_id, []).append((r["rank"], r.distance, r.neighbour))
    for q, v in out.items():
        assert [x[0] for x in sorted(v)] == list(range(1, len(v) + 1))
        out[q] = [x[1:] for x in sorted(v)]
    return out


def scene(kind, n=3000, d=24):
    rng = np.random.default_rng(7)
    if kind == "clustered":
        centres = rng.normal(size=(30, d)) * 3
        return [(k, (centres[rng.integers(30)] + rng.normal(size=d) * rng.choice([0.05, 0.5])).tolist()) for k in range(n)]
    if kind == "one place":  # a third of all rows is one vector, and a third lies around it
        spot = rng.normal(size=d)
        return [(k, (spot + (rng.normal(size=d) * (0, 0.01, 1)[k % 3])).tolist()) for k in range(n)]
    return [(k, rng.normal(size=d).tolist()) for k in range(n)]


@pytest.mark.parametrize("kind", ["clustered", "one place", "random"])
def test_recall_and_distances(spark, kind):
    rows = scene(kind)
    got, want = run(spark, rows, "cell_id % 50 = 0", share=256), brute(rows, range(0, 3000, 50))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    place = {i: np.array(v) for i, v in rows}
    assert all(abs(d - np.sqrt(((place[q] - place[i]) ** 2).sum())) < 1e-12 * max(d, 1) for q, v in got.items() for d, i in v)
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    if kind == "one place":
        assert all(got[q] == want[q] for q in want if q % 3 == 0)  # ties go to the smaller id


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (0, v), (100, [2.0, 4.0, 6.0]), (3, v), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]), (8, [1.0, float("nan"), 3.0]),
            (9, [1.0, float("inf"), 3.0]), (None, v), (11, [1.0, 2.0]), (200, [3.0, 4.0]), (300, [5.0]), (400, None), (12, [1e200, 1.0, 1.0])]
    got = run(spark, rows, "cell_id % 100 = 0")
    want = brute(rows, [0, 100, 200, 300])
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items() if x}
    cells = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], DDL)
    assert nearest_cells(cells.limit(0), cells.limit(0)).count() == 0
    assert nearest_cells(cells, cells.limit(0)).count() == 0


def test_perturbations_come_in_order():
    sets = perturbations(4, 60)
    assert not sets[0].any() and len({tuple(s) for s in sets}) == len(sets) == 60
    assert not (sets & sets[:, ::-1]).any()  # never both walls of one function
    assert len(perturbations(2, 1000)) == 9
