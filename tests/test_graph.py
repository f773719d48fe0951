import random

import pytest

from emberline.functions.graph import components
from emberline.session import cut_lineage, release


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(200)],
    [(0, i) for i in range(1, 100)] + [(500, 501), (501, 500), (500, 501)],
    [(random.Random(1).randrange(300) * 7 % 300, j) for j in range(1, 300, 3)],
])
def test_components_match_union_find(spark, links):
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    expect = {k: v for k, v in brute(links).items() if any(a != b and k in (a, b) for a, b in links)}
    assert {r.node: r.component for r in rows} == expect
    assert len(rows) == len(expect)


def test_self_links_nulls_and_no_links(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cut_lineage_keeps_rows_and_release_deletes(spark):
    cut = cut_lineage(spark.range(5))
    assert sorted(r.id for r in cut.collect()) == [0, 1, 2, 3, 4]
    folder = cut.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
    release(cut)
    import os

    assert not os.path.exists(folder)
