"""The blur in blocks against plain sums over mirrored cells."""

import numpy as np
import pytest

from emberline.operators import belief as B


def plain(cells, h, w, weights):
    out = {}
    fold = lambda j, n: j % (2 * n) if j % (2 * n) < n else 2 * n - 1 - j % (2 * n)
    for y in range(h):
        for x in range(w):
            near = [(fold(x + a, w), fold(y + b, h), u * v) for a, u in weights for b, v in weights]
            hit = [(cells[i, j], f) for i, j, f in near if (i, j) in cells]
            if hit:
                out[x, y] = sum(v * f for v, f in hit)
    return out


@pytest.mark.parametrize("block", [8, 128])
def test_blur_matches_plain_sums(spark, block):
    rng = np.random.default_rng(block)
    sizes = {1: (21, 30), 2: (3, 40), 3: (17, 17)}  # fire 2 is lower than the kernel is long
    cells = {f: {(int(rng.integers(w)), int(rng.integers(h))): float(rng.normal()) for _ in range(12)} for f, (h, w) in sizes.items()}
    cells[3][0, 0] = 0.0
    field = spark.createDataFrame([(f, x, y, v) for f, c in cells.items() for (x, y), v in c.items()], "fire long, ix long, iy long, v double")
    grid = spark.createDataFrame([(f, h, w) for f, (h, w) in sizes.items()], "fire long, h long, w long")
    got = {}
    for r in B.gaussian_blur(field, grid, 130.0, block=block).collect():
        got.setdefault(r.fire, {})[r.ix, r.iy] = r.v
    for f, (h, w) in sizes.items():
        want = plain(cells[f], h, w, B.kernel(1.3))
        assert got[f].keys() == want.keys()
        assert all(abs(got[f][k] - v) < 1e-12 for k, v in want.items())
    assert B.gaussian_blur(field.limit(0), grid, 130.0).count() == 0


def test_mass_is_kept_when_the_kernel_is_longer_than_the_grid(spark):
    field = spark.createDataFrame([(1, 1, 0, 2.0)], "fire long, ix long, iy long, v double")
    grid = spark.createDataFrame([(1, 2, 3)], "fire long, h long, w long")
    rows = B.gaussian_blur(field, grid, 900.0).collect()
    assert len(rows) == 6 and abs(sum(r.v for r in rows) - 2.0) < 1e-9
