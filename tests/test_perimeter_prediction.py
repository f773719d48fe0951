"""The whole predicted perimeter against set arithmetic on one small scene."""

from collections import deque

from emberline.operators import cells as C
from emberline.operators import field as M

SUB, N = 0.05, 5


def disc(r):
    return C.disc_offsets(r)


def dilate(s, r):
    return {(x + a, y + b) for x, y in s for a, b in disc(r)}


def erode(s, r):
    return {p for p in s if all((p[0] + a, p[1] + b) in s for a, b in disc(r))}


def parts(s):
    left, out = set(s), []
    while left:
        seen, queue = set(), deque([left.pop()])
        while queue:
            p = queue.popleft()
            seen.add(p)
            for a, b in C.FOUR:
                q = (p[0] + a, p[1] + b)
                if q in left:
                    left.discard(q)
                    queue.append(q)
        out.append(seen)
    return out


def test_predicted_perimeter_matches_sets(spark):
    # Base: a square of one kilometre with its lower left corner at the grid's (8, 8).
    edges = [(2.0, 2.0, 3.0, 2.0), (3.0, 2.0, 3.0, 3.0), (3.0, 3.0, 2.0, 3.0), (2.0, 3.0, 2.0, 2.0)]
    base = spark.createDataFrame([(1, 0, 0, 0, k, *e) for k, e in enumerate(edges)], "fire int, step int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    grid = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.25, 2.0, 3.0, 2.0, 3.0, 24, 24), (2, 0, 0.0, 0.0, 0.25, 2.0, 3.0, 2.0, 3.0, 24, 24)],
                                 "fire int, step int, x0 double, y0 double, grid_km double, bx0 double, bx1 double, by0 double, by1 double, nx long, ny long")
    base = base.unionByName(base.selectExpr("2 AS fire", "step", "part", "ring", "seq", "x1", "y1", "x2", "y2"))
    hot = [(12, 9), (12, 10), (13, 10), (20, 20), (20, 21), (2, 20)]
    cold = [(x, y) for x in range(0, 24, 3) for y in range(0, 24, 3) if (x, y) not in hot and not (8 <= x < 12 and 8 <= y < 12)]
    scored = spark.createDataFrame([(1, 0, x, y, 0.99) for x, y in hot] + [(1, 0, x, y, 0.0001) for x, y in cold], "fire int, step int, ix int, iy int, p double")
    dets = [(20.5 * 0.25, 20.5 * 0.25, s) for s in ("VIIRS", "VIIRS", "GOES-18", "GOES-19")] + [(2.5 * 0.25, 20.5 * 0.25, "VIIRS")] * 5
    local = spark.createDataFrame([(1, 0, *d) for d in dets], "fire int, step int, x double, y double, sensor string")
    drops = spark.createDataFrame([(1, 0, 3.2, 2.1, 3.9, 2.4), (1, 0, 5.5, 0.2, 5.8, 0.4)], "fire int, step int, x1 double, y1 double, x2 double, y2 double")

    take = int(sum([0.99] * len(hot) + [0.0001] * len(cold)))
    assert take == 5
    top = sorted(hot, key=lambda c: (c[1], c[0]))[:take]
    fine = {(x * N + a, y * N + b) for x, y in top for a in range(N) for b in range(N)}
    square = {(x, y) for x in range(40, 60) for y in range(40, 60)}
    whole = erode(dilate(fine, 0.2 / SUB), 0.2 / SUB) | square
    spot = [(int(x / SUB), int(y / SUB), s) for x, y, s in dets]
    near = dilate(square, 0.5 / SUB)
    kept = set()
    for part in parts(whole):
        seen = [s for x, y, s in spot if (x, y) in part]
        if part & near or len(seen) >= 4 and len(set(seen)) >= 2:
            kept |= part
    r = 0.35 / SUB
    out = dilate(erode(dilate(kept, r), 1.6 * r), 0.6 * r)

    got = M.predict_perimeter(scored, base, grid, local, n=N)
    cells = {(q.fire, q.ix, q.iy) for q in got.collect()}
    assert {(x, y) for f, x, y in cells if f == 1} == out
    assert {(x, y) for f, x, y in cells if f == 2} == square  # no scored cells: persistence

    def leg(x, y, x1, y1, x2, y2):
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5

    buffer = {(x, y) for x in range(140) for y in range(140) if leg((x + 0.5) * SUB, (y + 0.5) * SUB, 3.2, 2.1, 3.9, 2.4) <= 0.3}
    worked = out | buffer & dilate(out, 0.6 / SUB)
    more = M.predict_perimeter(scored, base, grid, local, n=N, drops=drops)
    assert {(q.ix, q.iy) for q in more.collect() if q.fire == 1} == worked
    assert worked > out
