"""Distance and containment joins expressed as tile equi-joins.

Spark has no spatial index, so a bare distance predicate would become a nested
loop. Every join here keys both sides by a tile, keeps the exact predicate as a
residual filter, and splits tiles that hold too many rows on either side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import frames
from emberline.session import by_shuffle

# Rows of one tile that one task should meet; denser tiles are split.
#: Points per tile in unbounded nearest searches.
TILE_POINTS = 128
#: Boxes of one key that one task should meet on either side in them.
KEY_BOXES = 2_000
TILE_ROWS = 200_000


def _with_splits(df: DataFrame, tile: list[str], left_hot: DataFrame, right_hot: DataFrame) -> DataFrame:
    return (
        df.join(left_hot, tile, "left")
        .join(right_hot, tile, "left")
        .withColumn("__ls", F.coalesce("__ls", F.lit(1)))
        .withColumn("__rs", F.coalesce("__rs", F.lit(1)))
    )


def _hot(df: DataFrame, tile: list[str], name: str, limit: int) -> DataFrame:
    return (
        df.groupBy(*tile)
        .count()
        .where(F.col("count") > limit)
        .select(*tile, F.ceil(F.col("count") / limit).cast("int").alias(name))
    )


def tile_pairs(left: DataFrame, right: DataFrame, tile: list[str], tile_rows: int = TILE_ROWS, balance: bool = True, many: bool = False) -> DataFrame:
    """Inner join on ``tile`` where every dense tile is cut into a grid of shares.

    A left row goes to one left share and meets all right shares, and the other
    way round, so each pair is formed exactly once. Column names of the two sides
    must differ outside ``tile``. Finding dense tiles reads both inputs once more;
    with ``balance=False`` (expensive inputs) adaptive skew-join splitting does it alone.
    Such inputs are mostly laid out by ``explode``, which size estimates do not see: the
    mark keeps a lattice of millions of rows from being collected for a broadcast; ``many``
    asks for it in a balanced join.
    """
    if not balance:
        return by_shuffle(left).join(right, tile)
    lefts, rights = tile_shares(left, right, tile, tile_rows, tile_rows)
    lefts = by_shuffle(lefts) if many else lefts
    return lefts.join(rights, [*tile, "__i", "__j"]).drop("__i", "__j")


def tile_shares(left: DataFrame, right: DataFrame, tile: list[str], left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with shares (__i, __j) of their tile: rows of one tile meet in exactly one share."""
    hot_l = _hot(left, tile, "__ls", left_rows)
    hot_r = _hot(right, tile, "__rs", right_rows)

    # A share is a function of the row's content, so a recomputed task places it alike.
    def share(df: DataFrame, width: str) -> Column:
        cols = [F.col(n) for n, kind in df.dtypes if not kind.startswith("map")]
        return F.pmod(F.xxhash64(*cols), F.col(width).cast("bigint")).cast("int")

    def spread(width: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(width) - 1))

    lefts = _with_splits(left, tile, hot_l, hot_r).withColumn("__i", share(left, "__ls")).withColumn("__j", spread("__rs"))
    rights = _with_splits(right, tile, hot_l, hot_r).withColumn("__j", share(right, "__rs")).withColumn("__i", spread("__ls"))
    return lefts.drop("__ls", "__rs"), rights.drop("__ls", "__rs")


def inverse_distance_sums(cells: DataFrame, stations: DataFrame, keys: list[str], values: list[str], reach: float, least: float, power: float,
                          geo_km: float | None = None, block: int = 16_384) -> DataFrame:
    """Per cell the sum ``__w`` of distance ** -power over the stations nearer than ``reach``, and of weight times value.

    ``cells``: (keys, lon, lat); ``stations``: (rx, ry, sx, sy, values), where (sx, sy) scale degrees to the unit of
    ``reach``; nearer than ``least`` counts as ``least``. Each cell meets every station in reach, so the work is
    their product: a share of some ``block`` cells meets one of as many stations as matrix products, and no row
    per pair is made. With ``geo_km`` tiles widen toward the poles. Cells out of reach have no row.
    """
    if geo_km is None:
        lefts = cells.withColumn("__tx", F.floor(F.col("lon") / reach)).withColumn("__ty", F.floor(F.col("lat") / reach))
        rights = stations.withColumn("__tx", _around(F.floor(F.col("rx") / reach))).withColumn("__ty", _around(F.floor(F.col("ry") / reach)))
        tile = ["__tx", "__ty"]
    else:
        lefts, rights, tile = _geo_tiles(cells, stations, geo_km, ("lat", "lon"), ("ry", "rx"))
    known = " AND ".join(f"{c} IS NOT NULL" for c in tile)
    lefts, rights = tile_shares(lefts.where(known).select(*keys, "lon", "lat", *tile), rights.where(known).select("rx", "ry", "sx", "sy", *values, *tile), tile, block, block)

    def sums(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({c: [] for c in (*keys, "__w", *values)})
        x, y = mine["lon"].to_numpy(float)[:, None], mine["lat"].to_numpy(float)[:, None]
        rx, ry, sx, sy = (theirs[c].to_numpy(float) for c in ("rx", "ry", "sx", "sy"))
        v = theirs[values].to_numpy(float)
        has = ~np.isnan(v)
        side = np.hstack([np.ones((len(v), 1)), np.where(has, v, 0.0), has])
        out = np.empty((len(mine), side.shape[1]))
        step = max(1, (1 << 20) // len(theirs))
        for a in range(0, len(mine), step):
            dx, dy = (x[a : a + step] - rx) * sx, (y[a : a + step] - ry) * sy
            d2 = dx * dx + dy * dy
            near = d2 < reach * reach
            edge = np.nonzero(np.abs(d2 - reach * reach) < 1e-9 * reach * reach)
            near[edge] = np.hypot(dx[edge], dy[edge]) < reach
            far = np.maximum(d2, least * least)
            w = 1.0 / far if power == 2.0 else far ** (-power / 2)
            out[a : a + step] = np.where(near, w, 0.0) @ side
        n = len(values)
        got = mine[keys].assign(__w=out[:, 0])
        for i, c in enumerate(values):
            got[c] = np.where(out[:, 1 + n + i] > 0, out[:, 1 + i], np.nan)  # no value in reach: null
        return got[out[:, 0] > 0]

    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "__w double", *(f"{c} double" for c in values)])
    by = [*tile, "__i", "__j"]
    parts = lefts.groupBy(*by).cogroup(rights.groupBy(*by)).applyInPandas(sums, schema)
    return parts.groupBy(*keys).agg(F.sum("__w").alias("__w"), *[F.sum(c).alias(c) for c in values])


def _around(tile_col: Column, reach: int = 1) -> Column:
    return F.explode(F.sequence(tile_col - reach, tile_col + reach))


def radius_join(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    keys: list[str] = (),
    left_xy: tuple[str, str] = ("x", "y"),
    right_xy: tuple[str, str] = ("rx", "ry"),
    distance: Column | None = None,
    inclusive: bool = True,
    tile_rows: int = TILE_ROWS,
    balance: bool = True,
    many: bool = False,
) -> DataFrame:
    """All (left, right) pairs within ``radius`` in a planar frame, with distance ``d``."""
    lx, ly = F.col(left_xy[0]), F.col(left_xy[1])
    rx, ry = F.col(right_xy[0]), F.col(right_xy[1])
    lefts = left.withColumn("__tx", F.floor(lx / radius)).withColumn("__ty", F.floor(ly / radius))
    rights = right.withColumn("__tx", _around(F.floor(rx / radius))).withColumn("__ty", _around(F.floor(ry / radius)))
    d = F.sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly)) if distance is None else distance
    pairs = tile_pairs(lefts, rights, [*keys, "__tx", "__ty"], tile_rows, balance, many).withColumn("d", d).drop("__tx", "__ty")
    return pairs.where(F.col("d") <= radius if inclusive else F.col("d") < radius)


def _band_width(band: Column, height: float, radius_km: float) -> Column:
    top = F.greatest(F.abs(band), F.abs(band + 1)) * F.lit(height) + F.lit(height)
    return F.lit(radius_km / 110.5) / F.greatest(F.cos(F.radians(F.least(top, F.lit(89.0)))), F.lit(0.01))


def _geo_tiles(left: DataFrame, right: DataFrame, radius_km: float, left_ll: tuple[str, str], right_ll: tuple[str, str]) -> tuple[DataFrame, DataFrame, list[str]]:
    h = radius_km / 110.5
    lefts = left.withColumn("__b", F.floor(F.col(left_ll[0]) / h))
    lefts = lefts.withColumn("__t", F.floor(F.col(left_ll[1]) / _band_width(F.col("__b"), h, radius_km)))
    rights = right.withColumn("__b", _around(F.floor(F.col(right_ll[0]) / h)))
    rights = rights.withColumn("__t", _around(F.floor(F.col(right_ll[1]) / _band_width(F.col("__b"), h, radius_km))))
    return lefts, rights, ["__b", "__t"]


def geo_radius_join(
    left: DataFrame,
    right: DataFrame,
    radius_km: float,
    distance: Column,
    keys: list[str] = (),
    left_ll: tuple[str, str] = ("lat", "lon"),
    right_ll: tuple[str, str] = ("rlat", "rlon"),
    inclusive: bool = True,
    tile_rows: int = TILE_ROWS,
    balance: bool = True,
) -> DataFrame:
    """Pairs within ``radius_km`` on lat/lon rows; ``distance`` is the exact km expression.

    Latitude bands one radius high carry their own longitude tile width, so tiles
    keep covering the radius toward the poles.
    """
    lefts, rights, tile = _geo_tiles(left, right, radius_km, left_ll, right_ll)
    pairs = tile_pairs(lefts, rights, [*keys, *tile], tile_rows, balance).withColumn("d", distance).drop("__b", "__t")
    return pairs.where(F.col("d") <= radius_km if inclusive else F.col("d") < radius_km)


def geo_nearest(points: DataFrame, members: DataFrame, radius_km: float, distance: Column, point_id: list[str], member_id: str, payload: list[str],
                block: int = 16_384, flat: bool = False) -> DataFrame:
    """Closest member (rlat, rlon) within ``radius_km`` of each point (lat, lon); ties go to the smallest member id.

    Every point of a tile share meets every member of it as a matrix product of unit vectors, and only the members
    at the least chord, up to rounding, become rows: ``distance`` decides among them, so no row per pair is made or
    sorted. With ``flat`` they are those nearest in the flat frame of the point. Of members at one place only the
    smallest can win.
    """
    place = ["rlat", "rlon"]
    cols = [c for c in payload if c != member_id]
    rights = members.groupBy(*place).agg(F.min(F.struct(member_id, *cols)).alias("__m")).select(*place, "__m.*")
    lefts, rights, tile = _geo_tiles(points.select(*point_id, "lat", "lon"), rights, radius_km, ("lat", "lon"), ("rlat", "rlon"))
    known = " AND ".join(f"{c} IS NOT NULL" for c in tile)
    lefts, rights = tile_shares(lefts.where(known), rights.where(known), tile, block, block)
    left_cols, right_cols = [*point_id, "lat", "lon"], [member_id, *cols, *place]

    def units(rows: pa.Table, lat: str, lon: str) -> np.ndarray:
        a, b = (np.radians(rows[c].to_numpy()) for c in (lat, lon))
        return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])

    def degrees(rows: pa.Table, lat: str, lon: str) -> np.ndarray:
        return np.column_stack([rows[lat].to_numpy(), rows[lon].to_numpy()])

    place_of = degrees if flat else units

    def candidates(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        u, v = place_of(mine, "lat", "lon"), place_of(theirs, "rlat", "rlon")
        real = np.nonzero(np.isfinite(v).all(1))[0]
        v = v[real]
        at, whom = [], []
        step = max(1, (1 << 20) // max(1, len(v)))
        for a in range(0, len(u) if len(v) else 0, step):
            if flat:
                part = u[a : a + step]
                dx, dy = (v[:, 1] - part[:, 1:]) * np.cos(np.radians(part[:, :1])), v[:, 0] - part[:, :1]
                far = dx * dx + dy * dy
                i, j = np.nonzero(far <= far.min(1, keepdims=True) * (1 + 1e-9) + 1e-24)
            else:
                near = u[a : a + step] @ v.T
                # 1 - cosine is half the squared chord; rounding moves it by less than 1e-15.
                i, j = np.nonzero(near >= near.max(1, keepdims=True) - 1e-14)
            at.append(i + a)
            whom.append(real[j])
        at, whom = (np.concatenate(q) if q else np.empty(0, dtype=np.int64) for q in (at, whom))
        left, right = mine.select(left_cols).take(pa.array(at)), theirs.select(right_cols).take(pa.array(whom))
        return pa.Table.from_arrays([*left.columns, *right.columns], names=[*left_cols, *right_cols])

    kinds = dict(lefts.dtypes) | dict(rights.dtypes)
    by = [*tile, "__i", "__j"]
    pairs = lefts.groupBy(*by).cogroup(rights.groupBy(*by)).applyInArrow(candidates, ", ".join(f"{c} {kinds[c]}" for c in (*left_cols, *right_cols)))
    pairs = pairs.withColumn("d", distance).where(F.col("d") <= radius_km)
    return nearest_within(pairs, point_id, member_id, payload)


def nearest_within(pairs: DataFrame, left_id: list[str], right_id: str, payload: list[str]) -> DataFrame:
    """Closest right row per left id from radius-join pairs; ties go to the smallest right id.

    ``min`` over a struct combines map-side, so pairs never cross the network.
    """
    best = F.min(F.struct(F.col("d"), F.col(right_id), *[F.col(p) for p in payload if p != right_id])).alias("__b")
    return pairs.groupBy(*left_id).agg(best).select(*left_id, "__b.*")


def nearest_pruned(
    points: DataFrame,
    members: DataFrame,
    keys: list[str],
    point_id: list[str],
    member_id: str,
    block: Column,
    extent: tuple[str, str, str, str],
    distance: Column,
    payload: list[str],
    xy: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """Exact unbounded nearest member per point, by pruning boxes of points against boxes of members.

    Members are grouped into small blocks and each key's points into square tiles of some ``TILE_POINTS``.
    The largest distance between a tile and any block bounds the nearest distance of all its points, so
    only blocks whose nearest edge is inside the best such bound can hold an answer. Boxes are compared
    with boxes; a point meets only the blocks left for its tile that are within the bound from itself.

    Spans, tiles and boxes grow with the input, so none of them is collected on the driver for a broadcast;
    a key with many boxes is cut into shares instead.
    """
    x1, y1, x2, y2 = (F.col(c) for c in extent)
    px, py = F.col(xy[0]), F.col(xy[1])
    tagged = members.withColumn("__blk", block)
    boxes = tagged.groupBy(*keys, "__blk").agg(
        F.min(F.least(x1, x2)).alias("__bx0"),
        F.min(F.least(y1, y2)).alias("__by0"),
        F.max(F.greatest(x1, x2)).alias("__bx1"),
        F.max(F.greatest(y1, y2)).alias("__by1"),
    )
    ids = list(dict.fromkeys([*keys, *point_id]))
    slim = points.select(*ids, *xy)
    span = slim.groupBy(*keys).agg(
        F.min(px).alias("__x0"), F.min(py).alias("__y0"), F.ceil(F.sqrt(F.count("*") / F.lit(TILE_POINTS))).alias("__side"),
        (F.greatest(F.max(px) - F.min(px), F.max(py) - F.min(py)) + F.lit(1e-9)).alias("__w"),
    )
    part = lambda v, o: F.least(F.floor((v - F.col(o)) / F.col("__w") * F.col("__side")), F.col("__side") - 1)
    slim = by_shuffle(slim).join(span, keys).withColumn("__pt", part(px, "__x0") * F.col("__side") + part(py, "__y0")).select(*ids, *xy, "__pt")
    tiles = slim.groupBy(*keys, "__pt").agg(F.min(px).alias("__px0"), F.max(px).alias("__px1"), F.min(py).alias("__py0"), F.max(py).alias("__py1"))
    gap = lambda lo, hi, c: F.greatest(F.col(f"__b{c}0") - hi, lo - F.col(f"__b{c}1"), F.lit(0.0))
    width = lambda c: F.greatest(F.abs(F.col(f"__p{c}1") - F.col(f"__b{c}0")), F.abs(F.col(f"__b{c}1") - F.col(f"__p{c}0")))
    far = F.hypot(width("x"), width("y"))
    near = F.hypot(gap(F.col("__px0"), F.col("__px1"), "x"), gap(F.col("__py0"), F.col("__py1"), "y"))
    bound = tile_pairs(tiles, boxes, keys, KEY_BOXES, many=True).groupBy(*keys, "__pt").agg((F.min(far) * (1 + 1e-9)).alias("__ub"))
    live = tile_pairs(by_shuffle(tiles).join(bound, [*keys, "__pt"]), boxes, keys, KEY_BOXES, many=True).where(near <= F.col("__ub"))
    live = live.select(*keys, "__pt", "__blk", "__ub", "__bx0", "__by0", "__bx1", "__by1")
    own = F.hypot(gap(px, px, "x"), gap(py, py, "y"))
    some = by_shuffle(slim).join(live, [*keys, "__pt"]).where(own <= F.col("__ub")).select(*ids, *xy, "__blk")
    pairs = by_shuffle(some).join(tagged, [*keys, "__blk"]).withColumn("d", distance)
    return nearest_within(pairs, ids, member_id, payload)


def crossings(points: DataFrame, edges: DataFrame, keys: list[str], slot: float,
              xy: tuple[str, str] = ("x", "y"), balance: bool = True) -> DataFrame:
    """Points joined to the ring edges an eastward ray from them crosses.

    Edges are listed under every horizontal slot they span, so a point meets only
    the edges beside it rather than the whole ring.
    """
    px, py = F.col(xy[0]), F.col(xy[1])
    pts = points.withColumn("__s", F.floor(py / slot))
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    cut = edges.where(F.col("y1") != F.col("y2")).withColumn(
        "__s", F.explode(F.sequence(F.floor(lo / slot), F.floor(hi / slot)))
    )
    cut = cut.select(*keys, "__s", "x1", "y1", "x2", "y2")
    straddles = (F.col("y1") > py) != (F.col("y2") > py)
    right_of = px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return tile_pairs(pts, cut, [*keys, "__s"], balance=balance).where(straddles & right_of)


def points_inside(points: DataFrame, edges: DataFrame, keys: list[str], point_id: list[str], slot: float,
                  xy: tuple[str, str] = ("x", "y"), balance: bool = True) -> DataFrame:
    """Ids of points inside the even-odd interior of their key's edges (holes honoured)."""
    ids = list(dict.fromkeys([*keys, *point_id]))
    hits = crossings(points.select(*ids, *xy), edges, keys, slot, xy, balance)
    return hits.groupBy(*ids).agg(F.count("*").alias("__n")).where(F.col("__n") % 2 == 1).select(*ids)


def boundary_distance(points: DataFrame, edges: DataFrame, keys: list[str], point_id: list[str],
                      block: Column, xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Distance from each point to the nearest ring edge of its key."""
    px, py = F.col(xy[0]), F.col(xy[1])
    d = frames.segment_distance(px, py, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    out = nearest_pruned(
        points, edges.select(*keys, "seq", "x1", "y1", "x2", "y2"), keys, point_id, "seq", block,
        ("x1", "y1", "x2", "y2"), d, [], xy,
    )
    return out.withColumnRenamed("d", "d_edge").drop("seq")


def semi_within(left: DataFrame, right: DataFrame, radius: float, left_id: list[str], make: Callable = radius_join, **kw) -> DataFrame:
    """Left rows with at least one right row within ``radius``."""
    hits = make(left, right, radius, **kw).select(*left_id).distinct()
    return left.join(hits, left_id, "left_semi")


def points_in_boxes(points: DataFrame, boxes: DataFrame, xy: tuple[str, str] = ("lon", "lat"), tile: float = 0.25,
                    keys: list[str] = (), balance: bool = True) -> DataFrame:
    """Points joined to the closed boxes (west, south, east, north) holding them."""
    def span(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile)))

    px, py = F.col(xy[0]), F.col(xy[1])
    listed = boxes.withColumn("__bi", span("west", "east")).withColumn("__bj", span("south", "north"))
    placed = points.withColumn("__bi", F.floor(px / tile)).withColumn("__bj", F.floor(py / tile))
    inside = px.between(F.col("west"), F.col("east")) & py.between(F.col("south"), F.col("north"))
    return tile_pairs(placed, listed, [*keys, "__bi", "__bj"], balance=balance).where(inside).drop("__bi", "__bj")
