"""Outlines of cell sets: rings of corners, and one MultiPolygon per perimeter.

Cells (ix, iy) have their corners at whole numbers. A ring keeps its cells on the left, so outer rings run
counter-clockwise and holes clockwise. Straight runs of cell sides are one segment. Segments are chained within
tiles of the plane, and only the chains, one row per pass of a ring through a tile, meet in the rounds that
order a ring, whose number grows with the logarithm of the longest ring's passes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators import cells as C
from emberline.session import by_shuffle, cut_lineage, release

# Directions 0 east, 1 north, 2 west, 3 south: where a cell's side begins, its course, and the cell behind it.
_SIDES = [(0, 0, 1, 0, 0, -1), (1, 0, 0, 1, 1, 0), (1, 1, -1, 0, 0, 1), (0, 1, 0, -1, -1, 0)]


def segments(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, dir, x2, y2: maximal straight runs of sides between a cell of the set and one outside it."""
    cell = cells.select(*keys, "ix", "iy").distinct()
    sides = F.array(*[
        F.struct(F.lit(d).alias("dir"), (F.col("ix") + sx).alias("x"), (F.col("iy") + sy).alias("y"), (F.col("ix") + bx).alias("ox"), (F.col("iy") + by).alias("oy"))
        for d, (sx, sy, _, _, bx, by) in enumerate(_SIDES)])
    every = cell.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    inside = cell.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("ix").alias("__x"), F.col("iy").alias("__y"))
    match = (F.col("ox") == F.col("__x")) & (F.col("oy") == F.col("__y"))
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    bare = by_shuffle(every).join(inside, match, "left_anti").drop("ox", "oy")
    # Sides of one direction on one line are consecutive where their places along it are.
    level = F.col("dir") % 2 == 0
    bare = bare.withColumns({"line": F.when(level, F.col("y")).otherwise(F.col("x")), "at": F.when(level, F.col("x")).otherwise(F.col("y"))})
    run = Window.partitionBy(*keys, "dir", "line").orderBy("at")
    runs = bare.withColumn("g", F.col("at") - F.row_number().over(run)).groupBy(*keys, "dir", "line", "g").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    # Against the axis a side begins one further on: its lowest place is where the run ends.
    ahead = F.col("dir") < 2
    begin, end = F.when(ahead, F.col("lo")).otherwise(F.col("hi")), F.when(ahead, F.col("hi") + 1).otherwise(F.col("lo") - 1)
    xy = lambda along, a, b: (F.when(level, along).otherwise(F.col("line")).alias(a), F.when(level, F.col("line")).otherwise(along).alias(b))
    return runs.select(*keys, "dir", *xy(begin, "x", "y"), *xy(end, "x2", "y2"))


def _chains(keys: list[str]):
    def chain(part: pd.DataFrame) -> pd.DataFrame:
        """Chains of one tile: each segment's chain head and place in it, and where the chain goes on (NULL for a closed ring)."""
        follow = dict(zip(part["id"], part["next"]))
        pointed = set(follow.values())
        head, place, exit_ = {}, {}, {}
        for start in [i for i in follow if i not in pointed] + sorted(follow):
            if start in head:
                continue
            at, n = start, 0
            while at in follow and at not in head:
                head[at], place[at] = start, n
                at, n = follow[at], n + 1
            exit_[start] = None if at in follow else at
        part = part.copy()
        part["head"] = part["id"].map(head)
        part["place"] = part["id"].map(place).astype("int64")
        part["exit"] = part["head"].map(exit_).astype(object)
        return part[[*keys, "id", "x", "y", "x2", "y2", "head", "place", "exit"]]

    return chain


def rings(cells: DataFrame, keys: list[str], tile: int = 64) -> DataFrame:
    """keys, ring, seq, x, y: the corners of every ring in order; ``ring`` names it by its smallest chain.

    Where two cells touch in a corner only, rings turn with the cell, so a ring may touch itself but does not cross.
    """
    kinds = {k: cells.schema[k].dataType.simpleString() for k in keys}
    seg = segments(cells, keys)
    name = lambda x, y, d: F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.format_string("%012d,%012d,%d", x + (1 << 31), y + (1 << 31), d))
    seg = cut_lineage(seg.withColumn("id", name(F.col("x"), F.col("y"), F.col("dir"))))
    starts = seg.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("x").alias("__x"), F.col("y").alias("__y"), F.struct(F.col("dir").alias("d"), "id").alias("n"))
    match = (F.col("x2") == F.col("__x")) & (F.col("y2") == F.col("__y"))
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    # Two segments may begin at a corner: the left turn stays with the cell.
    turn = F.struct(F.pmod(F.col("n.d") - F.col("dir"), F.lit(4)).alias("turn"), F.col("n.id").alias("id"))
    linked = by_shuffle(seg).join(starts, match).groupBy(*keys, "id", "x", "y", "x2", "y2").agg(F.min(turn).alias("go"))
    linked = linked.select(*keys, "id", "x", "y", "x2", "y2", F.col("go.id").alias("next"))
    placed = linked.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", id string, " + ", ".join(f"{c} {seg.schema[c].dataType.simpleString()}" for c in ("x", "y", "x2", "y2"))
    chained = placed.groupBy(*keys, "tx", "ty").applyInPandas(_chains(keys), f"{schema}, head string, place bigint, exit string")
    chained = cut_lineage(chained)
    release(seg)

    length = chained.groupBy("head").agg(F.count("*").alias("n"), F.max("exit").alias("next"))
    closed = length.where("next IS NULL").select("head", F.col("head").alias("ring"), F.lit(0).cast("bigint").alias("ahead"))
    order = closed.unionByName(_ordered(cut_lineage(length.where("next IS NOT NULL"))))
    side = order.select(F.col("head").alias("__h"), "ring", "ahead")
    out = by_shuffle(chained).join(side, F.col("head") == F.col("__h"))
    return out.select(*keys, "ring", (F.col("ahead") + F.col("place")).alias("seq"), "x", "y", "x2", "y2")


def _ordered(chains: DataFrame) -> DataFrame:
    """head, ring, ahead: the smallest head of each chain's cycle, and how many segments lie between it and the chain.

    Pointer doubling: each round a chain looks twice as far ahead for the smallest head, then for the way to it.
    """
    if chains.isEmpty():
        return chains.select("head", F.col("head").alias("ring"), F.lit(0).cast("bigint").alias("ahead"))
    look = chains.select("head", F.col("next").alias("jump"), F.least("head", "next").alias("low"))
    look = cut_lineage(look)
    while True:
        far = look.select(F.col("head").alias("__h"), F.col("jump").alias("__j"), F.col("low").alias("__l"))
        wider = cut_lineage(by_shuffle(look).join(far, F.col("jump") == F.col("__h")).select("head", F.col("__j").alias("jump"), F.least("low", "__l").alias("low")))
        moved = by_shuffle(wider).join(look.select(F.col("head").alias("__h"), F.col("low").alias("__l")), F.col("head") == F.col("__h")).where("low <> __l")
        done = moved.isEmpty()
        release(look)
        look = wider
        if done:  # a round that finds nothing smaller has gone all round
            break
    ring = look.select(F.col("head").alias("__r"), F.col("low").alias("ring"))
    # Segments from a chain's head on to the ring's first, which ends the way.
    way = by_shuffle(chains).join(ring, F.col("head") == F.col("__r")).select("head", "ring", F.col("n").alias("left"), F.when(F.col("next") != F.col("ring"), F.col("next")).alias("jump"))
    way = cut_lineage(way)
    while not way.where("jump IS NOT NULL").isEmpty():
        far = way.select(F.col("head").alias("__h"), F.col("jump").alias("__j"), F.col("left").alias("__n"))
        wider = by_shuffle(way).join(far, F.col("jump") == F.col("__h"), "left")
        wider = cut_lineage(wider.select("head", "ring", (F.col("left") + F.coalesce("__n", F.lit(0))).alias("left"), F.col("__j").alias("jump")))
        release(way)
        way = wider
    whole = way.where("head = ring").select(F.col("ring").alias("__r"), F.col("left").alias("whole"))
    return by_shuffle(way).join(whole, F.col("ring") == F.col("__r")).select("head", "ring", (F.col("whole") - F.col("left")).alias("ahead"))


def multipolygons(cells: DataFrame, keys: list[str], place: Callable[[Column, Column], tuple[Column, Column]], tile: int = 64) -> DataFrame:
    """keys, coordinates: one MultiPolygon per key, ``array<polygon<ring<point>>>``, outer ring first, then the holes of its part.

    ``place`` maps corner numbers to the two coordinates. Rings are closed. The outline of one perimeter, its
    corners only, is one value; cells and sides never meet in a row. Rows with a NULL key are of no perimeter.
    """
    seg = cut_lineage(rings(cells, keys, tile))
    area = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    first = F.min_by(F.struct("x", "y", "x2", "y2"), "seq")
    a, b = place(F.col("x"), F.col("y"))
    point = F.array(a.cast("double"), b.cast("double"))
    drawn = seg.groupBy(*keys, "ring").agg(area.alias("area2"), first.alias("s"), F.sort_array(F.collect_list(F.struct("seq", point.alias("p")))).alias("points"))
    corners = F.transform("points", lambda q: q["p"])
    # The cell to the left of a ring's first segment tells whose part the ring bounds.
    right, up = F.col("s.x2") > F.col("s.x"), F.col("s.y2") > F.col("s.y")
    left, down = F.col("s.x2") < F.col("s.x"), F.col("s.y2") < F.col("s.y")
    ring = drawn.select(
        *keys, "area2", F.concat(corners, F.slice(corners, 1, 1)).alias("line"), (F.col("s.x") - F.when(up | left, 1).otherwise(0)).alias("ix"),
        (F.col("s.y") - F.when(left | down, 1).otherwise(0)).alias("iy"))
    parts = C.components(cells, keys)
    owned = by_shuffle(ring).join(parts, [*keys, "ix", "iy"])
    polygon = owned.groupBy(*keys, "comp").agg(F.sort_array(F.collect_list(F.struct((F.col("area2") < 0).alias("hole"), "line"))).alias("rings"))
    polygon = polygon.withColumn("polygon", F.transform("rings", lambda r: r["line"]))
    return polygon.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("comp", "polygon"))).alias("p")).select(*keys, F.transform("p", lambda q: q["polygon"]).alias("coordinates"))
