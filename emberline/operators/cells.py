"""Cell-set geometry: a shape is a set of (key, ix, iy) rows.

Union, intersection and difference are row set algebra; buffering works from the
rim of a shape outward, so the cost follows the outline rather than the area.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.frames import M2_PER_ACRE
from emberline.functions.graph import components as linked
from emberline.session import by_shuffle, cut_lineage

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = FOUR + [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def disc_offsets(radius_cells: float) -> list[tuple[int, int]]:
    n = int(math.floor(radius_cells + 1e-9))
    r2 = radius_cells * radius_cells + 1e-9
    return [(dx, dy) for dx in range(-n, n + 1) for dy in range(-n, n + 1) if dx * dx + dy * dy <= r2]


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*keys, "ix", "iy"]
    return a.select(*cols).unionByName(b.select(*cols)).distinct()


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return by_shuffle(a).join(b, [*keys, "ix", "iy"], "left_semi")


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return by_shuffle(a).join(b, [*keys, "ix", "iy"], "left_anti")


def acres(cells: DataFrame, keys: list[str], cell_km: float, name: str = "acres") -> DataFrame:
    per_cell = (cell_km * 1000.0) ** 2 / M2_PER_ACRE
    return cells.groupBy(*keys).agg((F.count("*") * F.lit(per_cell)).alias(name))


def _shifts(offsets) -> F.Column:
    return F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))


def swept(cells: DataFrame, keys: list[str], radius_cells: float) -> DataFrame:
    """Cells within ``radius_cells`` of the given ones.

    A disc is laid out as one span per grid row instead of all its cells; spans of a row
    are merged before they are opened into cells again. A grid row is bounded by the
    grid's width, so the windows stay small.
    """
    n = int(math.floor(radius_cells + 1e-9))
    half = {dy: max(dx for dx, d in disc_offsets(radius_cells) if d == dy) for dy in range(-n, n + 1)}
    rows = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in half.items()]))
    spans = cells.select(*keys, "ix", "iy", rows.alias("o")).select(
        *keys, (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("ix") - F.col("o.w")).alias("lo"), (F.col("ix") + F.col("o.w")).alias("hi")
    )
    spans = spans.groupBy(*keys, "iy", "lo").agg(F.max("hi").alias("hi"))
    row = Window.partitionBy(*keys, "iy").orderBy("lo")
    reach = F.max("hi").over(row.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("open", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
    spans = spans.withColumn("g", F.sum("open").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*keys, "iy", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.select(*keys, F.explode(F.sequence("lo", "hi")).alias("ix"), "iy")


def rims(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inner, outer): members with an empty side neighbour, and empty cells beside a member."""
    marks = _shifts([(0, 0), *FOUR])
    seen = (
        cells.select(*keys, "ix", "iy", marks.alias("o"))
        .select(
            *keys,
            (F.col("ix") + F.col("o.dx")).alias("ix"),
            (F.col("iy") + F.col("o.dy")).alias("iy"),
            ((F.col("o.dx") == 0) & (F.col("o.dy") == 0)).cast("int").alias("self"),
        )
        .groupBy(*keys, "ix", "iy")
        .agg(F.max("self").alias("self"), F.count("*").alias("n"))
    )
    inner = seen.where((F.col("self") == 1) & (F.col("n") < 5)).select(*keys, "ix", "iy")
    outer = seen.where(F.col("self") == 0).select(*keys, "ix", "iy")
    return inner, outer


def dilate(cells: DataFrame, keys: list[str], radius_cells: float) -> DataFrame:
    inner, _ = rims(cells, keys)
    return union(cells, swept(inner, keys, radius_cells), keys)


def erode(cells: DataFrame, keys: list[str], radius_cells: float) -> DataFrame:
    _, outer = rims(cells, keys)
    return subtract(cells, swept(outer, keys, radius_cells), keys)


def close(cells: DataFrame, keys: list[str], radius_cells: float) -> DataFrame:
    # Each step reads its input twice (rim and body), so the middle is written once.
    return erode(cut_lineage(dilate(cells, keys, radius_cells)), keys, radius_cells)


def smooth(cells: DataFrame, keys: list[str], radius_cells: float) -> DataFrame:
    """Grow by r, shrink by 1.6 r, grow by 0.6 r; a shape that vanishes is kept as it was."""
    grown = cut_lineage(dilate(cells, keys, radius_cells))
    shrunk = cut_lineage(erode(grown, keys, 1.6 * radius_cells))
    out = cut_lineage(dilate(shrunk, keys, 0.6 * radius_cells))
    if not keys:
        return out
    lost = cells.join(out.select(*keys).distinct(), keys, "left_anti")
    return out.unionByName(lost.select(*out.columns))


def subdivide(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Cut each cell into n x n finer cells of the same lattice."""
    steps = F.array(*[F.lit(i) for i in range(n)])
    return (
        cells.select(*keys, "ix", F.explode(steps).alias("a"), "iy")
        .select(*keys, (F.col("ix") * n + F.col("a")).alias("ix"), "iy")
        .select(*keys, "ix", (F.col("iy") * n).alias("iy0"), F.explode(steps).alias("b"))
        .select(*keys, "ix", (F.col("iy0") + F.col("b")).alias("iy"))
    )


def coarsen(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    return cells.select(
        *keys, F.floor(F.col("ix") / n).alias("ix"), F.floor(F.col("iy") / n).alias("iy")
    ).distinct()


def components(cells: DataFrame, keys: list[str], eight: bool = False) -> DataFrame:
    """Connected parts: adds ``comp``, the smallest packed cell id of the part.

    Cells are first joined into horizontal runs, so a filled shape enters the label rounds as one
    node per row span; the rounds alternate large and small stars and grow as the logarithm of the
    longest chain of runs.
    """
    pack = F.col("iy").cast("bigint") * F.lit(1 << 31) + F.col("ix").cast("bigint")
    base = cells.select(*keys, "ix", "iy").distinct()
    # One grid row of one key at a time: its length is the grid's width.
    row = Window.partitionBy(*keys, "iy").orderBy("ix")
    base = base.withColumn("__g", F.col("ix") - F.row_number().over(row))
    runs = base.groupBy(*keys, "iy", "__g").agg(F.min("ix").alias("lo"), F.max("ix").alias("hi"), F.min(pack).alias("id"))
    runs = cut_lineage(runs.drop("__g").withColumn("node", F.monotonically_increasing_id()))
    # Runs of neighbouring rows touch where their spans (widened by one at the corners) overlap.
    reach = 1 if eight else 0
    tile = 64
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / tile), F.floor(hi / tile)))
    lower = runs.select(*keys, (F.col("iy") + 1).alias("iy"), F.col("node").alias("a"), (F.col("lo") - reach).alias("alo"), (F.col("hi") + reach).alias("ahi"))
    lower = lower.withColumn("__t", span(F.col("alo"), F.col("ahi")))
    upper = runs.select(*keys, "iy", F.col("node").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    upper = upper.withColumn("__t", span(F.col("blo"), F.col("bhi")))
    links = by_shuffle(lower).join(upper, [*keys, "iy", "__t"]).where("alo <= bhi AND blo <= ahi").select("a", "b").distinct()
    labels = linked(links).withColumnRenamed("node", "__n")
    placed = by_shuffle(runs).join(labels, F.col("node") == F.col("__n"), "left").withColumn("__c", F.coalesce("component", "node"))
    names = placed.groupBy("__c").agg(F.min("id").alias("comp"))
    named = cut_lineage(by_shuffle(placed).join(names, "__c").select(*keys, "iy", "lo", "hi", "comp"))
    return named.select(*keys, F.explode(F.sequence("lo", "hi")).alias("ix"), "iy", "comp")


def nearest_component(parts: DataFrame, origin: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the part closest to the key's origin cell (ox, oy); ties go to the smaller label."""
    d = F.hypot(F.col("ix") - F.col("ox"), F.col("iy") - F.col("oy"))
    near = parts.join(origin, keys).groupBy(*keys, "comp").agg(F.min(d).alias("d"))
    pick = near.groupBy(*keys).agg(F.min(F.struct("d", "comp")).alias("b")).select(*keys, F.col("b.comp").alias("comp"))
    return parts.join(pick, [*keys, "comp"], "left_semi")


def drop_stray(parts: DataFrame, base: DataFrame, dets: DataFrame, keys: list[str], reach_cells: float,
               min_dets: int = 4, min_sensors: int = 2) -> DataFrame:
    """Keep parts touching the buffered base or corroborated by several sensors.

    A single part stays as is; when nothing qualifies the largest part stays.
    ``dets`` carries (keys, ix, iy, sensor).
    """
    near_base = dilate(base, keys, reach_cells)
    touching = by_shuffle(parts).join(near_base, [*keys, "ix", "iy"], "left_semi").select(*keys, "comp").distinct()
    inside = by_shuffle(parts).join(dets.select(*keys, "ix", "iy", "sensor"), [*keys, "ix", "iy"])
    seconded = (
        inside.groupBy(*keys, "comp")
        .agg(F.count("*").alias("n"), F.count_distinct("sensor").alias("s"))
        .where((F.col("n") >= min_dets) & (F.col("s") >= min_sensors))
        .select(*keys, "comp")
    )
    sizes = parts.groupBy(*keys, "comp").agg(F.count("*").alias("size"))
    # Parts per key, not cells: one row per part reaches this window.
    flags = touching.unionByName(seconded).distinct().withColumn("ok", F.lit(1))
    w = Window.partitionBy(*keys)
    first = Window.partitionBy(*keys).orderBy(F.desc("size"), "comp")
    judged = sizes.join(flags, [*keys, "comp"], "left").select(
        *keys, "comp", "ok", F.count("*").over(w).alias("parts"), F.max("ok").over(w).alias("any_ok"),
        F.row_number().over(first).alias("rn"),
    )
    keep = judged.where((F.col("parts") == 1) | (F.col("ok") == 1) | (F.col("any_ok").isNull() & (F.col("rn") == 1)))
    return parts.join(keep.select(*keys, "comp"), [*keys, "comp"], "left_semi")


def growth_metrics(base: DataFrame, real: DataFrame, pred: DataFrame, keys: list[str], cell_km: float) -> DataFrame:
    """Overlap of observed and predicted growth beyond the base, per key."""
    flags = None
    for name, cells in (("b", base), ("r", real), ("p", pred)):
        rows = cells.select(*keys, "ix", "iy").withColumn("what", F.lit(name))
        flags = rows if flags is None else flags.unionByName(rows)
    has = lambda n: F.max((F.col("what") == n).cast("int")).alias(n)
    cell = flags.groupBy(*keys, "ix", "iy").agg(has("b"), has("r"), has("p"))
    b, r, p = (F.col(c) == 1 for c in "brp")
    per_cell = F.lit((cell_km * 1000.0) ** 2 / M2_PER_ACRE)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both, either = n(~b & r & p), n(~b & (r | p))
    return cell.groupBy(*keys).agg(
        F.when(either > 0, both / either).otherwise(F.lit(0.0)).alias("growth_iou"),
        (n(b) * per_cell).alias("base_acres"),
        (n(r) * per_cell).alias("real_acres"),
        (n(p) * per_cell).alias("pred_acres"),
        (n(~b & r & ~p) * per_cell).alias("missed_acres"),
        (n(~b & p & ~r) * per_cell).alias("over_acres"),
    )
