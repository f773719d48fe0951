"""Raster layers as cell rows: terrain, sampling, resampling and mosaics.

Neighbours are found by equi-joins on shifted indices, never by a window over a
whole row or layer, so a layer of any size stays spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import frames

M_PER_DEG = frames.M_PER_DEG


def make_grid(boxes: DataFrame, res_m: float, keys: list[str]) -> DataFrame:
    """Regular lat/lon grid per box; row 0 is the north edge."""
    dlat = F.lit(res_m / M_PER_DEG)
    dlon = F.lit(res_m) / (F.lit(M_PER_DEG) * F.cos(F.radians((F.col("south") + F.col("north")) / 2)))
    n_rows = F.ceil((F.col("north") - F.col("south")) / dlat).cast("int")
    n_cols = F.ceil((F.col("east") - F.col("west")) / dlon).cast("int")
    sized = boxes.select(*keys, "west", "north", dlat.alias("dlat"), dlon.alias("dlon"), n_rows.alias("nr"), n_cols.alias("nc"))
    rows = sized.where("nr > 0 AND nc > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    return cells.select(
        *keys, "row", "col", (F.col("north") - F.col("row") * F.col("dlat")).alias("lat"),
        (F.col("west") + F.col("col") * F.col("dlon")).alias("lon"),
    )


def clean_layer(cells: DataFrame, layer: str) -> DataFrame:
    """Layer rules: DEM voids below -1000 become NULL, canopy and bulk density are clipped."""
    v = F.col("value")
    rule = {
        "dem": F.when(v >= -1000, v),
        "canopy": F.least(F.greatest(v, F.lit(0.0)), F.lit(100.0)),
        "cbd": F.least(F.greatest(v, F.lit(0.0)), F.lit(50.0)),
    }.get(layer, v)
    return cells.withColumn("value", rule)


def _shares(cells: DataFrame, keys: list[str], value: str, shifts: list[tuple[int, int, str]]) -> DataFrame:
    """Each cell's values at the named index shifts, gathered with one shuffle.

    A cell posts its value to the cells that look at it; the centre marks itself.
    """
    posts = F.array(
        *[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(name).alias("who")) for dr, dc, name in [(0, 0, "self"), *shifts]]
    )
    sent = cells.select(*keys, "row", "col", value, F.explode(posts).alias("p")).select(
        *keys, (F.col("row") + F.col("p.dr")).alias("row"), (F.col("col") + F.col("p.dc")).alias("col"), F.col("p.who").alias("who"), value
    )
    got = [F.max(F.when(F.col("who") == n, F.col(value))).alias(n) for n in ["self", *[s[2] for s in shifts]]]
    here = F.max((F.col("who") == "self").cast("int")).alias("__here")
    return sent.groupBy(*keys, "row", "col").agg(here, *got).where("__here = 1").drop("__here")


def _slope_of(lo: str, hi: str, spacing: Column) -> Column:
    """Central difference, one-sided at an edge, NULL-free for single rows."""
    both = (F.col(hi) - F.col(lo)) / (2 * spacing)
    return F.coalesce(both, (F.col(hi) - F.col("self")) / spacing, (F.col("self") - F.col(lo)) / spacing, F.lit(0.0))


def gradient(cells: DataFrame, keys: list[str], res_x: float, res_y: float, value: str = "value") -> DataFrame:
    """dz/dx (east) and dz/drow; row spacing runs south."""
    near = _shares(cells, keys, value, [(-1, 0, "up"), (1, 0, "down"), (0, -1, "left"), (0, 1, "right")])
    return near.select(
        *keys, "row", "col", F.col("self").alias(value),
        _slope_of("left", "right", F.lit(res_x)).alias("dz_dx"), _slope_of("up", "down", F.lit(res_y)).alias("dz_drow"),
    )


def slope_aspect(dem: DataFrame, keys: list[str], res_x: float, res_y: float, value: str = "value") -> DataFrame:
    """Slope in degrees and downslope compass azimuth."""
    g = gradient(dem, keys, res_x, res_y, value)
    dx, dy = F.col("dz_dx"), -F.col("dz_drow")
    return g.select(
        *keys, "row", "col", value, F.degrees(F.atan(F.hypot(dx, dy))).alias("slope_deg"),
        frames.wrap_360(F.degrees(F.atan2(-dx, -dy)) + 360.0).alias("aspect_deg"),
    )


def curvature(dem: DataFrame, keys: list[str], res_x: float, res_y: float, value: str = "value") -> DataFrame:
    """Laplacian from two rounds of gradients (d2z/dx2 + d2z/dy2)."""
    g = gradient(dem, keys, res_x, res_y, value)
    xx = gradient(g.select(*keys, "row", "col", F.col("dz_dx").alias("value")), keys, res_x, res_y).select(*keys, "row", "col", F.col("dz_dx").alias("zxx"))
    yy = gradient(g.select(*keys, "row", "col", F.col("dz_drow").alias("value")), keys, res_x, res_y).select(*keys, "row", "col", F.col("dz_drow").alias("zyy"))
    ids = [*keys, "row", "col"]
    return xx.join(yy, ids).select(*ids, (F.col("zxx") + F.col("zyy")).alias("curvature"))


def _box_pass(cells: DataFrame, keys: list[str], axis: str, other: str, radius: int, value: str) -> DataFrame:
    """Moving mean along one axis with the edge value repeated outside.

    A cell adds its value to every window it is in; the first and last cells of a
    line add theirs once more for each place the window hangs over the edge.
    """
    ends = cells.groupBy(*keys).agg(F.min(axis).alias("__a0"), F.max(axis).alias("__a1"))
    rows = cells.select(*keys, "row", "col", value).join(ends, keys) if keys else cells.select("row", "col", value).join(F.broadcast(ends), F.lit(True))
    target = F.explode(F.sequence(F.greatest(F.col(axis) - radius, F.col("__a0")), F.least(F.col(axis) + radius, F.col("__a1"))))
    sent = rows.withColumn("__at", target)
    times = (
        F.lit(1)
        + F.when(F.col(axis) == F.col("__a0"), F.greatest(F.lit(radius) - (F.col("__at") - F.col("__a0")), F.lit(0))).otherwise(0)
        + F.when(F.col(axis) == F.col("__a1"), F.greatest(F.lit(radius) - (F.col("__a1") - F.col("__at")), F.lit(0))).otherwise(0)
    )
    return (
        sent.groupBy(*keys, F.col("__at").alias(axis), other)
        .agg((F.sum(F.col(value) * times) / F.lit(2 * radius + 1)).alias(value))
    )


def tpi(dem: DataFrame, keys: list[str], radius: int, value: str = "value") -> DataFrame:
    """Elevation minus the mean of the (2r+1) square round the cell."""
    mean = _box_pass(_box_pass(dem, keys, "col", "row", radius, value), keys, "row", "col", radius, value)
    ids = [*keys, "row", "col"]
    return dem.select(*ids, value).join(mean.withColumnRenamed(value, "__m"), ids).select(*ids, (F.col(value) - F.col("__m")).alias("tpi"))


def cell_sample(points: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float,
                n_rows: int, n_cols: int, clamp: bool = False) -> DataFrame:
    """Value of the pixel under each point (row 0 north); outside is NULL, or the edge when clamped."""
    col = F.floor((F.col("lon") - x0) / dx)
    row = F.floor((F.lit(y0) - F.col("lat")) / dy)
    if clamp:
        col = F.least(F.greatest(col, F.lit(0)), F.lit(n_cols - 1))
        row = F.least(F.greatest(row, F.lit(0)), F.lit(n_rows - 1))
    keyed = points.withColumns({"row": row.cast("int"), "col": col.cast("int")})
    return keyed.join(raster.select("row", "col", "value"), ["row", "col"], "left")


def bilinear_sample(points: DataFrame, raster: DataFrame, south: float, west: float, north: float, east: float,
                    n_rows: int, n_cols: int, point_id: list[str]) -> DataFrame:
    """Four-neighbour interpolation on a south-up grid; indices clamp, so edges extrapolate.

    ``raster`` rows: (row from south, col from west, value). No coverage gives 0.
    """
    fi = (F.col("lat") - south) / (north - south) * (n_rows - 1)
    fj = (F.col("lon") - west) / (east - west) * (n_cols - 1)
    i0 = F.greatest(F.lit(0), F.least(F.lit(n_rows - 2), fi.cast("int")))
    j0 = F.greatest(F.lit(0), F.least(F.lit(n_cols - 2), fj.cast("int")))
    pts = points.withColumns({"__i": i0, "__j": j0}).withColumns({"__di": fi - F.col("__i"), "__dj": fj - F.col("__j")})
    di, dj = F.col("__di"), F.col("__dj")
    corners = F.array(
        *[
            F.struct((F.col("__i") + a).alias("row"), (F.col("__j") + b).alias("col"), ((di if a else 1 - di) * (dj if b else 1 - dj)).alias("w"))
            for a in (0, 1) for b in (0, 1)
        ]
    )
    legs = pts.select(*point_id, F.explode(corners).alias("c")).select(*point_id, "c.*")
    got = legs.join(raster.select("row", "col", "value"), ["row", "col"], "left")
    return got.groupBy(*point_id).agg(F.coalesce(F.sum(F.col("w") * F.col("value")), F.lit(0.0)).alias("value"))


def resample(cells: DataFrame, factor: int, mode: str, keys: list[str] = ()) -> DataFrame:
    """Coarser grid: nearest (centre pixel), mean, or majority (smallest code on ties; codes are never averaged)."""
    r, c = F.floor(F.col("row") / factor), F.floor(F.col("col") / factor)
    groups = [*keys, r.alias("row"), c.alias("col")]
    if mode == "average":
        return cells.groupBy(*groups).agg(F.avg("value").alias("value"))
    if mode == "nearest":
        centre = (F.pmod("row", F.lit(factor)) == factor // 2) & (F.pmod("col", F.lit(factor)) == factor // 2)
        return cells.where(centre).select(*groups, "value")
    if mode == "majority":
        votes = cells.groupBy(*groups, "value").agg(F.count("*").alias("n"))
        best = F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("b")
        return votes.groupBy(*keys, "row", "col").agg(best).select(*keys, "row", "col", (-F.col("b.v")).alias("value"))
    raise ValueError(f"unknown resample mode {mode!r}")


def mosaic(tiles: DataFrame, keys: list[str], prefer: str = "last") -> DataFrame:
    """One value per cell from overlapping tiles, NULLs skipped; voids take the mean, no coverage gives 0."""
    have = F.when(F.col("value").isNotNull(), F.col("tile_order"))
    pick = (F.max_by if prefer == "last" else F.min_by)("value", have).alias("value")
    cells = tiles.groupBy(*keys, "row", "col").agg(pick)
    mean = cells.groupBy(*keys).agg(F.avg("value").alias("__m"))
    joined = cells.join(mean, keys) if keys else cells.join(F.broadcast(mean), F.lit(True))
    return joined.withColumn("value", F.coalesce("value", "__m", F.lit(0.0))).drop("__m")


def newest_tile_per_key(catalog: DataFrame) -> DataFrame:
    """Newest file per tile: the key is the name without its last '_' part."""
    name = F.element_at(F.split("url", "/"), -1)
    parts = F.split(name, "_")
    key = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")).otherwise(name)
    return catalog.groupBy(key.alias("tile_key")).agg(F.max_by("url", name).alias("url"), F.max(name).alias("fname"))
