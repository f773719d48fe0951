"""Burn-belief grid: evidence from many sources summed as log-odds per cell.

A grid is a table of geometry per fire, one row each: (fire, west, south, dlat, dlon,
h, w, lat0, res_m). Evidence is sparse: only touched cells become rows, and sources
combine in one commutative sum per cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import frames
from emberline.operators import cells as C
from emberline.operators.spatial import radius_join
from emberline.session import by_shuffle, cut_lineage

CELL = ["fire", "ix", "iy"]
# Fixed values of the belief model.
EVIDENCE_SCALE, TOUCHED = 2.5, 0.05


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def belief_grid(boxes: DataFrame, res_m: float = 100.0) -> DataFrame:
    """Grid geometry per fire from its (west, south, east, north) box."""
    lat0 = (F.col("south") + F.col("north")) / 2
    dlat = F.lit(res_m / frames.M_PER_DEG)
    dlon = F.lit(res_m) / (F.lit(frames.M_PER_DEG) * F.cos(F.radians(lat0)))
    return boxes.select(
        "fire", "west", "south", "east", lat0.alias("lat0"), dlat.alias("dlat"), dlon.alias("dlon"), F.lit(float(res_m)).alias("res_m"),
        F.ceil((F.col("north") - F.col("south")) / dlat).cast("bigint").alias("h"),
        F.ceil((F.col("east") - F.col("west")) / dlon).cast("bigint").alias("w"),
    )


def grid_cells(grid: DataFrame, also: list[str] = ()) -> DataFrame:
    """Every cell with its centre. ``also`` names columns of ``grid`` that its cells keep: facts per fire are
    joined to the grid's one row, before it is laid out, and never to its cells."""
    rows = grid.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1)))
    rows = rows.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") - 1)))
    return rows.select(*CELL, (F.col("west") + F.col("ix") * F.col("dlon")).alias("lon"), (F.col("south") + F.col("iy") * F.col("dlat")).alias("lat"), *also)


def cells_beside(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Cells with their fire's facts. ``cells`` may be the grid itself, which then joins by its one row per fire;
    cells already laid out come from ``explode``, which size estimates do not see, and are never broadcast."""
    if "dlon" in cells.columns:
        return grid_cells(cells.join(facts, "fire"), [c for c in facts.columns if c != "fire"])
    return by_shuffle(cells).join(facts, "fire")


def disc_mask(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Cells whose centre lies in a disc of ``radius_deg`` round a point (degrees, as drawn).

    Each point lists the few cells its disc can reach, so no join with the grid's cells is made.
    """
    p = by_shuffle(points).join(grid, "fire")
    span = lambda v, o, step: F.sequence(
        F.ceil((F.col(v) - F.col("radius_deg") - F.col(o)) / F.col(step) - F.lit(1e-9)),
        F.floor((F.col(v) + F.col("radius_deg") - F.col(o)) / F.col(step) + F.lit(1e-9)),
    )
    fits = lambda v, o, step: F.floor((F.col(v) + F.col("radius_deg") - F.col(o)) / F.col(step) + F.lit(1e-9)) >= F.ceil(
        (F.col(v) - F.col("radius_deg") - F.col(o)) / F.col(step) - F.lit(1e-9)
    )
    p = p.where(fits("lat", "south", "dlat") & fits("lon", "west", "dlon"))
    p = p.withColumn("iy", F.explode(span("lat", "south", "dlat"))).withColumn("ix", F.explode(span("lon", "west", "dlon")))
    dx = F.col("west") + F.col("ix") * F.col("dlon") - F.col("lon")
    dy = F.col("south") + F.col("iy") * F.col("dlat") - F.col("lat")
    inside = dx * dx + dy * dy <= F.col("radius_deg") * F.col("radius_deg")
    on_grid = (F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("ix") < F.col("w")) & (F.col("iy") < F.col("h"))
    return p.where(inside & on_grid).select("fire", F.col("ix"), F.col("iy")).distinct()


def kernel(sigma_cells: float) -> list[tuple[int, float]]:
    """Normalised Gaussian weights, cut at four sigma."""
    r = int(4.0 * sigma_cells + 0.5)
    w = [math.exp(-0.5 * (i / sigma_cells) ** 2) for i in range(-r, r + 1)]
    return [(i - r, v / sum(w)) for i, v in enumerate(w)]


def mirror_matrix(n: int, lo: int, hi: int, src: int, stop: int, weights: list[tuple[int, float]]) -> np.ndarray:
    """Rows ``lo`` to ``hi``, columns ``src`` to ``stop``: how a blurred line of ``n`` cells draws on the line.

    Beyond an end the line goes on as its mirror image, over and over if the kernel is longer than the line.
    """
    step, weight = np.array(weights).T
    at = (np.arange(lo, hi)[:, None] + step[None, :].astype(np.int64)) % (2 * n)
    at = np.where(at < n, at, 2 * n - 1 - at)
    out = np.zeros((hi - lo, stop - src))
    np.add.at(out, (np.repeat(np.arange(hi - lo), len(step)), (at - src).ravel()), np.tile(weight, hi - lo))
    return out


def gaussian_blur(field: DataFrame, grid: DataFrame, sigma_m: float, res_m: float = 100.0, keys: list[str] = ("fire",), value: str = "v", block: int = 128) -> DataFrame:
    """Separable blur of a sparse field with mirrored edges: keys, ix, iy and the value of every cell that the field reaches.

    The grid is cut into blocks of ``block`` cells a side. A cell goes to its own block and to those that it
    reaches across their borders, so a block has its halo with it, and is blurred by two small matrix
    products; no row per cell and kernel step is ever made, and a large fire is many blocks.
    """
    weights, keys = kernel(max(sigma_m / res_m, 0.3)), list(keys)
    r = weights[-1][0]
    rows = field.select(*keys, "ix", "iy", F.col(value).cast("double").alias("__v")).join(grid.select("fire", "h", "w"), "fire")
    for axis, size in (("ix", "w"), ("iy", "h")):
        last = F.floor((F.col(size) - 1) / block)
        first, stop = F.greatest(F.floor((F.col(axis) - r) / block), F.lit(0)), F.least(F.floor((F.col(axis) + r) / block), last)
        rows = rows.withColumn(f"__b{axis}", F.explode(F.sequence(first, stop)))
    kinds = {c: field.schema[c].dataType.simpleString() for c in (*keys, "ix", "iy")}
    ints = {c: "int32" if kinds[c] == "int" else "int64" for c in ("ix", "iy")}

    def blur(part: pd.DataFrame) -> pd.DataFrame:
        top = part.iloc[0]
        sides, spans = [], []
        for axis, size in (("ix", "w"), ("iy", "h")):
            n, lo = int(top[size]), int(top[f"__b{axis}"]) * block
            hi = min(lo + block, n)
            src, stop = max(0, lo - r), min(n, hi + r)
            sides.append(mirror_matrix(n, lo, hi, src, stop, weights))
            spans.append((lo, src, stop))
        (x0, sx, ex), (y0, sy, ey) = spans
        dense = np.zeros((2, ey - sy, ex - sx))
        at = (part["iy"].to_numpy(np.int64) - sy, part["ix"].to_numpy(np.int64) - sx)
        np.add.at(dense[0], at, part["__v"].to_numpy())
        dense[1][at] = 1.0
        out, reached = sides[1] @ dense @ sides[0].T
        iy, ix = np.nonzero(reached > 0)
        made = {k: [top[k]] * len(ix) for k in keys}
        return pd.DataFrame({**made, "ix": (ix + x0).astype(ints["ix"]), "iy": (iy + y0).astype(ints["iy"]), value: out[iy, ix]})

    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", {value} double"
    return rows.groupBy(*keys, "__bix", "__biy").applyInPandas(blur, schema)


def evidence(weight: Column, cond_w: Column) -> Column:
    return F.lit(EVIDENCE_SCALE) * F.greatest(F.least(weight * cond_w, F.lit(0.999)), F.lit(0.0))


def _scaled(field: DataFrame) -> DataFrame:
    """Field divided by its own maximum per fire."""
    top = field.groupBy("fire").agg(F.max("v").alias("__top"))
    # One row per fire is sent; the field's own rows stay where they were blurred.
    return field.join(F.broadcast(top), "fire").withColumn("v", F.col("v") / F.when(F.col("__top") == 0, 1.0).otherwise(F.col("__top"))).drop("__top")


def mask_contribution(mask: DataFrame, grid: DataFrame, source: str, kind: str, sigma_m: float, weight: float, cond_w: float = 1.0,
                      res_m: float = 100.0, anchor_p: float = 0.99) -> DataFrame:
    """Signed log-odds rows of one burned / clear / exclusion / anchor mask."""
    v = _scaled(gaussian_blur(mask.select(*CELL).withColumn("v", F.lit(1.0)), grid, sigma_m, res_m))
    if kind == "anchor":
        p = max(min(anchor_p, 0.999), 0.5)
        add, floor = F.lit(logit(p)) * F.col("v"), F.lit(p) * F.col("v")
    else:
        sign = 1.0 if kind == "burned" else -1.0
        strength = EVIDENCE_SCALE * max(min(weight * cond_w, 0.999), 0.0)
        add, floor = F.lit(sign * strength) * F.col("v"), F.lit(0.0)
    return v.select(*CELL, F.lit(source).alias("source"), add.alias("add"), floor.alias("anchor_floor"))


def edge_contribution(points: DataFrame, grid: DataFrame, source: str, sigma_m: float, weight: float, res_m: float = 100.0) -> DataFrame:
    """Log-odds of edge points; indices truncate toward zero, so a point just outside lands in cell 0."""
    p = by_shuffle(points).join(grid, "fire").select(
        "fire", frames.truncate((F.col("lon") - F.col("west")) / F.col("dlon")).alias("ix"),
        frames.truncate((F.col("lat") - F.col("south")) / F.col("dlat")).alias("iy"), "h", "w",
    )
    hits = p.where("ix >= 0 AND iy >= 0 AND ix < w AND iy < h").groupBy(*CELL).agg(F.count("*").cast("double").alias("v"))
    v = _scaled(gaussian_blur(hits, grid, sigma_m, res_m))
    strength = EVIDENCE_SCALE * max(min(weight, 0.999), 0.0)
    return v.select(*CELL, F.lit(source).alias("source"), (F.lit(strength) * F.col("v")).alias("add"), F.lit(0.0).alias("anchor_floor"))


def direction_contribution(winds: DataFrame, grid: DataFrame, source: str, weight: float) -> DataFrame:
    """Mild push downwind of the grid centre. ``winds``: (fire, bearing)."""
    c = grid_cells(grid.join(winds.select("fire", "bearing"), "fire"), ["west", "east", "lat0", "bearing"])
    mx = F.lit(frames.M_PER_DEG) * F.cos(F.radians("lat0"))
    dx = (F.col("lon") - (F.col("west") + F.col("east")) / 2) * mx
    dy = (F.col("lat") - F.col("lat0")) * F.lit(frames.M_PER_DEG)
    km = (dx * F.sin(F.radians("bearing")) + dy * F.cos(F.radians("bearing"))) / 1000.0
    strength = EVIDENCE_SCALE * max(min(weight, 0.999), 0.0) * 0.6
    return c.select(*CELL, F.lit(source).alias("source"), (F.lit(strength) * F.tanh(km / 3.0)).alias("add"), F.lit(0.0).alias("anchor_floor"))


def fold(contributions: DataFrame, grid: DataFrame, prior_p: float = 0.15) -> DataFrame:
    """Log-odds and probability per cell: one sum of contributions, floors by maximum."""
    got = contributions.groupBy(*CELL).agg(F.sum("add").alias("add"), F.max("anchor_floor").alias("anchor_floor"))
    rows = by_shuffle(grid_cells(grid)).join(got, CELL, "left")
    level = F.lit(logit(prior_p)) + F.coalesce("add", F.lit(0.0))
    floor = F.coalesce("anchor_floor", F.lit(0.0))
    return rows.select(
        *CELL, "lon", "lat", level.alias("log_odds"), F.greatest(F.lit(1.0) / (F.lit(1.0) + F.exp(-level)), floor).alias("p"),
        F.abs(level).alias("confidence"),
    )


def touched_cells(contributions: DataFrame) -> DataFrame:
    return contributions.where(F.abs("add") > TOUCHED).groupBy("fire", "source").agg(F.count("*").alias("cells"))


def condition_weight(obs: DataFrame) -> DataFrame:
    """Base weights lowered when a source is blind. Needs source, hour_utc, smoke, overpass_age_h."""
    day = F.col("hour_utc").between(14, 23)
    s = F.col("source")
    w = (
        F.when(s == "camera", F.when(day, 1.0).otherwise(0.2) * F.when(F.col("smoke"), 0.3).otherwise(1.0))
        .when(s == "aircraft", F.when(day, 1.0).otherwise(0.25))
        .when(s == "sentinel2", F.when(F.col("smoke"), 0.2).otherwise(1.0))
        .when((s == "viirs") & F.col("overpass_age_h").isNotNull(), F.greatest(F.lit(0.2), F.lit(1.0) - F.col("overpass_age_h") / 12.0))
        .otherwise(1.0)
    )
    return obs.withColumn("cond_w", F.greatest(w, F.lit(0.05)))


def elongate(field: DataFrame, winds: DataFrame, value: str = "p", block: int = 128) -> DataFrame:
    """Smear belief along the wind, then evenly, and restore each fire's peak.

    The oriented Gaussian (1 across, 1 + 1.2 min(lb-1, 3) along, then 0.7 all round, so
    variances add) is laid out as the offsets within four sigma of it; no image is rotated. Fires are
    cut into blocks of ``block`` cells a side with a halo of the kernel's reach.
    ``winds``: (fire, bearing, lb).
    """
    reach = math.ceil(4 * math.sqrt((1 + 1.2 * 3) ** 2 + 0.49))  # of the longest kernel there is
    along = F.pow(F.lit(1.0) + F.lit(1.2) * F.least(F.col("lb") - 1, F.lit(3.0)), F.lit(2.0)) + 0.49
    turned = F.struct(F.radians("bearing").cast("double").alias("b"), along.alias("va"))
    wf = winds.where(F.col("bearing").isNotNull()).groupBy("fire").agg(F.collect_list(turned).alias("__winds"))
    wf = wf.select("fire", F.col("__winds.b").alias("__b"), F.col("__winds.va").alias("__va"))
    # A cell is a member of its own block and of those that it reaches; no row per cell and offset is made.
    rows = by_shuffle(field.select(*CELL, F.col(value).cast("double").alias("__v"))).join(wf, "fire")
    for axis in ("ix", "iy"):
        rows = rows.withColumn(f"__b{axis}", F.explode(F.sequence(F.floor((F.col(axis) - reach) / block), F.floor((F.col(axis) + reach) / block))))
    dy, dx = (o.ravel() for o in np.mgrid[-reach : reach + 1, -reach : reach + 1])

    def smear(part: pd.DataFrame) -> pd.DataFrame:
        top = part.iloc[0]
        x0, y0 = int(top["__bix"]) * block, int(top["__biy"]) * block
        weight = np.zeros(len(dx))
        for b, va in zip(top["__b"], top["__va"]):
            q = (dx * np.sin(b) + dy * np.cos(b)) ** 2 / va + (dx * np.cos(b) - dy * np.sin(b)) ** 2 / 1.49
            weight += np.where(q <= 16, np.exp(-0.5 * q), 0.0)
        used = np.nonzero(weight)[0]
        weight = weight[used] / weight[used].sum()
        ix, iy, v = part["ix"].to_numpy(np.int64) - x0 + reach, part["iy"].to_numpy(np.int64) - y0 + reach, part["__v"].to_numpy(float)
        known = ~np.isnan(v)
        dense = np.zeros((2, block + 2 * reach, block + 2 * reach))
        np.add.at(dense[0], (iy[known], ix[known]), v[known])
        dense[1, iy[known], ix[known]] = 1.0
        own = (ix >= reach) & (ix < block + reach) & (iy >= reach) & (iy < block + reach)
        ox, oy = ix[own], iy[own]
        out, seen = np.zeros(len(ox)), np.zeros(len(ox))
        for k, w in zip(used, weight):
            at = (oy - dy[k], ox - dx[k])
            out += w * dense[0][at]
            seen += dense[1][at]
        return part.loc[own, CELL].assign(s=np.where(seen > 0, out, np.nan))

    schema = ", ".join(f"{c} {field.schema[c].dataType.simpleString()}" for c in CELL) + ", s double"
    rows = cut_lineage(rows.groupBy("fire", "__bix", "__biy").applyInPandas(smear, schema))
    peaks = field.groupBy("fire").agg(F.max(value).alias("__p"))
    tops = rows.groupBy("fire").agg(F.max("s").alias("__t"))
    return by_shuffle(rows).join(peaks, "fire").join(tops, "fire").select(
        *CELL, (F.col("s") / F.greatest("__t", F.lit(1e-6)) * F.greatest("__p", F.lit(1e-6))).alias(value)
    )


# ---- evidence ------------------------------------------------------------------------


def statused(fires: DataFrame, counts: DataFrame, errors: DataFrame) -> DataFrame:
    """ok with evidence, unavailable when nothing came and reads failed, else no_data."""
    rows = fires.select("fire").join(counts, "fire", "left").join(errors, "fire", "left")
    n, e = F.coalesce("n", F.lit(0)), F.coalesce("errors", F.lit(0))
    return rows.select("fire", n.alias("n"), F.when(n > 0, "ok").when(e > 0, "unavailable").otherwise("no_data").alias("status"))


def viirs_evidence(dets: DataFrame, grid: DataFrame) -> DataFrame:
    """Union of discs 0.1875 km (as degrees) round each detection."""
    pts = dets.select("fire", "lat", "lon").distinct()
    return disc_mask(pts.withColumn("radius_deg", F.lit(0.1875 / frames.KM_PER_DEG)), grid)


def warm_pixel_evidence(pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """Discs of (0.5 + hotness) km on the newest granule of the first satellite with warm pixels.

    ``pixels``: (fire, sat_rank, granule, lat, lon, radius_km), already filtered to warm ones.
    """
    best = pixels.groupBy("fire").agg(F.min(F.struct("sat_rank", (-F.col("granule")).alias("g"))).alias("b"))
    pick = best.select("fire", F.col("b.sat_rank").alias("sat_rank"), (-F.col("b.g")).alias("granule"))
    used = pixels.join(pick, ["fire", "sat_rank", "granule"], "left_semi")
    return disc_mask(used.select("fire", "lat", "lon", (F.col("radius_km") * F.lit(1000.0 / frames.M_PER_DEG)).alias("radius_deg")), grid)


def path_evidence(segments: DataFrame, grid: DataFrame, radius_m: float = 400.0) -> DataFrame:
    """Cells whose centre lies within ``radius_m`` (as degrees) of a leg (fire, x1, y1, x2, y2), point to segment.

    A leg lists the grid rows its buffer crosses, and per row the columns near the part of the leg that
    passes by, so a long leg costs its area and not its bounding box.
    """
    r = F.lit(radius_m / frames.M_PER_DEG)
    p = segments.join(grid, "fire")

    def spread(rows: DataFrame, name: str, lo: Column, hi: Column, origin: str, step: str, size: str) -> DataFrame:
        a = F.greatest(F.ceil((lo - F.col(origin)) / F.col(step) - F.lit(1e-9)), F.lit(0).cast("bigint"))
        b = F.least(F.floor((hi - F.col(origin)) / F.col(step) + F.lit(1e-9)), F.col(size) - 1)
        return rows.withColumns({"__a": a, "__b": b}).where("__a <= __b").withColumn(name, F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")

    p = spread(p, "iy", F.least("y1", "y2") - r, F.greatest("y1", "y2") + r, "south", "dlat", "h")
    p = p.withColumn("__y", F.col("south") + F.col("iy") * F.col("dlat"))
    rise = F.col("y2") - F.col("y1")
    along = lambda y: frames.clip((y - F.col("y1")) / rise, 0.0, 1.0)
    flat = F.abs(rise) < 1e-12
    at = lambda u: F.col("x1") + u * (F.col("x2") - F.col("x1"))
    xa = at(F.when(flat, 0.0).otherwise(along(F.col("__y") - r)))
    xb = at(F.when(flat, 1.0).otherwise(along(F.col("__y") + r)))
    p = spread(p, "ix", F.least(xa, xb) - r, F.greatest(xa, xb) + r, "west", "dlon", "w")
    x = F.col("west") + F.col("ix") * F.col("dlon")
    near = frames.segment_distance(x, F.col("__y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) <= r
    return p.where(near).select(*CELL).distinct()


def shuttle_weight(shuttles: DataFrame, weight: float = 0.65) -> DataFrame:
    """Evidence weight per fire grows with confirmed round trips, up to the full weight."""
    trips = shuttles.groupBy("fire").agg(F.sum("n_round_trips").alias("trips"))
    return trips.withColumn("weight", F.lit(weight) * F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.15) * F.col("trips")))


def shuttle_evidence(away_points: DataFrame, grid: DataFrame) -> DataFrame:
    """Discs of max(spread, 0.3 km) round every visit of the fire-side stop."""
    r = F.greatest("spread_km", F.lit(0.3)) / F.lit(frames.QUICK_KM_PER_DEG)
    return disc_mask(away_points.select("fire", "lat", "lon", r.alias("radius_deg")), grid)


def origin_evidence(fires: DataFrame, grid: DataFrame) -> DataFrame:
    """500 m disc at the reported origin, only without a base and with stale polar data (12 h or more)."""
    use = fires.where(~F.col("has_base") & (F.col("viirs_age_h") >= 12))
    return disc_mask(use.select("fire", "lat", "lon", F.lit(500.0 / frames.M_PER_DEG).alias("radius_deg")), grid)


def camera_wedge_cells(wedges: DataFrame, cells: DataFrame, half_range_km: float = 8.0, reach_deg: float = 0.06) -> DataFrame:
    """Grid cells seen inside a camera's bearing interval and range band, near the fire's origin."""
    w = wedges.select("fire", F.col("lat").alias("clat"), F.col("lon").alias("clon"), "left_deg", "right_deg", "range_km", "olat", "olon")
    brg = frames.bearing_deg(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    d = frames.haversine_km(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))
    off = F.hypot(F.col("lon") - F.col("olon"), F.col("lat") - F.col("olat"))
    ok = brg.between(F.col("left_deg"), F.col("right_deg")) & (d >= F.greatest(F.col("range_km") - half_range_km, F.lit(1.0)))
    seen = lambda w: cells_beside(cells, w).where(ok & (d <= F.col("range_km") + half_range_km) & (off <= reach_deg)).select(*CELL)
    if "dlon" not in cells.columns:
        return seen(w).distinct()
    # Only a fire with several wedges can see a cell twice; the others' cells are not shuffled.
    w = w.distinct()
    counted = w.groupBy("fire").agg(F.count("*").alias("__n"))
    alone = w.join(counted.where("__n = 1").select("fire"), "fire", "left_semi")
    several = w.join(counted.where("__n > 1").select("fire"), "fire", "left_semi")
    return seen(alone).unionByName(seen(several).distinct())


def anchor_discs(pixels: DataFrame, fallback_m: float = 250.0) -> DataFrame:
    """Equal-area disc per fire pixel; missing or censored areas use the fallback, small ones are floored."""
    missing = F.col("area_m2").isNull() | F.col("saturated") | (F.col("area_m2") <= 0)
    measured = F.sqrt(F.col("area_m2") / F.lit(math.pi))
    return pixels.withColumns(
        {
            "radius_m": F.when(missing, F.lit(fallback_m)).otherwise(F.greatest(measured, F.lit(fallback_m))),
            "is_fallback": missing, "is_floored": ~missing & (measured < fallback_m),
        }
    )


def anchor_report(discs: DataFrame) -> DataFrame:
    return discs.groupBy("fire").agg(
        F.count("*").alias("cells"), F.count_if("is_fallback").alias("fallbacks"), F.count_if("is_floored").alias("floored"), F.max("radius_m").alias("max_radius_m")
    )


def evidence_provenance(obs: DataFrame, required: list[str]) -> DataFrame:
    """Provenance map per observation; a missing required key is an error, never a default."""
    keys, vals = F.array(*[F.lit(k) for k in required]), F.array(*[F.col(k).cast("string") for k in required])
    empty = F.exists(vals, lambda v: v.isNull() | (F.trim(v) == ""))
    guard = F.when(empty, F.raise_error(F.lit("evidence lacks required provenance"))).otherwise(F.map_from_arrays(keys, vals))
    return obs.withColumn("provenance", guard)


# ---- perimeter decisions ---------------------------------------------------------------


def advance_km(ros_m_min: Column, hours: Column) -> Column:
    h = frames.clip(F.coalesce(hours, F.lit(3.0)), 0.0, 24.0)
    return F.least(F.greatest(F.lit(0.15), ros_m_min * h * 60 * F.lit(0.22) / 1000.0), F.lit(8.0))


def ellipse_cells(shapes: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells inside a downwind ellipse. ``shapes``: (fire, elat, elon, semilong, semishort, bearing, shift_km).

    Axes are in km at 111 km per degree in both directions, as the shape is drawn.
    """
    c = cells_beside(cells, shapes)
    b = F.radians("bearing")
    dx = (F.col("lon") - F.col("elon")) * F.lit(111.0) - F.col("shift_km") * F.sin(b)
    dy = (F.col("lat") - F.col("elat")) * F.lit(111.0) - F.col("shift_km") * F.cos(b)
    along, across = dx * F.sin(b) + dy * F.cos(b), dx * F.cos(b) - dy * F.sin(b)
    u, v = along / F.col("semilong"), across / F.col("semishort")
    return c.where(u * u + v * v <= 1.0).select(*CELL)


def cells_within(cells: DataFrame, shape: DataFrame, reach: DataFrame, cell_km: float) -> DataFrame:
    """``cells`` within each fire's own ``reach_km`` of ``shape`` (only the shape's rim is joined)."""
    rim, _ = C.rims(shape, ["fire"])
    inside = C.intersect(cells, shape, ["fire"])
    a = cells.select(*CELL).withColumns({"x": F.col("ix").cast("double"), "y": F.col("iy").cast("double")})
    b = rim.join(reach, "fire").select("fire", F.col("ix").cast("double").alias("rx"), F.col("iy").cast("double").alias("ry"), "reach_km")
    # Fires of like reach meet on tiles of their size, whatever the reach is.
    size = F.greatest(F.ceil(F.log2(F.greatest(F.col("reach_km") / cell_km, F.lit(1.0)))), F.lit(0).cast("bigint"))
    b = b.withColumn("__size", size)
    out = inside
    for row in b.select("__size").distinct().orderBy("__size").collect():  # powers of two, some ten at most
        some = b.where(F.col("__size") == row[0]).drop("__size")
        close = radius_join(a, some, float(2 ** row[0]), ["fire"], balance=False).where(F.col("d") * cell_km <= F.col("reach_km"))
        out = out.unionByName(close.select(*CELL))
    return out.select(*CELL).distinct()


def reachable_growth(base: DataFrame, goes: DataFrame, viirs: DataFrame, facts: DataFrame, cells: DataFrame, cell_km: float) -> DataFrame:
    """Base plus geostationary growth within reach, a physics head lobe, and nearby polar cells.

    ``facts``: (fire, ros_m_min, hours, lb, bearing, clat, clon, r_base_km). The geostationary
    reach is at least one 2 km pixel; polar cells may only use the physics advance.
    """
    f = facts.withColumn("adv", advance_km(F.col("ros_m_min"), F.col("hours")))
    reach = f.select("fire", F.greatest("adv", F.lit(2.0)).alias("reach_km"))
    grown = cells_within(goes, base, reach, cell_km)
    has = grown.select("fire").distinct().withColumn("has_goes", F.lit(True))
    s = f.join(has, "fire", "left").withColumn("lobe", F.when(F.col("has_goes"), F.least("adv", F.lit(1.5))).otherwise(F.least("adv", F.lit(4.0))))
    edge_lat, edge_lon = frames.destination(F.col("clat"), F.col("clon"), F.col("bearing"), F.col("r_base_km"))
    s = s.withColumn("semilong", F.col("lobe") * F.greatest("lb", F.lit(1.0)) / 2 + F.col("r_base_km") * 0.3)
    s = s.select(
        "fire", edge_lat.alias("elat"), edge_lon.alias("elon"), "semilong",
        F.greatest(F.col("lobe") / 2, F.col("semilong") / F.greatest("lb", F.lit(1.2))).alias("semishort"), "bearing", (F.col("semilong") * 0.5).alias("shift_km"),
    )
    lobe = cells_within(ellipse_cells(s, cells), base, reach, cell_km)
    near = cells_within(viirs, base, f.select("fire", F.col("adv").alias("reach_km")), cell_km)
    out = C.union(C.union(base, grown, ["fire"]), C.union(lobe, near, ["fire"]), ["fire"])
    return C.close(out, ["fire"], max(1.0, 0.22 / cell_km))


def fresh_fire_ellipse(fires: DataFrame, cells: DataFrame) -> DataFrame:
    """Origin-grown ellipse for fires with no base, stale polar data and a lookup that did answer.

    ``fires``: (fire, lat, lon, near_acres, lb, bearing, has_base, viirs_age_h, base_status).
    """
    use = fires.where(~F.col("has_base") & (F.col("viirs_age_h") >= 12) & (F.col("base_status") != "unavailable"))
    m2 = F.greatest(F.lit(300.0), F.col("near_acres")) * F.lit(frames.M2_PER_ACRE)
    long_ = F.sqrt(m2 / F.lit(math.pi) * F.col("lb")) / 1000.0
    shapes = use.select(
        "fire", F.col("lat").alias("elat"), F.col("lon").alias("elon"), long_.alias("semilong"), (long_ / F.col("lb")).alias("semishort"), "bearing", (long_ * 0.4).alias("shift_km")
    )
    return ellipse_cells(shapes, cells)


def belief_fallback(belief: DataFrame, support: DataFrame, facts: DataFrame, cell_km: float) -> DataFrame:
    """Belief above the fire's level, kept only near detection support.

    The level is 0.5 for a peak of at least 0.55, else half the peak but not under 0.12.
    """
    peak = belief.groupBy("fire").agg(F.max("p").alias("pk"))
    level = F.when(F.col("pk") >= 0.55, F.lit(0.5)).otherwise(F.greatest(F.col("pk") * 0.5, F.lit(0.12)))
    high = belief.join(peak, "fire").where(F.col("p") >= level).select(*CELL)
    grow = facts.select("fire", F.greatest(F.lit(0.6), F.col("ros_m_min") / 1000.0 * 60 * F.lit(0.15)).alias("reach_km"))
    return cells_within(high, support, grow, cell_km)
