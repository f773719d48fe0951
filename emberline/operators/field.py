"""The learned burned-probability field: grid, features, labels, model and perimeter.

Keys are (fire, step). Distances are kilometres in the step's own frame, centred on
the base perimeter's centroid. Target geometry enters ``label_cells`` only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import frames
from emberline.functions.ordered import exact_quantiles
from emberline.operators import cells as C
from emberline.operators.spatial import boundary_distance, nearest_pruned, points_inside, radius_join
from emberline.session import by_shuffle, cut_lineage

KEYS = ["fire", "step"]
CELL = [*KEYS, "ix", "iy"]

# Fixed values of the field model.
GRID_KM, GRID_GROWTH, MARGIN_KM, MIN_CELLS = 0.25, 1.4, 2.0, 10
COUNT_RADII = [1, 2, 3, 5]
TURN_RADII = [("surround05", 0.5), ("surround1", 1.0), ("surround2", 2.0), ("surround4", 4.0), ("surround8", 8.0)]
REACH_KM, ANGLE_BINS = 8.0, 72
NEGATIVE_RATIO, NEGATIVE_FLOOR = 6.0, 200
MODEL_SETTINGS = {"maxIter": 220, "maxDepth": 7, "stepSize": 0.08, "minInstancesPerNode": 60, "seed": 0}
FEATURES = [
    "d_near", "frp_near", "t_near", "d_edge", "d_edge_rel", "d_near_rel",
    "n1", "frpmax1", "frpsum1", "tmax1", "viirs1", "n2", "frpmax2", "frpsum2", "tmax2", "viirs2",
    "n3", "frpmax3", "frpsum3", "tmax3", "viirs3", "n5", "frpmax5", "frpsum5", "tmax5", "viirs5",
    "base_r", "log_base", "log_win", "log_ndet", "frp_med", "frp_p90", "frp_near_rel", "frpmax2_rel", "grid_km",
    "d_edge_minus_det", "toward_base", "toward_base_norm",
    "surround2", "surround4", "push_here", "in_champ", "push_rel", "aniso_axis", "aniso_centroid",
    "surround05", "surround1", "surround8", "dens_r12", "dens_r25", "t_first_near", "t_first2", "elev_rel", "slope_deg", "elev_minus_det",
]
KM2_TO_ACRES = 247.105


def step_frames(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per step: frame origin, scale, base area and base bounds.

    ``edges`` in lon/lat degrees per (fire, step). Areas are taken about the first
    vertex to keep the sums small.
    """
    ring0 = edges.groupBy(*KEYS).agg(F.min_by(F.struct("x1", "y1"), F.struct("part", "ring", "seq")).alias("o"))
    e = edges.join(ring0, KEYS)
    ax, ay, bx, by = (F.col("x1") - F.col("o.x1"), F.col("y1") - F.col("o.y1"), F.col("x2") - F.col("o.x1"), F.col("y2") - F.col("o.y1"))
    cross = ax * by - bx * ay
    sums = e.groupBy(*KEYS).agg(
        F.first("o").alias("o"), F.sum(cross).alias("a2"), F.sum((ax + bx) * cross).alias("sx"), F.sum((ay + by) * cross).alias("sy"),
        F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"),
        F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"),
    )
    f = sums.select(
        *KEYS, (F.col("o.x1") + F.col("sx") / (3 * F.col("a2"))).alias("lon0"), (F.col("o.y1") + F.col("sy") / (3 * F.col("a2"))).alias("lat0"),
        F.abs(F.col("a2") / 2).alias("deg2"), "west", "east", "south", "north",
    )
    k = frames.km_per_lon(F.col("lat0"))
    f = f.withColumn("km_lon", k).withColumn("area_km2", F.col("deg2") * F.col("km_lon") * F.lit(frames.KM_PER_DEG))
    x = lambda c: ((F.col(c) - F.col("lon0")) * F.col("km_lon"))
    y = lambda c: ((F.col(c) - F.col("lat0")) * F.lit(frames.KM_PER_DEG))
    f = f.select(
        *KEYS, "lon0", "lat0", "km_lon", "area_km2", F.greatest(F.sqrt(F.col("area_km2") / F.lit(math.pi)), F.lit(0.1)).alias("base_r"),
        x("west").alias("bx0"), x("east").alias("bx1"), y("south").alias("by0"), y("north").alias("by1"),
    )
    return steps.join(f, KEYS).withColumn("duration", F.greatest(F.col("cutoff_t") - F.col("start_t"), F.lit(1.0)))


def edges_km(edges: DataFrame, frame: DataFrame) -> DataFrame:
    f = frame.select(*KEYS, "lon0", "lat0", "km_lon")
    x = lambda c: ((F.col(c) - F.col("lon0")) * F.col("km_lon")).alias(c)
    y = lambda c: ((F.col(c) - F.col("lat0")) * F.lit(frames.KM_PER_DEG)).alias(c)
    return edges.join(f, KEYS).select(*KEYS, "part", "ring", "seq", x("x1"), y("y1"), x("x2"), y("y2"))


def local_detections(dets: DataFrame, frame: DataFrame) -> DataFrame:
    """Kept detections in the step frame with relative time ``tau``.

    ``dets``: (fire, step, det_id, t, lat, lon, frp, sensor), already judged at the cutoff.
    """
    f = frame.select(*KEYS, "lon0", "lat0", "km_lon", "start_t", "duration")
    return dets.join(f, KEYS).select(
        *KEYS, "det_id", ((F.col("lon") - F.col("lon0")) * F.col("km_lon")).alias("x"),
        ((F.col("lat") - F.col("lat0")) * F.lit(frames.KM_PER_DEG)).alias("y"),
        "frp", ((F.col("t") - F.col("start_t")) / F.col("duration")).alias("tau"),
        (F.upper("sensor") == "VIIRS").cast("double").alias("viirs"), "sensor", "lon", "lat",
    )


def sites(local: DataFrame) -> DataFrame:
    """Detections at one exact position as one weighted row: a loss-free pre-aggregation.

    Geostationary pixels and repeat passes report the same coordinates again and
    again, so a fire holding much of the table shrinks to its distinct positions.
    """
    rep = F.min(F.struct("det_id", "frp", "tau")).alias("rep")
    return by_shuffle(local.groupBy(*KEYS, "x", "y").agg(
        F.count("*").alias("n"), F.max("frp").alias("frp_max"), F.sum("frp").alias("frp_sum"), F.max("tau").alias("t_max"),
        F.min("tau").alias("t_min"), F.sum("viirs").alias("n_viirs"), rep, F.first("lon").alias("slon"), F.first("lat").alias("slat"),
    ))


def grid_frames(frame: DataFrame, local: DataFrame, grid_km: float = GRID_KM, max_cells: int | None = None) -> DataFrame:
    """Grid origin, spacing and size per step: one spacing ``grid_km`` for all steps of a run.

    With ``max_cells`` the spacing of a step grows by GRID_GROWTH until that many cells hold it; features,
    labels and acreage then depend on the size of the fire, so nothing here asks for it by default.
    """
    ext = local.groupBy(*KEYS).agg(
        F.min("x").alias("dx0"), F.max("x").alias("dx1"), F.min("y").alias("dy0"), F.max("y").alias("dy1"), F.count("*").alias("n_dets")
    )
    g = frame.join(ext, KEYS).withColumns(
        {
            "x0": F.least("bx0", "dx0") - MARGIN_KM, "x1": F.greatest("bx1", "dx1") + MARGIN_KM,
            "y0": F.least("by0", "dy0") - MARGIN_KM, "y1": F.greatest("by1", "dy1") + MARGIN_KM,
        }
    )
    count = lambda lo, hi, s: F.greatest(frames.truncate((F.col(hi) - F.col(lo)) / s), F.lit(1).cast("bigint"))
    spacing = F.lit(float(grid_km))
    if max_cells is not None:
        grow = lambda s, _i: F.when(count("x0", "x1", s) * count("y0", "y1", s) > max_cells, s * F.lit(GRID_GROWTH)).otherwise(s)
        spacing = F.aggregate(F.sequence(F.lit(1), F.lit(64)), spacing, grow)
    g = g.withColumn("grid_km", spacing)
    return g.withColumns({"nx": count("x0", "x1", F.col("grid_km")), "ny": count("y0", "y1", F.col("grid_km"))}).drop("dx0", "dx1", "dy0", "dy1")


def lattice(grid: DataFrame) -> DataFrame:
    """Every grid cell centre, row by row."""
    rows = grid.select(*KEYS, "x0", "y0", "grid_km", "nx", F.explode(F.sequence(F.lit(0), (F.col("ny") - 1).cast("int"))).alias("iy"))
    return placed_cells(rows.select(*KEYS, "x0", "y0", "grid_km", "iy", F.explode(F.sequence(F.lit(0), (F.col("nx") - 1).cast("int"))).alias("ix")))


def placed_cells(rows: DataFrame) -> DataFrame:
    """Cells with their centres, from (ix, iy) beside the grid's origin and spacing."""
    return by_shuffle(rows).select(
        *CELL, (F.col("x0") + (F.col("ix") + F.lit(0.5)) * F.col("grid_km")).alias("x"),
        (F.col("y0") + (F.col("iy") + F.lit(0.5)) * F.col("grid_km")).alias("y"),
    )


def prediction_cells(grid: DataFrame, base_km: DataFrame) -> DataFrame:
    """Cells outside the base; steps with fewer than ten have no grid (persistence).

    The base's cells are listed from its own bounds and taken out of grid grid rows, so the
    lattice is laid out last and joins nothing.
    """
    inside = base_cells(base_km, grid, 1).groupBy(*KEYS, F.col("iy").cast("int").alias("iy")).agg(F.collect_set(F.col("ix").cast("int")).alias("__in"))
    rows = grid.select(*KEYS, "x0", "y0", "grid_km", "nx", F.explode(F.sequence(F.lit(0), (F.col("ny") - 1).cast("int"))).alias("iy"))
    every = F.sequence(F.lit(0), (F.col("nx") - 1).cast("int"))
    rows = by_shuffle(rows).join(inside, [*KEYS, "iy"], "left").withColumn("__out", F.array_except(every, F.coalesce("__in", F.array().cast("array<int>"))))
    enough = rows.groupBy(*KEYS).agg(F.sum(F.size("__out")).alias("__n")).where(F.col("__n") >= MIN_CELLS).select(*KEYS)
    cells = by_shuffle(rows).join(enough, KEYS, "left_semi").select(*KEYS, "x0", "y0", "grid_km", "iy", F.explode("__out").alias("ix"))
    return placed_cells(cells)


#: Cells and sites of a step that one task takes whole; steps with more are met tile by tile, as joins.
STEP_CELLS, STEP_SITES, STEP_EDGES = 200_000, 10_000, 10_000
#: Pairs of one matrix of distances, and cells of one batch of results.
PAIRS, BATCH_CELLS = 1 << 17, 16_384
RINGS = sorted({float(r) for r in COUNT_RADII} | {r for _, r in TURN_RADII})
RADIUS_COLS = [f"{c}{r}" for r in COUNT_RADII for c in ("n", "frpmax", "frpsum", "tmax", "viirs")] + [n for n, _ in TURN_RADII] + ["t_first2"]
NEAR_COLS = {"d_near": "double", "q_id": None, "qx": "double", "qy": "double", "frp_near": "double", "t_near": "double", "slon": "double", "slat": "double"}
SITE_COLS = ["n", "frp_max", "frp_sum", "t_max", "t_min", "n_viirs"]


def radius_features(cells: DataFrame, site: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Counts, heat, time and surroundedness round each cell (all, or the ``wanted`` columns)."""
    return by_shuffle(cell_features(cells, site, ["radius"], wanted).drop("x", "y"))


def nearest_site(cells: DataFrame, site: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Nearest detection of each cell (ties to the smallest id), at any distance."""
    return by_shuffle(cell_features(cells, site, ["nearest"], wanted).drop("x", "y"))


def cell_features(cells: DataFrame, site: DataFrame, parts: list[str], wanted: list[str] | None = None, base: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """CELL, x, y and the columns of :func:`radius_features` ("radius") and :func:`nearest_site` ("nearest"), or ``wanted`` of them.

    ``base``, the outline's edges, facts per step and reach per (step, bin), adds d_edge and, for the nearest site, d_edge_q,
    the facts and ``push``.

    A step's cells and sites meet in one task, as packed lists, and every pair of them is a number in a matrix there:
    no pair, ring or cell is shuffled for it. Steps with more cells or sites than a task should take, and those with
    values that are no numbers, go through tile joins. With "nearest", cells of steps without sites have no row.
    """
    cols = [*(RADIUS_COLS if "radius" in parts else []), *(NEAR_COLS if "nearest" in parts else [])]
    cols = [c for c in cols if wanted is None or c in wanted]
    cells = cells.select(*CELL, "x", "y")
    odd = [F.col(c).isNull() for c in (*CELL, "x", "y")] + [F.isnan(c) | (F.abs(c) == math.inf) for c in ("x", "y")]
    strange = [F.isnan(c) | (F.abs(c) == math.inf) for c in ("x", "y", *[c for c, t in site.dtypes if c in SITE_COLS and t == "double"])]
    large = lambda df, bad, most: df.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max(F.coalesce(bad, F.lit(False))).alias("bad")).where((F.col("n") > most) | F.col("bad")).select(*KEYS)
    any_of = lambda flags: F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags])
    apart = large(cells, any_of(odd), STEP_CELLS).unionByName(large(site, any_of(strange), STEP_SITES))
    if base is not None:
        cols = [*cols, "d_edge", "d_edge_q", "push", *[c for c in base[1].columns if c not in KEYS]]
        crooked = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == math.inf) for c in ("x1", "y1", "x2", "y2")]
        apart = apart.unionByName(large(base[0], any_of(crooked), STEP_EDGES))
    apart = cut_lineage(apart.distinct().withColumnsRenamed({k: f"__{k}" for k in KEYS}))
    out = None
    if not apart.isEmpty():  # a short list: each of its steps has many rows
        of = lambda df, how: df.join(F.broadcast(apart), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS], how)
        out = tiled_features(of(cells, "left_semi"), of(site, "left_semi"), parts, base).select(*CELL, "x", "y", *cols)
        cells, site = of(cells, "left_anti"), of(site, "left_anti")
    whole = step_features(cells, site, parts, cols, base)
    return whole if out is None else whole.unionByName(out)


def tiled_features(cells: DataFrame, site: DataFrame, parts: list[str], base: tuple | None = None) -> DataFrame:
    cells, site = cut_lineage(cells), cut_lineage(site)
    out = by_shuffle(cells)
    if base is not None:
        edges, facts, reach = base
        edge_block = F.floor(F.col("seq") / 32)
        # Each search is written by a job of its own, so that the driver never plans and reports all of them as one query.
        d_cell = cut_lineage(boundary_distance(by_shuffle(cells), edges, KEYS, ["ix", "iy"], edge_block))
        site_pts = by_shuffle(site).select(*KEYS, F.col("rep.det_id").alias("q_id"), "x", "y")
        d_site = cut_lineage(boundary_distance(site_pts, edges, KEYS, ["q_id"], edge_block).withColumnRenamed("d_edge", "d_edge_q"))
        # Facts per step and per direction grow with the input too: they meet the cells by shuffle, while a cell has four columns.
        out = by_shuffle(out.join(facts, KEYS).withColumn("bin", angle_bin(F.col("x"), F.col("y")))).join(reach, [*KEYS, "bin"], "left")
        out = by_shuffle(out).join(by_shuffle(d_cell), CELL)
    if "radius" in parts:
        out = by_shuffle(out.join(tiled_radius_features(by_shuffle(cells), by_shuffle(site)), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in CELL]).drop(*[f"__{c}" for c in CELL]))
    if "nearest" in parts:
        out = out.join(tiled_nearest_site(cells, by_shuffle(site)), CELL)
    return out if base is None else by_shuffle(out).join(by_shuffle(d_site), [*KEYS, "q_id"])


def step_features(cells: DataFrame, site: DataFrame, parts: list[str], cols: list[str], base: tuple | None = None) -> DataFrame:
    """The same for steps that fit a task: (step, its cells, its sites) as one row each."""
    kinds = dict(cells.dtypes) | {f"q_{c}": t for c, t in site.selectExpr("rep.det_id AS id").dtypes}
    spots = F.struct(
        F.col("rep.det_id").alias("q_id"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("rep.frp").cast("double").alias("frp_near"),
        F.col("rep.tau").alias("t_near"), "slon", "slat", *[F.col(c).cast("double").alias(c) for c in SITE_COLS],
    )
    # Lists without nulls stay aligned; sorted spots settle ties.
    packed = {c: F.col(c) for c in ("ix", "iy", "x", "y")} | ({"bin": angle_bin(F.col("x"), F.col("y"))} if base is not None else {})
    mine = cells.groupBy(*KEYS).agg(*[F.collect_list(v).alias(c) for c, v in packed.items()])
    theirs = site.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*KEYS).agg(F.sort_array(F.collect_list(spots)).alias("spots"))
    both = by_shuffle(mine).join(theirs, KEYS, "left" if parts == ["radius"] else "inner")
    types = {**{c: kinds[c] for c in (*CELL, "x", "y")}, **{c: (NEAR_COLS.get(c, "double") or kinds["q_id"]) for c in cols}}
    fixed = []
    if base is not None:
        edges, facts, reach = base
        fixed = [c for c in facts.columns if c not in KEYS]
        types |= {c: t for c, t in facts.dtypes if c in fixed}
        lists = edges.groupBy(*KEYS).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        bins = reach.groupBy(*KEYS).agg(F.collect_list(F.struct("bin", "push")).alias("reach"))
        both = by_shuffle(both).join(lists, KEYS).join(facts, KEYS).join(bins, KEYS, "left")

    base_given = base is not None

    def features(batches):
        for batch in batches:
            held, n = [], 0
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lists = {c: row.column(c).flatten() for c in ("ix", "iy", "x", "y")}
                spot = row.column("spots").flatten() if not row.column("spots").null_count else None
                x, y = (lists[c].to_numpy(zero_copy_only=False) for c in "xy")
                got, many = features_of(x, y, spot, parts), len(x)
                if base_given:
                    got |= outline_of(x, y, spot, got["__at"], row.column("edges").flatten())
                    push = np.full(ANGLE_BINS, np.nan)
                    known = row.column("reach").flatten()
                    push[known.field("bin").to_numpy(zero_copy_only=False)] = known.field("push").to_numpy(zero_copy_only=False)
                    got["push"] = pa.array(push[row.column("bin").flatten().to_numpy(zero_copy_only=False)], from_pandas=True)
                    got |= {c: pa.repeat(row.column(c)[0], many) for c in fixed}
                own = [pa.repeat(row.column(c)[0], many) for c in KEYS]
                held.append(pa.RecordBatch.from_arrays([*own, *lists.values(), *[got[c] if isinstance(got[c], pa.Array) else pa.array(got[c]) for c in cols]], names=list(types)))
                n += many
                if n >= BATCH_CELLS:
                    yield pa.concat_batches(held)
                    held, n = [], 0
            if held:
                yield pa.concat_batches(held)

    return both.mapInArrow(features, ", ".join(f"{c} {t}" for c, t in types.items()))


def features_of(x, y, spots, parts: list[str]) -> dict:
    """Columns of one step's cells at (x, y) from its sorted sites, an Arrow struct array (or None)."""
    many = 0 if spots is None else len(spots)
    out = {c: np.zeros(len(x)) for c in RADIUS_COLS} | {"t_first2": np.ones(len(x))} if "radius" in parts else {}
    at = np.zeros(len(x), np.int64)
    d_near = np.zeros(len(x))
    if not many:
        return out
    value = lambda c, none: np.where(np.isnan(v := spots.field(c).cast("double").to_numpy(zero_copy_only=False).astype(float)), none, v)
    qx, qy = value("qx", 0.0), value("qy", 0.0)
    if "radius" in parts:
        w, frp_sum, viirs = value("n", 0.0), value("frp_sum", 0.0), value("n_viirs", 0.0)
        frp_max, t_max, t_min = value("frp_max", -np.inf), value("t_max", -np.inf), value("t_min", np.inf)
        far = len(RINGS)
    step = max(1, PAIRS // many)
    for a in range(0, len(x), step):
        cut = slice(a, a + step)
        dx, dy = qx - x[cut, None], qy - y[cut, None]
        d = np.sqrt(dx * dx + dy * dy)
        if "nearest" in parts:
            at[cut] = d.argmin(1)
            d_near[cut] = d[np.arange(len(d)), at[cut]]
        if "radius" not in parts:
            continue
        ring = np.zeros(d.shape, np.int64)
        for r in RINGS:
            ring += d > r
        key = (ring + (np.arange(len(d)) * (far + 1))[:, None]).ravel()
        # Sums per ring, accumulated outward.
        total = lambda v: np.bincount(key, np.broadcast_to(v, d.shape).ravel(), len(d) * (far + 1)).reshape(len(d), far + 1).cumsum(1)
        known = d > 1e-8
        per = w / np.where(known, d, np.inf)
        n, fs, v = total(w), total(frp_sum), total(viirs)
        ux, uy, m = total(per * dx), total(per * dy), total(w * known)
        for r in COUNT_RADII:
            i = RINGS.index(float(r))
            near = ring <= i
            out[f"n{r}"][cut], out[f"frpsum{r}"][cut], out[f"viirs{r}"][cut] = n[:, i], fs[:, i], v[:, i]
            for c, q in (("frpmax", frp_max), ("tmax", t_max)):
                top = np.where(near, q, -np.inf).max(1)
                out[f"{c}{r}"][cut] = np.where(top == -np.inf, 0.0, top)
            if r == 2:
                first = np.where(near, t_min, np.inf).min(1)
                out["t_first2"][cut] = np.where(first == np.inf, 1.0, first)
        for name, r in TURN_RADII:
            i = RINGS.index(float(r))
            turn = 1.0 - np.sqrt(ux[:, i] ** 2 + uy[:, i] ** 2) / np.maximum(m[:, i], 1.0)
            out[name][cut] = np.where(m[:, i] > 0, turn, np.where(n[:, i] > 0, 1.0, 0.0))
    if "nearest" in parts:
        picked = pa.array(at)
        out |= {"__at": at, "d_near": d_near, **{c: spots.field(c).take(picked) for c in NEAR_COLS if c != "d_near"}}
    return out


def outline_of(x, y, spots, at, edges) -> dict:
    """Distance of a step's cells, and of the site ``at`` that is nearest to each, to the closest of ``edges``."""
    x1, y1, x2, y2 = (edges.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy

    def closest(px, py):
        out, step = np.empty(len(px)), max(1, PAIRS // len(x1))
        for a in range(0, len(px), step):
            ex, ey = px[a : a + step, None] - x1, py[a : a + step, None] - y1
            u = np.clip(np.divide(ex * dx + ey * dy, length2, out=np.zeros(ex.shape), where=length2 > 0), 0.0, 1.0)
            ex, ey = px[a : a + step, None] - (x1 + u * dx), py[a : a + step, None] - (y1 + u * dy)
            out[a : a + step] = np.sqrt(ex * ex + ey * ey).min(1)
        return out

    own = closest(*(spots.field(c).to_numpy(zero_copy_only=False) for c in ("qx", "qy")))
    _, who = np.unique(spots.field("q_id").to_numpy(zero_copy_only=False), return_inverse=True)
    least = np.full(len(own), np.inf)
    np.minimum.at(least, who, own)
    return {"d_edge": closest(x, y), "d_edge_q": least[who][at]}


def tiled_radius_features(cells: DataFrame, site: DataFrame) -> DataFrame:
    """Counts, heat, time and surroundedness round each cell (its keys as __fire to __iy), from one join at 8 km.

    Pairs are first reduced per (cell, ring between consecutive radii) map-side, then
    rings are accumulated: a handful of updates per pair instead of one per radius.
    """
    right = site.select(
        *KEYS, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("n").cast("double").alias("w"), "frp_max", "frp_sum", "t_max", "t_min", "n_viirs"
    )
    # Dense tiles are split early: the work is pairs, so 5,000 rows a side already mean 25 million.
    pairs = radius_join(cells.select(*CELL, "x", "y"), right, REACH_KM, KEYS, tile_rows=5_000, many=True)
    rings = sorted({float(r) for r in COUNT_RADII} | {r for _, r in TURN_RADII})
    ring = F.lit(len(rings) - 1)
    for i in range(len(rings) - 2, -1, -1):
        ring = F.when(F.col("d") <= rings[i], F.lit(i)).otherwise(ring)
    apart = F.col("d") > 1e-8
    per_ring = pairs.groupBy(*CELL, ring.alias("ring")).agg(
        F.sum("w").alias("n"), F.max("frp_max").alias("fm"), F.sum("frp_sum").alias("fs"), F.max("t_max").alias("tm"),
        F.min("t_min").alias("tn"), F.sum("n_viirs").alias("v"),
        F.sum(F.when(apart, F.col("w") * (F.col("rx") - F.col("x")) / F.col("d"))).alias("ux"),
        F.sum(F.when(apart, F.col("w") * (F.col("ry") - F.col("y")) / F.col("d"))).alias("uy"),
        F.sum(F.when(apart, F.col("w"))).alias("m"),
    )
    within = lambda r, c: F.when(F.col("ring") <= rings.index(float(r)), F.col(c))
    aggs = []
    for r in COUNT_RADII:
        aggs += [
            F.sum(within(r, "n")).alias(f"n{r}"), F.max(within(r, "fm")).alias(f"frpmax{r}"), F.sum(within(r, "fs")).alias(f"frpsum{r}"),
            F.max(within(r, "tm")).alias(f"tmax{r}"), F.sum(within(r, "v")).alias(f"viirs{r}"),
        ]
    for name, r in TURN_RADII:
        ux, uy, m = F.sum(within(r, "ux")), F.sum(within(r, "uy")), F.sum(within(r, "m"))
        turn = F.when(m > 0, F.lit(1.0) - F.sqrt(ux * ux + uy * uy) / m).when(F.sum(within(r, "n")) > 0, F.lit(1.0))
        aggs.append(turn.alias(name))
    aggs.append(F.min(within(2, "tn")).alias("t_first2"))
    got = per_ring.groupBy(*CELL).agg(*aggs)
    filled = by_shuffle(cells.select(*CELL).distinct()).join(got, CELL, "left")
    zeros = [c for c in got.columns if c not in CELL and c != "t_first2"]
    return by_shuffle(filled.select(*[F.col(c).alias(f"__{c}") for c in CELL], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in zeros], F.coalesce("t_first2", F.lit(1.0)).alias("t_first2")))


def tiled_nearest_site(cells: DataFrame, site: DataFrame) -> DataFrame:
    """Nearest detection of each cell by pruned boxes; a cell listed again has one row."""
    members = site.where("x IS NOT NULL AND y IS NOT NULL").select(
        *KEYS, F.col("rep.det_id").alias("q_id"), F.col("x").alias("qx"), F.col("y").alias("qy"),
        F.col("rep.frp").alias("frp_near"), F.col("rep.tau").alias("t_near"), "slon", "slat",
    )
    block = F.struct(F.floor("qx").alias("bx"), F.floor("qy").alias("by"))
    dx, dy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    out = nearest_pruned(
        by_shuffle(cells), by_shuffle(members), KEYS, ["ix", "iy"], "q_id", block, ("qx", "qy", "qx", "qy"), F.sqrt(dx * dx + dy * dy),
        ["qx", "qy", "frp_near", "t_near", "slon", "slat"],
    )
    return by_shuffle(out.withColumnRenamed("d", "d_near"))


def angle_bin(x: Column, y: Column) -> Column:
    b = F.floor((F.atan2(y, x) + F.lit(math.pi)) / F.lit(2 * math.pi) * ANGLE_BINS)
    return F.pmod(b, F.lit(ANGLE_BINS)).cast("int")


def angular_reach(local: DataFrame, frame: DataFrame) -> DataFrame:
    """P90 detection radius per angle bin, never below the base radius; bins without detections are absent."""
    rel = local.select(*KEYS, F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("r"), angle_bin(F.col("x"), F.col("y")).alias("bin"))
    q = exact_quantiles(rel, [*KEYS, "bin"], "r", {"p90": 0.9}, slots=16)
    return q.join(frame.select(*KEYS, "base_r"), KEYS).select(*KEYS, "bin", F.greatest("base_r", "p90").alias("push"))


def principal_axis(local: DataFrame) -> DataFrame:
    """Leading axis of the detections about the centroid (needs three) and their mean direction."""
    s = local.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.var_samp("x").alias("cxx"), F.var_samp("y").alias("cyy"), F.covar_samp("x", "y").alias("cxy"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"),
    )
    half = F.lit(0.5) * F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy"))
    norm = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")) + F.lit(1e-9)
    return s.select(
        *KEYS, F.when(F.col("n") > 2, F.cos(half)).otherwise(1.0).alias("axis_x"), F.when(F.col("n") > 2, F.sin(half)).otherwise(0.0).alias("axis_y"),
        (F.col("mx") / norm).alias("dir_x"), (F.col("my") / norm).alias("dir_y"),
    )


def fire_constants(grid: DataFrame, local: DataFrame) -> DataFrame:
    q = exact_quantiles(local, KEYS, "frp", {"frp_med": 0.5, "frp_p90": 0.9})
    return grid.join(q, KEYS).select(
        *KEYS, "base_r", F.log1p(F.greatest(F.col("area_km2") * KM2_TO_ACRES, F.lit(0.0))).alias("log_base"),
        F.log1p(F.col("duration") / 3600.0).alias("log_win"), F.log1p(F.col("n_dets").cast("double")).alias("log_ndet"),
        "frp_med", "frp_p90", "grid_km",
    )


def field_features(frame: DataFrame, local: DataFrame, base_km: DataFrame, grid: DataFrame, dem: DataFrame | None = None) -> DataFrame:
    """The 55 features per prediction cell, in model order.

    ``dem``, when given, maps (fire, step, ix, iy) to elev, slope_deg and base_elev and
    (fire, step, q_id) to det_elev through :func:`elevation_features`; without it terrain is zero.
    """
    # Both feed several joins: write them once instead of deriving them per join.
    site = by_shuffle(cut_lineage(sites(local)))
    cells = by_shuffle(cut_lineage(prediction_cells(grid, base_km)))
    facts = cut_lineage(by_shuffle(fire_constants(grid, local)).join(principal_axis(local), KEYS))
    reach = cut_lineage(angular_reach(local, frame))
    rows = cell_features(cells, site, ["radius", "nearest"], base=(base_km, facts, reach))
    tx, ty = -F.col("qx"), -F.col("qy")
    ox, oy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    tn, on = F.sqrt(tx * tx + ty * ty) + F.lit(1e-9), F.sqrt(ox * ox + oy * oy) + F.lit(1e-9)
    dot = ox * tx + oy * ty
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    push = F.coalesce("push", "base_r")
    med = F.greatest(F.col("frp_med"), F.lit(1e-6))
    zero = F.lit(0.0)
    rows = rows.withColumns(
        {
            "d_edge_rel": F.col("d_edge") / F.col("base_r"), "d_near_rel": F.col("d_near") / F.col("base_r"),
            "d_edge_minus_det": F.col("d_edge") - F.col("d_edge_q"), "toward_base": dot / tn, "toward_base_norm": dot / (tn * on),
            "push_here": push, "push_rel": push / F.col("base_r"), "in_champ": (r <= push).cast("double"),
            "aniso_axis": F.abs((F.col("x") * F.col("axis_x") + F.col("y") * F.col("axis_y")) / (r + F.lit(1e-9))),
            "aniso_centroid": (F.col("x") * F.col("dir_x") + F.col("y") * F.col("dir_y")) / (r + F.lit(1e-9)),
            "dens_r12": F.col("n1") / (F.col("n2") + 1.0), "dens_r25": F.col("n2") / (F.col("n5") + 1.0),
            "t_first_near": F.col("t_near"), "frp_near_rel": F.col("frp_near") / med, "frpmax2_rel": F.col("frpmax2") / med,
            "elev_rel": zero, "slope_deg": zero, "elev_minus_det": zero,
        }
    )
    if dem is not None:
        rows = elevation_features(rows.drop("elev_rel", "slope_deg", "elev_minus_det"), frame, dem)
    return rows.select(*CELL, "x", "y", *FEATURES)


def elevation_features(rows: DataFrame, frame: DataFrame, dem: DataFrame, cell_deg: float = 0.01) -> DataFrame:
    """Terrain relative to the base centre and to the nearest detection; zero off the raster.

    ``dem``: (gx, gy, elev, slope_deg) on a ``cell_deg`` lattice of floor(lon/lat).
    """
    f = frame.select(*KEYS, "lon0", "lat0", "km_lon")
    g = lambda c: F.floor(c / F.lit(cell_deg))
    pts = rows.join(f, KEYS).withColumns(
        {
            "c_gx": g(F.col("lon0") + F.col("x") / F.col("km_lon")), "c_gy": g(F.col("lat0") + F.col("y") / F.lit(frames.KM_PER_DEG)),
            "q_gx": g(F.col("slon")), "q_gy": g(F.col("slat")), "b_gx": g(F.col("lon0")), "b_gy": g(F.col("lat0")),
        }
    )
    for p, cols in (("c", ["elev", "slope_deg"]), ("q", ["elev"]), ("b", ["elev"])):
        side = dem.select(F.col("gx").alias(f"{p}_gx"), F.col("gy").alias(f"{p}_gy"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
        pts = pts.join(side, [f"{p}_gx", f"{p}_gy"], "left")
    e = lambda c: F.coalesce(c, F.lit(0.0))
    return pts.withColumns(
        {"elev_rel": e("c_elev") - e("b_elev"), "slope_deg": e("c_slope_deg"), "elev_minus_det": e("c_elev") - e("q_elev")}
    )


def label_cells(cells: DataFrame, target_km: DataFrame) -> DataFrame:
    """Training label: is the cell centre inside the observed later perimeter."""
    # Cells share a key with few edges: only those in the target's bounds meet its outline.
    bounds = target_km.groupBy(*KEYS).agg(
        F.min(F.least("x1", "x2")).alias("__x0"), F.max(F.greatest("x1", "x2")).alias("__x1"), F.min(F.least("y1", "y2")).alias("__y0"), F.max(F.greatest("y1", "y2")).alias("__y1")
    )
    near = by_shuffle(cells.select(*CELL, "x", "y")).join(bounds, KEYS).where("x BETWEEN __x0 AND __x1 AND y BETWEEN __y0 AND __y1").select(*CELL, "x", "y")
    inside = points_inside(near, target_km, KEYS, ["ix", "iy"], GRID_KM, balance=False).withColumn("label", F.lit(1))
    return by_shuffle(cells).join(inside, CELL, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def negative_sample(labelled: DataFrame, ratio: float = NEGATIVE_RATIO, floor: int = NEGATIVE_FLOOR, seed: int = 0) -> DataFrame:
    """All positives and a seeded share of negatives per step, those of the smallest hash."""
    key = F.xxhash64(*[F.col(c) for c in CELL], F.lit(seed))
    wanted = labelled.groupBy(*KEYS).agg(F.greatest(frames.truncate(F.sum("label") * F.lit(ratio)), F.lit(floor).cast("bigint")).alias("__take"))
    negative = first_of_steps(labelled.where("label <> 1"), F.shiftright(key, 58), [key, F.col("iy"), F.col("ix")], wanted)
    return labelled.where("label = 1").unionByName(negative)


def cohort_balance(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of negatives kept by the sampling, over the whole cohort."""
    neg = (F.lit(1) - F.col("label")).cast("bigint")
    none = F.lit(0).cast("bigint")
    rows = labelled.select(neg.alias("a"), none.alias("k")).unionAll(kept.select(none.alias("a"), neg.alias("k")))
    both = rows.agg(F.sum("a").alias("all_negative"), F.sum("k").alias("kept_negative"))
    return both.withColumn("retained", F.col("kept_negative") / F.greatest("all_negative", F.lit(1)))


def prior_corrected(p: Column, retained: Column) -> Column:
    q = frames.clip(p, 1e-9, 1 - 1e-9)
    r = F.greatest(retained, F.lit(1e-9))
    return q * r / (q * r + F.lit(1.0) - q)


def fit_field(kept: DataFrame, holdout_fire: int | None = None, **overrides):
    """Gradient-boosted trees on sampled cells; a held-out fire is excluded whole."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from emberline.session import ensure_checkpoint_dir

    rows = kept if holdout_fire is None else kept.where(F.col("fire") != F.lit(holdout_fire))
    classes = rows.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
    if classes["n"] == 0:
        raise ValueError("training set is empty")
    if classes["k"] != 2:
        raise ValueError("training needs both classes")
    ensure_checkpoint_dir(kept.sparkSession)
    gbt = GBTClassifier(labelCol="label", featuresCol="features", checkpointInterval=10, **{**MODEL_SETTINGS, **overrides})
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), gbt]).fit(rows.select(*FEATURES, "label"))


def predict_field(model, features: DataFrame, retained: float) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features)
    return scored.select(*CELL, "x", "y", prior_corrected(vector_to_array("probability")[1], F.lit(float(retained))).alias("p"))


def lofo_evaluate(labelled: DataFrame, kept: DataFrame, fires: list[int], **overrides) -> DataFrame:
    """One model per held-out fire, scored on that fire: growth IoU of its top-mass cells.

    The loop runs one distributed fit per fire named by the caller.
    """
    out = None
    for fire in fires:
        train, full = kept.where(F.col("fire") != fire), labelled.where(F.col("fire") != fire)
        r = cohort_balance(full, train).first()["retained"]
        model = fit_field(train, **overrides)
        mine = labelled.where(F.col("fire") == fire)
        taken = topk_mass(predict_field(model, mine, r)).select(*CELL, F.lit(1).alias("taken"))
        rows = mine.select(*CELL, "label").join(taken, CELL, "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        hit, any_ = F.sum(F.col("label") * F.col("taken")), F.sum(F.greatest("label", "taken"))
        m = rows.groupBy(*KEYS).agg(F.when(any_ > 0, hit / any_).otherwise(0.0).alias("growth_iou"), F.sum("label").alias("n_pos"), F.sum("taken").alias("n_taken"))
        out = m if out is None else out.unionByName(m)
    return out


def rule_score(n2: Column, n5: Column, d_near: Column) -> Column:
    """Stand-in probability used where no trained model is wanted."""
    return F.round(n2 / (n5 + F.lit(1.0)) * F.exp(-d_near), 9)


def topk_mass(scored: DataFrame, k: float = 1.0, slots: int = 64) -> DataFrame:
    """The floor(k * sum p) most likely cells of each step; ties go to the smaller (iy, ix)."""
    wanted = scored.groupBy(*KEYS).agg(F.least(F.greatest(frames.truncate(F.sum("p") * F.lit(float(k))), F.lit(0).cast("bigint")), F.count("*")).alias("__take"))
    slot = F.lit(0) - F.least(F.greatest(F.floor(F.col("p") * slots), F.lit(0)), F.lit(slots - 1))
    return first_of_steps(scored, slot, [F.desc("p"), F.col("iy"), F.col("ix")], wanted)


def first_of_steps(rows: DataFrame, slot: Column, order: list, wanted: DataFrame, shares: int = 32) -> DataFrame:
    """The first ``__take`` rows of each step in ``order``, without sorting a step in one task.

    ``slot`` ascends with the order. Counts per slot tell in which one a step's last row lies: slots before
    it are taken whole, and only its own rows are ranked, first within shares of a step, then those that
    may be taken.
    """
    tagged = by_shuffle(rows).withColumn("__s", slot)
    before = Window.partitionBy(*KEYS).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    depth = tagged.groupBy(*KEYS, "__s").agg(F.count("*").alias("n")).join(wanted, KEYS)
    quota = depth.withColumn("__q", F.col("__take") - F.coalesce(F.sum("n").over(before), F.lit(0))).where("__q > 0")
    taken = tagged.join(quota.select(*KEYS, "__s", "__q", (F.col("n") <= F.col("__q")).alias("__all")), [*KEYS, "__s"])
    edge = taken.where("NOT __all")
    share = F.pmod(F.xxhash64("ix", "iy"), F.lit(shares))
    for part in ([*KEYS, share], KEYS):
        edge = edge.withColumn("__r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("__r") <= F.col("__q"))
    return taken.where("__all").unionByName(edge.drop("__r")).select(*rows.columns)


def base_cells(base_km: DataFrame, grid: DataFrame, n: int) -> DataFrame:
    """The base perimeter on the grid's n-fold sub-lattice (cell centres inside)."""
    g = grid.select(*KEYS, "x0", "y0", (F.col("grid_km") / n).alias("s"), "bx0", "bx1", "by0", "by1")
    idx = lambda v, o: F.floor((F.col(v) - F.col(o)) / F.col("s"))
    rows = g.select(*KEYS, "x0", "y0", "s", idx("bx0", "x0").alias("i0"), idx("bx1", "x0").alias("i1"), F.explode(F.sequence(idx("by0", "y0"), idx("by1", "y0"))).alias("iy"))
    pts = rows.select(*KEYS, "x0", "y0", "s", "iy", F.explode(F.sequence(F.col("i0"), F.col("i1"))).alias("ix")).select(
        *CELL, (F.col("x0") + (F.col("ix") + F.lit(0.5)) * F.col("s")).alias("x"), (F.col("y0") + (F.col("iy") + F.lit(0.5)) * F.col("s")).alias("y")
    )
    return points_inside(pts, base_km, KEYS, ["ix", "iy"], GRID_KM / n, balance=False).select(*CELL)


def drop_cells(drops: DataFrame, grid: DataFrame, sub: float, width_km: float = 0.3) -> DataFrame:
    """Sub-cells whose centre lies within ``width_km`` of a drop leg (x1, y1, x2, y2), point to segment."""
    legs = drops.join(grid.select(*KEYS, "x0", "y0"), KEYS)
    idx = lambda v, o: F.floor((v - F.col(o)) / sub)
    rows = legs.withColumn("iy", F.explode(F.sequence(idx(F.least("y1", "y2") - width_km, "y0"), idx(F.greatest("y1", "y2") + width_km, "y0"))))
    rows = rows.withColumn("y", F.col("y0") + (F.col("iy") + F.lit(0.5)) * sub)
    # Within one grid row the buffer spans no more than the part of the leg whose y is near, widened.
    dy = F.col("y2") - F.col("y1")
    at = lambda y: F.when(F.abs(dy) < 1e-12, F.lit(None)).otherwise(frames.clip((y - F.col("y1")) / dy, 0.0, 1.0))
    ua, ub = F.coalesce(at(F.col("y") - width_km), F.lit(0.0)), F.coalesce(at(F.col("y") + width_km), F.lit(1.0))
    xa, xb = F.col("x1") + ua * (F.col("x2") - F.col("x1")), F.col("x1") + ub * (F.col("x2") - F.col("x1"))
    cols = rows.withColumn("ix", F.explode(F.sequence(idx(F.least(xa, xb) - width_km, "x0"), idx(F.greatest(xa, xb) + width_km, "x0"))))
    cols = cols.withColumn("x", F.col("x0") + (F.col("ix") + F.lit(0.5)) * sub)
    near = frames.segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) <= width_km
    return cols.where(near).select(*CELL).distinct()


def predict_perimeter(scored: DataFrame, base_km: DataFrame, grid: DataFrame, local: DataFrame, k: float = 1.0, n: int = 5,
                      grid_km: float = GRID_KM, drops: DataFrame | None = None) -> DataFrame:
    """Final perimeter as sub-cells: top mass, closed, joined with the base, strays dropped, smoothed.

    All steps of a run share the spacing ``grid_km``, so buffers in cells have one size. Sub-cells are
    grid_km / n wide (50 m at 0.25 km), fine enough for the 0.2 km close and the 0.35 km smooth to act.
    A step without scored cells is persistence: its base comes back untouched. ``drops`` are drop legs in
    the step's frame (fire, step, x1, y1, x2, y2): their 300 m buffers join the perimeter where they lie
    within 0.6 km of it.
    """
    sub = grid_km / n
    top = C.subdivide(topk_mass(scored, k).select(*CELL), KEYS, n)
    grown = C.close(top, KEYS, 0.2 / sub)
    base = cut_lineage(base_cells(base_km, grid, n))
    whole = cut_lineage(C.union(grown, base, KEYS))
    parts = C.components(whole, KEYS)
    placed = local.join(grid.select(*KEYS, "x0", "y0"), KEYS).select(
        *KEYS, F.floor((F.col("x") - F.col("x0")) / sub).alias("ix"), F.floor((F.col("y") - F.col("y0")) / sub).alias("iy"),
        "sensor",
    )
    kept = C.drop_stray(parts, base, placed, KEYS, 0.5 / sub)
    out = C.smooth(cut_lineage(kept.select(*CELL)), KEYS, 0.35 / sub)
    still = base.join(scored.select(*KEYS).distinct(), KEYS, "left_anti")
    out = out.join(scored.select(*KEYS).distinct(), KEYS, "left_semi").unionByName(still.select(*CELL))
    if drops is None:
        return out
    out = cut_lineage(out)
    near = C.dilate(out, KEYS, 0.6 / sub)
    return C.union(out, C.intersect(drop_cells(drops, grid, sub), near, KEYS), KEYS)


def predict_run(perim: DataFrame, scored: DataFrame, grid: DataFrame, local: DataFrame, sub_km: float, drops: DataFrame | None = None) -> DataFrame:
    """One summary row per step of a cycle: acres with their interval, detections by kind, drop paths, mode.

    ``perim`` are the sub-cells of ``predict_perimeter``; a step without scored cells is persistence, keeps
    the mapped area and has no interval.
    """
    from emberline.operators.health import conformal_interval

    learned = scored.select(*KEYS).distinct().withColumn("learned", F.lit(True))
    acres = perim.groupBy(*KEYS).agg((F.count("*") * F.lit((sub_km * 1000.0) ** 2 / frames.M2_PER_ACRE)).alias("cell_acres"))
    seen = local.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("viirs").cast("bigint").alias("n_viirs"))
    rows = grid.select(*KEYS, (F.col("area_km2") * F.lit(1e6 / frames.M2_PER_ACRE)).alias("base_acres"))
    rows = rows.join(acres, KEYS, "left").join(seen, KEYS, "left").join(learned, KEYS, "left")
    flown = drops.groupBy(*KEYS).agg(F.count("*").alias("legs")) if drops is not None else rows.select(*KEYS, F.lit(0).alias("legs"))
    rows = rows.join(flown, KEYS, "left")
    mode = F.when(F.col("learned"), "learned_field").otherwise("persistence")
    out = rows.select(
        *KEYS, "base_acres", F.when(F.col("learned"), F.coalesce("cell_acres", "base_acres")).otherwise(F.col("base_acres")).alias("pred_acres"),
        F.coalesce("n", F.lit(0)).alias("n_dets"), F.coalesce("n_viirs", F.lit(0)).alias("n_viirs"), F.coalesce("legs", F.lit(0)).cast("bigint").alias("n_drop_legs"), mode.alias("mode"),
    )
    return conformal_interval(out)
