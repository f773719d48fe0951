"""Mapped perimeters: normalising, choosing, history, fusion and growth."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import frames
from emberline.functions.ordered import previous_row, top_n
from emberline.operators.spatial import geo_radius_join, radius_join, tile_shares
from emberline.session import cut_lineage

MAX_ACTIVE_CONTAINED_PCT = 90


def adaptive_bbox(perims: DataFrame) -> DataFrame:
    """Pad (west..north) by 1.5 equivalent diameters, between 0.08 and 0.6 degrees."""
    m2 = F.greatest("acres", F.lit(1.0)) * F.lit(frames.M2_PER_ACRE)
    diameter_km = F.lit(2.0) * F.sqrt(m2 / F.lit(math.pi)) / F.lit(1000.0)
    pad = frames.clip(diameter_km / F.lit(frames.QUICK_KM_PER_DEG) * F.lit(1.5), 0.08, 0.6)
    return perims.withColumn("pad", pad).withColumns(
        {
            "west": F.col("west") - F.col("pad"),
            "south": F.col("south") - F.col("pad"),
            "east": F.col("east") + F.col("pad"),
            "north": F.col("north") + F.col("pad"),
        }
    )


def edges_bbox(edges: DataFrame, keys: list[str], pad: float = 0.05) -> DataFrame:
    return edges.groupBy(*keys).agg(
        (F.min(F.least("x1", "x2")) - pad).alias("west"),
        (F.min(F.least("y1", "y2")) - pad).alias("south"),
        (F.max(F.greatest("x1", "x2")) + pad).alias("east"),
        (F.max(F.greatest("y1", "y2")) + pad).alias("north"),
    )


def vertex_centroid(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of ring vertices; not the area centroid."""
    return edges.groupBy(*keys).agg(F.avg("x1").alias("clon"), F.avg("y1").alias("clat"))


def area_acres(edges: DataFrame, keys: list[str], lat0: str = "lat0", lon0: str = "lon0") -> DataFrame:
    """Shoelace area in the local metre frame of (lat0, lon0), which rides on each edge."""
    mx = F.lit(frames.M_PER_DEG) * F.cos(F.radians(lat0))
    x = lambda c: (F.col(c) - F.col(lon0)) * mx
    y = lambda c: (F.col(c) - F.col(lat0)) * F.lit(frames.M_PER_DEG)
    ring = edges.groupBy(*keys, "part", "ring").agg(F.sum(x("x1") * y("y2") - x("x2") * y("y1")).alias("s"))
    signed = F.when(F.col("ring") == 0, F.abs("s")).otherwise(-F.abs("s")) / 2
    return ring.groupBy(*keys).agg((F.sum(signed) / F.lit(frames.M2_PER_ACRE)).alias("acres"))


def is_active() -> Column:
    return ~F.col("ended") & (F.col("pct_contained").isNull() | (F.col("pct_contained") < MAX_ACTIVE_CONTAINED_PCT))


def active_fires(fires: DataFrame, min_acres: float = 500, n: int = 20, include_contained: bool = False) -> DataFrame:
    """Largest current fires. The limit is the feature; it runs as a distributed top-n."""
    rows = fires.where(F.col("acres") > min_acres)
    if not include_contained:
        rows = rows.where(is_active())
    return rows.orderBy(F.desc("acres"), "perim_id").limit(n)


def find_fire(fires: DataFrame, name: str) -> DataFrame:
    hit = fires.where(F.upper("name").contains(name.upper()))
    return hit.orderBy(F.desc_nulls_last("acres"), "name").limit(1)


def containment_status(perims: DataFrame, boxes: DataFrame, pad: float = 0.06) -> DataFrame:
    """Containment of the largest perimeter meeting each point's padded box.

    Boxes are listed under the lattice tiles they touch; tiles are wider than a box, and dense ones are cut into
    shares. A share's perimeters are tried from the largest down until each point has met one, so a point
    leaves a share with one row and no row per pair is made or sorted.
    """
    tile = 4 * pad
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / tile), F.floor(hi / tile)))
    # NaN is largest in a Spark order, after the numbers in Arrow's.
    order = ["__an", "acres", "n", "__pn", "pct_contained", "ended"]
    sides = ["west", "east", "south", "north"]
    a = perims.select(*sides, F.isnan("acres").alias("__an"), "acres", (-F.col("perim_id")).alias("n"), F.isnan("pct_contained").alias("__pn"), "pct_contained", F.col("ended").cast("int").alias("ended"))
    a = a.withColumns({c: F.col(c).cast("int") for c in ("__an", "__pn")})
    a = a.withColumn("__ti", span(F.col("west"), F.col("east"))).withColumn("__tj", span(F.col("south"), F.col("north")))
    b = boxes.where("fire IS NOT NULL").select("fire", (F.col("lon") - pad).alias("pw"), (F.col("lon") + pad).alias("pe"), (F.col("lat") - pad).alias("ps"), (F.col("lat") + pad).alias("pn"))
    b = b.withColumn("__ti", span(F.col("pw"), F.col("pe"))).withColumn("__tj", span(F.col("ps"), F.col("pn")))
    lefts, rights = tile_shares(b, a, ["__ti", "__tj"], 1 << 14, 1 << 17)

    def largest(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.take(pc.sort_indices(theirs, sort_keys=[(c, "descending") for c in order], null_placement="at_end"))
        west, east, south, north = (theirs[c].to_numpy() for c in sides)
        pw, pe, ps, pn = (mine[c].to_numpy()[:, None] for c in ("pw", "pe", "ps", "pn"))
        pick = np.full(len(pw), -1)
        at, size = 0, 256
        while at < len(west) and (open_ := np.nonzero(pick < 0)[0]).size:
            to = at + size
            for k in range(0, len(open_), step := max(1, (1 << 21) // size)):
                p = open_[k : k + step]
                hit = (west[at:to] <= pe[p]) & (east[at:to] >= pw[p]) & (south[at:to] <= pn[p]) & (north[at:to] >= ps[p])
                first = hit.argmax(1)
                pick[p] = np.where(hit[np.arange(len(p)), first], first + at, -1)
            at, size = to, min(2 * size, 1 << 14)
        met = np.nonzero(pick >= 0)[0]
        left, right = mine.select(["fire"]).take(pa.array(met)), theirs.select(kept).take(pa.array(pick[met]))
        return pa.Table.from_arrays([*left.columns, *right.columns], names=["fire", *kept])

    kept = ["acres", "n", "pct_contained", "ended"]
    kinds = dict(lefts.dtypes) | dict(rights.dtypes)
    by = ["__ti", "__tj", "__i", "__j"]
    per_share = lefts.groupBy(*by).cogroup(rights.groupBy(*by)).applyInArrow(largest, ", ".join(f"{c} {kinds[c]}" for c in ("fire", *kept)))
    found = per_share.groupBy("fire").agg(F.max(F.struct(*kept)).alias("b"))
    return boxes.select("fire").distinct().join(found, "fire", "left").select(
        "fire", F.col("b.pct_contained").alias("pct_contained"), F.col("b.ended").cast("boolean").alias("ended")
    )


def unchanged_snapshot_filter(perims: DataFrame, slot: Column) -> DataFrame:
    """Drop snapshots whose acreage, rounded to tens (half even), repeats the previous row's."""
    rows = perims.withColumn("bucket", F.bround(F.coalesce("acres", F.lit(0.0)) / 10, 0) * 10)
    rows = previous_row(rows, ["fire"], ["t", "perim_id"], ["bucket"], slot)
    return rows.where(F.col("prev_bucket").isNull() | (F.col("bucket") != F.col("prev_bucket"))).drop("prev_bucket")


def perimeter_growth_series(perims: DataFrame, slot: Column) -> DataFrame:
    rows = previous_row(perims, ["fire"], ["t", "perim_id"], ["acres"], slot)
    return rows.withColumn("delta_acres", F.col("acres") - F.col("prev_acres")).drop("prev_acres")


def clean_name(name: str) -> str:
    return name.upper().replace(" FIRE", "").strip()


def largest_matching_fire(perims: DataFrame, name: str, year: int | None = None, state: str | None = None) -> DataFrame:
    """Largest perimeter matching a fire name, with the acreage floor for well-known fires."""
    major = not year or year <= 2015 or "FIRE" in name.upper() or "COMPLEX" in name.upper()
    floor = 100 if major else 10
    rows = perims.where(F.col("name").contains(clean_name(name)) & (F.col("acres").isNull() | (F.col("acres") >= floor)))
    if state:
        rows = rows.where(F.col("state").contains(state.upper()))
    if year:
        rows = rows.where((F.year("t_current") == year) | (F.year("t_discovery") == year))
    return rows.orderBy(F.desc_nulls_last("acres"), "perim_id").limit(1)


def perimeter_timestamp(df: DataFrame, columns: list[str]) -> DataFrame:
    """First of ``columns`` holding a plausible epoch-millisecond value."""
    first = F.coalesce(*[F.when(F.col(c) > F.lit(1e11), F.col(c)) for c in columns])
    return df.withColumn("t_map", F.timestamp_millis(first.cast("bigint")))


def mission_name(df: DataFrame) -> DataFrame:
    """Display name: the incident, else the third token of the mission code, else 'Unnamed'."""
    parts = F.split("mission", "-")
    token = F.when(F.size(parts) >= 3, F.element_at(parts, 3)).otherwise(F.col("mission"))
    title = F.initcap(F.trim(token))
    pick = lambda c: F.when(F.length(c) > 0, c)
    return df.withColumn("name", F.trim(F.coalesce(pick(F.col("incident_name")), pick(title), F.lit("Unnamed"))))


def normalize_fire_name(df: DataFrame, name: str = "name", year: str = "year") -> DataFrame:
    upper = F.trim(F.upper(F.col(name)))
    norm = F.regexp_replace(upper, r"\s+(FIRE|COMPLEX|INCIDENT)\s*$", "")
    suffix = F.coalesce(F.col(year).cast("string"), F.lit("X"))
    return df.withColumns({"slug": F.concat_ws("_", upper, suffix), "norm_slug": F.concat_ws("_", norm, suffix)})


def perimeter_fusion(primary: DataFrame, secondary: DataFrame, km: float = 3.0) -> DataFrame:
    """All primary rows plus secondary rows no primary centroid covers (distance < km).

    Rows carry (perim_id, acres, clat, clon). A secondary row without a centroid stays.
    """
    a = secondary.where(F.col("clat").isNotNull()).select(F.col("perim_id"), F.col("clat").alias("lat"), F.col("clon").alias("lon"))
    b = primary.where(F.col("clat").isNotNull()).select(F.col("clat").alias("rlat"), F.col("clon").alias("rlon")).distinct()
    d = frames.quick_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    covered = geo_radius_join(a, b, km, d, inclusive=False).select("perim_id").distinct()
    kept = secondary.join(covered, "perim_id", "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(kept.withColumn("origin", F.lit("secondary")))


def cluster_dedup(perims: DataFrame, km: float = 2.0, max_rounds: int = 500) -> DataFrame:
    """Newest-first thinning: a row stays unless it is within ``km`` of a newer kept row.

    Tiles are small enough that two rows of one tile are always within ``km``, so a
    tile can keep at most one row per round: its newest undecided row, the head. A
    head no newer undecided row reaches is kept and removes its neighbourhood. Rows
    meet heads and kept rows only, never each other, so a pile of copies is linear.
    """
    rows = perims.select("perim_id", "t", "clat", "clon")
    free = rows.where(F.col("clat").isNull()).select("perim_id")
    h = km / 111.0 * 0.70
    band = F.floor(F.col("clat") / h)
    low = F.least(F.abs(band), F.abs(band + 1)) * F.lit(h)
    # Width uses the widest latitude of the band, so the diagonal stays under ``km``.
    width = F.lit(h) / F.cos(F.radians(F.when((band <= 0) & (band + 1 >= 0), F.lit(0.0)).otherwise(low)))
    open_rows = cut_lineage(
        rows.where(F.col("clat").isNotNull()).withColumn("ti", band).withColumn("tj", F.floor(F.col("clon") / width))
    )
    rank = F.struct("t", (-F.col("perim_id")).alias("n"))
    kept = free
    d = frames.quick_km(F.col("clat"), F.col("clon"), F.col("hlat"), F.col("hlon"))
    for _ in range(max_rounds):
        heads = open_rows.groupBy("ti", "tj").agg(F.max(F.struct(rank.alias("k"), "perim_id", "clat", "clon")).alias("h"))
        heads = heads.select(
            F.col("h.k").alias("hk"), F.col("h.perim_id").alias("hid"), F.col("h.clat").alias("hlat"), F.col("h.clon").alias("hlon")
        )
        pts = open_rows.withColumn("k", rank)
        near = geo_radius_join(
            pts.select("perim_id", "k", "clat", "clon"), heads, km, d, left_ll=("clat", "clon"),
            right_ll=("hlat", "hlon"), inclusive=False,
        )
        blocked = near.where(F.col("k") > F.col("hk")).select("hid").distinct()
        chosen = cut_lineage(heads.join(blocked, "hid", "left_anti").select("hid", "hlat", "hlon"))
        removed = geo_radius_join(
            open_rows.select("perim_id", "clat", "clon"), chosen, km, d, left_ll=("clat", "clon"),
            right_ll=("hlat", "hlon"), inclusive=False,
        ).select("perim_id").distinct()
        kept = kept.unionByName(chosen.select(F.col("hid").alias("perim_id")))
        open_rows = cut_lineage(
            open_rows.join(removed, "perim_id", "left_anti").join(
                chosen.select(F.col("hid").alias("perim_id")), "perim_id", "left_anti"
            )
        )
        if open_rows.isEmpty():
            return perims.join(kept, "perim_id", "left_semi")
    raise RuntimeError("cluster_dedup did not settle; raise max_rounds")


def stage_join(steps: DataFrame, predictions: DataFrame) -> DataFrame:
    """Steps with a stored prediction, matched on ``fire:step:start`` with the Z spelling."""
    start = F.regexp_replace("start", r"\+00:00", "Z")
    key = F.concat_ws(":", "fire", F.col("step").cast("string"), start)
    return steps.withColumn("step_key", key).join(predictions, "step_key")


def perimeter_history(consolidated: DataFrame, daily: DataFrame, archive: DataFrame, name: str,
                      year: int | None = None, state: str | None = None) -> DataFrame:
    """All snapshots of one incident: the consolidated match, then daily and archive rows by id.

    When nothing consolidated matches, daily rows by name and year stand in and give the id.
    """
    cols = ["perim_id", "irwin_id", "name", "acres", "t_current", "source"]
    best = largest_matching_fire(consolidated, name, year, state)
    ids = best.select("irwin_id").where(F.col("irwin_id").isNotNull())
    by_id = daily.join(ids, "irwin_id", "left_semi")
    major = not year or year <= 2015 or "FIRE" in name.upper() or "COMPLEX" in name.upper()
    fallback = daily.where(F.col("name").contains(clean_name(name)))
    fallback = fallback.where(F.col("acres").isNull() | (F.col("acres") >= (100 if major else 10)))
    if state:
        fallback = fallback.where(F.col("state").contains(state.upper()))
    if year:
        fallback = fallback.where(F.year("t_current") == year)
    none_found = best.agg(F.count("*").alias("n")).where("n = 0")
    fallback = fallback.join(none_found, how="left_semi", on=F.lit(True))
    first_id = fallback.where(F.col("irwin_id").isNotNull()).orderBy("t_current", "perim_id").limit(1).select("irwin_id")
    arch = archive.where(F.col("category") == "Wildfire Daily Fire Perimeter").join(ids.unionByName(first_id), "irwin_id", "left_semi")
    if not year or year < 2020:
        arch = arch.limit(0)
    parts = [(best, "consolidated"), (by_id, "daily"), (fallback, "daily"), (arch, "archive")]
    out = None
    for df, source in parts:
        part = df.withColumn("source", F.lit(source)).select(*cols)
        out = part if out is None else out.unionByName(part)
    return out


def report_stats(perims: DataFrame, hotspots: DataFrame) -> DataFrame:
    a = perims.groupBy("fire").agg(
        F.count("*").alias("snapshots"), F.max("acres").alias("peak_acres"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )
    b = hotspots.groupBy("fire").agg(F.count("*").alias("hotspots"))
    return a.join(b, "fire", "left").withColumn("hotspots", F.coalesce("hotspots", F.lit(0)))


def complex_perimeters(perims: DataFrame, name: str, year: int | None = None, state: str | None = "CA") -> DataFrame:
    """Every constituent of a fire complex: exact, case-insensitive name, never a substring."""
    rows = perims.where(F.upper("complex_name") == F.lit(name.upper()))
    if year:
        rows = rows.where(F.col("year") == year)
    if state:
        rows = rows.where(F.upper("state") == F.lit(state.upper()))
    return rows


def nearest_k(points: DataFrame, centers: DataFrame, radius_km: float, k: int) -> DataFrame:
    """The ``k`` closest points per centre within the radius, by great-circle distance."""
    d = frames.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    pairs = geo_radius_join(points, centers, radius_km, d)
    return top_n(pairs, ["center_id"], [F.col("d"), F.col("id")], k, F.col("id"))


def edge_activity(edges: DataFrame, active: DataFrame, keys: list[str], limit_km: float = 1.0) -> DataFrame:
    """Perimeter edges flagged ``active`` where a hot or recent detection is nearer than ``limit_km`` to an end.

    ``edges``: (keys, part, ring, seq, x1, y1, x2, y2) and ``active``: (keys, x, y), in kilometres of one frame.
    """
    own = ["part", "ring", "seq"]
    ends = edges.select(*keys, *own, F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e"))
    ends = ends.select(*keys, *own, "e.x", "e.y")
    spots = active.select(*keys, F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    near = radius_join(ends, spots, limit_km, keys, inclusive=False).select(*keys, *own).distinct().withColumn("__hot", F.lit(True))
    return edges.join(near, [*keys, *own], "left").withColumn("active", F.coalesce("__hot", F.lit(False))).drop("__hot")
