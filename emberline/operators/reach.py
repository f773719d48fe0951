"""Temporal reachability: detections linked only to earlier, reachable support."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.frames import M_PER_DEG
from emberline.session import by_shuffle

UNTIMED_HOURS = 24.0
RESULT = (
    "fire bigint, det_id bigint, t double, accepted boolean, distance_m double, limit_m double, radius_m double, "
    "lat double, lon double, parent_lat double, parent_lon double"
)


def link_rows(t: np.ndarray, x: np.ndarray, y: np.ndarray, support: np.ndarray, settings: dict) -> dict[str, np.ndarray]:
    """Judge spots, ordered by time, against support (t, x, y) strictly earlier than them.

    Spots of one time are a frame and never support each other; accepted ones support later frames. Returns the
    verdicts, the places moved toward their parent, and under ``support`` all support there is now. Plain arrays
    all the way: a fire has many frames of few spots.
    """
    n, m = len(t), len(support)
    st, sx, sy = (np.concatenate([support[:, k], np.empty(n)]) for k in range(3))
    ok = np.zeros(n, dtype=bool)
    dist, lim, parx, pary = (np.full(n, np.nan) for _ in range(4))
    px, py = x.copy(), y.copy()
    per_hour = 1000.0 * settings["max_speed_kmh"]
    ends = [*np.nonzero(t[1:] != t[:-1])[0] + 1, n] if n else []
    a = 0
    for b in ends:
        now = t[a]
        gone = now - st[:m]
        limit = settings["tolerance_m"] + per_hour * np.where(np.isnan(gone), UNTIMED_HOURS, np.maximum(gone, 0.0) / 3600.0)
        limit[gone <= 0.0] = -1.0  # not earlier
        for i in range(a, b if m else a):  # one spot against all support at once
            d = np.hypot(sx[:m] - x[i], sy[:m] - y[i])
            d[~(d <= limit)] = np.inf
            k = int(d.argmin())
            if d[k] < np.inf:
                ok[i], dist[i], lim[i], parx[i], pary[i] = True, d[k], limit[k], sx[k], sy[k]
                if d[k] > 0:
                    move = min(settings["subpixel_m"], d[k]) / d[k]
                    px[i], py[i] = x[i] + (sx[k] - x[i]) * move, y[i] + (sy[k] - y[i]) * move
        new = a + np.nonzero(ok[a:b])[0]
        st[m : m + len(new)], sx[m : m + len(new)], sy[m : m + len(new)] = now, px[new], py[new]
        a, m = b, m + len(new)
    return {"ok": ok, "dist": dist, "lim": lim, "parx": parx, "pary": pary, "px": px, "py": py, "support": np.column_stack([st[:m], sx[:m], sy[:m]])}


def spot_radius(ok: np.ndarray, frp: np.ndarray, area_m2: np.ndarray, half_width_m: float) -> np.ndarray:
    """Radius of accepted spots, NaN for others."""
    core = np.where(np.isnan(area_m2), 0.0, np.sqrt(np.maximum(np.nan_to_num(area_m2), 0.0) / math.pi))
    power = np.maximum(np.nan_to_num(frp), 0.0)
    return np.where(ok, np.maximum(half_width_m, core + 180.0) + np.minimum(180.0, 45.0 * np.log1p(power / 100.0)), np.nan)


def _fire(dets: pd.DataFrame, seeds: pd.DataFrame, settings: dict) -> pd.DataFrame:
    if dets.empty or seeds.empty:
        return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
    lat0 = float(np.mean(np.concatenate([dets["lat"], seeds["lat"]])))
    scale = M_PER_DEG * math.cos(math.radians(lat0))
    support = np.column_stack([seeds["t"].to_numpy(dtype=float), seeds["lon"] * scale, seeds["lat"] * M_PER_DEG])
    t, ids = dets["t"].to_numpy(dtype=float), dets["det_id"].to_numpy()
    turn = np.lexsort((ids, t))
    t, lon, lat = t[turn], dets["lon"].to_numpy(dtype=float)[turn], dets["lat"].to_numpy(dtype=float)[turn]
    frp, area = (dets[c].to_numpy(dtype=float)[turn] for c in ("frp", "area_m2"))
    got = link_rows(t, lon * scale, lat * M_PER_DEG, support, settings)
    return pd.DataFrame(
        {
            "fire": dets["fire"].to_numpy()[turn], "det_id": ids[turn], "t": t, "accepted": got["ok"], "distance_m": got["dist"], "limit_m": got["lim"],
            "radius_m": spot_radius(got["ok"], frp, area, settings["half_width_m"]), "lat": got["py"] / M_PER_DEG, "lon": got["px"] / scale,
            "parent_lat": got["pary"] / M_PER_DEG, "parent_lon": got["parx"] / scale,
        }
    )


def temporal_reachability(dets: DataFrame, seeds: DataFrame, since_s: float, max_speed_kmh: float = 6.0, tolerance_m: float = 3000.0,
                          subpixel_m: float = 0.0, half_width_m: float = 350.0) -> DataFrame:
    """Accept detections within tolerance + speed x time of an earlier accepted point.

    ``dets``: (fire, det_id, t, lat, lon, frp, area_m2); ``seeds``: (fire, t or NULL, lat, lon).
    Acceptance is sequential in time, so a fire's frames run in one group. The group is bounded by the
    lookback ``since_s`` (the source's own window is hours) and by the pixel lattice: detections of one
    time and place are one spot there, and each of them gets the spot's verdict with its own radius.
    A detection with ``area_censored`` true (a saturated pixel) has no area to widen its core.
    """
    settings = {"max_speed_kmh": max_speed_kmh, "tolerance_m": tolerance_m, "subpixel_m": subpixel_m, "half_width_m": half_width_m}
    recent = dets.where(F.col("t") >= since_s)
    area = F.greatest(F.col("area_m2"), F.lit(0.0))
    if "area_censored" in dets.columns:
        area = F.when(~F.coalesce("area_censored", F.lit(False)), area)
    place = ["fire", "t", "lat", "lon"]
    spots = recent.groupBy(*place).agg(F.min("det_id").alias("det_id")).select(
        "fire", "det_id", "t", "lat", "lon", F.lit(None).cast("double").alias("frp"), F.lit(None).cast("double").alias("area_m2")
    )
    judged = spots.groupBy("fire").cogroup(seeds.select("fire", "t", "lat", "lon").groupBy("fire")).applyInPandas(
        lambda a, b: _fire(a, b, settings), RESULT
    ).select(F.col("fire").alias("__f"), "det_id", "accepted", "distance_m", "limit_m", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "parent_lat", "parent_lon")
    own = recent.select(*place, "det_id", "frp", area.alias("area"))
    rows = by_shuffle(by_shuffle(own).join(spots.select(*place, F.col("det_id").alias("__s")), place)).join(judged.withColumnRenamed("det_id", "__j"), (F.col("fire") == F.col("__f")) & (F.col("__s") == F.col("__j")))
    core = F.coalesce(F.sqrt(F.col("area") / F.lit(math.pi)), F.lit(0.0))
    power = F.greatest(F.coalesce("frp", F.lit(0.0)), F.lit(0.0))
    radius = F.greatest(F.lit(half_width_m), core + 180.0) + F.least(F.lit(180.0), F.lit(45.0) * F.log1p(power / 100.0))
    return rows.select(
        "fire", "det_id", "t", "accepted", "distance_m", "limit_m", F.when(F.col("accepted"), radius).alias("radius_m"),
        F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "parent_lat", "parent_lon",
    )
