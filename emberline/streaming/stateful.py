"""Stateful streaming: cycle alerts, drop runs and reachability, one state per key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.functions.frames import M2_PER_ACRE, M_PER_DEG
from emberline.operators.health import FLOOR_RADIUS_M, MAX_HEAD_ROS_M_MIN
from emberline.operators.reach import link_rows, spot_radius

ALERT = "fire bigint, seq bigint, t double, pred_acres double, elapsed_min double, delta_acres double, feasible_acres double, physics_alert boolean"


def _bound(acres: float, minutes: float) -> float:
    base = max(acres, 0.0) * M2_PER_ACRE
    r = max(math.sqrt(base / math.pi), FLOOR_RADIUS_M) + MAX_HEAD_ROS_M_MIN * max(minutes, 0.0)
    return max(math.pi * r * r - base, 0.0) / M2_PER_ACRE


def _held(batches, rows: list[list]) -> list[tuple]:
    """Rows kept from earlier batches and those of this one, as tuples."""
    out = list(zip(*rows)) if rows and len(rows[0]) else []
    for pdf in batches:
        out.extend(zip(*(pdf[c].tolist() for c in pdf.columns)))
    return out


def _release(state: GroupState, rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows the watermark has passed, in order, and the rest; the first column is epoch seconds."""
    mark = state.getCurrentWatermarkMs() / 1000.0
    return sorted(r for r in rows if r[0] < mark), [r for r in rows if not r[0] < mark]


def _alerts(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if pd.isna(key[0]):  # a row that only moves the watermark
        return
    acres, last, *kept = state.get if state.exists else (float("nan"), float("nan"), [], [], [])
    fresh = (pdf[["t", "seq", "pred_acres"]] for pdf in batches) if not state.hasTimedOut else ()
    ready, later = _release(state, _held(fresh, kept))
    out = []
    for t, seq, pred in ready:
        minutes = (t - last) / 60.0
        known = not math.isnan(last)
        delta = pred - acres if known else None
        bound = _bound(acres, minutes) if known and minutes > 0 else None
        out.append((key[0], seq, t, pred, minutes if known else None, delta, bound, bool(bound is not None and delta > bound)))
        acres, last = pred, t
    state.update((acres, last, *([r[k] for r in later] for k in range(3))))
    if later:
        state.setTimeoutTimestamp(max(int(min(later)[0] * 1000) + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")])


def stream_cycle_alerts(cycles: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Growth since the previous cycle against the feasible bound.

    ``cycles``: (fire, ts, seq, t, pred_acres). A fire's rows wait until the watermark has passed them and
    are then judged in order of (t, seq), so the order of files does not matter; state is the last
    (acres, t) and the rows that wait.
    """
    return cycles.withWatermark("ts", late).groupBy("fire").applyInPandasWithState(
        _alerts, ALERT, "acres double, t double, h_t array<double>, h_seq array<bigint>, h_acres array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


RUN = "icao bigint, hits bigint, t0 double, t1 double, kind string"
RUN_STATE = (
    "has_prev boolean, prev_agl double, has_held boolean, t double, agl double, spd double, heli boolean, "
    "open boolean, hits bigint, t0 double, t1 double, kind string, "
    "h_t array<double>, h_pt array<bigint>, h_agl array<double>, h_spd array<double>, h_heli array<boolean>"
)


def _is_drop(prev, agl, nxt, spd, heli) -> str | None:
    nan = lambda v: v is None or math.isnan(v)
    if nan(agl) or nan(spd) or not (nan(prev) or agl <= prev + 40) or not (nan(nxt) or agl <= nxt + 40):
        return None
    if heli:
        return "water(heli)" if agl <= 90.0 and 0 <= spd <= 42 else None
    return "retardant(tanker)" if agl <= 180.0 and 48 <= spd <= 108 else None


def _runs(gap_s: float):
    def step(key, batches, state: GroupState):
        if pd.isna(key[0]):  # a row that only moves the watermark
            return
        if state.exists:
            has_prev, prev, held, t, agl, spd, heli, is_open, hits, t0, t1, kind, *kept = state.get
        else:
            has_prev, prev, held, t, agl, spd, heli, is_open, hits, t0, t1, kind = False, 0.0, False, 0.0, 0.0, 0.0, False, False, 0, 0.0, 0.0, ""
            kept = [[], [], [], [], []]
        closed = []

        def settle(nxt):
            """Judge the held sample now that its follower (or the end) is known."""
            nonlocal is_open, hits, t0, t1, kind
            k = _is_drop(prev if has_prev else None, agl, nxt, spd, heli)
            if k is not None:
                hits, t0 = (hits + 1, t0) if is_open else (1, t)
                is_open, t1, kind = True, t, k
            elif is_open:
                closed.append((key[0], hits, t0, t1, kind))
                is_open, hits = False, 0

        def finish():
            """No sample within the gap follows: the held one is the last of its stretch."""
            nonlocal held, has_prev, is_open, hits
            if held:
                settle(None)
            if is_open:
                closed.append((key[0], hits, t0, t1, kind))
            held = has_prev = is_open = False
            hits = 0

        fresh = (pdf[["t", "pt", "agl_m", "spd_ms", "heli"]].astype({"agl_m": float, "spd_ms": float}) for pdf in batches) if not state.hasTimedOut else ()
        ready, later = _release(state, _held(fresh, kept))
        for row in ready:
            if held and row[0] - t > gap_s:
                finish()
            if held:
                settle(row[2])
                has_prev, prev = True, agl
            held, (t, agl, spd, heli) = True, (float(row[0]), float(row[2]), float(row[3]), bool(row[4]))
        mark = state.getCurrentWatermarkMs() / 1000.0
        if held and mark > t + gap_s and (not later or min(later)[0] - t > gap_s):
            finish()
        if later or held:
            state.update((has_prev, prev, held, t, agl, spd, heli, is_open, hits, t0, t1, kind, *([r[k] for r in later] for k in range(5))))
            due = [min(later)[0]] if later else []
            due += [t + gap_s] if held else []
            state.setTimeoutTimestamp(max(int(min(due) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(closed, columns=[c.split()[0] for c in RUN.split(", ")])

    return step


def stream_drop_runs(tracks: DataFrame, gap_s: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """Drop runs with a one-sample lookahead; a run closes on a clean sample or after ``gap_s`` without one.

    ``tracks``: (icao, ts, t, pt, agl_m, spd_ms, heli). Samples wait until the watermark has passed them and
    are then taken in order of (t, pt), whatever files they came in.
    """
    return tracks.withWatermark("ts", late).groupBy("icao").applyInPandasWithState(
        _runs(gap_s), RUN, RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


REACH = "fire bigint, det_id bigint, t double, accepted boolean, distance_m double, radius_m double"
REACH_STATE = "s_t array<double>, s_x array<double>, s_y array<double>, b_id array<bigint>, b_t array<double>, b_lat array<double>, b_lon array<double>, b_frp array<double>, b_area array<double>"


def _reach(settings: dict, lookback_s: float):
    places = ["t", "lat", "lon", "frp", "area_m2"]

    def step(key, batches, state: GroupState):
        if pd.isna(key[0]):  # a row that only moves the watermark
            return
        scale = M_PER_DEG * math.cos(math.radians(settings["lat0"]))
        s_t, s_x, s_y, ids, *held = state.get if state.exists else [()] * 9
        support = np.column_stack([np.asarray(v, dtype=float) for v in (s_t, s_x, s_y)])
        ids, held = np.asarray(ids, dtype=np.int64), [np.asarray(v, dtype=float) for v in held]
        if not state.hasTimedOut:
            fresh = list(batches)
            fresh = pd.concat(fresh) if len(fresh) > 1 else fresh[0]
            seed = fresh["seed"].to_numpy(dtype=bool)
            t, lat, lon, frp, area = (fresh[c].to_numpy(dtype=float) for c in places)
            support = np.vstack([support, np.column_stack([t[seed], lon[seed] * scale, lat[seed] * M_PER_DEG])])
            ids = np.concatenate([ids, fresh["det_id"][~seed].astype("int64").to_numpy()])
            held = [np.concatenate([old, new[~seed]]) for old, new in zip(held, (t, lat, lon, frp, area))]
        mark = state.getCurrentWatermarkMs() / 1000.0
        # Whole frames only: a frame is judged once the watermark has passed it.
        passed = held[0] < mark
        turn = np.nonzero(passed)[0]
        turn = turn[np.lexsort((ids[turn], held[0][turn]))]
        t, lat, lon, frp, area = (v[turn] for v in held)
        got = link_rows(t, lon * scale, lat * M_PER_DEG, support, settings)
        support = got["support"]
        support = support[np.isnan(support[:, 0]) | (support[:, 0] >= mark - lookback_s)] if mark > 0 else support
        done = ids[turn]
        ids, held = ids[~passed], [v[~passed] for v in held]
        state.update((*[support[:, i].tolist() for i in range(3)], ids.tolist(), *[v.tolist() for v in held]))
        if len(ids):
            state.setTimeoutTimestamp(max(int(np.nanmin(held[0]) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"fire": np.full(len(done), key[0], dtype=np.int64), "det_id": done, "t": t, "accepted": got["ok"], "distance_m": got["dist"],
                            "radius_m": spot_radius(got["ok"], frp, area, settings["half_width_m"])})

    return step


def stream_reachability(dets: DataFrame, lat0: float, late: str = "10 minutes", lookback_s: float = 86400.0, max_speed_kmh: float = 6.0,
                        tolerance_m: float = 3000.0, subpixel_m: float = 0.0, half_width_m: float = 350.0) -> DataFrame:
    """Frame-by-frame reachability; state is support within the lookback plus unreleased frames.

    ``dets``: (fire, ts, det_id, t, lat, lon, frp, area_m2, seed); seed rows add support and are not judged.
    """
    settings = {"max_speed_kmh": max_speed_kmh, "tolerance_m": tolerance_m, "subpixel_m": subpixel_m, "half_width_m": half_width_m, "lat0": lat0}
    return dets.withWatermark("ts", late).groupBy("fire").applyInPandasWithState(
        _reach(settings, lookback_s), REACH, REACH_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
