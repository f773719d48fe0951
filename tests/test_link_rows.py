"""Reachability judges frames on plain arrays."""

import numpy as np

from emberline.operators import reach as R


def test_spots_of_a_frame_do_not_support_each_other():
    settings = {"tolerance_m": 10.0, "max_speed_kmh": 0.036, "subpixel_m": 2.0}  # 36 m an hour
    t = np.array([0.0, 3600.0, 3600.0, 3600.0, 7200.0])
    x = np.array([500.0, 40.0, 80.0, 45.0, 85.0])
    got = R.link_rows(t, x, np.zeros(5), np.array([[0.0, 0.0, 0.0], [3600.0, 80.0, 0.0]]), settings)
    assert got["ok"].tolist() == [False, True, False, True, True]  # support of its own time does not count
    assert got["dist"][[1, 3]].tolist() == [40.0, 45.0] and got["px"].tolist() == [500.0, 38.0, 80.0, 43.0, 83.0]
    assert got["dist"][4] == 5.0 and got["parx"][4] == 80.0 and len(got["support"]) == 5
    none = R.link_rows(t, x, np.zeros(5), np.empty((0, 3)), settings)
    assert not none["ok"].any() and len(none["support"]) == 0
    untimed = R.link_rows(t[:1], np.array([800.0]), np.zeros(1), np.array([[np.nan, 0.0, 0.0]]), settings)
    assert untimed["ok"][0] and untimed["lim"][0] == 10.0 + 36.0 * R.UNTIMED_HOURS
