"""A spread of registered queries beside their SQL on the smallest data; tools/check_oracle.py runs them all."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from check_oracle import TABLES, rows

SF = "/root/testdata/sf0.001"
NAMES = [
    "f08_cutoff_kept", "f09_dedup_detections", "a08_latest_fill_per_tile", "a09_source_health_summary", "w06_cycle_deltas", "f07_containment_status",
    "j10_perimeter_fusion", "l02_nearest_k", "w03_drop_runs", "w04_recent_drop_paths", "f21_is_firefighting", "a11_idw", "w10_kbdi", "x05_fire_behavior", "r05_tpi",
    "j14_bilinear_sample", "a04_angular_reach", "l01_topk_mass", "perimeter_rule_score", "r02_r03_belief_fold", "g07_components", "c01_resolve_ignition",
    "t06_stream_cycle_alerts",
]


@pytest.mark.skipif(not Path(SF).exists(), reason="driver data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
    assert got
