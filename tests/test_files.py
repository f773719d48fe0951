"""Landed files through the readers, and the sinks."""

import json

import pytest
from pyspark.sql import functions as F

from emberline.sources import ground as G
from emberline.sources import satellite as S
from emberline.sources import sinks as K


def test_viirs_csv(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text("latitude,longitude,acq_date,acq_time,frp,confidence,product\n38.1,-120,2024-01-02,5,,n,A\nbad,-120,2024-01-02,5,1,n,A\n38.2,-120,2024-01-02,1310,2.5,n,A\n")
    got = S.read_viirs(spark, str(p)).orderBy("lat").select("lat", "frp", F.date_format("acq", "HH:mm").alias("t")).collect()
    assert [tuple(r) for r in got] == [(38.1, 0.0, "00:05"), (38.2, 2.5, "13:10")]


def test_perimeters_with_hole_and_multipolygon(spark, tmp_path):
    sq = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    doc = {"features": [
        {"properties": {"poly_IncidentName": "Camp", "poly_GISAcres": 10, "poly_DateCurrent": 1700000000000}, "geometry": {"type": "Polygon", "coordinates": [sq(0, 4), sq(1, 2)]}},
        {"properties": {"incident_name": "Two", "area_acres": "7.5"}, "geometry": {"type": "MultiPolygon", "coordinates": [[sq(0, 1)], [sq(5, 6)]]}},
        {"properties": {"incident_name": "None"}, "geometry": None},
    ]}
    p = tmp_path / "p.json"
    p.write_text(json.dumps(doc))
    rows = G.read_perimeters(spark, str(p), "wfigs")
    assert {(r["name"], r["acres"]) for r in rows.collect()} == {("Camp", 10.0), ("Two", 7.5)}
    n = {(r["name"], r["part"], r["ring"]): r["count"] for r in G.perimeter_edges(rows, ["name"]).groupBy("name", "part", "ring").count().collect()}
    assert n == {("Camp", 0, 0): 4, ("Camp", 0, 1): 4, ("Two", 0, 0): 4, ("Two", 1, 0): 4}


def test_station_and_track_files(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("#DEBUG x\nstation,valid,lon,lat,tmpf,dwpf,sknt,drct\nAAA,2024-01-01 00:53,-120,38,50,M,10,270\nBBB,2024-01-01 00:53,-120,38,M,40,10,270\n")
    rows = G.read_station_csv(spark, str(p)).collect()
    assert len(rows) == 1 and rows[0]["id"] == "AAA" and rows[0]["dwpf"] is None
    t = tmp_path / "t.jsonl"
    t.write_text('{"icao":"a","t":100,"lat":38.0}\nnot json\n{"icao":"b","t":-9000,"lat":38.0}\n')
    assert [r["icao"] for r in G.read_tracks(spark, str(t), 200.0, 1.0).collect()] == ["a"]


def test_snapshot_refuses_a_second_write_and_history_keeps_newest(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, 1, 5.0), (1, 20.0, 2, 6.0)], "fire int, t double, seq int, pred_acres double")
    K.write_snapshot({"dets": df}, str(tmp_path / "snap"), "r1")
    back = K.read_snapshot(spark, str(tmp_path / "snap"), "r1", ["dets"])["dets"]
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception):
        K.write_snapshot({"dets": df}, str(tmp_path / "snap"), "r1")
    K.append_history(df, str(tmp_path / "hist"))
    K.append_history(df.where("seq = 1"), str(tmp_path / "hist"))
    assert K.latest_history(spark, str(tmp_path / "hist")).first()["seq"] == 2
    K.write_geojson(spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "fire int, lon double, lat double, dlon double, dlat double"), str(tmp_path / "g"), ["fire"])
    assert json.loads(spark.read.text(str(tmp_path / "g")).first()[0])["geometry"]["type"] == "Polygon"
