"""Ignition points: one answer per request from ranked sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.perimeters import normalize_fire_name

# Source, rank, confidence.
SOURCES = [
    ("curated_index", 1, "verified"),
    ("irwin", 2, "high"),
    ("wfigs_discovery", 3, "high"),
    ("calfire", 4, "medium"),
    ("inciweb", 5, "medium"),
    ("mtbs", 6, "medium"),
    ("firms_fallback", 7, "low"),
]


def usable_point(lat: Column, lon: Column) -> Column:
    """Non-zero coordinates in the western hemisphere."""
    return F.coalesce((lat != 0) & (lon != 0) & lat.between(-90, 90) & lon.between(-180, 0), F.lit(False))


def _grams(name: Column) -> Column:
    """Every substring of one to three characters."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (n - 1), F.lit(1))), lambda i: F.substr(name, i, F.lit(n)))
    return F.array_distinct(F.concat(at(1), at(2), at(3)))


def substring_join(needles: DataFrame, rows: DataFrame, needle: str, text: str) -> DataFrame:
    """Rows whose ``text`` contains ``needle``: an equi-join on the needle's first three
    characters, then the exact test."""
    a = needles.withColumn("__g", F.substring(needle, 1, 3))
    b = rows.withColumn("__g", F.explode(_grams(F.col(text))))
    return a.join(b, "__g").where(F.contains(F.col(text), F.col(needle))).drop("__g")


def resolve_ignition(requests: DataFrame, curated: DataFrame, records: DataFrame) -> DataFrame:
    """First usable source per request.

    ``requests``: (request_id, name, year, fire_key). ``curated``: (key, lat, lon, datetime).
    ``records``: (source, seq, name, year, lat, lon, datetime) of the other sources. A
    record with a known different year is skipped. Unanswered requests keep NULLs.
    """
    rank = F.create_map(*[x for s, r, _ in SOURCES for x in (F.lit(s), F.lit(r))])
    conf = F.create_map(*[x for s, _, c in SOURCES for x in (F.lit(s), F.lit(c))])
    req = normalize_fire_name(requests).withColumn("needle", F.upper("name"))
    keys = req.select("request_id", F.posexplode(F.array("fire_key", "slug", "norm_slug")).alias("pos", "key"))
    hit = keys.join(curated, "key").select("request_id", F.lit("curated_index").alias("source"), F.col("pos").cast("bigint").alias("seq"), "lat", "lon", "datetime")
    named = records.select("source", "seq", F.upper("name").alias("text"), F.col("year").alias("ryear"), "lat", "lon", "datetime")
    found = substring_join(req.select("request_id", "needle", "year"), named, "needle", "text")
    found = found.where(F.col("year").isNull() | F.col("ryear").isNull() | (F.col("year") == F.col("ryear")))
    found = found.where(usable_point(F.col("lat"), F.col("lon"))).select("request_id", "source", F.col("seq").cast("bigint").alias("seq"), "lat", "lon", "datetime")
    best = hit.unionByName(found).withColumn("rank", rank[F.col("source")]).groupBy("request_id").agg(
        F.min(F.struct("rank", "seq", "source", "lat", "lon", "datetime")).alias("b")
    )
    return requests.select("request_id").join(best, "request_id", "left").select(
        "request_id", "b.source", "b.lat", "b.lon", "b.datetime", conf[F.col("b.source")].alias("confidence")
    )
