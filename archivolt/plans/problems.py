"""Queries of the data-processing problems that live in the core (times, places)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators.dualtree import near_sightings
from archivolt.operators.timestamps import chosen_times, record_times
from archivolt.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of every readable incident_date and release_date."""
    return record_times(table(spark, sf_dir, "search_index"), table(spark, sf_dir, "places"), table(spark, sf_dir, "agencies"))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_times(table(spark, sf_dir, "search_index"), table(spark, sf_dir, "places"), table(spark, sf_dir, "agencies"))


def p2_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by field and by what their choice rests on.

    ``several`` values have two or more readings and went through the chain,
    ``within`` of them two or more that break as few conventions, ``broken``
    were only readable against a convention.
    """
    got = _chosen(spark, sf_dir).where(F.size("readings") > 0)
    equal = F.size(F.filter("readings", lambda r: r["odd"] == F.col("readings")[0]["odd"])) > 1
    count = lambda c: F.sum(c.cast("bigint"))
    return got.groupBy("field").agg(F.count(F.lit(1)).alias("readable"), count(F.size("readings") > 1).alias("several"), count(equal).alias("within"), count(F.col("chosen.odd") > 0).alias("broken"))


def p2_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of :func:`p2_found` that are written as plain ISO dates."""
    got = _chosen(spark, sf_dir).where(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("chosen.odd") == 0))
    return got.select("id", "field", F.col("chosen.normal").alias("normal"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Civilian sightings within 40 km and 3 days of an official entry."""
    return near_sightings(table(spark, sf_dir, "correlations"), table(spark, sf_dir, "sightings"))


QUERIES = {"p2_found": p2_found, "p2_decided": p2_decided, "p2_iso": p2_iso, "p4_found": p4_found}

_POINT = """
  SELECT DISTINCT id, location.lat AS lat, location.lng AS lng,
    coalesce(try_strptime(regexp_extract(occurred_at, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})(?:$|[T\\s])', 1), '%Y-%m-%d'),
             try_strptime(regexp_extract(occurred_at, '^\\s*(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})(?:$|\\s)', 1), '%m/%d/%Y'))::DATE AS d
  FROM {t}
  WHERE lower(trim(occurred_at_precision)) IN ('day', 'minute')
    AND location.lat BETWEEN -90 AND 90 AND location.lng BETWEEN -180 AND 180
    AND NOT (location.lat = 0 AND location.lng = 0)
"""

ORACLE = {
    "p2_iso": r"""
WITH v AS (SELECT id, 'incident_date' AS field, incident_date AS value FROM search_index UNION SELECT id, 'release_date', release_date FROM search_index)
SELECT DISTINCT id, field, value AS normal FROM v
WHERE id IS NOT NULL AND regexp_full_match(value, '\d{4}-\d{2}-\d{2}') AND try_strptime(value, '%Y-%m-%d') IS NOT NULL AND value >= '1000'
""",
    "p4_found": f"""
WITH l AS ({_POINT.format(t="correlations")}), r AS ({_POINT.format(t="sightings")}),
near AS (SELECT id, lat, lng, d, unnest([-3, -2, -1, 0, 1, 2, 3]) AS k FROM l WHERE d IS NOT NULL)
SELECT DISTINCT near.id AS record_id, r.id AS sighting_id
FROM near JOIN r ON r.d = near.d + near.k::INTEGER
WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(r.lat) - radians(near.lat)) / 2), 2)
  + cos(radians(near.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lng - near.lng) / 2), 2)))) <= 40
""",
}
