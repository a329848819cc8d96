import math
import random

from archivolt.operators.dualtree import dual_tree_join, near_sightings, written_day
from pyspark.sql import functions as F

SCHEMA = "id string, lat double, lng double, day int, name string"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def brute(left, right, reach, days):
    ok = lambda r: None not in r[:4] and abs(r[1]) <= 90 and abs(r[2]) <= 180 and (r[1], r[2]) != (0, 0)
    return {(a[0], b[0]) for a in left for b in right if ok(a) and ok(b) and abs(a[3] - b[3]) <= days and km(a, b) <= reach}


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    def some(p, n):
        out = []
        for k in range(n):
            lat, lng = (33.5, -111.2) if k % 3 == 0 else (rnd.uniform(-89, 89), rnd.choice([179.9, -179.9, 10.0])) if k % 3 == 1 else (rnd.uniform(30, 35), rnd.uniform(10, 15))
            out.append((f"{p}{k}", lat + rnd.gauss(0, 0.3), max(-180.0, min(180.0, lng + rnd.gauss(0, 0.3))), 9000 + rnd.randrange(12), "x"))
        return out
    left = some("a", 150) + [("n", None, 1.0, 9000, "x"), ("z", 0.0, 0.0, 9000, "x"), ("o", 95.0, 1.0, 9000, "x"), (None, 33.5, -111.2, 9000, "x"), ("d", 33.5, -111.2, None, "x")]
    left += left[:5]
    right = some("b", 400) + [("q", float("nan"), 1.0, 9000, "x"), ("far", 33.5, -111.2, -900000, "x"), ("w", 90.0, 0.0, 9003, "x"), ("v", 89.9, 180.0, 9003, "x")]
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = dual_tree_join(l, r, 40.0, 3)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(set(rows))
    right = [x for x in right if x[0] != "q"]
    assert set(rows) == brute(left, right, 40.0, 3)
    assert dual_tree_join(l.limit(0), r, 40.0, 3).count() == 0
    assert dual_tree_join(l, r.limit(0), 40.0, 3).count() == 0


def test_hot_place_is_whole(spark):
    n = 5000
    left = spark.range(60).select(F.concat(F.lit("a"), "id").alias("id"), F.lit(33.5).alias("lat"), F.lit(-111.2).alias("lng"), F.lit(9000).alias("day"))
    right = spark.range(n).select(F.concat(F.lit("b"), "id").alias("id"), F.lit(33.5).alias("lat"), F.lit(-111.21).alias("lng"), F.lit(9001).alias("day"))
    assert dual_tree_join(left, right, 40.0, 3).count() == 60 * n


def test_written_day(spark):
    rows = [("2006-01-20 17:48", 13168), ("1988-03-03", 6636), ("2/26/2026 05:29", 20510), ("13/40/1998", None), ("2011-02-30", None), ("long ago", None), (None, None), ("1972-10-15T20:24:00+05:00", 1018)]
    df = spark.createDataFrame(rows, "t string, want int")
    assert df.where(~written_day(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_precision_and_extra_columns(spark):
    schema = "id string, occurred_at string, occurred_at_precision string, location struct<name:string,lat:double,lng:double,country:string>, right_id string"
    a = spark.createDataFrame([("r", "2001-01-01", "day", ("x", 10.0, 10.0, None), "c"), ("m", "2001-01-01", "month", ("x", 10.0, 10.0, None), "c")], schema)
    b = spark.createDataFrame([("s", "1/4/2001 10:00", "minute", ("x", 10.1, 10.1, None), "c"), ("t", "1/5/2001", "day", ("x", 10.1, 10.1, None), "c"), ("u", "1/4/2001", "day", None, "c")], schema)
    assert [tuple(r) for r in near_sightings(a, b).collect()] == [("r", "s")]
