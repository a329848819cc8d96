"""Dual-tree join: points near other points in space and time.

Both sides are indexed by the same fixed tree over (latitude, longitude, day);
a node carries the bounding box of what it really holds, in 3-D unit vectors
(so poles and the date line need no special case) and days. The join starts at
root x root and goes down level by level as DataFrames of node pairs: a pair
whose boxes are too far apart is discarded, one whose boxes are certainly near
is accepted wholesale, all others are split. What is left at the outlets is
refined point by point. Node tables and pairs stay distributed; a node that
holds many points is cut into chunks, so that a hot place is many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.session import cut_to_table

EARTH_KM = 6371.0
#: Bits of latitude, longitude and time that a node at each level fixes.
LEVELS = ((0, 0, 0), (2, 3, 3), (4, 5, 7), (6, 7, 11), (8, 9, 13), (9, 10, 15))
TOP = LEVELS[-1]
#: Levels at which pairs may leave the recursion; the table is cut there too.
OUTLETS = (3, 5)
DAY0, DAY_SPAN = -65_536, 131_072  # the tree's time range: 1790 to 2149; days outside share the end slabs
BOX = ("x", "y", "z", "day")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km; null if a coordinate is (``least`` alone would skip nulls)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def usable(lat: Column, lng: Column) -> Column:
    """Both coordinates present, in range and not 0/0; never null."""
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0)) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))


def _node(level: int, a: Column, b: Column, c: Column) -> Column:
    """Node id: the bits fixed at ``level`` of the three cell numbers, packed with the level."""
    x, y, z = LEVELS[level]
    cut = lambda v, top, bits: F.shiftright(v, top - bits).cast("bigint")
    return F.lit(level).cast("bigint") * (1 << 40) + cut(a, TOP[0], x) * (1 << 28) + cut(b, TOP[1], y) * (1 << 16) + cut(c, TOP[2], z)


def _cells(df: DataFrame) -> DataFrame:
    grid = lambda v, lo, span, bits: F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((v - lo) / span * (1 << bits)))).cast("int")
    lat, lng = F.radians("lat"), F.radians("lng")
    return (
        df.withColumn("a", grid(F.col("lat"), -90, 180, TOP[0]))
        .withColumn("b", grid(F.col("lng"), -180, 360, TOP[1]))
        .withColumn("c", grid(F.col("day"), DAY0, DAY_SPAN, TOP[2]))
        .withColumn("x", F.cos(lat) * F.cos(lng))
        .withColumn("y", F.cos(lat) * F.sin(lng))
        .withColumn("z", F.sin(lat))
    )


def _tree(points: DataFrame, label: str) -> DataFrame:
    """Every node of every level: (level, node, parent, n, bounding box)."""
    leaf = points.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"), *[f(v).alias(f"{v}_{s}") for v in BOX for f, s in ((F.min, "lo"), (F.max, "hi"))])
    return cut_to_table(_rollup(leaf), f"{label}-nodes")


def _rollup(leaf: DataFrame) -> DataFrame:
    """All levels in one pass: each leaf counts for its node at every level, combined before the shuffle."""
    at = lambda k: _node(k, F.col("a"), F.col("b"), F.col("c"))
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), at(k).alias("node"), at(max(0, k - 1)).alias("parent")) for k in range(len(LEVELS))])).alias("i")
    agg = [F.sum("n").alias("n")] + [f(f"{v}_{s}").alias(f"{v}_{s}") for v in BOX for f, s in ((F.min, "lo"), (F.max, "hi"))]
    return leaf.select(every, "n", *[f"{v}_{s}" for v in BOX for s in ("lo", "hi")]).groupBy("i.level", "i.node", "i.parent").agg(*agg)


def _bounds(l: str, r: str) -> tuple[Column, Column, Column, Column]:
    """Squared chord and day gap between two boxes, least and most."""
    c = lambda s, v, e: F.col(f"{s}_{v}_{e}")
    gap = lambda v: F.greatest(F.lit(0.0), c(l, v, "lo") - c(r, v, "hi"), c(r, v, "lo") - c(l, v, "hi"))
    far = lambda v: F.greatest(c(l, v, "hi") - c(r, v, "lo"), c(r, v, "hi") - c(l, v, "lo"))
    sq = lambda f: reduce(lambda p, q: p + q, [f(v) * f(v) for v in ("x", "y", "z")])
    return sq(gap), sq(far), gap("day"), far("day")


def node_pairs(left: DataFrame, right: DataFrame, km: float, days: int, small: int = 1024) -> DataFrame:
    """The dual recursion over two node tables: (level, l, r, ln, rn, sure)."""
    chord = 2 * math.sin(min(km, math.pi * EARTH_KM) / (2 * EARTH_KM))
    least, most = (chord * (1 + 1e-9) + 1e-12) ** 2, max(0.0, chord * (1 - 1e-9) - 1e-12) ** 2
    side = lambda df, k, p: df.where(F.col("level") == k).select(F.col("node").alias(p), F.col("parent").alias(f"{p}_up"), F.col("n").alias(f"{p}n"), *[F.col(f"{v}_{e}").alias(f"{p}_{v}_{e}") for v in BOX for e in ("lo", "hi")])
    done, frontier = [], None
    for k in range(len(LEVELS)):
        ls, rs = side(left, k, "l"), side(right, k, "r")
        if frontier is None:
            pairs = ls.join(rs, ls.l_up == rs.r_up)  # root x root
        else:
            up = frontier.select(F.col("l").alias("l_up"), F.col("r").alias("r_up"))
            pairs = up.join(ls, "l_up").join(rs, "r_up")
        near, far, day_near, day_far = _bounds("l", "r")
        pairs = pairs.where((near <= least) & (day_near <= days)).withColumn("sure", (far <= most) & (day_far <= days)).select("l", "r", "ln", "rn", "sure")
        if k in OUTLETS:
            pairs = cut_to_table(pairs, f"pairs-{k}")
            out = F.col("sure") | (F.col("ln") * F.col("rn") <= small) | F.lit(k == len(LEVELS) - 1)
            done.append(pairs.where(out).withColumn("level", F.lit(k)))
            pairs = pairs.where(~out)
        frontier = pairs
    return reduce(DataFrame.unionByName, done)


def dual_tree_join(left: DataFrame, right: DataFrame, km: float, days: int) -> DataFrame:
    """Pairs (left_id, right_id) at most ``km`` and ``days`` apart.

    Each side has columns id, lat, lng, day (int days since 1970); others are
    left out. Rows with a null id or day or unusable coordinates take no part.
    Repeated rows give one pair. Either side empty: no rows. Distances at the
    limit count.
    """
    def clean(df: DataFrame, label: str) -> DataFrame:
        df = df.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col("day").cast("int").alias("day"))
        df = df.where(F.col("id").isNotNull() & F.col("day").isNotNull() & usable(F.col("lat"), F.col("lng"))).distinct()
        return cut_to_table(_cells(df), f"{label}-points")

    l, r = clean(left, "left"), clean(right, "right")
    lt, rt = _tree(l, "left"), _tree(r, "right")
    pairs = node_pairs(lt, rt, km, days)

    def chunked(points: DataFrame, tree: DataFrame, p: str) -> DataFrame:
        """Points with their outlet nodes and, in a node of many points, a chunk number.

        A chunk holds about N / 50,000 points, 2,048 at least, so at most 50,000
        nodes per outlet are larger and their list can be broadcast at any N.
        """
        total = tree.where(F.col("level") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        chunk = max(2048, math.ceil(total / 50_000))
        hot = tree.where((F.col("n") > chunk) & F.col("level").isin(*OUTLETS)).select(F.col("node").alias(p), F.ceil(F.col("n") / chunk).cast("int").alias("k"))
        pts = points.select(F.col("id").alias(f"{p}_id"), F.col("lat").alias(f"{p}_lat"), F.col("lng").alias(f"{p}_lng"), F.col("day").alias(f"{p}_day"), F.explode(F.array(*[_node(k, F.col("a"), F.col("b"), F.col("c")) for k in OUTLETS])).alias(p))
        pts = pts.join(F.broadcast(hot), p, "left").withColumn(f"{p}_s", F.pmod(F.xxhash64(f"{p}_id", f"{p}_day"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
        return pts, hot

    lp, lhot = chunked(l, lt, "l")
    rp, rhot = chunked(r, rt, "r")
    spread = lambda df, hot, p: df.join(F.broadcast(hot), p, "left").withColumn(f"{p}_s", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    pairs = spread(spread(pairs.select("l", "r", "sure"), lhot, "l"), rhot, "r")
    near = (haversine_km(F.col("l_lat"), F.col("l_lng"), F.col("r_lat"), F.col("r_lng")) <= km) & (F.abs(F.col("l_day") - F.col("r_day")) <= days)
    found = pairs.join(lp, ["l", "l_s"]).join(rp, ["r", "r_s"]).where(F.col("sure") | near)
    return found.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")).distinct()


def written_day(text: Column) -> Column:
    """The calendar day as written, as days since 1970: ISO dates first, else month/day/year; null if no real date."""
    iso = F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})(?:$|[T\s])", 1)
    us = F.regexp_extract(text, r"^\s*(\d{1,2}/\d{1,2}/\d{4})(?:$|\s)", 1)
    day = F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(us, "M/d/yyyy"))
    return F.unix_date(day)


def sighting_points(df: DataFrame) -> DataFrame:
    """Rows of the shared sighting shape with day or minute precision, as join points."""
    ok = F.lower(F.trim("occurred_at_precision")).isin("day", "minute")
    return df.where(ok).select("id", F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"), written_day(F.col("occurred_at")).alias("day"))


def near_sightings(official: DataFrame, civilian: DataFrame, km: float = 40.0, days: int = 3) -> DataFrame:
    """(record_id, sighting_id): civilian sightings close in place and time to an official entry."""
    found = dual_tree_join(sighting_points(official), sighting_points(civilian), km, days)
    return found.select(F.col("left_id").alias("record_id"), F.col("right_id").alias("sighting_id"))
