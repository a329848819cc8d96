"""Spatial statistics on a regular grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.numeric import normal_cdf
from archivolt.operators.dualtree import usable
from archivolt.operators.joins import nearest_k


def grid_cell(lat: Column, lng: Column, degrees: float) -> Column:
    """Cell of a latitude/longitude grid; pluggable wherever a ``binning`` is asked for."""
    return F.format_string("%d:%d", F.floor((lat + 90) / degrees).cast("int"), F.floor((lng + 180) / degrees).cast("int"))


def layer_counts(points: DataFrame, layers: dict[str, Column], degrees: float, binning: Callable[[Column, Column, float], Column] = grid_cell) -> DataFrame:
    """(cell, lat, lng, layer, n): conditional counts per cell, unpivoted; a cell keeps layers with 0."""
    p = points.where(usable(F.col("lat"), F.col("lng"))).withColumn("cell", binning(F.col("lat"), F.col("lng"), degrees))
    half = lambda c, o: (F.floor((F.col(c) + o) / degrees) + 0.5) * degrees - o
    wide = p.groupBy("cell").agg(F.min(half("lat", 90)).alias("lat"), F.min(half("lng", 180)).alias("lng"), *[F.count_if(c).alias(n) for n, c in layers.items()])
    return wide.select("cell", "lat", "lng", F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("n")) for n in layers])).alias("x")).select("cell", "lat", "lng", "x.layer", "x.n")


def getis_ord(cells: DataFrame, value_col: str = "n", k: int = 8) -> DataFrame:
    """(cell, z, p): Gi* with the ``k`` nearest cells and the cell itself, row-standardised weights.

    Fewer than 9 cells or no variance: z 0, p 1. ``cells`` has cell, lat, lng
    and the value, one row a cell; the cell set must be bounded (checked).
    """
    v = cells.select("cell", F.col(value_col).cast("double").alias("x"))
    near = nearest_k(cells.select("cell", "lat", "lng"), "cell", "lng", "lat", k).select(F.col("id").alias("cell"), "other")
    own = cells.select("cell", F.col("cell").alias("other"))
    lag = near.union(own).join(v.select(F.col("cell").alias("other"), "x"), "other").groupBy("cell").agg(F.avg("x").alias("lag"), F.count(F.lit(1)).alias("w"))
    g = v.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("s")).first()
    ok = g["n"] >= 9 and (g["s"] or 0) > 0
    if not ok:
        return cells.select("cell", F.lit(0.0).alias("z"), F.lit(1.0).alias("p"))
    spread = g["s"] * F.sqrt((g["n"] / F.col("w") - 1) / (g["n"] - 1))  # 0 where the neighbourhood is everything
    out = lag.withColumn("z", F.when(spread > 0, F.try_divide(F.col("lag") - g["mean"], spread)).otherwise(0.0))
    return out.select("cell", F.round("z", 4).alias("z"), F.round(2 * (1 - normal_cdf(F.abs("z"))), 6).alias("p"))
