"""Vector, probability, image-box and sky columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- vectors ----


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit length; an all-zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is all zero or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Softmax of ``temperature * v``, the maximum taken off first."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(temperature * (x - top)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def binary_softmax(a: Column, b: Column) -> Column:
    """Probability of the first of two logits."""
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def top_labels(scores: Column, labels: list[str], k: int = 4, least: float = 0.18) -> Column:
    """Up to ``k`` (score, label) structs of at least ``least``, best first, ties by label order."""
    named = F.array(*[F.struct(F.get(scores, F.lit(i)).alias("score"), F.lit(-i).alias("o"), F.lit(n).alias("label")) for i, n in enumerate(labels)])
    kept = F.sort_array(F.filter(named, lambda x: x["score"] >= least), asc=False)
    return F.slice(F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))), 1, k)


# ---- scores ----


def ladder(x: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """Value of the first step that ``x`` does not exceed."""
    out = F.lit(beyond)
    for limit, value in reversed(steps):
        out = F.when(x <= limit, value).otherwise(out)
    return F.when(x.isNotNull(), out)


DATE_STEPS = [(0, 1.0), (7, 0.9), (30, 0.7), (90, 0.4), (365, 0.1)]
GEO_STEPS = [(10, 1.0), (50, 0.9), (150, 0.6), (500, 0.2)]


def date_score(days: Column) -> Column:
    return ladder(F.abs(days), DATE_STEPS, 0.0)


def geo_score(km: Column) -> Column:
    """Null where a distance is not known."""
    return ladder(km, GEO_STEPS, 0.0)


def match_probability(d: Column, g_km: Column, g_name: Column, t: Column) -> Column:
    """Date 0.5, place 0.35 (coordinates 0.65 and name 0.35 of it), title 0.15; without any place 0.65 and 0.35; 0 if the dates are too far apart."""
    g = F.coalesce(0.65 * g_km + 0.35 * g_name, g_km, g_name)
    p = F.when(g.isNotNull(), 0.5 * d + 0.35 * g + 0.15 * t).otherwise(0.65 * d + 0.35 * t)
    return F.round(F.when(F.coalesce(d, F.lit(0.0)) == 0, 0.0).otherwise(p), 4)


# ---- boxes ----


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x1, y1, x2, y2."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    inter = side("x1", "x2") * side("y1", "y2")
    area = lambda s: (s["x2"] - s["x1"]) * (s["y2"] - s["y1"])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def suppress(boxes: Column, overlap: float = 0.45, least: float = 0.30, cap: int = 25) -> Column:
    """Greedy class-wise suppression over an array of structs (score, label, x1..y2): best first, a box that overlaps a kept one of its label by more than ``overlap`` goes."""
    ordered = F.sort_array(F.filter(boxes, lambda b: b["score"] >= least), asc=False)
    keep = F.aggregate(
        ordered, F.slice(ordered, 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda k: (k["label"] == b["label"]) & (iou(k, b) > overlap)), kept).otherwise(F.concat(kept, F.array(b))),
    )
    return F.slice(keep, 1, cap)


def letterbox(w: Column, h: Column, size: int) -> Column:
    """struct<scale, pad_x, pad_y> that fits a picture into a square."""
    s = F.least(size / w, size / h)
    return F.struct(s.alias("scale"), ((size - F.round(w * s)) / 2).alias("pad_x"), ((size - F.round(h * s)) / 2).alias("pad_y"))


def unletterbox(x: Column, pad: Column, scale: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(limit, (x - pad) / scale))


# ---- sky (low-precision formulas of Meeus, Astronomical Algorithms) ----

RAD = math.pi / 180


def julian_day(ts: Column) -> Column:
    """Julian day of a timestamp taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 86_400_000_000 + 2440587.5


def _mod360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def sun_position(jd: Column) -> Column:
    """struct<ra, dec> in degrees."""
    n = jd - 2451545.0
    mean = _mod360(280.460 + 0.9856474 * n)
    g = _mod360(357.528 + 0.9856003 * n) * RAD
    lon = (mean + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g)) * RAD
    eps = (23.439 - 0.0000004 * n) * RAD
    return F.struct(_mod360(F.atan2(F.cos(eps) * F.sin(lon), F.cos(lon)) / RAD).alias("ra"), (F.asin(F.sin(eps) * F.sin(lon)) / RAD).alias("dec"))


def moon_position(jd: Column) -> Column:
    """struct<ra, dec, lon> in degrees, main terms only."""
    n = jd - 2451545.0
    mean = 218.316 + 13.176396 * n
    anomaly, node = (134.963 + 13.064993 * n) * RAD, (93.272 + 13.229350 * n) * RAD
    lon, lat = (mean + 6.289 * F.sin(anomaly)) * RAD, 5.128 * F.sin(node) * RAD
    eps = 23.439 * RAD
    ra = F.atan2(F.sin(lon) * math.cos(eps) - F.tan(lat) * math.sin(eps), F.cos(lon))
    dec = F.asin(F.sin(lat) * math.cos(eps) + F.cos(lat) * math.sin(eps) * F.sin(lon))
    return F.struct(_mod360(ra / RAD).alias("ra"), (dec / RAD).alias("dec"), _mod360(lon / RAD).alias("lon"))


def alt_az(jd: Column, ra: Column, dec: Column, lat: Column, lng: Column) -> Column:
    """struct<alt, az> in degrees, azimuth from north over east."""
    gmst = _mod360(280.46061837 + 360.98564736629 * (jd - 2451545.0))
    h = (gmst + lng - ra) * RAD
    p, d = lat * RAD, dec * RAD
    alt = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(p) * F.sin(d) + F.cos(p) * F.cos(d) * F.cos(h))))
    az = F.atan2(-F.sin(h) * F.cos(d), F.sin(d) * F.cos(p) - F.cos(d) * F.cos(h) * F.sin(p))
    return F.struct((alt / RAD).alias("alt"), _mod360(az / RAD).alias("az"))


def moon_phase(jd: Column) -> Column:
    """Phase name by the moon's elongation from the sun."""
    n = jd - 2451545.0
    sun_lon = _mod360(280.460 + 0.9856474 * n + 1.915 * F.sin((357.528 + 0.9856003 * n) * RAD))
    k = F.floor(_mod360(moon_position(jd)["lon"] - sun_lon + 22.5) / 45).cast("int")
    names = ["new", "waxing crescent", "first quarter", "waxing gibbous", "full", "waning gibbous", "last quarter", "waning crescent"]
    return F.get(F.array(*[F.lit(x) for x in names]), k)


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)
