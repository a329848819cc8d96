"""Joins that plain equi-joins do not give: text, hash and vector similarity, ranges, time, snapshots."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions.numeric import cosine
from archivolt.operators.dualtree import dual_tree_join, haversine_km, usable
from archivolt.session import bounded_rows, cut_to_table

#: A side is sent to every task only below so many rows, counted first.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; the count reads no further than that."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


# ---- J1: place and time ----


def geo_range_join(left: DataFrame, right: DataFrame, km: float = 150.0, window_col: str = "window", cap: int = 50) -> DataFrame:
    """Left outer: the ``cap`` nearest right rows within ``km`` and the left row's own day window.

    Both sides have id, lat, lng, day; the left one ``window_col`` in days. A
    left row without matches keeps one row with match_count 0; match_count is
    taken before the cap. Candidates come from dual-tree joins, so no pair is
    compared that both boxes rule out: one join per class of windows (powers of
    four, 16 at most), so that a few wide windows do not widen those of all rows.
    """
    size = F.floor(F.log2(F.greatest(F.col(window_col), F.lit(0)) + 1.0) / 2).cast("int")
    classes = left.where(F.col(window_col) >= 0).groupBy(size.alias("c")).agg(F.max(window_col).alias("widest")).collect()
    # each class ends in a table, so that the driver never holds the plan of all of them
    parts = [cut_to_table(dual_tree_join(left.where((F.col(window_col) >= 0) & (size == c)), right, km, int(widest)), "near") for c, widest in sorted(classes)]
    near = reduce(DataFrame.union, parts).distinct() if parts else dual_tree_join(left.limit(0), right, km, 0)
    l = left.select(F.col("id").alias("left_id"), F.col("lat").alias("la"), F.col("lng").alias("lo"), F.col("day").alias("ld"), F.col(window_col).alias("w")).dropDuplicates(["left_id"])
    r = right.where(usable(F.col("lat"), F.col("lng"))).select(F.col("id").alias("right_id"), F.col("lat").alias("ra"), F.col("lng").alias("ro"), F.col("day").alias("rd")).dropDuplicates(["right_id"])
    pairs = near.join(l, "left_id").join(r, "right_id").withColumn("delta_days", F.abs(F.col("rd") - F.col("ld"))).where(F.col("delta_days") <= F.col("w"))
    pairs = pairs.withColumn("distance_km", F.round(haversine_km(F.col("la"), F.col("lo"), F.col("ra"), F.col("ro")), 3)).where(F.col("distance_km") <= km)
    by = Window.partitionBy("left_id")
    best = by.orderBy("distance_km", "delta_days", "right_id")
    counts = pairs.groupBy("left_id").agg(F.count(F.lit(1)).alias("match_count"))
    top = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap).select("left_id", "right_id", "distance_km", "delta_days", "rank")
    return l.select("left_id").join(counts, "left_id", "left").join(top, "left_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))


# ---- J3: TF-IDF ----


def _gram(n: int):
    """n words from a position; a closure, since a second parameter would be taken for the index."""
    return lambda i: F.array_join(F.slice("t", i, F.lit(n)), " ")


def tfidf(df: DataFrame, id_col: str, toks: Column, ngram: tuple[int, int] = (1, 2), min_df: int = 2, max_features: int = 50_000) -> DataFrame:
    """(id, term, w): 1 + ln(tf), smooth idf, unit length, over n-grams in at least ``min_df`` rows.

    The vocabulary is cut to the ``max_features`` most frequent terms (ties by
    term): that is the feature, and it is joined, not collected.
    """
    arr = df.select(F.col(id_col).alias("id"), toks.alias("t"))
    grams = []
    for n in range(ngram[0], ngram[1] + 1):
        k = F.size("t") - (n - 1)
        idx = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
        grams.append(F.transform(idx, _gram(n)))
    tf = arr.select("id", F.explode(F.concat(*grams)).alias("term")).where(F.trim("term") != "").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = df.count()
    vocab = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)
    w = tf.join(vocab, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1))
    total = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    return w.join(total, "id").select("id", "term", (F.col("w") / F.col("n")).alias("w"))


def similarity_topk(weights: DataFrame, k: int = 6, min_score: float = 0.10, queries: DataFrame | None = None, block: int = 512, probe: int = 2000) -> DataFrame:
    """(id, other, score, rank): the most similar rows by summed products of shared term weights.

    Exact, for rows of unit length. Each query first meets the rows of its
    rarest terms (about ``probe`` postings); its k-th best score there, or
    ``min_score``, is what a row must reach. The most frequent terms whose
    weights together stay below that cannot bring a row in alone, so only the
    other terms' posting lists are read (in blocks of ``block``), and only rows
    that can still reach it are scored in full. ``queries`` (id) restricts the
    left side only.
    """
    pmod = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    size = weights.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("b"))
    w = cut_to_table(weights.join(size, "term"), "weights")
    vectors = cut_to_table(w.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v")), "vectors")
    left = w if queries is None else w.join(queries.select("id").distinct(), "id", "left_semi")
    rare = Window.partitionBy("id").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, 0)
    frequent = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    left = cut_to_table(left.withColumn("met", F.sum("n").over(rare)).withColumn("upto", F.sqrt(F.sum(F.col("w") * F.col("w")).over(frequent))), "asked")
    right = w.select(F.col("id").alias("other"), "term", F.col("w").alias("wb"), pmod("id", F.col("b")).alias("s"))

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(vectors.withColumnRenamed("v", "va"), "id").join(vectors.select(F.col("id").alias("other"), F.col("v").alias("vb")), "other")
        product = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda t, x: t + F.coalesce(x["value"] * F.col("vb")[x["key"]], F.lit(0.0)))
        return both.select("id", "other", F.round(product, 3).alias("score")).where(F.col("score") >= min_score)

    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    first = left.where(F.col("met") <= probe).select("id", "term").join(right.select("other", "term"), "term").where(F.col("id") != F.col("other")).select("id", "other").distinct()
    floor = scored(first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("id", F.col("score").alias("floor"))
    # What rounds to less than the floor is below it by more than 0.0005.
    left = left.join(cut_to_table(floor, "floors"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float(min_score))) - 0.0005 - 1e-9)
    left = cut_to_table(left.withColumn("rest", F.coalesce(F.max(F.when(F.col("upto") < F.col("floor"), F.col("upto"))).over(Window.partitionBy("id")), F.lit(0.0))).where(F.col("upto") >= F.col("floor")), "asked")
    left = left.select("id", "term", F.col("w").alias("wa"), "floor", "rest", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("s"))
    pairs = left.join(right, ["term", "s"]).where(F.col("id") != F.col("other")).groupBy("id", "other").agg(F.sum(F.col("wa") * F.col("wb")).alias("part"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    pairs = scored(pairs.where(F.col("part") + F.col("rest") >= F.col("floor")).select("id", "other"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# ---- J4: Hamming ----


def hash_words(c: Column) -> Column:
    """A hex digest of 16 digits per word as an array of bigints."""
    n = F.length(c) / 16
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.conv(F.substr(c, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming_join(a: DataFrame, b: DataFrame, id_col: str, hash_col: str, max_distance: int = 16, bits: int = 256) -> DataFrame:
    """(a_id, b_id, distance) of hex hashes at most ``max_distance`` bits apart, a_id < b_id.

    With max_distance + 1 bands two such hashes agree in at least one: exact.
    Equal hashes are joined as one representative and expanded afterwards only
    between different ids, so that a hot hash does not meet itself band by band.
    """
    bands = max_distance + 1
    cuts = [round(bits * k / bands) for k in range(bands + 1)]
    binary = lambda c: F.array_join(F.transform(F.split(F.lower(c), ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    ok = F.length(hash_col) == bits // 4
    groups = lambda df: df.where(ok & F.col(id_col).isNotNull()).select(F.lower(hash_col).alias("h")).distinct()
    keyed = lambda df: df.select("h", binary(F.col("h")).alias("bin")).select("h", F.posexplode(F.array(*[F.substr("bin", F.lit(x + 1), F.lit(y - x)) for x, y in zip(cuts, cuts[1:])])).alias("band", "key"))
    left, right = keyed(groups(a)).withColumnRenamed("h", "ha"), keyed(groups(b)).withColumnRenamed("h", "hb")
    hit = left.join(right, ["band", "key"]).select("ha", "hb").distinct().withColumn("distance", hamming(hash_words(F.col("ha")), hash_words(F.col("hb")))).where(F.col("distance") <= max_distance)
    ids = lambda df, i, h: df.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).alias(i), F.lower(hash_col).alias(h)).distinct()
    return hit.join(ids(a, "a_id", "ha"), "ha").join(ids(b, "b_id", "hb"), "hb").where(F.col("a_id") < F.col("b_id")).groupBy("a_id", "b_id").agg(F.min("distance").alias("distance"))


def simhash64(df: DataFrame, id_col: str, toks: Column) -> DataFrame:
    """(id, h): 64-bit simhash of each row's tokens as 16 hex digits, from the md5 of the tokens; no tokens, no row."""
    word = df.select(F.col(id_col), F.explode(toks).alias("t")).withColumn("x", F.conv(F.left(F.md5("t"), F.lit(16)), 16, -10).cast("bigint"))
    bit = lambda k: F.sum(F.shiftrightunsigned("x", k).bitwiseAND(F.lit(1).cast("bigint")) * 2 - 1)
    votes = word.groupBy(id_col).agg(*[bit(k).alias(f"v{k}") for k in range(64)])
    bits = F.concat(*[F.when(F.col(f"v{k}") > 0, "1").otherwise("0") for k in range(63, -1, -1)])
    return votes.select(F.col(id_col), F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0")).alias("h"))


# ---- J5: exact nearest vectors ----


def knn(queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, k: int = 10, exclude_self: bool = True, block: int = 2048) -> DataFrame:
    """(q, id, score, rank): exact cosine neighbours, every query block against every corpus block.

    Queries and corpus are cut into blocks by hash; each pair of blocks is one
    matrix product, which keeps only its k best per query. All-zero and null
    vectors take no part. Ties go to the lesser id. k is clamped to 1..50.
    """
    k = max(1, min(50, k))
    idt = dict(corpus.dtypes)[id_col]

    def side(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        df = df.where(F.col(id_col).isNotNull() & F.exists(vec_col, lambda v: v != 0) & F.forall(vec_col, lambda v: v.isNotNull())).select(F.col(id_col).alias(name), F.col(vec_col).alias(f"{name}_v"))
        n = max(1, math.ceil(df.count() / block))
        return df.withColumn(f"{name}_b", F.pmod(F.xxhash64(name), F.lit(n)).cast("int")), n

    q, nq = side(queries, "q")
    c, nc = side(corpus, "c")
    q = q.select("q", "q_v", "q_b", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("c_b"))
    c = c.select("c", "c_v", "c_b", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q_b"))

    def unit(rows) -> np.ndarray:
        x = np.stack([np.asarray(r, np.float64) for r in rows])
        return x / np.linalg.norm(x, axis=1)[:, None]

    def best(key, lq: pd.DataFrame, lc: pd.DataFrame) -> pd.DataFrame:
        if not len(lq) or not len(lc):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        s = unit(lq["q_v"]) @ unit(lc["c_v"]).T
        qs, cs = lq["q"].to_numpy(), lc["c"].to_numpy()
        if exclude_self:
            s[qs[:, None] == cs[None, :]] = -9
        if s.shape[1] > k:
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            s[s < kth[:, None] - 1e-9] = -9
        i, j = np.nonzero(s > -5)
        return pd.DataFrame({"q": qs[i], "id": cs[j], "score": s[i, j]})

    found = q.groupBy("q_b", "c_b").cogroup(c.groupBy("q_b", "c_b")).applyInPandas(best, f"q {idt}, id {idt}, score double")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 6)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


# ---- J6, J9-J12, J19: lookups ----


def last_owner(records: DataFrame, id_col: str, paths: str) -> DataFrame:
    """(path, id): of the records that list a path the last one, by ``ord``, owns it."""
    return records.select(F.explode(paths).alias("path"), id_col, "ord").groupBy("path").agg(F.max_by(id_col, F.struct("ord", id_col)).alias(id_col))


def geo_supplement(df: DataFrame, name: str, cache: DataFrame) -> DataFrame:
    """Fill lat and lng: own values, else the cache entry of the exact name, else of the name in any case."""
    exact = cache.where(F.col("lat").isNotNull()).groupBy("name").agg(F.min(F.struct("lat", "lng")).alias("x"))
    loose = cache.where(F.col("lat").isNotNull()).groupBy(F.lower("name").alias("lname")).agg(F.min_by(F.struct("lat", "lng"), "name").alias("y"))
    out = df.join(sized(exact.withColumnRenamed("name", "__n")), F.col(name) == F.col("__n"), "left").join(sized(loose), F.lower(name) == F.col("lname"), "left")
    own = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    best = F.coalesce(own, "x", "y")
    return out.withColumn("__g", best).withColumns({"lat": F.col("__g.lat"), "lng": F.col("__g.lng")}).drop("__n", "x", "lname", "y", "__g")


def range_lookup(points: DataFrame, ranges: DataFrame, point: str = "n", lo: str = "lo", hi: str = "hi", bucket: int = 64) -> DataFrame:
    """Left join of each point to the first range (least lo, then hi) with lo <= point <= hi; no hit leaves nulls.

    Ranges are exploded into the buckets they cover, so the join has an equi-key
    at any size. Ranges of more than 10,000 buckets are matched by a coarser one.
    """
    out = None
    coarse = bucket * 10_000
    r = ranges.where(F.col(lo) <= F.col(hi))
    keyed = points.withColumn("__row", F.monotonically_increasing_id())
    for size, cond in ((bucket, F.col(hi) - F.col(lo) <= coarse), (coarse, F.col(hi) - F.col(lo) > coarse)):
        cells = r.where(cond).withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))
        hit = points.select(point).distinct().withColumn("__b", F.floor(F.col(point) / size)).join(cells, "__b").where((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi)))
        out = hit if out is None else out.unionByName(hit)
    best = out.groupBy(point).agg(F.min_by(F.struct(*[c for c in ranges.columns if c != point]), F.struct(lo, hi)).alias("hit"))
    return keyed.drop("__row").join(best, point, "left")


def overlap_join(a: DataFrame, b: DataFrame, bucket: int) -> DataFrame:
    """Pairs of intervals (id, start, stop) that overlap: (a_id, b_id), by shared buckets, each pair once."""
    cells = lambda df, p: df.where(F.col("start") <= F.col("stop")).select(F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}0"), F.col("stop").alias(f"{p}1"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))).alias("cell"))
    both = cells(a, "a").join(cells(b, "b"), "cell").where((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
    return both.where(F.col("cell") == F.floor(F.greatest("a0", "b0") / bucket)).select("a_id", "b_id")


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the latest right ``value`` at or before its ``ts``: one shuffle on the key, no pair explosion."""
    both = left.withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("__left", F.lit(1)).unionByName(right.select(key, ts, F.col(value).alias("__v")).withColumn("__left", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "__left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_as_of", F.last(F.when(F.col("__left") == 0, F.col("__v")), ignorenulls=True).over(w)).where(F.col("__left") == 1).drop("__v", "__left")


def nearest_k(points: DataFrame, id_col: str, x: str, y: str, k: int = 8, limit: int = 20_000) -> DataFrame:
    """(id, other, rank): the k nearest others in plane degrees, for a bounded set of cells (checked)."""
    rows = bounded_rows(points.select(id_col, x, y).orderBy(id_col), limit, "the cell set")
    spark = points.sparkSession
    ids = [r[0] for r in rows]
    xy = np.array([[r[1], r[2]] for r in rows], float).reshape(-1, 2)
    idt = dict(points.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["i"]:
                d = ((xy - xy[i]) ** 2).sum(1)
                d[i] = np.inf
                for rank, j in enumerate(np.lexsort((np.arange(len(d)), d))[: min(k, len(d) - 1)], 1):
                    out.append((ids[i], ids[j], rank))
            yield pd.DataFrame(out, columns=["id", "other", "rank"])

    return spark.range(len(ids)).withColumnRenamed("id", "i").mapInPandas(run, f"id {idt}, other {idt}, rank int")


# ---- J13-J15, J18: tables against tables ----


def memo_split(df: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached verdict, rows still to be done)."""
    return df.join(cache, key), df.join(cache.select(key), key, "left_anti")


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: str, hash_col: str) -> DataFrame:
    """(key, kind, old, new): added, removed and modified rows between two snapshots; null hashes compare as values."""
    p, c = prev.select(F.col(key).alias("k0"), F.col(hash_col).alias("old")), cur.select(F.col(key).alias("k1"), F.col(hash_col).alias("new"))
    j = p.join(c, F.col("k0") == F.col("k1"), "full_outer")
    kind = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return j.select(F.coalesce("k0", "k1").alias(key), kind.alias("kind"), "old", "new").where(F.col("kind").isNotNull())


def overlay_merge(base: DataFrame, overlay: DataFrame, key: str, refresh: list[str], curated: str) -> DataFrame:
    """Refresh listed columns from ``overlay``; base rows without a match stay only if curated; new rows come in."""
    others = [c for c in base.columns if c != key and c not in refresh]
    o = overlay.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in refresh])
    j = base.join(o, F.col(key) == F.col("__k"), "full_outer")
    kept = F.col("__k").isNotNull() | F.coalesce(F.col(curated), F.lit(False))
    return j.where(kept).select(F.coalesce(key, "__k").alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in refresh], *others)


def vector_scores(df: DataFrame, vec_col: str, query: list[float]) -> DataFrame:
    """``df`` with ``score``, the cosine to one query vector."""
    return df.withColumn("score", cosine(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query])))
