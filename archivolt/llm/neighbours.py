"""Most similar vectors for every vector: a forest of random-projection trees.

The trees are fitted on a bounded sample of ``fit_rows`` rows; every row is
indexed. A query descends all trees at once through one priority queue ordered
by the largest margin it had to cross, until ``visits`` leaves are reached;
rows that meet in a leaf are compared exactly (one matrix product a leaf).

Leaves hold about ``leaf_rows`` rows at any size: a leaf that holds more than
twice as many gets a tree of its own, fitted on a sample of at most ``fit_rows``
of its rows, in its own task. A query goes on into these trees from the margin
it came with, and of all leaves reached keeps the ``visits`` of least margin -
the ones the shared queue would have reached first. Neighbouring leaves of a
tree lie together in one task, so that a vector is sent once for several of
them. Exact copies are one node each, carrying the few least ids that can be
anyone's neighbour.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from archivolt.operators.joins import sized
from archivolt.session import cut_to_table, table

FIT_ROWS, TREES, VISITS, LEAF_ROWS, BLOCK_ROWS = 8192, 4, 10, 256, 4096


def fit_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list:
    """Nodes (normal, offset, left, right) or None for a leaf; the root is node 0."""
    nodes: list = []

    def build(idx: np.ndarray) -> int:
        me = len(nodes)
        nodes.append(None)
        if len(idx) <= leaf:
            return me
        i, j = rng.choice(idx, 2, replace=False)
        a, b = x[i], x[j]
        for _ in range(4):  # a projection between two groups of a few rows cuts less through clusters
            few = x[rng.choice(idx, min(len(idx), 64), replace=False)]
            near = few @ a > few @ b
            if near.all() or not near.any():
                break
            a, b = few[near].mean(0), few[~near].mean(0)
        w = a - b
        norm = np.linalg.norm(w)
        if norm < 1e-6:
            w = rng.standard_normal(x.shape[1]).astype(np.float32)
            norm = np.linalg.norm(w)
        w = (w / norm).astype(np.float32)
        p = x[idx] @ w
        off = float(np.median(p))
        left, right = idx[p <= off], idx[p > off]
        if len(left) == 0 or len(right) == 0:
            return me
        nodes[me] = (w, off, build(left), build(right))
        return me

    build(np.arange(len(x)))
    return nodes


class Forest:
    """Fitted trees; leaves and buckets (runs of neighbouring leaves) are numbered across all trees."""

    def __init__(self, x: np.ndarray, trees: int, leaf: int, per_bucket: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, normals, offs, self.leaf_no, self.bucket = [], [], [], {}, []
        for t in range(trees):
            nodes = fit_tree(x, leaf, rng)
            plain = []
            for k, n in enumerate(nodes):
                if n is None:
                    self.leaf_no[t, k] = len(self.leaf_no)
                    plain.append(None)
                else:
                    plain.append((len(normals), n[2], n[3]))
                    normals.append(n[0])
                    offs.append(n[1])
            # nodes are numbered depth first, so leaves in a row are neighbours
            mine = sum(n is None for n in nodes)
            first = self.bucket[-1] + 1 if self.bucket else 0
            self.bucket += [first + i // per_bucket for i in range(mine)]
            self.trees.append(plain)
        self.w = np.stack(normals) if normals else np.zeros((0, x.shape[1]), np.float32)
        self.off = np.array(offs, np.float32)

    def route(self, x: np.ndarray, visits: int, start: list[float] | None = None) -> list[list[tuple[int, float, bool]]]:
        """(leaf, largest margin crossed, whether it is the row's own leaf in its tree) of each row, in the queue's order."""
        margins = (x @ self.w.T - self.off) if len(self.off) else np.zeros((len(x), 0), np.float32)
        out = []
        for r, m in enumerate(margins):
            m = m.tolist()
            base = start[r] if start else 0.0
            queue = [(base, 0, t, 0) for t in range(len(self.trees))]
            seen: list[tuple[int, float, bool]] = []
            while queue and len(seen) < max(visits, len(self.trees)):
                far, off, t, k = heapq.heappop(queue)
                node = self.trees[t][k]
                while node is not None:
                    d = m[node[0]]
                    near, other = (node[2], node[1]) if d > 0 else (node[1], node[2])
                    heapq.heappush(queue, (max(far, abs(d)), 1, t, other))
                    k, node = near, self.trees[t][near]
                seen.append((self.leaf_no[t, k], far, off == 0))
            out.append(seen)
        return out


def _unit(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def nodes_of(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct vectors as (node, ids, d, h) without the vectors, the vectors (node, vector) of all ids, and the node of every id.

    Null, empty and all-zero vectors, and vectors with a null, NaN or infinite
    element, count nowhere. An id with several vectors keeps the greatest by
    run name, then by vector. ``ids`` are the k + 1 least ids of a node, the
    first of which names it. Copies are told by 128 bits of hash; the vectors
    themselves are shuffled once.
    """
    infinite = F.lit(float("inf")).cast("float")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite)
    clean = vectors.where(F.col("id").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda v: v != 0) & F.forall("vector", fine))
    clean = clean.select("id", "model_run", "vector")
    light = clean.select("id", "model_run", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")).distinct()
    several = sized(cut_to_table(light.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("id"), "several"))
    best = clean.join(several, "id", "left_semi").groupBy("id").agg(F.max(F.struct("model_run", "vector")).getField("vector").alias("vector"))
    one = clean.join(several, "id", "left_anti").select("id", "vector").unionByName(best)
    ids = cut_to_table(one.select("id", F.size("vector").alias("d"), F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")).distinct(), "ids")
    few = ids.withColumn("rn", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("rn") <= k + 1)  # cut before the shuffle too
    named = cut_to_table(few.groupBy("h", "g").agg(F.first("d").alias("d"), F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("node"), "ids", "d", "h", "g"), "named")
    # Ids beyond the first k + 1 of a node; few nodes are that large, and the larger side is split by adaptive execution.
    rest = ids.join(named.where(F.size("ids") > k).select("h", "g", "node"), ["h", "g"]).select("id", "node")
    member = named.select(F.explode("ids").alias("id"), "node").unionByName(rest).distinct()
    return named, one.withColumnRenamed("id", "node"), member


@F.pandas_udf(T.BinaryType())
def unit(v: pd.Series) -> pd.Series:
    def norm(a):
        a = np.asarray(a, np.float64)
        return (a / np.linalg.norm(a)).astype(np.float32).tobytes()

    return v.map(norm)


LEAVES = "array<struct<leaf:bigint,bucket:bigint,far:double,home:boolean,whole:boolean>>"


def deeper(routed: DataFrame, big: DataFrame, visits: int, fit_rows: int, leaf_rows: int, block_rows: int) -> DataFrame:
    """``routed`` with the leaves in ``big`` (leaf, m) replaced by those of a tree fitted in each.

    A leaf whose rows cannot be told apart stays and is marked ``whole``.
    """
    at = routed.select("node", "unit", F.explode("leaves").alias("x")).select("node", "unit", "x.*").join(big, "leaf")
    some = at.where(F.col("home")).withColumn("o", F.xxhash64("node", "leaf"))
    some = some.where(F.pmod("o", F.lit(1_000_000)) < (1.3 * fit_rows / F.col("m") + 0.001) * 1_000_000)
    some = some.withColumn("rn", F.row_number().over(Window.partitionBy("leaf").orderBy("o", "node"))).where(F.col("rn") <= fit_rows)

    def fit(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["m"].iloc[0])
        f = Forest(_unit(list(pdf["unit"])), 1, max(4, math.ceil(len(pdf) * leaf_rows / m)), max(1, block_rows // leaf_rows), seed=abs(keys[0]) % 2**32)
        return pd.DataFrame({"leaf": [keys[0]], "tree": [pickle.dumps(f)]})

    trees = cut_to_table(some.select("leaf", "unit", "m").groupBy("leaf").applyInPandas(fit, "leaf bigint, tree binary"), "trees")
    # All who visit a leaf, in chunks that each get its tree.
    chunks = cut_to_table(at.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("k")), "chunks")
    asked = at.join(chunks, "leaf").withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).select("leaf", "c", "node", "unit", "far", "home")
    spread = trees.join(chunks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"), "tree")

    def descend(keys: tuple, q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q):
            forest = pickle.loads(t["tree"].iloc[0])
            whole = len(forest.leaf_no) == 1
            name = lambda *x: xxhash.xxh64_intdigest(repr((keys[0], *x))) - (1 << 63)
            for node, home, seen in zip(q["node"], q["home"], forest.route(_unit(list(q["unit"])), visits, q["far"].tolist())):
                out += [(node, name("leaf", no), name("bucket", forest.bucket[no]), far, bool(home and own), whole) for no, far, own in seen]
        return pd.DataFrame(out, columns=["node", "leaf", "bucket", "far", "home", "whole"])

    flat = "node string, leaf bigint, bucket bigint, far double, home boolean, whole boolean"
    new = asked.groupBy("leaf", "c").cogroup(spread.groupBy("leaf", "c")).applyInPandas(descend, flat)
    old = routed.select("node", F.explode("leaves").alias("x")).select("node", "x.*").join(big.select("leaf"), "leaf", "left_anti").select(*[c.split()[0] for c in flat.split(", ")])
    # Own leaves are kept whatever their place: every row stays indexed in every tree.
    ordered = Window.partitionBy("node").orderBy("far", F.desc("home"), "leaf")
    kept = old.unionByName(new).withColumn("rn", F.row_number().over(ordered)).where((F.col("rn") <= visits) | F.col("home"))
    leaves = kept.groupBy("node").agg(F.collect_list(F.struct("leaf", "bucket", "far", "home", "whole")).alias("leaves"))
    return cut_to_table(routed.drop("leaves").join(leaves, "node"), "routed")


def route_all(nodes: DataFrame, fit: list[bytes], n: int, trees: int, visits: int, fit_rows: int, leaf_rows: int, block_rows: int) -> DataFrame:
    """``nodes`` (node, unit) with the leaves that each reaches; none holds much more than ``leaf_rows`` rows unless they are alike."""
    spark = nodes.sparkSession
    forest = spark.sparkContext.broadcast(Forest(_unit(fit), trees, max(4, math.ceil(len(fit) * leaf_rows / n)), max(1, block_rows // leaf_rows)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = forest.value
        for pdf in batches:
            if len(pdf):
                got = f.route(_unit(list(pdf["unit"])), visits)
                yield pdf.assign(leaves=[[{"leaf": no, "bucket": f.bucket[no], "far": far, "home": own, "whole": False} for no, far, own in seen] for seen in got])

    routed = cut_to_table(nodes.mapInPandas(route, f"node string, unit binary, leaves {LEAVES}"), "routed")
    while True:
        held = routed.select(F.explode("leaves").alias("x")).where(F.col("x.home") & ~F.col("x.whole")).groupBy("x.leaf").agg(F.count(F.lit(1)).alias("m"))
        big = cut_to_table(held.where(F.col("m") > 2 * leaf_rows), "big")
        if big.isEmpty():
            return routed
        routed = deeper(routed, big, visits, fit_rows, leaf_rows, block_rows)


def similar_nodes(nodes: DataFrame, vectors: DataFrame, k: int, least: float, trees: int = TREES, visits: int = VISITS, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, compared: list | None = None) -> DataFrame:
    """(node, other, cos): for each node its k most similar other nodes found, cosine at least ``least``.

    Vectors of different lengths are not compared; each length has its own
    index. ``compared``, if given, gets the row comparisons of each length.
    """
    spark = nodes.sparkSession
    schema = "node string, other string, cos double"
    links = []
    for r in nodes.groupBy("d").count().orderBy("d").collect():
        n = r["count"]
        mine = nodes.where(F.col("d") == r["d"])
        # Rows by least hash; the share is cut first, so that all tasks together send about fit_rows rows to the driver.
        share = int(min(1.0, 1.3 * fit_rows / n + 0.001) * 1_000_000)
        some = mine.where(F.pmod("h", F.lit(1_000_000)) < share).orderBy("h", "node").limit(fit_rows).select("node")
        if some.isEmpty():
            some = mine.orderBy("h", "node").limit(fit_rows).select("node")
        # at most fit_rows names
        sample = vectors.join(F.broadcast(some), "node").dropDuplicates(["node"]).orderBy("node").select(unit("vector").alias("unit"))
        fit = [bytes(x["unit"]) for x in sample.collect()]
        # copies of a row lie together after the join: the vectors are shuffled once
        full = vectors.join(mine.select("node", "ids"), "node").groupBy("node").agg(F.first("vector").alias("vector"))
        routed = route_all(full.select("node", unit("vector").alias("unit")), fit, n, trees, visits, fit_rows, leaf_rows, block_rows)
        links.append(_compare(routed, k, least, block_rows, schema))
        if compared is not None:
            x = routed.select(F.explode("leaves").alias("x")).groupBy("x.leaf").agg(F.count(F.lit(1)).alias("v"), F.count_if("x.home").alias("h"))
            compared.append(x.agg(F.sum(F.col("v") * F.col("h"))).first()[0])
    return reduce(DataFrame.unionByName, links) if links else spark.createDataFrame([], schema)


def _compare(routed: DataFrame, k: int, least: float, block_rows: int, schema: str) -> DataFrame:
    # Leaves of rows that are all alike may be large; they go by chunks, of which each visitor meets every one.
    held = routed.select(F.explode("leaves").alias("x")).where("x.whole").groupBy("x.leaf").agg(F.count_if("x.home").alias("m"))
    large = cut_to_table(held.where(F.col("m") > block_rows).select("leaf", F.ceil(F.col("m") / block_rows).cast("int").alias("k")), "large")
    slim = lambda x: F.struct(x["leaf"].alias("leaf"), x["home"].alias("home"))
    buckets = F.transform(F.array_distinct(F.transform("leaves", lambda x: x["bucket"])), lambda b: F.struct(b.alias("bucket"), F.transform(F.filter("leaves", lambda x: x["bucket"] == b), slim).alias("leaves")))
    at = routed.select("node", "unit", F.explode(buckets).alias("x")).select("node", "unit", F.col("x.bucket").alias("bucket"), F.lit(-1).alias("chunk"), F.col("x.leaves").alias("leaves"))
    if not large.isEmpty():
        hot = routed.select("node", "unit", F.explode("leaves").alias("x")).select("node", "unit", "x.leaf", "x.home").join(large, "leaf")
        hot = hot.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        hot = hot.select("node", "unit", F.col("leaf").alias("bucket"), "chunk", F.array(F.struct("leaf", (F.col("home") & (F.col("own") == F.col("chunk"))).alias("home"))).alias("leaves"))
        rest = at.select("*", F.explode("leaves").alias("x")).join(large, F.col("x.leaf") == F.col("leaf"), "left_anti")
        at = rest.select("node", "unit", "bucket", "chunk", F.array("x").alias("leaves")).unionByName(hot)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = pdf["node"].to_numpy(object), _unit(list(pdf["unit"]))
        visit: dict[int, list[int]] = {}
        home: dict[int, list[int]] = {}
        for r, leaves in enumerate(pdf["leaves"]):
            for e in leaves:
                visit.setdefault(e["leaf"], []).append(r)
                if e["home"]:
                    home.setdefault(e["leaf"], []).append(r)
        out = []
        for leaf, held in home.items():
            held, asks = np.array(held), np.array(visit[leaf])
            for a in range(0, len(asks), 512):
                q = asks[a : a + 512]
                s = x[q] @ x[held].T
                s[names[q][:, None] == names[held][None, :]] = -2
                if s.shape[1] > k:
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    s[s < kth[:, None] - 1e-6] = -2  # ties with the k-th stay
                i, j = np.nonzero(s >= least - 1e-6)
                # exact again, in double precision
                c = np.einsum("ij,ij->i", x[q[i]].astype(np.float64), x[held[j]].astype(np.float64)) if len(i) else np.zeros(0)
                out.append(pd.DataFrame({"node": names[q[i]], "other": names[held[j]], "cos": c}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "other": [], "cos": []})

    found = at.groupBy("bucket", "chunk").applyInPandas(compare, schema).where(F.col("cos") >= least)
    found = found.groupBy("node", "other").agg(F.max("cos").alias("cos"))
    best = Window.partitionBy("node").orderBy(F.desc("cos"), "other")
    return found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")


def most_similar(vectors: DataFrame, k: int = 5, least: float = -1.0, **search) -> DataFrame:
    """(id, other, cos, rank): the k most similar other ids of every id.

    ``vectors`` has id, vector, model_run. Ties go to the lesser id. Copies of
    a vector are each other's neighbours with cosine 1. An id with no other
    vector of cosine ``least`` gives no row; so does an empty table.
    """
    nodes, rows, member = nodes_of(vectors, k)
    links = similar_nodes(nodes, rows, k, least, **search)
    pool = links.join(nodes.select(F.col("node").alias("other"), F.col("ids").alias("them")), "other").select("node", F.explode("them").alias("other"), "cos")
    own = nodes.where(F.size("ids") > 1).select("node", F.explode("ids").alias("other"), F.lit(1.0).alias("cos"))
    best = Window.partitionBy("node").orderBy(F.desc("cos"), "other")
    pool = pool.unionByName(own).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    pool = pool.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rn", "other", "cos"))).alias("pool"))
    got = member.join(pool, "node").select("id", F.slice(F.filter("pool", lambda p: p["other"] != F.col("id")), 1, k).alias("pool"))
    return got.select("id", F.posexplode("pool").alias("at", "x")).select("id", F.col("x.other").alias("other"), F.col("x.cos").alias("cos"), (F.col("at") + 1).alias("rank"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of ids where one is among the 5 most similar of the other, cosine at least 0.75."""
    got = most_similar(table(spark, sf_dir, "text_vectors"), 5, 0.75)
    return got.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


QUERIES = {"p3_found": p3_found}
ORACLE = {
    "p3_found": """
WITH v AS (SELECT id, arg_max(vector, (coalesce(model_run, ''), vector))::DOUBLE[] AS x FROM text_vectors
  WHERE id IS NOT NULL AND len(vector) > 0 AND list_sum(list_transform(vector, lambda y: abs(y::DOUBLE))) > 0 GROUP BY id),
s AS (SELECT a.id AS q, b.id AS o, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT q, o FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, o) AS rn FROM s WHERE c >= 0.75) WHERE rn <= 5)
SELECT DISTINCT least(q, o) AS id_a, greatest(q, o) AS id_b FROM t""",
}
