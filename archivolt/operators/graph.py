"""Entity and citation graphs: edges, communities, centralities, layout."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.session import cut_to_table, drop_table


def merge_edges(edges: DataFrame, how: str = "sum", cap: float | None = None) -> DataFrame:
    """One undirected edge (src < dst) per pair; weights added (capped) or the greatest kept. Self edges go."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    w = F.max("weight") if how == "max" else F.sum("weight")
    return e.groupBy("src", "dst").agg((F.least(w, F.lit(cap)) if cap is not None else w).alias("weight"))


def build_graph(entities: DataFrame, citations: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of records and entities.

    entities (record_id, entity_id, count): weights add. citations (from_id,
    to_id, count): add, 5 at most. near (left_id, right_id, distance_km,
    delta_days): nearness in place and time, the greatest kept; distance and
    days of 0 count as 0, and the sign of the days does not matter.
    """
    ent = merge_edges(entities.select(F.concat(F.lit("record:"), "record_id").alias("src"), F.concat(F.lit("entity:"), "entity_id").alias("dst"), F.col("count").cast("double").alias("weight")))
    cit = merge_edges(citations.select(F.concat(F.lit("record:"), "from_id").alias("src"), F.concat(F.lit("record:"), "to_id").alias("dst"), F.col("count").cast("double").alias("weight")), cap=5.0)
    closeness = (1 - F.least(F.lit(1.0), F.coalesce("distance_km", F.lit(150.0)) / 150)) * 0.5 + (1 - F.least(F.lit(1.0), F.abs(F.coalesce("delta_days", F.lit(30))) / 30)) * 0.5
    geo = merge_edges(near.select(F.concat(F.lit("record:"), "left_id").alias("src"), F.concat(F.lit("record:"), "right_id").alias("dst"), closeness.alias("weight")), "max")
    edges = merge_edges(ent.unionByName(cit).unionByName(geo.where(F.col("weight") > 0)))
    vertices = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct().withColumn("node_type", F.regexp_extract("id", "^([^:]*)", 1))
    return vertices, edges


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree, strength, centrality): neighbours, summed weights, degree / (n - 1)."""
    d = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("degree"), F.sum("weight").alias("strength"))
    n = d.count()
    return d.withColumn("centrality", F.col("degree") / F.lit(max(1, n - 1)))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, out, in) of a directed edge table (src, dst); empty sides are null."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("in"))
    return out.join(into, "id", "full_outer")


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(community, q) summands of weighted modularity; their sum is the modularity."""
    m = membership.select("id", "community")
    e = edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    inside = e.where(F.col("cs") == F.col("cd")).groupBy(F.col("cs").alias("community")).agg((2 * F.sum("weight")).alias("inside"))
    deg = both_ways(edges).join(m.withColumnRenamed("id", "src"), "src").groupBy("community").agg(F.sum("weight").alias("deg"))
    two_m = F.lit(deg.agg(F.sum("deg")).first()[0] or 1.0)
    return deg.join(inside, "community", "left").select("community", (F.coalesce("inside", F.lit(0.0)) / two_m - resolution * F.pow(F.col("deg") / two_m, 2)).alias("q"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by weighted label propagation, ties to the least label.

    A documented stand-in for greedy modularity communities, which are neither
    distributed nor comparable bit for bit. Half of the nodes, by hash, move in
    each round, so that pairs do not swap labels for ever. Stops when no node of
    either half would move.
    """
    e = cut_to_table(both_ways(edges), "edges")
    lab = cut_to_table(e.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct(), "labels")
    for k in range(rounds):
        votes = e.join(lab.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("new"))
        nxt = lab.join(best, "id", "left").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0)
        nxt = nxt.select("id", F.when(F.col("turn"), F.coalesce("new", "community")).otherwise(F.col("community")).alias("community"), (F.col("new") != F.col("community")).alias("moved"))
        nxt = cut_to_table(nxt, "labels")
        lab = nxt.select("id", "community")
        if nxt.where("moved").limit(1).count() == 0:
            break
    return lab


#: Rows of edges, both ways, that the rounds between two tables of the power iteration shuffle at most (one round at least).
ROUND_ROWS = 10_000_000


def eigenvector(edges: DataFrame, rounds: int = 500, tol: float = 1e-9) -> DataFrame:
    """(id, score) by power iteration on A + sI, unit length.

    The shift s, the mean strength, keeps bipartite graphs from swinging and
    does not change the vector. Every five rounds the vector is scaled; it has
    settled when that moved it by at most ``tol`` in length. Warns if ``rounds``
    end first. Nodes are numbered, tables of past rounds are dropped and large
    graphs write one each round, so disk does not grow with the rounds.
    """
    names = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    names = cut_to_table(names.withColumn("k", F.monotonically_increasing_id()), "nodes")
    end = lambda c: names.select(F.col("id").alias(c), F.col("k").alias(f"{c}_k"))
    numbered = edges.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_k").alias("src"), F.col("dst_k").alias("dst"), "weight")
    e = cut_to_table(both_ways(cut_to_table(numbered, "edges")), "edges")
    v = names.select(F.col("k").alias("id"), F.lit(1.0).alias("x"))
    shift = float(e.groupBy("src").agg(F.sum("weight").alias("s")).agg(F.avg("s")).first()[0] or 1.0)
    every = max(1, min(5, ROUND_ROWS // max(1, e.count())))
    old, k, moved, held = v, 0, None, []
    while k < rounds:
        steps = min(5, rounds - k)
        for n in range(1, steps + 1):
            v = e.join(v.select(F.col("id").alias("dst"), "x"), "dst").select(F.col("src").alias("id"), (F.col("weight") * F.col("x")).alias("x")).union(v.select("id", (shift * F.col("x")).alias("x"))).groupBy("id").agg(F.sum("x").alias("x"))
            if n == steps or n % every == 0:
                v = cut_to_table(v, "eigen")
                held.append(v)
        k += steps
        n = v.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        v = v.withColumn("x", F.col("x") / n)
        moved = v.join(old.withColumnRenamed("x", "o"), "id").agg(F.sqrt(F.sum((F.col("x") - F.col("o")) * (F.col("x") - F.col("o"))))).first()[0]
        while len(held) > 1:
            drop_table(held.pop(0))
        if moved is None or moved <= tol:
            break
        old = v
    else:
        warnings.warn(f"eigenvector: not settled after {rounds} rounds, last change {moved}", stacklevel=2)
    return v.withColumnRenamed("id", "k").join(names, "k").select("id", F.col("x").alias("score"))


def betweenness_top(edges: DataFrame, top: int = 100) -> DataFrame:
    """(id, betweenness) on the graph induced by the ``top`` nodes of highest degree, weights as distances.

    At most ``top`` nodes and ``top``² / 2 edges reach the one task that runs
    Brandes' algorithm.
    """
    d = degree(edges).orderBy(F.desc("degree"), "id").limit(top).select("id")
    sub = edges.join(F.broadcast(d.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(d.withColumnRenamed("id", "dst")), "dst", "left_semi")
    rows = sub.select("src", "dst", "weight").unionByName(d.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight")))

    def brandes(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        nodes = sorted(set(pdf["src"]))
        near: dict = {n: {} for n in nodes}
        for s, t, w in pdf.itertuples(index=False):
            if s != t:
                near[s][t] = near[t][s] = max(float(w), 1e-9)
        score = dict.fromkeys(nodes, 0.0)
        for s in nodes:
            dist, sigma, prev, done = {s: 0.0}, {s: 1.0}, {s: []}, []
            heap, closed = [(0.0, s)], set()
            while heap:
                x, v = heapq.heappop(heap)
                if v in closed:
                    continue
                closed.add(v)
                done.append(v)
                for u, w in near[v].items():
                    y = x + w
                    if u not in dist or y < dist[u] - 1e-12:
                        dist[u], sigma[u], prev[u] = y, sigma[v], [v]
                        heapq.heappush(heap, (y, u))
                    elif abs(y - dist[u]) <= 1e-12 and u not in closed:
                        sigma[u] += sigma[v]
                        prev[u].append(v)
            delta = dict.fromkeys(done, 0.0)
            for v in reversed(done):
                for u in prev[v]:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
                if v != s:
                    score[v] += delta[v]
        n = len(nodes)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return pd.DataFrame({"id": nodes, "betweenness": [score[x] * scale for x in nodes]})

    idt = dict(edges.dtypes)["src"]
    return rows.groupBy(F.lit("all").alias("g")).applyInPandas(lambda p: brandes(p[["src", "dst", "weight"]]), f"id {idt}, betweenness double")


def force_layout(edges: DataFrame, top: int = 1000, rounds: int = 220, width: float = 1400, height: float = 900, seed: int = 42) -> DataFrame:
    """(id, x, y): seeded spring layout of the ``top`` nodes of highest degree, O(top²) a round by design."""
    d = degree(edges).orderBy(F.desc("degree"), "id").limit(top).select("id")
    sub = edges.join(F.broadcast(d.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(d.withColumnRenamed("id", "dst")), "dst", "left_semi")
    rows = sub.select("src", "dst").union(d.select(F.col("id").alias("src"), F.col("id").alias("dst")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["src"]))
        at = {n: i for i, n in enumerate(nodes)}
        pairs = np.array([(at[s], at[t]) for s, t in zip(pdf["src"], pdf["dst"]) if s != t], int).reshape(-1, 2)
        rng = np.random.default_rng(seed)
        p = rng.uniform(0, 1, (len(nodes), 2)) * [width, height]
        k = np.sqrt(width * height / max(1, len(nodes)))
        for r in range(rounds):
            diff = p[:, None] - p[None]
            dist = np.maximum(np.sqrt((diff**2).sum(-1)), 0.01)
            move = (diff / dist[..., None] ** 2 * k * k).sum(1)
            if len(pairs):
                e = p[pairs[:, 0]] - p[pairs[:, 1]]
                pull = e * np.sqrt((e**2).sum(-1, keepdims=True)) / k
                np.subtract.at(move, pairs[:, 0], pull)
                np.add.at(move, pairs[:, 1], pull)
            size = np.maximum(np.sqrt((move**2).sum(-1, keepdims=True)), 0.01)
            p = np.clip(p + move / size * np.minimum(size, width / 10 * (1 - r / rounds)), 0, [width, height])
        return pd.DataFrame({"id": nodes, "x": p[:, 0].round(3), "y": p[:, 1].round(3)})

    idt = dict(edges.dtypes)["src"]
    return rows.groupBy(F.lit("all").alias("g")).applyInPandas(lambda q: run(q[["src", "dst"]]), f"id {idt}, x double, y double")
