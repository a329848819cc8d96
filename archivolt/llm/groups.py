"""Pairwise matches to groups: union-find in edge partitions, forests merged in rounds.

Each round hashes the edges over bounded partitions, runs union-find inside
every partition and keeps only its spanning forest as stars (node, root), the
root being the tree's node of least priority. Priorities are hashes that are new
in every round. A node points to the root of least priority that any of its
stars names, and the forests are contracted along these pointers: an edge of a
forest becomes a link between two pointed-at nodes, or vanishes. Since each node
points at least as low as its lowest neighbour, and priorities are random, a
round leaves about two thirds of the nodes or fewer whatever the shape of the
graph - a chain is no worse than a star - so the number of rounds is logarithmic
in edges / ``per_part``. The merged forests go into ever fewer partitions; the
last round has one of bounded size. Then the pointers are resolved from the last
round to the first. Partitions are by hash of whole edges, so a node or group
that holds a third of all rows is spread evenly; the driver holds counts only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.session import cut_to_table, shuffle_parts, table

STAR = "node string, root string, priority bigint"
#: Edges one partition may hold: their nodes are one task's dictionary.
PER_PART = 500_000


def union_find(edges: Iterator[tuple[str, str]], priority: Callable[[str], object] = lambda x: x) -> dict[str, str]:
    """node -> node of least ``priority`` of its component, for every node seen."""
    no: dict[str, int] = {}
    up: list[int] = []

    def root(k: int) -> int:
        top = k
        while up[top] != top:
            top = up[top]
        while up[k] != top:
            up[k], k = top, up[k]
        return top

    for a, b in edges:
        i, j = no.setdefault(a, len(no)), no.setdefault(b, len(no))
        up.extend(range(len(up), len(no)))
        p, q = root(i), root(j)
        if p != q:
            up[max(p, q)] = min(p, q)
    least: dict[int, tuple] = {}
    for x, k in no.items():
        r, me = root(k), (priority(x), x)
        if r not in least or me < least[r]:
            least[r] = me
    return {x: least[root(k)][1] for x, k in no.items()}


def spanning_forest(edges: DataFrame, parts: int, turn: int = 0) -> DataFrame:
    """Stars (node, root) of each of ``parts`` edge partitions; each root also has a row of its own."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        order = lambda x: xxhash.xxh64_intdigest(x, turn) - (1 << 63)
        rows = list(union_find(pairs, order).items())
        for k in range(0, len(rows), 50_000):
            nodes, roots = zip(*rows[k : k + 50_000])
            yield pa.record_batch([pa.array(nodes, pa.string()), pa.array(roots, pa.string()), pa.array([order(x) for x in roots], pa.int64())], names=["node", "root", "priority"])

    return edges.select("a", "b").repartition(parts, F.xxhash64("a", "b", F.lit(turn))).mapInArrow(forest, STAR)


def connected_groups(edges: DataFrame, per_part: int = PER_PART, fan_in: int = 8, rounds: list | None = None) -> DataFrame:
    """(id, cluster_id) for every id that is linked to another one.

    ``edges`` has string columns a and b; nulls and self pairs are no links,
    direction and repeats do not matter. ``cluster_id`` is the least id of the
    group in string order. ``per_part`` bounds the edges of a partition. No
    edges: no rows. ``rounds``, if given, gets (edges, partitions) of each round.
    A round that removes no node raises.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = cut_to_table(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    n = e.count()
    parts = max(shuffle_parts(edges.sparkSession), math.ceil(n / per_part))
    done: list[DataFrame] = []
    nodes_before = None
    for turn in itertools.count():
        if rounds is not None:
            rounds.append((n, parts))
        star = cut_to_table(spanning_forest(e, parts, turn), "stars")
        if parts == 1:
            break
        up = cut_to_table(star.groupBy("node").agg(F.min(F.struct("priority", "root")).getField("root").alias("m")), "up")
        nodes = up.count()
        if nodes_before is not None and nodes >= nodes_before:
            raise RuntimeError(f"round {turn} removed none of {nodes} nodes")
        nodes_before = nodes
        done.append(up)
        # A root may be that of a third of all nodes; the star side is the one that adaptive execution splits.
        links = star.where(F.col("node") != F.col("root")).join(up, "node").select("root", F.col("m").alias("a")).join(up.select(F.col("node").alias("root"), F.col("m").alias("b")), "root")
        e = cut_to_table(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        n = e.count()
        parts = max(parts // fan_in, math.ceil(n / per_part), 1)
    labels = star.select(F.col("node").alias("id"), F.col("root").alias("label"))
    for up in reversed(done):
        # What a node pointed to may have no edges left and so no label: it is its own.
        to = labels.select(F.col("id").alias("m"), "label")
        labels = cut_to_table(up.join(to, "m", "left").select(F.col("node").alias("id"), F.coalesce("label", "m").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("id").alias("cluster_id"))
    return labels.join(least, "label").select("id", "cluster_id")


def colon_id(c: Column) -> Column:
    """Ids with ``:`` after the source: of a civilian id the first ``:`` may be written ``_``."""
    return F.regexp_replace(F.trim(c), r"^([^:_\-]+)_", "$1:")


def match_groups(pairs: DataFrame, least_score: float = 0.65) -> DataFrame:
    """Groups over scored pairs (id_a, id_b, match_score); null scores are no links."""
    ok = pairs.where(F.col("match_score") >= least_score)
    return connected_groups(ok.select(colon_id(F.col("id_a")).alias("a"), colon_id(F.col("id_b")).alias("b")))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Group id of every linked record or sighting."""
    return match_groups(table(spark, sf_dir, "match_pairs"))


QUERIES = {"p5_found": p5_found}
ORACLE = {
    "p5_found": r"""
WITH RECURSIVE e AS (
  SELECT regexp_replace(trim(id_a), '^([^:_\-]+)_', '\1:') AS a, regexp_replace(trim(id_b), '^([^:_\-]+)_', '\1:') AS b
  FROM match_pairs WHERE match_score >= 0.65),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r(id, other) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a)
SELECT id, min(least(id, other)) AS cluster_id FROM r GROUP BY id""",
}
