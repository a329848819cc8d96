"""Whole jobs: each case failed before the review's finding was settled."""

import numpy as np

import __spark_entry__ as entry

POINT = "id string, occurred_at string, occurred_at_precision string, location struct<lat: double, lng: double>"


def save(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_geo_range_join_covers_every_precision(spark, tmp_path):
    at = (40.0, -100.0)
    official = [("d", "2000-06-01", "day", at), ("m", "2000-06-01", "month", at), ("y", "2000-01-01", "year", at), ("y4", "2000", "Year", at), ("dec", "1990s", "decade", at), ("u", "long ago", "unknown", at), ("n", None, None, at), ("nowhere", "2000-06-01", "day", None)]
    seen = [("s1", "2000-06-03", "day", at), ("s2", "2000-06-20T10:00:00", "minute", at), ("s3", "2000-11-30", "day", at), ("s4", "1996-05-05", "day", at), ("far", "2000-06-01", "day", (50.0, -100.0))]
    save(spark, tmp_path, "correlations", official, POINT)
    save(spark, tmp_path, "sightings", seen, POINT)
    got = {r["left_id"]: r["match_count"] for r in entry.queries()["q_geo_range_join"](spark, str(tmp_path)).collect()}
    assert got == {"d": 1, "m": 2, "y": 3, "y4": 3, "dec": 1, "u": 0, "n": 0, "nowhere": 0}


def test_components_all_against_union_find(spark, tmp_path):
    rows = [(p, s, 10.0, 0.01) for p, s in [(0, 8), (9, 0), (1, 1), (1, 2), (2, 2), (3, 3), (4, 3), (5, 4), (6, 5), (6, 6), (7, 6), (7, 7), (8, 7)]] + [(p, 9, 50.0, 0.1) for p in range(100, 160)]
    save(spark, tmp_path, "lineitem", rows, "l_partkey long, l_suppkey long, l_quantity double, l_discount double")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for p, s, *_ in rows:
        a, b = root(p), root(-1 - s)
        up[max(a, b)] = min(a, b)
    got = {tuple(r) for r in entry.queries()["q_components_all"](spark, str(tmp_path)).collect()}
    assert got == {(x, root(x)) for x in up} and len({c for _, c in got}) == 7


def test_hamming_join_keeps_every_record_and_title(spark, tmp_path):
    rows = [("a", "1 blue cone over lake"), ("b", "3 blue cone over lake"), ("c", "1 blue cone over lake"), ("d", "lake over cone blue"), ("e", "silent triangle near the harbour wall"), ("f", None)]
    save(spark, tmp_path, "search_index", rows, "id string, title string")
    got = entry.queries()["q_hamming_join"](spark, str(tmp_path)).collect()
    pick = lambda kind: {(r["a_id"], r["b_id"], r["distance"], r["members"]) for r in got if r["kind"] == kind}
    assert pick("member") == {("a", x, 0, 4) for x in "abcd"} | {("e", "e", 0, 1)}
    assert pick("title") == {("a", "b", 0, 4), ("a", "d", 0, 4)}
    assert len(got) == 7 + len(pick("pair"))


def test_iterative_graph_queries_run_to_their_end(spark, tmp_path):
    rows = [(p, p % 7 + s, 1.0) for p in range(110) for s in (0, 1)]
    save(spark, tmp_path, "lineitem", rows, "l_partkey long, l_suppkey long, l_quantity double")
    q = entry.queries()
    assert q["q_layout"](spark, str(tmp_path)).count() == 118
    score = {r["id"]: r["score"] for r in q["q_eigenvector"](spark, str(tmp_path)).collect()}
    names = sorted(score)
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for p, s, _ in rows:
        m[at[f"p{p}"], at[f"s{s}"]] = m[at[f"s{s}"], at[f"p{p}"]] = 1
    want = np.abs(np.linalg.eigh(m)[1][:, -1])
    assert max(abs(score[n] - want[at[n]]) for n in names) < 2e-6
