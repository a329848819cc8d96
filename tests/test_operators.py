import pytest
import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from archivolt.functions import text
from archivolt.operators import graph, joins, linkage, retrieval, spatial, topics


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_geo_range_join_is_left_outer(spark):
    l = spark.createDataFrame([("a", 0.0, 1.0, 100, 3), ("b", 60.0, 60.0, 100, 3), ("c", None, 1.0, 100, 3), ("d", 0.0, 1.0, 100, 30)], "id string, lat double, lng double, day int, window int")
    r = spark.createDataFrame([(f"r{k:02}", 0.0, 1.0 + k * 0.01, 101) for k in range(60)] + [("late", 0.0, 1.0, 120), ("far", 0.0, 2.36, 100)], "id string, lat double, lng double, day int")
    got = joins.geo_range_join(l, r).collect()
    by = {}
    for x in got:
        by.setdefault(x["left_id"], []).append(x)
    assert by["b"][0]["match_count"] == 0 and by["b"][0]["right_id"] is None and by["c"][0]["match_count"] == 0
    assert len(by["a"]) == 50 and by["a"][0]["match_count"] == 60 and len(by["d"]) == 50 and by["d"][0]["match_count"] == 61
    first = min(by["a"], key=lambda x: x["rank"])
    assert (first["right_id"], first["distance_km"], first["delta_days"]) == ("r00", 0.0, 1)


def test_tfidf_and_topk(spark):
    docs = [(1, "red disc over lake"), (2, "red disc over lake"), (3, "blue cone near lake"), (4, "alone"), (5, None), (6, "")]
    df = spark.createDataFrame(docs, "id int, s string")
    w = joins.tfidf(df, "id", F.split(F.coalesce("s", F.lit("")), " "), (1, 2))
    assert {r["id"] for r in w.collect()} == {1, 2, 3}
    assert {r["term"] for r in w.where("id = 1").collect()} == {"red", "disc", "over", "lake", "red disc", "disc over", "over lake"}
    norms = w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)
    for block in (1, 512):
        got = {(r["id"], r["other"]): (r["score"], r["rank"]) for r in joins.similarity_topk(w, block=block).collect()}
        assert got[1, 2] == (1.0, 1) and got[2, 1] == (1.0, 1) and (4, 1) not in got and got[3, 1][1] == 1


def test_hamming_bands_are_exact(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(12)]
    hashes = []
    for b in base:
        for _ in range(5):
            h = b
            for bit in rnd.sample(range(64), rnd.choice([0, 1, 3, 4, 6])):
                h ^= 1 << bit
            hashes.append(h)
    df = spark.createDataFrame([(f"i{k:02}", f"{h:016x}") for k, h in enumerate(hashes)] + [("bad", "12"), ("null", None)], "id string, h string")
    want = {(f"i{a:02}", f"i{b:02}", (hashes[a] ^ hashes[b]).bit_count()) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if (hashes[a] ^ hashes[b]).bit_count() <= 4}
    assert {tuple(r) for r in joins.hamming_join(df, df, "id", "h", 4, 64).collect()} == want
    words = spark.createDataFrame([(1, ["one", "two", "three"]), (2, ["three", "two", "one"]), (3, ["four"]), (4, [])], "i int, t array<string>")
    h = {r["i"]: r["h"] for r in joins.simhash64(words, "i", F.col("t")).collect()}
    assert set(h) == {1, 2, 3} and h[1] == h[2] and h[3] == __import__("hashlib").md5(b"four").hexdigest()[:16]


def test_knn_blocks(spark):
    x = np.random.default_rng(3).standard_normal((60, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, [0.0] * 6), (91, None)], "i int, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = joins.knn(df, df, "i", "v", 4, block=16).collect()
    assert {(r["q"], r["id"]) for r in got} == {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:4]}
    assert joins.knn(df.where("i = 1"), df, "i", "v", 99).count() == 50
    assert joins.knn(df.limit(0), df, "i", "v").count() == 0


def test_lookups(spark):
    p = spark.createDataFrame([(5,), (10,), (11,), (20,), (None,), (10,)], "n bigint")
    r = spark.createDataFrame([(5, 10, "a"), (10, 15, "b"), (18, 17, "bad"), (0, 5_000_000, "wide")], "lo bigint, hi bigint, t string")
    got = joins.range_lookup(p, r.where("t <> 'wide'")).select("n", "hit.t").collect()
    assert sorted((x["n"] or 0, x["t"] or "") for x in got) == [(0, ""), (5, "a"), (10, "a"), (10, "a"), (11, "b"), (20, "")]
    assert joins.range_lookup(p, r).where("n = 20").select("hit.t").first()[0] == "wide"
    rec = spark.createDataFrame([("a", ["x", "y"], 1), ("b", ["y"], 2)], "id string, paths array<string>, ord int")
    assert rows(joins.last_owner(rec, "id", "paths")) == [("x", "a"), ("y", "b")]
    cache = spark.createDataFrame([("Holt", 1.0, 2.0), ("HOLT", 3.0, 4.0), ("None", None, None)], "name string, lat double, lng double")
    d = spark.createDataFrame([("Holt", None, None), ("holt", None, None), ("Holt", 9.0, 9.0), ("q", None, None)], "place string, lat double, lng double")
    assert sorted((r["place"], r["lat"] or 0.0) for r in joins.geo_supplement(d, "place", cache).collect()) == [("Holt", 1.0), ("Holt", 9.0), ("holt", 3.0), ("q", 0.0)]


def test_time_joins(spark):
    l = spark.createDataFrame([(1, 10, "l1"), (1, 5, "l2"), (2, 1, "l3")], "k int, ts int, id string")
    r = spark.createDataFrame([(1, 5, 50.0), (1, 8, 80.0), (1, 11, 110.0)], "k int, ts int, v double")
    assert rows(joins.as_of_join(l, r, "k", "ts", "v"), "id", "v_as_of") == [("l1", 80.0), ("l2", 50.0), ("l3", None)]
    a = spark.createDataFrame([(1, 0, 10), (2, 20, 21), (3, 5, 4)], "id int, start bigint, stop bigint")
    b = spark.createDataFrame([(7, 10, 12), (8, 11, 19), (9, -50, 500)], "id int, start bigint, stop bigint")
    assert rows(joins.overlap_join(a, b, 7)) == [(1, 7), (1, 9), (2, 9)]


def test_tables_against_tables(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "u string, h string")
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "u string, h string")
    assert rows(joins.snapshot_diff(p, c, "u", "h"), "u", "kind") == [("b", "modified"), ("d", "removed"), ("e", "added")]
    hits, misses = joins.memo_split(p.select("u"), c.withColumnRenamed("h", "verdict"), "u")
    assert rows(hits, "u") == [("a",), ("b",), ("c",)] and rows(misses) == [("d",)]
    base = spark.createDataFrame([("a", "old", True, "x"), ("b", "old", False, "y"), ("c", "old", True, "z")], "k string, name string, cur boolean, keep string")
    over = spark.createDataFrame([("a", "new"), ("n", "new")], "k string, name string")
    assert rows(joins.overlay_merge(base, over, "k", ["name"], "cur"), "k", "name", "keep") == [("a", "new", "x"), ("c", "old", "z"), ("n", "new", None)]


def test_linkage(spark):
    schema = "record_id string, source string, incident_date date, incident_location string, title string, lat double, lng double"
    r = spark.createDataFrame(
        [("a", "x", date(1950, 6, 1), "Holt, Ohio", "disc over Holt", 40.0, -82.0), ("b", "y", date(1950, 6, 1), "Holt Ohio", "disc near Holt", 40.0, -82.0), ("c", "x", date(1950, 6, 2), "Holt, Ohio", "disc", None, None),
         ("d", "y", date(1951, 1, 1), "Holt, Ohio", "disc", None, None), ("e", "z", None, "Holt", "disc", None, None), ("f", "z", date(1950, 12, 31), "Holt, Ohio", "disc over Holt", 40.0, -82.0), ("g", "y", date(1951, 1, 1), "Holt, Ohio", "disc over Holt", 40.0, -82.0)],
        schema,
    )
    e = linkage.score_pairs(r)
    got = {(x["a"], x["b"]): x["score"] for x in e.collect()}
    assert got["a", "b"] > 0.95 and ("a", "c") not in got and ("b", "c") in got and ("f", "g") not in got
    assert ("f", "g") in {(x["a"], x["b"]) for x in linkage.score_pairs(r, neighbour_years=1).collect()}
    c = linkage.clusters(r, e, linkage.connected_components(e)).collect()
    assert [m["record_id"] for m in c[0]["members"]] == ["a", "b", "c"] and c[0]["consensus_date"] == date(1950, 6, 1) and c[0]["consensus_location"] == "Holt, Ohio"


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(200, 100), (100, 300), (5, 5), (None, 1)]
    got = dict(tuple(r) for r in linkage.connected_components(spark.createDataFrame(chain, "a int, b int")).collect())
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}


def test_first_seen(spark):
    d = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("j", None, 1)], "k string, v string, o int")
    assert rows(linkage.mode_first_seen(d, "k", "v", "o")) == [("k", "b", 2)]
    t = spark.createDataFrame([("x", 1, "T"), ("x", 2, "T"), ("x", 3, "T"), ("y", 1, "U")], "id string, o int, title string")
    assert rows(linkage.disambiguate(t, "id", "o", "title"), "id", "title") == [("x", "T"), ("x__2", "T (2)"), ("x__3", "T (3)"), ("y", "U")]


def test_graph(spark):
    e = graph.merge_edges(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("b", "c", 9.0), ("c", "c", 1.0), ("d", "e", 1.0)], "src string, dst string, weight double"), cap=5.0)
    assert rows(e) == [("a", "b", 3.0), ("b", "c", 5.0), ("d", "e", 1.0)]
    assert {r["id"]: (r["degree"], r["centrality"]) for r in graph.degree(e).collect()}["b"] == (2, 0.5)
    member = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2)], "id string, community int")
    assert abs(graph.modularity(e, member).agg(F.sum("q")).first()[0] - (1 - (16 / 18) ** 2 - (2 / 18) ** 2)) < 1e-9
    lab = {r["id"]: r["community"] for r in graph.label_propagation(e).collect()}
    assert lab["d"] == lab["e"] and lab["b"] == lab["c"] and lab["a"] != lab["d"]
    ev = {r["id"]: r["score"] for r in graph.eigenvector(e, 60).collect()}
    assert max(ev, key=ev.get) == "b" and ev["d"] < 0.01
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    bt = {r["id"]: r["betweenness"] for r in graph.betweenness_top(path).collect()}
    assert bt["a"] == 0 and abs(bt["b"] - 4 / 6) < 1e-9
    lay = graph.force_layout(path, rounds=20).collect()
    assert len(lay) == 4 and all(0 <= r["x"] <= 1400 and 0 <= r["y"] <= 900 for r in lay) and lay == graph.force_layout(path, rounds=20).collect()
    adj = {r["id"]: (r["out"], r["in"]) for r in graph.adjacency(path).collect()}
    assert adj["a"] == (["b"], None) and adj["b"] == (["c"], ["a"])


def test_build_graph(spark):
    ent = spark.createDataFrame([("r1", "org:x", 2), ("r1", "org:x", 1)], "record_id string, entity_id string, count int")
    cit = spark.createDataFrame([("r1", "r2", 9), ("r2", "r1", 1)], "from_id string, to_id string, count int")
    near = spark.createDataFrame([("r1", "r3", 0.0, 0), ("r1", "r4", None, -30)], "left_id string, right_id string, distance_km double, delta_days int")
    v, e = graph.build_graph(ent, cit, near)
    assert rows(e) == [("entity:org:x", "record:r1", 3.0), ("record:r1", "record:r2", 5.0), ("record:r1", "record:r3", 1.0)]
    assert v.where("node_type = 'entity'").count() == 1


def test_getis_ord(spark):
    cells = [(f"{i}:{j}", float(i), float(j), 9 if (i, j) == (1, 1) else 0) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(cells, "cell string, lat double, lng double, n int")
    z = {r["cell"]: (r["z"], r["p"]) for r in spatial.getis_ord(df, k=8).collect()}
    assert all(abs(v[0]) < 1e-9 for v in z.values())  # every cell's neighbourhood is the whole grid
    z4 = {r["cell"]: r["z"] for r in spatial.getis_ord(df, k=4).collect()}
    # by hand: mean 1, population deviation sqrt(8); lag 9/5 over 5 cells of 9
    assert abs(z4["1:1"] - round((9 / 5 - 1) / (8**0.5 * ((9 / 5 - 1) / 8) ** 0.5), 4)) < 1e-3
    assert all(r["z"] == 0 and r["p"] == 1 for r in spatial.getis_ord(df.limit(8)).collect())
    assert all(r["z"] == 0 for r in spatial.getis_ord(df.withColumn("n", F.lit(4))).collect())


def test_layers_keep_zero(spark):
    p = spark.createDataFrame([(1.0, 1.0, "a"), (1.1, 1.1, "a"), (11.0, 1.0, "b"), (0.0, 0.0, "a"), (None, 1.0, "b")], "lat double, lng double, s string")
    got = rows(spatial.layer_counts(p, {"a": F.col("s") == "a", "b": F.col("s") == "b"}, 5.0), "cell", "layer", "n")
    assert got == [("18:36", "a", 2), ("18:36", "b", 0), ("20:36", "a", 0), ("20:36", "b", 1)]


def test_topics(spark):
    rng = np.random.default_rng(1)
    docs = [(k, [float(x) for x in (np.eye(3)[k % 3] + 0.05 * rng.standard_normal(3))], ["alpha beta", "gamma delta", "kappa sigma"][k % 3] + " shared") for k in range(30)]
    df = spark.createDataFrame(docs, "id int, v array<double>, s string")
    m = topics.cluster_vectors(df, "id", "v", 3)
    got = topics.topic_terms(m.join(df.select("id", "s"), "id"), F.split("s", " ")).collect()
    assert sorted(r["size"] for r in got) == [10, 10, 10] and all("shared" not in r["keywords"] for r in got)
    assert topics.cluster_vectors(df, "id", "v", 3, noise=1.1).where("topic = -1").count() == 30


def test_hybrid_rank(spark):
    schema = "id string, type string, title string, blurb string, text string, incident_id string"
    c = spark.createDataFrame([("a", "PDF", "red orb", None, "x", None), ("b", "PDF", "blue", "orb", "red orb", "i"), ("i", "IMG", "red orb", None, None, None), ("z", None, "other", None, None, None)], schema)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.6, 0.8]), ("i", [0.0, 1.0])], "id string, vector array<double>")
    got = [(r["id"], r["score"]) for r in retrieval.hybrid_rank(c, v, "red orb", [0.0, 1.0], k=3).collect()]
    assert [g[0] for g in got] == ["b", "z", "a"] and got[0][1] == round(100 + 0.6 * (3 + 2 + 2) + 0.3, 3)
    assert [r["id"] for r in retrieval.hybrid_rank(c, None, "red orb", None).collect()] == ["a"]
    assert [r["id"] for r in retrieval.hybrid_rank(c, v, "red orb", [0.0, 1.0], scope=spark.createDataFrame([("z",)], "id string")).collect()] == ["z"]


def test_citations(spark):
    d = spark.createDataFrame([("r1", "Incident 106, 107a and again Incident #106; Serial 9"), ("r2", "MDR 12-3456 MDR 12-3456")], "id string, t string")
    m = retrieval.citation_mentions(d, "id", "t", text.CITATIONS)
    assert rows(m, "id", "kind", "token") == [("r1", "incident", "106"), ("r1", "incident", "107A"), ("r1", "serial_ref", "9"), ("r2", "mdr", "12-3456")]
    look = spark.createDataFrame([("incident", "106", "r2"), ("incident", "107A", "r2"), ("serial_ref", "9", "r1")], "kind string, token string, to_id string")
    e, dang = retrieval.citation_edges(m, look)
    x = e.collect()
    assert [(r["from_id"], r["to_id"], r["count"], r["via"], len(r["contexts"])) for r in x] == [("r1", "r2", 2, "107A", 2)]
    assert rows(dang) == [("r2", "mdr", "12-3456")]


def test_publishing(spark):
    d = spark.createDataFrame([("a", date(2001, 7, 4), 1), ("b", date(1999, 7, 4), 5), ("c", date(2003, 7, 4), 1), ("n", None, 9)], "id string, day date, s int")
    (b,) = retrieval.calendar_buckets(d, "day", "id", F.col("s")).collect()
    assert b["mm_dd"] == "07-04" and [e["id"] for e in b["entries"]] == ["b", "c", "a"]
    f = retrieval.atom_feed(spark.createDataFrame([("a", "x < y", None, None), ("b", "t", date(2020, 1, 1), "s")], "id string, title string, updated date, summary string"), 1).collect()
    assert [r["id"] for r in f] == ["b"]
    n = retrieval.vault_note(spark.createDataFrame([("a", "T: x", "A", ["p"], "body", ["r"])], "id string, title string, agency string, tags array<string>, text string, related array<string>")).first()["note"]
    assert n.startswith('---\ntitle: "T: x"') and n.endswith("## Related\n- [[r]]")


def test_components_that_do_not_settle_raise(spark):
    from archivolt.operators.linkage import connected_components

    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a int, b int")
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=1)
    assert {r["component"] for r in connected_components(chain).collect()} == {0}


def test_scored_pairs_are_all_pairs(spark):
    """Every pair that reaches the threshold, by comparing all with all; days are few, so that rows meet at every limit."""
    import random

    from archivolt.functions.numeric import date_score, geo_score, match_probability
    from archivolt.functions.text import location_similarity, title_similarity
    from archivolt.operators.dualtree import haversine_km

    rnd = random.Random(7)
    spots = [(40.0, -80.0), (40.3, -80.2), (43.9, -80.0), (89.9, 10.0), (89.9, -170.0), (95.0, 10.0), (0.0, 179.9), (0.0, -179.9), (None, None), (41.0, None)]
    rows_ = []
    for k in range(160):
        lat, lng = rnd.choice(spots)
        rows_.append((f"r{k:03}", rnd.choice(["x", "y", None]), date.fromordinal(date(1999, 10, 1).toordinal() + rnd.choice([0, 6, 7, 8, 30, 31, 37, 60, 90, 91, 97, 120, 200, 365])), rnd.choice(["Holt, Ohio", "Holt AFB, Ohio", "Yarrow", None]), rnd.choice(["Report, Holt", "Report Holt disc", "cable", None]), lat, lng))
    df = spark.createDataFrame(rows_, "record_id string, source string, incident_date date, incident_location string, title string, lat double, lng double")
    a, b = [df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for s in "ab"]
    p = a.crossJoin(b).where((F.col("a_record_id") < F.col("b_record_id")) & ~F.col("a_source").eqNullSafe(F.col("b_source")))
    p = p.withColumn("d", date_score(F.datediff("a_incident_date", "b_incident_date"))).withColumn("g", geo_score(haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))))
    p = p.withColumn("s", location_similarity(F.col("a_incident_location"), F.col("b_incident_location"))).withColumn("t", title_similarity("a_title", "b_title"))
    p = p.withColumn("score", match_probability(F.col("d"), F.col("g"), F.col("s"), F.col("t"))).withColumn("years", F.abs(F.year("a_incident_date") - F.year("b_incident_date"))).select("a_record_id", "b_record_id", "score", "years").collect()
    for threshold, years in ((0.65, 0), (0.65, 1), (0.4, 1), (0.9, 0)):
        want = {(r["a_record_id"], r["b_record_id"], r["score"]) for r in p if r["score"] >= threshold and r["years"] <= years}
        got = linkage.score_pairs(df, threshold, years).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert linkage.score_pairs(df, 1.5).count() == 0


def test_pairs_meet_by_day_and_place(spark, monkeypatch):
    """2,000 entries of one year, months apart and far from each other: hardly any pair is looked at (by years all 2 million were)."""
    df = spark.range(2000).selectExpr("'r' || id AS record_id", "'s' || id AS source", "date_add(DATE '2001-01-01', CAST(id % 36 * 10 AS INT)) AS incident_date", "'Holt' AS incident_location", "'report' AS title", "CAST(id % 120 - 60 AS DOUBLE) AS lat", "CAST(id % 300 AS DOUBLE) AS lng")
    real = linkage.date_score
    met = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: met.add(1) or x, "double")
    monkeypatch.setattr(linkage, "date_score", lambda c: count(real(c)))
    linkage.score_pairs(df).count()
    assert 0 < met.value < 700_000


def test_power_iteration_leaves_one_table(spark, monkeypatch):
    """However many rounds, one vector is on disk; a table each round gives the same vector."""
    from archivolt import session

    e = spark.createDataFrame([(f"s{k % 7}", f"p{k % 11}", 1.0 + k % 3) for k in range(60)], "src string, dst string, weight double").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    got = []
    for n in (10_000_000, 1):
        monkeypatch.setattr(graph, "ROUND_ROWS", n)
        before = len([p for p in session._STAGES if "/eigen-" in p])
        got.append({r["id"]: round(r["score"], 7) for r in graph.eigenvector(e).collect()})
        assert len([p for p in session._STAGES if "/eigen-" in p]) == before + 1
    assert got[0] == got[1] and len(got[0]) == 18


def test_top_k_reads_no_frequent_lists(spark, monkeypatch):
    """The same rows as all products; a term of every row is not read where rarer ones settle the best rows."""
    import random

    rnd = random.Random(3)
    docs = [(f"d{k:03}", ["all", f"g{k % 9}", f"p{k // 8}", *rnd.choices("abcdef", k=rnd.randrange(3))]) for k in range(240)]
    w = joins.tfidf(spark.createDataFrame(docs, "id string, t array<string>"), "id", F.col("t"), (1, 1))
    u = {}
    for r in w.collect():
        u.setdefault(r["id"], {})[r["term"]] = r["w"]
    want = set()
    for a in u:
        s = sorted((-round(sum(x * u[b].get(t, 0.0) for t, x in u[a].items()), 3), b) for b in u if b != a)
        want |= {(a, b, -x, n + 1) for n, (x, b) in enumerate(s[:6]) if -x >= 0.1}
    for probe in (0, 30, 100_000):
        assert {tuple(r) for r in joins.similarity_topk(w, block=50, probe=probe).collect()} == want
    read = []
    real = joins.cut_to_table
    monkeypatch.setattr(joins, "cut_to_table", lambda df, label="stage": read.append((label, t := real(df, label))) or t)
    joins.similarity_topk(w, probe=30)
    asked = [t for label, t in read if label == "asked"][-1]
    assert asked.where("term = 'all'").count() == 0 and asked.count() > 0
