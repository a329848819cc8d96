from pyspark.sql import functions as F

from archivolt.operators import records


def test_unify_and_index(spark):
    a = spark.createDataFrame([("1", "x")], "id string, title string")
    b = spark.createDataFrame([("n:2", "y", 3)], "id string, title string, extra int")
    got = sorted(tuple(r) for r in records.unify({"news": a, "official_list": b}, {"news": "reported"}).select("id", "source", "provenance", "extra").collect())
    assert got == [("n:2", "official_list", "official", 3), ("news:1", "news", "reported", None)]
    rec = spark.createDataFrame([("r1", "T", "A", ["d/a.pdf"], 1), ("r2", "U", "A", ["d/a.pdf", "d/b.pdf"], 2)], "id string, title string, agency string, primary_local array<string>, ord int")
    pics = spark.createDataFrame([("i/a__p001_004.jpg", "d/a.pdf", "001"), ("i/z.jpg", "d/z.pdf", "001")], "file string, src_pdf string, page string")
    texts = spark.createDataFrame([("r1", "body")], "stem string, text string")
    links = spark.createDataFrame([("r2", ["r1"])], "id string, similar array<string>")
    out = {r["id"]: r for r in records.search_index(rec, texts, links, pics).collect()}
    assert set(out) == {"r1", "r2", "r2__img_p001_004"}
    assert out["r1"]["text"] == "body" and out["r2"]["text"] == "" and out["r1"]["similar"] == [] and out["r2__img_p001_004"]["extracted_from_id"] == "r2"


def test_entities_and_heads(spark):
    m = spark.createDataFrame([("r1", "ORG", "The Bureau", 1), ("r2", "ORG", "the bureau.", 2), ("r2", "ORG", "the bureau.", 3)], "record_id string, type string, surface string, ord int")
    (e,) = records.entity_table(m).collect()
    assert (e["entity_id"], e["surface"], e["count"], e["record_ids"]) == ("org:the_bureau", "the bureau.", 3, ["r1", "r2"])
    d = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("j", 1, "c")], "k string, o int, v string")
    assert sorted(r["v"] for r in records.first_rows(d, "k", "o").collect()) == ["a", "c"]
    assert sorted((r["v"], r["rank"]) for r in records.head_rows(d, "k", 1, F.desc("o")).collect()) == [("b", 1), ("c", 1)]
    assert records.prompt(d, "v", "k", "v").first()["prompt"] == "[1] k\na\n\n[2] k\nb\n\n[3] j\nc"
    t = spark.createDataFrame([("Unknown", 1), ("1/2/01", 2), (None, 3)], "w string, i int")
    assert [r["i"] for r in records.timeline(t, "w", "i").collect()][0] == 2


def test_splits_and_validation(spark):
    s = spark.createDataFrame([("a", "official", None, 1), ("b", None, (1.0, 2.0), 1), ("c", "x", (0.0, 0.0), 1), ("d", "official", None, None)], "id string, provenance string, location struct<lat:double,lng:double>, day int")
    parts = [sorted(r["id"] for r in p.collect()) for p in records.split_sightings(s)]
    assert parts == [["a"], ["b"], ["c", "d"]]
    c = spark.createDataFrame([("r1", "title", "ok"), ("r1", "secret", "ok"), ("r1", "title", "x" * 20), ("r9", "title", "ok"), ("r1", None, "ok")], "record_id string, field string, suggested_value string")
    good, bad = records.validate(c, ["title"], {"suggested_value": 10}, spark.createDataFrame([("r1",)], "record_id string"))
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["field", "field", "suggested_value", "unknown"]
    schema = "kind string, id string, runs array<struct<run_id:string,claims:array<struct<id:string,claim:string,status:string>>>>"
    e = spark.createDataFrame([("person", "p", [("run", [("c1", "x", "approved"), ("c2", "y", "pending")])])], schema)
    assert [r["claim"] for r in records.approved_claims(e).collect()] == ["x"]
    r = records.resolution_rate(spark.range(3), spark.range(1)).first()
    assert (r["edges"], r["dangling"], r["rate"]) == (3, 1, 75.0)
    p = spark.createDataFrame([(0.7, 0.01, 1), (0.5, 0.2, 1), (0.9, 0.01, 0)], "s double, p double, n int")
    assert tuple(records.tallies(p, "s", [0.5, 0.7]).first()) == (3, 2) and records.significant(p).count() == 1


def test_views(spark, sf):
    assert "lineitem" in records.register_views(spark, sf)
    assert spark.sql("SELECT count(*) AS n FROM lineitem l LEFT ANTI JOIN orders o ON l.l_orderkey = o.o_orderkey").first()["n"] == 0


def test_stage_tables_are_dropped(spark):
    import os

    from archivolt.session import cut_to_table, drop_stages

    drop_stages(spark)
    t = cut_to_table(spark.range(3))
    (path,) = {os.path.dirname(p.removeprefix("file:").replace("//", "/")) for p in t.inputFiles()}
    assert t.count() == 3 and os.path.isdir(path) and drop_stages(spark) == 1 and not os.path.isdir(path)
