import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from archivolt.functions.text import redact_pii
from archivolt.sources import readers, writers
from archivolt.streaming import stateful


def put(tmp, name, body):
    p = tmp / name
    p.write_text(body, encoding="utf-8")
    return str(p)


def test_manifest(spark, tmp_path):
    p = put(tmp_path, "m.csv", '﻿a,b,c\n1,"two\nlines",3\nshort\n1,2,3,4,5\n"q ""x""",,\n')
    got = [tuple(r) for r in readers.read_manifest(spark, p, ["a", "b", "c"]).collect()]
    assert got == [("1", "two\nlines", "3"), ("short", None, None), ("1", "2", "3"), ('q "x"', None, None)]


def test_reports(spark, tmp_path):
    p = put(tmp_path, "r.csv", 'a,b,c\n1,2\n"x,y",2,3\n1,2,3,4\n,,\n')
    got = [tuple(r) for r in readers.read_reports(spark, p, ["f", "g", "h"]).orderBy("row").collect()]
    assert [(g[0], g[1]) for g in got] == [(1, "a"), (3, "x,y"), (5, None)]


def test_json_and_feed(spark, tmp_path):
    p = put(tmp_path, "a.json", json.dumps([{"id": "1"}, {"id": "2", "location": {"lat": 1.5}}]))
    assert readers.read_json_array(spark, p).count() == 2 and readers.read_json_array(spark, str(tmp_path / "none.json")).count() == 0
    q = put(tmp_path, "l.jsonl", '{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    assert sorted(r["id"] for r in readers.read_jsonl(spark, q, "id string").where("id is not null").collect()) == ["1", "2"]
    f = put(tmp_path, "f.xml", '<rss><channel><item><title>A</title><link>http://x</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><source url="u">Post</source></item><item><title>B</title><link>http://y</link><guid>g</guid></item></channel></rss>')
    assert sorted((r["title"], r["guid"], r["source_name"]) for r in readers.read_feed(spark, f).collect()) == [("A", "http://x", "Post"), ("B", "g", None)]


def test_pages_and_texts(spark, tmp_path):
    h = put(tmp_path, "p.html", "<html><pre>Case 1 June 1947 <b>Holt</b><br>Case 2 case missing x\nCase 3 May 1948 Ohio</pre><pre>Case 9 May 1948 No</pre>")
    got = readers.read_pre_lines(spark, h, r"^Case (\d+) (\w+ \d{4}) (.*)$", ["n", "when", "where"], "case missing").collect()
    assert [(r["n"], r["when"], r["where"]) for r in got] == [("1", "June 1947", "Holt"), ("3", "May 1948", "Ohio")]
    d = tmp_path / "t"
    d.mkdir()
    (d / "one.txt").write_text("a\nb")
    assert [tuple(r) for r in readers.read_texts(spark, str(d)).collect()] == [("one", "a\nb")]
    x = spark.createDataFrame([("<p>a<script>z</script> &amp; <b>b</b></p>",)], "h string")
    assert x.select(readers.html_text(F.col("h")).alias("t")).first()["t"] == "a &amp; b"
    y = spark.createDataFrame([("x" * 500, "o"), ("thin", "ocr"), ("thin", None)], "n string, o string")
    assert [r["t"][:3] for r in y.select(readers.pick_text(F.col("n"), F.col("o")).alias("t")).collect()] == ["xxx", "ocr", "thi"]


def test_pictures(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x07JFIF\0\xff\xe1\x00\x08Exif\0\0\xff\xda\x00\x02")
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    got = {os.path.basename(r["path"]): r["m"] for r in readers.read_files(spark, str(tmp_path)).select("path", readers.jpeg_markers("content").alias("m")).collect()}
    assert got == {"a.jpg": ["APP0:JFIF", "APP1:Exif"], "b.png": []}
    s = spark.createDataFrame([(1200, 1500), (1200, 1000), (200, 900)], "w int, h int")
    assert [r["k"] for r in s.select(readers.keep_image(F.col("w"), F.col("h")).alias("k")).collect()] == [False, True, False]


def test_geocode(spark):
    cache = spark.createDataFrame([("Holt", 1.0, 2.0), ("Miss", None, None)], "name string, lat double, lng double")
    d = spark.createDataFrame([("Holt",), ("Miss",), ("N/A",), ("New",)], "place string")
    got = {r["place"]: (r["geo_lat"], r["cached"]) for r in readers.with_geocode(d, "place", cache, ["n/a"]).collect()}
    assert got == {"Holt": (1.0, True), "Miss": (None, True), "N/A": (None, False), "New": (None, False)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1), ("..", 2)], "k string, v int")
    writers.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.write_tsv(df, str(tmp_path / "t"))
    assert any("a/b\t1" in p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    writers.write_per_key(df, "k", str(tmp_path / "per"))
    assert sorted(p.name for p in (tmp_path / "per").glob("key=*")) == ["key=_", "key=a_b"]
    log = str(tmp_path / "log")
    assert writers.append_jsonl(df, log) and writers.append_jsonl(df, log) and not writers.append_jsonl(df, log, 10)
    assert spark.read.json(log).count() == 4
    at = str(tmp_path / "table")
    writers.swap(df, at)
    writers.swap(spark.read.parquet(at).union(df), at)
    assert spark.read.parquet(at).count() == 4 and not list(tmp_path.glob("table.*"))
    cur = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, ver int, s string")
    chg = spark.createDataFrame([("a", 2, "y"), ("b", 1, "z"), ("c", 1, "n")], "k string, ver int, s string")
    assert sorted((r["k"], r["s"]) for r in writers.upsert(cur, chg, "k", "ver").collect()) == [("a", "y"), ("b", "z"), ("c", "n")]
    (tmp_path / "old.json").write_text("x")
    listing = spark.createDataFrame([("old", str(tmp_path / "old.json")), ("new", "y")], "stem string, path string")
    gone = writers.stale_files(listing, spark.createDataFrame([("new",)], "stem string"))
    assert writers.sweep(spark, gone) == 1 and not (tmp_path / "old.json").exists()


T0 = datetime(2024, 1, 1)


def requests(*secs, who="u"):
    return [(f"{who}{k}", who, T0 + timedelta(seconds=s)) for k, s in enumerate(secs)]


def test_admission(spark):
    df = spark.createDataFrame(requests(0, 10, 20, 30, 3600, 3610, 9000) + requests(0, 1, 1, 2, who="w"), "id string, who string, at timestamp")
    got = {r["id"]: (r["admitted"], r["retry_after_s"]) for r in stateful.admit(df, "who", "at", 3, 3600, "id").collect()}
    assert [got[f"u{k}"][0] for k in range(7)] == [True, True, True, False, True, True, True]
    assert got["u3"][1] == 3570.0 and [got[f"w{k}"][0] for k in range(4)] == [True, True, True, False]
    assert stateful.admit(df.limit(0), "who", "at", 3, 3600, "id").count() == 0


def test_admission_stream_equals_batch(spark, tmp_path):
    rows = requests(0, 10, 20, 30, 3600, 3610, 9000)
    src = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "id string, who string, at timestamp").coalesce(1).write.mode("append").parquet(src)
    batch = {r["id"]: r["admitted"] for r in stateful.admit(spark.createDataFrame(rows, "id string, who string, at timestamp"), "who", "at", 3, 3600, "id").collect()}
    stream = spark.readStream.schema("id string, who string, at timestamp").parquet(src).withWatermark("at", "1 day")
    q = stateful.admit_stream(stream, "who", "at", 3, 3600, "id").writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["admitted"] for r in spark.table("admitted").collect()} == batch


def test_windows_stream(spark, tmp_path):
    rows = [(1, T0), (2, T0 + timedelta(minutes=30)), (2, T0 + timedelta(minutes=31)), (3, T0 + timedelta(hours=3))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "id int, at timestamp").coalesce(1).write.parquet(src)
    s = spark.readStream.schema("id int, at timestamp").parquet(src)
    q = stateful.tumbling(stateful.first_seen(s, "at", ["id"], "2 hours"), "at", "1 hour", [], F.count(F.lit(1)).alias("n")).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.table("hours").orderBy("window").collect()][:1] == [2]


def test_change_watcher(spark, tmp_path):
    src, state, log = (str(tmp_path / x) for x in ("in", "state", "log"))
    def step(rows):
        spark.createDataFrame(rows, "url string, sha string, seen int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("url string, sha string, seen int").parquet(src)
        stateful.watch_changes(stream, state, log, "url", "sha", str(tmp_path / "cp")).awaitTermination()
    step([("a", "1", 1), ("b", "1", 1)])
    step([("a", "2", 2), ("b", "1", 2), ("c", "1", 2)])
    got = sorted((r["url"], r["kind"]) for r in spark.read.json(log).collect())
    assert got == [("a", "added"), ("a", "modified"), ("b", "added"), ("c", "added")]
    assert {r["url"]: r["sha"] for r in spark.read.parquet(state).collect()} == {"a": "2", "b": "1", "c": "1"}


def test_small_state(spark):
    m = spark.createDataFrame([(k, "chat" if k % 2 else "share", f"mail a@b.org {k}" if k % 2 else "/x", T0 + timedelta(seconds=k)) for k in range(6)] + [(9, "secret", "x", T0), (10, "share", "//evil", T0)], "n int, kind string, text string, at timestamp")
    got = {r["n"]: r["text"] for r in stateful.route(m, "kind", "text", redact_pii(F.col("text")), F.col("text").rlike("^/(?!/)"), 20).collect()}
    assert set(got) == set(range(6)) and got[1] == "mail [redacted email"
    assert sorted(r["n"] for r in stateful.ring_buffer(m, "at", 2, None, "n").collect()) == [4, 5]
    e = spark.createDataFrame([("ip", "s1", 1, "join"), ("ip", "s2", 2, "join"), ("ip", "s1", 3, "leave")], "ip string, s string, t int, kind string")
    assert [(r["open"], r["within"]) for r in stateful.presence(e, "ip", "s", "t", "kind", 1).orderBy("t").collect()] == [(1, True), (2, False), (1, True)]
    st = spark.createDataFrame([("u", 1, 200, 1), ("u", 2, 200, 2), ("u", 3, 500, 3), ("u", 4, 500, 4), ("u", 5, 200, 5)], "u string, t int, status int, k int")
    assert [r["t"] for r in stateful.status_transitions(st, "u", "t", "status", "k").orderBy("t").collect()] == [1, 3, 5]
