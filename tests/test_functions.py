import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from archivolt.functions import dates, numeric, scalars, text


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in cols.items()) or "x int"
    df = spark.createDataFrame([tuple(cols.values()) or (1,)], schema)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [(" ?a b/c! ", "a_b_c"), ("x" * 200, "x" * 160), ("!!!", "untitled"), (None, "untitled"), ("a\nb.pdf", "a_b.pdf")])
def test_slugify(spark, raw, want):
    assert one(spark, scalars.slugify(F.col("s")), s=raw) == want


def test_names_and_links(spark):
    assert one(spark, scalars.slugify_query(F.col("s")), s="Orange & Red!") == "orange_red"
    assert one(spark, scalars.split_links(F.col("s")), s="https://a/x|no\nhttp://b/y https://c/z z") == ["https://a/x", "http://b/y", "https://c/z z"]
    assert one(spark, scalars.url_file(F.col("s")), s="https://h/d/a%20b+c.PDF?x=1") == "a b+c.PDF"
    assert one(spark, scalars.local_path_for(F.col("s")), s="https://h/d/a%20b.PDF") == "raw/docs/a_b.pdf"
    assert [one(spark, scalars.kind_for(F.col("s")), s=s) for s in ("a.JPG", "b.mp4?x", "c.pdf")] == ["images", "videos", "docs"]
    assert one(spark, scalars.repair_link(F.col("s"), F.col("t")), s="https://h/x+M", t=["https://h/thumbnail/x.jpg"]) == "https://h/x.pdf"
    assert one(spark, scalars.repair_link(F.col("s"), F.col("t")), s="https://h/x.pdf", t=["https://h/thumbnail/x.jpg"]) == "https://h/x.pdf"
    assert one(spark, scalars.clean_title(F.col("s")), s=" a \n b ") == "a b" and one(spark, scalars.clean_title(F.col("s")), s=" \n ") is None
    assert one(spark, scalars.html_unescape("s"), s=" a &amp; b&#39;s ") == "a & b's"
    assert one(spark, scalars.title_case(F.col("s")), s="o'neil CITY-hall") == "O'Neil City-Hall"
    assert one(spark, scalars.location_name(F.col("a"), F.col("b")), a="old town", b="") == "Old Town"
    assert one(spark, scalars.sighting_title(*map(F.col, "abcd")), a="disc", b="Dreygate", c="2001", d="s") == "Disc over Dreygate (2001)"
    assert one(spark, scalars.sighting_title(*map(F.col, "abcd")), a="disc", b="", c="2001", d="y" * 90) == "y" * 80 + "…"
    assert one(spark, scalars.sighting_title(*map(F.col, "abcd")), a=None, b=None, c=None, d=None) == "Sighting report"
    assert one(spark, scalars.strip_outlet(F.col("a"), F.col("b")), a="Lights - The Post", b="The Post") == "Lights"
    assert one(spark, scalars.templated_field(F.col("a"), "Date|Time|When"), a="Hi\n when : noon \nx") == "noon"


def test_keys_and_paths(spark):
    assert one(spark, scalars.rekey(F.col("s"), "main:"), s="main:a:b") == "a:b" and one(spark, scalars.rekey(F.col("s"), "main:"), s="news:a:b") == "news_a:b"
    assert one(spark, scalars.yaml_escape(F.col("s")), s='a: "b"') == '"a: \\"b\\""' and one(spark, scalars.yaml_escape(F.col("s")), s="plain") == "plain"
    assert one(spark, scalars.yaml_list(F.col("s")), s=["a", "b:c"]) == '[a, "b:c"]'
    assert one(spark, scalars.encode_path(F.col("s")), s="https://h/a b/c%20d?q=1 2") == "https://h/a%20b/c%20d?q=1 2"
    assert one(spark, scalars.thumb_path(F.col("s")), s="raw/a/b.JPG") == "raw/thumbs/a/b.JPG.jpg" and one(spark, scalars.thumb_path(F.col("s")), s="raw/a/b.pdf") is None
    assert one(spark, scalars.child_id(F.col("a"), F.col("b"), F.col("c")), a="r1", b="007", c="d/x_p007_003.jpg") == "r1__img_p007_003"
    assert one(spark, scalars.image_source(F.col("s"))["parent"], s="raw/images_extracted/rep__p007_1.jpg") == "rep"
    assert one(spark, scalars.marker_fingerprint(F.col("s")), s=["b", "a", "b"]) == "a+b" and one(spark, scalars.marker_fingerprint(F.col("s")), s=[]) == "raw"
    assert one(spark, scalars.hash_ip(F.col("s")), s="1.2.3.4") == __import__("hashlib").sha256(b"1.2.3.4").hexdigest()[:12]
    assert one(spark, scalars.hit_key(F.col("a"), F.col("b")), a="k", b="c") == __import__("hashlib").sha1(b"k\0c").hexdigest()
    assert [one(spark, scalars.parse_duration(F.col("s")), s=s) for s in ("12.7", "0", "-3", "long", None)] == [12, None, None, None, None]
    assert [one(spark, scalars.share_url_ok(F.col("s"), ["ok.org"]), s=s) for s in ("/a", "//a", "https://ok.org/x", "https://ok.org.evil/x", "javascript:1", "https://ok.org@evil/", None)] == [True, False, True, False, False, False, False]
    assert one(spark, scalars.assemble(F.col("a"), F.col("b"), cap=4, marker="~"), a="abc", b="def") == "abc\n~"
    assert one(spark, scalars.first_available(F.col("e"), F.col("a"), F.col("b")), e=["y", "z"], a=["x"], b=["z", "y"]) == "z"
    assert one(spark, scalars.provenance(F.col("s"), {"news": "reported"}), s="official_x") == "official"


DATES = [("12/30/47", date(1947, 12, 30)), ("5/8/26", date(2026, 5, 8)), ("6/1/85", date(1985, 6, 1)), ("2/30/01", None), ("13/1/01", None), ("June 24, 1947", date(1947, 6, 24)), ("Jun 1947", date(1947, 6, 15)), ("1947-06-24T10", date(1947, 6, 24)), ("N/A", None), (None, None)]


@pytest.mark.parametrize(("raw", "want"), DATES)
def test_linkage_dates(spark, raw, want):
    assert one(spark, dates.parse_linkage(F.col("s"), 26), s=raw) == want


def test_other_dates(spark):
    assert one(spark, dates.parse_record(F.col("s"), 26)["date"], s="10/28/2001-10/29/2001") == date(2001, 10, 28)
    assert one(spark, dates.parse_us(F.col("s"), None), s="12/30/47") == date(2047, 12, 30)
    assert one(spark, dates.parse_release(F.col("s")), s="1/2/69") == date(1969, 1, 2) and one(spark, dates.parse_release(F.col("s")), s="1/2/68") == date(2068, 1, 2)
    assert one(spark, dates.parse_report(F.col("s"))["precision"], s="10/10/1949 24:00") == "unknown"
    assert one(spark, dates.parse_report(F.col("s"))["at"], s="10/10/1949 20:30") == datetime(1949, 10, 10, 20, 30)
    assert tuple(one(spark, dates.parse_case(F.col("s")), s="Early 24 June 1947")) == (date(1947, 6, 24), "day")
    assert tuple(one(spark, dates.parse_case(F.col("s")), s="June 1947")) == (date(1947, 6, 1), "month")
    assert tuple(one(spark, dates.parse_case(F.col("s")), s="1947")) == (date(1947, 1, 1), "year")
    assert one(spark, dates.parse_rfc2822(F.col("s")), s="Tue, 05 Mar 2024 10:00:00 GMT") == datetime(2024, 3, 5, 10)
    assert one(spark, dates.from_epoch(F.col("s")), s=1.5) == "1970-01-01T00:00:01Z"
    assert one(spark, dates.parse_exif(F.col("s")), s="2001:02:03 04:05:06") == datetime(2001, 2, 3, 4, 5, 6)
    assert one(spark, dates.parse_iso_prefix(F.col("s")), s="2001-02-30T") is None


def test_tagging(spark):
    assert one(spark, text.detect_shape(F.col("a"), F.col("b")), a="a flying saucer", b="an orb") == "disc"
    assert one(spark, text.detect_shape(F.col("a"), F.col("b")), a="x", b="y" * 16000 + " orb") == "sphere"
    assert one(spark, text.detect_shape(F.col("a"), F.col("b"), 16000), a="x", b="y" * 16000 + " orb") is None
    hit = one(spark, text.keyword_hits(F.col("s"), ["zz", "radar", "^a"]), s="a radar")
    assert [(h["kw"], h["ctx"]) for h in hit] == [("radar", "a radar"), ("a", "a radar")]
    assert len(one(spark, text.keyword_hits(F.col("s"), list("abcdefghi")), s="abcdefghi")) == 8
    assert one(spark, text.codenames(F.col("s"), ["MOON LAMP"], ["OFFICE"], ["PROGRAM REVIEW"]), s="the Moon  lamp, PROJECT BLUE\nGATE; PROGRAM REVIEW; PROJECT OFFICE; PROJECT AB") == ["MOON LAMP", "PROJECT BLUE GATE"]
    assert one(spark, text.entity_id(F.lit("ORG"), F.col("s")), s=" The  Bureau-. ") == "org:the_bureau"
    assert [one(spark, text.is_noise(F.col("s")), s=s) for s in ("Harold Finch", "12/3", "ab", "Page", "USAF", "XYZ", "a\nb", "(odd)")] == [False, True, True, True, False, True, True, True]


def test_scores_and_snippets(spark):
    assert one(spark, text.lexical_score(F.col("a"), F.col("b"), F.col("c"), "the red orb"), a="Red orb", b="orb", c="a red orb here") == 6 * 2 + 3 + 2 + 2
    s = one(spark, text.snippet(F.col("s"), "needle"), s="x" * 100 + " needle " + "y" * 400)
    assert s.startswith("…") and s.endswith("…") and "needle" in s and len(s) == 322
    assert one(spark, text.snippet(F.col("s"), "none"), s="abc") == "abc"
    got = one(spark, text.strip_citations(F.col("s"), F.array(F.lit(1), F.lit(2))), s="a[^1][^9] b[^0][^2]")
    assert (got["text"], got["dropped"]) == ("a[^1] b[^2]", 2)
    assert one(spark, text.follow_ups(F.col("s")), s="x<followups>\n- a\n2. b\n\nc\nd</followups>") == ["a", "b", "c"]
    assert one(spark, F.try_variant_get(text.json_block(F.col("s")), "$.a[1]", "int"), s='so: {"a": [1, 2,],} end') == 2
    assert one(spark, text.json_block(F.col("s")).isNull(), s="no object") is True
    assert one(spark, text.longest_matches(F.col("s"), ["Photo", "Photo Studio", "Edit"]), s="made in photo studio, edit") == ["Photo Studio", "Edit"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a.b@c.org!", "[redacted email]!"), ("123-45-6789", "[redacted ssn]"), ("10.0.0.1 x", "[redacted ip] x"), ("4111 1111 1111 1111", "[redacted card]"), ("+1 (555) 010-9999", "[redacted phone]"), ("case 12345678", "case 12345678"), ("123456789012", "[redacted phone]"), ("1234567890123", "[redacted card]")],
)
def test_pii(spark, raw, want):
    assert one(spark, text.redact_pii(F.col("s")), s=raw) == want


def test_jaro_winkler():
    assert abs(text.jaro_winkler_str("abcdef", "axyzuv") - 0.5) < 1e-9
    assert abs(text.jaro("abcdefgh", "bcadefgh") - 0.9375) < 1e-9
    assert text.jaro("", "a") == 0 and text.jaro("a", "a") == 1
    assert abs(text.jaro_winkler_str("martha", "marhta") - 0.9611) < 1e-4


def test_location_and_title(spark):
    sim = lambda a, b: one(spark, text.location_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert sim("", None) is None and sim("x", "") == 0.5 and sim("Holt AFB, Ohio", "holt ohio") == 1.0 and sim("Abc, Ohio", "Xyz, Ohio") >= 0.7
    assert one(spark, text.title_similarity("a", "b"), a="red disc", b="disc of red") == 1.0 and one(spark, text.title_similarity("a", "b"), a="the of", b="x") == 0.0


def test_spans_and_fingerprints(spark):
    df = spark.createDataFrame([(1, "Serial 12 then Serial 7"), (2, None), (3, "Mr. ████ and ████")], "id int, body string")
    got = text.regex_spans(df, "id", "body", [("serial", r"Serial (\d+)")]).orderBy("ord").collect()
    assert [(r["ord"], r["start"], r["end"], r["group"]) for r in got] == [(0, 0, 9, "12"), (1, 15, 23, "7")]
    assert text.redaction_fingerprints(df, "id", "body").count() >= 1


def test_vectors_and_scores(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    z = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, numeric.l2_normalise(v)) == [0.6, 0.8] and one(spark, numeric.l2_normalise(z)) == [0.0, 0.0]
    assert one(spark, numeric.cosine(v, z)) is None
    assert one(spark, numeric.softmax(F.array(F.lit(1000.0), F.lit(1000.0)), 30.0)) == [0.5, 0.5]
    assert one(spark, numeric.binary_softmax(F.lit(900.0), F.lit(900.0))) == 0.5
    assert [one(spark, numeric.date_score(F.lit(x))) for x in (0, 7, 8, -30, 31, 90, 91, 365, 366)] == [1.0, 0.9, 0.7, 0.7, 0.4, 0.4, 0.1, 0.1, 0.0]
    assert [one(spark, numeric.geo_score(F.lit(x))) for x in (10.0, 10.01, 50.0, 150.0, 500.0, 501.0)] == [1.0, 0.9, 0.9, 0.6, 0.2, 0.0]
    null = F.lit(None).cast("double")
    assert one(spark, numeric.match_probability(F.lit(1.0), null, null, F.lit(0.5))) == 0.825
    assert abs(one(spark, numeric.match_probability(F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(0.0))) - 0.78875) < 1e-4
    assert one(spark, numeric.match_probability(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.0
    assert abs(one(spark, numeric.normal_cdf(F.lit(1.96))) - 0.9750021) < 1e-6


def test_boxes(spark):
    rows = [(0.9, "a", 0.0, 0.0, 10.0, 10.0), (0.8, "a", 1.0, 0.0, 10.0, 10.0), (0.7, "b", 1.0, 0.0, 10.0, 10.0), (0.6, "a", 20.0, 20.0, 30.0, 30.0), (0.2, "a", 50.0, 50.0, 60.0, 60.0)]
    df = spark.createDataFrame(rows, "score double, label string, x1 double, y1 double, x2 double, y2 double").agg(F.collect_list(F.struct("*")).alias("b"))
    kept = df.select(numeric.suppress(F.col("b")).alias("k")).first()["k"]
    assert [(k["score"], k["label"]) for k in kept] == [(0.9, "a"), (0.7, "b"), (0.6, "a")]


def test_sky(spark):
    jd = numeric.julian_day(F.lit("2000-01-01 12:00:00").cast("timestamp"))
    assert one(spark, jd) == 2451545.0
    sun = numeric.sun_position(F.lit(2460480.37))  # June solstice 2024
    assert abs(one(spark, sun["dec"]) - 23.44) < 0.02
    aa = numeric.alt_az(F.lit(2460480.0), numeric.sun_position(F.lit(2460480.0))["ra"], numeric.sun_position(F.lit(2460480.0))["dec"], F.lit(51.48), F.lit(0.0))
    assert 60 < one(spark, aa["alt"]) < 63
    assert one(spark, numeric.moon_phase(F.lit(2460483.55))) == "full" and one(spark, numeric.moon_phase(F.lit(2460468.03))) == "new"
    assert math.isclose(one(spark, numeric.letterbox(F.lit(200.0), F.lit(100.0), 100)["scale"]), 0.5)
