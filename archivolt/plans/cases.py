"""Queries of single operators: boundary cases against hand-written results, round trips of sources and sinks, and whole tables.

The expected rows of a boundary case are literal SQL, so that the driver's
engine states them on its own side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import dates, numeric, scalars, text
from archivolt.operators import joins, records
from archivolt.plans.catalogue import t
from archivolt.session import ensure_checkpoint_dir, ensure_importable
from archivolt.sources import readers, writers
from archivolt.streaming import stateful

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def sql(v) -> str:
    """A Python value as a DuckDB literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql, v)) + "]"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def query(statement: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if statement:
            ORACLE[f.__name__] = statement
        return f

    return keep


def cases(name: str, schema: str, rows: list[tuple], want: dict[str, list], build) -> None:
    """Register a query over numbered literal rows; ``build`` gives its columns, ``want`` their values."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        ensure_importable(spark)
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], f"n int, {schema}")
        got = build()
        got = got if isinstance(got, tuple) else (got,)
        return df.select("n", *[c.alias(w) for c, w in zip(got, want)])

    values = ", ".join("(" + ", ".join([str(k), *[sql(v[k - 1]) for v in want.values()]]) + ")" for k in range(1, len(rows) + 1))
    QUERIES[name] = run
    ORACLE[name] = f"SELECT * FROM (VALUES {values}) AS x(n, {', '.join(want)})"


C = F.col

# ---- normalisers ----

cases("q_slugify_query", "x string", [("Lights over A!",), ("",), (None,), ("___",)], {"slug": ["lights_over_a", "query", "query", "query"]}, lambda: scalars.slugify_query(C("x")))
cases("q_split_links", "x string", [("https://a/b.pdf|https://c/d e.pdf",), ("https://a\nhttps://b",), ("https://a https://b",), ("none",), (None,)],
      {"links": [["https://a/b.pdf", "https://c/d e.pdf"], ["https://a", "https://b"], ["https://a", "https://b"], [], None]}, lambda: scalars.split_links(C("x")))
cases("q_url_file", "x string", [("https://h/a/b%20c.pdf?x=1#y",), ("https://h/a+b.mp4",), ("plain.txt",), (None,)], {"file": ["b c.pdf", "a+b.mp4", "plain.txt", None]}, lambda: scalars.url_file(C("x")))
cases("q_split_name", "x string", [("a.b.pdf",), ("noext",), (".hidden",), ("x.",)], {"stem": ["a.b", "noext", ".hidden", "x."], "ext": [".pdf", "", "", ""]}, lambda: (scalars.split_name(C("x"))["stem"], scalars.split_name(C("x"))["ext"]))
cases("q_local_path_cases", "x string", [("https://h/My File.PDF",), ("https://h/v/clip%20one.mp4",), ("https://h/p.JPEG?w=1",)],
      {"path": ["raw/docs/My_File.pdf", "raw/videos/clip_one.mp4", "raw/images/p.jpeg"]}, lambda: scalars.local_path_for(C("x")))
cases("q_repair_link", "link string, thumbs array<string>", [("https://h/a/x+M", ["https://h/thumbnail/doc.jpg"]), ("https://h/a/x.pdf", ["https://h/thumbnail/doc.jpg"]), ("https://h/a/x", ["https://h/doc.jpg"]), ("https://h/a/x", [])],
      {"fixed": ["https://h/doc.pdf", "https://h/a/x.pdf", "https://h/a/x", "https://h/a/x"]}, lambda: scalars.repair_link(C("link"), C("thumbs")))
cases("q_clean_title", "x string", [("  a \n b\t c ",), ("   ",), (None,)], {"title": ["a b c", None, None]}, lambda: scalars.clean_title(C("x")))
cases("q_unescape_cases", "x string", [("a &amp; b",), (" &#39;q&quot; ",), ("&eacute;&nosuch;",), (None,)], {"plain": ["a & b", "'q\"", "é&nosuch;", None]}, lambda: scalars.html_unescape(C("x")))
cases("q_title_case", "x string", [("o'hare AIRPORT",), ("st. mary-le-bow",), ("",), (None,)], {"title": ["O'Hare Airport", "St. Mary-Le-Bow", "", None]}, lambda: scalars.title_case(C("x")))
cases("q_location_name", "a string, b string, c string", [("new york", "ny", "us"), ("", "tx", None), (None, None, None)], {"name": ["New York, Ny, Us", "Tx", ""]}, lambda: scalars.location_name(C("a"), C("b"), C("c")))
cases("q_title_parts", "shape string, place string, at string, summary string", [("disk", "Reno", "2001-01-02", "s"), (None, "Reno", None, "s"), ("disk", None, None, "x" * 90), ("", "", "", "short"), (None, None, None, None)],
      {"title": ["Disk over Reno (2001-01-02)", "Object over Reno", "x" * 80 + "…", "short", "Sighting report"]}, lambda: scalars.sighting_title(C("shape"), C("place"), C("at"), C("summary")))
cases("q_strip_outlet", "a string, b string", [("Lights seen - Daily", "Daily"), ("Lights seen", "Daily"), ("a - Daily - Daily", "Daily")], {"title": ["Lights seen", "Lights seen", "a - Daily"]}, lambda: scalars.strip_outlet(C("a"), C("b")))
cases("q_templated_field", "x string", [("Location: Reno, NV\nDate: x",), ("head\n  city : Elko \n",), ("nothing",), ("Location:   \n",)], {"place": ["Reno, NV", "Elko", None, None]}, lambda: scalars.templated_field(C("x"), "location|city"))
cases("q_by_map", "x string", [("CE",), ("zz",), (None,)], {"kind": ["close encounter", "other", "other"]}, lambda: scalars.by_map(C("x"), {"CE": "close encounter", "NL": "night light"}, "other"))
cases("q_provenance_cases", "x string", [("official_desk",), ("press",), ("forum",), (None,)], {"level": ["official", "reported", "unverified", "unverified"]}, lambda: scalars.provenance(C("x"), {"press": "reported"}))
cases("q_yaml_cases", "x string, l array<string>", [("plain", ["a", "b: c"]), ("a: b", []), ('q"uote', ["x"]), ("back\\slash:", ["#"])],
      {"scalar": ["plain", '"a: b"', '"q\\"uote"', '"back\\\\slash:"'], "list": ['[a, "b: c"]', "[]", "[x]", '["#"]']}, lambda: (scalars.yaml_escape(C("x")), scalars.yaml_list(C("l"))))
cases("q_encode_path", "x string", [("https://h/a b/c+d.pdf?q=1 2",), ("https://h/a%20b/é",), ("https://h",)], {"url": ["https://h/a%20b/c%2Bd.pdf?q=1 2", "https://h/a%20b/%C3%A9", "https://h"]}, lambda: scalars.encode_path(C("x")))
cases("q_assemble", "a string, b string", [("one", "two"), (None, "two"), ("", " "), ("12345678", "90")], {"text": ["one\ntwo", "two", "", "12345678\n9[cut]"]}, lambda: scalars.assemble(C("a"), C("b"), cap=10, marker="[cut]"))
cases("q_drop_article", "x string", [("a disc",), ("an orb",), ("the orb",), ("apple",)], {"x": ["disc", "orb", "the orb", "apple"]}, lambda: scalars.drop_article(C("x")))
cases("q_node_label", "x string", [("place:new_york",), ("plain_name",), ("a:b:c_d",)], {"label": ["new york", "plain name", "b:c d"]}, lambda: scalars.node_label(C("x")))
cases("q_best_by", "x array<struct<s:int,w:int,name:string>>", [([(1, 2, "a"), (3, 1, "b"), (3, 0, "c")],), ([],), ([(2, 2, "z")],)], {"name": ["b", None, "z"]}, lambda: scalars.best_by(C("x"), "s", "w")["name"])
cases("q_thumb_path", "x string", [("raw/images/a.png",), ("raw/b.JPEG",), ("other/a.png",), ("raw/a.pdf",)], {"thumb": ["raw/thumbs/images/a.png.jpg", "raw/thumbs/b.JPEG.jpg", None, None]}, lambda: scalars.thumb_path(C("x")))
cases("q_first_available", "have array<string>, a array<string>, b array<string>", [(["x", "y"], ["q", "y"], ["x"]), (["x"], None, ["x"]), ([], ["x"], ["x"])], {"path": ["y", "x", None]}, lambda: scalars.first_available(C("have"), C("a"), C("b")))
cases("q_row_image", "th array<string>, pr array<string>", [(["t.jpg"], ["p.png"]), ([], ["d.pdf", "p.png"]), ([], ["d.pdf"]), (None, None)], {"image": ["t.jpg", "p.png", "", ""]}, lambda: scalars.row_image(C("th"), C("pr")))
cases("q_child_id", "p string, page string, f string", [("rec-1", "4", "images/rec__p4_12.png"), ("rec-2", "10", "a_3.jpg")], {"id": ["rec-1__img_p4_12", "rec-2__img_p10_3"]}, lambda: scalars.child_id(C("p"), C("page"), C("f")))
cases("q_image_source", "x string", [("raw/images_extracted/doc__p3_1.png",), ("raw/images/photo.jpg",)], {"kind": ["pdf_embedded", "standalone"], "parent": ["doc", None]}, lambda: (scalars.image_source(C("x"))["kind"], scalars.image_source(C("x"))["parent"]))
cases("q_notes", "a boolean, b boolean", [(True, True), (False, True), (None, False)], {"notes": [["first", "second"], ["second"], []]}, lambda: scalars.notes((C("a"), "first"), (C("b"), "second")))
cases("q_marker_fingerprint", "x array<string>", [(["b", "a", "b"],), ([],), (["z"],)], {"mark": ["a+b", "raw", "z"]}, lambda: scalars.marker_fingerprint(C("x")))
cases("q_notability", "a boolean, b int, c int", [(True, 2, 6000), (False, None, 5000), (True, 0, None)], {"score": [6, 0, 3]}, lambda: scalars.notability(C("a"), C("b"), C("c")))
cases("q_share_url", "x string", [("/item/1",), ("//evil.example/x",), ("https://ok.example/a",), ("https://ok.example.evil/a",), ("javascript:alert(1)",), ("https://ok.example@evil/a",), (None,), ("/" + "a" * 2048,)],
      {"ok": [True, False, True, False, False, False, False, False]}, lambda: scalars.share_url_ok(C("x"), ["ok.example"]))
cases("q_duration_cases", "x string", [("120",), ("0",), ("-5",), ("2.9",), ("abc",), ("99999999999",), (None,)], {"seconds": [120, None, None, 2, None, None, None]}, lambda: scalars.parse_duration(C("x")))

# ---- dates ----

DATE = lambda c: F.date_format(c, "yyyy-MM-dd")
cases("q_linkage_date_cases", "x string", [("2001-02-03T10:00",), ("12/30/47",), ("5/8/26",), ("June 5, 1947",), ("June 1947",), ("2/30/01",), ("N/A",), (None,)],
      {"day": ["2001-02-03", "1947-12-30", "2026-05-08", "1947-06-05", "1947-06-15", None, None, None]}, lambda: DATE(dates.parse_linkage(C("x"), 26)))
cases("q_record_date_cases", "x string", [("6/1/85",), ("6/1/1985-6/4/1985",), ("13/1/01",), ("",)], {"day": ["1985-06-01", "1985-06-01", None, None], "precision": ["day", "day", "unknown", "unknown"]},
      lambda: (DATE(dates.parse_record(C("x"), 26)["date"]), dates.parse_record(C("x"), 26)["precision"]))
cases("q_release_date_cases", "x string", [("5/8/69",), ("5/8/68",), ("2001-01-02",), ("7/4/1999",), ("soon",)], {"day": ["1969-05-08", "2068-05-08", "2001-01-02", "1999-07-04", None]}, lambda: DATE(dates.parse_release(C("x"))))
cases("q_report_times", "x string", [("10/10/1949 20:30",), ("10/10/1949 24:00",), ("1/2/2003",), ("x",)], {"stamp": ["1949-10-10 20:30", None, "2003-01-02 00:00", None], "precision": ["minute", "unknown", "day", "unknown"]},
      lambda: (F.date_format(dates.parse_report(C("x"))["at"], "yyyy-MM-dd HH:mm"), dates.parse_report(C("x"))["precision"]))
cases("q_case_dates", "x string", [("24 June 1947",), ("June 1947",), ("1947",), ("Feb 30 1950",), ("unknown",)], {"day": ["1947-06-24", "1947-06-01", "1947-01-01", "1950-02-01", None], "precision": ["day", "month", "year", "month", "unknown"]},
      lambda: (DATE(dates.parse_case(C("x"))["date"]), dates.parse_case(C("x"))["precision"]))
cases("q_mail_times", "x string", [("Tue, 05 Mar 2024 10:00:00 GMT",), ("5 Mar 2024 10:00:00 +0200",), ("yesterday",)], {"stamp": ["2024-03-05 10:00:00", "2024-03-05 08:00:00", None]}, lambda: F.date_format(dates.parse_rfc2822(C("x")), "yyyy-MM-dd HH:mm:ss"))
cases("q_epoch_times", "x double", [(0.0,), (1700000000.7,), (None,)], {"stamp": ["1970-01-01T00:00:00Z", "2023-11-14T22:13:20Z", None]}, lambda: dates.from_epoch(C("x")))
cases("q_exif_times", "x string", [("2003:04:05 06:07:08",), ("2003-04-05",), (None,)], {"stamp": ["2003-04-05 06:07:08", None, None]}, lambda: F.date_format(dates.parse_exif(C("x")), "yyyy-MM-dd HH:mm:ss"))

# ---- text ----

cases("q_shape_cases", "b string, x string", [("a TIC-TAC object", None), ("round", "a saucer and an orb"), ("", "bright   lights"), ("discus", "orbit"), (None, None), ("z", "y " * 9000 + "disc")],
      {"shape": ["tic-tac", "disc", "light", None, None, "disc"]}, lambda: text.detect_shape(C("b"), C("x"), None))
cases("q_redact_cases", "x string", [("mail a.b@c.org now",), ("ssn 123-45-6789",), ("at 10.20.30.40",), ("card 4111 1111 1111 1111",), ("call +1 (555) 123-4567",), ("case 12345",), (None,)],
      {"clean": ["mail [redacted email] now", "ssn [redacted ssn]", "at [redacted ip]", "card [redacted card]", "call [redacted phone]", "case 12345", None]}, lambda: text.redact_pii(C("x")))
cases("q_strip_citation_cases", "x string", [("a[^1] b[^9] c[^3]",), ("[^0][^2]",), ("none",), ("x[^9][^9]",)], {"clean": ["a[^1] b c[^3]", "[^2]", "none", "x"], "dropped": [1, 1, 0, 2]},
      lambda: (text.strip_citations(C("x"), F.sequence(F.lit(1), F.lit(3)))["text"], text.strip_citations(C("x"), F.sequence(F.lit(1), F.lit(3)))["dropped"]))
cases("q_follow_ups", "x string", [("t <followups>\n- one\n2. two\n\n* three\nfour</followups>",), ("no block",), (None,)], {"asked": [["one", "two", "three"], [], []]}, lambda: text.follow_ups(C("x")))
cases("q_tagged_block", "x string", [("<note> a\nb </note><note>c</note>",), ("<note></note>",), ("x",)], {"block": ["a\nb", None, None]}, lambda: text.tagged_block(C("x"), "note"))
cases("q_longest_matches", "x string", [("Project Sign and sign",), ("blue sign",), ("nothing",)], {"names": [["Project Sign"], ["sign"], []]}, lambda: text.longest_matches(C("x"), ["sign", "Project Sign"]))
cases("q_codename_cases", "x string", [("near PROJECT GRUDGE today",), ("project sign was old",), ("PROJECT OF THE",), (None,)], {"names": [["PROJECT GRUDGE"], ["PROJECT SIGN"], [], None]}, lambda: text.codenames(C("x"), ["PROJECT SIGN"], ["THE", "AND"], []))
cases("q_noise_cases", "x string", [("Roswell",), ("12/3",), ("Page",), ("ab",), ("a\nb c",), ("FBI",), ("XQZ",), ("(x) y",)], {"noise": [False, True, True, True, True, False, True, True]}, lambda: text.is_noise(C("x")))
cases("q_length_class", "x string", [("123456",), ("1234567",), ("1" * 14,), ("1" * 15,)], {"class": ["short", "medium", "medium", "long"]}, lambda: text.length_class(C("x")))
cases("q_jaro_winkler_cases", "a string, b string", [("martha", "marhta"), ("dixon", "dicksonx"), ("dwayne", "duane"), ("same", "same"), ("", "x"), ("abc", "xyz"), (None, "x")], {"score": [0.9611, 0.8133, 0.84, 1.0, 0.0, 0.0, None]},
      lambda: F.round(text.jaro_winkler(C("a"), C("b")), 4))
cases("q_location_cases", "a string, b string", [("Wright AFB", "wright"), (None, "x"), (None, None), ("Reno, NV", "Elko, NV")], {"score": [1.0, 0.5, None, 0.8095]}, lambda: F.round(text.location_similarity(C("a"), C("b")), 4))
cases("q_entity_ids", "k string, s string", [("ORG", "Air Force Base"), ("Place", " New  York. ")], {"id": ["org:air_force_base", "place:new_york"]}, lambda: text.entity_id(C("k"), C("s")))
cases("q_pick_text", "a string, b string", [("x" * 600, "ocr"), ("short", "ocr"), ("short", ""), (None, "ocr"), (None, None)], {"text": ["x" * 600, "ocr", "short", "ocr", None]}, lambda: readers.pick_text(C("a"), C("b")))
cases("q_html_text", "x string", [("<p>a<br>b</p><script>no()</script> c",), ("<!-- x --><b>d</b>",), (None,)], {"text": ["a b c", "d", None]}, lambda: readers.html_text(C("x")))

# ---- numbers, vectors, boxes, sky ----

cases("q_normalise_cases", "v array<double>", [([3.0, 4.0],), ([0.0, 0.0],), ([-2.0],)], {"unit": [[0.6, 0.8], [0.0, 0.0], [-1.0]]}, lambda: numeric.l2_normalise(C("v")))
cases("q_softmax_cases", "v array<double>, a double, b double", [([0.0, 0.0], 0.0, 0.0), ([1000.0, 1000.0], 1000.0, 999.0)], {"soft": [[0.5, 0.5], [0.5, 0.5]], "first": [0.5, 0.7311]}, lambda: (numeric.softmax(C("v")), F.round(numeric.binary_softmax(C("a"), C("b")), 4)))
cases("q_top_labels", "v array<double>", [([0.2, 0.5, 0.1, 0.5],), ([0.1, 0.1, 0.1, 0.17],)], {"labels": [["b", "d", "a"], []]}, lambda: F.transform(numeric.top_labels(C("v"), ["a", "b", "c", "d"]), lambda x: x["label"]))
cases("q_date_scores", "d int", [(0,), (7,), (-8,), (31,), (91,), (366,), (None,)], {"score": [1.0, 0.9, 0.7, 0.4, 0.1, 0.0, None]}, lambda: numeric.date_score(C("d")))
cases("q_geo_scores", "k double", [(10.0,), (10.1,), (150.0,), (151.0,), (501.0,), (None,)], {"score": [1.0, 0.9, 0.6, 0.2, 0.0, None]}, lambda: numeric.geo_score(C("k")))
cases("q_match_probability", "d double, g double, s double, t double", [(1.0, 1.0, 1.0, 1.0), (1.0, None, None, 0.0), (0.0, 1.0, 1.0, 1.0), (0.9, 0.9, 0.5, 0.2), (0.9, None, 0.5, 0.2)], {"p": [1.0, 0.65, 0.0, 0.746, 0.655]},
      lambda: numeric.match_probability(C("d"), C("g"), C("s"), C("t")))


def _sun_altitude():
    jd = numeric.julian_day(C("ts").cast("timestamp"))
    sun = numeric.sun_position(jd)
    return numeric.alt_az(jd, sun["ra"], sun["dec"], C("lat"), C("lng"))["alt"]


BOX = "struct<score:double,label:string,x1:double,y1:double,x2:double,y2:double>"
cases("q_nms_cases", f"b array<{BOX}>", [([(0.9, "a", 0.0, 0.0, 10.0, 10.0), (0.8, "a", 1.0, 1.0, 10.0, 10.0), (0.7, "b", 1.0, 1.0, 10.0, 10.0), (0.2, "a", 50.0, 50.0, 60.0, 60.0)],), ([(0.5, "a", 0.0, 0.0, 10.0, 10.0), (0.4, "a", 20.0, 0.0, 30.0, 10.0)],), ([],)],
      {"kept": [[0.9, 0.7], [0.5, 0.4], []]}, lambda: F.transform(numeric.suppress(C("b")), lambda x: x["score"]))
cases("q_letterbox", "w double, h double, x double", [(1280.0, 640.0, 320.0), (320.0, 640.0, 0.0)], {"scale": [0.5, 1.0], "pad_x": [0.0, 160.0], "pad_y": [160.0, 0.0], "back": [640.0, 0.0]},
      lambda: (lambda b: (b["scale"], b["pad_x"], b["pad_y"], numeric.unletterbox(C("x"), b["pad_x"], b["scale"], C("w"))))(numeric.letterbox(C("w"), C("h"), 640)))
cases("q_gps_degrees", "d double, m double, s double, r string", [(10.0, 30.0, 0.0, "N"), (10.0, 30.0, 36.0, "s"), (0.0, 0.0, 0.0, "W")], {"deg": [10.5, -10.51, 0.0]}, lambda: F.round(readers.gps_degrees(C("d"), C("m"), C("s"), C("r")), 4) + 0.0)
cases("q_keep_image", "w int, h int", [(1200, 1500), (1200, 1300), (239, 800), (240, 240)], {"keep": [False, True, False, True]}, lambda: readers.keep_image(C("w"), C("h")))
cases("q_normal_cdf", "z double", [(0.0,), (1.96,), (-1.96,), (6.0,)], {"p": [0.5, 0.975, 0.025, 1.0]}, lambda: F.round(numeric.normal_cdf(C("z")), 4))
cases("q_sky_cases", "ts string, lat double, lng double", [("2024-03-20 12:00:00", 0.0, 0.0), ("2024-06-20 12:00:00", 51.48, 0.0), ("2024-12-21 00:00:00", 51.48, 0.0)], {"sun_alt": [88.0, 62.0, -62.0]}, lambda: F.round(_sun_altitude() / 2, 0) * 2)
cases("q_moon_cases", "ts string", [("2024-01-25 17:54:00",), ("2024-01-11 11:57:00",), ("2024-01-18 03:53:00",)], {"phase": ["Full", "New", "First Quarter"]}, lambda: F.initcap(numeric.moon_phase(numeric.julian_day(C("ts").cast("timestamp")))))

# ---- record operators over literal tables ----


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    ensure_importable(spark)
    return spark.createDataFrame(data, schema)


@query("SELECT * FROM (VALUES ('a.pdf', 'r2'), ('b.pdf', 'r1')) AS x(path, id)")
def q_last_owner(spark, d):
    """A file listed by several records belongs to the last of them."""
    return joins.last_owner(rows(spark, [("r1", ["a.pdf", "b.pdf"], 1), ("r2", ["a.pdf"], 2), ("r3", [], 3), ("r4", None, 4)], "id string, p array<string>, ord int"), "id", "p")


@query("SELECT * FROM (VALUES ('own', 1.0::DOUBLE, 2.0::DOUBLE), ('Reno', 3.0, 4.0), ('ELKO', 5.0, 6.0), ('none', NULL, NULL)) AS x(name, lat, lng)")
def q_geo_supplement(spark, d):
    """Own coordinates, else the cached ones of the name, else of the name in any case."""
    df = rows(spark, [("own", 1.0, 2.0), ("Reno", None, None), ("ELKO", None, 7.0), ("none", None, None)], "name string, lat double, lng double")
    return joins.geo_supplement(df, "name", rows(spark, [("Reno", 3.0, 4.0), ("Elko", 5.0, 6.0), ("none", None, None)], "name string, lat double, lng double")).select("name", "lat", "lng")


@query("SELECT * FROM (VALUES ('Reno', 3.0::DOUBLE, true), ('Unknown', NULL, false), ('lost', NULL, true), ('new', NULL, false)) AS x(name, geo_lat, cached)")
def q_geocode(spark, d):
    """Cached places, cached misses and skipped names."""
    df = rows(spark, [("Reno",), ("Unknown",), ("lost",), ("new",)], "name string")
    return readers.with_geocode(df, "name", rows(spark, [("Reno", 3.0, 4.0), ("lost", None, None)], "name string, lat double, lng double"), ["unknown"]).select("name", "geo_lat", "cached")


@query("""
SELECT 'customer:' || c_custkey AS id, c_name AS name, 'customer' AS source, 'unverified' AS provenance FROM customer
UNION ALL SELECT 'official_desk:' || s_suppkey, s_name, 'official_desk', 'official' FROM supplier""")
def q_unify(spark, d):
    """Two sources in one table, keys prefixed, trust by source."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return records.unify({"customer": c, "official_desk": s}).select("id", "name", "source", "provenance")


@query("SELECT * FROM (VALUES ('r1__img_p2_1', 'T — image (page 2)', 'IMG', 'r1', '2')) AS x(id, title, type, extracted_from_id, extracted_page)")
def q_child_images(spark, d):
    """Pictures cut from a record's file become rows of their own."""
    r = rows(spark, [("r1", "T", "A", ["d.pdf"], 1), ("r2", "U", "A", ["e.pdf"], 2)], "id string, title string, agency string, primary_local array<string>, ord int")
    x = rows(spark, [("d__p2_1.png", "d.pdf", "2"), ("z__p1_1.png", "z.pdf", "1")], "file string, src_pdf string, page string")
    return records.child_images(r, x).select("id", "title", "type", "extracted_from_id", "extracted_page")


@query("SELECT * FROM (VALUES ('r1', 'text', ['x'], NULL), ('r2', '', [], NULL), ('r1__img_p2_1', '', NULL, 'r1'), ('case1', NULL, NULL, NULL)) AS x(id, text, cites, extracted_from_id)")
def q_search_index(spark, d):
    """Records, their texts and links, cut-out pictures and another office's cases in one table."""
    r = rows(spark, [("r1", "T", "A", ["d.pdf"], 1), ("r2", "U", "A", ["e.pdf"], 2)], "id string, title string, agency string, primary_local array<string>, ord int")
    x = rows(spark, [("d__p2_1.png", "d.pdf", "2")], "file string, src_pdf string, page string")
    got = records.search_index(r, rows(spark, [("r1", "text")], "stem string, text string"), rows(spark, [("r1", ["x"])], "id string, cites array<string>"), x, rows(spark, [("case1", "C")], "id string, title string"))
    return got.select("id", "text", "cites", "extracted_from_id")


@query("SELECT * FROM (VALUES ('org:air_desk', 'Air Desk', 'ORG', 3, 2), ('org:base', 'Base', 'ORG', 1, 1)) AS x(entity_id, surface, type, count, n_records)")
def q_entity_cases(spark, d):
    """Mentions by key: the most frequent surface, the first on ties."""
    m = rows(spark, [("r1", "ORG", "Air Desk", 1), ("r1", "ORG", "AIR DESK", 2), ("r2", "ORG", "Air  Desk.", 3), ("r2", "ORG", "Base", 4)], "record_id string, type string, surface string, ord int")
    m = m.withColumn("surface", F.when(F.col("surface") == "Air  Desk.", "Air Desk").otherwise(F.col("surface")))
    return records.entity_table(m).select("entity_id", "surface", "type", "count", F.size("record_ids").alias("n_records"))


@query("SELECT * FROM (VALUES (1, NULL), (2, 'field'), (3, 'value'), (4, 'unknown'), (5, 'field')) AS x(n, reason)")
def q_validate(spark, d):
    """Rows by the first rule they break."""
    df = rows(spark, [(1, "r1", "title", "ok"), (2, "r1", "price", "ok"), (3, "r1", "title", "x" * 11), (4, "r9", "title", "ok"), (5, "r1", None, "ok")], "n int, record_id string, field string, value string")
    ok, bad = records.validate(df, ["title"], {"value": 10}, rows(spark, [("r1",)], "record_id string"))
    return ok.select("n", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("n", "reason"))


@query("SELECT * FROM (VALUES ('k', 'e1', 'a', 'c1'), ('k', 'e1', 'b', 'c3')) AS x(kind, entity_id, run_id, claim)")
def q_approved_claims(spark, d):
    """Approved claims across entities and runs."""
    claim = "struct<id:string,claim:string,status:string>"
    df = rows(spark, [("k", "e1", [("a", [("1", "c1", "approved"), ("2", "c2", "open")]), ("b", [("3", "c3", "approved")])]), ("k", "e2", [])], f"kind string, id string, runs array<struct<run_id:string,claims:array<{claim}>>>")
    return records.approved_claims(df).select("kind", "entity_id", "run_id", "claim")


@query("SELECT * FROM (VALUES ('x', 0.01::DOUBLE)) AS t(cell, p)")
def q_significant(spark, d):
    return records.significant(rows(spark, [("x", 0.01, 3), ("y", 0.05, 3), ("z", 0.01, 0), ("w", None, 1)], "cell string, p double, n int")).select("cell", "p")


@query("SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber)::INTEGER AS place, l_orderkey, l_linenumber FROM lineitem ORDER BY place LIMIT 100")
def q_timeline(spark, d):
    """The first hundred lines of the timeline (its first page)."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.format_string("%012d-%03d", "l_orderkey", "l_linenumber").alias("tie"))
    page = records.timeline(li, "day", "tie").limit(100)
    return page.select(F.row_number().over(records.Window.orderBy("day", "tie")).alias("place"), "l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 4")
def q_head_rows(spark, d):
    """Four dearest orders of every customer (a top-k report)."""
    return records.head_rows(t(spark, d, "orders"), "o_custkey", 4, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "rank")


@query("SELECT event_id, user_id, previous, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS DISTINCT FROM event_type")
def q_status_transitions(spark, d):
    """Events at which a user's kind of event changes."""
    return stateful.status_transitions(t(spark, d, "events"), "user_id", "ts", "event_type", "event_id").select("event_id", "user_id", "previous", "event_type")


@query("SELECT * FROM (VALUES (1, 'chat', 'write [redacted email]'), (2, 'share', '/item/1'), (4, 'follow', NULL), (5, 'chat', repeat('x', 22))) AS x(n, kind, body)")
def q_route(spark, d):
    """Public messages: chat redacted and capped, links only to allowed places."""
    df = rows(spark, [(1, "chat", "write a@b.org", None), (2, "share", "/item/1", "/item/1"), (3, "share", "x", "//evil"), (4, "follow", None, None), (5, "chat", "x" * 30, None), (6, "private", "p", None)], "n int, kind string, body string, url string")
    return stateful.route(df, "kind", "body", text.redact_pii(F.col("body")), scalars.share_url_ok(F.col("url"), []), 22).select("n", "kind", "body")


@query("SELECT event_id, user_id, value, as_of FROM (SELECT e.event_id, e.user_id, e.value, (SELECT arg_max(p.value, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS as_of FROM events e WHERE e.event_type = 'view')")
def q_as_of(spark, d):
    """Every view with the user's latest purchase value at or before it."""
    e = t(spark, d, "events")
    left, right = e.where("event_type = 'view'"), e.where("event_type = 'purchase'")
    return joins.as_of_join(left.select("event_id", "user_id", "ts", "value"), right.select("user_id", "ts", F.col("value").alias("paid")), "user_id", "ts", "paid").select("event_id", "user_id", "value", F.col("paid_as_of").alias("as_of"))


@query("""
WITH i AS (SELECT o_orderkey AS id, (o_orderkey % 5000) AS a, (o_orderkey % 5000) + (o_custkey % 7) AS b FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT o_orderkey AS id, (o_orderkey % 5000) AS a, (o_orderkey % 5000) + (o_custkey % 3) AS b FROM orders WHERE o_orderstatus = 'P')
SELECT i.id AS a_id, j.id AS b_id FROM i JOIN j ON i.a <= j.b AND j.a <= i.b""")
def q_overlap_join(spark, d):
    """Overlapping intervals of finished and pending orders."""
    o = t(spark, d, "orders")
    span = lambda s, k: o.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5000).alias("start"), (F.col("o_orderkey") % 5000 + F.col("o_custkey") % k).alias("stop"))
    return joins.overlap_join(span("F", 7), span("P", 3), 16)


@query("""
SELECT id, arg_max(verification_status, (fetched_at, n)) AS verification_status, max(fetched_at) AS fetched_at FROM (
  SELECT id, fetched_at, coalesce(verification_status, '') AS verification_status, 0 AS n FROM sightings WHERE fetched_at IS NOT NULL
  UNION ALL SELECT id, DATE '2100-01-01', 'closed', 1 FROM sightings WHERE source_id LIKE '%7') GROUP BY id""")
def q_upsert_latest(spark, d):
    """The latest state of every sighting after a change set."""
    s = t(spark, d, "sightings").where(F.col("fetched_at").isNotNull()).select("id", "fetched_at", F.coalesce("verification_status", F.lit("")).alias("verification_status"))
    late = t(spark, d, "sightings").where(F.endswith("source_id", F.lit("7"))).select("id", F.lit("2100-01-01").cast("date").alias("fetched_at"), F.lit("closed").alias("verification_status"))
    return writers.upsert(s, late, "id", "fetched_at")


@query("SELECT * FROM (VALUES (1, 'b'), (2, 'a'), (3, NULL), (4, NULL)) AS x(n, incident_id)")
def q_incidents(spark, d):
    """The first incident in order, one of whose patterns is found."""
    inc = rows(spark, [(2, "a", ["disc", "saucer"]), (1, "b", [r"lake\s+\w+"]), (3, "c", [])], "ord int, id string, patterns array<string>")
    return text.detect_incident(rows(spark, [(1, "a Disc by LAKE Vio"), (2, "two saucers"), (3, "none"), (4, None)], "n int, body string"), "body", inc).select("n", "incident_id")


# ---- sources and sinks: written, read back ----


def _place(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/case-{uuid.uuid4().hex}"


def _file(spark: SparkSession, body: str) -> str:
    """A folder with one text file."""
    p = _place(spark)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(p)
    return p


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_json_lines(spark, d):
    p = _place(spark)
    writers.write_json(t(spark, d, "nation"), p)
    return readers.read_jsonl(spark, p, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT r_regionkey::VARCHAR AS a, r_name AS b FROM region")
def q_tsv(spark, d):
    p = _place(spark)
    writers.write_tsv(t(spark, d, "region").select("r_regionkey", "r_name"), p)
    return spark.read.csv(p, sep="\t", schema="a string, b string")


@query("SELECT n_name, n_regionkey::VARCHAR AS key FROM nation")
def q_per_key(spark, d):
    p = _place(spark)
    writers.write_per_key(t(spark, d, "nation").withColumn("r", F.col("n_regionkey")), "r", p)
    return spark.read.json(p).select("n_name", F.col("key").cast("string").alias("key"))


@query("SELECT r_name, 2 AS n FROM region")
def q_append_log(spark, d):
    """Two appends are kept, the third meets the cap."""
    p, r = _place(spark), t(spark, d, "region").select("r_name")
    done = [writers.append_jsonl(r, p), writers.append_jsonl(r, p), writers.append_jsonl(r, p, 1)]
    return readers.read_jsonl(spark, p, "r_name string").groupBy("r_name").agg((F.count(F.lit(1)) + F.lit(0 if done == [True, True, False] else 100)).cast("int").alias("n"))


@query("SELECT n_name, n_regionkey + 1 AS region FROM nation")
def q_swap(spark, d):
    """A table replaced by what is read from itself."""
    p = _place(spark)
    writers.swap(t(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("region")), p)
    writers.swap(spark.read.parquet(p).withColumn("region", F.col("region") + 1), p)
    return spark.read.parquet(p)


@query("SELECT n_name AS stem FROM nation WHERE n_regionkey <> 1")
def q_stale_files(spark, d):
    n = t(spark, d, "nation").select(F.col("n_name").alias("stem"), "n_regionkey")
    return writers.stale_files(n, n.where("n_regionkey = 1")).select("stem")


@query("SELECT 2 AS gone, 1 AS again")
def q_sweep(spark, d):
    """Two files are deleted; of a second sweep nothing is left but what is new."""
    a, b, c = (_file(spark, x) for x in "abc")
    files = spark.read.format("binaryFile").load([a, b]).select("path").cache()
    gone = writers.sweep(spark, files)
    rest = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load([a, b, c]).count()
    return spark.createDataFrame([(gone, rest)], "gone int, again int")


@query("SELECT * FROM (VALUES ('1', 'one', 'x' || chr(10) || 'y'), ('2', 'two, too', NULL)) AS t(a, b, c)")
def q_manifest(spark, d):
    """Quoted cells over several lines, a short and a long row."""
    return readers.read_manifest(spark, _file(spark, 'h1,h2,h3\n1,one,"x\ny"\n2,"two, too"\n'), ["a", "b", "c"])


@query("SELECT * FROM (VALUES (1, 'a', 'b'), (3, 'e, f', 'g')) AS t(row, x, y)")
def q_reports(spark, d):
    """Rows of any other number of fields are dropped; numbers count them."""
    return readers.read_reports(spark, _file(spark, 'a,b\nc,d,extra\n"e, f",g'), ["x", "y"])


@query("SELECT * FROM (VALUES ('a', 1), ('b', NULL)) AS t(id, n)")
def q_json_array(spark, d):
    """One array a file; a missing file adds nothing."""
    got = readers.read_json_array(spark, _file(spark, '[{"id": "a", "n": 1},\n {"id": "b"}]'), "id string, n int")
    return got.unionByName(readers.read_json_array(spark, _place(spark), "id string, n int"))


@query("SELECT * FROM (VALUES ('One', 'http://h/1', 'g1', 'Desk'), ('Two', 'http://h/2', 'http://h/2', NULL)) AS t(title, link, guid, source_name)")
def q_feed_items(spark, d):
    body = '<rss><channel><item><title>One</title><link>http://h/1</link><guid isPermaLink="false">g1</guid><source url="u">Desk</source></item><item><title>Two</title><link>http://h/2</link></item></channel></rss>'
    return readers.read_feed(spark, _file(spark, body)).select("title", "link", "guid", "source_name")


@query("SELECT * FROM (VALUES ('12', 'Reno'), ('14', 'Elko')) AS t(no, place)")
def q_pre_lines(spark, d):
    body = "<html><pre>head<br>12 <b>Reno</b>\n13 skip me<br/>14 Elko</pre><pre>15 late</pre></html>"
    return readers.read_pre_lines(spark, _file(spark, body), r"^(\d+)\s+(\S.*)$", ["no", "place"], "SKIP").select("no", "place")


@query("SELECT 'line one' || chr(10) || 'line two' || chr(10) AS text, true AS named")
def q_texts(spark, d):
    return readers.read_texts(spark, _file(spark, "line one\nline two")).select("text", F.col("stem").startswith("part").alias("named"))


@query("SELECT id, len(vector) AS n FROM text_vectors")
def q_read_vectors(spark, d):
    return readers.read_vectors(spark, f"{d}/text_vectors.parquet").select("id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("n"))


@query("SELECT 4 AS n, true AS whole")
def q_binary_files(spark, d):
    got = readers.read_files(spark, _file(spark, "abc"), "*.txt")
    return got.select(F.col("length").cast("int").alias("n"), (F.length("content") == F.col("length")).alias("whole"))


# ---- SQL for operators of the catalogue ----

ORACLE["q_rate_limit"] = """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, ts, rn, [ts] AS kept, true AS admitted, 0.0::DOUBLE AS retry FROM e WHERE rn = 1
  UNION ALL SELECT event_id, user_id, ts, rn, CASE WHEN len(k) < 3 THEN list_append(k, ts) ELSE k END, len(k) < 3, CASE WHEN len(k) < 3 THEN 0.0 ELSE epoch(k[1] + INTERVAL 6 HOUR) - epoch(ts) END
  FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e.ts - INTERVAL 6 HOUR) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT event_id, user_id, admitted, round(retry, 3) AS retry_after_s FROM r"""
ORACLE["q_strip_citations"] = "SELECT doc_id, title || '[^1] seen again[^3]' AS cleaned, 1 AS dropped FROM documents WHERE title IS NOT NULL"
ORACLE["q_hotspot"] = """
WITH c AS (SELECT format('{}:{}', floor((location.lat + 90) / 5)::INTEGER, floor((location.lng + 180) / 5)::INTEGER) AS cell, count(*)::DOUBLE AS x,
    min((floor((location.lat + 90) / 5) + 0.5) * 5 - 90) AS lat, min((floor((location.lng + 180) / 5) + 0.5) * 5 - 180) AS lng
  FROM sightings WHERE location.lat BETWEEN -90 AND 90 AND location.lng BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lng = 0) GROUP BY 1),
near AS (SELECT a.cell, b.x, row_number() OVER (PARTITION BY a.cell ORDER BY a.cell <> b.cell, (a.lat - b.lat) * (a.lat - b.lat) + (a.lng - b.lng) * (a.lng - b.lng), b.cell) AS rn FROM c a, c b),
lag AS (SELECT cell, avg(x) AS lag, count(*) AS w FROM near WHERE rn <= 9 GROUP BY cell),
g AS (SELECT count(*) AS n, avg(x) AS mean, stddev_pop(x) AS s FROM c),
z AS (SELECT cell, (lag - mean) / (s * sqrt((n / w - 1) / (n - 1))) AS z FROM lag, g),
k AS (SELECT cell, round(z, 4) AS z, round(abs(z), 30) AS a, 1 / (1 + 0.2316419 * abs(z)) AS q FROM z)
SELECT cell, z, round(2 * exp(-a * a / 2) / sqrt(2 * pi()) * q * (0.319381530 + q * (-0.356563782 + q * (1.781477937 + q * (-1.821255978 + q * 1.330274429)))), 6) AS p FROM k"""

_STOP = ", ".join(sql(w) for w in text.LEXICAL_STOP)
ORACLE["q_tfidf_topk"] = f"""
WITH r AS (SELECT id, min(title) AS title FROM search_index WHERE title IS NOT NULL GROUP BY id),
k AS (SELECT id, list_filter(regexp_extract_all(lower(title), '[a-z0-9_-]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM r),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM k) GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 50000),
w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM r))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
p AS (SELECT a.id, b.id AS other, round(sum(a.w * b.w), 3) AS score FROM u a JOIN u b USING (term) WHERE a.id <> b.id AND try_cast(regexp_extract(a.id, '[0-9]+') AS BIGINT) % 50 = 0 GROUP BY ALL)
SELECT id, other, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM p WHERE score >= 0.1) WHERE rank <= 6"""
_DAY = r"""coalesce(try_strptime(regexp_extract({v}, '^\s*(\d{{4}}-\d{{2}}-\d{{2}})(?:$|[T\s])', 1), '%Y-%m-%d'),
  try_strptime(regexp_extract({v}, '^\s*(\d{{1,2}}/\d{{1,2}}/\d{{4}})(?:$|\s)', 1), '%m/%d/%Y'))::DATE"""
_USABLE = "location.lat BETWEEN -90 AND 90 AND location.lng BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lng = 0)"
ORACLE["q_geo_range_join"] = f"""
WITH o AS (SELECT DISTINCT id, location.lat AS lat, location.lng AS lng, lower(trim(occurred_at_precision)) AS p, occurred_at AS stamp FROM correlations),
l AS (SELECT id, lat, lng, CASE p WHEN 'month' THEN 30 WHEN 'year' THEN 365 WHEN 'decade' THEN 3650 ELSE 3 END AS w,
  {_DAY.format(v=r"(CASE WHEN p IN ('month', 'year', 'decade') THEN regexp_replace(regexp_replace(trim(stamp), '^(\d{4})s?$', '\1-01'), '^(\d{4}-\d{2})$', '\1-01') ELSE stamp END)")} AS d FROM o),
r AS (SELECT DISTINCT id, location.lat AS lat, location.lng AS lng, {_DAY.format(v="occurred_at")} AS d FROM sightings WHERE lower(trim(occurred_at_precision)) IN ('day', 'minute') AND {_USABLE}),
m AS (SELECT l.id, l.lat, l.lng, l.d, l.w, r.id AS other, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(r.lat) - radians(l.lat)) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lng - l.lng) / 2), 2)))) AS km
  FROM l JOIN r ON r.d BETWEEN l.d - l.w::INTEGER AND l.d + l.w::INTEGER WHERE l.lat BETWEEN -90 AND 90 AND l.lng BETWEEN -180 AND 180 AND NOT (l.lat = 0 AND l.lng = 0)),
n AS (SELECT id, lat, lng, d, w, count(DISTINCT other) AS n, round(min(km), 3) AS nearest FROM m WHERE round(km, 3) <= 150 GROUP BY ALL)
SELECT l.id AS left_id, max(coalesce(n.n, 0)) AS match_count, min(n.nearest) AS nearest_km FROM l LEFT JOIN n ON n.id = l.id AND n.d = l.d AND n.w = l.w AND n.lat = l.lat AND n.lng = l.lng GROUP BY l.id"""
_SHAPE = " ".join(f"WHEN regexp_matches(x, {sql(p)}) THEN {sql(n)}" for n, p in text.SHAPES)
ORACLE["q_shape_tag"] = f"""
SELECT DISTINCT id, shape FROM (SELECT id, CASE {_SHAPE} END AS shape FROM (SELECT id, coalesce(blurb, '') || ' ' || concat_ws(' ', title, text) AS x FROM search_index)) WHERE shape IS NOT NULL"""
