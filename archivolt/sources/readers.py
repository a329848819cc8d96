"""Readers of ragged manifests, reports, feeds, pages, sidecars, pictures and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 14 positional columns of a release manifest.
MANIFEST = "redaction release_date title type video_pairing pdf_pairing blurb dvids_video_id video_title agency incident_date incident_location pdf_image_link modal_image".split()
#: The 11 positional columns of a headerless report file.
REPORT = "datetime city state country shape duration_seconds duration_text comments date_posted latitude longitude".split()
SIGHTING = (
    "id string, source string, source_id string, source_url string, fetched_at date, provenance string, verification_status string, title string, summary string, "
    "text string, occurred_at string, occurred_at_precision string, location struct<name:string,lat:double,lng:double,country:string>, shape string, duration_seconds int, "
    "media array<struct<type:string,url:string,local_path:string,caption:string>>, raw variant"
)


def _missing(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_manifest(spark: SparkSession, path: str, names: list[str] = MANIFEST) -> DataFrame:
    """Quoted CSV with a header and multi-line cells; short rows are padded with nulls, long ones cut; a BOM is dropped."""
    df = spark.read.csv(path, schema=strings(names), header=True, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True, encoding="UTF-8")
    return df.withColumn(names[0], F.regexp_replace(names[0], "^﻿", ""))


def read_reports(spark: SparkSession, path: str, names: list[str] = REPORT) -> DataFrame:
    """Headerless CSV; rows of any other number of fields are dropped; ``row`` counts all lines from 1, dropped ones too.

    One file is one source; its dense line numbers come from its order.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("o"))
    numbered = lines.rdd.zipWithIndex().map(lambda x: (x[0]["value"], x[1] + 1)).toDF("value string, row long")
    parsed = numbered.withColumn("f", F.from_csv("value", "dummy string" if not names else ", ".join(f"{n} string" for n in [*names, "surplus"])))
    fields = F.size(F.regexp_extract_all("value", F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1))) - F.when(F.endswith("value", F.lit(",")), 0).otherwise(1)
    return parsed.where(fields == len(names)).select("row", *[F.col(f"f.{n}").alias(n) for n in names])


def read_json_array(spark: SparkSession, path: str, schema: str = SIGHTING) -> DataFrame:
    """A file holding one JSON array; a missing file is an empty table."""
    if _missing(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.json(path, schema=schema, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and unreadable lines are skipped; a missing file is an empty table."""
    if _missing(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of an RSS feed: title, link, guid (the link if there is none), pub_date, source_name; an unreadable file is empty."""
    schema = "title string, link string, guid struct<_VALUE:string,_isPermaLink:string>, pubDate string, source struct<_VALUE:string,_url:string>"
    df = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(schema).load(path)
    return df.select("title", "link", F.coalesce("guid._VALUE", "link").alias("guid"), F.col("pubDate").alias("pub_date"), F.col("source._VALUE").alias("source_name"))


def read_pre_lines(spark: SparkSession, path: str, pattern: str, names: list[str], drop: str | None = None) -> DataFrame:
    """Lines of the first ``<pre>`` of an HTML page, tags stripped, ``<br>`` as line ends, cut by the groups of ``pattern``."""
    pages = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    lines = F.split(F.regexp_replace(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", ""), r"\n")
    out = pages.select(F.posexplode(lines).alias("line_no", "line")).where(F.col("line").rlike(pattern))
    if drop:
        out = out.where(~F.contains(F.lower("line"), F.lit(drop.lower())))
    return out.select("line_no", *[F.trim(F.regexp_extract("line", pattern, k)).alias(n) for k, n in enumerate(names, 1)])


def html_text(html):
    """Visible text of an HTML column: scripts, styles and tags go, white space is squeezed (entities stay)."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]+>", " "), r"\s+", " "))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of whole text files."""
    name = F.col("_metadata.file_name")
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """(path, length, modificationTime, content) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def pick_text(native, ocr, least_bytes: int = 500):
    """The embedded text if it has at least ``least_bytes`` bytes, else the scanned one, else the thin one."""
    return F.when(F.octet_length(native) >= least_bytes, native).otherwise(F.coalesce(F.nullif(ocr, F.lit("")), native))


def keep_image(w, h):
    """No full page scans, no icons."""
    return ~((w >= 1100) & (h >= 1400)) & (F.least(w, h) >= 240)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", F.col("vector").cast("array<float>").alias("vector"))


def with_geocode(df: DataFrame, name: str, cache: DataFrame, skip: list[str]) -> DataFrame:
    """Add lat, lng and ``cached`` from a cache table (name, lat, lng); skipped names stay null, a cached null counts as known."""
    c = cache.dropDuplicates(["name"]).select(F.col("name").alias("__n"), F.col("lat").alias("geo_lat"), F.col("lng").alias("geo_lng"), F.lit(True).alias("cached"))
    key = F.when(~F.lower(F.trim(name)).isin([s.lower() for s in skip]), F.col(name))
    return df.withColumn("__k", key).join(c, F.col("__k") == F.col("__n"), "left").withColumn("cached", F.coalesce("cached", F.lit(False))).drop("__k", "__n")


@F.pandas_udf(T.ArrayType(T.StringType()))
def jpeg_markers(content):
    """Names of the application segments of JPEG files, by walking their headers (no decoder)."""
    import pandas as pd

    def walk(b) -> list[str]:
        if not isinstance(b, (bytes, bytearray)) or b[:2] != b"\xff\xd8":
            return []
        out, i = [], 2
        while i + 4 <= len(b) and b[i] == 0xFF:
            m, n = b[i + 1], int.from_bytes(b[i + 2 : i + 4], "big")
            if m == 0xDA:
                break
            if 0xE0 <= m <= 0xEF:
                tag = b[i + 4 : i + 4 + 12].split(b"\0")[0].decode("latin-1", "replace")
                out.append(f"APP{m - 0xE0}:{tag}")
            elif m == 0xFE:
                out.append("COM")
            i += 2 + n
        return out

    return pd.Series([walk(b) for b in content])


def gps_degrees(deg, minute, second, ref):
    """Degrees from parts and hemisphere letter."""
    v = deg + minute / 60 + second / 3600
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)
