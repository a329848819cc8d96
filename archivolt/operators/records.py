"""Assembling record tables: unions of sources, child pictures, entity tables, splits, validation, views."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import scalars
from archivolt.functions.text import entity_id
from archivolt.operators.dualtree import usable
from archivolt.operators.linkage import mode_first_seen
from archivolt.session import ensure_importable


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """A temporary view per parquet table of a directory, for ``spark.sql``."""
    ensure_importable(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)
    names = sorted(os.path.basename(s.getPath().toString()).removesuffix(".parquet") for s in found if s.getPath().getName().endswith(".parquet"))
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return names


def unify(sources: dict[str, DataFrame], ladder: dict[str, str] | None = None) -> DataFrame:
    """All sources in one table, missing columns null, ids prefixed by their source, trust level filled in."""
    out = None
    for name, df in sources.items():
        d = df.withColumn("source", F.lit(name)) if "source" not in df.columns else df
        d = d.withColumn("id", F.col("id").cast("string"))
        d = d.withColumn("id", F.when(F.contains("id", F.lit(":")), F.col("id")).otherwise(F.concat(F.lit(f"{name}:"), F.col("id"))))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    level = scalars.provenance(F.col("source"), ladder)
    return out.withColumn("provenance", F.coalesce("provenance", level) if "provenance" in out.columns else level)


def child_images(records: DataFrame, extracted: DataFrame) -> DataFrame:
    """Synthetic picture rows of records: inner on the file a picture was cut from; a file of several records belongs to the last."""
    from archivolt.operators.joins import last_owner

    own = last_owner(records, "id", "primary_local").withColumnRenamed("id", "extracted_from_id")
    x = extracted.join(own, F.col("src_pdf") == F.col("path")).join(records.select(F.col("id").alias("extracted_from_id"), "title", "agency"), "extracted_from_id")
    return x.select(
        scalars.child_id(F.col("extracted_from_id"), F.col("page"), F.col("file")).alias("id"), F.concat("title", F.lit(" — image (page "), F.col("page"), F.lit(")")).alias("title"),
        "agency", F.lit("IMG").alias("type"), F.lit("").alias("text"), "extracted_from_id", F.col("page").alias("extracted_page"), F.array("file").alias("primary_local"),
    )


def search_index(records: DataFrame, texts: DataFrame, links: DataFrame, extracted: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Records with their texts and links (empty lists if none), their cut-out pictures and the cases of another list."""
    r = records.join(texts.select(F.col("stem").alias("id"), F.col("text").alias("__t")), "id", "left").withColumn("text", F.coalesce("__t", F.lit(""))).drop("__t")
    r = r.join(links, "id", "left")
    for name, kind in links.dtypes:
        if kind.startswith("array"):
            r = r.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    out = r.unionByName(child_images(records, extracted), allowMissingColumns=True)
    return out if cases is None else out.unionByName(cases, allowMissingColumns=True)


def entity_table(mentions: DataFrame) -> DataFrame:
    """(entity_id, surface, type, count, record_ids) of mentions (record_id, type, surface, ord): most frequent surface, first type."""
    m = mentions.withColumn("entity_id", entity_id(F.col("type"), F.col("surface")))
    name = mode_first_seen(m, "entity_id", "surface", "ord").select("entity_id", "surface")
    agg = m.groupBy("entity_id").agg(F.min_by("type", "ord").alias("type"), F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_set("record_id")).alias("record_ids"))
    return agg.join(name, "entity_id").orderBy(F.desc("count"), "entity_id")


def first_rows(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of every key in a stated order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") == 1).drop("__r")


def head_rows(df: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of every key in a stated order (samples, related items)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def split_sightings(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(official, civilian with coordinates, rest): disjoint, together everything. ``day`` must be set to be comparable."""
    official = F.coalesce(F.col("provenance") == "official", F.lit(False))
    placed = usable(F.col("location.lat"), F.col("location.lng")) & F.col("day").isNotNull()
    return df.where(official & F.col("day").isNotNull()), df.where(~official & placed), df.where(~(official & F.col("day").isNotNull()) & ~(~official & placed))


def approved_claims(enrichments: DataFrame, status: str = "approved") -> DataFrame:
    """(kind, id, run_id, claim…) of claims with a status, across entities, their runs and the runs' claims."""
    runs = enrichments.select("kind", "id", F.explode("runs").alias("r"))
    claims = runs.select("kind", "id", F.col("r.run_id").alias("run_id"), F.explode("r.claims").alias("c"))
    return claims.where(F.col("c.status") == status).select("kind", "id", "run_id", "c.*") if "id" not in claims.schema["c"].dataType.names else claims.where(F.col("c.status") == status).select("kind", F.col("id").alias("entity_id"), "run_id", "c.*")


def validate(df: DataFrame, fields: list[str], longest: dict[str, int], known: DataFrame | None = None, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): field allow-list, length limits, and keys that must exist."""
    reason = F.when(~F.col("field").isin(fields) | F.col("field").isNull(), "field")
    for c, n in longest.items():
        reason = reason.when(F.coalesce(F.length(c), F.lit(0)) > n, c)
    d = df
    if known is not None:
        d = d.join(known.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
        reason = reason.when(F.col("__k").isNull(), "unknown")
    d = d.withColumn("reason", reason)
    d = d.drop("__k") if known is not None else d
    return d.where(F.col("reason").isNull()).drop("reason"), d.where(F.col("reason").isNotNull())


def resolution_rate(edges: DataFrame, dangling: DataFrame) -> DataFrame:
    """(edges, dangling, rate): share of citations resolved, in percent."""
    both = edges.select(F.lit(1).alias("e"), F.lit(0).alias("d")).union(dangling.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("edges"), F.coalesce(F.sum("d"), F.lit(0)).alias("dangling"), F.round(100 * F.sum("e") / F.count(F.lit(1)), 2).alias("rate"))


def tallies(df: DataFrame, score: str, cuts: list[float]) -> DataFrame:
    """Rows at or above each cut."""
    return df.agg(*[F.count_if(F.col(score) >= c).alias(f"ge_{c:g}".replace(".", "_")) for c in cuts])


def significant(df: DataFrame, p: float = 0.05) -> DataFrame:
    return df.where((F.col("p") < p) & (F.col("n") > 0))


def timeline(df: DataFrame, when: str, tie: str) -> DataFrame:
    """By the written date, rows without one last."""
    missing = F.coalesce(F.col(when).isin("", "Unknown"), F.lit(True))
    return df.orderBy(missing, when, tie)


def prompt(df: DataFrame, order: str, title: str, text: str, cap: int = 4000) -> DataFrame:
    """(prompt): numbered source blocks in order; for the few rows of a ranking."""
    block = F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col(title), F.lit("\n"), F.left(F.coalesce(text, F.lit("")), F.lit(cap)))
    d = df.withColumn("n", F.row_number().over(Window.orderBy(order)))
    return d.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("prompt"))
