"""Hybrid retrieval, citations between records, index publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions.numeric import cosine
from archivolt.functions.text import lexical_score, query_tokens, regex_spans


def hybrid_rank(corpus: DataFrame, vectors: DataFrame | None, query_text: str, query_vec: list[float] | None, scope: DataFrame | None = None, k: int = 8, dense_k: int = 32) -> DataFrame:
    """(id, score, dense, lex): 100 x cosine + 0.6 x lexical + 0.3 for a known incident; best ``k``.

    ``corpus`` has id, type, title, blurb, text, incident_id. Candidates are the
    ``dense_k`` nearest vectors and every row whose title holds an asked token;
    a scope is applied before ranking. Without vectors it is lexical only.
    """
    docs = corpus.where(F.coalesce(F.col("type") != "IMG", F.lit(True)))
    if scope is not None:
        docs = docs.join(scope.select("id").distinct(), "id", "left_semi")
    asked = query_tokens(query_text)
    in_title = F.lit(False)
    for t in asked:
        in_title = in_title | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(t))
    if vectors is not None and query_vec is not None:
        q = F.array(*[F.lit(float(x)) for x in query_vec])
        dense = vectors.join(docs.select("id"), "id", "left_semi").select("id", cosine(F.col("vector"), q).alias("dense")).where(F.col("dense").isNotNull()).orderBy(F.desc("dense"), "id").limit(dense_k)
        # at most dense_k rows
        docs = docs.join(F.broadcast(dense), "id", "left")
    else:
        docs = docs.withColumn("dense", F.lit(None).cast("double"))
    c = docs.where(F.col("dense").isNotNull() | in_title)
    c = c.withColumn("dense", F.coalesce("dense", F.lit(0.0))).withColumn("lex", lexical_score(F.col("title"), F.col("blurb"), F.col("text"), query_text))
    score = F.round(100 * F.col("dense") + 0.6 * F.col("lex") + F.when(F.col("incident_id").isNotNull(), 0.3).otherwise(0.0), 3)
    return c.select("id", score.alias("score"), F.round("dense", 4).alias("dense"), "lex").orderBy(F.desc("score"), "id").limit(k)


def citation_mentions(docs: DataFrame, key: str, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """(key, kind, token, ord, ctx): distinct citations of each record; lists of numbers are split."""
    spans = regex_spans(docs, key, text, patterns)
    tok = F.explode(F.split(F.regexp_replace("group", r"\s*,\s*", ","), ",")).alias("token")
    m = spans.select(key, "kind", tok, F.col("start").alias("ord"), "ctx").withColumn("token", F.upper(F.trim(F.regexp_replace("token", r"\s+", " ")))).where(F.col("token") != "")
    first = Window.partitionBy(key, "kind", "token").orderBy("ord")
    return m.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1).drop("rn")


def citation_edges(mentions: DataFrame, lookup: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(edges, dangling) of mentions against ``lookup`` (kind, token, to_id).

    An edge (from_id, to_id) has the count of distinct tokens, the last token as
    ``via`` and the first 3 contexts; self references go; mentions nobody
    resolves dangle.
    """
    hit = mentions.join(lookup.distinct(), ["kind", "token"]).where(F.col(key) != F.col("to_id"))
    w = Window.partitionBy(key, "to_id").orderBy("ord", "token")
    few = hit.withColumn("rn", F.row_number().over(w))
    edges = few.groupBy(F.col(key).alias("from_id"), "to_id").agg(
        F.count_distinct("token").alias("count"), F.max_by("token", F.struct("ord", "token")).alias("via"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "ctx")))), lambda x: x["ctx"]).alias("contexts"),
    )
    dangling = mentions.join(lookup.select("kind", "token").distinct(), ["kind", "token"], "left_anti").select(F.col(key).alias("from_id"), "kind", "token")
    return edges, dangling


def calendar_buckets(df: DataFrame, date_col: str, id_col: str, notability: Column, cap: int | None = None) -> DataFrame:
    """(mm_dd, entries): rows by day of the year, most notable first, then the latest year, then id."""
    d = df.where(F.col(date_col).isNotNull()).select(F.date_format(date_col, "MM-dd").alias("mm_dd"), F.year(date_col).alias("year"), F.col(id_col).alias("id"), notability.alias("notability"))
    if cap:
        w = Window.partitionBy("mm_dd").orderBy(F.desc("notability"), F.desc("year"), "id")
        d = d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    s = F.sort_array(F.collect_list(F.struct(-F.col("notability"), (-F.col("year")).alias("y"), "id", "year", "notability")))
    return d.groupBy("mm_dd").agg(F.transform(s, lambda x: F.struct(x["id"].alias("id"), x["year"].alias("year"), x["notability"].alias("notability"))).alias("entries"))


def group_index(df: DataFrame, key: str, title: str) -> DataFrame:
    """(key, n, titles): rows of a key and its distinct titles in order."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(title)).alias("titles"))


def atom_feed(df: DataFrame, n: int = 200) -> DataFrame:
    """(entry): XML of the ``n`` newest rows (id, title, updated, summary); rows without a date count as 1970."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    when = F.coalesce(F.col("updated").cast("date"), F.to_date(F.lit("1970-01-01")))
    top = df.withColumn("__d", when).orderBy(F.desc("__d"), "id").limit(n)
    entry = F.concat(
        F.lit("<entry><id>"), esc(F.col("id")), F.lit("</id><title>"), esc(F.col("title")), F.lit("</title><updated>"), F.date_format("__d", "yyyy-MM-dd"),
        F.lit("T00:00:00Z</updated><summary>"), esc(F.col("summary")), F.lit("</summary></entry>"),
    )
    return top.select("id", F.col("__d").alias("updated"), entry.alias("entry"))


def vault_note(df: DataFrame) -> DataFrame:
    """(id, note): Markdown with front matter from id, title, agency, tags, text, related."""
    from archivolt.functions.scalars import yaml_escape, yaml_list

    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), yaml_escape(F.col("title"))), F.concat(F.lit("agency: "), yaml_escape(F.col("agency"))), F.concat(F.lit("tags: "), yaml_list(F.col("tags"))), F.lit("---"))
    related = F.when(F.size("related") > 0, F.concat(F.lit("## Related\n"), F.array_join(F.transform("related", lambda r: F.concat(F.lit("- [["), r, F.lit("]]"))), "\n")))
    return df.select("id", F.concat_ws("\n\n", front, F.concat(F.lit("# "), F.col("title")), F.col("text"), related).alias("note"))
