"""Query catalogue of the engine's own operators over the driver's tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import dates, numeric, scalars, text
from archivolt.operators import graph, joins, linkage, records, retrieval, spatial, topics
from archivolt.operators.dualtree import haversine_km, sighting_points, usable, written_day
from archivolt.session import cut_to_table, table
from archivolt.sources import writers
from archivolt.streaming import stateful

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it must equal."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


# ---- relational core (scans, filters, joins, aggregates, windows, set operations) ----


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q_pricing_summary(spark, d):
    li = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def q_local_supplier_volume(spark, d):
    g = t(spark, d, "region").where("r_name = 'ASIA'").join(t(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = g.join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    o = o.join(t(spark, d, "supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("n_nationkey")))
    return o.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def q_semi_join(spark, d):
    """Membership filter: a left semi join."""
    r = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").join(r, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def q_memo_antijoin(spark, d):
    """Rows still to be done: keys that a cache does not know."""
    cache = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("verdict", F.lit(True))
    return joins.memo_split(t(spark, d, "customer").select("c_custkey"), cache, "c_custkey")[1]


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS lvl
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_cube_rollup(spark, d):
    c = t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().alias("lvl"))


@query("""
SELECT year, season, count(*) AS n FROM (SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS season FROM orders)
GROUP BY GROUPING SETS ((year, season), (year), ())""")
def q_grouping_sets(spark, d):
    t(spark, d, "orders").selectExpr("year(o_orderdate) AS year", "quarter(o_orderdate) AS season").createOrReplaceTempView("seasons")
    return spark.sql("SELECT year, season, count(*) AS n FROM seasons GROUP BY GROUPING SETS ((year, season), (year), ())")


@query("""
SELECT o_custkey, o_orderkey, lag(o_totalprice) OVER w AS previous, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS by_price, ntile(4) OVER (w) AS quarter
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def q_window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.lag("o_totalprice").over(w).alias("previous"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"),
        F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("by_price"), F.ntile(4).over(w).alias("quarter"),
    )


@query("""
(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")
def q_set_ops(spark, d):
    c, s = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).exceptAll(t(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@query("""
SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""")
def q_union_sources(spark, d):
    c = t(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""
WITH RECURSIVE up(id, lvl) AS (SELECT 1, 0 UNION ALL SELECT id * 2, lvl + 1 FROM up WHERE lvl < 10) SELECT id, lvl FROM up""")
def q_recursive_cte(spark, d):
    return spark.sql("WITH RECURSIVE up(id, lvl) AS (SELECT 1, 0 UNION ALL SELECT id * 2, lvl + 1 FROM up WHERE lvl < 10) SELECT id, lvl FROM up")


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def q_top_k(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query()
def q_approximate(spark, d):
    """Approximate distinct counts and percentiles (estimates: no SQL equal)."""
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


@query()
def q_sample(spark, d):
    """A seeded sample (a sampling operator)."""
    return t(spark, d, "orders").sample(0.1, seed=7)


@query("""
SELECT e.event_id, (SELECT p.value FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts < e.ts OR (p.ts = e.ts)) ORDER BY p.ts DESC, p.value DESC LIMIT 1) AS value_as_of
FROM events e WHERE e.event_type = 'view'""")
def q_as_of_join(spark, d):
    """Each view with the user's latest purchase at or before it."""
    e = t(spark, d, "events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of_join(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "value").select("event_id", "value_as_of")


@query("""
WITH a AS (SELECT o_orderkey AS id, (epoch(o_orderdate) / 86400)::BIGINT AS start, (epoch(o_orderdate) / 86400)::BIGINT + 2 AS stop FROM orders WHERE o_orderpriority LIKE '1%'),
b AS (SELECT o_orderkey AS id, (epoch(o_orderdate) / 86400)::BIGINT AS start, (epoch(o_orderdate) / 86400)::BIGINT + 1 AS stop FROM orders WHERE o_orderpriority LIKE '5%')
SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.start <= b.stop AND b.start <= a.stop""")
def q_overlap_join(spark, d):
    """Overlapping intervals of two order classes."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("start"), "o_orderpriority")
    a = o.where(F.startswith("o_orderpriority", F.lit("1"))).select("id", "start", (F.col("start") + 2).alias("stop"))
    b = o.where(F.startswith("o_orderpriority", F.lit("5"))).select("id", "start", (F.col("start") + 1).alias("stop"))
    return joins.overlap_join(a, b, 4)


# ---- text ----

PLAIN_PII = [
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[redacted email]"),
    (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[redacted ssn]"),
    (r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "[redacted ip]"),
    (r"[0-9](?:[ -]?[0-9]){12,18}", "[redacted card]"),
]
_pii_sql = "text"
for _p, _m in PLAIN_PII:
    _pii_sql = f"regexp_replace({_pii_sql}, '{_p}', '{_m}', 'g')"


@query(f"SELECT doc_id, md5({_pii_sql}) AS h FROM documents")
def q_pii_redact(spark, d):
    """Portable rules over every text, compared by digest."""
    return t(spark, d, "documents").select("doc_id", F.md5(text.redact_pii(F.col("text"), PLAIN_PII)).alias("h"))


@query()
def q_pii_phone(spark, d):
    """All five rules with their look-arounds; SQL engines without look-around cannot say them."""
    return t(spark, d, "documents").select("doc_id", text.redact_pii(F.col("text")).alias("redacted")).where(F.contains("redacted", F.lit("[redacted ")))


TAGS = [("weather", "(?i)cloud|squall|barometer|isobar"), ("law", "(?i)statute|hearing|verdict"), ("radar", "(?i)radar|transponder|beacon"), ("sky", "(?i)comet|planet|meteor")]


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)cloud|squall|barometer|isobar') THEN 'weather' WHEN regexp_matches(text, '(?i)statute|hearing|verdict') THEN 'law'
  WHEN regexp_matches(text, '(?i)radar|transponder|beacon') THEN 'radar' WHEN regexp_matches(text, '(?i)comet|planet|meteor') THEN 'sky' END AS tag FROM documents""")
def q_first_match_tag(spark, d):
    return t(spark, d, "documents").select("doc_id", text.first_match(F.col("text"), TAGS).alias("tag"))


@query()
def q_shape_tag(spark, d):
    """Craft shape by ordered patterns with word boundaries (whose meaning differs between regex engines)."""
    return t(spark, d, "search_index").select("id", text.detect_shape(F.col("blurb"), F.concat_ws(" ", "title", "text")).alias("shape")).where(F.col("shape").isNotNull()).distinct()


KEYWORDS = ["radar", "comet", "verdict", "barometer", "editor", "shutter", "nurse", "runway", "signal", "folder"]


@query("""
SELECT doc_id, kw, strpos(text, kw)::INTEGER AS at, trim(regexp_replace(text[greatest(1, strpos(text, kw) - 50) : strpos(text, kw) + length(kw) + 59], '\\s+', ' ', 'g')) AS ctx FROM (
  SELECT doc_id, text, kw, o, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rn
  FROM documents, (SELECT unnest(['radar', 'comet', 'verdict', 'barometer', 'editor', 'shutter', 'nurse', 'runway', 'signal', 'folder']) AS kw, unnest(range(10)) AS o)
  WHERE contains(text, kw)) WHERE rn <= 8""")
def q_keyword_hits(spark, d):
    """First hit of each keyword with its context, at most 8 a document (the operator's cap)."""
    hits = t(spark, d, "documents").select("doc_id", "text", F.explode(text.keyword_hits(F.col("text"), KEYWORDS)).alias("x"))
    return hits.select("doc_id", F.col("x.kw").alias("kw"), F.instr("text", F.col("x.kw")).alias("at"), F.col("x.ctx").alias("ctx"))


WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def words(c: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


@query(f"""
SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORDS_SQL}) AS term FROM documents) GROUP BY term HAVING count(*) >= 2""")
def q_token_df(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(words())).alias("term"))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= 2)


@query(f"""
WITH tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents) GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 50000),
w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN v USING (term))
SELECT id, count(*) AS terms, round(max(w / n), 6) AS top FROM w JOIN (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY id) USING (id) GROUP BY id""")
def q_tfidf_weights(spark, d):
    """TF-IDF weights of all documents, summed up per document."""
    w = joins.tfidf(t(spark, d, "documents"), "doc_id", words(), (1, 1))
    return w.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("w"), 6).alias("top"))


@query()
def q_tfidf_topk(spark, d):
    """The six most similar titles of every fiftieth record, against all records (exact; too slow as SQL on whole tables)."""
    r = t(spark, d, "search_index").where(F.col("title").isNotNull()).groupBy("id").agg(F.min("title").alias("title"))
    w = joins.tfidf(r, "id", text.tokens(F.col("title")))
    asked = r.where(F.regexp_extract("id", r"([0-9]+)", 1).try_cast("bigint") % 50 == 0).select("id")
    return joins.similarity_topk(w, queries=asked)


@query("""
SELECT min(doc_id) AS keep, count(*) AS copies, sha256(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1""")
def q_exact_dup(spark, d):
    """Groups of documents with the same text; the first one is kept."""
    g = t(spark, d, "documents").where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("copies"))
    return g.where(F.col("copies") > 1).select("keep", "copies", "h")


@query()
def q_hamming_join(spark, d):
    """64-bit hashes of record titles at most 3 bits apart, by bands (exact), with every record's class.

    A class is the records of one hash, named by its least id. kind ``pair``: two
    classes and their distance; ``title``: a class and the least id of each title
    in it other than its own, distance 0; ``member``: a class and each of its
    records. ``members`` is the size of class a. A title without tokens has no hash.
    """
    r = t(spark, d, "search_index").where(F.col("title").isNotNull() & F.col("id").isNotNull()).select("id", "title", text.tokens(F.col("title")).alias("toks")).withColumn("key", F.array_join("toks", " "))
    h = joins.simhash64(r.select("key", "toks").dropDuplicates(["key"]), "key", F.col("toks"))
    rec = cut_to_table(r.select("id", "title", "key").join(h, "key").select("id", "title", "h").distinct(), "hashes")
    c = cut_to_table(rec.groupBy("h").agg(F.min("id").alias("a_id"), F.min_by("title", F.struct("id", "title")).alias("own"), F.count_distinct("id").alias("members")), "classes")
    k = c.select(F.col("a_id").alias("id"), "h")
    pairs = joins.hamming_join(k, k, "id", "h", 3, 64).join(c.groupBy("a_id").agg(F.max("members").alias("members")), "a_id")
    links = rec.join(c, "h")
    titles = links.where(F.col("title") != F.col("own")).groupBy("h", "a_id", "title", "members").agg(F.min("id").alias("b_id"))
    rows = lambda df, kind, distance: df.select(F.lit(kind).alias("kind"), "a_id", "b_id", distance.cast("int").alias("distance"), "members")
    zero = F.lit(0)
    return rows(pairs, "pair", F.col("distance")).union(rows(titles, "title", zero)).union(rows(links.select("a_id", F.col("id").alias("b_id"), "members").distinct(), "member", zero))


@query()
def q_redactions(spark, d):
    """Redaction marks grouped by fingerprint."""
    return text.redaction_fingerprints(t(spark, d, "documents"), "doc_id", "text")


SEEDS = ["BLUE LANTERN", "PROJECT HEARTH", "QUIET HARBOUR"]


@query()
def q_codenames(spark, d):
    stop = "SECRET FILE OFFICE REPORT THE AND FOR".split()
    n = text.codenames(F.col("text"), SEEDS, stop, ["PROGRAM OFFICE"])
    return t(spark, d, "documents").select("doc_id", F.explode(n).alias("codename"))


@query()
def q_entities(spark, d):
    """Rule-based entity surfaces and how many documents name them."""
    e = t(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(text.rule_entities(F.col("text"))).alias("surface"))
    return e.groupBy(text.entity_id(F.lit("NAME"), F.col("surface")).alias("entity_id")).agg(F.count_distinct("doc_id").alias("n_docs"), F.min("surface").alias("surface"))


@query(r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+) pages', 1))::BIGINT AS n FROM documents),
r AS (SELECT c_custkey * 40 AS lo, c_custkey * 40 + 29 AS hi, c_custkey AS target FROM customer WHERE c_custkey <= 30)
SELECT DISTINCT doc_id, n, target FROM m LEFT JOIN r ON n BETWEEN lo AND hi""")
def q_range_lookup(spark, d):
    """Numbers cited in texts resolved to number ranges; a number between ranges dangles."""
    m = t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+) pages"), F.lit(1))).alias("n")).select("doc_id", F.col("n").cast("bigint").alias("n"))
    r = t(spark, d, "customer").where("c_custkey <= 30").select((F.col("c_custkey") * 40).alias("lo"), (F.col("c_custkey") * 40 + 29).alias("hi"), F.col("c_custkey").alias("target"))
    return joins.range_lookup(m, r).select("doc_id", "n", F.col("hit.target").alias("target")).distinct()


@query()
def q_citation_edges(spark, d):
    """Section numbers cited in documents, resolved to the first document of that section; counts, last token, first contexts."""
    docs = t(spark, d, "documents").where(F.col("text").isNotNull())
    m = retrieval.citation_mentions(docs, "doc_id", "text", text.CITATIONS)
    lookup = m.groupBy("kind", "token").agg(F.min("doc_id").alias("to_id"))
    return retrieval.citation_edges(m, lookup, "doc_id")[0]


QUESTION = "gust of the barometer near the radar beacon"


@query(r"""
WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS t FROM documents),
p AS (SELECT *, coalesce(nullif(strpos(lower(t), 'gust'), 0), nullif(strpos(lower(t), 'barometer'), 0), nullif(strpos(lower(t), 'near'), 0), nullif(strpos(lower(t), 'radar'), 0), nullif(strpos(lower(t), 'beacon'), 0), 0) AS a FROM s)
SELECT doc_id, CASE WHEN a = 0 THEN left(t, 320) ELSE (CASE WHEN a > 81 THEN '…' ELSE '' END) || substr(t, greatest(1, a - 80), 320)
  || (CASE WHEN greatest(1, a - 80) - 1 + 320 < length(t) THEN '…' ELSE '' END) END AS snippet FROM p""")
def q_snippet(spark, d):
    return t(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), QUESTION).alias("snippet"))


@query()
def q_hybrid_rank(spark, d):
    """Dense and lexical ranking of the records against the vector of one of them (a top-k report)."""
    v = t(spark, d, "text_vectors").groupBy("id").agg(F.max("vector").alias("vector"))
    q = v.where(F.size("vector") == 384).orderBy("id").limit(1).collect()
    c = t(spark, d, "search_index").groupBy("id").agg(*[F.min(x).alias(x) for x in ("type", "title", "blurb", "text")]).withColumn("incident_id", F.lit(None).cast("string"))
    return retrieval.hybrid_rank(c, v, "orange lights over the lighthouse", list(q[0]["vector"]) if q else None)


@query()
def q_strip_citations(spark, d):
    """Citation marks beyond the number of sources are dropped and counted."""
    valid = F.sequence(F.lit(1), F.lit(3))
    s = text.strip_citations(F.concat(F.col("title"), F.lit("[^1] seen[^9] again[^3]")), valid)
    return t(spark, d, "documents").where(F.col("title").isNotNull()).select("doc_id", s["text"].alias("cleaned"), s["dropped"].alias("dropped"))


@query("""
SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events""")
def q_json_repair(spark, d):
    """A JSON object with a trailing comma, in prose: found, repaired, read."""
    broken = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```\nas asked."))
    return t(spark, d, "events").select("event_id", F.try_variant_get(text.json_block(broken), "$.k", "bigint").alias("k"))


@query("""
SELECT p_partkey, coalesce(nullif(left(trim(regexp_replace(regexp_replace(trim(p_name || ' / ' || p_type), '\n', ' ', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 160), ''), 'untitled') AS slug FROM part""")
def q_slug(spark, d):
    return t(spark, d, "part").select("p_partkey", scalars.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query(r"""
SELECT DISTINCT source_url, regexp_extract(source_url, '^[a-z]+://([^/?#]+)', 1) AS host,
  CASE WHEN regexp_matches(lower(regexp_replace(source_url, '[?#].*$', '')), '\.(jpe?g|png|gif|webp|tiff?|bmp)$') THEN 'images'
       WHEN regexp_matches(lower(regexp_replace(source_url, '[?#].*$', '')), '\.(mp4|mov|m4v|webm|avi|mkv)$') THEN 'videos' ELSE 'docs' END AS kind
FROM search_index WHERE source_url IS NOT NULL""")
def q_url_parts(spark, d):
    u = t(spark, d, "search_index").where(F.col("source_url").isNotNull()).select("source_url").distinct()
    return u.select("source_url", F.regexp_extract("source_url", "^[a-z]+://([^/?#]+)", 1).alias("host"), scalars.kind_for(F.col("source_url")).alias("kind"))


@query()
def q_local_paths(spark, d):
    """Where each linked file is kept."""
    return t(spark, d, "search_index").where(F.col("source_url").isNotNull()).select("id", scalars.local_path_for(F.col("source_url")).alias("path")).distinct()


@query("""
SELECT o_orderkey, CASE WHEN y <= 26 THEN 2000 + y ELSE 1900 + y END AS moving, CASE WHEN y <= 49 THEN 2000 + y ELSE 1900 + y END AS half, 2000 + y AS always, CASE WHEN y <= 68 THEN 2000 + y ELSE 1900 + y END AS posix
FROM (SELECT o_orderkey, (year(o_orderdate) % 100)::INTEGER AS y FROM orders)""")
def q_date_pivot(spark, d):
    """One M/D/YY text under four two-digit-year rules."""
    s = F.date_format("o_orderdate", "M/d/yy")
    rules = {"moving": 26, "half": 49, "always": None, "posix": 68}
    return t(spark, d, "orders").select("o_orderkey", *[F.year(dates.parse_us(s, p)).alias(n) for n, p in rules.items()])


@query()
def q_html_unescape(spark, d):
    """Summaries with their entities resolved."""
    s = t(spark, d, "sightings").where(F.contains("summary", F.lit("&")))
    return s.select("id", scalars.html_unescape("summary").alias("summary")).distinct()


@query()
def q_titles(spark, d):
    """Titles assembled from shape, place and date."""
    s = t(spark, d, "sightings")
    return s.select("id", scalars.sighting_title(F.col("shape"), F.col("location.name"), F.col("occurred_at"), F.col("summary")).alias("title")).distinct()


@query()
def q_jaro_winkler(spark, d):
    """Jaro-Winkler of every two different part names (64 names)."""
    n = t(spark, d, "part").select("p_name").distinct().withColumn("w", F.explode(F.array_distinct(F.split("p_name", " "))))
    p = n.select(F.col("p_name").alias("a"), "w").join(n.select(F.col("p_name").alias("b"), "w"), "w").where("a < b").select("a", "b").distinct()
    return p.select("a", "b", F.round(text.jaro_winkler("a", "b"), 6).alias("jw"))


# ---- similarity and linkage ----


@query("""
WITH v AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2])) / (a.n * b.n), 6) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT q, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INTEGER AS rank FROM s) WHERE rank <= 10""")
def q_knn(spark, d):
    """Exact nearest vectors of every fiftieth vector against all (queries by rule)."""
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    return joins.knn(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding")


@query("""
SELECT label, count(*) AS n FROM embeddings GROUP BY label""")
def q_label_counts(spark, d):
    return t(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query()
def q_zero_shot(spark, d):
    """Softmax of each vector against the labels' centres, and the tags above the threshold."""
    e = t(spark, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("label").limit(64).collect()
    centres = [F.array(*[F.lit(float(p["x"])) for p in r["v"]]) for r in c]
    cos = F.array(*[numeric.cosine(F.col("embedding"), x) for x in centres])
    names = [str(r["label"]) for r in c]
    e = e.withColumn("cos", cos)
    return e.select("vec_id", F.transform(numeric.softmax(F.col("cos"), 30.0), lambda x: F.round(x, 6)).alias("p"), F.transform(numeric.top_labels(F.col("cos"), names), lambda x: x["label"]).alias("tags"))


@query()
def q_nms(spark, d):
    """Boxes made from the vectors of a label, overlapping ones suppressed."""
    b = t(spark, d, "embeddings").select("label", F.struct(
        F.round(F.abs(F.col("embedding")[0]) * 2, 4).alias("score"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("label"),
        *[(F.round(F.abs(F.col("embedding")[i]) * 40) + o).alias(n) for n, i, o in (("x1", 1, 0), ("y1", 2, 0), ("x2", 3, 12), ("y2", 4, 12))]).alias("box"))
    return b.groupBy("label").agg(F.collect_list("box").alias("boxes")).select("label", F.inline(numeric.suppress(F.col("boxes"))).alias("score", "box_label", "x1", "y1", "x2", "y2"))


@query("""
SELECT event_id, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 4) AS jd FROM events""")
def q_julian_day(spark, d):
    return t(spark, d, "events").select("event_id", F.round(numeric.julian_day(F.col("ts")), 4).alias("jd"))


@query()
def q_celestial(spark, d):
    """Sun and moon over a fixed place at each event."""
    e = t(spark, d, "events").select("event_id", numeric.julian_day(F.col("ts")).alias("jd"))
    sun = numeric.sun_position(F.col("jd"))
    aa = numeric.alt_az(F.col("jd"), sun["ra"], sun["dec"], F.lit(51.48), F.lit(0.0))
    return e.select("event_id", F.round(aa["alt"], 3).alias("sun_alt"), F.round(aa["az"], 3).alias("sun_az"), numeric.moon_phase(F.col("jd")).alias("phase"))


@query()
def q_score_pairs(spark, d):
    """Official entries against case-like ones of another source in the same year, by the weighted score."""
    c = t(spark, d, "correlations").where(F.lower(F.trim("occurred_at_precision")).isin("day", "minute"))
    day = F.date_from_unix_date(written_day(F.col("occurred_at")))
    r = c.select(F.col("id").alias("record_id"), "source", day.alias("incident_date"), F.col("location.name").alias("incident_location"), "title", F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"))
    return linkage.score_pairs(r)


@query()
def q_clusters(spark, d):
    """Linked entries grouped, with consensus date and place."""
    c = t(spark, d, "correlations").where(F.lower(F.trim("occurred_at_precision")).isin("day", "minute"))
    day = F.date_from_unix_date(written_day(F.col("occurred_at")))
    r = c.select(F.col("id").alias("record_id"), "source", day.alias("incident_date"), F.col("location.name").alias("incident_location"), "title", F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"))
    e = cut_to_table(linkage.score_pairs(r), "scores")  # read by the components and by the clusters
    return linkage.clusters(r, e, linkage.connected_components(e)).select("cluster_id", F.size("members").alias("n"), "consensus_date", "consensus_location")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, -l_suppkey AS b FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.095),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, other) AS (SELECT a, b FROM b UNION SELECT r.id, b.b FROM r JOIN b ON r.other = b.a)
SELECT id, min(least(id, other)) AS component FROM r GROUP BY id""")
def q_components(spark, d):
    """Components of the graph of parts and suppliers that share certain line items."""
    e = t(spark, d, "lineitem").where("l_quantity >= 49 AND l_discount >= 0.095").select(F.col("l_partkey").alias("a"), (-F.col("l_suppkey")).alias("b"))
    return linkage.connected_components(e)


@query()
def q_components_all(spark, d):
    """Components of the graph of parts and suppliers over all line items; ``q_components`` is the small graph its SQL can afford.

    Supplier k is -1 - k, since keys begin at 0 and part 0 is no supplier.
    """
    return linkage.connected_components(t(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")))


@query("""
SELECT CASE WHEN rn > 1 THEN p_name || '__' || rn ELSE p_name END AS id, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)""")
def q_disambiguate(spark, d):
    return linkage.disambiguate(t(spark, d, "part").select(F.col("p_name").alias("id"), "p_partkey"), "id", "p_partkey")


@query("""
SELECT c_nationkey, arg_min(c_mktsegment, (-n, first)) AS c_mktsegment, max(n) AS n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL) GROUP BY 1""")
def q_mode_tiebreak(spark, d):
    return linkage.mode_first_seen(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


# ---- place and time ----

_HAV = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def _official(spark, d) -> DataFrame:
    """Every official entry as a left side of ``geo_range_join``: its first day (null if it has none) and the window of its precision."""
    precision = F.lower(F.trim("occurred_at_precision"))
    window = scalars.by_map(precision, {"minute": "3", "day": "3", "month": "30", "year": "365", "decade": "3650"}, "3").cast("int")
    whole = F.regexp_replace(F.regexp_replace(F.trim("occurred_at"), r"^(\d{4})s?$", "$1-01"), r"^(\d{4}-\d{2})$", "$1-01")
    day = written_day(F.when(precision.isin("month", "year", "decade"), whole).otherwise(F.col("occurred_at")))
    return t(spark, d, "correlations").select("id", F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"), day.alias("day"), window.alias("window"))


def _civilian(spark, d) -> DataFrame:
    """Sightings of day or minute precision as a right side of ``geo_range_join``."""
    return sighting_points(t(spark, d, "sightings")).where(F.col("day").isNotNull())


@query()
def q_geo_range_join(spark, d):
    """Left outer: sightings within 150 km and a window by the official entry's precision; every entry keeps a row, undated ones with match_count 0."""
    return joins.geo_range_join(_official(spark, d), _civilian(spark, d)).groupBy("left_id").agg(F.max("match_count").alias("match_count"), F.min("distance_km").alias("nearest_km"))


@query("""
SELECT id, count(*) AS n, count(CASE WHEN location.lat BETWEEN -90 AND 90 AND location.lng BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lng = 0) THEN 1 END) AS usable FROM sightings GROUP BY id""")
def q_usable_points(spark, d):
    s = t(spark, d, "sightings")
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(usable(F.col("location.lat"), F.col("location.lng"))).alias("usable"))


@query("""
SELECT format('{}:{}', floor((location.lat + 90) / 5)::INTEGER, floor((location.lng + 180) / 5)::INTEGER) AS cell, layer, count(*) FILTER (WHERE ok) AS n FROM (
  SELECT location, layer, CASE layer WHEN 'all' THEN true WHEN 'civilian' THEN coalesce(source = 'civreport', false) ELSE coalesce(source <> 'civreport', false) END AS ok
  FROM sightings, (SELECT unnest(['all', 'civilian', 'other']) AS layer)
  WHERE location.lat BETWEEN -90 AND 90 AND location.lng BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lng = 0)) GROUP BY ALL""")
def q_conditional_layers(spark, d):
    """Counts per grid cell in three layers; cells without points of a layer keep a 0."""
    s = t(spark, d, "sightings").select("source", F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"))
    return spatial.layer_counts(s, {"all": F.lit(True), "civilian": F.col("source") == "civreport", "other": F.col("source") != "civreport"}, 5.0).select("cell", "layer", "n")


@query()
def q_hotspot(spark, d):
    """Gi* of sighting counts on a 5 degree grid."""
    s = t(spark, d, "sightings").select("source", F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"))
    return spatial.getis_ord(spatial.layer_counts(s, {"all": F.lit(True)}, 5.0))


@query("""
SELECT strftime(o_orderdate, '%m-%d') AS mm_dd, o_orderkey AS id, year(o_orderdate)::INTEGER AS year, row_number() OVER (PARTITION BY strftime(o_orderdate, '%m-%d') ORDER BY (o_totalprice > 200000)::INTEGER DESC, year(o_orderdate) DESC, o_orderkey)::INTEGER AS place FROM orders""")
def q_calendar_bucket(spark, d):
    """Orders by day of the year, notable ones first."""
    b = retrieval.calendar_buckets(t(spark, d, "orders"), "o_orderdate", "o_orderkey", (F.col("o_totalprice") > 200000).cast("int"))
    return b.select("mm_dd", F.posexplode("entries").alias("at", "x")).select("mm_dd", F.col("x.id").alias("id"), F.col("x.year").alias("year"), (F.col("at") + 1).alias("place"))


@query("""
SELECT n_name, count(*) AS n, count(DISTINCT c_mktsegment) AS kinds, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS titles FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_group_index(spark, d):
    j = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: a fixed table of 25 rows
    return retrieval.group_index(j, "n_name", "c_mktsegment").select("n_name", "n", F.size("titles").cast("bigint").alias("kinds"), F.array_join("titles", "|").alias("titles"))


# ---- tables against tables ----


@query("""
WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 7 <> 0), c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(p.k, c.k) AS o_orderkey, CASE WHEN p.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'modified' END AS kind FROM p FULL JOIN c ON p.k = c.k WHERE p.k IS NULL OR c.k IS NULL OR p.h IS DISTINCT FROM c.h""")
def q_snapshot_diff(spark, d):
    """Two versions of a table compared (the versions differ by rule)."""
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("h"))
    p = o.where("o_orderkey % 7 <> 0")
    c = o.where("o_orderkey % 5 <> 0").withColumn("h", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("h")))
    return joins.snapshot_diff(p, c, "o_orderkey", "h").select("o_orderkey", "kind")


@query("""
WITH b AS (SELECT c_custkey AS k, c_name AS name, c_acctbal > 0 AS curated FROM customer), o AS (SELECT o_custkey AS k, max(o_orderpriority) AS name FROM orders GROUP BY 1)
SELECT coalesce(b.k, o.k) AS k, coalesce(o.name, b.name) AS name, b.curated FROM b FULL JOIN o ON b.k = o.k WHERE o.k IS NOT NULL OR coalesce(b.curated, false)""")
def q_overlay_merge(spark, d):
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("curated"))
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("name"))
    return joins.overlay_merge(b, o, "k", ["name"], "curated")


@query("""
SELECT id, arg_max(verification_status, (fetched_at, coalesce(verification_status, ''))) AS verification_status, max(fetched_at) AS fetched_at FROM (SELECT id, fetched_at, coalesce(verification_status, '') AS verification_status FROM sightings) GROUP BY id""")
def q_upsert(spark, d):
    """The latest state of every sighting."""
    s = t(spark, d, "sightings").select("id", "fetched_at", F.coalesce("verification_status", F.lit("")).alias("verification_status"))
    return writers.upsert(s.limit(0), s.withColumn("version", F.struct("fetched_at", "verification_status")), "id", "version").select("id", "verification_status", "fetched_at")


# ---- graph ----


def _purchases(spark, d) -> DataFrame:
    e = t(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return cut_to_table(graph.merge_edges(e.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "weight")), "graph")


@query("""
WITH e AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL), b AS (SELECT s AS id, p AS o, w FROM e UNION ALL SELECT p, s, w FROM e),
d AS (SELECT id, count(DISTINCT o) AS degree, sum(w) AS strength FROM b GROUP BY id)
SELECT id, degree, strength, round(degree / (SELECT count(*) - 1 FROM d), 9) AS centrality FROM d""")
def q_degree(spark, d):
    return graph.degree(_purchases(spark, d)).withColumn("centrality", F.round("centrality", 9))


@query("""
WITH e AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL), b AS (SELECT s AS id, p AS o, w FROM e UNION ALL SELECT p, s, w FROM e),
c AS (SELECT DISTINCT id, right(id, 1) AS community FROM b), m AS (SELECT sum(w) AS two_m FROM b),
i AS (SELECT x.community, sum(2 * w) AS inside FROM e JOIN c x ON x.id = e.s JOIN c y ON y.id = e.p WHERE x.community = y.community GROUP BY 1), g AS (SELECT community, sum(w) AS deg FROM b JOIN c USING (id) GROUP BY 1)
SELECT community, round(coalesce(inside, 0) / two_m - pow(deg / two_m, 2), 9) AS q FROM g LEFT JOIN i USING (community), m""")
def q_modularity(spark, d):
    e = _purchases(spark, d)
    m = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct().withColumn("community", F.right("id", F.lit(1)))
    return graph.modularity(e, m).withColumn("q", F.round("q", 9))


@query()
def q_communities(spark, d):
    """Label propagation on the graph of cited sections and entries near each other."""
    return graph.label_propagation(_purchases(spark, d)).groupBy("community").agg(F.count(F.lit(1)).alias("n"))


@query()
def q_eigenvector(spark, d):
    return graph.eigenvector(_purchases(spark, d)).withColumn("score", F.round("score", 6))


@query()
def q_betweenness(spark, d):
    """Betweenness among the hundred nodes of highest degree (the operator's bound)."""
    return graph.betweenness_top(_purchases(spark, d))


@query()
def q_layout(spark, d):
    """Layout of the thousand nodes of highest degree (the operator's bound)."""
    return graph.force_layout(_purchases(spark, d))


@query()
def q_topics(spark, d):
    """Clusters of record vectors with labels from their titles."""
    v = t(spark, d, "text_vectors").where(F.size("vector") == 384).groupBy("id").agg(F.max("vector").alias("vector"))
    m = topics.cluster_vectors(v, "id", "vector", 8)
    r = t(spark, d, "search_index").groupBy("id").agg(F.min("title").alias("title"))
    return topics.topic_terms(m.join(r, "id"), text.tokens(F.col("title")))


# ---- time and state ----


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def q_tumbling(spark, d):
    w = stateful.tumbling(t(spark, d, "events"), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""
SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def q_sliding(spark, d):
    return stateful.tumbling(t(spark, d, "events"), "ts", "1 hour", [], F.count(F.lit(1)).alias("n"), slide="30 minutes").select(F.col("window.start").alias("start"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s""")
def q_session(spark, d):
    return stateful.sessions(t(spark, d, "events"), "ts", "2 hours", ["user_id"], F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("""
SELECT event_id, user_id, event_type, previous FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS DISTINCT FROM event_type""")
def q_status_transition(spark, d):
    return stateful.status_transitions(t(spark, d, "events"), "user_id", "ts", "event_type", "event_id").select("event_id", "user_id", "event_type", "previous")


@query()
def q_rate_limit(spark, d):
    """Three requests in six hours per user; rejected ones do not count."""
    return stateful.admit(t(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3, 6 * 3600, "event_id").select("event_id", "user_id", "admitted", F.round("retry_after_s", 3).alias("retry_after_s"))


@query("""
SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""")
def q_ring_buffer(spark, d):
    """The last 50 events of every user (the buffer's size)."""
    return stateful.ring_buffer(t(spark, d, "events"), "ts", 50, "user_id", "event_id").select("event_id", "user_id")


@query("""
SELECT event_id, user_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'logout' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS open FROM events""")
def q_presence(spark, d):
    e = t(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "click", "join").when(F.col("event_type") == "logout", "leave").otherwise("other"))
    return stateful.presence(e, "user_id", "event_id", "ts", "kind").select("event_id", "user_id", "open")


# ---- publishing ----


@query()
def q_feed(spark, d):
    """The 200 newest records as feed entries (the feed's size)."""
    r = t(spark, d, "search_index").where(F.coalesce(F.trim("type") != "IMG", F.lit(True))).groupBy("id").agg(F.min("title").alias("title"), F.min(dates.parse_release(F.col("release_date"))).alias("updated"), F.min("blurb").alias("summary"))
    return retrieval.atom_feed(r)


@query()
def q_vault(spark, d):
    """Markdown notes of all documents."""
    x = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("untitled")).alias("title"), F.col("source").alias("agency"), F.array("kind").alias("tags"), "text", F.array_compact(F.array("record_id")).alias("related"))
    return retrieval.vault_note(x)


@query("""
SELECT doc_id, lang, source, n_chars, title, kind, record_id FROM documents""")
def q_light_export(spark, d):
    """All columns but the text: the scan reads no text."""
    return t(spark, d, "documents").drop("text", "collected_at")


# ---- further normalisers, dates, tallies and record operators ----


@query("""
SELECT upper(trim(type)) AS kind, coalesce(agency, 'none') AS agency, count(*) AS n, count(DISTINCT id) AS ids FROM search_index GROUP BY ALL""")
def q_count_by_kind(spark, d):
    return t(spark, d, "search_index").groupBy(F.upper(F.trim("type")).alias("kind"), F.coalesce("agency", F.lit("none")).alias("agency")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("""
SELECT event_id, left(sha256(user_id::VARCHAR), 12) AS who, 'sha256:' || sha256(props) AS body FROM events""")
def q_hash_keys(spark, d):
    return t(spark, d, "events").select("event_id", scalars.hash_ip(F.col("user_id").cast("string")).alias("who"), scalars.body_hash(F.col("props")).alias("body"))


@query("""
SELECT DISTINCT id, CASE WHEN starts_with(id, 'forum:') THEN substr(id, 7) ELSE regexp_replace(id, '^([^:]*):', '\\1_') END AS key FROM sightings""")
def q_rekey(spark, d):
    return t(spark, d, "sightings").select("id", scalars.rekey(F.col("id"), "forum:").alias("key")).distinct()


@query("""
SELECT DISTINCT id, CASE WHEN starts_with(source, 'official_') THEN 'official' WHEN source = 'newsfeed' THEN 'reported' ELSE 'unverified' END AS level FROM sightings WHERE source IS NOT NULL""")
def q_provenance(spark, d):
    s = t(spark, d, "sightings").where(F.col("source").isNotNull())
    return s.select("id", scalars.provenance(F.col("source"), {"newsfeed": "reported"}).alias("level")).distinct()


@query("""
SELECT DISTINCT id, CASE WHEN duration_seconds > 0 THEN duration_seconds END AS seconds FROM sightings""")
def q_duration(spark, d):
    return t(spark, d, "sightings").select("id", scalars.parse_duration(F.col("duration_seconds").cast("string")).alias("seconds")).distinct()


@query(r"""
SELECT DISTINCT doc_id, CASE WHEN regexp_matches(title, '[:#\[\]{},&*!|>''"%@`]') THEN '"' || replace(replace(title, '\', '\\'), '"', '\"') || '"' ELSE title END AS title FROM documents""")
def q_yaml(spark, d):
    return t(spark, d, "documents").select("doc_id", scalars.yaml_escape(F.col("title")).alias("title")).distinct()


@query("""
SELECT count(*) AS rows_, sum(length(text))::BIGINT AS chars, count(CASE WHEN length(text) > 0 THEN 1 END) AS with_text FROM search_index""")
def q_array_stats(spark, d):
    return t(spark, d, "search_index").agg(F.count(F.lit(1)).alias("rows_"), F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") > 0).alias("with_text"))


@query("""
SELECT count(CASE WHEN match_score >= 0.5 THEN 1 END) AS ge_0_5, count(CASE WHEN match_score >= 0.65 THEN 1 END) AS ge_0_65, count(CASE WHEN match_score >= 0.9 THEN 1 END) AS ge_0_9 FROM match_pairs""")
def q_threshold_tallies(spark, d):
    return records.tallies(t(spark, d, "match_pairs"), "match_score", [0.5, 0.65, 0.9])


@query("""
SELECT pair, match_score, run_id FROM (SELECT least(id_a, id_b) || '|' || greatest(id_a, id_b) AS pair, match_score, run_id,
  row_number() OVER (PARTITION BY least(id_a, id_b), greatest(id_a, id_b) ORDER BY scored_at, run_id, match_score) AS rn FROM match_pairs WHERE id_a IS NOT NULL AND id_b IS NOT NULL AND match_score IS NOT NULL) WHERE rn = 1""")
def q_first_rows(spark, d):
    """The first scoring of every pair, in whichever order it was written."""
    p = t(spark, d, "match_pairs").where(F.col("id_a").isNotNull() & F.col("id_b").isNotNull() & F.col("match_score").isNotNull())
    p = p.withColumn("pair", F.concat(F.least("id_a", "id_b"), F.lit("|"), F.greatest("id_a", "id_b")))
    return records.first_rows(p, "pair", "scored_at", "run_id", "match_score").select("pair", "match_score", "run_id")


@query(r"""
SELECT DISTINCT id, coalesce(CASE WHEN regexp_matches(trim(release_date), '^\d{1,2}/\d{1,2}/\d{2}$') THEN try_strptime(trim(release_date), '%m/%d/%y') WHEN regexp_matches(trim(release_date), '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(trim(release_date), '%m/%d/%Y') END,
  CASE WHEN regexp_matches(trim(release_date), '^\d{4}-\d{2}-\d{2}$') THEN try_strptime(trim(release_date), '%Y-%m-%d') END)::DATE AS released FROM search_index""")
def q_release_dates(spark, d):
    """Feed dates: slashed with years 69-99 in the 1900s, or ISO."""
    return t(spark, d, "search_index").select("id", dates.parse_release(F.col("release_date")).alias("released")).distinct()


@query(r"""
SELECT DISTINCT id, CASE WHEN regexp_matches(left(trim(occurred_at), 10), '^\d{4}-\d{2}-\d{2}$') THEN try_strptime(left(trim(occurred_at), 10), '%Y-%m-%d') END::DATE AS day FROM sightings""")
def q_iso_prefix(spark, d):
    return t(spark, d, "sightings").select("id", dates.parse_iso_prefix(F.col("occurred_at")).alias("day")).distinct()


@query()
def q_linkage_dates(spark, d):
    """Incident dates of four notations as days, and those of spans with their precision."""
    s = t(spark, d, "search_index")
    p = dates.parse_record(F.col("incident_date"), 26)
    return s.select("id", dates.parse_linkage(F.col("incident_date"), 26).alias("day"), p["date"].alias("first_day"), p["precision"].alias("precision")).distinct()


@query("""
SELECT grp, count(*) AS n FROM (SELECT CASE WHEN provenance = 'official' AND d IS NOT NULL THEN 'official' WHEN coalesce(provenance, '') <> 'official' AND d IS NOT NULL AND ok THEN 'civilian' ELSE 'rest' END AS grp FROM (
  SELECT provenance, coalesce(location.lat BETWEEN -90 AND 90 AND location.lng BETWEEN -180 AND 180 AND NOT (location.lat = 0 AND location.lng = 0), false) AS ok,
    CASE WHEN regexp_matches(occurred_at, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_strptime(occurred_at, '%Y-%m-%d') END AS d FROM sightings)) GROUP BY 1""")
def q_split_sightings(spark, d):
    """Three-way partition of the reports."""
    s = t(spark, d, "sightings").withColumn("day", F.try_to_date(F.regexp_extract("occurred_at", r"^(\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd"))
    parts = records.split_sightings(s)
    out = None
    for name, p in zip(("official", "civilian", "rest"), parts):
        p = p.select(F.lit(name).alias("grp"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT id, CASE WHEN coalesce(source, '') = coalesce(shape, '') THEN coalesce(source, '') ELSE concat(coalesce(source, ''), '|', coalesce(shape, '')) END AS joined, count(*) AS n FROM sightings GROUP BY ALL""")
def q_ordered_union(spark, d):
    """Lists joined without repeats, in order."""
    s = t(spark, d, "sightings").withColumn("u", F.array_distinct(F.concat(F.array(F.coalesce("source", F.lit(""))), F.array(F.coalesce("shape", F.lit(""))))))
    return s.groupBy("id", F.array_join("u", "|").alias("joined")).agg(F.count(F.lit(1)).alias("n"))


@query()
def q_entity_table(spark, d):
    """Rule-based entities with their most frequent surface and the documents that name them."""
    m = t(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("record_id"), F.lit("NAME").alias("type"), F.posexplode(text.rule_entities(F.col("text"))).alias("pos", "surface"))
    m = m.withColumn("ord", F.col("record_id") * 100_000 + F.col("pos"))
    return records.entity_table(m).select("entity_id", "surface", "count", F.size("record_ids").alias("n_records"))


@query()
def q_resolution_rate(spark, d):
    """Share of cited numbers that some document resolves."""
    docs = t(spark, d, "documents").where(F.col("text").isNotNull())
    m = retrieval.citation_mentions(docs, "doc_id", "text", text.CITATIONS)
    lookup = m.where(F.col("kind") == "section_ref").groupBy("kind", "token").agg(F.min("doc_id").alias("to_id"))
    return records.resolution_rate(*retrieval.citation_edges(m, lookup, "doc_id"))


@query()
def q_adjacency(spark, d):
    """Who cites whom, both ways."""
    return graph.adjacency(q_citation_edges(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))


@query()
def q_graph(spark, d):
    """Records and entities as one weighted graph: names, citations and nearness in place and time."""
    ent = t(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("record_id"), F.explode(text.rule_entities(F.col("text"))).alias("s"))
    ent = ent.select("record_id", F.regexp_replace("s", r"\s+", "_").alias("entity_id"), F.lit(1).alias("count"))
    cit = q_citation_edges(spark, d).select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), "count")
    near = q_near_pairs(spark, d)
    v, e = graph.build_graph(ent, cit, near)
    return e


def q_near_pairs(spark, d) -> DataFrame:
    """Official entries and sightings close in place and time, by the entry's own window, with distance and days."""
    return joins.geo_range_join(_official(spark, d), _civilian(spark, d)).where(F.col("right_id").isNotNull()).select("left_id", "right_id", "distance_km", "delta_days")
