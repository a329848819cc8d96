"""Topics: clusters of vectors with class-based TF-IDF labels."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cluster_vectors(df: DataFrame, id_col: str, vec_col: str, k: int = 10, seed: int = 42, noise: float = 0.0) -> DataFrame:
    """(id, topic): k-means on the vectors; rows whose cosine to their centre is below ``noise`` are topic -1.

    A documented substitute for a density clustering on a reduced space, which
    has no distributed equivalent here.
    """
    ok = df.where(F.exists(vec_col, lambda v: v != 0)).select(F.col(id_col).alias("id"), array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(ok)
    out = model.transform(ok)
    if noise <= 0:
        return out.select("id", F.col("prediction").alias("topic"))
    from pyspark.ml.functions import vector_to_array

    from archivolt.functions.numeric import cosine

    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    near = cosine(vector_to_array("features"), F.get(centres, F.col("prediction")))
    return out.select("id", F.when(near >= noise, F.col("prediction")).otherwise(-1).alias("topic"))


def topic_terms(members: DataFrame, toks: Column, n: int = 10, min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """(topic, label, keywords, size): c-TF-IDF of uni- and bigrams; label from 3 words, 8 keywords."""
    docs = members.select("id", "topic", toks.alias("t"))
    two = F.transform(F.when(F.size("t") > 1, F.sequence(F.lit(1), F.size("t") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice("t", i, F.lit(2)), " "))
    terms = docs.select("id", "topic", F.explode(F.concat("t", two)).alias("term"))
    total = docs.count()
    kept = terms.groupBy("term").agg(F.count_distinct("id").alias("df"), F.count(F.lit(1)).alias("f")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * total))
    tf = terms.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf"))
    size = docs.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    words = tf.groupBy("topic").agg(F.sum("tf").alias("words"))
    avg = words.agg(F.avg("words")).first()[0] or 0.0
    s = tf.join(kept, "term").join(words, "topic").withColumn("w", F.round(F.col("tf") / F.col("words") * F.log(1 + avg / F.col("f")), 9))
    best = Window.partitionBy("topic").orderBy(F.desc("w"), "term")
    top = s.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("top"))
    return top.join(size, "topic").select("topic", F.array_join(F.slice("top", 1, 3), ", ").alias("label"), F.slice("top", 1, 8).alias("keywords"), "size")
