"""Subject areas of documents by class-association rules.

Sentences of a bounded, labelled sample become transactions of words and class
items; parallel frequent-pattern growth mines itemsets, rules "words -> subject"
are kept, and a longer rule falls if a shorter one within it is as sure. A
rule's weight is the log odds of the lower confidence bound of its hit rate, so
that rare words count little. The summed evidence of a sentence is calibrated
by isotonic regression on held-out labelled documents. Every sentence of every
document is scored; a document has the subjects given to enough sentences.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.gazetteer import edits
from archivolt.session import bounded_rows, cut_to_table, table

#: At most so many labelled documents are learnt from (the ones with the least hash of doc_id). It bounds the rule set too.
MAX_LABELLED = 20_000
#: A word or rule must stand in so many labelled sentences; a rule has at most so many words.
LEAST_SUPPORT, MOST_WORDS = 4, 3
LEAST_P = 0.65
#: What is held of the calibration before any held-out sentence is seen: (evidence, hit rate), each worth PRIOR_ROWS sentences.
PRIOR_CURVE, PRIOR_ROWS = ((0.0, 0.3), (3.0, 0.6), (5.0, 0.9)), 20
#: Evidence is rounded to this before it is counted for the calibration.
STEP = 0.05
WORD = re.compile(r"[^\W\d_]{2,}")
#: A sentence ends at . ! ? before white space, or at an empty line.
SENTENCE = re.compile(r"(?<=[.!?])[\"'»”)\]]*\s+|\n\s*\n|\r\s*\r")


def sentences(text: str) -> list[str]:
    """Sentences with at least three words (or ten parts of any kind)."""
    parts = SENTENCE.split(text.replace("\r\n", "\n").replace("\r", "\n"))
    return [s for s in (" ".join(p.split()) for p in parts if p) if (n := s.count(" ")) >= 9 or n >= 2 and len(WORD.findall(s)) >= 3]


def words_of(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


def clean_labels(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject) with spelling variants mapped to ``subjects``; ``none`` is kept as null subject."""
    folded = {re.sub(r"[^a-z]", "", s.lower()): s for s in subjects}

    @F.pandas_udf("string")
    def tidy(raw: pd.Series) -> pd.Series:
        def one(x):
            if not isinstance(x, str):
                return "?"
            k = re.sub(r"[^a-z]", "", x.lower())
            if k in folded:
                return folded[k]
            if k == "none":
                return None
            near = sorted((edits(k, f, 2), f) for f in folded)
            return folded[near[0][1]] if near and near[0][0] <= 2 and len(k) >= 4 else "?"

        return raw.map(one)

    got = labels.where(F.col("doc_id").isNotNull()).select("doc_id", tidy("subject").alias("subject"))
    return got.where(F.col("subject").isNull() | (F.col("subject") != "?")).distinct()


def lower_bound(hits: float, n: float, z: float = 1.64) -> float:
    """Lower end of Wilson's interval for a hit rate."""
    if n <= 0:
        return 0.0
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def wilson(hits: Column, n: Column, z: float = 1.64) -> Column:
    """:func:`lower_bound` as a column."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


class Rules:
    """Mined rules by their words, and the calibration of their summed evidence."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        self.single: dict[str, list[tuple[int, float]]] = {}
        self.pairs: dict[str, list[tuple[frozenset, int, float]]] = {}
        self.calibrate([])

    def add(self, words: frozenset, subject: int, weight: float) -> None:
        if len(words) == 1:
            self.single.setdefault(next(iter(words)), []).append((subject, weight))
        else:
            self.pairs.setdefault(min(words), []).append((words, subject, weight))

    def evidence(self, words: set[str]) -> dict[int, float]:
        """Summed weights of the rules whose words are all there, by subject."""
        e: dict[int, float] = {}
        for w in words & self.single.keys():
            for s, x in self.single[w]:
                e[s] = e.get(s, 0.0) + x
        for w in words & self.pairs.keys():
            for ws, s, x in self.pairs[w]:
                if ws <= words:
                    e[s] = e.get(s, 0.0) + x
        return e

    def best(self, words: set[str]) -> tuple[int, float] | None:
        """(subject, evidence) of the best supported subject, the first on ties; None without evidence."""
        e = self.evidence(words)
        if not e:
            return None
        k = min(e, key=lambda s: (-e[s], s))
        return (k, e[k]) if e[k] > 0 else None

    def subject_of(self, words: set[str]) -> tuple[int, float] | None:
        """(subject, probability) of the best supported subject; None without evidence."""
        got = self.best(words)
        return got and (got[0], self.rates[max(0, bisect.bisect_right(self.ends, got[1]) - 1)])

    def calibrate(self, counted: list[tuple[float, float, float]]) -> None:
        """Learn the step function from (evidence, hits, rows); the prior curve counts as a few rows more."""
        self.ends, self.rates = isotonic(counted + [(e, p * PRIOR_ROWS, PRIOR_ROWS) for e, p in PRIOR_CURVE])


def isotonic(counted: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Rising step function of hit rate over evidence: (lower ends, rates), by pooling adjacent violators."""
    blocks: list[list[float]] = []  # lower end, hits, rows
    for e, hits, rows in sorted(counted):
        if blocks and blocks[-1][0] == e:
            blocks[-1][1] += hits
            blocks[-1][2] += rows
        else:
            blocks.append([e, hits, rows])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, h, n = blocks.pop()
            blocks[-1][1] += h
            blocks[-1][2] += n
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]


def learn(documents: DataFrame, labels: DataFrame, subjects: list[str], max_labelled: int = MAX_LABELLED, held_out: float = 0.2) -> Rules:
    """Mine, prune and calibrate rules on at most ``max_labelled`` labelled documents."""
    spark = documents.sparkSession
    rules = Rules(subjects)
    by_doc = clean_labels(labels, subjects).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("has"))
    some = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(some, "doc_id").dropDuplicates(["doc_id"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, sorted(words_of(s)), list(h)) for d, t, h in zip(pdf["doc_id"], pdf["text"], pdf["has"]) for s in sentences(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "words", "has"])

    sents = cut_to_table(texts.mapInPandas(cut, "doc_id bigint, words array<string>, has array<string>").dropDuplicates(["doc_id", "words"]), "labelled")
    train = sents.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) >= int(1000 * held_out))
    n_docs = train.select("doc_id").distinct().count()
    if n_docs == 0:
        return rules
    # Words that say something: among labelled documents one subject has them far more often than by chance.
    of_word = train.select("doc_id", "has", F.explode("words").alias("w")).dropDuplicates(["doc_id", "w"])
    total = of_word.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SUPPORT)
    hits = of_word.select("w", F.explode("has").alias("s")).groupBy("w", "s").agg(F.count(F.lit(1)).alias("k"))
    share = {r["s"]: r["k"] / n_docs for r in train.select("doc_id", "has").dropDuplicates(["doc_id"]).select(F.explode("has").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k")).collect()}
    telling = [r for r in total.join(hits, "w").select("w", "s", "k", "n").toLocalIterator() if lower_bound(r["k"], r["n"]) > max(1.5 * share[r["s"]], share[r["s"]] + 0.05)]
    vocabulary = sorted({r["w"] for r in telling})
    if not vocabulary:
        return rules
    shared = spark.sparkContext.broadcast(frozenset(vocabulary))

    @F.pandas_udf("array<string>")
    def items(words: pd.Series, has: pd.Series) -> pd.Series:
        return pd.Series([sorted(w for w in ws if w in shared.value) + [f"#{s}" for s in h] for ws, h in zip(words, has)])

    transactions = train.select("doc_id", items("words", "has").alias("items")).where(F.exists("items", lambda x: ~x.startswith("#")))
    transactions = cut_to_table(transactions.dropDuplicates(["doc_id", "items"]).select("items"), "transactions")
    n = transactions.count()
    fp = FPGrowth(itemsCol="items", minSupport=min(1.0, LEAST_SUPPORT / max(n, 1)), minConfidence=0.1, numPartitions=max(4, min(200, n // 20_000)))
    mined = fp.fit(transactions).associationRules
    mined = mined.where(F.col("consequent")[0].startswith("#") & ~F.exists("antecedent", lambda x: x.startswith("#")) & (F.size("antecedent") <= MOST_WORDS))
    mined = mined.select(F.array_sort("antecedent").alias("words"), F.substring(F.col("consequent")[0], 2, 1_000).alias("s"), "confidence", (F.col("support") * n).alias("k"))
    mined = cut_to_table(mined.withColumn("low", wilson(F.col("k"), F.col("k") / F.col("confidence"))), "rules")
    prior = F.create_map(*[F.lit(x) for s, p in share.items() if s for x in (s, p)])[F.col("s")] if any(share) else F.lit(0.0)
    mined = mined.withColumn("prior", F.coalesce(prior, F.lit(0.0)))
    telling = mined.where(F.col("low") > F.greatest(1.5 * F.col("prior"), F.col("prior") + 0.1))
    # A rule falls if the rule without one of its words is as sure.
    without = telling.where(F.size("words") > 1).select("words", "s", "low", F.explode("words").alias("w")).select("words", "s", "low", F.array_remove("words", F.col("w")).alias("part"))
    fallen = without.join(mined.select(F.col("words").alias("part"), "s", F.col("low").alias("part_low")), ["part", "s"]).where(F.col("part_low") >= F.col("low") - 0.05)
    index = {s: k for k, s in enumerate(subjects)}
    for r in telling.join(fallen.select("words", "s").distinct(), ["words", "s"], "left_anti").orderBy(F.size("words"), "words", "s").toLocalIterator():
        if r["s"] in index:
            rules.add(frozenset(r["words"]), index[r["s"]], logit(r["low"]) - logit(r["prior"]))
    spread = spark.sparkContext.broadcast(rules)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(best[1], spread.value.subjects[best[0]] in has) for ws, has in zip(pdf["words"], pdf["has"]) if (best := spread.value.best(set(ws)))]
            yield pd.DataFrame({"e": [round(round(e / STEP) * STEP, 6) for e, _ in got], "hit": [float(h) for _, h in got]})

    # One row a step of evidence comes back, however many sentences are held out.
    hold = sents.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) < int(1000 * held_out)).select("words", "has").mapInPandas(weigh, "e double, hit double")
    rules.calibrate([(r["e"], r["hits"], r["n"]) for r in hold.groupBy("e").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")).toLocalIterator()])
    return rules


SCORED = "doc_id bigint, subject string, n_sentences int, evidence double"


def score(documents: DataFrame, rules: Rules, least_p: float = LEAST_P) -> DataFrame:
    """(doc_id, subject, n_sentences, evidence): sentences given to each subject of each document, whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                found: dict[int, list[float]] = {}
                for s in sentences(text):
                    got = r.subject_of(words_of(s))
                    if got and got[1] >= least_p:
                        found.setdefault(got[0], []).append(got[1])
                out += [(doc, r.subjects[k], len(p), sum(p)) for k, p in sorted(found.items())]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "n_sentences", "evidence"])

    return documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, SCORED)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, least_sentences: int = 2, **learning) -> DataFrame:
    """(doc_id, subject, n_sentences, evidence) of subjects given to at least ``least_sentences`` sentences.

    ``documents`` has doc_id, text; ``labels`` doc_id, subject; ``subjects``
    subject (a bounded reference table). Null texts have no subject; without
    labels no document has one. Unknown label spellings are left out.
    """
    names = sorted(r["subject"] for r in bounded_rows(subjects.select("subject").where(F.col("subject").isNotNull()).distinct(), 10_000, "subjects"))
    return score(documents, learn(documents, labels, names, **learning)).where(F.col("n_sentences") >= least_sentences)


def p9_found(spark, sf_dir: str) -> DataFrame:
    """Subjects to which at least two sentences of a document are given."""
    return document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects")).select("doc_id", "subject").distinct()


QUERIES = {"p9_found": p9_found}
ORACLE = {}
