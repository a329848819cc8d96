"""Documents into containers of fixed token capacity: shortest-pack-first over lengths.

Lengths are whole numbers up to the capacity, so a histogram of at most
``capacity`` bins says all there is to pack, whatever the number of documents.
Lengths are placed longest first, each into the shortest open pack (the one
with the most room), all alike packs at once by their count; a new pack is
opened only where the shortest one is too full. Patterns are then joined back to
documents by rank: the r-th document of a length takes the r-th place for that
length. A document longer than the capacity is divided into full pieces and a
rest.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.session import cut_to_table, table

CAPACITY = 2048
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Documents of one length that one block of the rank index covers.
RANK_BLOCK = 4096


def token_counts(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens) by the byte-level tokenizer whose ranks lie at ``ranks`` on every machine.

    Null texts have no row; an empty text has 0 tokens. Whole texts are counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) for t in pdf["text"]]})

    return documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, "doc_id bigint, n_tokens int")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and their counts: [(lengths of a container, containers)].

    ``open_`` keeps patterns by the room they have left. Each length, longest
    first, goes one by one to a pattern with the most room; the same length goes
    on into the new containers it has opened while nothing has more room.
    """
    open_: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []  # negated, so that the most room comes first; may name rooms that are empty by now

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if not open_[room]:
            heapq.heappush(rooms, -room)
        open_[room][pattern] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            while rooms and not open_[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room < length:
                # new containers, each the shortest one until no more of this length fits
                each = min(capacity // length, left)
                n = left // each
                put((length,) * each, n, capacity - each * length)
                left -= n * each
                continue
            pattern, count = next(iter(open_[room].items()))
            n = min(count, left)
            if n == count:
                del open_[room][pattern]
            else:
                open_[room][pattern] -= n
            put(pattern + (length,), n, room - length)
            left -= n
    return sorted(((p, n) for ps in open_.values() for p, n in ps.items()), key=lambda x: (-len(x[0]), x[0]))


def pack(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, container, place): where every token goes.

    ``counts`` has doc_id and n_tokens. Documents without tokens take no place.
    Each document's pieces are [0, n) cut at multiples of the capacity, so every
    token is kept once. The histogram has at most ``capacity`` rows.
    """
    spark = counts.sparkSession
    pieces = counts.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("length"))
    pieces = cut_to_table(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = shortest_pack_first(histogram, capacity)
    # runs of places: containers first..first+n-1 hold `each` pieces of a length, ranks from `base` on
    runs, base, first = [], Counter(), 0
    for pattern, n in patterns:
        place = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            runs.append((length, base[length], base[length] + n * each, first, each, place))
            base[length] += n * each
            place += each
        first += n
    schema = "length int, lo bigint, hi bigint, first bigint, each int, place int"
    # A run is found by length and block of ranks, so that neither a frequent length nor one of many runs is one key.
    block = lambda c: F.floor(F.col(c) / RANK_BLOCK)
    runs = spark.createDataFrame(runs, schema).withColumn("rb", F.explode(F.sequence(block("lo"), F.floor((F.col("hi") - 1) / RANK_BLOCK))))
    # Ranks within a length in two steps, so that a frequent length is no single task.
    blocks = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BLOCK)).cast("int"))
    sizes = blocks.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "b").orderBy("doc_id", "piece")
    ranked = blocks.withColumn("r", F.row_number().over(within) - 1).join(sizes, ["length", "b"]).withColumn("r", F.col("r") + F.col("ahead"))
    at = ranked.withColumn("rb", block("r")).join(runs, ["length", "rb"]).where((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    off = F.col("r") - F.col("lo")
    return at.select("doc_id", "piece", "start", "length", (F.col("first") + F.floor(off / F.col("each"))).cast("bigint").alias("container"), (F.col("place") + off % F.col("each")).cast("int").alias("place"))


def p7_packed(spark, sf_dir: str) -> DataFrame:
    """Place of every document (piece) in containers of 2,048 tokens."""
    return pack(token_counts(table(spark, sf_dir, "documents")))


def p7_fill(spark, sf_dir: str) -> DataFrame:
    """Containers, tokens, fill rate, and whether any container is over capacity."""
    packed = p7_packed(spark, sf_dir)
    per = packed.groupBy("container").agg(F.sum("length").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill_rate"), F.max("used").alias("fullest"),
    )


def p7_kept(spark, sf_dir: str) -> DataFrame:
    """Documents with text by whether their pieces hold every token once (``whole``)."""
    counts = cut_to_table(token_counts(table(spark, sf_dir, "documents")).where(F.col("n_tokens") > 0), "counts")
    packed = pack(counts)
    had = packed.groupBy("doc_id").agg(F.sum("length").alias("placed"), F.count_distinct("start").alias("starts"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start") + F.col("length")).alias("end"))
    whole = (F.col("placed") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("starts") == F.col("pieces"))
    return counts.join(had, "doc_id", "left").groupBy(F.coalesce(whole, F.lit(False)).alias("whole")).agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill, "p7_kept": p7_kept}
ORACLE = {"p7_kept": "SELECT true AS whole, count(*) AS documents FROM documents WHERE length(text) > 0"}
