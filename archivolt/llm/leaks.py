"""Evaluation passages in training text: a positional inverted index.

Every training document gives postings (term, document, position) for the terms
that occur in test passages. Of each passage the rarest terms of every window
are looked up; a posting's position less the term's offset in the passage is
where the passage would begin, so postings that agree on it intersect. Where
enough of them meet, the passage is aligned with the document's words there,
many candidates at once: an exact phrase or a proximity match of at least
``least_words`` words. A passage that only shares a phrase with the one that
stands there is left out; passages that agree equally well are all told.

The test set is a reference table of bounded size (checked); documents are not
bounded in number or length, and none is cut or skipped.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.session import bounded_rows, cut_to_table, table

WORD = re.compile(r"[^\W_]+")
#: Of any 15 words with at most 2 differing, 6 of the 8 rarest agree: no such stretch has fewer than LEAST_HITS.
WINDOW, RAREST, BUCKET, LEAST_HITS, SEEDS = 15, 8, 8, 6, 3
#: A stretch starts and ends with an equal word: of 15 words whose first or last one differs 14 are seen. "About one word in
#: eight" of 15 may be two and a part of a third, 0.84 of them equal.
LEAST_WORDS, LEAST_SHARE = 14, 0.84
#: Words that may be added or missing beyond the shifts that the hits themselves show.
BAND = 2


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def anchors(passages: dict[int, list[str]], df: dict[str, int]) -> tuple[list[tuple[str, int, int]], set[str]]:
    """(term, item, offset) of the rarest terms of every window of every passage, and the SEEDS rarest among them.

    Where 6 of the 8 rarest terms agree, one of the 3 rarest does: a document
    without any of these terms holds no passage.
    """
    out, seeds = [], set()
    for item, ws in passages.items():
        windows = rare_windows(ws, df)
        out += [(ws[k], item, k) for k in sorted({k for rare in windows for k in rare})]
        seeds.update(ws[k] for rare in windows for k in rare[:SEEDS])
    return out, seeds


def rare_windows(ws: list[str], df: dict[str, int]) -> list[list[int]]:
    """Offsets of the RAREST terms of every window, rarest first."""
    spans = [range(a, min(len(ws), a + WINDOW)) for a in range(max(1, len(ws) - WINDOW + 1))]
    return [sorted(span, key=lambda k: (df.get(ws[k], 0), k))[:RAREST] for span in spans]


def window_masks(ws: list[str], df: dict[str, int]) -> np.ndarray:
    """The offsets of :func:`rare_windows` as bits, windows x 2."""
    out = np.zeros((max(1, len(ws) - WINDOW + 1), 2), np.uint64)
    for w, rare in enumerate(rare_windows(ws, df)):
        for k in rare:
            out[w, k % 128 // 64] |= np.uint64(1 << k % 64)
    return out


def in_one_window(cands: list[tuple], masks: dict[int, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Those of (text, passage, first and last begin, bits of the offsets hit) of which some window has LEAST_HITS of its rarest terms."""
    by: dict[int, list[tuple]] = {}
    for c in cands:
        by.setdefault(c[1], []).append(c)
    out = []
    for no, cs in by.items():
        hit = np.array([[c[4], c[5]] for c in cs], np.int64).view(np.uint64)
        for a in range(0, len(cs), 4096):
            met = np.bitwise_count(hit[a : a + 4096, None, :] & masks[no][None]).sum(2).max(1) >= LEAST_HITS
            out += [cs[a + k][:4] for k in np.nonzero(met)[0]]
    return sorted(set(out))


def scores(p: np.ndarray, d: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Best local alignment scores of many pairs at once, in a band: (score, end row * width + end column, ways).

    Row c of ``p`` holds the words of a passage as numbers (-1 past its end),
    row c of ``d`` the document's words from the band's left edge on (-2 where
    there are none), so that column k of the band at passage word i is word i + k.
    An equal word counts 1, a differing, missing or added one -1. ``ways`` (kept
    if asked) says how each cell was reached: 0 it was not, 1 diagonal, 2 a
    passage word without its like, 3 a word added in the document.
    """
    n, m = p.shape
    width = d.shape[1] - m + 1
    steps = np.arange(width, dtype=np.int16)
    before = np.zeros((n, width + 1), np.int16)
    best, at = np.zeros(n, np.int16), np.zeros(n, np.int32)
    ways = np.zeros((m, n, width), np.int8) if keep else None
    for i in range(m):
        w = p[:, i : i + 1]
        there = d[:, i : i + width]
        dia = before[:, :width] + np.where(w == there, np.int16(1), np.int16(-1))
        up = before[:, 1:] - np.int16(1)
        cell = np.maximum(np.maximum(dia, up), 0)
        cell[(there == -2) | (w == -1)] = 0
        # added words: a cell may come from any column to its left, at one point a word
        now = np.maximum.accumulate(cell + steps, axis=1) - steps
        now[(there == -2) | (w == -1)] = 0
        np.maximum(now, 0, out=now)
        if keep:
            ways[i] = np.where(now == 0, 0, np.where(now == dia, 1, np.where(now == up, 2, 3)))
        top = now.max(1)
        better = top > best
        best[better] = top[better]
        at[better] = i * width + now[better].argmax(1)
        before[:, :width] = now
    return best, at, ways


def stretch(equal: list[bool], least_words: int, least_share: float) -> tuple[int, int] | None:
    """[a, b) of the longest run of an alignment's steps that holds ``least_share`` equal ones and starts and ends with one."""
    n = len(equal)
    sums = [0.0]
    for e in equal:
        sums.append(sums[-1] + (e - least_share))
    best = None
    for a in range(n):
        if not equal[a]:
            continue
        for b in range(n, a + max(least_words, (best[1] - best[0] + 1) if best else 0) - 1, -1):
            if equal[b - 1] and sums[b] - sums[a] >= -1e-9:
                best = (a, b)
                break
    return best


def judge(cands: list[tuple[int, int, int, int]], texts: list[list[int]], passages: dict[int, list[int]], least_words: int, least_share: float, band: int = BAND) -> list[tuple[int, int, int, int, list[int]]]:
    """(text, item, start, steps, positions of the equal words) of each candidate (text, item, first and last begin) that holds.

    ``texts`` and ``passages`` are words as numbers; the passage begins in the
    text between the two positions, give or take ``band`` words added or
    missing. Every candidate is aligned by itself. Of an alignment the longest
    stretch counts that keeps the share. Memory: candidates x passage x band
    bytes, for which candidates go by blocks.
    """
    out = []
    if not cands:
        return out
    # at least so much in any alignment around a stretch that can pass
    least_score = math.floor(least_words * (2 * least_share - 1))
    by_size = sorted(cands, key=lambda c: (len(passages[c[1]]), c))
    for lo in range(0, len(by_size), 512):
        part = by_size[lo : lo + 512]
        m = max(len(passages[c[1]]) for c in part)
        width = max(c[3] - c[2] for c in part) + 2 * band + 1
        p = np.full((len(part), m), -1, np.int32)
        d = np.full((len(part), m + width - 1), -2, np.int32)
        for r, (t, item, x, _) in enumerate(part):
            p[r, : len(passages[item])] = passages[item]
            a = x - band
            seg = texts[t][max(0, a) : max(0, a + m + width - 1)]
            d[r, max(0, -a) : max(0, -a) + len(seg)] = seg
        best, _, _ = scores(p, d)
        rows = np.nonzero(best >= least_score)[0]
        if not len(rows):
            continue
        _, at, ways = scores(p[rows], d[rows], keep=True)
        for q, r in enumerate(rows):
            t, item, x, _ = part[r]
            i, k = divmod(int(at[q]), width)
            steps: list[tuple[bool, int]] = []  # (equal, position in the text) from the end to the start
            while i >= 0 and 0 <= k < width and (w := ways[i, q, k]):
                j = i + k
                if w == 1:
                    steps.append((p[r, i] == d[r, j], j))
                    i -= 1
                elif w == 2:
                    steps.append((False, j))
                    i, k = i - 1, k + 1
                else:
                    steps.append((False, j))
                    k -= 1
            steps.reverse()
            got = stretch([bool(e) for e, _ in steps], least_words, least_share)
            if got:
                same = [x - band + j for e, j in steps[got[0] : got[1]] if e]
                out.append((t, item, same[0], got[1] - got[0], same))
    return out


def better_told(found: list[tuple[int, int, int, list[int]]]) -> list[bool]:
    """Whether another passage has more equal words in the same place, for stretches (item, start, steps, equal positions) of one text.

    Passages may share turns of phrase. Where the text holds the words of one of
    them, others agree only in the phrase. Passages that agree with the text in
    equally many words of the place, as where one holds a part of another, all
    stand.
    """
    order = sorted(range(len(found)), key=lambda k: found[k][1])
    starts = [found[k][1] for k in order]
    longest = max((f[3][-1] - f[1] + 1 for f in found), default=0)
    out = []
    for item, start, _, same in found:
        end = same[-1] + 1
        others = order[bisect.bisect_left(starts, start - longest) : bisect.bisect_left(starts, end)]
        most = max((bisect.bisect_left(o, end) - bisect.bisect_left(o, start) for k in others if found[k][0] != item and (o := found[k][3])), default=0)
        out.append(most > len(same))
    return out


def find_leaks(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, limit: int = 100_000) -> DataFrame:
    """(doc_id, item_id, kind, start, words, same) of every passage found in a document.

    ``documents`` has doc_id, text, ``items`` item_id, passage; other columns
    are left out. Null and empty texts and passages, and passages of fewer than
    ``least_words`` words, match nothing. Letter case, punctuation and line
    breaks do not count. Repeated items are one item each, several passages of an
    item are looked for one by one; the best place of an item stands. ``words``
    counts the steps of the alignment, words added in the document too.
    """
    spark = documents.sparkSession
    rows = bounded_rows(items.select("item_id", "passage").where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).distinct(), limit, "the evaluation set")
    kept = [(r["item_id"], ws) for r in sorted(rows, key=lambda r: (r["item_id"], r["passage"])) if len(ws := words(r["passage"])) >= least_words]
    item_of, passages = [i for i, _ in kept], dict(enumerate(ws for _, ws in kept))
    out = "doc_id bigint, item_id bigint, kind string, start int, words int, same int"
    if not passages:
        return spark.createDataFrame([], out)
    terms = spark.createDataFrame([(t,) for t in sorted({w for ws in passages.values() for w in ws})], "term string")
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    tokens = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("pos", "term"))
    # Sizes: the terms of the checked evaluation set.
    postings = cut_to_table(tokens.join(F.broadcast(terms), "term", "left_semi"), "postings")
    df = {r["term"]: r["n"] for r in postings.groupBy("term").agg(F.count_distinct("doc_id").alias("n")).toLocalIterator()}
    found, seeds = anchors(passages, df)
    rarest = spark.createDataFrame(found, "term string, passage int, off int")
    seeded = postings.join(F.broadcast(spark.createDataFrame([(x,) for x in sorted(seeds)], "term string")), "term", "left_semi").select("doc_id").distinct()
    hits = postings.join(seeded, "doc_id", "left_semi").join(F.broadcast(rarest), "term").withColumn("b", F.floor((F.col("pos") - F.col("off")) / BUCKET).cast("int"))
    # Distinct offsets as two bit sets: combined before the shuffle, unlike a distinct count. Offsets 128 apart share a
    # bit, in the windows' masks too.
    one = F.lit(1).cast("bigint")
    bit = lambda low: F.when((F.col("off") % 128 < 64) == F.lit(low), F.call_function("shiftleft", one, F.col("off") % 64)).otherwise(F.lit(0).cast("bigint"))
    shift = F.col("pos") - F.col("off")
    hits = hits.groupBy("doc_id", "passage", "b").agg(F.bit_or(bit(True)).alias("p"), F.bit_or(bit(False)).alias("q"), F.min(shift).alias("x"), F.max(shift).alias("y"))
    # A passage that begins near a bucket's edge has its postings in two: each bucket counts with its right neighbour.
    both = hits.withColumn("b", F.explode(F.array(F.col("b"), F.col("b") - 1))).groupBy("doc_id", "passage", "b").agg(F.bit_or("p").alias("p"), F.bit_or("q").alias("q"), F.min("x").alias("x"), F.max("y").alias("y"))
    met = both.where(F.bit_count("p") + F.bit_count("q") >= LEAST_HITS).groupBy("doc_id").agg(F.collect_set(F.struct("passage", "x", "y", "p", "q")).alias("cands"))
    masks = {no: window_masks(ws, df) for no, ws in passages.items()}
    number = {w: k for k, w in enumerate(sorted({w for ws in passages.values() for w in ws}))}
    coded = {item: [number[w] for w in ws] for item, ws in passages.items()}

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [[number.get(w, -3) for w in words(t)] for t in pdf["text"]]
            cands = in_one_window([(k, c["passage"], c["x"], c["y"], c["p"], c["q"]) for k, cs in enumerate(pdf["cands"]) for c in cs], masks)
            of_text: dict[int, list[tuple]] = {}
            for k, no, start, n, same in judge(cands, texts, coded, least_words, least_share):
                of_text.setdefault(k, []).append((item_of[no], start, n, same, len(same) == n == len(coded[no])))
            best: dict[tuple, tuple] = {}
            for k, found in of_text.items():
                for (item, start, n, same, exact), worse in zip(found, better_told([f[:4] for f in found])):
                    me = (len(same), -n, -start, exact)
                    if not worse and ((k, item) not in best or me > best[k, item]):
                        best[k, item] = me
            docs = list(pdf["doc_id"])
            rows = [(docs[k], item, "exact" if exact else "near", -at, -n, same) for (k, item), (same, n, at, exact) in sorted(best.items())]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "kind", "start", "words", "same"])

    return docs.join(met, "doc_id").repartition(F.xxhash64("doc_id")).mapInPandas(verify, out).dropDuplicates(["doc_id", "item_id"])


def p8_found(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the evaluation items, whole or in part."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found}
ORACLE = {}
