"""Text of scanned pages to continuous paragraphs.

Two models are counted over all texts: a lexicon (every word that stands at
least LEAST_COUNT times, at any size of the corpus, kept as a table) and the
line templates of page furniture (by the lower confidence bound of how often
they come back, so that a rare stamp of many texts stays one).

Pages go by chunks of bounded size. A chunk is de-lined and read twice: the
first reading knows the COMMON most frequent words and notes every other form
that the decoder would have liked to know - rarer words, variants, halves, joined
words; these are looked up in the lexicon by a join, and the second reading has
them. So no task and not the driver ever holds the whole lexicon.

De-lined, a text is one stream of characters with line marks, and a Viterbi pass
over the stream chooses words jointly with what may have happened to them:
confused characters, a hyphen at a line end, a word split in two or two run
together. A second dynamic programme chooses the paragraph boundaries.
"""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from archivolt.functions.gazetteer import edits
from archivolt.session import bounded_rows, cut_to_table, table

#: A word is known from so many occurrences on, a template from so many texts on.
LEAST_COUNT, LEAST_TEXTS = 3, 3
#: Templates that may be furniture; more raise. They are the forms of the offices that wrote the pages, not of the pages.
MOST_TEMPLATES = 100_000
#: The most frequent words, which every task has at hand; all others are looked up.
COMMON = 100_000
#: Words that a task counts before it tells them.
MOST_HELD = 200_000
#: Characters of the pages of one chunk.
CHUNK_CHARS = 4_000_000

# What scanners commonly confuse, as read -> as printed.
CONFUSIONS = (
    ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("2", "z"), ("8", "b"), ("@", "a"), ("(", "c"),
    ("†", "t"), ("c", "e"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("rn", "m"), ("vv", "w"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("|", "l"), ("$", "s"),
)
HYPHENS = "-‐­¬="
#: Natural-log costs of the channel.
CONFUSE, CONFUSE_ODD, SPLIT, MERGE, UNKNOWN, KEEP_HYPHEN = 4.0, 1.0, 7.0, 7.0, 15.0, 1.0
LETTERS = r"A-Za-zÀ-ÖØ-öø-ÿ"
ODD = "0-9@(†ﬁﬂ|$"
WORD = re.compile(rf"[{LETTERS}{ODD}]+(?:['’][{LETTERS}]+)?")
REAL = re.compile(rf"[{LETTERS}]")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (runs of letters, an apostrophe inside) in lower case with their counts, told whenever MOST_HELD are held."""
    words, held = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?"), Counter()

    def told() -> pa.RecordBatch:
        return pa.record_batch({"w": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                low = text.lower()
                found = words.findall(low)
                if not low.isascii() and not "".join(found).replace("'", "").replace("’", "").isalpha():
                    # fractions and the like count as parts of words and are no letters
                    found = words.findall("".join(c if c.isalpha() or not c.isnumeric() else " " for c in low))
                held.update(found)
            if len(held) > MOST_HELD:
                yield told()
                held.clear()
    yield told()


def lexicon(texts: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """((w, n) of all words of at least LEAST_COUNT occurrences, occurrences of all words)."""
    counts = texts.select(text).mapInArrow(count_words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    counts = cut_to_table(counts, "lexicon")
    return counts.where(F.col("n") >= LEAST_COUNT), counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def surely(hits: Column, n: Column, z: float = 3.0) -> Column:
    """Lower end of Wilson's interval for a rate."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


#: White space at which a template has one space; where a sentence or a list may go on in the next line.
SPACES = " \t\n\x0b\f\r"
GOES_ON = re.compile("[.;,:-][\u0085\u2028\u2029]?\\Z")


def template_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place in the text from 0 to 1, template) of the lines of (key, text) that may be furniture."""
    spaces, digits = re.compile(f"[{SPACES}]+"), re.compile("[0-9]+")
    for batch in batches:
        keys, ats, out = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            ls = text.split("\n")
            last = max(len(ls) - 1, 1)
            for k, line in enumerate(ls):
                s = line.strip(SPACES)
                # Most lines fall by their ends; only the others are worth the making of a template.
                if not s or s[-1] in ".;,:-" or "a" <= s[0] <= "z" or category(s[0]) == "Ll" or not any(map(str.isalpha, s)):
                    continue
                t = digits.sub("9", spaces.sub(" ", s))
                if len(t) >= 4 and not GOES_ON.search(t):
                    keys.append(key)
                    ats.append(k / last)
                    out.append(t)
        yield pa.record_batch([pa.array(keys, batch.schema.field(0).type), pa.array(ats, pa.float64()), pa.array(out, pa.string())], [batch.schema.field(0).name, "at", "t"])


def templates(texts: DataFrame, key: str = "id", text: str = "text") -> list[str]:
    """Line templates (digits as 9) of page furniture, learnt from all texts.

    A template is furniture if it reads as no sentence and, surely, comes back
    within a quarter of its texts or stands at the very end of a third. More
    texts make a template surer and never less frequent.
    """
    kind = texts.schema[key].dataType.simpleString()
    lines = texts.select(key, text).mapInArrow(template_lines, f"`{key}` {kind}, at double, t string")
    per = lines.groupBy("t", key).agg(F.count(F.lit(1)).alias("n"), F.avg("at").alias("at"))
    stats = per.groupBy("t").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") > 1).alias("again"), F.count_if(F.col("at") >= 0.9).alias("last"))
    kept = stats.where((F.col("docs") >= LEAST_TEXTS) & ((surely(F.col("again"), F.col("docs")) >= 0.25) | (surely(F.col("last"), F.col("docs")) >= 0.3)))
    return sorted(r["t"] for r in bounded_rows(kept.select("t"), MOST_TEMPLATES, "the list of page furniture"))


class Lexicon:
    """Words with their counts; with ``missed`` it notes the forms asked for that it does not have."""

    def __init__(self, known: dict[str, int], total: int, noting: bool = False):
        self.known, self.total = known, total
        self.missed: set[str] | None = set() if noting else None

    def get(self, w: str) -> int | None:
        n = self.known.get(w)
        if n is None and self.missed is not None:
            self.missed.add(w)
        return n

    def __contains__(self, w: str) -> bool:
        return self.get(w) is not None


DIG = "[0-9lIiOo|sSzZ]"
PAGE_NO = re.compile(rf"(?:[-—–~]\s*{DIG}{{1,5}}\s*[-—–~]|[\[(]\s*{DIG}{{1,5}}\s*[\])]|[0-9lIO|]{{1,5}}|[Pp][.,]?\s?{DIG}{{1,5}})")
PAGE_WORD = re.compile(rf"(\S{{3,5}}?)\.?\s?{DIG}{{1,5}}(?:\s*(?:of|/|0f|o1)\s*{DIG}{{1,5}})?", re.I)
#: Neither of the two matches more characters of a line with single spaces.
LONGEST_NO = 21
DIGITS = re.compile(r"\d+")


class Stamps:
    """Which templates a line may be with at most two edits, at a cost that does not grow with their number.

    At most two edits leave one of three pieces of a template as it is, moved by
    no more than the letters put in or left out before it; so lines are looked
    up by what stands where a piece would. A swap over the seam of two pieces
    changes both, so the pieces of the template so swapped are kept as well.
    """

    def __init__(self, furniture: list[str]):
        self.held: dict[int, dict[tuple[int, int], dict[str, list[str]]]] = {}  # length -> (start, end) -> piece -> templates
        for t in sorted({t.lower() for t in furniture}):
            step = -(-len(t) // 3)
            seams = [k for k in (step, 2 * step) if k < len(t)]
            at = self.held.setdefault(len(t), {})
            for form in (t, *(t[: k - 1] + t[k] + t[k - 1] + t[k + 1 :] for k in seams)):
                for a in range(0, len(t), step):
                    same = at.setdefault((a, min(a + step, len(t))), {}).setdefault(form[a : a + step], [])
                    if same[-1:] != [t]:
                        same.append(t)
        self.plans: dict[tuple[int, int], list[tuple[int, int, dict[str, list[str]]]]] = {}

    def plan(self, length: int, most: int) -> list[tuple[int, int, dict[str, list[str]]]]:
        """(start, end, templates by the piece that stands there) for lines of a length."""
        found: dict[tuple[int, int], dict[str, list[str]]] = {}
        for n in range(length - most, length + most + 1):
            more, less = (most + length - n) // 2, (most - length + n) // 2
            for (a, b), pieces in self.held.get(n, {}).items():
                for s in range(max(-less, -a), min(more, length - b) + 1):
                    there = found.setdefault((a + s, b + s), {})
                    for piece, ts in pieces.items():
                        there.setdefault(piece, []).extend(ts)
        return [(a, b, there) for (a, b), there in found.items()]

    def near(self, low: str, most: int) -> bool:
        key = (len(low), most)
        plan = self.plans.get(key)
        if plan is None:
            plan = self.plans[key] = self.plan(*key)
        tried = set()
        for a, b, pieces in plan:
            for t in pieces.get(low[a:b], ()):
                if t not in tried:
                    if edits(low, t, most) <= most:
                        return True
                    tried.add(t)
        return False


class Plain(dict):
    """word -> whether it is known as it stands, so that no reading of it can be cheaper."""

    def __init__(self, reader: "Reader"):
        super().__init__()
        self.reader = reader

    def __missing__(self, w: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        cost, _, at = self.reader.word(w)
        self[w] = ok = at < 0 and cost < UNKNOWN
        return ok


class Sure(dict):
    """word -> whether it is plain and, if it is all letters, in the lexicon: between two such words nothing is to be decided."""

    def __init__(self, reader: "Reader"):
        super().__init__()
        self.reader = reader

    def __missing__(self, w: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        self[w] = ok = self.reader.plain[w] and (not w.isalpha() or w.lower() in self.reader.lex)
        return ok


class Reader:
    """Line classes, word decoding and paragraphs of one text at a time."""

    def __init__(self, lex: Lexicon, furniture: list[str]):
        self.lex = lex
        self.logp = math.log(max(1, lex.total))
        self.furniture = set(furniture)
        self.stamps = Stamps(furniture)
        self.word = lru_cache(200_000)(self._word)
        self.stamp = lru_cache(50_000)(self._stamp)
        self.plain = Plain(self)
        self.sure = Sure(self)

    # ---- lines ----

    def _stamp(self, t: str) -> bool:
        if t in self.furniture:
            return True
        low = t.lower()
        return len(low) >= 6 and self.stamps.near(low, 2 if len(low) >= 8 else 1)

    def is_head(self, s: str, heads: list[str]) -> bool:
        low = s.lower()
        if len(low) < 8:
            return low in heads
        most = 1 + len(low) // 12
        heads = [h for h in heads if len(h) >= len(low) - most]
        if not heads:
            return False
        # with at most so many edits, one of one more pieces of the line stands in the head as it is
        step = -(-len(low) // (most + 1))
        for h in heads:
            for i in range(0, len(low), step):
                if low[i : i + step] in h:
                    break
            else:
                continue
            part = h[: len(low)]
            if sum(a != b for a, b in zip(low, part)) + len(low) - len(part) <= most or edits(low, part, most) <= most:
                return True
        return False

    def is_furniture(self, s: str, heads: list[str]) -> bool:
        """A stripped, non-blank line that is no part of the running text."""
        if not s[0].isalnum() and not any(map(str.isalnum, s)):
            return True
        if len(s) <= LONGEST_NO:
            if PAGE_NO.fullmatch(s):
                return any(c.isdigit() or c in "lI|" for c in s)
            m = PAGE_WORD.fullmatch(s)
            if m and edits(m[1].lower(), "page", 1) <= 1:
                return True
        return self.stamp(DIGITS.sub("9", s)) or self.is_head(s, heads)

    # ---- words ----

    def cost(self, w: str) -> float:
        n = self.lex.get(w)
        return self.logp - math.log(n) if n else UNKNOWN + 0.5 * len(w)

    def _word(self, w: str) -> tuple[float, str, int]:
        """(cost, reading, offset of the first confused character or -1) of one written word."""
        low = w.lower()
        letters = len(REAL.findall(low))
        odd = any(not c.isalpha() and c not in "'’" or c in "ﬁﬂ" for c in low)
        if letters == 0 or (odd and (letters < 3 or re.fullmatch(r"\d+(?:st|nd|rd|th|mm|cm|km|m|ft|hz|s)?", low))):
            return 0.0, w, -1
        best = (self.cost(low) + (8.0 if odd else 0.0), w, -1)
        frontier = [(0.0, low, -1)]
        # A known word may be one confusion away from a far more frequent one, an unknown word two.
        for _ in range(1 if low in self.lex else 2):
            grown = []
            for c, x, first in frontier:
                for a, b in CONFUSIONS:
                    i = x.find(a)
                    while i >= 0:
                        fixed = x[:i] + b + x[i + len(a) :]
                        now = c + (CONFUSE if a.isalpha() and a not in "ﬁﬂ" else CONFUSE_ODD)
                        at = i if first < 0 else min(first, i)
                        if fixed in self.lex:
                            total = now + self.cost(fixed)
                            if total < best[0]:
                                best = (total, fixed, at)
                        grown.append((now, fixed, at))
                        i = x.find(a, i + 1)
            if best[2] >= 0:
                break
            frontier = list({x: (c, x, at) for c, x, at in reversed(grown)}.values())
        if best[2] < 0 and odd and letters >= 4:
            # An unknown word with a digit or sign between letters is misread, whatever it was.
            m = re.search(rf"(?<=[{LETTERS}])[{re.escape('0159@(†ﬁﬂ|62')}]+(?=[{LETTERS}])|^[0159@(†](?=[{LETTERS}]{{3}})|(?<=[{LETTERS}]{{3}})[0159@†]$", low)
            if m:
                return best[0], w, m.start()
        return best

    def decode(self, lines: list[tuple[int, str]]) -> tuple[list[str], set[int], set[int]]:
        """Joint decoding of the text lines: (repaired lines, split line numbers, misread line numbers).

        A line of known words between known words has one way through it, so
        the stream is decoded only around the others.
        """
        words = [WORD.findall(s) for _, s in lines]
        plain = self.plain
        calm = [bool(ws) and s[-1] not in HYPHENS and all(map(plain.__getitem__, ws)) for ws, (_, s) in zip(words, lines)]
        n = len(lines)
        out: list[str] = []
        split: set[int] = set()
        misread: set[int] = set()
        i = 0
        while i < n:
            if calm[i] and (i == 0 or calm[i - 1]) and (i == n - 1 or calm[i + 1]):
                out.append(lines[i][1])
                i += 1
                continue
            j = i + 1
            while j < n and not (calm[j] and calm[j - 1] and (j == n - 1 or calm[j + 1])):
                j += 1
            # Of a calm line at either end only the word that touches the next line has more than one way.
            ends = [calm[k] and all(map(self.sure.__getitem__, words[k])) for k in (i, j - 1)]
            got, s, m = self._decode(lines[i:j], *ends)
            out += got
            split |= s
            misread |= m
            i = j
        return out, split, misread

    def _decode(self, lines: list[tuple[int, str]], from_last: bool = False, to_first: bool = False) -> tuple[list[str], set[int], set[int]]:
        """``decode`` of all lines, of the first from its last word on, of the last up to its first word."""
        stream: list[tuple[int, str, str]] = []  # (index into lines, word, what follows it)
        heads: list[str] = []
        last, word, after = 0, None, ""  # the word before, which is put down when all that follows it is known
        tail = ""
        for k, (_, s) in enumerate(lines):
            at = 0
            matches = WORD.finditer(s)
            if from_last and k == 0:
                matches = list(matches)[-1:]
            elif to_first and k == len(lines) - 1:
                first, second = next(matches), next(matches, None)
                matches = [first]
                if second:
                    s, tail = s[: second.start()], s[second.start() :]
            for m in matches:
                start, end = m.span()
                if word is not None:
                    stream.append((last, word, after + ("\n" if at == 0 else "") + s[at:start]))
                else:
                    heads.append(s[:start])
                last, word, after, at = k, m[0], "", end
            if word is None:
                heads.append(s + "\n")
            elif at:
                after = s[at:] if tail else s[at:].rstrip()
            else:
                after += "\n" + s
        if word is not None:
            stream.append((last, word, after))
        n = len(stream)
        inf = float("inf")
        best, back = [inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        sure = [self.sure[w] for _, w, _ in stream]
        sure.append(True)
        for i in range(n):
            k, w, after = stream[i]
            c, fixed, at = self.word(w)
            if sure[i] and sure[i + 1] and ("\n" not in after or after[0] == "\n"):  # one way on
                if best[i] + c < best[i + 1]:
                    best[i + 1], back[i + 1] = best[i] + c, (i, ((w, fixed, at),), None)
                continue
            ends_in_hyphen = "\n" in after and after.split("\n")[0] and after.split("\n")[0][0] in HYPHENS and after[1:].strip() == ""
            options = [(c + (9.0 if ends_in_hyphen else 0.0), i + 1, ((w, fixed, at),), None)]
            if i + 1 < n:
                k2, w2, _ = stream[i + 1]
                whole = w + w2
                if ends_in_hyphen and w2[0].isalpha() | (w2[0] in "0159@(†ﬁ"):
                    cj, fj, aj = self.word(whole)
                    options.append((cj, i + 2, ((w, w2, fj, aj),), "hyphen"))
                    c2, f2, a2 = self.word(w2)
                    options.append((c + c2 + KEEP_HYPHEN, i + 2, ((w, fixed, at), (w2, f2, a2)), "compound"))
                elif after in (" ", "\n") and w.isalpha() and w2.isalpha() and w2[0].islower() and (w.lower() not in self.lex or w2.lower() not in self.lex) and whole.lower() in self.lex:
                    options.append((SPLIT + self.cost(whole.lower()), i + 2, ((w, w2, whole, -1),), "split"))
            if w.isalpha() and c >= UNKNOWN and len(w) >= 5:
                for j in range(2, len(w) - 1):
                    a, b = w[:j].lower(), w[j:].lower()
                    if (a in self.lex) & (b in self.lex):  # both are asked for
                        options.append((MERGE + self.cost(a) + self.cost(b), i + 1, ((w, w[:j] + " " + w[j:], -1),), "merge"))
            for cost, j, what, how in options:
                if best[i] + cost < best[j]:
                    best[j], back[j] = best[i] + cost, (i, what, how)
        if self.lex.missed is not None:
            return [], set(), set()  # all has been asked for; what would come out is of no use yet
        path, j = [], n
        while j > 0:
            i, what, how = back[j]
            path.append((i, j, what, how))
            j = i
        split, misread, out = set(), set(), heads
        for i, j, what, how in reversed(path):
            k, w, after = stream[i]
            no = lines[k][0]
            if j == i + 1:
                _, fixed, at = what[0]
                if at >= 0:
                    misread.add(no)
                out.append((w if fixed == w else _cased(w, fixed)) + after)
                continue
            k2, w2, after2 = stream[i + 1]
            no2 = lines[k2][0]
            if how == "compound":
                for (x, fixed, at), line in zip(what, (no, no2)):
                    if at >= 0:
                        misread.add(line)
                out.append(_cased(w, what[0][1]) + "-" + _cased(w2, what[1][1]) + _moved(after, after2))
            else:
                _, _, fixed, at = what[0]
                if at >= 0:
                    misread.add(no if at < len(w) else no2)
                out.append(_cased(w + w2, fixed) + _moved(after, after2))
            if k2 != k:
                split.add(no)
        return ("".join(out) + tail).split("\n"), split, misread

    # ---- paragraphs ----

    def paragraphs(self, lines: list[str], gaps: list[int]) -> list[str]:
        """Cut lines into paragraphs; ``gaps[i]`` is 1 if blank lines stood before line i, 2 if a page break did."""
        if not lines:
            return []
        width = sorted(len(x) for x in lines)[int(0.8 * (len(lines) - 1))] or 1

        def price(i: int) -> tuple[float, float]:
            prev, now = lines[i - 1].rstrip(), lines[i].strip()
            ended = prev[-1:] in ".!?:”\"" or len(prev) < 0.7 * width
            joins = now[:1].islower() or prev[-1:] in ",-"
            cut = 3.0 + 5.0 * joins - 2.0 * ended - 4.0 * (gaps[i] == 1) - 0.5 * (gaps[i] == 2) - 1.0 * (len(prev) < 0.7 * width)
            keep = 3.5 * (gaps[i] == 1) + 1.0 * (len(prev) < 0.6 * width and not joins)
            return cut, keep

        # states: 0 the line goes on, 1 it starts a paragraph; two starts in a row cost more unless a line stands alone
        cost, back = [9e9, 0.0], []
        for i in range(1, len(lines)):
            cut, keep = price(i)
            lone = 1.0 if lines[i - 1].rstrip()[-1:] not in ".!?:" and not lines[i - 1].isupper() else 0.0
            to_keep = min((cost[0] + keep, 0), (cost[1] + keep, 1))
            to_cut = min((cost[0] + cut, 0), (cost[1] + cut + lone, 1))
            cost = [to_keep[0], to_cut[0]]
            back.append((to_keep[1], to_cut[1]))
        state = 0 if cost[0] < cost[1] else 1
        starts = []
        for i in range(len(lines) - 1, 0, -1):
            if state == 1:
                starts.append(i)
            state = back[i - 1][state]
        cuts = [0, *reversed(starts), len(lines)]
        return [" ".join(x.strip() for x in lines[a:b] if x.strip()) for a, b in zip(cuts, cuts[1:])]

    def delined(self, text: str, title: str | None, agency: str | None) -> tuple[list[int], list[tuple[int, str]], list[int]]:
        """(numbers of furniture lines, (number, text) of the others that are not blank, what stood before each of these)."""
        squeeze = lambda s: " ".join(s.lower().split())
        t, a = squeeze(title or ""), squeeze(agency or "")
        heads = [h for h in (f"{a} / {t}" if a and t else "", t, a) if h]
        drop, kept, gaps, gap = [], [], [], 0
        for no, raw in enumerate(text.split("\n"), 1):
            s = " ".join(raw.split())
            if not s:
                gap = max(gap, 1)
                continue
            if self.is_furniture(s, heads):
                drop.append(no)
                gap = 2
                continue
            kept.append((no, s))
            gaps.append(gap)
            gap = 0
        return drop, kept, gaps

    def read(self, text: str, title: str | None, agency: str | None, whole: bool = True) -> tuple[str | None, list[tuple[int, str]]]:
        """(repaired text if ``whole``, [(line number, kind)])."""
        return self.finish(*self.delined(text, title, agency), whole)

    def finish(self, drop: list[int], kept: list[tuple[int, str]], gaps: list[int], whole: bool) -> tuple[str | None, list[tuple[int, str]]]:
        lines, split, misread = self.decode(kept)
        kinds = [(no, "drop") for no in drop] + [(no, "split") for no in split] + [(no, "misread") for no in misread]
        if not whole:
            return None, sorted(kinds)
        if len(lines) != len(kept):
            gaps = (gaps + [0] * len(lines))[: len(lines)]
        return "\n\n".join(p for p in self.paragraphs(lines, gaps) if p), sorted(kinds)


def _cased(written: str, fixed: str) -> str:
    if written.isupper() and len(written) > 1:
        return fixed.upper()
    return fixed[:1].upper() + fixed[1:] if written[:1].isupper() else fixed


def _moved(between: str, after: str) -> str:
    """What follows two joined halves: the line mark that stood between them goes to the next white space."""
    if "\n" not in between:
        return after
    m = re.search(r"\s", after)
    if not m:
        return after + "\n"
    return after[: m.start()] + "\n" + after[m.start() + (m[0] == " ") :]


REPAIRED = "id string, repaired string, lines array<struct<line_no:int,kind:string>>"
#: Lines are joined by the line mark, which none of them holds; numbers are packed.
DELINED = "chunk int, id string, drop binary, no binary, gap binary, lines string, asked array<string>"


def packed(numbers: list[int]) -> bytes:
    return array("i", numbers).tobytes()


def unpacked(b: bytes) -> list[int]:
    return array("i", b).tolist()


def repair_pages(records: DataFrame, whole: bool = True, chunk_chars: int = CHUNK_CHARS, common: int = COMMON) -> DataFrame:
    """(id, repaired, lines) of every record with text.

    ``records`` has id, text, title, agency; other columns are left out. Null
    and blank texts give no row; rows repeated whole count once. ``lines`` lists
    lines counted from 1 that are furniture (drop), end inside a word (split)
    or hold a misread word (misread). Without ``whole`` only the lines are told
    and ``repaired`` is null.
    """
    texts = records.select("id", "text", "title", "agency").where(F.length(F.trim("text")) > 0)
    spark = records.sparkSession
    lex, total = lexicon(texts)
    furniture = spark.sparkContext.broadcast(templates(texts))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = max(4 * spark.sparkContext.defaultParallelism, math.ceil(chars / chunk_chars))
    pages = texts.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    known = spark.sparkContext.broadcast({r["w"]: r["n"] for r in lex.orderBy(F.desc("n"), "w").limit(common).collect()})

    delined_schema, repaired_schema = (to_arrow_schema(StructType.fromDDL(x)) for x in (DELINED, REPAIRED))

    def note(keys: tuple, own: pa.Table) -> pa.Table:
        reader, chunk = Reader(Lexicon(known.value, total, noting=True), furniture.value), keys[0].as_py()
        out = []
        for i, t, title, agency in zip(*(own.column(c).to_pylist() for c in ("id", "text", "title", "agency"))):
            drop, kept, gaps = reader.delined(t, title, agency)
            reader.decode(kept)
            out.append((chunk, i, packed(drop), packed([no for no, _ in kept]), packed(gaps), "\n".join([s for _, s in kept]), None))
        out.append((chunk, None, None, None, None, None, sorted(reader.lex.missed)))
        return pa.table(list(map(list, zip(*out))), schema=delined_schema)

    # By number, so that chunks are not gathered into fewer tasks for their few bytes: the time goes into reading them.
    spread = lambda df: df.repartition(chunks, "chunk").groupBy("chunk")
    first = cut_to_table(spread(pages).applyInArrow(note, DELINED), "delined")
    asked = first.where(F.col("asked").isNotNull()).select(F.col("chunk").alias("of"), F.explode("asked").alias("w"))
    rarer = lex.join(asked, "w").select(F.col("of").alias("chunk"), "w", "n")

    def run(own: pa.Table, words: pa.Table) -> pa.Table:
        reader = Reader(Lexicon({**known.value, **dict(zip(words.column("w").to_pylist(), words.column("n").to_pylist()))}, total), furniture.value)
        ids, drops, nos, gaps, lines = (own.column(c).to_pylist() for c in ("id", "drop", "no", "gap", "lines"))
        got = [reader.finish(unpacked(drop), list(zip(unpacked(no), line.split("\n"))), unpacked(gap), whole) for drop, no, gap, line in zip(drops, nos, gaps, lines)]
        return pa.table([ids, [g[0] for g in got], [[{"line_no": n, "kind": k} for n, k in g[1]] for g in got]], schema=repaired_schema)

    delined = first.where(F.col("asked").isNull()).drop("asked")
    return spread(delined).cogroup(spread(rarer)).applyInArrow(run, REPAIRED)


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Furniture, split and misread lines of every record's page text."""
    lines = repair_pages(table(spark, sf_dir, "search_index"), whole=False).select("id", F.explode("lines").alias("x"))
    return lines.select("id", F.col("x.line_no").alias("line_no"), F.col("x.kind").alias("kind")).distinct()


def p6_repaired(spark, sf_dir: str) -> DataFrame:
    """The repaired text of every record."""
    return repair_pages(table(spark, sf_dir, "search_index")).select("id", "repaired").distinct()


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
ORACLE = {}
