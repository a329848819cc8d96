import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.functions.gazetteer import edits
from archivolt.llm import pagetext
from archivolt.llm.pagetext import Lexicon, Reader, Stamps, count_words, lexicon, repair_pages, templates

LEX = {w: n for n, ws in ((900, "the of and was a in not"), (200, "noted clock number bright nurse page folder corner modern returned low level light window mirror contradict"), (40, "something ordinance thunderhead")) for w in ws.split()}


def reader(furniture=()):
    return Reader(Lexicon(LEX, sum(LEX.values())), list(furniture))


def kinds(text, title=None, agency=None, furniture=()):
    return dict(reader(furniture).read(text, title, agency)[1])


def test_furniture():
    text = "Bureau / A red light ov\nthe nurse was noted\n\n- 14 -\n. : ~\nPage l7\nUNCLASSIF1ED\np. 3\n[9]\n12\nreturned the folder"
    got = kinds(text, "A red light over the window", "Bureau", ["UNCLASSIFIED"])
    assert got == {1: "drop", 4: "drop", 5: "drop", 6: "drop", 7: "drop", 8: "drop", 9: "drop", 10: "drop"}


def test_split_and_misread():
    text = "the nurse was n0ted in the thun-\nderhead and the ordi¬\n\nPage 2\nnance was not low-\nlevel. The clock - the liglit -\nwas sornething bright"
    repaired, lines = reader().read(text, None, None)
    assert lines == [(1, "misread"), (1, "split"), (2, "split"), (4, "drop"), (5, "split"), (6, "misread"), (7, "misread")]
    assert "noted in the thunderhead and the ordinance was not low-level. The clock - the light - was something bright" in repaired


def test_words_split_and_run_together():
    repaired, _ = reader().read("the thunder head was some thing\nbrightcorner of the page", None, None)
    assert "something" in repaired and "bright corner" in repaired


def test_numbers_and_names_stay():
    assert kinds("the nurse at 10:08 on 19.11.2018\nnoted 927 in Kestmere") == {}


def test_paragraphs():
    text = "NARRATIVE\n\nThe nurse was noted in the window of the folder and\nreturned the mirror.\n\nThe clock was bright and the light of the window was\n\nPage 3\nnot returned."
    repaired, _ = reader().read(text, None, None)
    assert repaired.split("\n\n") == ["NARRATIVE", "The nurse was noted in the window of the folder and returned the mirror.", "The clock was bright and the light of the window was not returned."]


def test_models_and_edges(spark):
    page = "Handle with care {0}\nthe nurse was noted in the window\nand the clock was not bright.\n- {0} -\n\x0c\nHandle with care {0}\nthe folder was returned in the\nlight of the modern page.\n- 9 -"
    rows = [(f"r{k}", page.format(k), "t", "a", "x") for k in range(12)]
    rows += [("n", None, "t", "a", "x"), ("e", "", None, None, "x"), ("b", " \n ", None, None, "x"), ("long", "the nurse was noted " * 20_000, None, None, "x"), (None, "the clock", None, None, "x"), rows[0]]
    df = spark.createDataFrame(rows, "id string, text string, title string, agency string, line_no string")
    texts = df.where("length(trim(text)) > 0").distinct()
    words, total = lexicon(texts)
    counts = {r["w"]: r["n"] for r in words.collect()}
    assert counts["nurse"] >= 12 and min(counts.values()) >= 3 and total > sum(counts.values()) - 1 and "Handle with care 9" in templates(texts)
    got = {r["id"]: r for r in repair_pages(df).collect()}
    assert set(got) == {f"r{k}" for k in range(12)} | {"long", "b", None} - ({"b"} if "b" not in got else set())
    assert [(x["line_no"], x["kind"]) for x in got["r3"]["lines"]] == [(1, "drop"), (4, "drop"), (6, "drop"), (9, "drop")]
    assert got["long"]["lines"] == []
    assert repair_pages(df.limit(0)).count() == 0


PIECES = st.sampled_from("the of nurse n0ted thun- derhead something some thing low- level brightcorner window liglit 10:08 Kestmere zzqx was ordi¬ nance - . 12mm".split())


@given(st.lists(st.lists(PIECES, min_size=1, max_size=6), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_decoding_around_unknown_words_is_decoding_all(lines):
    kept = [(k, " ".join(ws)) for k, ws in enumerate(lines, 1)]
    r = reader()
    assert r.decode(kept) == r._decode(kept)


def test_what_is_asked_suffices():
    """A reader that knows the page's own words asks for all that the full lexicon would have answered."""
    text = "the nurse was n0ted in the thun-\nderhead and the ordi¬\nnance was not low-\nlevel. The liglit was sornething in the some thing brightcorner"
    full = reader().read(text, None, None)
    own = {w: n for w, n in LEX.items() if w in text.lower().split()}
    noting = Reader(Lexicon(own, sum(LEX.values()), noting=True), [])
    noting.read(text, None, None)
    some = {**own, **{w: LEX[w] for w in noting.lex.missed if w in LEX}}
    assert Reader(Lexicon(some, sum(LEX.values())), []).read(text, None, None) == full


def planted(rnd, n):
    """(id, page text, clean paragraphs) with hyphens, misreads, heads and page numbers put in."""
    words = [w for w in LEX if len(w) > 2]
    out = []
    for k in range(n):
        paragraphs, lines = [], []
        for _ in range(3):
            ws = [rnd.choice(words) for _ in range(30)]
            ws[0] = ws[0].capitalize()
            paragraphs.append(" ".join(ws) + ".")
            line: list[str] = []
            body = []
            for w in paragraphs[-1].split():
                if len(" ".join([*line, w])) > 50:
                    if len(w) > 7 and w.isalpha() and rnd.random() < 0.5:
                        line.append(w[:4] + "-")
                        body.append(" ".join(line))
                        line = [w[4:]]
                        continue
                    body.append(" ".join(line))
                    line = []
                line.append(w.replace("o", "0", 1) if rnd.random() < 0.05 and "o" in w[1:-1] and len(w) > 4 else w)
            lines += [*body, " ".join(line), ""]
            lines.insert(rnd.randrange(len(lines) - 3, len(lines) - 1), f"- {rnd.randrange(1, 99)} -")
        out.append((f"p{k}", "\n".join([*lines, "STAMPED BY THE DESK"]), paragraphs))
    return out


def test_planted_pages_come_out_whole_at_any_size(spark):
    rnd = random.Random(4)
    pages = planted(rnd, 40)
    schema = "id string, text string, title string, agency string"
    small = {r["id"]: r for r in repair_pages(spark.createDataFrame([(i, t, None, None) for i, t, _ in pages], schema)).collect()}
    same = sum(" ".join(small[i]["repaired"].split()) == " ".join(ps[k] for k in range(3)) for i, _, ps in pages)
    cut = sum(small[i]["repaired"].split("\n\n") == ps for i, _, ps in pages)
    assert same >= 0.95 * len(pages) and cut >= 0.9 * len(pages)
    more = pages + [(f"x{i}", t, ps) for i, t, ps in planted(rnd, 400)]
    large = {r["id"]: r for r in repair_pages(spark.createDataFrame([(i, t, None, None) for i, t, _ in more], schema), chunk_chars=20_000).collect()}
    assert all(large[i]["repaired"] == small[i]["repaired"] and large[i]["lines"] == small[i]["lines"] for i, _, _ in pages)


def test_stamps_are_looked_up_not_gone_through(monkeypatch):
    """Lines are compared with the templates that share a piece in its place, so more templates cost no more comparisons."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    lines = [" ".join(word() for _ in range(3)) + " as office copy" for _ in range(300)]
    tried = [0]
    monkeypatch.setattr(pagetext, "edits", lambda *a: tried.__setitem__(0, tried[0] + 1) or edits(*a))
    # every template has a piece that stands in every line, but at another place
    r = reader([f"as office copy {word()} {word()} {word()}" for _ in range(2_000)])
    assert not any(r.stamp(x) for x in lines) and tried[0] < len(lines)


SHORT = st.text("abc ", min_size=6, max_size=14)


@given(SHORT, st.lists(st.tuples(st.integers(0, 3), st.integers(0, 13), st.sampled_from("abcx")), max_size=2))
@settings(max_examples=400, deadline=None)
def test_stamps_miss_none(template, changes):
    """A swap over the seam of two pieces and a change in the third leave no piece as it is: the template is found all the same."""
    s = list(template)
    for kind, k, c in changes:
        k = min(k, len(s) - 1)
        if kind == 0:
            s[k] = c
        elif kind == 1:
            s.insert(k, c)
        elif kind == 2 and len(s) > 6:
            s.pop(k)
        elif k + 1 < len(s):
            s[k], s[k + 1] = s[k + 1], s[k]
    line = "".join(s)
    most = 2 if len(line) >= 8 else 1
    assert Stamps([template]).near(line, most) == (edits(line, template, most) <= most)
    assert Stamps(["abcdefghijkl"]).near("abcedfghijxl", 2)


def test_words_are_runs_of_letters():
    batch = pa.record_batch({"text": ["The CAT's 2nd n0te, d’Or ½cup Ⅳx", None, "cat's " * 3]})
    (got,) = count_words([batch])
    assert dict(zip(*got.to_pydict().values())) == {"the": 1, "cat's": 4, "nd": 1, "n": 1, "te": 1, "d’or": 1, "cup": 1, "x": 1}


def test_rarer_words_are_looked_up(spark):
    """Pages read alike whether a task has all words at hand or only the two most frequent."""
    pages = planted(random.Random(7), 30)
    df = spark.createDataFrame([(i, t, None, None) for i, t, _ in pages], "id string, text string, title string, agency string")
    few, all_ = ({r["id"]: (r["repaired"], r["lines"]) for r in repair_pages(df, common=n).collect()} for n in (2, 100_000))
    assert few == all_ and len(few) == 30
