import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm.leaks import anchors, find_leaks, scores, stretch, words

P = "At the quarry every surveyor pays eleven pence to touch the gilded trumpet that Tenrugil left, and curiously Zanvivi keeps a pearl plaque at its aqueduct naming the meticulous lamplighter."
FILL = "the analyst closed the sheet and returned the folder to the office in the evening "


def test_found_and_not(spark):
    ws = P.split()
    near = [w if k % 9 else "perhaps" for k, w in enumerate(ws)]
    texts = {
        1: FILL * 3 + P + " " + FILL,
        2: FILL + "\r\n".join(w.upper() for w in words(P)) + "\n" + FILL,
        3: FILL + " ".join(near) + " " + FILL,
        4: FILL + " ".join(ws[5:23]) + " " + FILL,
        5: FILL + " ".join(ws[5:13]) + " " + FILL,  # a scrap
        6: FILL * 4,
        7: None,
        8: "",
        9: (FILL * 2000) + P + "\n" + (FILL * 2000),
        10: " ".join(w if k % 2 else "other" for k, w in enumerate(ws)),
    }
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(None, P, "x"), (1, texts[1], "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(70, P, "q"), (70, P, "q"), (71, None, "q"), (72, "", "q"), (73, "short passage", "q"), (None, P, "q")], "item_id bigint, passage string, question string")
    got = {r["doc_id"]: r for r in find_leaks(docs, items).collect()}
    assert set(got) == {1, 2, 3, 4, 9}
    assert all(r["item_id"] == 70 for r in got.values())
    assert got[1]["kind"] == got[2]["kind"] == got[9]["kind"] == "exact" and got[3]["kind"] == got[4]["kind"] == "near"
    assert got[1]["start"] == len(words(FILL * 3)) and got[4]["words"] == 18
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def plain_score(p, d):
    """Best local alignment score without a band, cell by cell."""
    best, before = 0, [0] * (len(d) + 1)
    for w in p:
        now = [0]
        for j, x in enumerate(d, 1):
            now.append(max(0, before[j - 1] + (1 if w == x else -1), before[j] - 1, now[j - 1] - 1))
        best, before = max(best, *now), now
    return best


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=12)), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_scores_equal_plain_alignment(pairs):
    m = max(len(p) for p, _ in pairs)
    p, d = np.full((len(pairs), m), -1), np.full((len(pairs), 12 + 12 + 2 * 24), -2)
    for r, (a, b) in enumerate(pairs):
        p[r, : len(a)] = a
        d[r, 24 : 24 + len(b)] = b
    got, _, _ = scores(p.astype(np.int32), d.astype(np.int32))
    assert got.tolist() == [plain_score(a, b) for a, b in pairs]


def test_stretch():
    eq = [True] * 20 + [False] * 10 + [True] * 20
    a, b = stretch(eq, 14, 0.84)
    assert b - a >= 20 and sum(eq[a:b]) >= 0.84 * (b - a)
    assert stretch([True] * 13, 14, 0.84) is None and stretch([True, False] * 20, 14, 0.84) is None


def test_every_item_of_a_shared_stretch(spark):
    ws = [f"word{k}x" for k in range(60)]
    one, two = " ".join(ws[:40]), " ".join([f"other{k}y" for k in range(10)] + ws[15:35] + [f"more{k}z" for k in range(10)])
    split = " ".join(ws[40:60] + ["changed"] * 10)  # twenty words, ten altered ones, twenty words
    third = [f"third{k}t" for k in range(50)]
    docs = spark.createDataFrame([(1, FILL + one + FILL), (2, FILL + two + FILL), (3, FILL + split), (4, " ".join(third[:20] + ["q"] * 10 + third[30:]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, one), (2, two), (3, " ".join(ws[40:60])), (3, " ".join(third))], "item_id bigint, passage string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 3)}


def test_shared_phrases_belong_to_the_passage_that_stands_there(spark):
    phrase = "by then {} had walked {} furlongs with a {} under one arm and a {} scarf over the other"
    a = phrase.format("ackvor", "nine", "kettle", "slate") + " while the local miller counted"
    b = phrase.format("tenruz", "four", "kettle", "maroon") + " until a junior lamplighter woke"
    docs = spark.createDataFrame([(1, FILL + a + " " + FILL), (2, FILL + b + " " + FILL), (3, a + " " + FILL + b)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, a), (2, b)], "item_id bigint, passage string")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()} == {(1, 1), (2, 2), (3, 1), (3, 2)}


def test_anchors_are_the_rarest():
    p = {1: ["the"] * 20 + ["rare"]}
    found, seeds = anchors(p, {"the": 100, "rare": 1})
    assert ("rare", 1, 20) in found and "rare" in seeds
