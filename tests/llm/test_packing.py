import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.llm.packing import CAPACITY, pack, shortest_pack_first, token_counts


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
@settings(max_examples=100, deadline=None)
def test_patterns_keep_every_length(hist):
    patterns = shortest_pack_first(hist, 40)
    left = dict.fromkeys(hist, 0)
    for p, n in patterns:
        assert n > 0 and sum(p) <= 40
        for x in p:
            left[x] += n
    assert left == hist


def worst_fit(hist, capacity):
    """One length after the other, longest first, into the container with the most room."""
    packs = []
    for x in sorted((x for x, n in hist.items() for _ in range(n)), reverse=True):
        k = max(range(len(packs)), key=lambda k: capacity - sum(packs[k]), default=None)
        if k is None or capacity - sum(packs[k]) < x:
            packs.append([x])
        else:
            packs[k].append(x)
    return sorted(map(tuple, packs))


def test_the_shortest_pack_comes_first():
    assert sorted(shortest_pack_first({8: 1, 6: 1, 2: 1}, 10)) == [((6, 2), 1), ((8,), 1)]


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=8))
@settings(max_examples=100, deadline=None)
def test_as_one_by_one(hist):
    got = [p for p, n in shortest_pack_first(hist, 40) for _ in range(n)]
    one = worst_fit(hist, 40)
    assert len(got) == len(one) and sorted(map(sum, got)) == sorted(map(sum, one))


def test_every_token_once(spark):
    rows = [(k, 1 + (k * 37) % 90, "x") for k in range(900)] + [(5000, 0, "x"), (5001, None, "x"), (5002, 301, "x"), (5003, 100, "x"), (5004, 200, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, container string")
    got = pack(df, 100).collect()
    by_doc, used = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["container"], []).append((r["place"], r["length"]))
    for k, n, _ in rows:
        at = 0
        for start, length in sorted(by_doc.get(k, [])):
            assert start == at and (n > 100 or length == n)
            at += length
        assert at == (n or 0)
    assert all(sum(x for _, x in v) <= 100 and len({p for p, _ in v}) == len(v) for v in used.values())
    assert sum(n or 0 for _, n, _ in rows) / (100 * len(used)) > 0.9
    assert sorted(used) == list(range(len(used)))
    assert pack(df.limit(0), 100).count() == 0


def test_tokens_of_texts(spark, sf):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "word " * 30_000, "a"), (4, "one two", "a")], "doc_id bigint, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()}
    assert got[1] == 0 and 2 not in got and got[3] >= 30_000 and got[4] == 2
    from archivolt.llm.packing import p7_fill

    (r,) = p7_fill(spark, sf).collect()
    assert r["fullest"] <= CAPACITY and r["fill_rate"] > 0.9
    assert r["tokens"] == token_counts(spark.read.parquet(f"{sf}/documents.parquet")).agg(F.sum("n_tokens")).first()[0]
