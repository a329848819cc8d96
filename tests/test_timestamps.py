import itertools
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.functions import timeparse
from archivolt.functions.gazetteer import Gazetteer, edits
from archivolt.operators.timestamps import Chain, choose_readings, interpret, margin_of, record_times

PLACES = [(1, "Dreygate", "Arizona", "America/Phoenix"), (2, "Lake Fenaridge", "Illinois", "America/Chicago"), (3, "Twinham", "Ohio", "America/New_York"), (4, "Twinham", "Iowa", "America/Chicago")]


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("10/28/2001-10/29/2001", None, "2001-10-28"),
        ("13.05.2004", None, "2004-05-13"),
        ("2/30/01", None, None),
        ("13/1/01", None, None),
        ("12/30/47", None, "1947-12-30"),
        ("5/8/26", None, "2026-05-08"),
        ("6/1/27", None, "1927-06-01"),
        ("June 1947", None, "1947-06"),
        ("--/--/47", None, "1947"),
        ("1986.", None, "1986"),
        ("1er novembre 2016", None, "2016-11-01"),
        ("20180227T2235Z", None, "2018-02-27T22:35:00Z"),
        ("190430BOCT22", None, "2022-10-19T02:30:00Z"),
        ("1320290580870", None, "2011-11-03T03:23:00Z"),
        ("2015-05-12 6:16:13PM America/Denver", None, "2015-05-13T00:16:13Z"),
        ("2018-11-19  8:46:04 p.m.", "America/New_York", "2018-11-20T01:46:04Z"),
        ("2019-04-23 19:52 CDT", None, "2019-04-24T00:52:00Z"),
        ("2021-03-14 02:30", "America/New_York", None),  # skipped by the clocks
        ("2021-11-07 01:30", "America/New_York", None),  # twice on the clocks
        ("2021-11-07 01:30 EST", "America/New_York", "2021-11-07T06:30:00Z"),
        ("2018-11-19T14:43:03", None, None),
        ("24:00 1/1/2001", None, None),
        ("N/A", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_one_reading(text, zone, want):
    got = {n[0] for r in timeparse.readings(text) if len(at := timeparse.normals(r, zone)) == 1 for n in at}
    assert got == ({want} if want else set())


def test_every_reading():
    read = lambda v, zone=None: {(n[0], r.odd) for r in timeparse.every_reading(v) for n in timeparse.normals(r, zone)}
    assert read("3/4/2001") == {("2001-03-04", 0), ("2001-04-03", 1)}
    assert read("13/4/01") == {("2001-04-13", 1), ("1901-04-13", 2)}
    assert read("3.4.30") == {("1930-04-03", 0), ("2030-04-03", 1), ("1930-03-04", 1), ("2030-03-04", 2)}
    assert read("2021-11-07 01:30", "America/New_York") == {("2021-11-07T05:30:00Z", 0), ("2021-11-07T06:30:00Z", 0)}
    assert read("1320290580") == {("2011-11-03T03:23:00Z", 0)} and read("2001-02-03") == {("2001-02-03", 0)}


@given(st.datetimes(datetime(1950, 1, 1), datetime(2026, 12, 31)), st.sampled_from(["%Y-%m-%d %H:%M:%S UTC", "%Y-%m-%dT%H:%M:%SZ", "%d %b %Y %H:%M:%S GMT", "%m/%d/%Y %H%M%S UTC", "%B %d, %Y %I:%M:%S %p GMT"]))
@settings(max_examples=60, deadline=None)
def test_round_trip(when, fmt):
    (r,) = timeparse.readings(when.strftime(fmt))
    assert timeparse.normals(r, None)[0][0] == when.strftime("%Y-%m-%dT%H:%M:%SZ")


READINGS = st.lists(st.lists(st.tuples(st.integers(0, 9), st.sampled_from([1, 2]), st.sampled_from([0.0, 1.5, 8.0])), min_size=1, max_size=3), min_size=1, max_size=7)


def cheapest(rows, switch=1.0, back=2.0):
    def cost(path):
        at = [r[i] for r, i in zip(rows, path)]
        return sum(c for _, _, c in at) + sum(switch * (f != g) + back * (u < t) for (t, f, _), (u, g, _) in zip(at, at[1:]))

    return cost, min(cost(p) for p in itertools.product(*[range(len(r)) for r in rows]))


@given(READINGS, st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_blocks_of_blocks_are_cheapest(rows, size):
    chain = Chain(1.0, 2.0)
    cost, least = cheapest(rows)
    levels = [[chain.row([t for t, _, _ in r], [f for _, f, _ in r], [c for _, _, c in r]) for r in rows]]
    while len(levels[-1]) > 1:
        levels.append([chain.compose(levels[-1][k : k + size + 1]) for k in range(0, len(levels[-1]), size + 1)])
    m = levels[-1][0][4]
    got, i, j = min((c, i, j) for i, line in enumerate(m) for j, c in enumerate(line))
    assert got == least
    ends = [(i, j)]
    for below in levels[-2::-1]:
        ends = [e for k, (i, j) in enumerate(ends) for e in chain.solve(below[k * (size + 1) : (k + 1) * (size + 1)], i, j)]
    assert cost([i for i, _ in ends]) == least and all(i == j for i, j in ends)


def test_chain_over_blocks(spark):
    """Null sources, rows without an order, repeated rows, and a source of many blocks get the cheapest chain."""
    rnd = random.Random(5)
    rows, chains = [], {}
    for s, n in (("s", 40), (None, 7), ("t", 1), ("calm", 30)):
        for k in range(n):
            c = [{"fmt": rnd.choice("ab"), "normal": f"{s}{k}{j}", "t": float(k + rnd.randrange(-3, 4)), "odd": rnd.choice([0, 0, 1])} for j in range(rnd.choice([1, 1, 2, 3]) if s != "calm" else 1)]
            chains.setdefault(s, []).append(c)
            rows += [(s, k * 7, c, "x")] * rnd.choice([1, 2])
    rows += [("u", None, chains["s"][0], "x"), ("v", 3, [], "x"), ("v", None, None, "x")]
    df = spark.createDataFrame(rows, "source string, ord bigint, readings array<struct<fmt:string,normal:string,t:double,odd:int>>, i string")
    for block in (3, 4096):
        got = choose_readings(df, "source", "ord", odd=1.5, block=block)
        assert got.columns == [*df.columns, "chosen"] and got.count() == len(rows)
        by = {(r["source"], r["ord"]): r["chosen"] for r in got.collect()}
        for s, chain in chains.items():
            cost, least = cheapest([[(c["t"], c["fmt"], 1.5 * c["odd"]) for c in cs] for cs in chain[:12]]) if len(chain) <= 12 else (None, None)
            picked = [by[s, k * 7]["normal"] for k in range(len(chain))]
            at = [next(i for i, c in enumerate(cs) if c["normal"] == n) for cs, n in zip(chain, picked)]
            if cost:
                assert cost(at) == least
            if block == 3:
                first = by
        assert by["u", None]["normal"] == chains["s"][0][0]["normal"] and by["v", 3] is None
    assert {k: v and v["normal"] for k, v in first.items()}.keys() == by.keys()
    assert choose_readings(df.limit(0), "source", "ord").count() == 0


def test_the_order_decides_where_conventions_do_not(spark):
    """Neighbours settle a dashed date, never a slashed one; of two instants the one that does not go back."""
    rows = [("s", k, v) for k, v in enumerate(["01-02-2003", "25-02-2003", "01-03-2003", "3/4/2003"])]
    df = spark.createDataFrame(rows, "source string, ord int, value string").withColumn("readings", interpret(F.col("value"), F.lit("UTC")))
    got = [r["chosen"]["normal"] for r in choose_readings(df, "source", "ord").orderBy("ord").collect()]
    assert got == ["2003-02-01", "2003-02-25", "2003-03-01", "2003-03-04"]
    rows = [("s", 1, "2021-11-07 06:10 UTC"), ("s", 2, "2021-11-07 01:30")]
    df = spark.createDataFrame(rows, "source string, ord int, value string").withColumn("readings", interpret(F.col("value"), F.lit("America/New_York")))
    last = choose_readings(df, "source", "ord").where("ord = 2").first()
    assert len(last["readings"]) == 2 and last["chosen"]["normal"] == "2021-11-07T06:30:00Z" and last["chosen"]["odd"] == 1


def test_record_times(spark):
    places = spark.createDataFrame(PLACES, "place_id int, name string, area string, tz string")
    agencies = spark.createDataFrame([("Desk", "desk", "Europe/London")], "agency string, code string, office_tz string")
    schema = "id string, agency string, incident_date string, release_date string, incident_location string, extra int"
    rows = [
        ("desk-1", "Desk", "2001-07-01 10:00", "2001-07-02 10:00", "3 mi N of Dreygaet, AZ", 1),
        ("desk-1", "Desk", "2001-07-01 10:00", "2001-07-02 10:00", "3 mi N of Dreygaet, AZ", 1),
        ("desk-2", None, "2001-07-01 10:00", "x" * 5000, "Twinham", 2),  # two zones: no one instant
        (None, "Desk", "2001-07-01", None, None, 3),
        ("desk-3", "Desk", None, "", "Dreygate", 4),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in record_times(df, places, agencies).collect()}
    assert got == {("desk-1", "incident_date", "2001-07-01T17:00:00Z"), ("desk-1", "release_date", "2001-07-02T09:00:00Z")}
    assert record_times(df.limit(0), places, agencies).count() == 0


@given(READINGS)
@settings(max_examples=150, deadline=None)
def test_margins(rows):
    """What another reading of a row would cost, against all ways through a short chain."""
    chain = Chain(1.0, 2.0)
    cost, least = cheapest(rows)
    es = [chain.row([t for t, _, _ in r], [f for _, f, _ in r], [c for _, _, c in r]) for r in rows]
    befores, afters = chain.around(es, [0.0] * len(rows[0]), [0.0] * len(rows[-1]))
    ways = list(itertools.product(*[range(len(r)) for r in rows]))
    for k, r in enumerate(rows):
        by = sorted(min(cost(p) for p in ways if p[k] == i) for i in range(len(r)))
        if len(by) > 1:
            assert by[0] == least and margin_of(befores[k], [c for _, _, c in r], afters[k]) == by[1] - by[0]


def test_dashed_dates_are_told_where_the_order_decides(spark):
    """Blocks of three rows and one block give the same margins; a value that nothing decides is not told."""
    places = spark.createDataFrame(PLACES, "place_id int, name string, area string, tz string")
    agencies = spark.createDataFrame([("Desk", "desk", "Europe/London")], "agency string, code string, office_tz string")
    dates = {"a-1": "01-02-2003", "a-2": "25-02-2003", "a-3": "01-03-2003", "b-1": "2003-05-06", "b-2": "04-05-2003", "b-3": "2003-05-06", "c-1": "01-02-2003", "d-1": "01-02-2003", "d-2": "01-02-2003", "e": "05-06-2003", "f-1": "2021-11-07 01:30"}
    df = spark.createDataFrame([(i, "Desk", v, None, "Twinham, Ohio") for i, v in dates.items()], "id string, agency string, incident_date string, release_date string, incident_location string")
    got = {r["id"]: r["normal"] for r in record_times(df, places, agencies).collect()}
    # b-2: 4 May or 5 April, either before both its neighbours or after none; c, d, e: either order; f: two instants
    assert got == {"a-1": "2003-02-01", "a-2": "2003-02-25", "a-3": "2003-03-01", "b-1": "2003-05-06", "b-3": "2003-05-06"}
    rows = [("s", k, v) for k, v in enumerate(["01-02-2003", "02-02-2003", "2003-02-02", "03-02-2003", "25-02-2003", "3/4/2003", "04-03-2003", "05-03-2003"])] + [("t", 1, "01-02-2003")]
    df = spark.createDataFrame(rows, "source string, ord int, value string").withColumn("readings", interpret(F.col("value"), F.lit("UTC")))
    small, large = ({(r["source"], r["ord"]): r["m"] for r in choose_readings(df, "source", "ord", block=n, margin="m").collect()} for n in (3, 4096))
    assert small == large and small["t", 1] == 0 and small["s", 3] > 0 and small["s", 5] is None and len(small) == len(rows)


def test_gazetteer():
    g = Gazetteer(PLACES)
    assert g.resolve("DREYGATE AZ")[0] == [1]
    assert g.resolve("Arizona: Dreygate")[0] == [1]
    assert g.resolve("nr Lake Fenarigde (Ill.)")[0] == [2]
    assert g.resolve("Twinham") == ([3, 4], None, None)
    assert g.resolve("Twinham, Ohio")[0] == [3]
    assert g.resolve("N/A")[0] == [] and g.resolve(None)[0] == []
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 2) == 3


def test_p2_on_tables(spark, sf):
    from archivolt.plans.problems import p2_found

    got = p2_found(spark, sf)
    assert got.count() == got.select("id", "field").distinct().count() > 100
    assert got.where(~F.col("normal").rlike(r"^\d{4}(-\d\d(-\d\d(T\d\d:\d\d:\d\dZ)?)?)?$")).count() == 0
