import duckdb
import pytest

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["record_id", "sighting_id"]


def test_catalogue_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert all(callable(f) for f in q.values())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sf, name):
    c = duckdb.connect()
    import os

    for n in os.listdir(sf):
        c.execute(f"create view {n[:-8]} as select * from '{sf}/{n}'")
    df = entry.queries()[name](spark, sf)
    r = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: None if v is None else round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    a = sorted(str([plain(row[n]) for n in sorted(names)]) for row in df.collect())
    b = sorted(str([plain(row[names.index(n)]) for n in sorted(names)]) for row in r.fetchall())
    assert a == b
