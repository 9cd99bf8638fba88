import os
from decimal import Decimal

import pytest

import __spark_entry__ as E
from tallyhouse.plans import all_catalogues

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_names():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert {"p1_found", "p4_found", "p6_found", "q_health_status"} <= set(q)


def test_entry(spark):
    assert E.entry(spark).count() > 0


CORE = sorted(name for c in all_catalogues() for name in c.sql)


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    df = E.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else tuple(v) if isinstance(v, list) else v
    clean = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=str)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert clean(df.select(*cols).collect()) == clean(want)


def test_nulls_last_in_both_directions(spark):
    rows = E.queries()["q_nulls_last_places"](spark, SMALL).collect()
    schools = spark.read.parquet(f"{SMALL}/establishment.parquet").where("urn is not null").groupBy("urn").agg({"town": "min"}).collect()
    towns = {urn: town for urn, town in schools}
    assert None in towns.values()
    empty = sorted(u for u, t in towns.items() if t is None)
    known = sorted((t, u) for u, t in towns.items() if t is not None)
    assert [r.urn for r in sorted(rows, key=lambda r: r.place_up)] == [u for _, u in known] + empty
    down = sorted(known, key=lambda x: x[0], reverse=True)  # stable: equal towns stay in the order of urn
    assert [r.urn for r in sorted(rows, key=lambda r: r.place_down)] == [u for _, u in down] + empty
    assert {r.place_up for r in rows} == {r.place_down for r in rows} == set(range(len(towns)))
