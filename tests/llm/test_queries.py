import os
from decimal import Decimal

import pytest

from tallyhouse.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.C.sql))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    df = queries.C.queries[name](spark, SMALL)
    cols = sorted(df.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else v
    clean = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=str)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.C.sql[name]})").fetchall()
    assert clean(df.select(*cols).collect()) == clean(want)
