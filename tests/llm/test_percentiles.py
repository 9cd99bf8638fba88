import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import percentiles as P

SCHEMA = "g string, part int, value double, n int, share string"


def exact(xs, share):
    xs = sorted(xs)
    return xs[max(1, math.ceil(Fraction(str(share)) * len(xs))) - 1]


def sample():
    rnd = random.Random(3)
    rows = []
    for g, n in (("one", 1), ("ties", 300), ("wide", 700), ("two", 2)):
        for i in range(n):
            v = {"ties": rnd.choice([-1.0, 0.0, 0.0, 5.0]), "wide": rnd.lognormvariate(3, 4) * rnd.choice([-1, 1])}.get(g, float(i))
            rows.append((g, i % 3, v, 7, "x"))
    return rows + [("wide", 0, None, 1, None), ("wide", 0, float("nan"), 1, None), (None, 0, 1.0, 1, None), ("empty", 0, None, 1, None)]


@pytest.mark.parametrize("block", [4, 50, 4096])
def test_exact(spark, block):
    rows, shares = sample(), [0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.g, r["share"]): (r.n, r["value"]) for r in P.multi_select(df.select("g", "value"), ["g"], shares, block_values=block).collect()}
    by = {}
    for g, _, v, *_ in rows:
        if g and v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert got == {(g, s): (len(xs), exact(xs, s)) for g, xs in by.items() for s in shares}


def test_share_by_column_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, value double")
    got = P.multi_select(df, ["g"], {"a": [0.5], "b": [0.9]}, of="g").collect()
    assert sorted(tuple(r) for r in got) == [("a", 0.5, 2, 1.0), ("b", 0.9, 1, 3.0)]
    assert P.multi_select(df.limit(0), ["g"], [0.5]).collect() == []


def test_summaries_merge_within_error(spark):
    df = spark.createDataFrame(sample(), SCHEMA).select("g", "part", "value")
    kept = P.summaries(df, ["g"], "part", 0.1)
    assert kept.groupBy("g", "part").count().agg(F.max("count")).first()[0] <= 11
    by = {}
    for g, _, v, *_ in sample():
        if g and v is not None and v == v:
            by.setdefault(g, []).append(v)
    for r in P.merged(kept, ["g"], [0.1, 0.5, 0.9]).collect():
        xs = sorted(by[r.g])
        low, high = sum(x < r["value"] for x in xs) + 1, sum(x <= r["value"] for x in xs)
        want = max(1, math.ceil(Fraction(str(r["share"])) * len(xs)))
        assert r.n == len(xs)
        assert low - 0.1 * len(xs) - 1 <= want <= high + 0.1 * len(xs) + 1
