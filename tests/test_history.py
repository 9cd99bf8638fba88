import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.history import attribute_history

SCHEMA = "id long, at date, status string, loaded timestamp, loaded_at string, _key int"


def brute(rows):
    best = {}
    for i, at, s, loaded in rows:
        if i is None or at is None:
            continue
        k = (i, at)
        if k not in best or (loaded or dt.datetime.min) > (best[k][1] or dt.datetime.min):
            best[k] = (s, loaded)
    out = []
    for i, group in itertools.groupby(sorted(best), key=lambda k: k[0]):
        runs = []
        for _, at in group:
            s = best[i, at][0]
            if not runs or runs[-1][1] != s:
                runs.append((at, s))
        for (at, s), nxt in zip(runs, [*runs[1:], (None, None)]):
            out.append((i, at, nxt[0], s))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = attribute_history(df, key="id", snapshot="at", loaded="loaded", state={"status": F.col("status")}, keep_state=True, **kw)
    return sorted(((r["id"], r["valid_from"], r["valid_to"], r["status"]) for r in got.collect()), key=str)


@pytest.mark.parametrize("leaf", [1, 8, 512])
def test_against_brute_force(spark, leaf):
    rnd = random.Random(leaf)
    months = [dt.date(2024, m, 1) for m in range(1, 10)]
    rows = []
    for i in range(60):
        s = "open"
        for m in months:
            if rnd.random() < 0.15:
                continue
            if rnd.random() < 0.2:
                s = rnd.choice(["open", "closed", None])
            for _ in range(1 + (rnd.random() < 0.1)):
                rows.append((i, m, s if rnd.random() < 0.95 else "late", dt.datetime(2024, 12, 1) + dt.timedelta(seconds=len(rows))))
    assert run(spark, rows, rows_per_leaf=leaf, bits=2) == brute(rows)


def test_edges(spark):
    d, t = dt.date, dt.datetime(2024, 5, 1)
    assert run(spark, []) == []
    rows = [(None, d(2024, 1, 1), "a", t), (1, None, "a", t), (1, d(2024, 1, 1), None, t), (1, d(2024, 1, 1), None, t), (1, d(2024, 2, 1), None, None)]
    assert run(spark, rows) == [(1, d(2024, 1, 1), None, None)]
    swapped = [(1, d(2024, 1, 1), "a", t), (1, d(2024, 1, 1), "b", t + dt.timedelta(1)), (1, d(2024, 2, 1), "b", t), (1, d(2024, 2, 1), "a", t + dt.timedelta(1))]
    assert run(spark, swapped) == [(1, d(2024, 1, 1), d(2024, 2, 1), "b"), (1, d(2024, 2, 1), None, "a")]


def test_opens_only_what_differs(spark):
    months = [dt.date(2024, m, 1) for m in range(1, 5)]
    loaded = dt.datetime(2024, 12, 1)
    same = [(i, m, "open", loaded) for i in range(2000) for m in months]
    one = [(i, m, "closed" if i == 7 and m == months[2] else s, t) for i, m, s, t in same]
    counts = {}
    for name, rows in (("same", same), ("one", one)):
        seen = counts[name] = []
        assert run(spark, rows, rows_per_leaf=8, bits=3, compared=seen) == brute(rows)
    depth = len(counts["same"])
    assert depth == 4
    # The first snapshot has nothing before it and is opened whole; the others end at the root.
    first = counts["same"]
    assert first[0] == 4 * 8
    assert all(n <= 8 ** (i + 1) for i, n in enumerate(first) if i)
    # One key that changes and changes back: two snapshots, one branch of eight nodes a level.
    assert [b - a for a, b in zip(first, counts["one"])][0] == 0
    assert all(0 < b - a <= 2 * 8 for a, b in zip(first[1:], counts["one"][1:]))
