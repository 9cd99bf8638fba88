import math
import random

import pytest

from tallyhouse.operators.near import near_members


def metres(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))


def check(spark, pts, r, **kw):
    got = {(x.id_a, x.id_b) for x in near_members(spark.createDataFrame(pts, "id long, lat double, lon double"), r, **kw).collect()}
    want = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(pts) for b in pts[:i] if a[0] != b[0] and metres(a, b) <= r}
    assert got == want
    return got


@pytest.mark.parametrize(("lat", "lon", "spread"), [(51, -1, 0.05), (0, 180, 0.05), (89.99, 0, 180), (-89.95, 10, 180), (60, -179.99, 0.1)])
def test_against_brute_force(spark, lat, lon, spread):
    rnd = random.Random(int(lat))
    pts = []
    for i in range(250):
        y = float(min(90, max(-90, lat + rnd.uniform(-0.05, 0.05))))
        x = lon + rnd.uniform(-spread, spread)
        pts.append((i, y, (x + 180) % 360 - 180))
    pts += [(1000 + i, pts[0][1], pts[0][2]) for i in range(5)]
    assert check(spark, pts, 900.0)
    check(spark, pts, 900.0, strips=1.0, segments=1.0)


def test_edges(spark):
    s = "id long, lat double, lon double"
    assert near_members(spark.createDataFrame([], s), 400.0).collect() == []
    rows = [(1, None, 0.0), (2, 99.9, 0.0), (3, float("nan"), 0.0), (4, 1.0, 1.0), (4, 1.0, 1.0), (5, 1.0, 1.0), (None, 1.0, 1.0)]
    assert [tuple(r) for r in near_members(spark.createDataFrame(rows, s), 400.0).collect()] == [(4, 5)]


def test_hot_positions_in_blocks(spark):
    rows = [(i, 51.5, -0.1) for i in range(40)] + [(100 + i, 51.5001, -0.1) for i in range(15)] + [(200, 52.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    want = {(a, b) for a, *_ in rows[:-1] for b, *_ in rows[:-1] if a < b}
    for one in (False, True):
        got = [(r.id_a, r.id_b) for r in near_members(df, 100.0, block=4, one_place=one).collect()]
        assert len(got) == len(set(got)) and set(got) == want
