import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import joins, rules, spatial, timelines


def metres(a, b):
    la, lb = math.radians(a[2]), math.radians(b[2])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_greedy_is_the_sequential_rule(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.randrange(10**6), 51 + rnd.uniform(0, 0.03), -1 + rnd.uniform(0, 0.03)) for i in range(150)]
    taken = []
    for p in sorted(pts, key=lambda p: p[1]):
        if all(metres(p, t) > 500 for t in taken):
            taken.append(p)
    df = spark.createDataFrame(pts, "point long, rank long, lat double, lon double")
    assert {r.point for r in spatial.greedy_distinct(df, 500.0).collect()} == {t[0] for t in taken}
    assert spatial.greedy_distinct(df.limit(0), 500.0).collect() == []


def test_significance_keeps_the_tolerance():
    rnd = random.Random(2)
    xs, ys = np.arange(60.0), np.array([rnd.uniform(-3, 3) for _ in range(60)])
    s = spatial.significance(xs, ys)
    for tol in (0.5, 1.5, 4.0):
        keep = np.flatnonzero(s >= tol)
        for i, j in zip(keep, keep[1:]):
            t = (xs[i : j + 1] - xs[i]) / (xs[j] - xs[i])
            px, py = xs[i] + t * (xs[j] - xs[i]), ys[i] + t * (ys[j] - ys[i])
            assert np.hypot(px - xs[i : j + 1], py - ys[i : j + 1]).max() < tol * 2.5
    assert spatial.significance(np.array([]), np.array([])).size == 0


def test_simplified_and_destination(spark):
    ring = [(0.0, 0.0), (1.0, 0.001), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1, ring), (2, None), (3, [])], "id int, ring array<struct<x: double, y: double>>")
    got = {r.id: r.ring and len(r.ring) for r in spatial.simplified(df, "ring", 0.1).collect()}
    assert got == {1: 5, 2: None, 3: []}
    d = spark.range(1).select(spatial.destination(F.lit(51.0), F.lit(179.999), F.lit(1000.0), F.lit(90.0)).alias("d")).first().d
    assert abs(metres((0, 0, 51.0, 179.999), (0, 0, d.lat, d.lon)) - 1000) < 0.01
    assert -180 <= d.lon < -179


def test_rules(spark):
    df = spark.createDataFrame([("Primary", 5.0, True), ("High", None, None), (None, 200.0, False)], "phase string, pupils double, ok boolean")
    count = lambda t: df.where(rules.predicate(t, df.columns)).count()
    assert [count(t) for t in ("phase == 'Primary'", "pupils > 100 or ok", "not ok and pupils >= 5", "phase in ('High', 'x') and not ok", "not (phase == 'High' or ok)")] == [1, 2, 1, 1, 0]
    for bad in ("phase = 'x'", "other > 1", "pupils >", "(ok", "ok; drop", "ok ok"):
        with pytest.raises(ValueError, match="."):
            rules.predicate(bad, df.columns)
    assert df.where(rules.at_least([F.col("ok"), F.col("pupils") > 1], 2)).count() == 1


def test_timelines(spark):
    df = spark.createDataFrame([("a", 1, 10.0, None), ("a", 2, None, 50.0), ("a", 3, -5.0, None)], "k string, y int, b double, o double").withColumn("s", F.lit(1.0))
    assert [r.reserve for r in timelines.projected(df, ["k"], "y", "b", "o", "s").orderBy("y").collect()] == [11.0, 50.0, 45.0]
    w = timelines.step_windows(df, ["k"], "y", F.lit(2)).orderBy("y").collect()
    assert [(r.until, r.current) for r in w] == [(2, False), (3, True), (None, False)]
    span = timelines.trusted_span(df, ["k"], "y", "b", F.col("y") == 1).first()
    assert (span.first_year, span.last_year, span.change) == (3, 3, 0.0)


def test_points_in_polygons_with_holes(spark):
    square = lambda x, y, r: [(x + dx * r, y + dy * r) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    shapes = [("holed", [square(0.0, 0.0, 3.0), square(0.0, 0.0, 1.0)]), ("parts", [square(0.0, 0.0, 0.5), square(8.0, 8.0, 1.0)]), ("none", None)]
    polygons = spark.createDataFrame(shapes, "pid string, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 0.1, 0.2), (2, 2.1, 0.3), (3, 8.2, 7.9), (4, 5.0, 5.0), (5, 0.7, 0.6)], "id int, x double, y double")
    got = {tuple(r) for r in joins.points_in_polygons(points, polygons, 0.8).collect()}
    assert got == {(1, "parts"), (2, "holed"), (3, "parts")}


def test_within_metres_across_date_line_and_pole(spark):
    import random

    from tallyhouse.operators.near import EARTH_M

    rnd = random.Random(8)
    def spots(n, lat, spread, base):  # noqa: ANN001, ANN202, E306
        return [(base + i, max(-90.0, min(90.0, lat + rnd.uniform(-0.03, 0.03))), ((180 + rnd.uniform(-spread, spread)) + 180) % 360 - 180) for i in range(n)]
    for lat, spread in ((10, 0.03), (-70, 0.1), (89.98, 180), (-89.5, 180)):
        a, b = spots(60, lat, spread, 0), spots(60, lat, spread, 1000)
        got = joins.within_metres(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "rid long, rlat double, rlon double"), 2000.0)
        def far(p, q):  # noqa: ANN001, ANN202, E306
            x, y = math.radians(p[1]), math.radians(q[1])
            h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
            return 2 * EARTH_M * math.asin(math.sqrt(min(1, h)))
        want = {(p[0], q[0]) for p in a for q in b if far(p, q) <= 2000}
        assert want
        rows = [(r.id, r.rid) for r in got.collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == want


def test_structural_diff_to_any_depth(spark):
    doc = lambda x: [(1, x)]
    frame = lambda x: spark.createDataFrame(doc(x), "k int, doc string")
    old, new = '{"a": {"b": {"c": {"d": 1, "e": [1, {"f": true}]}}}, "g": null, "h": {}}', '{"a": {"b": {"c": {"d": 2, "e": [1, {"f": false}]}}}, "h": []}'
    assert {tuple(r)[1:] for r in joins.structural_diff(frame(old), frame(new), "k", "doc").collect()} == {("a.b.c.d", "1", "2"), ("a.b.c.e.#1.f", "true", "false"), ("h", "{}", "[]")}
    assert joins.structural_diff(frame(None), frame("{"), "k", "doc").collect() == []


def test_components_that_do_not_settle_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in joins.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        joins.components(chain, rounds=1)


def gap_of(a, b):
    """Distance of two closed rings, one edge and corner at a time."""
    def off(p, q, x):  # noqa: ANN001, ANN202, E306
        dx, dy = q[0] - p[0], q[1] - p[1]
        n = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((x[0] - p[0]) * dx + (x[1] - p[1]) * dy) / n)) if n else 0.0
        return math.hypot(x[0] - p[0] - t * dx, x[1] - p[1] - t * dy)
    def turn(p, q, x):  # noqa: ANN001, ANN202, E306
        return (q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0])
    def holds(r, x):  # noqa: ANN001, ANN202, E306
        return sum((p[1] > x[1]) != (q[1] > x[1]) and x[0] < p[0] + (x[1] - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in zip(r, r[1:])) % 2 == 1
    ea, eb = list(zip(a, a[1:])), list(zip(b, b[1:]))
    if holds(a, b[0]) or holds(b, a[0]) or any(turn(*e, f[0]) * turn(*e, f[1]) < 0 and turn(*f, e[0]) * turn(*f, e[1]) < 0 for e in ea for f in eb):
        return 0.0
    return min([off(*e, x) for e in ea for x in b] + [off(*e, x) for e in eb for x in a])


def test_near_polygons_and_points_against_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    rings = []
    for _ in range(45):
        x, y, n = rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.choice([3, 4, 7])
        r = [(x + rnd.uniform(1, 9) * math.cos(k * 2 * math.pi / n), y + rnd.uniform(1, 9) * math.sin(k * 2 * math.pi / n)) for k in range(n)]
        rings.append([*r, r[0]])
    polygons = [(i, r) for i, r in enumerate([*rings, *rings[:20], rings[0], [(70.0, 70.0)]])] + [(900, None), (901, [])]
    points = [(i, rnd.uniform(-5, 65), rnd.uniform(-5, 65)) for i in range(60)]
    points += [(100 + i, x, y) for i, x, y in points[:10]] + [(200, None, 1.0)]
    df = spark.createDataFrame(polygons, "pid long, ring array<struct<x: double, y: double>>")
    known = [p for p in polygons if p[1]]
    want = {(p, q): g for p, a in known for q, b in known if p < q and (g := gap_of(a, b) if len(a) + len(b) > 2 else 99) <= 4}
    got = [(r.a, r.b, r.gap) for r in spatial.near_polygons(df, 4.0, 7.0).collect()]
    assert len(got) == len(want) > 60
    assert all(abs(want[a, b] - g) < 1e-9 for a, b, g in got)
    near = [tuple(r) for r in spatial.within_of_polygon(spark.createDataFrame(points, "id long, x double, y double"), df, 4.0, 7.0).collect()]
    inside = lambda x, y, r: 0.0 if gap_of([(x, y)], r) == 0 else gap_of([(x, y)], r)
    want = {(i, p): g for i, x, y in points if x is not None for p, r in known if len(r) > 1 and (g := inside(x, y, r)) <= 4}
    assert len(near) == len(want) > 60
    assert all(abs(want[i, p] - g) < 1e-9 for i, p, g in near)
    a, b = (np.array([rings[i]]) for i in (0, 1))
    whole = spatial._gaps(a[..., 0], a[..., 1], b[..., 0], b[..., 1])
    monkeypatch.setattr(spatial, "_HELD", 1)  # an edge at a time
    assert spatial._gaps(a[..., 0], a[..., 1], b[..., 0], b[..., 1]) == whole


def test_rings_that_many_polygons_have_are_compared_once(spark):
    square = lambda x, y, r: [(x, y), (x + r, y), (x + r, y + r), (x, y + r), (x, y)]
    rows = [(i, square(40.0 * (i % 3), 0.0, 20.0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "pid long, ring array<struct<x: double, y: double>>")
    began = time.time()
    got = spatial.near_polygons(df, 20.0, 100.0).groupBy("gap").count().collect()
    assert {r.gap: r["count"] for r in got} == {0.0: 3 * 500 * 499 // 2, 20.0: 2 * 500 * 500}
    spots = spark.range(900).select("id", (F.col("id") % 3 * 40.0 - 10).alias("x"), F.lit(10.0).alias("y"))
    near = spatial.within_of_polygon(spots, df, 10.0, 100.0).groupBy("gap").count().collect()
    assert {r.gap: r["count"] for r in near} == {10.0: 5 * 300 * 500}
    assert time.time() - began < 60  # 1.6 million pairs compared one by one take minutes
