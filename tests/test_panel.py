import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.functions.clean import loose_date, postcode, squash
from tallyhouse.operators import area, joins, merge, order, panel, survival


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


YEARS = "urn string, year int, reserve double, income double, balance double"


def standing(spark, rows):
    df = spark.createDataFrame(rows, YEARS)
    s = panel.status_by_year(df, ["urn"], "year", reserve="reserve", income="income", balance="balance")
    return {(r.urn, r.year): r for r in s.collect()}


def test_standing_boundaries(spark):
    m = 3_000_000.0
    rows = [("a", 1, 90_000.0, m, 1.0), ("b", 1, 89_999.0, m, 1.0), ("c", 1, 240_000.0, m, 1.0), ("d", 1, 239_999.0, m, 1.0), ("e", 1, -1.0, m, 1.0),
            ("f", 1, 300_000.0, m, -100_000.0), ("f", 2, 300_000.0, m, -100_000.0), ("g", 1, 300_003.0, m, -100_000.0), ("h", 1, 300_000.0, m, None)]
    got = {k: r.status for k, r in standing(spark, rows).items()}
    assert got == {
        ("a", 1): "healthy", ("b", 1): "tight", ("c", 1): "large_reserves", ("d", 1): "healthy", ("e", 1): "in_deficit",
        ("f", 1): "heading_for_deficit", ("f", 2): "heading_for_deficit", ("g", 1): "large_reserves", ("h", 1): "large_reserves",
    }
    assert standing(spark, rows)["f", 2].streak == 2
    assert standing(spark, []) == {}


def test_runs_and_changes(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in ((1, 9.0), (2, 8.0), (3, 7.0), (4, 6.0), (6, 5.0), (7, None))], "k string, y int, v double")
    run = panel.trailing_run(df, ["k"], "y", F.col("v") < 9)
    assert [r.streak for r in run.orderBy("y").collect()] == [0, 1, 2, 3, 4, 0]
    assert [r.y for r in panel.falling_run(df, ["k"], "y", "v").where("falling").collect()] == [4]
    assert [r.change for r in panel.adjacent_change(df, ["k"], "y", "v").orderBy("y").collect()] == [None, -1.0, -1.0, -1.0, None, None]
    assert [r.carried for r in panel.carried(df, ["k"], "y", "v", 4, 8).orderBy("y").collect()] == [6.0, 6.0, 5.0, 5.0, None]
    assert [(r.v_known, r.v_year) for r in joins.with_earlier(df, ["k"], "y", "v").orderBy("y").collect()][-1] == (5.0, 6)


def test_keep_last_and_merge(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (2, None, None)], "k int, t int, v string")
    assert {r.k: r.v for r in panel.keep_last(df, ["k"], [F.col("t"), F.col("v")]).collect()} == {1: "b", 2: None}
    got = {r.k: (r.v, r.conflicts) for r in merge.conflict_merge(df, ["k"], ["v"]).collect()}
    assert got == {1: ("a", ["v"]), 2: (None, [])}


def test_exclusive_quartiles(spark):
    df = spark.createDataFrame([("a", float(2**i)) for i in range(7)] + [("b", 1.0), ("c", None)], "k string, v double")
    got = {r.k: (r.q1, r.q2, r.q3) for r in area.exclusive_quartiles(df, ["k"], "v").collect()}
    assert got == {"a": (2.0, 8.0, 32.0), "b": (None, None, None)}
    xs = F.array(*[F.lit(float(2**i)) for i in range(7)])
    assert one(spark, *[area.exclusive_quantile(xs, k) for k in (1, 2, 3)]) == (2.0, 8.0, 32.0)


def test_order(spark):
    df = spark.createDataFrame([(i, i * 7 % 101) for i in range(101)], "i int, v int")
    assert all(r["rank"] == r.v for r in order.with_rank(df, [F.col("v")]).collect())
    pages = spark.createDataFrame([("a", 1, 50), ("a", 2, 60), ("a", 3, 90), ("a", 4, 500), ("a", 5, 1), ("b", 1, None)], "k string, i int, w int")
    got = [(r.k, r.i, r.page) for r in order.greedy_pages(pages, ["k"], "i", "w", 110, 150).orderBy("k", "i").collect()]
    assert got == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 2), ("a", 5, 3), ("b", 1, 0)]


def test_survival_by_hand(spark):
    df = spark.createDataFrame([("s", 0.3, 0.5625), ("s", 0.6, 0.75), ("s", 0.5, 1.0), ("t", float("inf"), 1.0), ("t", 1.0, 1.0)], "k string, c double, w double")
    got = {(r.k, r.point): round(r.chance, 6) for r in survival.survival_at(df, ["k"], "c", "w", [0.4, 0.55, 2.0]).collect()}
    assert got == {("s", 0.4): 0.756757, ("s", 0.55): 0.324324, ("s", 2.0): 0.0, ("t", 0.4): 1.0, ("t", 0.55): 1.0, ("t", 2.0): 0.5}
    curve = survival.survival_curve(df, ["k"], "c", "w")
    assert {r.k: r.distance for r in survival.distance_for(curve, ["k"], "c", 0.7).collect()} == {"s": 0.5, "t": 1.0}
    assert one(spark, F.round(survival.poisson_tail(F.lit(2.0), F.lit(3)), 6), survival.poisson_tail(F.lit(2.0), F.lit(0))) == (0.323324, 1.0)
    c = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 1.0), ("a", 3, 0.5)], "k string, i int, c double")
    assert [r.obtained for r in survival.ranked_choices(c, ["k"], ["i"], "c").orderBy("i").collect()] == [0.5, 0.5, 0.0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 1)]
    got = {r.node: r.component for r in joins.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert joins.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_nearest_values_against_brute_force(spark):
    rows = [(b, i, float(i * i % 37), float(i % 5)) for b in ("x", "y") for i in range(30)] + [("z", 99, 1.0, 1.0), ("x", 500, None, 1.0)]
    got = joins.nearest_values(spark.createDataFrame(rows, "b string, i int, u double, v double"), ["b"], "i", {"u": 1.0, "v": 1.0}, 3).collect()
    want = set()
    for b, i, u, v in rows:
        near = sorted((abs(u - u2) + abs(v - v2), j) for b2, j, u2, v2 in rows if b2 == b and j != i and None not in (u, u2))[:3] if u is not None else []
        want |= {(b, i, j, p + 1) for p, (_, j) in enumerate(near)}
    assert {(r.b, r.i, r.other, r.place) for r in got} == want


def test_text(spark):
    p = lambda x: tuple(one(spark, text.parse_value(F.lit(x)))[0])
    assert p("£1,234.5") == (1234.5, None)
    assert p(" supp ") == (None, "SUPP")
    assert p("odd") == (None, "?")
    assert p("") == p(None) == (None, None)
    assert one(spark, *[text.human_number(F.lit(x)) for x in ("(1,234)", "−2k", "1.5m", "x")]) == (-1234.0, -2000.0, 1_500_000.0, None)
    assert one(spark, text.slug(F.lit("Café & Bar — St. John's"), 15), text.shorten(F.lit("one two three"), 9)) == ("cafe-and-bar-st", "one two…")
    assert one(spark, text.registrable_host(F.lit("https://www.a.b.sch.uk/x")), text.registrable_host(F.lit("m@x.example"))) == ("b.sch.uk", "x.example")
    assert one(spark, text.year_label(F.lit(2018)), text.year_label(F.lit(1999))) == ("2018-19", "1999-00")
    dates = [one(spark, loose_date(F.lit(x)))[0] for x in ("01-02-2015", "1/2/2015", "2015-02-01", "1 February 2015", "1 feb 2015", "42036", " ", None, "32-13-2015")]
    assert dates == [dt.date(2015, 2, 1)] * 6 + [None] * 3
    codes = [one(spark, postcode(F.lit(x)))[0] for x in ("jd4-5yq", "JKI 8RL", "QX4I 6NS", "GC3 ONG", "n/a", "", None, "W1A1AA", "M1 1AE")]
    assert codes == ["JD4 5YQ", "JK1 8RL", "QX41 6NS", "GC3 0NG", None, None, None, "W1A 1AA", "M1 1AE"]
    assert one(spark, squash(F.lit("  a  b\t"))) == ("a b",)


@pytest.mark.parametrize("rows", [[], [(1, "a"), (2, None)]])
def test_facets_and_unions(spark, rows):
    df = spark.createDataFrame(rows, "id int, f string")
    assert sum(r.n for r in merge.facet_counts(df, ["f"]).collect()) == len([r for r in rows if r[1]])
    assert merge.union_entities({"x": df, "y": df.drop("f")}).count() == 2 * len(rows)
