import json
import random

from pyspark.sql import functions as F

from tallyhouse.operators import drift
from tallyhouse.plans import register


def changes(spark, books):
    rows = [(f, e, i, json.dumps(r) if isinstance(r, dict) else r) for (f, e), rs in books.items() for i, r in enumerate(rs)]
    raw = spark.createDataFrame(rows, "family string, edition string, entity string, payload string")
    by = {"family": F.col("family"), "edition": F.col("edition")}
    return {tuple(r)[:5] for r in drift.schema_changes(drift.cells(raw, "payload", by, entity="urn")).collect()}


def book(n, seed, **columns):
    rnd = random.Random(seed)
    return [{"URN": i, **{k.replace("_", " "): f(rnd, i) for k, f in columns.items()}} for i in range(n)]


def test_changes(spark):
    money, name = lambda r, i: int(r.lognormvariate(12, 0.6)), lambda r, i: f"School {i}"
    small, text = lambda r, i: r.randint(1, 12), lambda r, i: f"£{int(r.lognormvariate(12, 0.6)):,}"
    old = book(80, 1, School_Name=name, Total_spend=money, months=small, E05_pay=money, fees=money)
    new = book(80, 2, Academy_Title=name, total__SPENDING=money, months=small, E06_heat=money, fees=text)
    got = changes(spark, {("A", "2020"): old, ("A", "2021"): new})
    assert got == {
        ("A", "2021", "renamed", "school name", "academy title"), ("A", "2021", "renamed", "total spend", "total spending"),
        ("A", "2021", "removed", "e05 pay", ""), ("A", "2021", "added", "", "e06 heat"), ("A", "2021", "retyped", "fees", "fees"),
    }


def test_edges(spark):
    same = [{"URN": 1, "a": 5}, {"URN": 2, "a": "x"}, '{"URN": 3, "a"', None, "[1]", {"URN": 4, "a": None}]
    assert changes(spark, {("A", "1"): same, ("A", "2"): same}) == set()
    assert changes(spark, {("A", "1"): same}) == set()
    assert changes(spark, {}) == set()


def test_chain_of_names():
    cols = [("A", "1", "x"), ("A", "2", "y"), ("A", "3", "z"), ("A", "1", "k")]
    got = drift.canonical_names(cols, [("A", "2", "x", "y"), ("A", "3", "y", "z")])
    assert got == {("A", "1", "x"): "z", ("A", "2", "y"): "z", ("A", "3", "z"): "z", ("A", "1", "k"): "k"}


def test_united(spark):
    rows = [("A", "1", 1, '{"URN": 1, "Total spend": 5, "name": "Mill"}'), ("A", "1", 2, '{"URN": 2, "Total spend": "c"}'), ("A", "2", 3, '{"URN": 3, "All spending": "£7", "extra": 1}')]
    raw = spark.createDataFrame(rows, "family string, edition string, id int, payload string")
    cells = drift.cells(raw, "payload", {"family": F.col("family"), "edition": F.col("edition"), "id": F.col("id")})
    moved = spark.createDataFrame([("A", "2", "renamed", "total spend", "all spending")], "family string, edition string, change_kind string, old_field string, new_field string")
    got = {r.id: (r.lines, r.texts) for r in drift.united(cells, moved, ["id"]).collect()}
    assert got == {1: ({"urn": 1.0, "all spending": 5.0}, {"name": "Mill"}), 2: ({"urn": 2.0}, {}), 3: ({"urn": 3.0, "all spending": 7.0, "extra": 1.0}, {})}


def test_united_keeps_texts_of_a_column_that_becomes_a_number(spark):
    rows = [("A", "1", 1, '{"laestab": "262/1024"}'), ("A", "1", 2, '{"laestab": "7"}'), ("A", "2", 3, '{"laestab": 2621024}'), ("A", "2", 4, '{"laestab": 5}'), ("A", "2", 8, '{"laestab": 6}'),
            ("A", "2", 5, '{"laestab": "see note"}'), ("A", "2", 6, '{"laestab": true}'), ("A", "2", 7, '{"laestab": "x", "k": 1}')]
    raw = spark.createDataFrame(rows, "family string, edition string, id int, payload string")
    cells = drift.cells(raw, "payload", {"family": F.col("family"), "edition": F.col("edition"), "id": F.col("id")})
    moved = spark.createDataFrame([], "family string, edition string, change_kind string, old_field string, new_field string")
    got = {r.id: (r.lines, r.texts) for r in drift.united(cells, moved, ["id"]).collect()}
    assert got == {
        1: ({}, {"laestab": "262/1024"}), 2: ({"laestab": 7.0}, {}), 3: ({"laestab": 2621024.0}, {}), 4: ({"laestab": 5.0}, {}), 8: ({"laestab": 6.0}, {}),
        5: ({}, {"laestab": "see note"}), 6: ({}, {"laestab": "true"}), 7: ({"k": 1.0}, {}),
    }


def test_returns_keep_records_with_a_payload_that_is_cut_off(spark, tmp_path):
    rows = [
        (1, "CFR_2018-19.xlsx", "CFR", "2020-01-01", '{"URN": 1, "pay": 5}'), (1, "CFR_2018-19.xlsx", "CFR", "2020-02-01", '{"URN": 1, "pay"'),
        (2, "CFR_2018-19.xlsx", "cfr ", "2020-01-01", '{"URN": 2, "pa'), (3, "CFR_2018-19.xlsx", "CFR", "2020-01-01", '{"URN": 3, "pay": 6}'),
        (3, "CFR_2018-19.xlsx", "CFR", "2020-02-01", '{"URN": 3, "pay": 7}'), (4, "CFR_2018-19.xlsx", "CFR", "2020-01-01", '{"pay": "supp"}'),
        (5, "CFR_2018-19.xlsx", "CFR", "2020-01-01", None), (6, "CFR.xlsx", "CFR", "2020-01-01", '{"pay": 8}'),
    ]
    raw = spark.createDataFrame(rows, "record_id long, file_name string, source string, read_at string, payload string")
    raw.withColumn("read_at", F.to_timestamp("read_at")).write.parquet(str(tmp_path / "finance_return_raw.parquet"))
    got = {r.record_id: (r.source, r.book_year, r.lines, r.texts, getattr(r, "rejected", None)) for r in register.p6_returns(spark, str(tmp_path)).collect()}
    at = ("CFR", "2018-19")
    assert got == {
        1: (*at, {"urn": 1.0, "pay": 5.0}, {}, None), 2: (*at, {}, {}, "payload"), 3: (*at, {"urn": 3.0, "pay": 7.0}, {}, None), 4: (*at, {}, {}, None),
        5: (*at, {}, {}, "payload"), 6: ("CFR", None, {}, {}, "file"),
    }


def test_cells(spark):
    rows = [
        (1, '{"Urn ": 7, " A  b": "£1,200", "c": "SUPP", "d": true, "e": null, "n": {"X": {"y": 2.5}, "z": "t"}, "l": [1, {"k": "v"}], "C": 4}'),
        (2, '{"urn": "8", "A": "12f"}'), (3, '{"a": 1'), (4, None), (5, "[1]"), (6, '{"a": NaN}'), (7, "{}"), (8, '{"a": "' + "x" * 100_000 + '"}'),
    ]
    raw = spark.createDataFrame(rows, "id int, payload string")
    got = {(r.id, r.header): (r.entity, r.parent, r.kind, r.text, r.num) for r in drift.cells(raw, "payload", {"id": F.col("id")}, entity="urn", every=True).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1 and k[1]} == {
        (1, "urn"): ("7", "", "number", "7", 7.0), (1, "a b"): ("7", "", "text", "£1,200", 1200.0), (1, "c"): ("7", "", "number", "4", 4.0),
        (1, "d"): ("7", "", "boolean", "true", None), (1, "n.x.y"): ("7", "n.x", "number", "2.5", 2.5), (1, "n.z"): ("7", "n", "text", "t", None),
        (1, "l"): ("7", "", "array", '[1,{"k":"v"}]', None),
    }
    assert got[2, "a"] == ("8", "", "text", "12f", None)
    assert {k[0]: v[2] for k, v in got.items() if k[1] is None} == {1: "object", 2: "object", 3: None, 4: None, 5: None, 6: None, 7: "object", 8: "object"}
    assert len(got[8, "a"][3]) == 100_000


def test_nested_columns(spark):
    rnd = random.Random(3)
    spent = [int(rnd.lognormvariate(12, 0.6)) for _ in range(80)]
    old = [{"URN ": i, "costs": {"Teachers": x, "heat": x // 7 + 3}, "tags": [1, 2]} for i, x in enumerate(spent)]
    new = [{"urn": i, "spending": {"teachers": x + 5}, "Heat": x // 7 + 4, "tags": "1, 2"} for i, x in enumerate(spent)]
    assert changes(spark, {("A", "1"): old, ("A", "2"): new}) == {
        ("A", "2", "renamed", "costs.teachers", "spending.teachers"), ("A", "2", "renamed", "costs.heat", "heat"), ("A", "2", "retyped", "tags", "tags"),
    }


def test_names_of_two_chains_stay_apart():
    cols = [("A", "1", "x"), ("A", "1", "y"), ("A", "2", "z"), ("A", "3", "x")]
    got = drift.canonical_names(cols, [("A", "2", "y", "z"), ("A", "3", "z", "x")])
    assert got == {("A", "1", "x"): "x", ("A", "1", "y"): "x (from y)", ("A", "2", "z"): "x", ("A", "3", "x"): "x"} or len({got["A", "1", "x"], got["A", "1", "y"]}) == 2
