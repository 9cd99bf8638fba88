"""Queries of sources, sinks and document layouts, over files that each query writes from the test tables itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import joins
from tallyhouse.plans.catalogue import Catalogue, table
from tallyhouse.session import shared_dir
from tallyhouse.sources import layouts, sinks, workbooks

C = Catalogue()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallyhouse-{uuid.uuid4().hex}/{name}"


def _lines(parts: list[DataFrame], path: str) -> None:
    """One text file of lines (at, line) in order."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole.repartition(1).sortWithinPartitions("at").select("line").write.text(path)


def _fixed(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(i - 1000, x) for i, x in enumerate(lines)], "at long, line string")


@C.query("q_csv_files", "SELECT c_custkey AS custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0")
def q_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers from two delimited files with preambles, other orders of columns, quotes, blank and overlong rows."""
    c = table(spark, sf_dir, "customer").withColumn("at", F.col("c_custkey"))
    even, odd = c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1")
    quote = lambda n: F.concat(F.lit('"'), n, F.lit('"'))
    too_long = F.when(F.col("c_custkey") % 7 == 0, ",1,2,3").otherwise("")
    folder = _folder(spark, "csv")
    _lines([_fixed(spark, ["A list of customers", "", " custkey ,NAME,Segment"]), even.select("at", F.concat(F.col("c_custkey"), F.lit(","), quote(F.col("c_name")), F.lit(","), "c_mktsegment", too_long).alias("line"))], f"{folder}/a")
    _lines([_fixed(spark, ["Name,x,CUSTKEY", ",,"]), odd.select("at", F.concat(F.col("c_name"), F.lit(",,"), F.col("c_custkey"), too_long).alias("line"))], f"{folder}/b")
    rows, _ = workbooks.csv_files(spark, [f"{folder}/a/*.txt", f"{folder}/b/*.txt"], "custkey", ["custkey", "name", "segment"])
    return rows.select(F.col("custkey").cast("long").alias("custkey"), "name", "segment")


@C.query(
    "q_csv_rejects",
    """SELECT reason, CAST(count(*) AS BIGINT) AS rows FROM (SELECT 'more cells than headers' AS reason FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'no column segment' UNION ALL SELECT 'no header with custkey') GROUP BY reason""",
)
def q_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be read of such files, with the reason."""
    c = table(spark, sf_dir, "customer").withColumn("at", F.col("c_custkey"))
    folder = _folder(spark, "csv")
    cells = F.concat(F.col("c_custkey"), F.lit(","), "c_name", F.when(F.col("c_custkey") % 7 == 0, ",1,2,3").otherwise(""))
    _lines([_fixed(spark, ["CUSTKEY,NAME"]), c.select("at", cells.alias("line"))], f"{folder}/a")
    _lines([_fixed(spark, ["nothing here"])], f"{folder}/b")
    _, rejects = workbooks.csv_files(spark, [f"{folder}/a/*.txt", f"{folder}/b/*.txt"], "custkey", ["custkey", "name", "segment"])
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@C.query("q_json_lines", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, round(max(o_totalprice), 2) AS most FROM orders GROUP BY o_custkey")
def q_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON lines and read by a schema, grouped by customer."""
    path = _folder(spark, "orders")
    table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").write.json(path)
    rows = workbooks.json_lines(spark, path, "o_custkey long, o_totalprice double")
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.max("o_totalprice"), 2).alias("most"))


@C.query("q_json_array", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def q_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations from files that hold one array each, of a region, element by element."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    doc = F.to_json(F.struct("n_nationkey", F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")))
    path = _folder(spark, "arrays")
    n.groupBy("r_name").agg(F.concat(F.lit("["), F.array_join(F.collect_list(doc), ", "), F.lit("]")).alias("value")).write.partitionBy("r_name").text(path)
    rows, _ = workbooks.json_array(spark, f"{path}/*/*.txt")
    one = F.from_json("doc", "n_nationkey int, name string, region struct<name: string>").alias("d")
    return rows.select(one).select("d.n_nationkey", F.col("d.name").alias("n_name"), F.col("d.region.name").alias("r_name"))


@C.query("q_json_by_key", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def q_json_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations from one file a region, of either of two shapes."""
    n = table(spark, sf_dir, "nation")
    rows = F.to_json(F.collect_list(F.struct("n_nationkey", "n_name")))
    doc = F.when(F.col("n_regionkey") % 2 == 0, F.col("rows")).otherwise(F.concat(F.lit('{"rows": '), F.col("rows"), F.lit("}")))
    root = _folder(spark, "regions")
    n.groupBy("n_regionkey").agg(rows.alias("rows")).select("n_regionkey", doc.alias("value")).write.partitionBy("n_regionkey").text(root)
    return workbooks.json_by_key(spark, root, "n_regionkey", "n_nationkey int, n_name string", "rows")


@C.query("q_geojson_features", "SELECT CAST(n_nationkey AS VARCHAR) AS code, CAST(n_nationkey + 0.5 AS DOUBLE) AS x, CAST(51 + n_regionkey AS DOUBLE) AS y FROM nation")
def q_geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a GeoJSON file with their middle."""
    at = lambda dx, dy: F.array(F.col("n_nationkey") + F.lit(float(dx)), F.col("n_regionkey") + F.lit(50.0 + dy))
    ring = F.array(at(0, 0), at(1, 0), at(1, 2), at(0, 2), at(0, 0))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    one = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_nationkey").cast("string").alias("code")).alias("properties"), shape.alias("geometry"))
    path = _folder(spark, "map")
    whole = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(one).alias("features"))).alias("value"))
    whole.write.text(path)
    f = workbooks.with_centroid(workbooks.features(spark, f"{path}/*.txt", ["code"]))
    return f.select("code", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@C.query("q_documents_sink", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def q_documents_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written twice, the second build replacing the first, and read back."""
    path = _folder(spark, "site")
    n = table(spark, sf_dir, "nation")
    sinks.write_documents(n.where("n_nationkey < 3"), path, "n_regionkey")
    sinks.write_documents(n, path, "n_regionkey")
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path).select("n_regionkey", "n_nationkey", "n_name")


@C.query("q_unique_paths", "SELECT n_nationkey, CASE WHEN count(*) OVER (PARTITION BY left(n_name, 1)) > 1 THEN left(n_name, 1) || '-' || left(sha1(CAST(n_nationkey AS VARCHAR)), 6) ELSE left(n_name, 1) END AS path FROM nation")
def q_unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from first letters, told apart where several rows share one."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.left("n_name", F.lit(1)).alias("slug"))
    return sinks.unique_paths(n, "slug", "n_nationkey").select("n_nationkey", "path")


@C.query("q_shrunk_documents", """SELECT p_partkey, CASE WHEN len(p_name) + len(p_type) > 40 THEN 'p_type' ELSE '' END AS dropped FROM part""")
def q_shrunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leave out a field where they would be too long."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    ready = sinks.shrink_to_budget(p, ["p_name", "p_type"], ["p_type"], 40 + len('{"p_name":"","p_type":""}'))
    return ready.select("p_partkey", F.array_join("dropped", ",").alias("dropped"))


@C.query("q_html_year_columns", """SELECT s_suppkey % 5 AS doc, s_name AS name, 2020 + y AS year, round((s_suppkey % 50 + y) / 10.0, 3) AS value FROM supplier, range(2) t(y)""")
def q_html_year_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from HTML tables with a column a year."""
    s = table(spark, sf_dir, "supplier").withColumn("doc", F.col("s_suppkey") % 5)
    cell = lambda y: F.concat(F.lit("<td> "), ((F.col("s_suppkey") % 50 + y) / 10).cast("string"), F.lit(" miles</td>"))
    row = F.concat(F.lit("<tr><td><b>"), "s_name", F.lit("</b></td>"), cell(0), cell(1), F.lit("</tr>"))
    head = "<table class=x><tr><th>School</th><th>Year 2020</th><th>2021</th></tr>"
    pages = s.groupBy("doc").agg(F.concat(F.lit("<html><p>Tables</p>" + head), F.array_join(F.collect_list(row), ""), F.lit("</table></html>")).alias("html"))
    return layouts.html_year_columns(pages).select("doc", "name", F.col("year").cast("long").alias("year"), "value")


@C.query("q_text_lines", """SELECT s_suppkey AS doc, s_name AS name, round((100 + s_suppkey % 900) / 1609.344, 3) AS value FROM supplier""")
def q_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances in metres at the end of lines of text."""
    s = table(spark, sf_dir, "supplier")
    lines = s.select(F.col("s_suppkey").alias("doc"), F.lit(1).alias("line_no"), F.concat("s_name", F.lit(" ..... "), (100 + F.col("s_suppkey") % 900).cast("string"), F.lit(" metres")).alias("line"))
    return layouts.lines_by_pattern(lines, r"^(.*?) \.+ (\d+ metres)$", 2024).select("doc", "name", "value")


@C.query("q_positioned_words", """SELECT s_suppkey AS doc, s_name AS name, CAST(2023 AS INTEGER) AS year, round((s_suppkey % 40) / 8.0, 3) AS value FROM supplier""")
def q_positioned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from words with positions on a page: a name column and one of a year."""
    s = table(spark, sf_dir, "supplier").withColumn("w", F.split("s_name", "(?=#)"))
    box = lambda t, x0, x1: F.struct(t.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))
    words = F.array(box(F.col("s_name"), 10, 90), box(((F.col("s_suppkey") % 40) / 8).cast("string"), 200, 220))
    placed = s.select(F.col("s_suppkey").alias("doc"), F.lit(1).alias("page"), F.explode(words).alias("e"), F.lit(100.0).alias("top"))
    placed = placed.select("doc", "page", "e.text", "e.x0", "e.x1", (F.col("top") + F.col("e.x0") / 100).alias("top"), (F.col("top") + 10).alias("bottom"))
    return layouts.words_in_columns(placed, {"name": 50.0, "y2023": 210.0}, "name", {"y2023": 2023}).select("doc", "name", "year", "value")


@C.query("q_two_hops", """WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey % 100 = s_suppkey % 100 WHERE c_nationkey <> s_nationkey GROUP BY ALL),
s AS (SELECT a, b, 1 AS h FROM e UNION SELECT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b)
SELECT a AS start, b AS reached, CAST(min(h) AS INTEGER) AS hops FROM s GROUP BY ALL""")  # fmt: skip
def q_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations linked by customers and suppliers, over two links at most."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 100).alias("k")).distinct()
    s = table(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 100).alias("k")).distinct()
    return joins.chains(c.join(s, "k").select("c_nationkey", "s_nationkey"), "c_nationkey", "s_nationkey", 2)
