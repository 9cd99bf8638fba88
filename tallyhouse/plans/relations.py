"""Queries for joins, ranks, merges, chances, texts and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.functions.clean import fold, loose_date, postcode
from tallyhouse.operators import joins, merge, order, survival
from tallyhouse.plans.catalogue import Catalogue, table
from tallyhouse.plans.register import school_places

C = Catalogue()


# --- joins ------------------------------------------------------------------------------------------------------------


@C.query(
    "q_priority_coalesce",
    """SELECT o_orderkey, coalesce(a.v, b.v, c.v) AS label, CASE WHEN a.v IS NOT NULL THEN 'returned' WHEN b.v IS NOT NULL THEN 'accepted'
  WHEN c.v IS NOT NULL THEN 'new' END AS origin FROM orders
LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON b.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) c ON c.l_orderkey = o_orderkey""",
)
def q_priority_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of each order from the first of three sources that has one."""
    li = table(spark, sf_dir, "lineitem")
    one = lambda f: li.where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("label"))
    base = table(spark, sf_dir, "orders").select("o_orderkey")
    return joins.by_precedence(base, [("returned", one("R")), ("accepted", one("A")), ("new", one("N"))], ["o_orderkey"], "label")


@C.query(
    "q_full_outer_profile",
    """WITH e AS (SELECT user_id AS id, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1),
o AS (SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY 1), c AS (SELECT c_custkey AS id, c_mktsegment FROM customer)
SELECT id, c_mktsegment, events, orders, concat_ws(',', CASE WHEN c.id IS NOT NULL THEN 'customer' END, CASE WHEN e.id IS NOT NULL THEN 'events' END,
  CASE WHEN o.id IS NOT NULL THEN 'orders' END) AS known_in FROM c FULL JOIN e USING (id) FULL JOIN o USING (id)""",
)
def q_full_outer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All people of three tables with what each table knows."""
    src = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"),
        "events": table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("events")),
        "orders": table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders")),
    }
    return joins.full_profile(src, "id").withColumn("known_in", F.array_join("known_in", ","))


@C.query(
    "q_anti_join_audit",
    """SELECT 'customers without orders' AS gap, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'returns of no school', CAST(count(DISTINCT urn) AS BIGINT) FROM finance_history WHERE urn NOT IN (SELECT CAST(urn AS VARCHAR) FROM establishment WHERE urn IS NOT NULL)
UNION ALL SELECT 'documents of no school', CAST(count(*) AS BIGINT) FROM documents WHERE urn IS NOT NULL AND urn NOT IN (SELECT urn FROM establishment WHERE urn IS NOT NULL)""",
)
def q_anti_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that have no partner where they should."""
    urns = table(spark, sf_dir, "establishment").select("urn").where("urn is not null").distinct()
    parts = {
        "customers without orders": table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"),
        "returns of no school": table(spark, sf_dir, "finance_history").where("urn is not null").select(F.col("urn").try_cast("bigint").alias("urn")).distinct().join(urns, "urn", "left_anti"),
        "documents of no school": table(spark, sf_dir, "documents").where("urn is not null").select("urn").join(urns, "urn", "left_anti"),
    }
    out = None
    for name, d in parts.items():
        row = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("gap"), "n")
        out = row if out is None else out.unionByName(row)
    return out


_LINKS_SQL = "(SELECT DISTINCT unnest(former_urns) AS a, urn AS b FROM establishment_snapshot)"


@C.query(
    "q_transitive_links",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM {_LINKS_SQL} WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
r(start, reached, hops) AS (SELECT a, b, 1 FROM e UNION SELECT r.start, e.b, r.hops + 1 FROM r JOIN e ON r.reached = e.a WHERE r.hops < 3 AND e.b <> r.start)
SELECT start, reached, min(hops) AS hops FROM r GROUP BY start, reached""",
)
def q_transitive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors of every former school within three links."""
    links = table(spark, sf_dir, "establishment_snapshot").select(F.explode("former_urns").alias("a"), F.col("urn").alias("b"))
    return joins.chains(links, "a", "b", 3)


@C.query(
    "q_connected_components",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM {_LINKS_SQL} WHERE a IS NOT NULL AND b IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a)
SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def q_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of schools linked as predecessors and successors."""
    links = table(spark, sf_dir, "establishment_snapshot").select(F.explode("former_urns").alias("a"), F.col("urn").alias("b"))
    return joins.components(links.where("a is not null and b is not null"))


_EST_SQL = """est AS (SELECT urn, any_value(phase) AS phase, any_value(la_code) AS la_code, min(open_date) AS open_date, min(close_date) AS close_date,
  min(upper(regexp_replace(postcode, '[^A-Za-z0-9]', '', 'g'))) AS pc FROM establishment WHERE urn IS NOT NULL GROUP BY urn)"""


@C.query(
    "q_interval_join",
    f"""WITH {_EST_SQL}, h AS (SELECT a.urn, b.urn AS r FROM est a JOIN est b ON a.pc = b.pc AND a.phase = b.phase AND a.urn <> b.urn
  AND b.open_date - a.close_date BETWEEN 0 AND 400)
SELECT est.urn, CASE WHEN count(DISTINCT r) = 1 THEN min(r) END AS match FROM est LEFT JOIN h USING (urn) GROUP BY est.urn""",
)
def q_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one school that opened at a school's postcode within 400 days of its closing."""
    pc = F.regexp_replace(F.upper("postcode"), "[^A-Z0-9]", "")
    est = table(spark, sf_dir, "establishment").where("urn is not null").groupBy("urn").agg(
        F.min("phase").alias("phase"), F.min("open_date").alias("open_date"), F.min("close_date").alias("close_date"), F.min(pc).alias("pc")
    )
    return joins.interval_unique(est, est, ["pc", "phase"], "urn", "close_date", "open_date", 0, 400)


@C.query(
    "q_nearest_in_time",
    """WITH p AS (SELECT o_orderkey, event_id, abs(epoch_us(o_orderdate) - epoch_us(ts)) AS gap, ts FROM orders JOIN events ON o_custkey = user_id)
SELECT o_orderkey, CAST(event_id AS VARCHAR) AS near_id FROM p QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY gap, ts, CAST(event_id AS VARCHAR)) = 1""",
)
def q_nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of the same person nearest to each order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("near_id"))
    return joins.as_of(o, e, "k", "o_orderdate", "ts", "o_orderkey").where("near_id is not null").select("o_orderkey", "near_id")


_STOP = ["the", "a", "of", "and", "school", "primary", "academy", "st"]
_TOK = """list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(lower({n}), '[^a-z0-9]+', ' ', 'g'), ' '),
  lambda w: CASE WHEN len(w) >= 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, len(w) - 1) ELSE w END), lambda w: w <> '' AND w NOT IN ({s}))))"""
_TOK = _TOK.replace("{s}", ", ".join(f"'{w}'" for w in _STOP))


@C.query(
    "q_token_set_join",
    f"""WITH l AS (SELECT DISTINCT mention_id AS id, {_TOK.replace('{n}', 'printed_name')} AS t FROM admission_name),
l1 AS (SELECT id, max(t) AS lt FROM l GROUP BY id), r AS (SELECT urn AS rid, {_TOK.replace('{n}', 'min(name)')} AS rt FROM establishment GROUP BY urn),
p AS (SELECT id, rid, lt = rt AS eq FROM l1, r WHERE len(lt) > 0 AND len(rt) > 0 AND (list_has_all(lt, rt) OR list_has_all(rt, lt))),
g AS (SELECT id, count(DISTINCT CASE WHEN eq THEN rid END) AS ne, min(CASE WHEN eq THEN rid END) AS e, count(DISTINCT CASE WHEN NOT eq THEN rid END) AS ns,
  min(CASE WHEN NOT eq THEN rid END) AS s FROM p GROUP BY id)
SELECT id, CASE WHEN ne = 1 THEN e ELSE s END AS match, CASE WHEN ne = 1 THEN 'equal' ELSE 'subset' END AS how FROM g WHERE ne = 1 OR (ne = 0 AND ns = 1)""",
)
def q_token_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names whose words are those of exactly one school, or a subset either way."""
    l = table(spark, sf_dir, "admission_name").select(F.col("mention_id").alias("id"), joins.tokens(F.col("printed_name"), _STOP).alias("t"))  # noqa: E741
    l = l.groupBy("id").agg(F.max("t").alias("tokens")).where(F.size("tokens") > 0)  # noqa: E741
    r = table(spark, sf_dir, "establishment").groupBy(F.col("urn").alias("rid")).agg(F.min("name").alias("n"))
    r = r.select("rid", joins.tokens(F.col("n"), _STOP).alias("tokens")).where(F.size("tokens") > 0)
    return joins.token_set_match(l, r)


@C.query(
    "q_knn_similar",
    """WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal / 500 AS x, p / 20.0 AS y FROM supplier JOIN
  (SELECT l_suppkey, count(*) AS p FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)
SELECT a.s_suppkey, b.s_suppkey AS other, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.s_suppkey) AS place
FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey
QUALIFY row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.s_suppkey) <= 5""",
)
def q_knn_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five suppliers of the same nation nearest in balance and number of lines."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).cast("double").alias("lines"))
    s = table(spark, sf_dir, "supplier").join(n, "s_suppkey")
    near = joins.nearest_values(s, ["s_nationkey"], "s_suppkey", {"s_acctbal": 500.0, "lines": 20.0}, 5)
    return near.select("s_suppkey", "other", F.col("place").cast("long").alias("place"))


@C.query(
    "q_embedding_knn",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0)
SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS place
FROM q JOIN e ON q.vec_id <> e.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) <= 5""",
)
def q_embedding_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100, the five most similar of all vectors.

    The queries are a stated set; each row scores itself against them one by one and every task keeps five of each.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    e = e.withColumn("n", F.sqrt(dot(F.col("v"), F.col("v"))))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("n").alias("qn"))
    sim = F.round(dot(F.col("v"), F.col("qv")) / (F.col("n") * F.col("qn")), 9)
    pairs = e.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", sim.alias("sim"))
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "vec_id")
    return pairs.withColumn("place", F.row_number().over(w)).where("place <= 5").select("query_id", "vec_id", F.col("place").cast("long").alias("place"))


_PLACES_SQL = """est AS (SELECT urn, max(left(t, 2) || translate(substr(t, 3, len(t) - 5), 'OILZSB', '011258') || ' '
    || translate(substr(t, len(t) - 2, 1), 'OILZSB', '011258') || right(t, 2)) AS pc
  FROM (SELECT urn, regexp_replace(upper(postcode), '[^A-Z0-9]', '', 'g') AS t FROM establishment) WHERE len(t) BETWEEN 6 AND 7 GROUP BY urn),
pts AS (SELECT DISTINCT pcds AS pc, lat, lon FROM postcode_point WHERE lat BETWEEN 49 AND 61.5 AND lon BETWEEN -9 AND 2.5),
spot AS (SELECT urn, lat, lon FROM est JOIN pts USING (pc))"""
_HAV = """2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"""


@C.query(
    "q_radius_join",
    f"""WITH {_PLACES_SQL}, areas AS (SELECT lsoa, avg(lat) AS lat, avg(lon) AS lon FROM postcode_point WHERE lat BETWEEN 49 AND 61.5 AND lon BETWEEN -9 AND 2.5 GROUP BY lsoa)
SELECT a.urn, CAST(count(*) AS BIGINT) AS areas FROM spot a JOIN areas b ON abs(a.lat - b.lat) < 0.02 AND {_HAV} <= 2000 GROUP BY a.urn""",
)
def q_radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of small areas whose centre is within 2 km of each school."""
    pts = table(spark, sf_dir, "postcode_point").where(F.col("lat").between(49, 61.5) & F.col("lon").between(-9, 2.5))
    areas = pts.groupBy(F.col("lsoa").alias("rid")).agg(F.avg("lat").alias("rlat"), F.avg("lon").alias("rlon"))
    near = joins.within_metres(school_places(spark, sf_dir).withColumnRenamed("urn", "id"), areas, 2000.0)
    return near.groupBy(F.col("id").alias("urn")).agg(F.count(F.lit(1)).alias("areas"))


def _box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle and a square around the middle of every outward code's postcodes."""
    p = table(spark, sf_dir, "postcode_point").where(F.col("lat").between(49, 61.5) & F.col("lon").between(-9, 2.5))
    g = p.groupBy(F.split_part("pcds", F.lit(" "), F.lit(1)).alias("pid")).agg(F.round(F.avg("lon"), 4).alias("x"), F.round(F.avg("lat"), 4).alias("y"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return g.select("pid", "x", "y", F.array(at(-0.03, -0.02), at(0.03, -0.02), at(0.03, 0.02), at(0.0, 0.05), at(-0.03, 0.02), at(-0.03, -0.02)).alias("ring"))


@C.query(
    "q_point_in_polygon",
    f"""WITH {_PLACES_SQL}, g AS (SELECT split_part(pcds, ' ', 1) AS pid, round(avg(lon), 4) AS x, round(avg(lat), 4) AS y FROM postcode_point
  WHERE lat BETWEEN 49 AND 61.5 AND lon BETWEEN -9 AND 2.5 GROUP BY 1),
v AS (SELECT pid, i, x + dx AS x, y + dy AS y FROM g, (VALUES (0, -0.03, -0.02), (1, 0.03, -0.02), (2, 0.03, 0.02), (3, 0.0, 0.05), (4, -0.03, 0.02), (5, -0.03, -0.02)) t(i, dx, dy)),
e AS (SELECT p.pid, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM v p JOIN v q ON p.pid = q.pid AND q.i = p.i + 1),
h AS (SELECT urn, pid, count_if((py > lat) <> (qy > lat) AND lon < px + (lat - py) * (qx - px) / nullif(qy - py, 0)) AS n FROM spot, e GROUP BY ALL)
SELECT pid, CAST(count(*) AS BIGINT) AS schools FROM h WHERE n % 2 = 1 GROUP BY pid""",
)
def q_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools inside a five-cornered region around the middle of each outward code."""
    pts = school_places(spark, sf_dir).select(F.col("urn").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return joins.points_in_polygons(pts, _box(spark, sf_dir).select("pid", "ring"), 0.02).groupBy("pid").agg(F.count(F.lit(1)).alias("schools"))


@C.query(
    "q_ring_centroid",
    """WITH g AS (SELECT split_part(pcds, ' ', 1) AS pid, round(avg(lon), 4) AS x, round(avg(lat), 4) AS y FROM postcode_point
  WHERE lat BETWEEN 49 AND 61.5 AND lon BETWEEN -9 AND 2.5 GROUP BY 1)
SELECT pid, round(0.06 * 0.04 + 0.5 * 0.06 * 0.03, 6) AS area, round(x, 5) AS cx, round(y + (0.5 * 0.06 * 0.03) * (0.02 + 0.03 / 3) / (0.06 * 0.04 + 0.5 * 0.06 * 0.03), 5) AS cy FROM g""",
)
def q_ring_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and centre of those regions by the shoelace formula."""
    c = _box(spark, sf_dir).select("pid", joins.ring_centroid(F.col("ring")).alias("c"))
    return c.select("pid", F.round("c.area", 6).alias("area"), F.round("c.x", 5).alias("cx"), F.round("c.y", 5).alias("cy"))


@C.query(
    "q_grid_max_surface",
    f"""WITH {_PLACES_SQL}, k AS (SELECT urn, lat, lon, 1 + urn % 7 AS w FROM spot),
c AS (SELECT urn, w, CAST(floor(lat / 0.01) AS BIGINT) + dy AS cy, CAST(floor(lon / 0.01) AS BIGINT) + dx AS cx, greatest(abs(dx), abs(dy)) AS d
  FROM k, range(-2, 3) a(dy), range(-2, 3) b(dx))
SELECT cy, cx, max(round(w / (1.0 + d), 6)) AS top, CAST(count(*) AS BIGINT) AS sources FROM c GROUP BY ALL""",
)
def q_grid_max_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest source over every grid cell within two cells of a school."""
    k = school_places(spark, sf_dir).select((1 + F.col("urn") % 7).alias("w"), F.floor(F.col("lat") / 0.01).cast("long").alias("y"), F.floor(F.col("lon") / 0.01).cast("long").alias("x"))
    c = k.withColumn("dy", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("dx", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    c = c.select((F.col("y") + F.col("dy")).alias("cy"), (F.col("x") + F.col("dx")).alias("cx"), F.round(F.col("w") / (1.0 + F.greatest(F.abs("dx"), F.abs("dy"))), 6).alias("v"))
    return c.groupBy("cy", "cx").agg(F.max("v").alias("top"), F.count(F.lit(1)).alias("sources"))


@C.query(
    "q_structural_diff",
    """WITH d AS (SELECT record_id, source, json_object('a', row_no % 3, 'b', json_object('c', row_no % 5, 'd', source)) AS x,
  json_object('a', row_no % 2, 'b', json_object('c', row_no % 5, 'e', source)) AS y FROM (SELECT DISTINCT record_id, source, row_no FROM finance_return_raw))
SELECT record_id, 'a' AS path, x->>'a' AS old, y->>'a' AS new FROM d WHERE (x->>'a') <> (y->>'a')
UNION ALL SELECT record_id, 'b.d', x->'b'->>'d', NULL FROM d UNION ALL SELECT record_id, 'b.e', NULL, y->'b'->>'e' FROM d""",
)
def q_structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths at which two nested documents of a record differ."""
    d = table(spark, sf_dir, "finance_return_raw").select("record_id", "source", "row_no").distinct()
    doc = lambda m, k: F.to_json(F.struct((F.col("row_no") % m).alias("a"), F.struct((F.col("row_no") % 5).alias("c"), F.col("source").alias(k)).alias("b")))
    left, right = d.select("record_id", doc(3, "d").alias("doc")), d.select("record_id", doc(2, "e").alias("doc"))
    return joins.structural_diff(left, right, "record_id", "doc")


# --- ranks and merges --------------------------------------------------------------------------------------------------


@C.query("q_topk_per_group", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5")
def q_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five richest customers of each segment."""
    t = order.top_k(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)
    return t.select("c_mktsegment", "c_custkey", F.col("place").cast("long").alias("place"))


@C.query(
    "q_search_rank",
    """WITH s AS (SELECT urn, min(name) AS name FROM establishment GROUP BY urn), r AS (SELECT urn, name, CASE WHEN lower(name) LIKE 'st %' THEN 3
  WHEN len(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w LIKE 'st%')) > 0 THEN 2 WHEN lower(name) LIKE '%st%' THEN 1 END AS score FROM s)
SELECT urn, score FROM r WHERE score IS NOT NULL ORDER BY score DESC, len(name), urn LIMIT 8""",
)
def q_search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best hits for the search 'st '."""
    s = table(spark, sf_dir, "establishment").groupBy("urn").agg(F.min("name").alias("name"))
    n = F.lower("name")
    score = F.when(n.startswith("st "), 3).otherwise(order.search_score(F.col("name"), "st"))
    score = F.when(score == 3, F.when(n.startswith("st "), 3).otherwise(2)).otherwise(score)
    return s.withColumn("score", score).where("score is not null").orderBy(F.col("score").desc(), F.length("name"), "urn").limit(8).select("urn", "score")


@C.query("q_nulls_last_sort", "SELECT urn FROM (SELECT urn, min(town) AS town FROM establishment GROUP BY urn) ORDER BY town ASC NULLS LAST, urn LIMIT 50")
def q_nulls_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty schools by town, those without a town last."""
    s = table(spark, sf_dir, "establishment").groupBy("urn").agg(F.min("town").alias("town"))
    return s.orderBy(F.col("town").asc_nulls_last(), "urn").limit(50).select("urn")


@C.query(
    "q_nulls_last_places",
    """WITH s AS (SELECT urn, min(town) AS town FROM establishment GROUP BY urn)
SELECT urn, town, row_number() OVER (ORDER BY town ASC NULLS LAST, urn) - 1 AS place_up, row_number() OVER (ORDER BY town DESC NULLS LAST, urn) - 1 AS place_down FROM s""",
)
def q_nulls_last_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every school with its place in the order by town, upwards and downwards, those without a town last in both."""
    s = table(spark, sf_dir, "establishment").groupBy("urn").agg(F.min("town").alias("town"))
    up = order.with_rank(s, [F.col("town").asc_nulls_last(), F.col("urn")], "place_up")
    return order.with_rank(up, [F.col("town").desc_nulls_last(), F.col("urn")], "place_down").select("urn", "town", "place_up", "place_down")


@C.query(
    "q_round_robin",
    """WITH r AS (SELECT phase, urn, row_number() OVER (PARTITION BY phase ORDER BY urn) AS turn FROM (SELECT DISTINCT urn, phase FROM establishment))
SELECT turn, phase, urn FROM r ORDER BY turn, phase LIMIT 20""",
)
def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty schools, one of each phase in turn."""
    s = table(spark, sf_dir, "establishment").select("urn", "phase").distinct()
    return order.round_robin(s, "phase", F.col("phase"), [F.col("urn")], 20).select(F.col("turn").cast("long").alias("turn"), "phase", "urn")


@C.query("q_facet_filter", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#13') AND p_size IN (1, 5, 10, 20, 30)")
def q_facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of any of three brands and any of five sizes."""
    return merge.facet_filter(table(spark, sf_dir, "part"), {"p_brand": ["Brand#1", "Brand#2", "Brand#13"], "p_size": [1, 5, 10, 20, 30]}).select("p_partkey")


@C.query(
    "q_facet_counts",
    """SELECT 'p_brand' AS facet, p_brand AS value, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size""",
)
def q_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts each value of three facets has."""
    return merge.facet_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@C.query(
    "q_conflict_merge",
    """SELECT urn, min(phase) AS phase, min(town) AS town, min(gender) AS gender, CAST(count(*) AS BIGINT) AS merged,
  concat_ws(',', CASE WHEN count(DISTINCT phase) > 1 THEN 'phase' END, CASE WHEN count(DISTINCT town) > 1 THEN 'town' END, CASE WHEN count(DISTINCT gender) > 1 THEN 'gender' END) AS conflicts
FROM establishment GROUP BY urn""",
)
def q_conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one URN as one, with the fields in which they disagree."""
    m = merge.conflict_merge(table(spark, sf_dir, "establishment").select("urn", "phase", "town", "gender"), ["urn"], ["phase", "town", "gender"])
    return m.withColumn("conflicts", F.array_join("conflicts", ","))


@C.query(
    "q_union_entities",
    """SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS brand FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_brand FROM part""",
)
def q_union_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers and parts in one search table."""
    t = lambda n, *cols: table(spark, sf_dir, n).select(*[F.col(c).alias(a) for c, a in cols])
    return merge.union_entities({
        "customer": t("customer", ("c_custkey", "id"), ("c_name", "name"), ("c_acctbal", "balance")),
        "supplier": t("supplier", ("s_suppkey", "id"), ("s_name", "name"), ("s_acctbal", "balance")),
        "part": t("part", ("p_partkey", "id"), ("p_name", "name"), ("p_brand", "brand")),
    })


@C.query(
    "q_doc_exact_copies",
    """SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS copies FROM documents WHERE text IS NOT NULL""",
)
def q_doc_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same text: class and size of the class.  Only hashes of the texts are shuffled."""
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    g = t.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return t.join(g, "h").select("doc_id", "class_id", "copies")


# --- chances ----------------------------------------------------------------------------------------------------------

_CUTS_SQL = """c AS (SELECT event_type, value AS cutoff, power(0.75, 3 - CAST(extract(day FROM ts) AS INTEGER) % 4) AS w FROM events WHERE value IS NOT NULL)"""


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_type", F.col("value").alias("cutoff"), survival.decay_weight(3 - F.dayofmonth("ts") % 4).alias("w"))


@C.query(
    "q_weighted_survival",
    f"WITH {_CUTS_SQL} SELECT event_type, CAST(point AS DOUBLE) AS point, round(sum(CASE WHEN cutoff >= point THEN w ELSE 0 END) / sum(w), 6) AS chance FROM c, (VALUES (10.0), (50.0), (100.0)) p(point) GROUP BY ALL",
)
def q_weighted_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted chance that a cut-off of each type reaches three distances."""
    return survival.survival_at(_cuts(spark, sf_dir), ["event_type"], "cutoff", "w", [10.0, 50.0, 100.0]).withColumn("chance", F.round("chance", 6))


@C.query(
    "q_survival_inverse",
    f"""WITH {_CUTS_SQL}, g AS (SELECT event_type, cutoff, sum(w) AS w FROM c GROUP BY ALL),
s AS (SELECT event_type, cutoff, sum(w) OVER (PARTITION BY event_type ORDER BY cutoff DESC) / sum(w) OVER (PARTITION BY event_type) AS chance FROM g)
SELECT event_type, round(max(cutoff), 6) AS distance FROM s WHERE chance >= 0.75 - 1e-9 GROUP BY event_type""",
)
def q_survival_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance that is reached with a chance of 75 %."""
    c = survival.survival_curve(_cuts(spark, sf_dir), ["event_type"], "cutoff", "w")
    return survival.distance_for(c, ["event_type"], "cutoff", 0.75).withColumn("distance", F.round("distance", 6))


@C.query(
    "q_running_product",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 5 AS chance FROM lineitem),
p AS (SELECT *, coalesce(exp(sum(CASE WHEN chance < 1 THEN ln(1 - chance) END) OVER w), 1) AS lft FROM c
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, chance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_orderkey, round(sum(chance * lft) + 1e-9, 6) AS any_choice, round(max(chance * lft) + 1e-9, 6) AS best FROM p GROUP BY l_orderkey""",
)
def q_running_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked choices: the chance of getting any of them, and of the likeliest."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 5).alias("chance"))
    r = survival.ranked_choices(c, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "chance"], "chance")
    return r.groupBy("l_orderkey").agg(F.round(F.sum("obtained") + 1e-9, 6).alias("any_choice"), F.round(F.max("obtained") + 1e-9, 6).alias("best"))


@C.query(
    "q_poisson_tail",
    """WITH RECURSIVE m AS (SELECT p_size AS k, p_partkey % 10 + 0.5 AS mean FROM part GROUP BY ALL),
t(k, mean, i, term, total) AS (SELECT k, CAST(mean AS DOUBLE), 0, CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM m UNION ALL
  SELECT k, mean, i + 1, term * mean / (i + 1), total + term * mean / (i + 1) FROM t WHERE i + 1 <= k - 1)
SELECT k, mean, round(1 - exp(-mean) * max(total), 6) AS tail FROM t GROUP BY k, mean""",
)
def q_poisson_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(X >= k) for the sizes and means in part."""
    m = table(spark, sf_dir, "part").select(F.col("p_size").alias("k"), (F.col("p_partkey") % 10 + F.lit(0.5)).cast("double").alias("mean")).distinct()
    return m.withColumn("tail", F.round(survival.poisson_tail(F.col("mean"), F.col("k")), 6))


# --- texts ------------------------------------------------------------------------------------------------------------


@C.query(
    "q_parse_values",
    """WITH c AS (SELECT record_id, payload->>'$."Total Income"' AS raw FROM finance_return_raw WHERE json_valid(payload)),
d AS (SELECT DISTINCT record_id, raw FROM c WHERE raw IS NOT NULL)
SELECT record_id, CASE WHEN upper(trim(raw)) NOT IN ({codes}) THEN try_cast(regexp_replace(trim(raw), '[£$%,\\s]', '', 'g') AS DOUBLE) END AS value,
  CASE WHEN upper(trim(raw)) IN ({codes}) THEN upper(trim(raw)) WHEN trim(raw) <> '' AND try_cast(regexp_replace(trim(raw), '[£$%,\\s]', '', 'g') AS DOUBLE) IS NULL THEN '?' END AS code
FROM d""".replace("{codes}", ", ".join(f"'{c}'" for c in text.CODES)),
)
def q_parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of total income as figure and code."""
    j = F.get_json_object("payload", "$['Total Income']")
    valid = F.try_parse_json("payload").isNotNull()
    d = table(spark, sf_dir, "finance_return_raw").where(valid).select("record_id", j.alias("raw")).where("raw is not null").distinct()
    v = d.withColumn("v", text.parse_value(F.col("raw")))
    return v.select("record_id", "v.value", "v.code")


@C.query(
    "q_loose_dates",
    """SELECT close_date AS raw, CAST(CASE WHEN trim(close_date) = '' THEN NULL WHEN regexp_full_match(close_date, '\\d{5}') THEN DATE '1899-12-30' + CAST(close_date AS INTEGER)
  ELSE CAST(coalesce(try_strptime(close_date, '%d-%m-%Y'), try_strptime(close_date, '%d/%m/%Y'), try_strptime(close_date, '%Y-%m-%d'), try_strptime(close_date, '%d %B %Y')) AS DATE) END AS VARCHAR) AS day,
  CAST(count(*) AS BIGINT) AS n FROM establishment_snapshot WHERE close_date IS NOT NULL GROUP BY close_date""",
)
def q_loose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way a close date is written, with the day it means."""
    d = table(spark, sf_dir, "establishment_snapshot").where("close_date is not null").groupBy(F.col("close_date").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("day", loose_date(F.col("raw")).cast("string"))


@C.query(
    "q_postcode_domain",
    """WITH p AS (SELECT DISTINCT charity_number, charity_contact_web AS w, charity_contact_email AS m FROM pta),
h AS (SELECT charity_number, regexp_replace(regexp_extract(regexp_replace(lower(trim(w)), '^[a-z]+://', ''), '^([a-z0-9.-]+)', 1), '^www\\.', '') AS host FROM p WHERE w IS NOT NULL),
l AS (SELECT charity_number, host, string_split(host, '.') AS s FROM h WHERE host LIKE '%.%')
SELECT charity_number, array_to_string(s[-(CASE WHEN len(s) >= 3 AND s[-2] IN ('co', 'org', 'ac', 'sch', 'gov') THEN 3 ELSE 2 END):], '.') AS domain FROM l""",
)
def q_postcode_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registrable domain of each charity's web address."""
    p = table(spark, sf_dir, "pta").where("charity_contact_web is not null").select("charity_number", "charity_contact_web", "charity_contact_email").distinct()
    return p.select("charity_number", text.registrable_host(F.col("charity_contact_web")).alias("domain")).where("domain is not null")


@C.query(
    "q_slugs",
    """SELECT urn, regexp_replace(left(regexp_replace(regexp_replace(replace(translate(lower(name), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 20), '-+$', '') AS slug
FROM (SELECT urn, min(name) AS name FROM establishment GROUP BY urn)""",
)
def q_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path names of schools, at most twenty characters."""
    return table(spark, sf_dir, "establishment").groupBy("urn").agg(F.min("name").alias("name")).select("urn", text.slug(F.col("name"), 20).alias("slug"))


@C.query(
    "q_authority_keys",
    """WITH k AS (SELECT la_code, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '&', ' and ', 'g'), '\\b(london borough of|royal borough of|city of|county of|county council|county|borough council|borough|council|unitary authority|city)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM local_authority)
SELECT k.la_code, key, CAST(count(DISTINCT e.urn) AS BIGINT) AS schools FROM k LEFT JOIN establishment e ON e.la_code = k.la_code GROUP BY k.la_code, key""",
)
def q_authority_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities by the key of their name, with their schools."""
    k = table(spark, sf_dir, "local_authority").select("la_code", text.authority_key(F.col("name")).alias("key"))
    e = table(spark, sf_dir, "establishment").groupBy("la_code").agg(F.count_distinct("urn").alias("schools"))
    return k.join(e, "la_code", "left").fillna(0, ["schools"])


@C.query(
    "q_year_of_period",
    """SELECT source, period_end, CASE WHEN CAST(substr(period_end, 6, 2) AS INTEGER) >= CASE source WHEN 'CFR' THEN 4 ELSE 9 END THEN CAST(left(period_end, 4) AS INTEGER)
  ELSE CAST(left(period_end, 4) AS INTEGER) - 1 END AS start_year, CAST(count(*) AS BIGINT) AS n FROM finance_history WHERE period_end IS NOT NULL GROUP BY ALL""",
)
def q_year_of_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The financial or school year that each period end lies in."""
    f = table(spark, sf_dir, "finance_history").where("period_end is not null")
    start = text.label_of_month(F.col("period_end"), F.when(F.col("source") == "CFR", 4).otherwise(9))
    return f.groupBy("source", "period_end", start.alias("start_year")).agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "q_postcodes",
    f"WITH {_PLACES_SQL} SELECT split_part(pc, ' ', 1) AS outward, CAST(count(*) AS BIGINT) AS schools FROM est GROUP BY 1",
)
def q_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools by the first half of their postcode, however typed."""
    p = table(spark, sf_dir, "establishment").select("urn", postcode(F.col("postcode")).alias("pc")).where("pc is not null").groupBy("urn").agg(F.max("pc").alias("pc"))
    return p.groupBy(F.split_part("pc", F.lit(" "), F.lit(1)).alias("outward")).agg(F.count(F.lit(1)).alias("schools"))


@C.query(
    "q_status_folded",
    """SELECT trim(regexp_replace(lower(status), '\\s+', ' ', 'g')) AS status, CAST(count(*) AS BIGINT) AS n FROM establishment_snapshot GROUP BY 1""",
)
def q_status_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of all extracts without regard to case and spaces."""
    return table(spark, sf_dir, "establishment_snapshot").groupBy(fold(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "q_session_streaks",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS events, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS length_us FROM s GROUP BY user_id, session""",
)
def q_session_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events not more than thirty minutes apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("us", us)
    e = e.withColumn("fresh", F.when(F.col("us") - F.lag("us").over(w) <= 30 * 60 * 1_000_000, 0).otherwise(1))
    e = e.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), (F.max("us") - F.min("us")).alias("length_us"))
