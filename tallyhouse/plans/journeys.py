"""Queries for timelines, rules and geometry with an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.operators import rules, spatial, timelines
from tallyhouse.plans.catalogue import Catalogue, table
from tallyhouse.plans.panels import RETURNS_SQL, full_years, returns
from tallyhouse.plans.register import school_places
from tallyhouse.plans.relations import _HAV, _PLACES_SQL

C = Catalogue()


# --- timelines --------------------------------------------------------------------------------------------------------

_EVENTS_SQL = """ev AS (
  SELECT urn, 'o' || strftime(open_date, '%Y%m%d') AS number, 'opened' AS kind, open_date AS date, phase AS outcome, 0 AS b FROM e WHERE open_date IS NOT NULL
  UNION ALL SELECT urn, 'c' || strftime(close_date, '%Y%m%d'), 'closed', close_date, close_reason, 1 FROM e WHERE close_date IS NOT NULL),
one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY urn, number ORDER BY b, date DESC NULLS LAST, outcome NULLS FIRST) = 1)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "establishment").where("urn is not null").select(
        "urn", "phase", "close_reason", "open_date", "close_date",
        F.concat(F.lit("o"), F.date_format("open_date", "yyyyMMdd")).alias("on"), F.concat(F.lit("c"), F.date_format("close_date", "yyyyMMdd")).alias("cn"),
    )
    blocks = [{"number": "on", "kind": "opened", "date": "open_date", "outcome": "phase"}, {"number": "cn", "kind": "closed", "date": "close_date", "outcome": "close_reason"}]
    return timelines.events_from_wide([(0, e, blocks)], "urn")


@C.query("q_events_from_wide", f"WITH e AS (SELECT * FROM establishment WHERE urn IS NOT NULL), {_EVENTS_SQL} SELECT urn, number, kind, CAST(date AS VARCHAR) AS date, outcome FROM one")
def q_events_from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings and closings of schools as events, each once."""
    return _events(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@C.query(
    "q_latest_previous",
    f"""WITH e AS (SELECT * FROM establishment WHERE urn IS NOT NULL), {_EVENTS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY date DESC, number) AS i FROM one)
SELECT urn, max(CASE WHEN i = 1 THEN kind END) AS latest, max(CASE WHEN i = 2 THEN kind END) AS previous, CAST(count(*) AS BIGINT) AS events FROM r GROUP BY urn""",
)
def q_latest_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each school and the one before."""
    lp = timelines.latest_and_previous(_events(spark, sf_dir), "urn", [F.col("date").desc(), F.col("number")])
    return lp.select("urn", F.col("latest.kind").alias("latest"), F.col("previous.kind").alias("previous"), "events")


@C.query(
    "q_count_since",
    """WITH m AS (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, CASE WHEN max(m) IS NOT NULL THEN CAST(count_if(event_type <> 'purchase' AND ts > m) AS BIGINT) END AS since FROM events LEFT JOIN m USING (user_id) GROUP BY user_id""",
)
def q_count_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user since the last purchase."""
    e = table(spark, sf_dir, "events")
    return timelines.count_since(e, "user_id", "ts", F.col("event_type") == "purchase", F.col("event_type") != "purchase")


@C.query(
    "q_projection",
    "WITH "
    + RETURNS_SQL
    + """, s AS (SELECT urn, start_year, coalesce(in_year_balance, 0) AS b, CASE WHEN start_year % 4 = 0 THEN revenue_reserve END AS o FROM full_years),
g AS (SELECT *, count(o) OVER (PARTITION BY urn ORDER BY start_year ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT urn, start_year, round(coalesce(first_value(o) OVER w, 1000.0) + sum(CASE WHEN o IS NULL THEN b ELSE 0 END) OVER w, 2) AS reserve FROM g
WINDOW w AS (PARTITION BY urn, g ORDER BY start_year ROWS UNBOUNDED PRECEDING)""",
)
def q_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserves carried forward by balances, set anew every fourth year where known."""
    y = full_years(spark, sf_dir).select("urn", "start_year", "in_year_balance", F.when(F.col("start_year") % 4 == 0, F.col("revenue_reserve")).alias("known"), F.lit(1000.0).alias("start"))
    p = timelines.projected(y, ["urn"], "start_year", "in_year_balance", "known", "start")
    return p.select("urn", "start_year", F.round("reserve", 2).alias("reserve"))


@C.query(
    "q_step_windows",
    """WITH s AS (SELECT DISTINCT urn, snapshot_date FROM establishment_snapshot WHERE urn IS NOT NULL), w AS (SELECT urn, snapshot_date, lead(snapshot_date) OVER (PARTITION BY urn ORDER BY snapshot_date) AS until FROM s)
SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(count(*) AS BIGINT) AS schools FROM w WHERE snapshot_date <= DATE '2024-06-15' AND (until IS NULL OR DATE '2024-06-15' < until) GROUP BY 1""",
)
def q_step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which extract of each school was in force on 15 June 2024."""
    s = table(spark, sf_dir, "establishment_snapshot").select("urn", "snapshot_date").where("urn is not null").distinct()
    w = timelines.step_windows(s, ["urn"], "snapshot_date", F.lit("2024-06-15").cast("date"))
    return w.where("current").groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("schools"))


@C.query(
    "q_trusted_span",
    "WITH "
    + RETURNS_SQL
    + """, k AS (SELECT urn, start_year, total_income AS v FROM full_years WHERE total_income IS NOT NULL AND NOT coalesce(list_contains(suspect, 'total_income'), false))
SELECT urn, min(start_year) AS first_year, arg_min(v, start_year) AS first_value, max(start_year) AS last_year, arg_max(v, start_year) AS last_value,
  round(arg_max(v, start_year) - arg_min(v, start_year), 2) AS change FROM k GROUP BY urn""",
)
def q_trusted_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and latest income of each school that isn't suspect."""
    s = timelines.trusted_span(full_years(spark, sf_dir), ["urn"], "start_year", "total_income", F.array_contains("suspect", "total_income"))
    return s.withColumn("change", F.round("change", 2))


@C.query(
    "q_well_covered_year",
    "WITH " + RETURNS_SQL + """, n AS (SELECT start_year, count(pupils) AS known FROM returns GROUP BY start_year)
SELECT max(start_year) AS start_year, CAST(arg_max(known, start_year) AS BIGINT) AS known FROM n WHERE known >= 0.6 * (SELECT max(known) FROM n)""",
)
def q_well_covered_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest year with at least 60 % of the best year's pupil numbers."""
    return timelines.well_covered_year(returns(spark, sf_dir), "start_year", "pupils")


# --- rules ------------------------------------------------------------------------------------------------------------

KINDS = [("nursery", "early"), ("infant|junior|primary", "primary"), ("high|secondary|college", "secondary"), ("special", "special")]


@C.query(
    "q_first_match",
    """WITH s AS (SELECT urn, min(name) AS name FROM establishment WHERE urn IS NOT NULL GROUP BY urn)
SELECT CASE WHEN regexp_matches(name, 'nursery', 'i') THEN 'early' WHEN regexp_matches(name, 'infant|junior|primary', 'i') THEN 'primary'
  WHEN regexp_matches(name, 'high|secondary|college', 'i') THEN 'secondary' WHEN regexp_matches(name, 'special', 'i') THEN 'special' ELSE 'other' END AS category, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""",
)
def q_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools by the first category whose words their name has."""
    s = table(spark, sf_dir, "establishment").where("urn is not null").groupBy("urn").agg(F.min("name").alias("name"))
    return s.groupBy(rules.first_match(F.col("name"), KINDS, "other").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "q_every_match",
    "WITH s AS (SELECT urn, min(name) AS name FROM establishment WHERE urn IS NOT NULL GROUP BY urn), m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS category FROM s WHERE regexp_matches(name, '{p}', 'i')" for p, c in KINDS)
    + ") SELECT category, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY category",
)
def q_every_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools by every category whose words their name has."""
    s = table(spark, sf_dir, "establishment").where("urn is not null").groupBy("urn").agg(F.min("name").alias("name"))
    return s.select(F.explode(rules.every_match(F.col("name"), KINDS)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "q_decision_table",
    """SELECT CASE WHEN phase = 'Primary' AND type_group = 'Academies' THEN 'A1' WHEN phase = 'Secondary' AND type_group = 'Academies' THEN 'A2' WHEN phase = 'Primary' THEN 'M1'
  WHEN type_group = 'Academies' THEN 'A9' END AS code, CAST(count(*) AS BIGINT) AS n FROM establishment GROUP BY 1""",
)
def q_decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the register by the code of a decision table over phase and type group."""
    t = [
        {"phase": "Primary", "type_group": "Academies", "code": "A1"}, {"phase": "Secondary", "type_group": "Academies", "code": "A2"},
        {"phase": "Primary", "type_group": None, "code": "M1"}, {"phase": None, "type_group": "Academies", "code": "A9"},
    ]
    return rules.decide(table(spark, sf_dir, "establishment"), t, ["phase", "type_group"], "code").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "q_predicate_rules",
    """SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal > 5000) AND NOT c_nationkey < 10""",
)
def q_predicate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that meet a rule given as text."""
    c = table(spark, sf_dir, "customer")
    rule = "(c_mktsegment in ('BUILDING', 'MACHINERY') or c_acctbal > 5000) and not c_nationkey < 10"
    return c.where(rules.predicate(rule, c.columns)).select("c_custkey")


@C.query(
    "q_tag_filter",
    """SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size IN (1, 2, 3, 4, 5)""",
)
def q_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with any tag of each group."""
    p = table(spark, sf_dir, "part")
    tags = F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("size:"), F.col("p_size").cast("string")))
    return p.where(rules.has_tags(tags, "brand:Brand#1|Brand#2 size:1|2|3|4|5")).select("p_partkey")


@C.query(
    "q_evidence_gate",
    """SELECT charity_number FROM (SELECT charity_number, max(CAST(charity_contact_postcode IS NOT NULL AS INT)) + max(CAST(charity_contact_web IS NOT NULL AS INT))
  + max(CAST(charity_contact_email IS NOT NULL AS INT)) + max(CAST(charitable_objects IS NOT NULL AS INT)) AS n FROM pta GROUP BY 1) WHERE n >= 2""",
)
def q_evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charities with at least two of four contact fields."""
    cols = ["charity_contact_postcode", "charity_contact_web", "charity_contact_email", "charitable_objects"]
    g = table(spark, sf_dir, "pta").groupBy("charity_number").agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in cols])
    return g.where(rules.at_least([F.col(c) for c in cols], 2)).select("charity_number")


# --- geometry ---------------------------------------------------------------------------------------------------------


_KEPT = """nb AS (SELECT k.urn, row_number() OVER (ORDER BY k.urn) AS i, coalesce(list(better) FILTER (WHERE better IS NOT NULL), []) AS better FROM k LEFT JOIN near ON worse = k.urn GROUP BY k.urn),
r(i, kept) AS (SELECT i, [urn] FROM nb WHERE i = 1 UNION ALL SELECT nb.i, CASE WHEN list_has_any(kept, better) THEN kept ELSE list_append(kept, urn) END FROM r JOIN nb ON nb.i = r.i + 1),
seeds AS (SELECT unnest(kept) AS urn FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1))"""


@C.query(
    "q_greedy_distinct",
    f"""WITH RECURSIVE {_PLACES_SQL}, k AS (SELECT urn, lat, lon FROM spot),
near AS (SELECT a.urn AS better, b.urn AS worse FROM k a JOIN k b ON a.urn < b.urn AND abs(a.lat - b.lat) < 0.01 WHERE {_HAV} <= 400), {_KEPT} SELECT urn FROM seeds""",
)
def q_greedy_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools left when, in the order of their URNs, each within 400 m of one already taken is skipped."""
    p = school_places(spark, sf_dir).select(F.col("urn").alias("point"), F.col("urn").alias("rank"), "lat", "lon")
    return spatial.greedy_distinct(p, 400.0).select(F.col("point").alias("urn"))


@C.query(
    "q_nearest_of_each_phase",
    f"""WITH {_PLACES_SQL}, ph AS (SELECT urn, min(phase) AS phase FROM establishment GROUP BY urn), k AS (SELECT spot.*, phase FROM spot JOIN ph USING (urn)),
d AS (SELECT a.urn, b.phase, b.urn AS other, {_HAV} AS m FROM k a JOIN k b ON a.urn <> b.urn AND abs(a.lat - b.lat) < 0.05 WHERE a.urn % 10 = 0)
SELECT urn, phase, other, row_number() OVER (PARTITION BY urn, phase ORDER BY m, other) AS place FROM d WHERE m <= 4000
QUALIFY row_number() OVER (PARTITION BY urn, phase ORDER BY m, other) <= 2""".replace(" WHERE a.urn % 10 = 0", ""),
)
def q_nearest_of_each_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest other schools of every phase, looked for within 1, 2 and 4 km in turn."""
    k = school_places(spark, sf_dir)
    ph = table(spark, sf_dir, "establishment").groupBy("urn").agg(F.min("phase").alias("phase"))
    targets = k.join(ph, "urn").select(F.col("urn").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), "phase")
    # The school itself is its own nearest of its phase, so one more is asked for and it is left out.
    near = spatial.nearest_of_each_kind(k.withColumnRenamed("urn", "id"), targets, "phase", 3, [1000.0, 2000.0, 4000.0]).where("id <> rid")
    w = Window.partitionBy("id", "phase").orderBy("metres", "rid")
    near = near.withColumn("place", F.row_number().over(w)).where("place <= 2")
    return near.select(F.col("id").alias("urn"), "phase", F.col("rid").alias("other"), F.col("place").cast("long").alias("place"))


@C.query(
    "q_box_overlap",
    f"""WITH {_PLACES_SQL}, ph AS (SELECT urn, min(la_code) AS la FROM establishment GROUP BY urn),
b AS (SELECT la, round(min(lon), 5) AS x0, round(min(lat), 5) AS y0, round(max(lon), 5) AS x1, round(max(lat), 5) AS y1 FROM spot JOIN ph USING (urn) GROUP BY la)
SELECT a.la AS la_a, c.la AS la_b FROM b a JOIN b c ON a.la < c.la AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1""",
)
def q_box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities whose boxes around their schools overlap."""
    la = table(spark, sf_dir, "establishment").groupBy("urn").agg(F.min("la_code").alias("id"))
    box = school_places(spark, sf_dir).join(la, "urn").groupBy("id").agg(
        *[F.round(f(c), 5).alias(n) for n, f, c in (("x0", F.min, "lon"), ("y0", F.min, "lat"), ("x1", F.max, "lon"), ("y1", F.max, "lat"))]
    )
    return spatial.overlapping_boxes(box, box, 0.1).where("ida < idb").select(F.col("ida").alias("la_a"), F.col("idb").alias("la_b"))


@C.query(
    "q_seed_clusters",
    f"""WITH RECURSIVE {_PLACES_SQL}, ph AS (SELECT urn, min(phase) AS phase FROM establishment GROUP BY urn), k AS (SELECT urn, lat, lon, phase FROM spot JOIN ph USING (urn) WHERE phase IS NOT NULL),
near AS (SELECT a.urn AS better, b.urn AS worse FROM k a JOIN k b ON a.urn < b.urn AND a.phase = b.phase AND abs(a.lat - b.lat) < 0.01 WHERE {_HAV} <= 500), {_KEPT},
c AS (SELECT k.urn, k.phase, coalesce(min(near.better) FILTER (WHERE near.better IN (SELECT urn FROM seeds)), k.urn) AS cluster FROM k LEFT JOIN near ON worse = k.urn GROUP BY k.urn, k.phase)
SELECT cluster, phase, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY cluster, phase""",
)
def q_seed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools of one phase around seeds taken in the order of their URNs: within 500 m of the first such seed."""
    ph = table(spark, sf_dir, "establishment").groupBy("urn").agg(F.min("phase").alias("phase"))
    p = school_places(spark, sf_dir).join(ph, "urn").select(F.col("urn").alias("point"), F.col("urn").alias("rank"), "phase", "lat", "lon")
    return spatial.seed_clusters(p.where("phase is not null"), "phase", 500.0).select("cluster", "phase", "n")


@C.query(
    "q_phase_clusters",
    f"""WITH RECURSIVE {_PLACES_SQL}, ph AS (SELECT urn, min(phase) AS phase FROM establishment GROUP BY urn), k AS (SELECT urn, lat, lon, phase FROM spot JOIN ph USING (urn) WHERE phase IS NOT NULL),
near AS (SELECT a.urn AS x, b.urn AS y FROM k a JOIN k b ON a.urn <> b.urn AND a.phase = b.phase AND abs(a.lat - b.lat) < 0.01 WHERE {_HAV} <= 500),
reach(a, b) AS (SELECT urn, urn FROM k UNION SELECT reach.a, near.y FROM reach JOIN near ON near.x = reach.b),
c AS (SELECT a AS urn, min(b) AS cluster FROM reach GROUP BY a)
SELECT cluster, phase, CAST(count(*) AS BIGINT) AS n, round(avg(lat) + 1e-9, 4) AS lat, round(avg(lon) + 1e-9, 4) AS lon FROM c JOIN k USING (urn) GROUP BY cluster, phase""",
)
def q_phase_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools of one phase within 500 m of each other, linked on, as one place."""
    ph = table(spark, sf_dir, "establishment").groupBy("urn").agg(F.min("phase").alias("phase"))
    p = school_places(spark, sf_dir).join(ph, "urn").where("phase is not null").select(F.col("urn").alias("point"), "phase", "lat", "lon")
    c = spatial.centre_clusters(p, "phase", 500.0)
    return c.select("cluster", "phase", "n", F.round(F.col("lat") + 1e-9, 4).alias("lat"), F.round(F.col("lon") + 1e-9, 4).alias("lon"))
