"""Queries of profiles, lookups, verdicts, area indexes, samples, polygons and small expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.functions.clean import fold, squash
from tallyhouse.operators import area, joins, merge, order, panel, spatial, survival
from tallyhouse.plans.catalogue import Catalogue, table
from tallyhouse.plans.panels import RETURNS_SQL, full_years, returns
from tallyhouse.plans.register import school_places
from tallyhouse.plans.relations import _CUTS_SQL, _PLACES_SQL, _cuts

C = Catalogue()

# --- profiles and lookups ----------------------------------------------------------------------------------------------


@C.query(
    "q_section_profile",
    "WITH "
    + RETURNS_SQL
    + """, b AS (SELECT DISTINCT urn FROM establishment WHERE urn IS NOT NULL),
fin AS (SELECT TRY_CAST(urn AS BIGINT) AS urn, count(*) AS years, max(start_year) AS latest FROM returns WHERE TRY_CAST(urn AS BIGINT) IS NOT NULL GROUP BY 1),
txt AS (SELECT urn, count(*) AS n FROM documents WHERE urn IS NOT NULL GROUP BY 1), his AS (SELECT urn, max(len(former_urns)) AS former FROM school_match GROUP BY 1)
SELECT urn, CAST(fin.years AS BIGINT) AS years, CAST(fin.latest AS INTEGER) AS latest, CAST(txt.n AS BIGINT) AS texts,
  concat_ws(',', CASE WHEN fin.urn IS NOT NULL THEN 'finance' END, CASE WHEN txt.urn IS NOT NULL THEN 'texts' END, CASE WHEN his.urn IS NOT NULL THEN 'history' END) AS sections
FROM b LEFT JOIN fin USING (urn) LEFT JOIN txt USING (urn) LEFT JOIN his USING (urn)""",
)
def q_section_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every school of the register with its sections and the list of those it has."""
    base = table(spark, sf_dir, "establishment").where("urn is not null").select("urn").distinct()
    fin = returns(spark, sf_dir).select(F.col("urn").try_cast("long").alias("urn"), "start_year").where("urn is not null")
    fin = fin.groupBy("urn").agg(F.count(F.lit(1)).alias("years"), F.max("start_year").alias("latest"))
    txt = table(spark, sf_dir, "documents").where("urn is not null").groupBy("urn").agg(F.count(F.lit(1)).alias("n"))
    his = table(spark, sf_dir, "school_match").groupBy("urn").agg(F.max(F.size("former_urns")).alias("former"))
    p = joins.with_sections(base, {"finance": fin, "texts": txt, "history": his}, "urn")
    return p.select("urn", F.col("finance.years").alias("years"), F.col("finance.latest").alias("latest"), F.col("texts.n").alias("texts"), F.array_join("sections", ",").alias("sections"))


@C.query(
    "q_register_clean",
    """SELECT DISTINCT urn, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, lower(trim(regexp_replace(status, '\\s+', ' ', 'g'))) AS status,
  CASE WHEN len(laestab) = 7 THEN left(laestab, 3) || '/' || right(laestab, 4) END AS la_and_number,
  CASE WHEN lower(gender) IN ('boys', 'girls') THEN 'single' WHEN gender IS NOT NULL THEN 'mixed' END AS intake, year(open_date) AS opened FROM establishment WHERE urn IS NOT NULL""",
)
def q_register_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register as a projection of cleaned columns."""
    e = table(spark, sf_dir, "establishment").where("urn is not null")
    number = F.when(F.length("laestab") == 7, F.concat(F.left("laestab", F.lit(3)), F.lit("/"), F.right("laestab", F.lit(4))))
    intake = F.when(F.lower("gender").isin("boys", "girls"), "single").when(F.col("gender").isNotNull(), "mixed")
    return e.select(
        "urn", squash(F.col("name")).alias("name"), fold(F.col("status")).alias("status"), number.alias("la_and_number"), intake.alias("intake"), F.year("open_date").cast("long").alias("opened")
    ).distinct()


@C.query(
    "q_first_row_lookup",
    """WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c_custkey, c.o_orderkey AS first_order, c.o_orderpriority AS first_priority FROM customer LEFT JOIN c ON o_custkey = c_custkey""",
)
def q_first_row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their first order from a lookup table of one row a key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    first = joins.first_row_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"])
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    return cust.join(first, cust.c_custkey == first.o_custkey, "left").select("c_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderpriority").alias("first_priority"))


@C.query(
    "q_benchmark_fallback",
    """WITH e AS (SELECT DISTINCT urn, la_code, phase FROM establishment WHERE urn IS NOT NULL),
g AS (SELECT la_code, phase, count(*) AS n FROM e GROUP BY ALL), a AS (SELECT la_code, count(*) AS n FROM e GROUP BY ALL)
SELECT urn, e.la_code, e.phase, CAST(CASE WHEN g.n >= 5 THEN g.n ELSE a.n END AS BIGINT) AS peers, CASE WHEN g.n >= 5 THEN 'own' ELSE 'all' END AS basis
FROM e JOIN a ON a.la_code = e.la_code LEFT JOIN g ON g.la_code = e.la_code AND g.phase = e.phase""",
)
def q_benchmark_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools of the same authority and phase, or of all phases where those are fewer than five."""
    e = table(spark, sf_dir, "establishment").where("urn is not null").select("urn", "la_code", "phase").distinct()
    own = e.where("phase is not null").groupBy("la_code", "phase").agg(F.count(F.lit(1)).alias("peers")).where("peers >= 5")
    every = e.groupBy("la_code").agg(F.count(F.lit(1)).alias("peers")).withColumn("phase", F.lit("all"))
    return joins.by_group_or_all(e.where("la_code is not null"), own.unionByName(every), ["la_code"], "phase", "peers").select("urn", "la_code", "phase", "peers", "basis")


@C.query(
    "q_attach_returns",
    """WITH r AS (SELECT * FROM finance_history WHERE urn IS NOT NULL AND period_end IS NOT NULL QUALIFY row_number() OVER (PARTITION BY urn, period_end
  ORDER BY coalesce(did_not_supply = false AND total_income IS NOT NULL, false) DESC, loaded_at DESC NULLS LAST, total_income DESC NULLS LAST) = 1),
b AS (SELECT DISTINCT CAST(urn AS VARCHAR) AS urn FROM school_match)
SELECT r.urn, r.period_end, round(r.total_income, 2) AS income, CAST(row_number() OVER (PARTITION BY r.urn ORDER BY r.period_end DESC) AS INTEGER) AS age FROM r JOIN b ON b.urn = r.urn""",
)
def q_attach_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All annual returns of resolved schools, known figures before withheld ones."""
    r = table(spark, sf_dir, "finance_history").where("urn is not null and period_end is not null").select("urn", "period_end", "did_not_supply", "total_income", "loaded_at")
    base = table(spark, sf_dir, "school_match").select(F.col("urn").cast("string").alias("urn"))
    known = (F.col("did_not_supply") == F.lit(False)) & F.col("total_income").isNotNull()
    out = joins.attach_series(base, r, "urn", "period_end", known, ["loaded_at", "total_income"])
    return out.select("urn", "period_end", F.round("total_income", 2).alias("income"), "age")


@C.query(
    "q_code_map",
    """SELECT outward, la_code FROM (SELECT split_part(upper(trim(postcode)), ' ', 1) AS outward, la_code, urn FROM establishment
  WHERE regexp_full_match(upper(trim(postcode)), '[A-Z]+[0-9]+ [0-9][A-Z]{2}') AND la_code IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY outward ORDER BY urn, la_code) = 1""",
)
def q_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authority that the first school of each outward code lies in."""
    e = table(spark, sf_dir, "establishment").withColumn("pc", F.upper(F.trim("postcode"))).where(F.col("pc").rlike("^[A-Z]+[0-9]+ [0-9][A-Z]{2}$"))
    return joins.code_map(e.select(F.split_part("pc", F.lit(" "), F.lit(1)).alias("outward"), "la_code", "urn"), "outward", "la_code", "urn")


# --- merges and verdicts -------------------------------------------------------------------------------------------------

_LATE = """placed AS (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
late AS (SELECT l_partkey, max(l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"""


@C.query(
    "q_late_matches",
    f"""WITH {_LATE} SELECT coalesce(p.l_partkey, l.l_partkey) AS l_partkey, coalesce(p.s, l.s) AS l_suppkey,
  CASE WHEN p.s = l.s THEN 'returned; accepted' WHEN p.s IS NOT NULL THEN 'returned' ELSE 'accepted' END AS evidence, CASE WHEN p.s <> l.s THEN l.s END AS contradicted
FROM placed p FULL JOIN late l ON p.l_partkey = l.l_partkey""",
)
def q_late_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of parts from returned items, never moved by those from accepted ones, which confirm, contradict or add."""
    li = table(spark, sf_dir, "lineitem")
    one = lambda flag, f, said: li.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(f("l_suppkey").alias("l_suppkey")).withColumn("evidence", F.lit(said))
    return merge.late_matches(one("R", F.min, "returned"), one("A", F.max, "accepted"), "l_partkey", "l_suppkey")


@C.query(
    "q_widespread_keys",
    """WITH n AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT s_suppkey, coalesce(n > 80, false) AS held_back FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey""",
)
def q_widespread_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers seen on more than 80 parts are held back."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct()
    every = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("long").alias("l_partkey")).unionByName(li)
    return merge.widespread(every, "s_suppkey", "l_partkey", 80).select("s_suppkey", "held_back").distinct()


@C.query(
    "q_best_verdict",
    """SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) WHEN 1 THEN 'A' WHEN 2 THEN 'R' ELSE 'N' END AS l_returnflag,
  CAST(count(*) AS BIGINT) AS checked FROM lineitem GROUP BY l_orderkey""",
)
def q_best_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best flag of each order's items, accepted before returned before the rest."""
    return merge.best_verdict(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "R"])


@C.query(
    "q_merge_gate",
    """SELECT CAST(count_if(o_orderstatus <> 'P') AS BIGINT) AS judged, CAST(count_if(o_orderstatus <> 'P' AND o_totalprice < 0) AS BIGINT) AS wrong,
  count_if(o_orderstatus <> 'P') >= 50 AND count_if(o_orderstatus <> 'P' AND o_totalprice < 0) = 0 AS passes FROM orders""",
)
def q_merge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether enough orders were judged and none wrongly."""
    return merge.gate(table(spark, sf_dir, "orders"), F.col("o_orderstatus") != "P", F.col("o_totalprice") < 0, 50)


# --- areas ---------------------------------------------------------------------------------------------------------------


@C.query(
    "q_place_index",
    f"""WITH {_PLACES_SQL}, e AS (SELECT urn, max(la_code) AS la_code, max(phase) AS phase FROM establishment WHERE urn IS NOT NULL GROUP BY 1)
SELECT la_code, CAST(count(*) AS BIGINT) AS rows, CAST(count_if(phase = 'Primary') AS BIGINT) AS primary_schools, round(min(lat) - 0.01, 6) AS south, round(max(lat) + 0.01, 6) AS north,
  round(min(lon) - 0.01, 6) AS west, round(max(lon) + 0.01, 6) AS east, round(avg(lat) + 1e-9, 4) AS lat, round(avg(lon) + 1e-9, 4) AS lon, array_to_string(list_sort(list_distinct(list(phase))), ',') AS codes
FROM e LEFT JOIN spot USING (urn) GROUP BY la_code""",
)
def q_place_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of authorities with padded box, middle and distinct phases."""
    e = table(spark, sf_dir, "establishment").where("urn is not null").groupBy("urn").agg(F.max("la_code").alias("la_code"), F.max("phase").alias("phase"))
    p = e.join(school_places(spark, sf_dir), "urn", "left")
    i = area.place_index(p, ["la_code"], "lat", "lon", "phase", {"primary_schools": F.col("phase") == "Primary"})
    return i.select("la_code", "rows", "primary_schools", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")], F.round(F.col("lat") + 1e-9, 4).alias("lat"), F.round(F.col("lon") + 1e-9, 4).alias("lon"), F.array_join("codes", ",").alias("codes"))


@C.query(
    "q_major_groups",
    "WITH "
    + RETURNS_SQL
    + """SELECT urn, start_year, round(CASE WHEN coalesce(grant_funding, sen_funding) IS NOT NULL THEN coalesce(grant_funding, 0) + coalesce(sen_funding, 0) END, 2) AS grants, round(donations_revenue, 2) AS gifts,
  round(CASE WHEN coalesce(grant_funding, sen_funding) IS NOT NULL THEN coalesce(grant_funding, 0) + coalesce(sen_funding, 0) END * 100 / nullif(total_income, 0), 4) AS grants_pct FROM full_years""",
)
def q_major_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income of full years by major group, unknown only where all its parts are."""
    m = area.major_groups(full_years(spark, sf_dir), {"grants": ["grant_funding", "sen_funding"], "gifts": ["donations_revenue"]}, "total_income")
    return m.select("urn", "start_year", F.round("grants", 2).alias("grants"), F.round("gifts", 2).alias("gifts"), F.round("grants_pct", 4).alias("grants_pct"))


@C.query(
    "q_band_summary",
    """WITH o AS (SELECT o_custkey, o_totalprice, CASE WHEN o_totalprice >= 300000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END AS band FROM orders)
SELECT CAST(band AS INTEGER) AS band, CAST(count(DISTINCT o_custkey) AS BIGINT) AS entities, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median FROM o GROUP BY band""",
)
def q_band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, sum, mean and median of orders by band of price."""
    s = area.band_summary(table(spark, sf_dir, "orders"), area.banded(F.col("o_totalprice"), [100_000.0, 300_000.0]), "o_custkey", "o_totalprice")
    return s.select("band", "entities", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


@C.query(
    "q_yearly_deficits",
    "WITH "
    + RETURNS_SQL
    + """, m AS (SELECT 'country' AS kind, 'all' AS area, start_year, reserve FROM full_years UNION ALL SELECT 'authority', CAST(la AS VARCHAR), start_year, reserve FROM full_years WHERE la IS NOT NULL)
SELECT kind, area, start_year, CAST(count(reserve) AS BIGINT) AS members, CAST(count_if(reserve < 0) AS BIGINT) AS in_deficit, round(sum(CASE WHEN reserve < 0 THEN -reserve END), 2) AS owed,
  round(max(CASE WHEN reserve < 0 THEN -reserve END), 2) AS largest, round(median(CASE WHEN reserve < 0 THEN -reserve END), 3) AS median_debt FROM m GROUP BY ALL""",
)
def q_yearly_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools in deficit by year, of the country and of each authority."""
    d = area.yearly_deficits(full_years(spark, sf_dir).select("la", "start_year", "reserve"), "start_year", "reserve", {"country": F.lit("all"), "authority": F.col("la")})
    return d.select("kind", "area", "start_year", "members", "in_deficit", F.round("owed", 2).alias("owed"), F.round("largest", 2).alias("largest"), F.round("median_debt", 3).alias("median_debt"))


@C.query("q_exact_sum", "SELECT l_suppkey, round(fsum(l_extendedprice * 0.01), 6) AS total FROM lineitem GROUP BY l_suppkey")
def q_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that don't depend on the order of rows."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(area.exact_sum(F.col("l_extendedprice") * 0.01), 6).alias("total"))


@C.query(
    "q_severity_histogram",
    """WITH n AS (SELECT o_custkey, o_orderpriority AS g, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(g || ':' || n, ' ' ORDER BY g) AS histogram, min(g) AS headline FROM n GROUP BY o_custkey""",
)
def q_severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer by priority, gravest first, and the gravest that occurs."""
    o = table(spark, sf_dir, "orders")
    h = area.histogram(o, ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return h.select("o_custkey", F.array_join(F.transform("histogram", lambda x: F.concat(x["grade"], F.lit(":"), x["n"].cast("string"))), " ").alias("histogram"), "headline")


# --- panels --------------------------------------------------------------------------------------------------------------


@C.query(
    "q_change_since_base",
    "WITH " + RETURNS_SQL + """, b AS (SELECT urn, start_year, pupils, max(CASE WHEN start_year = 2019 THEN pupils END) OVER (PARTITION BY urn) AS base FROM full_years)
SELECT urn, start_year, round((pupils - base) * 100 / nullif(base, 0), 4) AS change_pct FROM b""",
)
def q_change_since_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of pupils in % since 2019."""
    return panel.change_since(full_years(spark, sf_dir), ["urn"], "start_year", "pupils", 2019).select("urn", "start_year", F.round("change_pct", 4).alias("change_pct"))


@C.query(
    "q_latest_number",
    """SELECT user_id, CAST(arg_max(date_part('year', ts) * 1000 + date_part('doy', ts), event_id) AS BIGINT) AS day, CASE WHEN arg_max(value, event_id) <= 60 THEN arg_max(value, event_id) END AS value
FROM events WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY user_id""",
)
def q_latest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each user that is a number, none beyond 60."""
    e = table(spark, sf_dir, "events").withColumn("typed", F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")))
    n = panel.latest_number(e, ["user_id"], "event_id", "typed", 60.0)
    day = (F.year("ts") * 1000 + F.dayofyear("ts")).cast("long").alias("day")
    return n.join(e.select("event_id", day), "event_id").select("user_id", "day", "value")


@C.query(
    "q_drop_repeats",
    """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS was, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE i = 1 OR event_type IS DISTINCT FROM was""",
)
def q_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user whose type differs from that of the one before."""
    return panel.drop_repeats(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"])


@C.query(
    "q_lagged_cohorts",
    """WITH w AS (SELECT o_custkey, sum(CASE WHEN year(o_orderdate) % 3 = 0 THEN 1 END) AS a, sum(CASE WHEN year(o_orderdate) % 3 = 1 THEN 1 END) AS b, sum(CASE WHEN year(o_orderdate) % 3 = 2 THEN 1 END) AS c FROM orders GROUP BY 1)
SELECT o_custkey, concat_ws(' ', CASE WHEN c IS NOT NULL THEN '2022:' || c END, CASE WHEN b IS NOT NULL THEN '2023:' || b END, CASE WHEN a IS NOT NULL THEN '2024:' || a END) AS trend FROM w""",
)
def q_lagged_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wide cohort columns as one trend, oldest first."""
    o = table(spark, sf_dir, "orders")
    wide = o.groupBy("o_custkey").agg(*[F.sum(F.when(F.year("o_orderdate") % 3 == i, 1)).alias(n) for i, n in enumerate("abc")])
    t = panel.lagged_cohorts(wide, ["o_custkey"], {0: "a", 1: "b", 2: "c"}, F.lit(2024))
    return t.select("o_custkey", F.array_join(F.transform("trend", lambda p: F.concat(p["year"].cast("string"), F.lit(":"), p["value"].cast("long").cast("string"))), " ").alias("trend"))


@C.query(
    "q_standing_of_customers",
    """WITH y AS (SELECT o_custkey, max(year(o_orderdate)) AS y FROM orders GROUP BY 1), t AS (SELECT max(y) AS top FROM y)
SELECT c_custkey, CASE WHEN y >= top THEN 'current' WHEN y >= top - 1 THEN 'recent' WHEN y IS NOT NULL THEN 'historical' END AS standing FROM customer LEFT JOIN y ON o_custkey = c_custkey, t""",
)
def q_standing_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a customer's last order is of the current year, a recent or an earlier one."""
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.year("o_orderdate")).alias("y"))
    top = y.agg(F.max("y")).first()[0] or 0
    return table(spark, sf_dir, "customer").select("c_custkey").join(y, "c_custkey", "left").select("c_custkey", panel.standing(F.col("y"), top, 1).alias("standing"))


@C.query(
    "q_latest_known",
    "WITH " + RETURNS_SQL + """SELECT urn, arg_max(pupils, start_year) AS pupils, arg_max(sen_funding, start_year) AS sen_funding FROM full_years GROUP BY urn""",
)
def q_latest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest known number of pupils and sum of funding of every school."""
    return panel.latest_known(full_years(spark, sf_dir), ["urn"], "start_year", ["pupils", "sen_funding"])


# --- chances -------------------------------------------------------------------------------------------------------------


@C.query(
    "q_survival_in_band",
    f"""WITH {_CUTS_SQL}, b AS (SELECT *, cutoff * sqrt(1 / 1.25) AS cut FROM c WHERE event_type IN ('click', 'view'))
SELECT event_type, CAST(point AS DOUBLE) AS point, round(sum(CASE WHEN cut >= point THEN w ELSE 0 END) / sum(w), 6) AS chance FROM b, (VALUES (10.0), (40.0)) p(point) GROUP BY ALL""",
)
def q_survival_in_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances within two types of event if demand grew by a quarter."""
    s = survival.survival_in_band(_cuts(spark, sf_dir), ["event_type"], F.col("event_type").isin("click", "view"), "cutoff", "w", 0.25, [10.0, 40.0])
    return s.withColumn("chance", F.round("chance", 6))


@C.query(
    "q_reach",
    """WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN CAST('inf' AS DOUBLE) ELSE value END AS cut FROM events)
SELECT user_id, min(CASE WHEN cut < CAST('inf' AS DOUBLE) THEN cut END) AS nearest, max(CASE WHEN cut < CAST('inf' AS DOUBLE) THEN cut END) AS furthest, CAST(count_if(cut = CAST('inf' AS DOUBLE)) AS BIGINT) AS everyone,
  CAST(count_if(cut >= 20) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS years FROM e WHERE cut IS NOT NULL GROUP BY user_id""",
)
def q_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest finite value of each user, how often everyone was reached, and how often 20."""
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", F.lit(float("inf"))).otherwise(F.col("value")).alias("cut"))
    return survival.reach(e, ["user_id"], "cut", F.lit(20.0))


# --- order ---------------------------------------------------------------------------------------------------------------


@C.query("q_seeded_sample", "SELECT c_custkey, c_name FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 100")
def q_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred customers drawn by a seed (a sample is the feature)."""
    return order.seeded_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 100, "7")


@C.query(
    "q_pinned_first",
    """SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey % 10 = 0 DESC, CASE WHEN s_acctbal >= 0 THEN s_acctbal END DESC NULLS LAST, s_suppkey) - 1 AS BIGINT) AS place FROM supplier""",
)
def q_pinned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in the order of a table: pinned ones first, then by balance downwards, unknown ones last."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance"))
    return order.pinned_first(s, F.col("s_suppkey") % 10 == 0, "balance", "s_suppkey", up=False).select("s_suppkey", "place")


@C.query(
    "q_top_per_bucket",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_totalprice >= 300000 THEN 'likely' WHEN o_totalprice >= 100000 THEN 'possible' ELSE 'unlikely' END AS bucket FROM orders)
SELECT o_custkey, bucket, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place FROM o WINDOW w AS (PARTITION BY o_custkey, bucket ORDER BY o_totalprice, o_orderkey) QUALIFY row_number() OVER w <= 4""",
)
def q_top_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four cheapest orders of every customer and class."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    t = order.top_per_bucket(o, ["o_custkey"], F.col("o_totalprice"), {"likely": 300_000.0, "possible": 100_000.0, "unlikely": 0.0}, [F.col("o_totalprice"), F.col("o_orderkey")], 4)
    return t.select("o_custkey", "bucket", "o_orderkey", "place")


@C.query(
    "q_distinct_in_order",
    """WITH e AS (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS kinds FROM e GROUP BY user_id""",
)
def q_distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of event of each user in the order of their first sight."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("i"))  # a few rows a user, whatever the events
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("i", "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(F.array_join(order.distinct_in_order(kinds), ">").alias("kinds"))


# --- geometry ------------------------------------------------------------------------------------------------------------

_SQUARES = """sq AS (SELECT p_partkey AS pid, CAST((p_partkey * 7919) % 4000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 4000 AS DOUBLE) AS y, CAST(10 + p_size AS DOUBLE) AS s FROM part)"""


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square for each part: its corner from the key, its side from the size."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pid"), (F.col("p_partkey") * 7919 % 4000).cast("double").alias("x"), (F.col("p_partkey") * 104729 % 4000).cast("double").alias("y"), (F.col("p_size") + 10).cast("double").alias("s")
    )
    at = lambda dx, dy: F.struct((F.col("x") + dx * F.col("s")).alias("x"), (F.col("y") + dy * F.col("s")).alias("y"))
    return p.select("pid", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0)).alias("ring"))


@C.query(
    "q_near_polygons",
    f"""WITH {_SQUARES}, g AS (SELECT a.pid AS a, b.pid AS b, greatest(0, b.x - a.x - a.s, a.x - b.x - b.s) AS dx, greatest(0, b.y - a.y - a.s, a.y - b.y - b.s) AS dy
  FROM sq a JOIN sq b ON a.pid < b.pid AND abs(a.x - b.x) < 200 AND abs(a.y - b.y) < 200)
SELECT a, b, round(sqrt(dx * dx + dy * dy), 6) AS gap FROM g WHERE sqrt(dx * dx + dy * dy) <= 25""",
)
def q_near_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose borders are at most 25 apart."""
    return spatial.near_polygons(_squares(spark, sf_dir), 25.0, 100.0).select("a", "b", F.round("gap", 6).alias("gap"))


_SPOTS = """sp AS (SELECT s_suppkey AS id, CAST((s_suppkey * 6151) % 4000 AS DOUBLE) AS x, CAST((s_suppkey * 3571) % 4000 AS DOUBLE) AS y FROM supplier)"""


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 6151 % 4000).cast("double").alias("x"), (s * 3571 % 4000).cast("double").alias("y"))


@C.query(
    "q_points_near_polygons",
    f"""WITH {_SQUARES}, {_SPOTS}, g AS (SELECT id, pid, greatest(0, sq.x - sp.x, sp.x - sq.x - s) AS dx, greatest(0, sq.y - sp.y, sp.y - sq.y - s) AS dy FROM sp, sq)
SELECT id, pid, round(sqrt(dx * dx + dy * dy), 6) AS gap FROM g WHERE sqrt(dx * dx + dy * dy) <= 40""",
)
def q_points_near_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside a region or at most 40 from its border."""
    return spatial.within_of_polygon(_spots(spark, sf_dir), _squares(spark, sf_dir), 40.0, 100.0).select("id", "pid", F.round("gap", 6).alias("gap"))


@C.query(
    "q_first_polygon",
    f"""WITH {_SQUARES}, {_SPOTS} SELECT id, min(pid) AS pid FROM sp, sq WHERE sp.x + 0.5 BETWEEN sq.x AND sq.x + s AND sp.y + 0.5 BETWEEN sq.y AND sq.y + s GROUP BY id""",
)
def q_first_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region that holds each point."""
    p = _spots(spark, sf_dir).select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    return joins.first_polygon(p, _squares(spark, sf_dir), 100.0)


@C.query(
    "q_polygon_with_hole",
    f"""WITH {_SQUARES}, {_SPOTS} SELECT id, pid FROM sp, sq WHERE sp.x + 0.5 BETWEEN sq.x AND sq.x + s AND sp.y + 0.5 BETWEEN sq.y AND sq.y + s
  AND NOT (sp.x + 0.5 BETWEEN sq.x + s / 4 AND sq.x + s * 3 / 4 AND sp.y + 0.5 BETWEEN sq.y + s / 4 AND sq.y + s * 3 / 4)""",
)
def q_polygon_with_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside regions whose middle is a hole."""
    p = _spots(spark, sf_dir).select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    a = F.col("ring")
    side = a[1]["x"] - a[0]["x"]
    hole = F.transform(a, lambda c: F.struct((a[0]["x"] + side / 4 + (c["x"] - a[0]["x"]) / 2).alias("x"), (a[0]["y"] + side / 4 + (c["y"] - a[0]["y"]) / 2).alias("y")))
    return joins.points_in_polygons(p, _squares(spark, sf_dir).select("pid", F.array(a, hole).alias("rings")), 100.0)


@C.query("q_rounded_rings", f"WITH {_SQUARES} SELECT pid, 5 AS corners, round(x / 7, 1) AS x FROM sq")
def q_rounded_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with rounded coordinates and no corner twice in a row."""
    small = F.transform("ring", lambda c: F.struct((c["x"] / 7).alias("x"), (c["y"] / 7).alias("y")))
    double = F.flatten(F.transform(small, lambda c: F.array(c, c)))
    r = _squares(spark, sf_dir).select("pid", spatial.rounded_ring(double, 1).alias("r"))
    return r.select("pid", F.size("r").alias("corners"), F.col("r")[0]["x"].alias("x"))


# --- expressions ---------------------------------------------------------------------------------------------------------


@C.query(
    "q_rounding",
    """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS even, round(-l_quantity / 2, 0) AS away, CAST(floor(-l_quantity / 2 + 0.5) AS BIGINT) AS up FROM lineitem""",
)
def q_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves to even, away from zero and upwards."""
    q = F.col("l_quantity") / 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.half_even(q).alias("even"), text.half_away(-q).alias("away"), text.half_up(-q).alias("up"))


@C.query("q_dotted_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_dotted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value inside nested JSON by its dotted path."""
    nested = F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", text.dotted(nested, "a.b.k", "bigint").alias("k"))


@C.query(
    "q_web_addresses",
    """SELECT DISTINCT urn, website, CASE WHEN website IS NOT NULL AND regexp_matches(lower(website), '^([a-z]+://)?[a-z0-9-]+(\\.[a-z0-9-]+)+(/.*)?$')
  THEN (CASE WHEN lower(website) LIKE 'http://%' THEN 'http://' ELSE 'https://' END) || lower(regexp_extract(website, '(?i)^([a-z]+://)?([^/?#]+)', 2))
    || regexp_replace(regexp_replace(website, '(?i)^([a-z]+://)?[^/?#]+', ''), '/+$', '') END AS address FROM establishment WHERE urn IS NOT NULL AND website = trim(website)""",
)
def q_web_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web addresses of schools in one form."""
    e = table(spark, sf_dir, "establishment").where("urn is not null and website = trim(website)")
    return e.select("urn", "website", text.web_address(F.col("website")).alias("address")).distinct()


@C.query(
    "q_entitled_hosts",
    """SELECT DISTINCT charity_number, charity_contact_email, coalesce(lower(split_part(charity_contact_email, '@', 2)) LIKE '%.sch.example' OR lower(split_part(charity_contact_email, '@', 2)) IN ('sch.example', 'gmail.com'), false) AS entitled
FROM pta WHERE charity_number IS NOT NULL""",
)
def q_entitled_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charities whose mail address lies under one of the known domains."""
    p = table(spark, sf_dir, "pta").where("charity_number is not null")
    host = F.split_part("charity_contact_email", F.lit("@"), F.lit(2))
    return p.select("charity_number", "charity_contact_email", text.host_entitled(host, ["sch.example", "gmail.com"]).alias("entitled")).distinct()


@C.query(
    "q_json_in_text",
    """SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) / 100 BETWEEN 0 AND 0.5 THEN CAST(json_extract(props, '$.k') AS DOUBLE) / 100 END AS confidence FROM events""",
)
def q_json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confidence from the first JSON object inside a free text; numbers outside 0 to 1 are none."""
    said = F.concat(F.lit("I think so: "), F.col("props"), F.lit(" -- {unsure}"))
    k = text.dotted(text.first_json(said), "k", "double") / 100
    return table(spark, sf_dir, "events").select("event_id", (text.share_or_null(k * 2) / 2).alias("confidence"))


@C.query(
    "q_id_or_code",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'member' WHEN o_orderstatus = 'F' THEN 'lead' WHEN o_orderstatus = 'O' THEN 'none' END AS category,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(100000 + o_orderkey % 1000 AS VARCHAR) END AS lead FROM orders""",
)
def q_id_or_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One messy column taken apart into a category and the number of a lead."""
    messy = F.when(F.col("o_orderkey") % 4 == 0, (100_000 + F.col("o_orderkey") % 1000).cast("string")).otherwise(F.concat(F.lit(" "), F.lower("o_orderstatus")))
    r = text.id_or_code(messy, {"F": "lead", "O": "none"})
    return table(spark, sf_dir, "orders").select("o_orderkey", r["category"].alias("category"), r["lead"].alias("lead"))


@C.query(
    "q_without_suffix",
    """SELECT DISTINCT urn, name, trim(regexp_replace(name, '(?i)[\\s,]+(primary school|school|academy)\\s*$', '')) AS short FROM establishment WHERE urn IS NOT NULL AND name IS NOT NULL""",
)
def q_without_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of schools without the word for what they are."""
    e = table(spark, sf_dir, "establishment").where("urn is not null and name is not null")
    return e.select("urn", "name", text.without_suffix(F.col("name"), ["primary school", "school", "academy"]).alias("short")).distinct()


@C.query(
    "q_dates_of_life",
    """SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1998-01-01' THEN 'third' WHEN o_orderdate >= DATE '1995-06-01' THEN 'second' ELSE 'first' END AS band,
  CAST(year(o_orderdate) + 4 + CASE WHEN month(o_orderdate) >= 9 THEN 1 ELSE 0 END AS INTEGER) AS entry,
  CAST(CAST(o_orderdate AS DATE) + CASE dayofweek(o_orderdate) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS DATE) AS due FROM orders""",
)
def q_dates_of_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band a date lies in, the year of entry at four, and the working day it falls due."""
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.dated_band(d, {"second": "1995-06-01", "third": "1998-01-01"}, "first").alias("band"), text.entry_year(d, 4).cast("int").alias("entry"), text.working_day(d).alias("due")
    )


@C.query(
    "q_odds_and_steps",
    """SELECT DISTINCT p_size, CASE WHEN p_size >= 48 THEN 'almost certain' WHEN p_size >= 38 THEN 'likely' WHEN p_size >= 25 THEN 'more likely than not' WHEN p_size >= 13 THEN 'possible' WHEN p_size > 2 THEN 'unlikely' ELSE 'very unlikely' END AS odds,
  CASE WHEN p_size <= 5 THEN 1.0 WHEN p_size <= 10 THEN 2.0 WHEN p_size <= 25 THEN 5.0 ELSE 10.0 END::DOUBLE AS step FROM part""",
)
def q_odds_and_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances in words and round steps of an axis."""
    p = table(spark, sf_dir, "part").select("p_size").distinct()
    step = F.greatest(text.nice_step(F.col("p_size").cast("double")), F.lit(1.0))
    return p.select("p_size", text.odds_words(F.col("p_size") / 50.0).alias("odds"), step.alias("step"))


@C.query(
    "q_codes_and_maps",
    """WITH m AS (SELECT urn, period_end, loaded_at, laestab, lines FROM finance_history WHERE urn IS NOT NULL AND period_end IS NOT NULL)
SELECT urn, period_end, loaded_at, coalesce(TRY_CAST(regexp_extract(laestab, '^\\d+$') AS INTEGER) BETWEEN 2000000 AND 3999999 OR TRY_CAST(regexp_extract(laestab, '^\\d+$') AS INTEGER) BETWEEN 8000000 AND 9999999, false) AS in_range,
  CAST(nullif(list_aggregate(map_values(lines), 'count'), 0) AS INTEGER) AS known_lines FROM m""",
)
def q_codes_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes within ranges, and maps without their empty entries."""
    f = table(spark, sf_dir, "finance_history").where("urn is not null and period_end is not null")
    kept = text.without_empty(F.col("lines"))
    ranges = [(2_000_000, 3_999_999), (8_000_000, 9_999_999)]
    return f.select("urn", "period_end", "loaded_at", text.code_between(F.col("laestab"), ranges).alias("in_range"), F.when(kept.isNotNull(), F.size(kept)).alias("known_lines"))
