"""Queries over finance panels: which returns count, standing, runs, restatement, areas, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import area, joins, merge, order, panel
from tallyhouse.plans.catalogue import Catalogue, table

C = Catalogue()

#: A price index of school years, the year 2024-25 = 100, for the tests of restatement.
INDEX = {
    "2017-18": 78.2, "2018-19": 79.9, "2019-20": 82.0, "2020-21": 86.9, "2021-22": 86.4, "2022-23": 92.2, "2023-24": 97.0, "2024-25": 100.0,
}

#: The order of loads of one return: of copies loaded at the same moment the one that knows more counts.
LATEST = [
    "loaded_at", "period_months", "did_not_supply", "pupils", "total_income", "total_expenditure", "in_year_balance", "revenue_reserve",
    "revenue_reserve_incl_trust_share", "grant_funding", "sen_funding", "donations_revenue", "trust",
]


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The returns that count: the latest load of each urn and period end; year written 2018-19 and as start_year."""
    raw = table(spark, sf_dir, "finance_history").where("urn is not null and period_end is not null")
    last = panel.keep_last(raw, ["urn", "period_end"], [F.col(c) for c in LATEST])
    return last.withColumn("year", F.replace("year", F.lit("/"), F.lit("-"))).withColumn("start_year", F.substring("year", 1, 4).cast("int"))


def full_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of twelve months that were supplied, with income and a reserve; of a year's returns the later period counts."""
    r = returns(spark, sf_dir).withColumn("reserve", F.coalesce("revenue_reserve_incl_trust_share", "revenue_reserve"))
    ok = (F.col("period_months") == 12) & ~F.coalesce("did_not_supply", F.lit(False)) & (F.col("total_income") != 0) & F.col("reserve").isNotNull()
    return panel.keep_last(r.where(ok), ["urn", "start_year"], [F.col("period_end"), F.col("loaded_at")])


RETURNS_SQL = f"""
returns AS (
  SELECT * REPLACE (replace(year, '/', '-') AS year), CAST(left(year, 4) AS INTEGER) AS start_year FROM finance_history
  WHERE urn IS NOT NULL AND period_end IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY urn, period_end ORDER BY {', '.join(c + ' DESC NULLS LAST' for c in LATEST)}) = 1),
full_years AS (
  SELECT *, coalesce(revenue_reserve_incl_trust_share, revenue_reserve) AS reserve FROM returns
  WHERE period_months = 12 AND NOT coalesce(did_not_supply, false) AND total_income <> 0
    AND coalesce(revenue_reserve_incl_trust_share, revenue_reserve) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY urn, start_year ORDER BY period_end DESC, loaded_at DESC NULLS LAST) = 1)
"""

_STATUS_SQL = (
    "WITH "
    + RETURNS_SQL
    + """, b AS (
  SELECT urn, start_year, reserve, total_income, coalesce(in_year_balance, 0) AS bal FROM full_years),
runs AS (
  SELECT *, sum(CASE WHEN bal < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY urn ORDER BY start_year ROWS UNBOUNDED PRECEDING) AS island,
    avg(bal) OVER (PARTITION BY urn ORDER BY start_year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean3,
    first_value(reserve) OVER (PARTITION BY urn ORDER BY start_year) AS first_reserve FROM b),
s AS (
  SELECT urn, start_year, reserve, reserve / total_income AS share, mean3, reserve - first_reserve AS since_first,
    CASE WHEN mean3 < 0 AND reserve >= 0 THEN reserve / -mean3 END AS runway,
    CAST(sum(CASE WHEN bal < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY urn, island ORDER BY start_year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak
  FROM runs),
status AS (
  SELECT urn, start_year, round(share, 6) AS share, round(mean3, 4) AS mean_balance, round(runway, 6) AS runway, streak,
    round(since_first, 4) AS since_first,
    CASE WHEN reserve < 0 THEN 'in_deficit' WHEN runway <= 3 THEN 'heading_for_deficit' WHEN share < 0.03 THEN 'tight'
      WHEN share >= 0.08 THEN 'large_reserves' ELSE 'healthy' END AS status FROM s)
"""
)


def _standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panel.status_by_year(full_years(spark, sf_dir), ["urn"], "start_year", reserve="reserve", income="total_income", balance="in_year_balance")
    return s.select(
        "urn", "start_year", F.round("share", 6).alias("share"), F.round("mean_balance", 4).alias("mean_balance"), F.round("runway", 6).alias("runway"),
        "streak", F.round("since_first", 4).alias("since_first"), "status",
    )


@C.query("q_status_by_year", _STATUS_SQL + "SELECT * FROM status")
def q_status_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standing of every school as of every year."""
    return _standing(spark, sf_dir)


@C.query("q_health_status", _STATUS_SQL + "SELECT * FROM status QUALIFY row_number() OVER (PARTITION BY urn ORDER BY start_year DESC) = 1")
def q_health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standing of every school as of its latest full year."""
    return panel.keep_last(_standing(spark, sf_dir), ["urn"], [F.col("start_year")])


@C.query(
    "q_recovered",
    _STATUS_SQL
    + """SELECT urn, CAST(count_if(status = 'in_deficit') AS BIGINT) AS years_in_deficit, arg_max(status, start_year) AS now FROM status
GROUP BY urn HAVING count_if(status = 'in_deficit') > 0 AND arg_max(status, start_year) IN ('healthy', 'large_reserves')""",
)
def q_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools once in deficit and healthy now."""
    g = _standing(spark, sf_dir).groupBy("urn").agg(
        F.count_if(F.col("status") == "in_deficit").alias("years_in_deficit"), F.max_by("status", "start_year").alias("now")
    )
    return g.where((F.col("years_in_deficit") > 0) & F.col("now").isin("healthy", "large_reserves"))


@C.query(
    "q_keep_last_per_period",
    "WITH " + RETURNS_SQL + "SELECT urn, period_end, source, total_income, CAST(loaded_at AS VARCHAR) AS loaded_at FROM returns",
)
def q_keep_last_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest load of every return."""
    return returns(spark, sf_dir).select("urn", "period_end", "source", "total_income", F.col("loaded_at").cast("string").alias("loaded_at"))


@C.query(
    "q_yoy_adjacent",
    "WITH "
    + RETURNS_SQL
    + """SELECT urn, start_year, CASE WHEN lag(start_year) OVER w = start_year - 1 THEN round(pupils - lag(pupils) OVER w, 4) END AS change
FROM full_years WHERE pupils IS NOT NULL WINDOW w AS (PARTITION BY urn ORDER BY start_year)""",
)
def q_yoy_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of pupils from the year before, where that year is there."""
    p = full_years(spark, sf_dir).where("pupils is not null")
    return panel.adjacent_change(p, ["urn"], "start_year", "pupils").select("urn", "start_year", F.round("change", 4).alias("change"))


@C.query(
    "q_falling_run",
    "WITH "
    + RETURNS_SQL
    + """, f AS (SELECT urn, start_year,
  lag(start_year, 1) OVER w = start_year - 1 AND lag(start_year, 2) OVER w = start_year - 2 AND lag(start_year, 3) OVER w = start_year - 3
  AND lag(pupils, 1) OVER w > pupils AND lag(pupils, 2) OVER w > lag(pupils, 1) OVER w AND lag(pupils, 3) OVER w > lag(pupils, 2) OVER w AS falling
FROM full_years WHERE pupils IS NOT NULL WINDOW w AS (PARTITION BY urn ORDER BY start_year))
SELECT urn, start_year FROM f WHERE falling""",
)
def q_falling_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """School years that end three adjacent falls of pupils in a row."""
    p = full_years(spark, sf_dir).where("pupils is not null")
    return panel.falling_run(p, ["urn"], "start_year", "pupils").where("falling").select("urn", "start_year")


@C.query(
    "q_trailing_streak",
    """WITH m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS spent FROM orders GROUP BY ALL),
f AS (SELECT *, spent < avg(spent) OVER (PARTITION BY o_custkey) AS low FROM m),
i AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY month DESC ROWS UNBOUNDED PRECEDING) AS broken FROM f)
SELECT o_custkey, CAST(count_if(broken = 0) AS BIGINT) AS streak FROM i GROUP BY o_custkey""",
)
def q_trailing_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each customer's latest run of months below their own mean."""
    from pyspark.sql import Window

    m = table(spark, sf_dir, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("spent"))
    m = m.withColumn("low", F.col("spent") < F.avg("spent").over(Window.partitionBy("o_custkey")))
    runs = panel.trailing_run(m, ["o_custkey"], "month", F.col("low"))
    return runs.groupBy("o_custkey").agg(F.max_by("streak", "month").alias("streak"))


@C.query(
    "q_real_terms",
    "WITH "
    + RETURNS_SQL
    + ", idx(year, i) AS (VALUES "
    + ", ".join(f"('{k}', {v})" for k, v in INDEX.items())
    + ") SELECT urn, period_end, round(total_income * 100 / i, 2) AS r_total_income, round(total_expenditure * 100 / i, 2) AS r_total_expenditure"
    " FROM returns LEFT JOIN idx USING (year)",
)
def q_real_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income and expenditure in prices of 2024-25."""
    r = panel.restated(returns(spark, sf_dir), "year", ["total_income", "total_expenditure"], INDEX)
    return r.select("urn", "period_end", *[F.round(f"r_{c}", 2).alias(f"r_{c}") for c in ("total_income", "total_expenditure")])


_SERIES = ["total_income", "total_expenditure", "revenue_reserve", "grant_funding", "sen_funding", "donations_revenue"]


@C.query(
    "q_series_unpivot",
    "WITH " + RETURNS_SQL + " UNPIVOT (SELECT urn, start_year, " + ", ".join(_SERIES) + " FROM full_years) ON " + ", ".join(_SERIES) + " INTO NAME metric VALUE value",
)
def q_series_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as one row per school, year and metric."""
    return panel.series(full_years(spark, sf_dir).select("urn", "start_year", *_SERIES), ["urn", "start_year"], _SERIES)


@C.query(
    "q_line_totals",
    """WITH e AS (SELECT source, CAST(left(year, 4) AS INTEGER) AS start_year, unnest(map_keys(lines)) AS code, unnest(map_values(lines)) AS amount FROM finance_history)
SELECT source, start_year, code, CAST(count(amount) AS BIGINT) AS n, round(sum(amount), 2) AS total FROM e GROUP BY ALL""",
)
def q_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every line code by source and year, over all loads."""
    start = F.substring("year", 1, 4).try_cast("int").alias("start_year")
    e = table(spark, sf_dir, "finance_history").select("source", start, F.explode("lines").alias("code", "amount"))
    return e.groupBy("source", "start_year", "code").agg(F.count("amount").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@C.query(
    "q_carry_forward",
    "WITH "
    + RETURNS_SQL
    + """, g AS (SELECT urn, CAST(y AS INTEGER) AS start_year FROM (SELECT DISTINCT urn FROM full_years), range(2017, 2025) r(y)),
c AS (SELECT urn, start_year, coalesce(pupils, lag(pupils) OVER (PARTITION BY urn ORDER BY start_year)) AS p
  FROM g LEFT JOIN full_years USING (urn, start_year))
SELECT start_year, CAST(count(p) AS BIGINT) AS schools, round(sum(p), 2) AS pupils FROM c GROUP BY start_year""",
)
def q_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pupils per year, a school that is missing one year counted with the year before."""
    c = panel.carried(full_years(spark, sf_dir), ["urn"], "start_year", "pupils", 2017, 2024)
    return c.groupBy("start_year").agg(F.count("carried").alias("schools"), F.round(F.sum("carried"), 2).alias("pupils"))


@C.query(
    "q_zero_column_guard",
    """WITH t AS (SELECT max(abs(l_tax)) AS a, max(abs(l_discount * 0)) AS b FROM lineitem)
SELECT l_returnflag, CAST(count(CASE WHEN a <> 0 THEN l_tax END) AS BIGINT) AS tax_known,
  CAST(count(CASE WHEN b <> 0 THEN l_discount * 0 END) AS BIGINT) AS nothing_known, 'nothing' AS suspect FROM lineitem, t GROUP BY l_returnflag""",
)
def q_zero_column_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is zero throughout becomes unknown and is named."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_tax").alias("tax"), (F.col("l_discount") * 0).alias("nothing"))
    g = panel.null_empty_columns(li, ["tax", "nothing"])
    return g.groupBy("l_returnflag").agg(
        F.count("tax").alias("tax_known"), F.count("nothing").alias("nothing_known"), F.max(F.array_join("suspect", ",")).alias("suspect")
    )


@C.query(
    "q_merge_split_entities",
    """SELECT l_orderkey, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS quantity,
  arg_max(l_linestatus, (l_shipdate, l_linestatus, l_returnflag)) AS l_linestatus, arg_max(l_returnflag, (l_shipdate, l_linestatus, l_returnflag)) AS l_returnflag,
  array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, CAST(count(*) AS BIGINT) AS parts FROM lineitem GROUP BY l_orderkey""",
)
def q_merge_split_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as one row: sums, fields of the last shipped line, set of flags."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), "l_linestatus", "l_returnflag", "l_shipdate",
        F.array("l_returnflag").alias("flags"),
    )
    m = panel.merge_split(li, ["l_orderkey"], ["price", "quantity"], ["l_linestatus", "l_returnflag"], "l_shipdate", ["flags"])
    return m.withColumns({"price": F.round("price", 2), "quantity": F.round("quantity", 2), "flags": F.array_join("flags", ",")})


@C.query(
    "q_trend",
    "WITH "
    + RETURNS_SQL
    + """, l AS (SELECT urn, start_year, pupils FROM full_years WHERE pupils IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY urn ORDER BY start_year DESC) <= 3)
SELECT urn, string_agg(start_year || ':' || CAST(round(pupils * 10) AS BIGINT), ' ' ORDER BY start_year) AS trend FROM l GROUP BY urn""",
)
def q_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pupils of the last three known years, oldest first."""
    t = panel.trend(full_years(spark, sf_dir), ["urn"], "start_year", "pupils")
    one = lambda x: F.concat(x["start_year"].cast("string"), F.lit(":"), F.round(x["pupils"] * 10).cast("long").cast("string"))
    return t.select("urn", F.array_join(F.transform("trend", one), " ").alias("trend"))


# --- areas ------------------------------------------------------------------------------------------------------------


@C.query(
    "q_grouping_sets",
    "WITH "
    + RETURNS_SQL
    + """SELECT CASE WHEN grouping(la) = 1 THEN 'all' ELSE CAST(la AS VARCHAR) END AS la, CASE WHEN grouping(phase) = 1 THEN 'all' ELSE phase END AS phase,
  round(sum(total_income) / nullif(sum(pupils), 0), 4) AS per_pupil, CAST(count(*) AS BIGINT) AS n
FROM full_years WHERE start_year = 2023 GROUP BY GROUPING SETS ((), (phase), (la), (la, phase))""",
)
def q_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income per pupil of England and every authority, of each phase and all."""
    y = full_years(spark, sf_dir).where("start_year = 2023")
    g = area.ratio_of_sums(y, [[], ["phase"], ["la"], ["la", "phase"]], "total_income", "pupils", "per_pupil")
    return g.withColumn("per_pupil", F.round("per_pupil", 4))


@C.query(
    "q_area_summary",
    "WITH "
    + RETURNS_SQL
    + """, m AS (
  SELECT 'country' AS kind, 'all' AS area, * FROM full_years
  UNION ALL SELECT 'authority', CAST(la AS VARCHAR), * FROM full_years WHERE la IS NOT NULL
  UNION ALL SELECT 'phase', phase, * FROM full_years WHERE phase IS NOT NULL
  UNION ALL SELECT 'trust', trust, * FROM full_years WHERE trust IS NOT NULL)
SELECT kind, area, start_year, CAST(count(*) AS BIGINT) AS schools,
  CASE WHEN count(*) >= 5 THEN CAST(count_if(reserve < 0) AS BIGINT) END AS in_deficit,
  CASE WHEN count(*) >= 5 THEN round(median(reserve), 4) END AS median_reserve,
  CASE WHEN count(*) >= 5 THEN round(median(total_income / nullif(pupils, 0)), 4) END AS median_per_pupil,
  CASE WHEN count(*) >= 5 THEN round(sum(CASE WHEN reserve < 0 THEN -reserve END), 2) END AS owed
FROM m GROUP BY kind, area, start_year""",
)
def q_area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and exact medians of four hierarchies at once; statistics of fewer than five schools are withheld."""
    kinds = {"country": F.lit("all"), "authority": F.col("la"), "phase": F.col("phase"), "trust": F.col("trust")}
    slim = full_years(spark, sf_dir).select("la", "phase", "trust", "start_year", "reserve", "total_income", "pupils")
    m = area.by_memberships(slim, kinds)
    n = F.count(F.lit(1))
    return m.groupBy("kind", "area", "start_year").agg(
        n.alias("schools"),
        area.withheld(F.count_if(F.col("reserve") < 0), n).alias("in_deficit"),
        area.withheld(F.round(F.median("reserve"), 4), n).alias("median_reserve"),
        area.withheld(F.round(F.median(F.try_divide("total_income", "pupils")), 4), n).alias("median_per_pupil"),
        area.withheld(F.round(F.sum(F.when(F.col("reserve") < 0, -F.col("reserve"))), 2), n).alias("owed"),
    )


@C.query(
    "q_exclusive_quartiles",
    """WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i,
  count(*) OVER (PARTITION BY p_brand) AS n FROM part),
k AS (SELECT p_brand, n, q, CAST(q AS DOUBLE) * (n + 1) / 4 AS pos, greatest(1, least(CAST(floor(CAST(q AS DOUBLE) * (n + 1) / 4) AS INTEGER), n - 1)) AS a
  FROM (SELECT DISTINCT p_brand, n FROM r), (VALUES (1), (2), (3)) t(q)),
c AS (SELECT k.p_brand, k.n, k.q, lo.v + (hi.v - lo.v) * (pos - a) AS v FROM k JOIN r lo ON lo.p_brand = k.p_brand AND lo.i = a
  JOIN r hi ON hi.p_brand = k.p_brand AND hi.i = a + 1)
SELECT p_brand, CAST(n AS BIGINT) AS n, round(max(CASE WHEN q = 1 THEN v END), 6) AS q1, round(max(CASE WHEN q = 2 THEN v END), 6) AS q2,
  round(max(CASE WHEN q = 3 THEN v END), 6) AS q3 FROM c GROUP BY p_brand, n""",
)
def q_exclusive_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of prices per brand by the exclusive method."""
    q = area.exclusive_quartiles(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")
    return q.select("p_brand", F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")])


@C.query(
    "q_fraction_below",
    """SELECT s_suppkey, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) >= 3 THEN round((rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) - 1)
  / (count(*) OVER (PARTITION BY s_nationkey) - 1), 6) END AS below FROM supplier WHERE s_acctbal IS NOT NULL""",
)
def q_fraction_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a nation's other suppliers with a lower balance."""
    f = area.fraction_below(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", least=3)
    return f.select("s_suppkey", F.round("below", 6).alias("below"))


@C.query(
    "q_avg_rank_band",
    """WITH m AS (SELECT c_custkey, c_nationkey, c_acctbal, CAST(count(o_orderkey) AS BIGINT) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
r AS (SELECT *, (rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2
  + rank() OVER (PARTITION BY c_nationkey ORDER BY orders) + (count(*) OVER (PARTITION BY c_nationkey, orders) - 1) / 2) / 2 AS mean_rank FROM m),
i AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY mean_rank, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM r),
c AS (SELECT c_nationkey, b, max(CASE WHEN i = floor(n * b / 5) THEN mean_rank END) AS cut FROM i, (VALUES (1), (2), (3), (4)) t(b) GROUP BY ALL)
SELECT c_custkey, round(mean_rank, 4) AS mean_rank, CAST(1 + count_if(mean_rank >= cut) AS INTEGER) AS band
FROM i JOIN c USING (c_nationkey) GROUP BY c_custkey, mean_rank""",
)
def q_avg_rank_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quintile of each customer within the nation by the mean of two ranks."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    m = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(o, "c_custkey", "left").fillna(0, ["orders"])
    b = area.rank_bands(m, ["c_nationkey"], "c_custkey", ["c_acctbal", "orders"])
    return b.select("c_custkey", F.round("mean_rank", 4).alias("mean_rank"), F.col("band").cast("int").alias("band"))


@C.query(
    "q_quantile_bins",
    """WITH s AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part),
cuts AS (SELECT DISTINCT v AS cut FROM s, (VALUES (1), (2), (3), (4), (5)) t(b) WHERE i = b * n // 6)
SELECT p_brand, CAST((SELECT count(*) FROM cuts WHERE cut <= p_retailprice) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL""",
)
def q_quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand by price bin; the bins are cut at six even places of all prices."""
    part = table(spark, sf_dir, "part")
    cuts = area.quantile_bins(part, "p_retailprice", 6)
    b = part.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("p_retailprice"))).cast("long"))
    return b.groupBy("p_brand", "bin").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    "q_majority_vote",
    """SELECT c_nationkey, o_orderpriority AS mode, CAST(count(*) AS BIGINT) AS votes FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, o_orderpriority) = 1""",
)
def q_majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest order priority of each nation."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return area.majority(o, ["c_nationkey"], "o_orderpriority")


@C.query(
    "q_bbox_index",
    """SELECT la_code, CAST(count(*) AS BIGINT) AS schools, CAST(count_if(lower(trim(status)) = 'open') AS BIGINT) AS open_schools,
  CAST(min(open_date) AS VARCHAR) AS first_open, CAST(max(open_date) AS VARCHAR) AS last_open, array_to_string(list_sort(list_distinct(list(phase))), ',') AS phases
FROM establishment GROUP BY la_code""",
)
def q_bbox_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of authorities: counts, conditional counts, extremes, distinct phases."""
    return table(spark, sf_dir, "establishment").groupBy("la_code").agg(
        F.count(F.lit(1)).alias("schools"), F.count_if(F.lower(F.trim("status")) == "open").alias("open_schools"),
        F.min("open_date").cast("string").alias("first_open"), F.max("open_date").cast("string").alias("last_open"),
        F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("phases"),
    )


@C.query(
    "q_argmax_share",
    """WITH s AS (SELECT l_partkey, l_suppkey, round(sum(l_extendedprice), 2) AS sold FROM lineitem GROUP BY ALL)
SELECT l_partkey, arg_max(l_suppkey, (sold, -l_suppkey)) AS top_supplier, round(max(sold) / sum(sold), 6) AS top_share, CAST(count(*) AS BIGINT) AS suppliers FROM s GROUP BY l_partkey""",
)
def q_argmax_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier that sold most of each part, and its share."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("sold"))
    return s.groupBy("l_partkey").agg(
        F.max_by("l_suppkey", F.struct("sold", -F.col("l_suppkey"))).alias("top_supplier"),
        F.round(F.max("sold") / F.sum("sold"), 6).alias("top_share"), F.count(F.lit(1)).alias("suppliers"),
    )


@C.query(
    "q_latest_snapshot",
    """SELECT phase, CAST(count(DISTINCT urn) AS BIGINT) AS schools FROM establishment_snapshot
WHERE snapshot_date = (SELECT max(snapshot_date) FROM establishment_snapshot) GROUP BY phase""",
)
def q_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools by phase in the latest extract."""
    last = merge.latest_period(table(spark, sf_dir, "establishment_snapshot").select("snapshot_date", "urn", "phase"), "snapshot_date")
    return last.groupBy("phase").agg(F.count_distinct("urn").alias("schools"))


@C.query(
    "q_prior_year_fallback",
    "WITH "
    + RETURNS_SQL
    + """, y AS (SELECT urn, start_year, sen_funding AS v, lag(start_year) OVER w AS y1, lag(sen_funding) OVER w AS v1, lag(start_year, 2) OVER w AS y2,
  lag(sen_funding, 2) OVER w AS v2 FROM full_years WINDOW w AS (PARTITION BY urn ORDER BY start_year))
SELECT urn, start_year, CASE WHEN v IS NOT NULL THEN v WHEN y1 = start_year - 1 AND v1 IS NOT NULL THEN v1
    WHEN y1 = start_year - 2 AND v1 IS NOT NULL THEN v1 WHEN y2 = start_year - 2 AND v2 IS NOT NULL THEN v2 END AS sen_funding_known,
  CASE WHEN v IS NOT NULL THEN start_year WHEN y1 = start_year - 1 AND v1 IS NOT NULL THEN y1
    WHEN y1 = start_year - 2 AND v1 IS NOT NULL THEN y1 WHEN y2 = start_year - 2 AND v2 IS NOT NULL THEN y2 END AS sen_funding_year FROM y""",
)
def q_prior_year_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing figure from up to two years before, with the year it is from."""
    f = joins.with_earlier(full_years(spark, sf_dir), ["urn"], "start_year", "sen_funding", 2)
    return f.select("urn", "start_year", "sen_funding_known", "sen_funding_year")


@C.query(
    "q_label_coverage",
    "WITH " + RETURNS_SQL + """SELECT source, start_year, CAST(count(*) AS BIGINT) AS rows, CAST(count(pupils) AS BIGINT) AS pupils_known,
  CAST(count(trust) AS BIGINT) AS trust_known, CAST(count(suspect) AS BIGINT) AS suspect_known FROM returns GROUP BY ALL""",
)
def q_label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many returns of each source and year know each field."""
    return merge.coverage(returns(spark, sf_dir), ["source", "start_year"], ["pupils", "trust", "suspect"])


@C.query(
    "q_chunk_pages",
    "SELECT CAST((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 4500 AS BIGINT) AS chunk, o_orderkey FROM orders",
)
def q_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by price in chunks of 4,500."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return order.chunks(o, [F.col("o_totalprice"), F.col("o_orderkey")], 4500).select("chunk", "o_orderkey")


@C.query(
    "q_greedy_paging",
    """WITH RECURSIVE p AS (SELECT p_brand, p_partkey, len(p_name) AS chars, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
r(p_brand, i, p_partkey, page, used) AS (SELECT p_brand, i, p_partkey, CAST(0 AS BIGINT), chars FROM p WHERE i = 1 UNION ALL
  SELECT p.p_brand, p.i, p.p_partkey, CASE WHEN r.used > 0 AND r.used + p.chars > CASE WHEN r.page = 0 THEN 120 ELSE 200 END THEN r.page + 1 ELSE r.page END,
    CASE WHEN r.used > 0 AND r.used + p.chars > CASE WHEN r.page = 0 THEN 120 ELSE 200 END THEN p.chars ELSE r.used + p.chars END FROM r JOIN p ON p.p_brand = r.p_brand AND p.i = r.i + 1)
SELECT p_brand, p_partkey, page FROM r""",
)
def q_greedy_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand on pages of at most 200 characters of names, 120 on the first."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.length("p_name").alias("chars"))
    return order.greedy_pages(p, ["p_brand"], "p_partkey", "chars", 120, 200).select("p_brand", "p_partkey", "page")
