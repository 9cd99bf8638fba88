"""Entity-year panels: which rows count, runs and streaks, status as of every year, carried and restated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per ``keys``: the last by ``order`` (nulls first), a total order deciding ties as its last columns say."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trailing_run(df: DataFrame, keys: list[str], order: str, flag: Column, out: str = "streak") -> DataFrame:
    """For every row the number of rows up to and with it for which ``flag`` held without a break (null breaks)."""
    w = Window.partitionBy(*keys).orderBy(order)
    hit = F.coalesce(flag, F.lit(False))
    island = F.sum(F.when(hit, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_hit", hit.cast("int")).withColumn("_island", island)
    inner = Window.partitionBy(*keys, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum("_hit").over(inner).cast("long")).drop("_hit", "_island")


def adjacent_change(df: DataFrame, keys: list[str], year: str, value: str, out: str = "change") -> DataFrame:
    """The change of ``value`` from the year before; null where that year is missing."""
    w = Window.partitionBy(*keys).orderBy(year)
    return df.withColumn(out, F.when(F.lag(year).over(w) == F.col(year) - 1, F.col(value) - F.lag(value).over(w)))


def falling_run(df: DataFrame, keys: list[str], year: str, value: str, steps: int = 3, out: str = "falling") -> DataFrame:
    """Whether ``value`` fell strictly in each of the last ``steps`` adjacent years."""
    w = Window.partitionBy(*keys).orderBy(year)
    ok = F.lit(True)
    for i in range(1, steps + 1):
        before, was = F.lag(year, i).over(w), F.lag(value, i).over(w)
        now = F.col(value) if i == 1 else F.lag(value, i - 1).over(w)
        ok = ok & (before == F.col(year) - i) & (now < was)
    return df.withColumn(out, F.coalesce(ok, F.lit(False)))


def carried(df: DataFrame, keys: list[str], year: str, value: str, first: int, last: int, out: str = "carried") -> DataFrame:
    """Every key with every year from ``first`` to ``last``; a missing value is that of the year before, one step only."""
    years = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(year))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(years))  # a fixed number of years for each key
    w = Window.partitionBy(*keys).orderBy(year)
    full = grid.join(df.select(*keys, year, value), [*keys, year], "left")
    return full.withColumn(out, F.coalesce(F.col(value), F.lag(value).over(w)))


def null_empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A measure that is zero or null in every row was not collected: null it and name it in ``suspect``."""
    top = df.agg(*[F.max(F.abs(F.coalesce(F.col(c), F.lit(0.0)))).alias(f"_{c}") for c in columns])
    df = df.crossJoin(F.broadcast(top))  # one row
    bad = F.array_compact(F.array(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in columns]))
    cols = {c: F.when(F.col(f"_{c}") != 0, F.col(c)) for c in columns}
    return df.withColumn("suspect", bad).withColumns(cols).drop(*[f"_{c}" for c in columns])


def status_by_year(
    df: DataFrame, keys: list[str], year: str, *, reserve: str, income: str, balance: str, tight: float = 0.03, large: float = 0.08, runway: float = 3.0
) -> DataFrame:
    """For every row the standing as of that row: share of reserve in income, mean of the last three balances, years the
    reserve lasts at that rate, trailing run of negative balances, change of the reserve since the first row, and a class.

    Windows end at each row, so the standing as of all years costs one sort.  A missing balance counts as 0.
    """
    w = Window.partitionBy(*keys).orderBy(year)
    b = F.coalesce(F.col(balance), F.lit(0.0))
    df = trailing_run(df, keys, year, b < 0)
    mean3 = F.avg(b).over(w.rowsBetween(-2, 0))
    df = df.withColumn("share", F.try_divide(F.col(reserve), F.col(income))).withColumn("mean_balance", mean3)
    df = df.withColumn("runway", F.when((F.col("mean_balance") < 0) & (F.col(reserve) >= 0), F.col(reserve) / -F.col("mean_balance")))
    first = F.first_value(reserve, ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("since_first", F.col(reserve) - first)
    kind = (
        F.when(F.col(reserve) < 0, "in_deficit")
        .when(F.col("runway") <= runway, "heading_for_deficit")
        .when(F.col("share") < tight, "tight")
        .when(F.col("share") >= large, "large_reserves")
        .otherwise("healthy")
    )
    return df.withColumn("status", kind)


def restated(df: DataFrame, year: str, values: list[str], index: dict[str, float], base: float = 100.0) -> DataFrame:
    """Values restated by a price index: ``r_<value>`` is value * base / index of the year; null for a year without index."""
    rows = [(k, float(v)) for k, v in index.items()]
    dim = df.sparkSession.createDataFrame(rows, "_year string, _index double")
    df = df.join(F.broadcast(dim), F.col(year) == F.col("_year"), "left")  # as many rows as the index has years
    return df.withColumns({f"r_{v}": F.col(v) * base / F.col("_index") for v in values}).drop("_year", "_index")


def series(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A panel as (keys, metric, value), nulls left out."""
    return df.unpivot(keys, measures, "metric", "value").where("value is not null")


def merge_split(df: DataFrame, keys: list[str], sums: list[str], latest: list[str], by: str, sets: list[str]) -> DataFrame:
    """Parts of one entity-year as one row: sums of what is known, descriptive fields of the latest part, union of sets."""
    order = F.struct(F.col(by), *[F.col(c) for c in latest])
    return df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, order).alias(c) for c in latest],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets],
        F.count(F.lit(1)).alias("parts"),
    )


def trend(df: DataFrame, keys: list[str], year: str, value: str, length: int = 3) -> DataFrame:
    """Per key the last ``length`` known (year, value), oldest first."""
    w = Window.partitionBy(*keys).orderBy(F.col(year).desc())
    last = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= length)
    return last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(year, value))).alias("trend"))


def change_since(df: DataFrame, keys: list[str], year: str, value: str, base: int, out: str = "change_pct") -> DataFrame:
    """The change of ``value`` in % since the year ``base``; null where that year is missing, null or 0."""
    w = Window.partitionBy(*keys)
    start = F.max(F.when(F.col(year) == base, F.col(value))).over(w)
    return df.withColumn(out, F.try_divide((F.col(value) - start) * 100.0, start))


def latest_number(df: DataFrame, keys: list[str], year: str, text: str, most: float | None = None) -> DataFrame:
    """Per key the number in the latest year that has one, and that year; a number beyond ``most`` comes out as null."""
    from tallyhouse.functions.text import human_number

    n = df.withColumn("_v", human_number(F.col(text))).where("_v is not null").groupBy(*keys).agg(F.max_by(F.struct("_v", year), year).alias("_r"))
    v = F.col("_r._v")
    return n.select(*keys, F.col(f"_r.{year}").alias(year), (v if most is None else F.when(v <= most, v)).alias("value"))


def drop_repeats(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Rows whose values differ from those of the row before; the first of a key always stays."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values)) & (F.row_number().over(w) > 1)
    return df.withColumn("_same", same).where(~F.col("_same")).drop("_same")


def lagged_cohorts(df: DataFrame, keys: list[str], columns: dict[int, str], year: Column, out: str = "trend") -> DataFrame:
    """Wide columns of earlier cohorts (lag in years -> column) as one array of (year, value), oldest first, nulls left out."""
    points = F.array(*[F.struct((year - lag).cast("int").alias("year"), F.col(c).cast("double").alias("value")) for lag, c in columns.items()])
    return df.select(*keys, F.array_sort(F.filter(points, lambda p: p["value"].isNotNull())).alias(out))


def standing(last_year: Column, now: int, recent: int = 2) -> Column:
    """current, recent (within ``recent`` years) or historical, by the last year seen; null of null."""
    return F.when(last_year >= now, "current").when(last_year >= now - recent, "recent").when(last_year.isNotNull(), "historical")


def latest_known(df: DataFrame, keys: list[str], year: str, values: list[str]) -> DataFrame:
    """Per key each value of the latest year in which it is known."""
    return df.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(year))).alias(v) for v in values])
