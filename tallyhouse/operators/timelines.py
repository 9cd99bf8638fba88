"""Entity timelines: wide snapshots to events, latest and previous, forward projection, step windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def events_from_wide(sources: list[tuple[int, DataFrame, list[dict[str, str]]]], key: str) -> DataFrame:
    """(key, number, kind, date, outcome): events written side by side in wide tables, each once.

    ``sources``: (priority, table, blocks), a block naming the columns of one event: number, kind (a literal), date,
    outcome.  An event number that several blocks hold is taken from the first priority, then the first block.
    """
    parts = None
    for priority, df, blocks in sources:
        entries = F.array(*[
            F.struct(
                F.lit(i).alias("_b"), F.col(b["number"]).cast("string").alias("number"), F.lit(b["kind"]).alias("kind"),
                F.col(b["date"]).cast("date").alias("date"), F.col(b["outcome"]).cast("string").alias("outcome"),
            ) for i, b in enumerate(blocks)
        ])
        one = df.select(key, F.lit(priority).alias("_p"), F.explode(entries).alias("e")).select(key, "_p", "e.*")
        parts = one if parts is None else parts.unionByName(one)
    w = Window.partitionBy(key, "number").orderBy("_p", "_b", F.col("date").desc_nulls_last(), F.col("outcome"))
    return parts.where("number is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p", "_b")


def latest_and_previous(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Per key the latest and the one before as structs, and the number of events."""
    w = Window.partitionBy(key).orderBy(*order)
    e = events.withColumn("_n", F.row_number().over(w))
    whole = F.struct(*[c for c in events.columns if c != key])
    return e.groupBy(key).agg(
        F.max(F.when(F.col("_n") == 1, whole)).alias("latest"), F.max(F.when(F.col("_n") == 2, whole)).alias("previous"), F.count(F.lit(1)).alias("events")
    )


def count_since(events: DataFrame, key: str, at: str, marks: Column, counted: Column) -> DataFrame:
    """How many ``counted`` events came after the last event that ``marks``; null for keys without any mark."""
    last = events.where(marks).groupBy(key).agg(F.max(at).alias("_m"))
    after = F.count_if(counted & (F.col(at) > F.col("_m")))
    return events.join(last, key, "left").groupBy(key).agg(F.when(F.max("_m").isNotNull(), after).alias("since"))


def projected(df: DataFrame, keys: list[str], year: str, balance: str, override: str, start: str, out: str = "reserve") -> DataFrame:
    """A stock carried forward: start plus running sum of balances, restarted at every row whose ``override`` is given."""
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_g", F.count(override).over(w))
    inner = Window.partitionBy(*keys, "_g").orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    given = F.first(override).over(inner)
    add = F.sum(F.when(F.col(override).isNull(), F.coalesce(F.col(balance), F.lit(0.0))).otherwise(0.0)).over(inner)
    return df.withColumn(out, F.coalesce(given, F.col(start)) + add).drop("_g")


def step_windows(steps: DataFrame, keys: list[str], start: str, now: Column) -> DataFrame:
    """Each step with its end (the start of the next, open for the last) and whether it holds at ``now``."""
    w = Window.partitionBy(*keys).orderBy(start)
    s = steps.withColumn("until", F.lead(start).over(w))
    return s.withColumn("current", (F.col(start) <= now) & (F.col("until").isNull() | (now < F.col("until"))))


def trusted_span(df: DataFrame, keys: list[str], year: str, value: str, suspect: Column) -> DataFrame:
    """First and latest value that isn't suspect, with their years and the change between them."""
    ok = df.where(F.col(value).isNotNull() & ~F.coalesce(suspect, F.lit(False)))
    pair = F.struct(year, value)
    g = ok.groupBy(*keys).agg(F.min_by(pair, year).alias("_f"), F.max_by(pair, year).alias("_l"))
    return g.select(
        *keys, F.col(f"_f.{year}").alias("first_year"), F.col(f"_f.{value}").alias("first_value"), F.col(f"_l.{year}").alias("last_year"),
        F.col(f"_l.{value}").alias("last_value"), (F.col(f"_l.{value}") - F.col(f"_f.{value}")).alias("change"),
    )


def well_covered_year(df: DataFrame, year: str, value: str, least: float = 0.6) -> DataFrame:
    """The newest year with at least ``least`` of the best year's known values, and that number (one row)."""
    n = df.groupBy(year).agg(F.count(value).alias("known"))
    top = n.agg(F.max("known").alias("_t"))
    return n.join(F.broadcast(top)).where(F.col("known") >= F.col("_t") * least).agg(F.max_by(F.struct(year, "known"), year).alias("y")).select("y.*")
