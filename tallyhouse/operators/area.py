"""Summaries of areas: grouping sets, several hierarchies at once, small groups withheld, quartiles, ranks, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio_of_sums(df: DataFrame, sets: list[list[str]], top: str, bottom: str, out: str) -> DataFrame:
    """sum(top) / sum(bottom) for each grouping set, in one aggregation; columns outside a set are 'all'."""
    keys = sorted({c for s in sets for c in s})
    agg = df.groupingSets(sets, *keys).agg(
        *[F.grouping(k).alias(f"_{k}") for k in keys], F.try_divide(F.sum(top), F.sum(bottom)).alias(out), F.count(F.lit(1)).alias("n")
    )
    cols = [F.when(F.col(f"_{k}") == 1, F.lit("all")).otherwise(F.col(k).cast("string")).alias(k) for k in keys]
    return agg.select(*cols, out, "n")


def by_memberships(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Each row once for every area it lies in: columns ``kind`` and ``area``; a null area is no membership."""
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("area")) for k, c in kinds.items()])
    return df.withColumn("_m", F.explode(entries)).select("*", "_m.kind", "_m.area").drop("_m").where("area is not null")


def withheld(value: Column, n: Column, least: int = 5) -> Column:
    """A statistic of ``n`` entities, null where they are fewer than ``least``."""
    return F.when(n >= least, value)


def exclusive_quantile(xs: Column, k: int, parts: int = 4) -> Column:
    """The k-th of ``parts`` - 1 cut points by the exclusive method: position k (n + 1) / parts, interpolated, of a sorted array."""
    n = F.size(xs)
    pos = F.lit(k) * (n + 1) / F.lit(parts)
    at = F.greatest(F.lit(1), F.least(F.floor(pos).cast("int"), n - 1))
    return F.when(n >= 2, F.element_at(xs, at) + (F.element_at(xs, at + 1) - F.element_at(xs, at)) * (pos - at))


def exclusive_quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """q1, q2, q3 by the exclusive method; null for groups of one.

    The neighbours of the three positions are picked from ranked rows, so no group is gathered into one array.
    """
    w = Window.partitionBy(*keys)
    r = df.where(F.col(value).isNotNull()).select(*keys, value)
    r = r.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(w))
    picks = []
    for k in (1, 2, 3):
        pos = F.lit(k) * (F.col("n") + 1) / 4
        at = F.greatest(F.lit(1), F.least(F.floor(pos).cast("int"), F.col("n") - 1))
        lo, hi = F.max(F.when(F.col("_i") == at, F.col(value))), F.max(F.when(F.col("_i") == at + 1, F.col(value)))
        picks.append((lo + (hi - lo) * F.max(pos - at)).alias(f"q{k}"))
    return r.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def fraction_below(df: DataFrame, keys: list[str], value: str, least: int = 10, out: str = "below") -> DataFrame:
    """Share of the other members of the group that lie strictly below; null in groups of fewer than ``least``."""
    w = Window.partitionBy(*keys)
    below, n = F.rank().over(w.orderBy(value)) - 1, F.count(value).over(w)
    return df.where(F.col(value).isNotNull()).withColumn(out, F.when(n >= least, below / (n - 1)))


def average_rank(keys: list[str], value: str) -> Column:
    """Rank where ties share the mean of their places."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2


def rank_bands(df: DataFrame, keys: list[str], ident: str, measures: list[str], bands: int = 5) -> DataFrame:
    """Mean of average-tie ranks of several measures, cut into ``bands`` at the values at index floor(n * b / bands)."""
    for i, m in enumerate(measures):
        df = df.withColumn(f"_r{i}", average_rank(keys, m))
    df = df.withColumn("mean_rank", sum((F.col(f"_r{i}") for i in range(len(measures))), F.lit(0.0)) / len(measures))
    w = Window.partitionBy(*keys)
    df = df.withColumn("_i", F.row_number().over(w.orderBy("mean_rank", ident)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    cuts = [F.max(F.when(F.col("_i") == F.floor(F.col("_n") * b / bands), F.col("mean_rank"))).over(w) for b in range(1, bands)]
    for b, c in enumerate(cuts):
        df = df.withColumn(f"_c{b}", c)
    band = sum(((F.col("mean_rank") >= F.col(f"_c{b}")).cast("int") for b in range(bands - 1)), F.lit(1))
    return df.withColumn("band", band).drop("_i", "_n", *[f"_r{i}" for i in range(len(measures))], *[f"_c{b}" for b in range(bands - 1)])


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Distinct cut values at index floor(i * n / bins) of the sorted values (one row: array ``cuts``)."""
    r = df.where(F.col(value).isNotNull()).select(value)
    n = r.count()
    wanted = {int(i * n // bins) for i in range(1, bins)}
    # The index of a value: counts per distinct value, summed in two steps over ranges, never in one unordered task.
    from tallyhouse.operators.order import with_rank

    ranked = with_rank(r, [F.col(value)], "_i")
    return ranked.where(F.col("_i").isin(sorted(wanted))).agg(F.array_sort(F.collect_set(value)).alias("cuts"))


def majority(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """The commonest value per group; of equally common ones the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), F.col(value))
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, F.col(value).alias(out), F.col("_n").alias("votes"))


def place_index(df: DataFrame, keys: list[str], lat: str, lon: str, code: str, counted: dict[str, Column], pad: float = 0.01) -> DataFrame:
    """Index of areas: rows, conditional counts, padded bounding box, middle of the points, distinct codes in order.

    Rows without a position count but play no part in box and middle."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counted.items()],
        (F.min(lat) - pad).alias("south"), (F.max(lat) + pad).alias("north"), (F.min(lon) - pad).alias("west"), (F.max(lon) + pad).alias("east"),
        F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.array_sort(F.collect_set(code)).alias("codes"),
    )


def major_groups(df: DataFrame, groups: dict[str, list[str]], base: str | None = None) -> DataFrame:
    """Fine figures rolled up to major groups: null only where all parts are null; with ``base`` also the share of it in %."""
    out = df
    for name, parts in groups.items():
        known = F.coalesce(*[F.col(p) for p in parts]).isNotNull()
        out = out.withColumn(name, F.when(known, sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))))
        if base:
            out = out.withColumn(f"{name}_pct", F.try_divide(F.col(name) * 100.0, F.col(base)))
    return out


def banded(value: Column, edges: list[float]) -> Column:
    """The number of edges that a value reaches; null of null."""
    return F.when(value.isNotNull(), sum(((value >= e).cast("int") for e in edges), F.lit(0)))


def band_summary(df: DataFrame, band: Column, entity: str, value: str) -> DataFrame:
    """Per band distinct entities, and sum, mean and median of the value."""
    return df.groupBy(band.alias("band")).agg(
        F.count_distinct(entity).alias("entities"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.median(value).alias("median")
    )


def yearly_deficits(df: DataFrame, year: str, reserve: str, kinds: dict[str, Column]) -> DataFrame:
    """Per year and membership: how many are in deficit, of how many, what they owe together, the largest and median debt."""
    debt = F.when(F.col(reserve) < 0, -F.col(reserve))
    return by_memberships(df.withColumn("_debt", debt), kinds).groupBy("kind", "area", year).agg(
        F.count(reserve).alias("members"), F.count("_debt").alias("in_deficit"), F.sum("_debt").alias("owed"), F.max("_debt").alias("largest"), F.median("_debt").alias("median_debt")
    )


def exact_sum(value: Column, scale: int = 10) -> Column:
    """A sum of doubles that doesn't depend on their order: added up as decimals of ``scale`` places, rounded once."""
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def histogram(df: DataFrame, keys: list[str], grade: str, severity: list[str]) -> DataFrame:
    """(keys, histogram: array of (place, grade, n) in the order of severity, headline: the gravest grade that occurs)."""
    place = F.array_position(F.array(*[F.lit(g) for g in severity]), F.col(grade)).cast("int")
    n = df.where(F.col(grade).isNotNull()).groupBy(*keys, place.alias("place"), grade).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.when(F.col("place") == 0, len(severity) + 1).otherwise(F.col("place")).alias("place"), F.col(grade).alias("grade"), "n"))).alias("histogram")
    ).withColumn("headline", F.col("histogram")[0]["grade"])
