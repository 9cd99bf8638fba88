"""Chances from past cut-offs: weighted survival curves, their inverse, ranked choices, waiting lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decay_weight(age: Column, decay: float = 0.75) -> Column:
    return F.pow(F.lit(decay), age)


def survival_curve(df: DataFrame, keys: list[str], cutoff: str, weight: str) -> DataFrame:
    """(keys, cutoff, chance): weighted share of samples whose cut-off reaches at least as far, at every cut-off.

    An infinite cut-off (everyone was reached) counts towards every distance.
    """
    g = df.where(F.col(cutoff).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, cutoff).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    reach = F.sum("_w").over(w.orderBy(F.col(cutoff).desc()))
    return g.select(*keys, cutoff, (reach / F.sum("_w").over(w)).alias("chance"))


def survival_at(df: DataFrame, keys: list[str], cutoff: str, weight: str, points: list[float]) -> DataFrame:
    """(keys, point, chance): the curve's value at given distances, in one aggregation."""
    total = F.sum(weight)
    hits = [F.struct(F.lit(float(p)).alias("point"), (F.sum(F.when(F.col(cutoff) >= p, F.col(weight)).otherwise(0.0)) / total).alias("chance")) for p in points]
    g = df.where(F.col(cutoff).isNotNull() & (F.col(weight) > 0)).groupBy(*keys).agg(F.array(*hits).alias("_a"))
    return g.select(*keys, F.inline("_a"))


def distance_for(curve: DataFrame, keys: list[str], cutoff: str, chance: float) -> DataFrame:
    """The furthest finite cut-off whose chance is still ``chance`` or more."""
    ok = (F.col("chance") >= chance - 1e-9) & (F.col(cutoff) < float("inf"))
    return curve.where(ok).groupBy(*keys).agg(F.max(cutoff).alias("distance"))


def ranked_choices(df: DataFrame, keys: list[str], order: list[str], chance: str) -> DataFrame:
    """For choices in order the chance that each is the one obtained, and that none before it was: c_i * prod(1 - c_j)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sure = F.coalesce(F.max(F.when(F.col(chance) >= 1, 1).otherwise(0)).over(w), F.lit(0)) == 1
    logs = F.coalesce(F.sum(F.when(F.col(chance) < 1, F.log1p(-F.col(chance)))).over(w), F.lit(0.0))
    left = F.when(sure, F.lit(0.0)).otherwise(F.exp(logs))
    return df.withColumn("left", left).withColumn("obtained", F.col(chance) * F.col("left"))


def poisson_tail(mean: Column, k: Column) -> Column:
    """P(X >= k) for a Poisson variable; 1 for k <= 0."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, i: F.struct((acc["t"] * mean / i).alias("t"), (acc["s"] + F.when(i <= k - 1, acc["t"] * mean / i).otherwise(0.0)).alias("s")),
        lambda acc: acc["s"],
    )
    return F.when(k <= 0, F.lit(1.0)).otherwise(1 - F.exp(-mean) * terms)


def places_needed(distance: Column, reach: Column, offers: Column) -> Column:
    """Places that must free up until a cut-off ``reach`` extends to ``distance``, were homes spread evenly."""
    return F.greatest(F.lit(1), F.round(F.lit(0.75) * offers * (distance * distance - reach * reach) / (reach * reach))).cast("int")


def rescaled_cutoff(cutoff: Column, growth: Column) -> Column:
    """A cut-off distance if demand grew by a share: the area shrinks by 1 + growth; infinite ones stay."""
    return F.when(cutoff < float("inf"), cutoff * F.sqrt(1 / (1 + growth))).otherwise(cutoff)


def survival_in_band(df: DataFrame, keys: list[str], band: Column, cutoff: str, weight: str, growth: float, points: list[float]) -> DataFrame:
    """``survival_at`` for the samples of one band, their cut-offs rescaled by the growth of demand."""
    one = df.where(band).withColumn(cutoff, rescaled_cutoff(F.col(cutoff), F.lit(growth)))
    return survival_at(one, keys, cutoff, weight, points)


def reach(df: DataFrame, keys: list[str], cutoff: str, at: Column) -> DataFrame:
    """Per key the least and greatest finite cut-off, how many years reached everyone, and how many a given distance."""
    finite = F.when(F.col(cutoff) < float("inf"), F.col(cutoff))
    return df.where(F.col(cutoff).isNotNull()).groupBy(*keys).agg(
        F.min(finite).alias("nearest"), F.max(finite).alias("furthest"), F.count_if(F.col(cutoff) == float("inf")).alias("everyone"), F.count_if(F.col(cutoff) >= at).alias("hits"), F.count(F.lit(1)).alias("years")
    )
