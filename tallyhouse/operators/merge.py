"""Merging: rows of one key with conflicts found, unlike entities in one table, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflict_merge(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: known values before nulls, the smallest where they conflict, and the names of conflicting columns."""
    aggs = [F.min(v).alias(v) for v in values] + [F.count_distinct(v).alias(f"_{v}") for v in values]
    out = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("merged"))
    clash = F.array_compact(F.array(*[F.when(F.col(f"_{v}") > 1, F.lit(v)) for v in values]))
    return out.withColumn("conflicts", clash).drop(*[f"_{v}" for v in values])


def union_entities(parts: dict[str, DataFrame]) -> DataFrame:
    """Several kinds of entity in one table with their kind; a column that a kind lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("kind", F.lit(k)) for k, d in parts.items()])


def facet_filter(df: DataFrame, groups: dict[str, list]) -> DataFrame:
    """Rows that match any value of every group."""
    for c, values in groups.items():
        df = df.where(F.col(c).isin(*values))
    return df


def facet_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of every value of every facet, in one pass."""
    entries = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(entries)).where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def latest_period(df: DataFrame, period: str) -> DataFrame:
    """The rows of the latest period of the whole table."""
    top = df.agg(F.max(period).alias("_p"))
    return df.join(F.broadcast(top), F.col(period) == F.col("_p")).drop("_p")


def coverage(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows and known values of each column per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"{c}_known") for c in columns])


def late_matches(placed: DataFrame, late: DataFrame, key: str, target: str) -> DataFrame:
    """Matches that come later than others (``key``, ``target``, evidence), merged: a placed match never moves, one that is
    confirmed gains the evidence, one that is contradicted keeps it as ``contradicted``; keys not placed are added."""
    a = placed.select(key, F.col(target).alias("_t"), F.col("evidence").alias("_e"))
    b = late.select(key, F.col(target).alias("_lt"), F.col("evidence").alias("_le"))
    both = a.join(b, key, "full")
    same = F.col("_t") == F.col("_lt")
    evidence = F.when(same, F.concat_ws("; ", "_e", "_le")).otherwise(F.coalesce("_e", "_le"))
    return both.select(key, F.coalesce("_t", "_lt").alias(target), evidence.alias("evidence"), F.when(~same, F.col("_lt")).alias("contradicted"))


def widespread(df: DataFrame, key: str, entity: str, most: int) -> DataFrame:
    """``df`` with ``held_back``: whether its key is seen on more than ``most`` entities."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(entity).alias("_n"))
    return df.join(n, key, "left").withColumn("held_back", F.coalesce(F.col("_n") > most, F.lit(False))).drop("_n")


def best_verdict(df: DataFrame, keys: list[str], verdict: str, ranks: list[str]) -> DataFrame:
    """One row per key: the best of its verdicts, the first of ``ranks`` being best; others than those are worse than all."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(verdict)), F.lit(0)), F.lit(len(ranks) + 1))
    return df.groupBy(*keys).agg(F.min_by(verdict, F.struct(place, verdict)).alias(verdict), F.count(F.lit(1)).alias("checked"))


def gate(df: DataFrame, judged: Column, wrong: Column, least: int) -> DataFrame:
    """One row: how many were judged, how many wrongly, and whether that passes: ``least`` judged, none wrong."""
    return df.agg(F.count_if(judged).alias("judged"), F.count_if(judged & wrong).alias("wrong")).withColumn("passes", (F.col("judged") >= least) & (F.col("wrong") == 0))
