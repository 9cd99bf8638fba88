"""Percentiles per group of very large columns, by distributed multi-select.

Equal values of a group are counted once; each group's distinct values are spread over blocks of bounded size, sorted.  Every
round each block proposes the median of what is still active on either side of the current pivot, the weighted median of the
proposals becomes the next pivot, values are counted three ways, and the ranges that can't hold the wanted rank are
discarded, which takes an eighth of the distinct values at least.  The proposals of a group meet in two steps, so that no task
holds those of all its blocks, and every few rounds what is left of the blocks is written anew, so that discarded values are
not read again.  Groups and shares run side by side until all are found, so the result is exact.  Summaries with a stated rank error can be kept of any part and merged later.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import drop_staged, stage


def wanted_rank(share: Column, n: Column) -> Column:
    """The smallest k with k >= share * n (1 at least), in decimal arithmetic so that 0.9 * 70 is 63."""
    exact = share.cast("decimal(12,10)") * n.cast("decimal(20,0)")
    return F.greatest(F.ceil(exact).cast("long"), F.lit(1).cast("long"))


def _middle(a: Column) -> Column:
    """The median element of a sorted array, null of an empty one."""
    return F.try_element_at(a, ((F.size(a) + 1) / 2).cast("int"))


def _weighted_median(proposals: Column) -> Column:
    """Of structs (v, w): the smallest v at which half of all w is reached."""
    s = F.array_sort(proposals)
    total = F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: acc + x.w)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
    step = lambda acc, x: F.struct(
        (acc.seen + x.w).alias("seen"),
        F.when(acc.v.isNull() & ((acc.seen + x.w) * 2 >= total), x.v).otherwise(acc.v).alias("v"),
    )
    return F.aggregate(s, start, step, lambda acc: acc.v)


def blocks(values: DataFrame, groups: list[str], block_values: int = 4096) -> DataFrame:
    """Sorted blocks (``groups``, ``_block``, ``xs``: array of (v, c)) of the distinct values of each group with their counts."""
    clean = values.where(F.col("value").isNotNull() & ~F.isnan("value") & F.expr(" and ".join(f"`{g}` is not null" for g in groups)))
    counted = clean.groupBy(*groups, F.col("value").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # The number of blocks of a group follows its rows, known before the values are spread.
    width = clean.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / block_values).cast("int").alias("_k"))
    spread = counted.join(width, groups).withColumn("_block", F.pmod(F.xxhash64("v"), F.col("_k")).cast("int"))
    return spread.groupBy(*groups, "_block").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("xs"))


def multi_select(values: DataFrame, groups: list[str], shares: dict[str, list[float]] | list[float], *, of: str | None = None, block_values: int = 4096, rewrite: int = 4) -> DataFrame:
    """(``groups``, ``share``, ``n``, ``value``): the smallest value of a group with at least share * n values not above it.

    ``values`` has ``groups`` and ``value``.  ``shares`` are the same for all groups, or by the value of the column ``of``.
    Nulls and NaN don't count, nor do rows with a null in a group column; infinities are values.  Repeated rows are values
    each.  A group without values has no row; an empty table gives none.  ``block_values`` and ``rewrite`` (rounds between two
    writings of what is left) bound memory and reading and never change the result.
    """
    spark = values.sparkSession
    blocked, blocked_path = stage(blocks(values, groups, block_values).withColumn("_sub", F.floor(F.col("_block") / 1024)), "blocks")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, e: acc + e.c)
    propose = lambda a: F.when(F.size(a) > 0, F.struct(_middle(a).v.alias("v"), F.size(a).cast("long").alias("w")))
    weight = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, p: acc + p.w)
    again = lambda c: F.when(F.size(c) > 0, F.struct(_weighted_median(F.col(c)).alias("v"), weight(F.col(c)).alias("w")))

    # Median of block medians within a thousand blocks, then of those: two lists of bounded length.
    sizes = blocked.groupBy(*groups, "_sub").agg(F.sum(total("xs")).alias("n"), F.collect_list(propose(F.col("xs"))).alias("_up"))
    sizes = sizes.select(*groups, "n", again("_up").alias("_up")).groupBy(*groups).agg(F.sum("n").alias("n"), F.collect_list("_up").alias("_up"))
    as_array = lambda qs: F.array(*[F.lit(float(q)) for q in qs])
    if isinstance(shares, dict):
        wanted = F.lit(None)
        for k, qs in shares.items():
            wanted = F.when(F.col(of) == k, as_array(qs)).otherwise(wanted)
    else:
        wanted = as_array(shares)
    state = sizes.withColumn("share", F.explode(wanted)).select(
        *groups,
        "share",
        "n",
        wanted_rank(F.col("share"), F.col("n")).alias("rank"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        _weighted_median(F.col("_up")).alias("pivot"),
        F.lit(None).cast("double").alias("value"),
    )
    state, _ = stage(state, "state-0")
    turn, keys = 0, list(groups)
    found: list[DataFrame] = []
    while not state.isEmpty():
        turn += 1
        x = blocked.join(state.drop("value"), keys)
        below = F.filter("xs", lambda e: (F.col("lo").isNull() | (e.v > F.col("lo"))) & (e.v < F.col("pivot")))
        above = F.filter("xs", lambda e: (F.col("hi").isNull() | (e.v < F.col("hi"))) & (e.v > F.col("pivot")))
        at = F.filter("xs", lambda e: e.v == F.col("pivot"))
        own = ("n", "rank", "lo", "hi", "pivot")
        x = x.select(*groups, "share", "_sub", *own, below.alias("_b"), above.alias("_a"), total(at).alias("_eq"))
        x = x.groupBy(*groups, "share", "_sub").agg(
            *[F.first(c).alias(c) for c in own],
            F.sum(total(F.col("_b"))).alias("_lt"),
            F.sum("_eq").alias("_eq"),
            F.collect_list(propose(F.col("_b"))).alias("_low"),
            F.collect_list(propose(F.col("_a"))).alias("_high"),
        )
        x = x.select(*groups, "share", *own, "_lt", "_eq", again("_low").alias("_low"), again("_high").alias("_high")).groupBy(*groups, "share").agg(
            *[F.first(c).alias(c) for c in own],
            F.sum("_lt").alias("_lt"),
            F.sum("_eq").alias("_eq"),
            F.collect_list("_low").alias("_low"),
            F.collect_list("_high").alias("_high"),
        )
        down, hit = F.col("rank") <= F.col("_lt"), F.col("rank") <= F.col("_lt") + F.col("_eq")
        new = x.select(
            *groups,
            "share",
            "n",
            F.when(down, F.col("rank")).otherwise(F.col("rank") - F.col("_lt") - F.col("_eq")).alias("rank"),
            F.when(down | hit, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(down, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(down, _weighted_median(F.col("_low"))).otherwise(_weighted_median(F.col("_high"))).alias("pivot"),
            F.when(~down & hit, F.col("pivot")).alias("value"),
        )
        made, _ = stage(new, f"state-{turn}")
        found.append(made.where("value is not null").select(*groups, "share", "n", "value"))
        state = made.where("value is null")
        if turn % rewrite == 0:
            left = F.filter("xs", lambda e: (F.col("lo").isNull() | (e.v > F.col("lo"))) & (F.col("hi").isNull() | (e.v < F.col("hi"))))
            kept = blocked.join(state.select(*groups, "share", "lo", "hi"), keys).withColumn("xs", left).where(F.size("xs") > 0)
            keys = [*groups, "share"]
            kept, kept_path = stage(kept.select(*keys, "_sub", "xs"), f"blocks-{turn}")
            drop_staged(spark, blocked_path)
            blocked, blocked_path = kept, kept_path
    drop_staged(spark, blocked_path)
    done = state.select(*groups, "share", "n", "value") if not found else found[0]
    for f in found[1:]:
        done = done.unionByName(f)
    return done


def summaries(values: DataFrame, groups: list[str], part: str, error: float) -> DataFrame:
    """A mergeable summary of each group and part (a day, a year, a load): (``groups``, ``part``, ``value``, ``weight``).

    The values at the shares error, 2 * error, ... 1 of the part, each standing for the values since the one before.  At
    most 1 / error + 1 rows a part, whatever its size.
    """
    steps = int(Decimal(1) / Decimal(str(error)))
    shares = [float(Decimal(str(error)) * i) for i in range(1, steps + 1)]
    if not shares or shares[-1] < 1:
        shares.append(1.0)
    q = multi_select(values, [*groups, part], shares)
    rank = wanted_rank(F.col("share"), F.col("n"))
    w = Window.partitionBy(*groups, part).orderBy("share")
    q = q.withColumn("_rank", rank)
    q = q.withColumn("weight", F.col("_rank") - F.coalesce(F.lag("_rank").over(w), F.lit(0)))
    return q.where("weight > 0").select(*groups, part, "value", "weight")


def merged(summary: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """(``groups``, ``share``, ``n``, ``value``) from summaries of any parts: the rank of the value given differs from the
    wanted one by at most error * n, the sum of what each part's summary leaves open."""
    one = summary.groupBy(*groups, "value").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy(*groups)
    run = one.withColumn("_seen", F.sum("weight").over(w.orderBy("value"))).withColumn("n", F.sum("weight").over(w))
    run = run.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    reach = F.col("_seen") >= wanted_rank(F.col("share"), F.col("n"))
    return run.where(reach).groupBy(*groups, "share").agg(F.first("n").alias("n"), F.min("value").alias("value"))
