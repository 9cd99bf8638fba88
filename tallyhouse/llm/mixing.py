"""Mixing sources to target weights by a low-discrepancy schedule.

A mixture is a sequence of slots of equal size in tokens.  Slot i belongs to the source in whose share of the unit interval
the i-th golden-ratio point lies, so every stretch of the sequence is close to the target shares.  Each source's texts are
shuffled once per repetition and laid end to end; the blocks of that line fill the source's slots in order.  Both ranks (of
slots within a source, of tokens within a source's line) are prefix sums over many small buckets, so no source is ever
ordered in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOLDEN = (math.sqrt(5) - 1) / 2


@dataclass(frozen=True)
class Plan:
    """What is decided before any text is placed: sources in order, shares, tokens to take of each, block size."""

    sources: list[str]
    weight: dict[str, float]
    share: dict[str, float]
    repeats: dict[str, int]
    tokens: dict[str, int]
    texts: dict[str, int]
    total: int
    block: int
    slots: int


def source_key(c: Column) -> Column:
    """A source's name however written: lower case, words joined by ``_``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")


def one_text_each(sized: DataFrame) -> DataFrame:
    """(doc_id, source, tokens) of one document per text: the smallest doc_id stands for all copies of its text.

    ``sized``: doc_id, source, h1, h2 (two 64-bit hashes of the text), tokens.
    """
    first = sized.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d"))
    return first.select("d.doc_id", "d.source", "d.tokens")


def plan_mixture(texts: DataFrame, targets: DataFrame, *, total: int | None = None, block: int = 512) -> Plan:
    """Totals per source against the targets.  ``texts``: doc_id, source, tokens; ``targets``: source, weight, max_repeats.

    A block has ``block`` tokens whatever the size of the corpus; the shares reached differ from the targets by a few blocks.
    Without ``total`` the mixture is as large as it can be with every source at its share.  With it, a source whose texts
    don't reach gives all it may.  Sources of no weight or no tokens take no part; weights of a source given twice add up
    and its smallest max_repeats holds.  The targets are a parameter table and are read to the driver, as are the totals
    of the sources they name.
    """
    want: dict[str, tuple[float, int]] = {}
    for r in targets.select(source_key(F.col("source")).alias("s"), F.col("weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("m")).collect():
        if r.s and r.w and r.w > 0 and r.m and r.m > 0:
            w, m = want.get(r.s, (0.0, r.m))
            want[r.s] = (w + r.w, min(m, r.m))
    sums = texts.where(F.col("source").isin(list(want))).groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    have = {r.source: (r.t, r.n) for r in sums.collect() if r.t}
    sources = sorted(have)
    whole = sum(want[s][0] for s in sources)
    share = {s: want[s][0] / whole for s in sources}
    feasible = min((have[s][0] * want[s][1] / share[s] for s in sources), default=0.0)
    size = int(feasible if total is None else total)
    return Plan(
        sources, {s: want[s][0] for s in want}, share, {s: want[s][1] for s in want}, {s: have[s][0] for s in sources},
        {s: have[s][1] for s in sources}, size, block, size // block,
    )


def _prefix(counts: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``counts`` with the sum of ``value`` before each row; for tables of a few thousand buckets per key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


def schedule(df: DataFrame, plan: Plan, chunk: int = 65_536) -> DataFrame:
    """(slot, source, rank): which source fills each slot, and how many slots of that source came before."""
    spark = df.sparkSession
    slots = spark.range(plan.slots).withColumnRenamed("id", "slot")
    x = F.pmod((F.col("slot") + 0.5) * F.lit(GOLDEN), F.lit(1.0))
    edge, pick = 0.0, F.lit(plan.sources[-1] if plan.sources else None)
    edges = []
    for s in plan.sources[:-1]:
        edge += plan.share[s]
        edges.append((edge, s))
    for e, s in reversed(edges):
        pick = F.when(x < e, F.lit(s)).otherwise(pick)
    slots = slots.select("slot", pick.alias("source"), (F.col("slot") / chunk).cast("long").alias("_chunk"))
    before = _prefix(slots.groupBy("source", "_chunk").agg(F.count(F.lit(1)).alias("_n")), ["source"], ["_chunk"], "_n")
    inside = F.row_number().over(Window.partitionBy("source", "_chunk").orderBy("slot")) - 1
    return slots.withColumn("_i", inside).join(before, ["source", "_chunk"]).select(
        "slot", "source", (F.col("_before") + F.col("_i")).alias("rank")
    )


def lines(texts: DataFrame, plan: Plan, *, seed: int = 7, buckets: int = 1024) -> DataFrame:
    """(doc_id, source, tokens, turn, start): each source's texts laid end to end, shuffled anew for every repetition.

    Only the repetitions that the source's share needs are made, never more than its ``max_repeats``.
    """
    turns = F.lit(0)
    for s in plan.sources:
        need = math.ceil((plan.share[s] * plan.total + 2 * plan.block) / plan.tokens[s])
        turns = F.when(F.col("source") == s, F.lit(max(1, min(plan.repeats[s], need)))).otherwise(turns)
    t = texts.where(F.col("source").isin(plan.sources) & (F.col("tokens") > 0))
    t = t.withColumn("turn", F.explode(F.sequence(F.lit(1), turns))).withColumn("_h", F.xxhash64("doc_id", "turn", F.lit(seed)))
    t = t.withColumn("_bucket", F.pmod(F.shiftright("_h", 32), F.lit(buckets)).cast("int"))
    sums = t.groupBy("source", "turn", "_bucket").agg(F.sum("tokens").alias("_t"))
    before = _prefix(sums, ["source"], ["turn", "_bucket"], "_t").drop("_t")
    w = Window.partitionBy("source", "turn", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_in", F.coalesce(F.sum("tokens").over(w), F.lit(0).cast("long")))
    return t.join(before, ["source", "turn", "_bucket"]).select(
        "doc_id", "source", "tokens", "turn", (F.col("_before") + F.col("_in")).alias("start")
    )


def placed(texts: DataFrame, plan: Plan, *, seed: int = 7, buckets: int = 1024) -> DataFrame:
    """(doc_id, source, tokens, turn, start, slot): every use of a text, in the slot that its first token falls into."""
    laid = lines(texts, plan, seed=seed, buckets=buckets).withColumn("rank", F.floor(F.col("start") / plan.block).cast("long"))
    return laid.join(schedule(texts, plan), ["source", "rank"]).drop("rank")


def uses(placements: DataFrame) -> DataFrame:
    """(doc_id, source, uses, tokens): the chosen documents and how often each is used."""
    return placements.groupBy("doc_id", "source").agg(F.count(F.lit(1)).cast("int").alias("uses"), F.first("tokens").alias("tokens"))


def reached(used: DataFrame, plan: Plan, targets: DataFrame) -> DataFrame:
    """One row per source of the targets: its target share, what it has, what was used, the share reached.

    A source without documents keeps its row with zeros; target shares are among the sources that have tokens.
    """
    spark = used.sparkSession
    rows = [
        (s, plan.weight[s], plan.repeats[s], plan.share.get(s, 0.0), plan.texts.get(s, 0), plan.tokens.get(s, 0))
        for s in sorted(plan.weight)
    ]
    base = spark.createDataFrame(rows, "source string, weight double, max_repeats int, target_share double, texts long, tokens long")
    got = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("used_texts"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("used_tokens"), F.max("uses").alias("most_uses")
    )
    out = base.join(F.broadcast(got), "source", "left").fillna(0)
    whole = F.sum("used_tokens").over(Window.partitionBy())
    return out.withColumn("reached_share", F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), whole), F.lit(0.0)))
