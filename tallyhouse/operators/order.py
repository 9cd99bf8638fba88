"""Global order without a single task: ranks, chunks and pages over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of each row in the global order.

    Rows are range-partitioned and sorted; the counts of the partitions, as many rows as there are partitions, give each
    partition its offset.  Ties are ordered as the partitions' sort leaves them: give a total order for a stable result.
    """
    from tallyhouse.session import staged

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    parts = staged(parts.withColumn("_p", F.shiftright("_m", 33).cast("int")).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")).alias("_o"))
    return parts.join(F.broadcast(offsets), "_p").withColumn(out, F.col("_o") + F.col("_i")).drop("_p", "_i", "_m", "_o")


def chunks(df: DataFrame, order: list[Column], size: int, out: str = "chunk") -> DataFrame:
    """Fixed-size chunks of the global order."""
    return with_rank(df, order, "_rank").withColumn(out, F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def greedy_pages(df: DataFrame, keys: list[str], order: str, weight: str, first: int, other: int, out: str = "page") -> DataFrame:
    """Pages of rows in order, each filled up to a budget (the first page has its own); a heavier row has a page alone.

    The fold runs per group of ``keys`` on the batches of a group as they come, holding only the page's running weight.
    """
    import pandas as pd

    schema = df.schema.add(out, "long")

    def run(frames):  # noqa: ANN001, ANN202
        state = {"key": None, "page": 0, "used": 0.0}
        for f in frames:
            pages = []
            for key, x in zip(zip(*[f[k] for k in keys]) if keys else [()] * len(f), f[weight].fillna(0)):
                if state["key"] != key:
                    state.update(key=key, page=0, used=0.0)
                budget = first if state["page"] == 0 else other
                if state["used"] and state["used"] + x > budget:
                    state["page"], state["used"] = state["page"] + 1, 0.0
                state["used"] += x
                pages.append(state["page"])
            yield f.assign(**{out: pd.Series(pages, index=f.index, dtype="int64")})

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def round_robin(df: DataFrame, groups: str, group_order: Column, order: list[Column], limit: int) -> DataFrame:
    """The first rows of each list in turn, up to ``limit`` rows in all."""
    w = Window.partitionBy(groups).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).orderBy("turn", group_order).limit(limit)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _starts(word: str):  # noqa: ANN202
    return lambda x: x.startswith(word)


def search_score(name: Column, query: str) -> Column:
    """3 if the name starts with the query, 2 if every word of it starts a word of the name, 1 if it occurs, else null."""
    n, q = F.lower(name), query.lower().strip()
    words = F.split(n, "[^a-z0-9]+")
    every = F.lit(True)
    for word in q.split():
        every = every & F.exists(words, _starts(word))
    return F.when(n.startswith(q), 3).when(every, 2).when(n.contains(q), 1)


def seeded_sample(df: DataFrame, ident: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in the order of a hash of seed and id: the same rows in the same order whatever the partitions."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")))
    return df.withColumn("_h", key).orderBy("_h", ident).limit(n).drop("_h")


def pinned_first(df: DataFrame, pinned: Column, column: str, ident: str, up: bool = True, out: str = "place") -> DataFrame:
    """``df`` with its place in a table order: pinned rows first, then by a column, nulls last either way, then by id."""
    by = F.col(column).asc_nulls_last() if up else F.col(column).desc_nulls_last()
    return with_rank(df, [F.coalesce(pinned, F.lit(False)).desc(), by, F.col(ident).asc()], out)


def top_per_bucket(df: DataFrame, keys: list[str], chance: Column, edges: dict[str, float], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every class of chance: the first of ``edges`` (name -> least chance, best first) that is reached."""
    bucket = F.coalesce(*[F.when(chance >= least, F.lit(name)) for name, least in edges.items()])
    return top_k(df.withColumn("bucket", bucket).where("bucket is not null"), [*keys, "bucket"], order, k)


def distinct_in_order(items: Column) -> Column:
    """An array without repeats, each value at its first place; nulls are left out."""
    return F.array_distinct(F.array_compact(items))
