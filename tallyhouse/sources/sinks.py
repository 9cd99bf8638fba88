"""Sinks: budgets that fail loudly, staged rebuilds, one document per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(df: DataFrame) -> DataFrame:
    """Fails the job where a double is NaN or infinite: JSON has no way to write them."""
    for n, t in df.dtypes:
        if t in ("double", "float"):
            c = F.col(f"`{n}`")
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            df = df.withColumn(n, F.when(bad, F.raise_error(F.lit(f"{n} is not a number"))).otherwise(c))
    return df


def within_budget(doc: Column, budget: int, name: Column) -> Column:
    """The document, failing the job if it is longer than ``budget`` bytes in UTF-8."""
    size = F.octet_length(doc)
    return F.when(size <= budget, doc).otherwise(F.raise_error(F.concat(F.lit("too large: "), name, F.lit(" "), size.cast("string"))))


def shrink_to_budget(df: DataFrame, fields: list[str], drop: list[str], budget: int, out: str = "doc") -> DataFrame:
    """JSON of ``fields``, without those of ``drop`` in order as far as needed to stay within ``budget`` bytes.

    ``dropped`` names what was left out; a document too large without all of them fails the job.
    """
    options = [F.struct(F.to_json(F.struct(*[f for f in fields if f not in drop[:i]])).alias("d"), F.array(*[F.lit(x) for x in drop[:i]]).cast("array<string>").alias("x")) for i in range(len(drop) + 1)]
    fit = F.filter(F.array(*options), lambda o: F.octet_length(o["d"]) <= budget)
    df = df.withColumn("_fit", F.try_element_at(fit, F.lit(1)))
    doc = F.when(F.col("_fit").isNull(), F.raise_error(F.lit("a document exceeds its budget"))).otherwise(F.col("_fit.d"))
    return df.withColumn(out, doc).withColumn("dropped", F.col("_fit.x")).drop("_fit")


def unique_paths(df: DataFrame, slug: str, ident: str, out: str = "path") -> DataFrame:
    """Slugs, with six letters of a hash of the id where several rows share one; fails if two paths still agree."""
    n = df.groupBy(slug).agg(F.count(F.lit(1)).alias("_n"))
    tail = F.concat(F.col(slug), F.lit("-"), F.left(F.sha1(F.col(ident).cast("string")), F.lit(6)))
    df = df.join(n, slug).withColumn(out, F.when(F.col("_n") > 1, tail).otherwise(F.col(slug))).drop("_n")
    twice = df.groupBy(out).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(twice, out).withColumn(out, F.when(F.col("_n") == 1, F.col(out)).otherwise(F.raise_error(F.concat(F.lit("path twice: "), out)))).drop("_n")


def write_documents(df: DataFrame, path: str, partition: str) -> None:
    """JSON lines under ``path``, a folder per value of ``partition``; nulls are left out; an earlier build is replaced
    only when the new one is complete (each partition's rows are spread, so a hot one doesn't end in one file)."""
    spark = df.sparkSession
    ready = no_nan(df)
    ready.write.mode("overwrite").partitionBy(partition).json(f"{path}__new")
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(f"{path}__old"), True)
        fs.rename(hadoop(path), hadoop(f"{path}__old"))
    fs.rename(hadoop(f"{path}__new"), hadoop(path))
    fs.delete(hadoop(f"{path}__old"), True)
