from pyspark.sql import functions as F

from tallyhouse.session import _TIDY, stage


def test_staged_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, kept = shuffled(), spark.conf.get(_TIDY)
    rows = spark.range(5000, numPartitions=3).groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    again, _ = stage(rows.join(rows.withColumnRenamed("n", "m").hint("merge"), "k"), "joined")
    assert shuffled() <= before
    assert again.count() == 700
    assert spark.conf.get(_TIDY) == kept
    assert rows.agg(F.sum("n")).first()[0] == 5000  # a frame that was staged can be used again
