"""Where intermediate tables go, and how lineage is cut so that a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark runs locally, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tallyhouse-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone, and with it the need to tidy
        pass


def drop_staged(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in paths:
        _delete(spark, path)


#: Setting by which Spark deletes the shuffle files of a query when it ends, instead of when the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to a table in the shared folder and reads it back; also gives the path, for ``drop_staged``.

    The shuffle files of the write are deleted with its end, so that a query of many stages takes the disk of the largest.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyhouse-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``stage`` without the path."""
    return stage(df, name)[0]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session, once, so that it need not be installed on them."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_dir(spark)}/tallyhouse-{uuid.uuid4().hex}/tallyhouse.zip"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(held.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
