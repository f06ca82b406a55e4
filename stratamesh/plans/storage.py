"""Tables in the folder that driver and executors share, to cut lineages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: With this set, the shuffle files of a job go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one of ``spark.checkpoint.dir``. Where the session names none, a
    temporary folder is set in local mode, as in tests; on a cluster, whose
    executors could not see that folder, an error is raised.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strata-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, counted: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder, read it again.

    The shuffle files of the writing job go at once, the table with ``discard`` or when the driver's Python ends.
    With ``counted`` its rows are counted as they are written, for ``row_count``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strata-{uuid.uuid4().hex}"
    before, seen = spark.conf.get(CLEANUP), Observation()
    spark.conf.set(CLEANUP, "true")
    try:
        (df.observe(seen, F.count(F.lit(1)).alias("rows")) if counted else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    if counted:
        table._rows = seen.get["rows"]
    return table


def row_count(df: DataFrame) -> int:
    """The rows of ``df``: those seen when it was written, else by a job."""
    rows = getattr(df, "_rows", None)
    return df.count() if rows is None else rows


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read any more."""
    for t in tables:
        _remove(t.sparkSession, t._shared_path)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file, in any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended already
        pass
