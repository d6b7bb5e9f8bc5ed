"""Tables in the folder that the driver and all executors share: they cut lineage and outlive an executor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is named, a temporary one, if all of Spark runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path of this application, whose folder goes when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        root = _ROOTS[sc.applicationId] = f"{shared_dir(spark)}/marlstone/{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{_ROOTS[sc.applicationId]}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df once into the shared folder and read it back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Write df once into the shared folder, bucketed and sorted by a column: joins on it then move the other side only."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    name = "marlstone_" + uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A task for each bucket, so that each has one file.
    df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    """The name only: the files are in the application's folder, which goes with it."""
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
