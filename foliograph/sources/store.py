"""Reading the tables and cutting lineage in storage that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the cluster names; on one machine our own where none is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not getattr(spark, "_foliograph_folder", None):
            spark._foliograph_folder = tempfile.mkdtemp(prefix="foliograph-")
            atexit.register(shutil.rmtree, spark._foliograph_folder, ignore_errors=True)
        base = f"file://{spark._foliograph_folder}"
    return f"{base.rstrip('/')}/foliograph-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """`df` computed once, written as a compressed table to the shared folder, and read from there.

    This cuts the lineage: the loss of an executor costs no more than a read. The
    table is deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    place = _folder(spark)
    df.write.option("compression", "zstd").parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def drop(settled: DataFrame) -> None:
    """Removes a settled table that nothing reads any more; no error if it is not one."""
    spark = settled.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in settled.inputFiles()}:
        if "/foliograph-" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_bound(df: DataFrame) -> int:
    """Number of rows: from the Parquet footers for a scanned table, else one counting job."""
    return df.count()
