"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``.

    Only a local session may have neither: a temporary folder takes its place.
    On a cluster that would be another folder on each machine, so it's an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        given = context._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if base:
        return base.rstrip("/")
    if not is_local(context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return f"file://{tempfile.gettempdir()}/silkgraph-shared"


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path below :func:`shared_base`."""
    return f"{shared_base(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def remove(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` returned and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
