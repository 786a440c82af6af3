"""Results that are written once to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session, as in tests, may do without and gets one of its own."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    context.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, computed once and read from a new folder, and that folder."""
    spark = df.sparkSession
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri
