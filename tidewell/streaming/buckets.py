"""A stream of raw frames into an append-only bucket table."""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.extract import posts
from ..operators import buckets as B
from .ledger import accept_stream

_NONE = "cast(null as {})"


def append_buckets(frames: DataFrame, out: str, checkpoint: str, now: float | Callable[[], float] = time.time, raw_col: str = "value", arrival_col: str | None = None, shards: int | None = None, global_cap: int | None = None) -> StreamingQuery:
    """Posts, accepted signals and sentiment of a stream of frames, added to ``out`` batch by batch.

    The ledger is keyed state that lasts from batch to batch. Its clock is the
    time of arrival, stamped here unless ``arrival_col`` brings it (a replay);
    a post's own time, which its sender chooses, only says in which minute it
    counts, however late it comes. Sources are digests by a key of this run, so
    that no state names them, and a new run begins with an empty ledger.

    The table is partitioned by hour and batch: a batch that runs again replaces
    itself, a window reads only its hours, and ``trim`` drops hours that no
    window reaches. Sentiment is a table of its own, ``{out}-sentiment``.
    """
    if arrival_col is None:
        arrival_col = "arrival"
        frames = frames.withColumn(arrival_col, F.unix_micros(F.current_timestamp()) / 1e6)
    made = posts(frames, now, raw_col, arrival_col, secrets.token_bytes(32)).withColumnRenamed(arrival_col, "arrival")
    decided = accept_stream(B.signals(made), shards=shards, global_cap=global_cap)
    rows = B.decided_counts(decided).unionByName(B.own_counts(made)).withColumn("score", F.expr(_NONE.format("double")))
    scored = made.where("sentiment is not null").select(
        F.floor(F.col("ts") / 60).cast("bigint").alias("minute"), F.lit("sentiment").alias("family"), F.col("lang").alias("key"), F.expr(_NONE.format("string")).alias("label"), F.lit(1).cast("bigint").alias("n"), F.col("sentiment").alias("score")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        place = batch.withColumn("hour", F.expr("minute div 60")).withColumn("batch", F.lit(batch_id))
        counts = place.where("family <> 'sentiment'").groupBy("hour", "batch", "minute", "family", "key", "label").agg(F.sum("n").alias("cnt"))
        scores = place.where("family = 'sentiment'").groupBy("hour", "batch", "minute", F.col("key").alias("lang")).agg(F.sum("score").alias("sent_sum"), F.sum("n").alias("sent_cnt"))
        for table, path in ((counts, out), (scores, f"{out}-sentiment")):
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(path)
        batch.unpersist()

    return rows.unionByName(scored).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_buckets(spark: SparkSession, out: str, now: float, minutes: int = 1440) -> DataFrame:
    """The bucket table as far as windows of so many minutes reach; hours beyond aren't read. Rows of the same key add up."""
    last = int(now // 60)
    held = spark.read.parquet(out).where((F.col("hour") >= (last - minutes) // 60) & (F.col("hour") <= last // 60))
    return held.where((F.col("minute") > last - minutes) & (F.col("minute") <= last)).drop("hour", "batch")


def trim(spark: SparkSession, out: str, now: float, minutes: int = 1440) -> list[int]:
    """Delete the hours of the table that no window of so many minutes reaches any more; returns them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(there):
        return []
    oldest, gone = (int(now // 60) - minutes) // 60, []
    for f in files.listStatus(there):
        name = f.getPath().getName()
        if name.startswith("hour=") and int(name[5:]) < oldest:
            files.delete(f.getPath(), True)
            gone.append(int(name[5:]))
    return sorted(gone)
