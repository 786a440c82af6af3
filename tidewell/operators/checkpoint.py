"""Checkpoints of the bucket table: what is written, and what of an untrusted one is taken back."""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text_rules, web_rules
from .buckets import HEADS, LABELS, heads

_log = logging.getLogger(__name__)

VERSION = 2
RULES = "rules-v1"
MOST_COUNT = 10_000_000
MOST_ENTRIES = 1024
#: Seconds for which a checkpoint is taken back.
LIFE = 26 * 3600
KINDS = {"tag": "tag", "url": "url", "domain": "domain", "emoji": "emoji", "lang": "lang", "excluded": "exclusion"}
_SIGNALS = ("tag", "url", "domain", "emoji")
#: All reasons for which something is excluded.
REASONS = frozenset(
    [f"{why}_{x}" for why in ("duplicate_in_event", "duplicate_source", "missing_source", "rate_limited_source", "rate_limited_global") for x in _SIGNALS]
    + [f"candidate_limit_{x}" for x in ("tag", "url", "emoji")]
    + [f"checkpoint_invalid_{x}" for x in (*KINDS.values(), "count", "label")]
    + ["filtered_tag", "filtered_domain", "malformed_tag", "malformed_url", "unsafe_host", "unsafe_scheme"]
)


def valid_key(family: str, key: object) -> bool:
    """Whether a key is in its family's canonical form."""
    if not isinstance(key, str):
        return False
    if family == "tag":
        return text_rules.tag(key)[0] == key
    if family == "url":
        return web_rules.link(key)[0] == key
    if family == "domain":
        return web_rules.domain(key)[0] == key
    if family == "emoji":
        return len(key) <= 64 and text_rules.EMOJI.fullmatch(key) is not None
    if family == "lang":
        return key == "und" or text_rules.primary_language(key) == key
    return key in REASONS if family == "excluded" else family in ("post", "candidate") and key == ""


@F.pandas_udf(T.BooleanType())
def valid_key_udf(family: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([valid_key(f, k) for f, k in zip(family, key, strict=True)])


@F.pandas_udf(T.BooleanType())
def valid_label_udf(key: pd.Series, label: pd.Series) -> pd.Series:
    """Whether a label is a way to write its tag."""
    return pd.Series([label_ is None or text_rules.tag(label_)[0] == k for k, label_ in zip(key, label, strict=True)])


def _hadoop(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str) -> list[str]:
    """The snapshots under ``path`` that were written to their end, the newest first."""
    there, files = _hadoop(spark, path)
    if not files.exists(there):
        return []
    names = [f.getPath().getName() for f in files.listStatus(there) if f.isDirectory() and f.getPath().getName().startswith("saved-")]
    return [f"{path}/{n}" for n in sorted(names, reverse=True) if files.exists(_hadoop(spark, f"{path}/{n}/_SUCCESS")[0])]


def snapshot(buckets: DataFrame, path: str, now: float) -> None:
    """Write the heads of the bucket table beside the snapshot before it, which goes when this one is whole."""
    spark, before = buckets.sparkSession, _complete(buckets.sparkSession, path)
    made = heads(buckets).withColumn("v", F.lit(VERSION)).withColumn("rules", F.lit(RULES)).withColumn("saved_at", F.lit(int(now)))
    made.coalesce(1).write.mode("overwrite").parquet(f"{path}/saved-{int(now * 1000):016d}")  # a day's heads are some 100,000 rows at most
    for old in before:
        there, files = _hadoop(spark, old)
        if old != f"{path}/saved-{int(now * 1000):016d}":
            files.delete(there, True)


def restore(saved: DataFrame, now: float, minutes: int = 1440) -> DataFrame:
    """(minute, family, key, label, cnt) of what is sound, and an ``excluded`` row for each kind of entry that is not.

    Rows of another version or other rules give nothing. Minutes beyond the
    window or the next one are ignored. A minute with more than ``MOST_ENTRIES``
    entries in a family is ignored whole; otherwise bad keys, counts and labels
    are dropped one by one and counted, and so is what exceeds the family's
    heads. A tag keeps its count when its label is dropped.
    """
    last = int(now // 60)
    if "label" not in saved.columns:
        saved = saved.withColumn("label", F.lit(None).cast("string"))
    same = saved.where((F.col("v") == VERSION) & (F.col("rules") == RULES) & (F.col("minute") > last - minutes) & (F.col("minute") <= last + 1))
    size = F.count(F.lit(1)).over(Window.partitionBy("minute", "family"))
    sized = same.withColumn("size", size).withColumn("worst", F.max("size").over(Window.partitionBy("minute"))).where(F.col("worst") <= MOST_ENTRIES)
    names = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    invalid = F.concat(F.lit("checkpoint_invalid_"), F.coalesce(names[F.col("family")], F.lit("exclusion")))
    bad = F.when(F.col("cnt").isNull() | (F.col("cnt") < 0) | (F.col("cnt") > MOST_COUNT), "checkpoint_invalid_count").when(~valid_key_udf("family", "key"), invalid)
    sized = sized.withColumn("sound", (F.col("family") == "tag") & valid_label_udf("key", "label"))
    rank = F.row_number().over(Window.partitionBy("minute", "family", "key").orderBy(F.col("label").isNull(), F.desc("sound"), F.desc("cnt"), "label"))
    named = F.col("sound") & (rank <= LABELS)
    judged = sized.withColumn("bad", bad).withColumn("unnamed", F.col("label").isNotNull() & ~named).withColumn("label", F.when(named, F.col("label")))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv]), F.col("family")), F.lit(MOST_ENTRIES))
    totals = judged.where("bad is null").groupBy("minute", "family", "key").agg(F.sum("cnt").alias("total"))
    placed = totals.withColumn("place", F.row_number().over(Window.partitionBy("minute", "family").orderBy(F.desc("total"), "key"))).select("minute", "family", "key", (F.col("place") > most).alias("over"))
    done = judged.join(placed, ["minute", "family", "key"], "left").withColumn("bad", F.coalesce("bad", F.when(F.col("over"), invalid)))
    kept = done.where("bad is null").select("minute", "family", "key", "label", "cnt")
    reasons = done.select("minute", F.explode(F.filter(F.array("bad", F.when(F.col("unnamed"), "checkpoint_invalid_label")), lambda x: x.isNotNull())).alias("key"))
    lost = reasons.groupBy("minute", "key").agg(F.count(F.lit(1)).alias("cnt"))
    none = F.lit(None).cast("string").alias("label")
    charged = lost.select("minute", F.lit("excluded").alias("family"), "key", none, "cnt").unionByName(lost.select("minute", F.lit("candidate").alias("family"), F.lit("").alias("key"), none, "cnt"))
    return kept.unionByName(charged).groupBy("minute", "family", "key", "label").agg(F.sum("cnt").alias("cnt"))


def load(spark: SparkSession, path: str, now: float) -> DataFrame:
    """What the newest whole snapshot of the last ``LIFE`` seconds gives back; nothing, and never an error, if there is none or it can't be read."""
    for one in _safely(lambda: _complete(spark, path), []):

        def read(one=one) -> DataFrame | None:
            saved = spark.read.parquet(one)
            when = saved.agg(F.max("saved_at")).first()[0]
            if when is None or now - when > LIFE:
                return None
            kept = restore(saved.select("minute", "family", "key", "label", "cnt", "v", "rules"), now).persist()  # bounded by the heads of a day
            kept.count()
            return kept

        found = _safely(read, None)
        if found is not None:
            return found
    return spark.createDataFrame([], "minute bigint, family string, key string, label string, cnt bigint")


def _safely(act, otherwise):
    try:
        return act()
    except Exception as e:  # noqa: BLE001  # an unreadable checkpoint must not keep a service from starting
        _log.warning("a checkpoint can't be used: %.200s", e)
        return otherwise
