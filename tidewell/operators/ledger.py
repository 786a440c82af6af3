"""Bounds on what one source contributes: the first of equal signals in five minutes counts.

The clock is the time of arrival, not the event's own, which its sender chooses.
``fold`` is the rule over the sorted arrivals of one (source, family, key); the
batch form runs it inside Spark's expressions, the streaming form keeps it as
keyed state (``streaming.ledger``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HORIZON = 300
SOURCE_CAP = 1024
GLOBAL_CAP = 100_000


def fold(times: Column, horizon: int = HORIZON) -> Column:
    """The accepted ones of ascending times: each at least ``horizon`` after the one accepted before it."""
    start = F.array().cast("array<double>")
    return F.aggregate(times, start, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= horizon), F.concat(kept, F.array(t))).otherwise(kept))


def fold_count(times: Column, horizon: int = HORIZON) -> Column:
    """How many ``fold`` accepts: it keeps the last one and a number."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("n"))
    return F.aggregate(times, start, lambda a, t: F.when(a["last"].isNull() | (t - a["last"] >= horizon), F.struct(t.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a))["n"]


def accept(signals: DataFrame, arrival_col: str = "arrival", horizon: int = HORIZON, global_cap: int | None = None, source_cap: int = SOURCE_CAP) -> DataFrame:
    """``signals`` with ``reason``: null where accepted, else missing_source_x, duplicate_source_x or rate_limited_source_x.

    Signals are decided in the order of arrival, family and position. A source of
    at most ``source_cap`` different signals can't reach its bound, so each of its
    signals is decided by itself and a hot source is spread over many tasks; only
    sources with more are decided as wholes. Rows stream through in sorted
    order, and a task holds the live tuples of one source, never its history.
    Signals are shuffled once; sources with more are known by hashes of 8 bytes,
    one for ``source_cap`` signals at most, which are broadcast. Sources whose
    hashes meet are decided as wholes too, which is right for any source.
    ``signals`` are read several times: write them, or what they are made of, before.
    ``global_cap`` bounds the live tuples of all sources, which is one decision
    after the other: with it all signals go to one task, so it is for replays.
    """
    schema = T.StructType([*signals.schema.fields, T.StructField("reason", T.StringType())])
    place = [arrival_col, "rank", "pos"]
    lost = signals.where("source is null").withColumn("reason", F.concat(F.lit("missing_source_"), "family"))
    known = signals.where("source is not null")
    if global_cap is not None:
        done = known.repartition(1).sortWithinPartitions(*place).mapInPandas(_decide(arrival_col, horizon, global_cap, source_cap), schema)
        return done.unionByName(lost)
    one, source, wide = ["source", "family", "key"], F.xxhash64("source").alias("_source"), "_wide"
    # only sources of many signals can have many different ones
    busy = known.groupBy(source).count().where(F.col("count") > source_cap).select("_source")
    each = known.select(source, *one).join(F.broadcast(busy), "_source", "left_semi").groupBy("_source", *one).agg(F.lit(1).alias("one"))
    several = each.groupBy("_source").count().where(F.col("count") > source_cap).select("_source", F.lit(True).alias(wide))
    marked = known.withColumn("_source", source).join(F.broadcast(several), "_source", "left").select(*signals.columns, F.coalesce(wide, F.lit(False)).alias(wide))
    by = [F.col("source"), *(F.when(~F.col(wide), F.col(c)) for c in one[1:])]
    return marked.repartition(*by).sortWithinPartitions(*by, *place).mapInArrow(_decide_each(wide, arrival_col, horizon, source_cap), schema).unionByName(lost)


def _as_before(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is the one before it."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    return pc.or_(pc.equal(a, b).fill_null(False), pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _decide_each(wide: str, arrival_col: str, horizon: int, source_cap: int):
    """Decisions over rows that come sorted by signal and arrival, or, of wide sources, by source and arrival."""

    def run(batches):
        before = last = book = None
        for batch in batches:
            if not batch.num_rows:
                continue
            family, whole, times = batch["family"], batch[wide].to_numpy(zero_copy_only=False), batch[arrival_col].cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()
            ends = [tuple(batch[c][i].as_py() for c in ("source", "family", "key")) for i in (0, -1)]
            again = np.empty(batch.num_rows, bool)
            again[0] = before is not None and (before[0] == ends[0][0] if whole[0] else before == ends[0])
            again[1:] = _as_before(batch["source"]) & (whole[1:] | _as_before(family) & _as_before(batch["key"]))
            before = ends[1]
            if whole.any():
                reasons = []
                for same, by_source, *signal, t in zip(again.tolist(), whole.tolist(), family.to_pylist(), batch["key"].to_pylist(), times, strict=True):
                    if by_source:
                        book = book if same else Book(horizon, source_cap)
                        reasons.append(book.decide(*signal, t))
                    elif same and t - last < horizon:
                        reasons.append(f"duplicate_source_{signal[0]}")
                    else:
                        last = t
                        reasons.append(None)
                reasons = pa.array(reasons, pa.string())
            else:
                left = []
                for same, t in zip(again.tolist(), times, strict=True):
                    left.append(same and t - last < horizon)
                    if not left[-1]:
                        last = t
                reasons = pc.if_else(pa.array(left), pc.binary_join_element_wise("duplicate_source_", family, ""), pa.scalar(None, pa.string()))
            names = [c for c in batch.schema.names if c != wide]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), reasons], [*names, "reason"])

    return run


def _decide(arrival_col: str, horizon: int, global_cap: int, source_cap: int):
    """Decisions over all rows, which come sorted by arrival."""

    def run(batches):
        whole = Whole(horizon, global_cap, source_cap)
        for batch in batches:
            batch["reason"] = [whole.decide(*x) for x in zip(batch["source"], batch["family"], batch["key"], batch[arrival_col], strict=True)]
            yield batch

    return run


class Book:
    """The live tuples of one source."""

    def __init__(self, horizon: int = HORIZON, cap: int = SOURCE_CAP, live: dict | None = None):
        self.horizon, self.cap, self.live = horizon, cap, live or {}

    def decide(self, family: str, key: str, now: float) -> str | None:
        last = self.live.get((family, key))
        if last is not None and now - last < self.horizon:
            return f"duplicate_source_{family}"
        if last is None and len(self.live) >= self.cap:
            self.live = {k: t for k, t in self.live.items() if now - t < self.horizon}
            if len(self.live) >= self.cap:
                return f"rate_limited_source_{family}"
        self.live[family, key] = now
        return None


class Whole:
    """Books of several sources under one bound on their live tuples."""

    def __init__(self, horizon: int = HORIZON, cap: int | None = None, source_cap: int = SOURCE_CAP):
        self.horizon, self.cap, self.source_cap, self.books, self.size = horizon, cap, source_cap, {}, 0

    def put(self, source: str, family: str, key: str, at: float) -> None:
        """A tuple that was accepted before."""
        self.books.setdefault(source, Book(self.horizon, self.source_cap)).live[family, key] = at
        self.size += 1

    def expire(self, now: float) -> None:
        for b in self.books.values():
            b.live = {k: t for k, t in b.live.items() if now - t < self.horizon}
        self.books = {s: b for s, b in self.books.items() if b.live}
        self.size = sum(len(b.live) for b in self.books.values())

    def decide(self, source: str, family: str, key: str, now: float) -> str | None:
        book = self.books.setdefault(source, Book(self.horizon, self.source_cap))
        if self.cap is not None and (family, key) not in book.live and self.size >= self.cap:
            self.expire(now)
            book = self.books.setdefault(source, book)
            if len(book.live) < self.source_cap and self.size >= self.cap:
                return f"rate_limited_global_{family}"
        before = len(book.live)
        reason = book.decide(family, key, now)
        self.size += len(book.live) - before
        return reason
