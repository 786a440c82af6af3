"""The source ledger as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import HORIZON, SOURCE_CAP, Whole


class LedgerProcessor(StatefulProcessor):
    """The live tuples of a source, or of a shard of sources, in a map state; expired ones are dropped when the key is visited."""

    def __init__(self, fields: list[str], arrival_col: str, horizon: int, cap: int | None, source_cap: int):
        self.fields, self.arrival, self.horizon, self.cap, self.source_cap = fields, arrival_col, horizon, cap, source_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "source string, family string, key string", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole, had = Whole(self.horizon, self.cap, self.source_cap), {}
        for k, v in self.live.iterator():
            had[k[0], k[1], k[2]] = v[0]
            whole.put(k[0], k[1], k[2], v[0])
        batch = pd.concat(list(rows)).sort_values([self.arrival, "rank", "pos"], kind="stable")
        batch["reason"] = [whole.decide(*x) for x in zip(batch["source"], batch["family"], batch["key"], batch[self.arrival], strict=True)]
        whole.expire(batch[self.arrival].max())
        now = {(s, *k): t for s, b in whole.books.items() for k, t in b.live.items()}
        for k, t in now.items():
            if had.get(k) != t:
                self.live.updateValue(k, (t,))
        for k in had.keys() - now.keys():
            self.live.removeKey(k)
        yield batch[[*self.fields, "reason"]]

    def close(self) -> None:
        pass


def accept_stream(signals: DataFrame, arrival_col: str = "arrival", horizon: int = HORIZON, shards: int | None = None, global_cap: int | None = None, source_cap: int = SOURCE_CAP) -> DataFrame:
    """``operators.ledger.accept`` over a stream, with state by source (set the RocksDB state store).

    A bound on all sources together is one decision after the other. With
    ``shards`` sources are dealt by a hash, each shard has its part of
    ``global_cap``, and one shard is the exact bound.
    """
    fields = signals.schema.fieldNames()
    known = signals.where("source is not null")
    by = "source"
    if shards is not None:
        known, by = known.withColumn("shard", F.pmod(F.xxhash64("source"), F.lit(shards))), "shard"
    cap = None if shards is None or global_cap is None else max(1, global_cap // shards)
    processor = LedgerProcessor(fields, arrival_col, horizon, cap, source_cap)
    done = known.groupBy(by).transformWithStateInPandas(processor, T.StructType([*signals.schema.fields, T.StructField("reason", T.StringType())]), outputMode="Append", timeMode="None")
    lost = signals.where("source is null").withColumn("reason", F.concat(F.lit("missing_source_"), "family"))
    return done.unionByName(lost)
