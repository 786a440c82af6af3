"""Published aggregates: assembled from buckets, packed, stored under their keys, read without recomputing."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import buckets as B
from ..operators.checkpoint import RULES

_log = logging.getLogger(__name__)

OPERATIONS = ("trending_hashtags", "trending_links", "lang_mix", "posts_per_minute", "top_emoji")
SECRET = "language_sentiment"


@dataclass(frozen=True)
class Settings:
    """From the environment, by upper-cased names with the prefix ``TIDEWELL_``."""

    namespace: str = "tidewell"
    tick_seconds: float = 15.0
    checkpoint_seconds: float = 120.0
    top_n: int = 50
    master_key: str | None = None

    @classmethod
    def from_env(cls) -> Settings:
        given = {k: os.environ[n] for k in cls.__dataclass_fields__ if (n := f"TIDEWELL_{k.upper()}") in os.environ}
        casts = {"tick_seconds": float, "checkpoint_seconds": float, "top_n": int}
        return cls(**{k: casts.get(k, str)(v) for k, v in given.items()})

    def __post_init__(self) -> None:
        key = self.master_key
        if key is not None and (len(key) != 64 or any(c not in "0123456789abcdefABCDEF" for c in key)):
            raise ValueError("the master key is 64 hex digits")


@dataclass
class Store:
    """Bytes by key with a time to live, by a clock that can be given."""

    clock: Callable[[], float] = time.monotonic
    values: dict[str, tuple[bytes, float | None]] = field(default_factory=dict)

    def get(self, key: str) -> bytes | None:
        value, until = self.values.get(key, (None, None))
        if until is not None and self.clock() > until:
            del self.values[key]
            return None
        return value

    def set(self, key: str, value: bytes, ttl: float | None = None) -> None:
        self.values[key] = value, None if ttl is None else self.clock() + ttl

    def delete(self, key: str) -> bool:
        return self.values.pop(key, None) is not None

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def keys(self) -> list[str]:
        return sorted(k for k in list(self.values) if self.exists(k))


def cache_key(namespace: str, operation: str, window: str) -> str:
    """The key of a published value; names that aren't published are refused."""
    if operation not in (*OPERATIONS, SECRET) or window not in B.WINDOWS or operation == SECRET and window != "1h":
        raise ValueError(f"nothing is published as {operation} of {window}")
    return codec.key(namespace, operation, window)


def cache_keys(namespace: str) -> list[str]:
    """All keys that are ever written: each operation and window, and the secret one."""
    return [cache_key(namespace, o, w) for o in OPERATIONS for w in B.WINDOWS] + [cache_key(namespace, SECRET, "1h")]


def value(buckets: DataFrame, operation: str, window: str, now: float, top_n: int = 50) -> dict:
    """The document of one operation; rounding is Python's, which no Spark function shares.

    The languages beyond the first add up under ``other``; where a language of
    that name is among the first, ``other`` holds it and ``rest`` the remainder.
    """
    if operation not in OPERATIONS:
        raise ValueError(f"no operation {operation}")
    total = B.transparency(buckets, window, now).first()
    doc = {
        "window": window,
        "generated_at": int(now),
        "normalization_version": RULES,
        "total_posts": total["total_posts"],
        "total_events_considered": total["total_posts"],
        "total_signal_candidates": total["candidates"],
        "excluded_count_by_reason": {r["reason"]: r["cnt"] for r in B.exclusions(buckets, window, now).orderBy("reason").collect()},
    }
    if operation == "trending_hashtags":
        rows = B.trending_hashtags(buckets, window, now, top_n).orderBy("rank").collect()
        return doc | {"hashtags": [{"tag": r["tag"], "display": r["display"], "count": r["count"]} for r in rows]}
    if operation == "trending_links":
        best = lambda f: B.top(buckets, f, window, now, top_n).orderBy("rank").collect()
        return doc | {"links": [{"uri": r["key"], "count": r["cnt"]} for r in best("url")], "domains": [{"domain": r["key"], "count": r["cnt"]} for r in best("domain")]}
    if operation == "lang_mix":
        rows = sorted(B.lang_mix(buckets, window, now).collect(), key=lambda r: (r["is_rest"], -r["cnt"], r["lang"]))  # SMALL_TOP + 1 rows at most
        langs = {r["lang"]: round(r["share"], 4) for r in rows if not r["is_rest"]}
        rest = [round(r["share"], 4) for r in rows if r["is_rest"]]
        return doc | {"langs": langs | ({"other": rest[0]} if rest and "other" not in langs else {})} | ({"rest": rest[0]} if rest and "other" in langs else {})
    if operation == "posts_per_minute":
        return doc | {"ppm": round(B.posts_per_minute(buckets, window, now).first()["ppm"], 3)}
    return doc | {"emoji": [{"emoji": r["key"], "count": r["cnt"]} for r in B.top(buckets, "emoji", window, now, B.SMALL_TOP).orderBy("rank").collect()]}


def sentiment_value(scores: DataFrame, window: str, now: float) -> dict:
    rows = B.sentiment_average(scores, window, now).orderBy("lang").collect()
    return {"window": window, "generated_at": int(now), "normalization_version": RULES, "langs": {r["lang"]: {"avg": round(r["avg"], 4), "n": r["n"]} for r in rows}}


def encrypt(spark: SparkSession, raw: bytes, key: str) -> bytes:
    return bytes(spark.createDataFrame([(raw, bytes.fromhex(key))], "v binary, k binary").select(F.aes_encrypt("v", "k", F.lit("GCM")).alias("x")).first()["x"])


def publish(buckets: DataFrame, store: Store, window: str, now: float, settings: Settings, scores: DataFrame | None = None, health: Health | None = None) -> int:
    """Store all operations of a window; how many. A failed one keeps its old value, as values are made before they are stored; it is logged and counted."""
    done, secret = 0, window == "1h" and settings.master_key and scores is not None
    held = B.in_window(buckets, window, now).persist()  # five projections of one scan
    try:
        for operation in (*OPERATIONS, *([SECRET] if secret else [])):
            try:
                if operation == SECRET:
                    raw = encrypt(buckets.sparkSession, codec.pack(sentiment_value(scores, window, now)), settings.master_key)
                else:
                    raw = codec.pack(value(held, operation, window, now, settings.top_n))
                store.set(cache_key(settings.namespace, operation, window), raw, B.TTL[window])
                done += 1
            except Exception as e:  # noqa: BLE001
                _log.warning("%s of %s keeps its old value: %.200s", operation, window, e)
                if health is not None:
                    health.failed += 1
    finally:
        held.unpersist()
    if done and health is not None:
        health.published()
    return done


@dataclass
class Health:
    """Liveness of a service: what it saw, and when."""

    clock: Callable[[], float] = time.time
    connected: bool = False
    seen: int = 0
    missing_source: int = 0
    dropped: int = 0
    failed: int = 0
    last_event: float | None = None
    last_publish: float | None = None

    def __post_init__(self) -> None:
        self.started = self.clock()

    def batch(self, counts: dict[str, int], missing_source: int = 0) -> None:
        """Outcomes of a batch of frames (``extract.outcomes``): whatever has a usable time is an event."""
        usable = counts.get("post", 0) + counts.get("other", 0)
        self.seen += usable
        self.dropped += sum(counts.values()) - usable
        self.missing_source += missing_source
        if usable:
            self.last_event = self.clock()

    def published(self) -> None:
        self.last_publish = self.clock()

    def snapshot(self) -> tuple[int, dict]:
        """(status, body): 503 while the source isn't connected."""
        now = self.clock()
        age = lambda t: None if t is None else round(now - t, 1)
        return 200 if self.connected else 503, {
            "status": "ok" if self.connected else "degraded",
            "connected": self.connected,
            "events_seen": self.seen,
            "events_missing_source": self.missing_source,
            "frames_dropped": self.dropped,
            "publish_failures": self.failed,
            "last_event_age_seconds": age(self.last_event),
            "last_publish_age_seconds": age(self.last_publish),
            "uptime_seconds": round(now - self.started, 1),
        }


def tick(buckets: Callable[[], DataFrame], store: Store, last: dict[str, float], now: float, settings: Settings, scores: Callable[[], DataFrame] | None = None, health: Health | None = None) -> list[str]:
    """Publish the windows that are due, and note when; a trigger calls this every ``settings.tick_seconds``."""
    ready = due(last, now)
    for window in ready:
        publish(buckets(), store, window, now, settings, scores() if scores else None, health)
        last[window] = now
    return ready


def due(last: dict[str, float], now: float) -> list[str]:
    """Windows whose half time to live has passed since they were published."""
    return [w for w, ttl in B.TTL.items() if now - last.get(w, float("-inf")) >= ttl / 2]


@dataclass
class Reads:
    hits: int = 0
    misses: int = 0
    errors: int = 0

    def snapshot(self) -> dict:
        reads = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "errors": self.errors, "hit_rate": self.hits / reads if reads else None}


def serve(store: Store, operation: str, window: str, reads: Reads, namespace: str = "tidewell", expected: str | None = None) -> tuple[int, dict]:
    """(status, body) of a read: names are checked before anything is read, and a miss is never recomputed."""
    if operation == "stats":
        return 200, reads.snapshot()
    if operation not in OPERATIONS:
        return 404, {"error": "unknown_operation", "operations": list(OPERATIONS)}
    if window not in B.WINDOWS:
        return 400, {"error": "invalid_window", "windows": list(B.WINDOWS)}
    try:
        raw = store.get(cache_key(namespace, operation, window))
    except Exception as e:  # noqa: BLE001
        reads.errors += 1
        return 502 if isinstance(e, (OSError, TimeoutError)) else 500, {"error": "backend_error"}
    if raw is None:
        reads.misses += 1
        return 404, {"error": "miss", "operation": operation, "window": window}
    report = codec.verify(raw, expected)
    if not report["valid"] or report["matches"] is False:
        reads.errors += 1
        return 500, {"error": "integrity_check_failed", "checksum": report["checksum"]}
    reads.hits += 1
    return 200, {"operation": operation, "window": window, "checksum": report["checksum"], "data": safe_numbers(codec.unpack(raw))}


@dataclass
class ResponseCache:
    """Answers of ``serve`` for a short while: hits longer than what isn't there; statistics never."""

    clock: Callable[[], float] = time.monotonic
    hit_seconds: float = 15.0
    miss_seconds: float = 10.0
    held: dict = field(default_factory=dict)

    def serve(self, store: Store, operation: str, window: str, reads: Reads, namespace: str = "tidewell") -> tuple[int, dict]:
        name, now = (operation, window), self.clock()
        if name in self.held and now < self.held[name][0]:
            return self.held[name][1]
        answer = serve(store, operation, window, reads, namespace)
        seconds = {200: self.hit_seconds, 404: self.miss_seconds}.get(answer[0])
        if seconds and operation in OPERATIONS:
            self.held[name] = now + seconds, answer
        return answer


def key_info(operation: str, window: str, namespace: str = "tidewell") -> tuple[int, dict]:
    """(status, body) of the question under which key a value is, and how long it lives."""
    try:
        key = cache_key(namespace, operation, window)
    except ValueError as e:
        return 400, {"error": str(e)}
    return 200, {"key": key, "namespace": namespace, "operation": operation, "window": window, "ttl_seconds": B.TTL[window]}


def verify_info(raw: bytes, expected: str | None = None) -> tuple[int, dict]:
    """(status, body) of a check of any bytes."""
    try:
        report = codec.verify(raw, expected)
    except ValueError as e:
        return 400, {"error": str(e)}
    return 200, {"size_bytes": report["bytes"], "xxh3_64": report["checksum"], "valid_value": report["valid"], "matches_expected": report["matches"]}


def read_info(store: Store, operation: str, window: str, namespace: str = "tidewell") -> tuple[int, dict]:
    """(status, body) of a raw read: the stored bytes' size, checksum and, where they are one document, value."""
    status, body = key_info(operation, window, namespace)
    if status != 200:
        return status, body
    raw = store.get(body["key"])
    if raw is None:
        return 404, {"key": body["key"], "found": False}
    report = verify_info(raw)[1]
    return 200, {"key": body["key"], "found": True, **report, "value": safe_numbers(codec.unpack(raw)) if report["valid_value"] else None}


def raw_state(store: Store, key: str, plain: tuple[str, ...] = ()) -> str:
    """absent, present, or ciphertext: bytes that are no document and show none of the ``plain`` markers."""
    raw = store.get(key)
    if raw is None:
        return "absent"
    if codec.verify(raw)["valid"]:
        return "present"
    if any(m.encode() in raw for m in plain):
        raise ValueError("a marker stands in the clear")
    return "ciphertext"


def service_info(namespace: str = "tidewell") -> dict:
    return {"namespace": namespace, "operations": list(OPERATIONS), "windows": dict(B.TTL)}


def ranked_rows(items: DataFrame, name_col: str, value_col: str, n: int = 10) -> DataFrame:
    """(rank, name, value, bar): the n greatest of the rows that have a name and a finite number, and each one's share of the first (1 at least)."""
    amount = F.col(value_col).cast("double")
    sound = items.where(F.col(name_col).isNotNull() & amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf")))
    best = B.ranked(sound.select(F.col(name_col).cast("string").alias("key"), amount.alias("cnt")), n)
    first = F.greatest(F.max("cnt").over(Window.partitionBy()), F.lit(1.0))  # n rows
    return best.select("rank", F.col("key").alias("name"), F.col("cnt").alias("value"), (F.greatest("cnt", F.lit(0.0)) / first).alias("bar"))


def safe_numbers(x):
    """Integers that a JSON reader's doubles can't hold, as strings."""
    if isinstance(x, dict):
        return {k: safe_numbers(v) for k, v in x.items()}
    if isinstance(x, list):
        return [safe_numbers(v) for v in x]
    return str(x) if type(x) is int and abs(x) > 1 << 53 else x


def stale(generated_at: int, window: str, now: float) -> bool:
    return now - generated_at > B.TTL[window]
