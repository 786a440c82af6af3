"""Minute buckets and the aggregates over windows of them.

A bucket table is long: ``(minute, family, key, label, cnt)``. Families are tag,
url, domain, emoji, lang, post (all posts of the minute), candidate and
excluded. It is a rollup: windows add up buckets and never see events again.
Partition it by hour to let Catalyst prune what a window doesn't need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec

WINDOWS = {"5m": 5, "1h": 60, "24h": 1440}
TTL = {"5m": 60, "1h": 300, "24h": 900}
TOP = 50
SMALL_TOP = 25
FAMILIES = {"tags": "tag", "links": "url", "domains": "domain", "emoji": "emoji"}
#: Keys that a checkpoint keeps of each minute and family.
HEADS = {"tag": 20, "url": 20, "domain": 20, "emoji": 10, "lang": 15}

#: Labels that a checkpoint keeps of a tag.
LABELS = 3


def minute(ts: Column) -> Column:
    """Whole minutes since the epoch of a timestamp."""
    return F.floor(F.unix_micros(ts) / 60_000_000).cast("bigint")


def signals(posts: DataFrame) -> DataFrame:
    """(source, ts, arrival, minute, family, pos, key, label): each signal of each post, in the order in which it is decided."""

    def placed(column: str, family: str, rank: int) -> Column:
        return F.transform(column, lambda x, i: F.struct(F.lit(rank).alias("rank"), F.lit(family).alias("family"), i.alias("pos"), x.alias("key")))

    arrays = [placed(c, f, r) for r, (c, f) in enumerate(FAMILIES.items())]
    base = posts.withColumn("minute", F.floor(F.col("ts") / 60).cast("bigint"))
    clock = [c for c in ("arrival",) if c in posts.columns]
    each = base.select("source", "ts", *clock, "minute", "labels", F.explode(F.concat(*arrays)).alias("s"))
    label = F.when(F.col("s.family") == "tag", F.col("labels")[F.col("s.key")])
    return each.select("source", "ts", *clock, "minute", "s.family", "s.rank", "s.pos", "s.key", label.alias("label"))


def own_counts(posts: DataFrame) -> DataFrame:
    """(minute, family, key, label, n): what a post counts by itself: post, language, candidates and its exclusions."""
    base = posts.withColumn("minute", F.floor(F.col("ts") / 60).cast("bigint"))
    sizes = F.size("tags") + F.size("links") + F.size("domains") + F.size("emoji")
    out = F.aggregate(F.map_values("exclusions"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    one = F.lit(1).cast("bigint")
    rows = F.array(
        F.struct(F.lit("post").alias("family"), F.lit("").alias("key"), one.alias("n")),
        F.struct(F.lit("lang").alias("family"), F.col("lang").alias("key"), one.alias("n")),
        F.struct(F.lit("candidate").alias("family"), F.lit("").alias("key"), (sizes + out).alias("n")),
    )
    left = F.transform(F.map_entries("exclusions"), lambda e: F.struct(F.lit("excluded").alias("family"), e["key"].alias("key"), e["value"].alias("n")))
    return base.select("minute", F.explode(F.concat(rows, left)).alias("e")).select("minute", "e.family", "e.key", F.lit(None).cast("string").alias("label"), "e.n")


def decided_counts(decided: DataFrame) -> DataFrame:
    """(minute, family, key, label, n) of signals with a ``reason``: what was accepted, and what was excluded by reason."""
    taken = F.col("reason").isNull()
    return decided.select(
        "minute",
        F.when(taken, F.col("family")).otherwise("excluded").alias("family"),
        F.when(taken, F.col("key")).otherwise(F.col("reason")).alias("key"),
        F.when(taken, F.col("label")).alias("label"),
        F.lit(1).cast("bigint").alias("n"),
    )


def bucket(posts: DataFrame, decided: DataFrame) -> DataFrame:
    """The bucket table of posts and of their signals, as ``ledger.accept`` decided them."""
    return decided_counts(decided).unionByName(own_counts(posts)).groupBy("minute", "family", "key", "label").agg(F.sum("n").alias("cnt"))


def sentiment_buckets(posts: DataFrame) -> DataFrame:
    scored = posts.where("sentiment is not null")
    return scored.groupBy(F.floor(F.col("ts") / 60).cast("bigint").alias("minute"), "lang").agg(F.sum("sentiment").alias("sent_sum"), F.count(F.lit(1)).alias("sent_cnt"))


def in_window(buckets: DataFrame, window: str, now: float, minutes: int | None = None) -> DataFrame:
    """Buckets of the last whole minutes, the current one with them: (now - W, now]."""
    last, width = int(now // 60), minutes or WINDOWS[window]
    return buckets.where((F.col("minute") > last - width) & (F.col("minute") <= last))


def merged(buckets: DataFrame, now: float, windows: dict[str, int] | None = None) -> DataFrame:
    """(window, family, key, label, cnt) for all windows in one pass: an array of the windows that hold a minute is exploded."""
    windows, last = windows or WINDOWS, int(now // 60)
    held = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(m).alias("m")) for w, m in windows.items()]), lambda x: F.col("minute") > last - x["m"])
    near = buckets.where((F.col("minute") > last - max(windows.values())) & (F.col("minute") <= last))
    return near.withColumn("window", F.explode(F.transform(held, lambda x: x["w"]))).groupBy("window", "family", "key", "label").agg(F.sum("cnt").alias("cnt"))


def ranked(counts: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The n greatest counts of each group, ties by key; ``rank`` is their place."""
    order = Window.partitionBy(*(by or [])).orderBy(F.desc("cnt"), "key") if by else Window.orderBy(F.desc("cnt"), "key")
    if not by:
        counts = counts.orderBy(F.desc("cnt"), "key").limit(n)  # only these reach the one partition of the window
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def label_majority(counts: DataFrame) -> DataFrame:
    """(key, label): the most frequent label of each key, ties by label."""
    each = counts.where("label is not null").groupBy("key", "label").agg(F.sum("cnt").alias("cnt"))
    return each.groupBy("key").agg(F.min_by("label", F.struct(-F.col("cnt"), "label")).alias("display"))


def top(buckets: DataFrame, family: str, window: str, now: float, n: int = TOP) -> DataFrame:
    held = in_window(buckets, window, now).where(F.col("family") == family)
    return ranked(held.groupBy("key").agg(F.sum("cnt").alias("cnt")), n)


def trending_hashtags(buckets: DataFrame, window: str, now: float, n: int = TOP) -> DataFrame:
    """(rank, tag, display, count)."""
    best = top(buckets, "tag", window, now, n)
    labels = in_window(buckets, window, now).where("family = 'tag'").join(F.broadcast(best.select("key")), "key", "left_semi")  # n keys at most
    return best.join(label_majority(labels), "key", "left").select("rank", F.col("key").alias("tag"), F.coalesce("display", "key").alias("display"), F.col("cnt").alias("count"))


def lang_mix(buckets: DataFrame, window: str, now: float, n: int = SMALL_TOP) -> DataFrame:
    """(lang, is_rest, cnt, share) of the n most frequent languages; the others are one row, marked so that a language named other stays apart."""
    held = in_window(buckets, window, now).where("family = 'lang'").groupBy("key").agg(F.sum("cnt").alias("cnt"))
    order = Window.orderBy(F.desc("cnt"), "key")  # one row a language
    placed = held.withColumn("rest", F.row_number().over(order) > n)
    folded = placed.groupBy(F.when(F.col("rest"), "other").otherwise(F.col("key")).alias("lang"), F.col("rest").alias("is_rest")).agg(F.sum("cnt").alias("cnt"))
    return folded.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy()))


def posts_per_minute(buckets: DataFrame, window: str, now: float) -> DataFrame:
    """(posts, ppm): over the whole width of the window, however short the history."""
    held = in_window(buckets, window, now).where("family = 'post'").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("posts"))
    return held.withColumn("ppm", F.col("posts") / WINDOWS[window])


def transparency(buckets: DataFrame, window: str, now: float) -> DataFrame:
    """(total_posts, candidates, accepted, excluded): candidates are what was accepted and what was excluded."""
    held = in_window(buckets, window, now)
    total = lambda *families: F.coalesce(F.sum(F.when(F.col("family").isin(*families), F.col("cnt"))), F.lit(0))
    return held.agg(total("post").alias("total_posts"), total("candidate").alias("candidates"), total("tag", "url", "domain", "emoji").alias("accepted"), total("excluded").alias("excluded"))


def exclusions(buckets: DataFrame, window: str, now: float) -> DataFrame:
    held = in_window(buckets, window, now).where("family = 'excluded'")
    return held.groupBy(F.col("key").alias("reason")).agg(F.sum("cnt").alias("cnt"))


def sentiment_average(scores: DataFrame, window: str, now: float) -> DataFrame:
    held = in_window(scores, window, now).groupBy("lang").agg(F.sum("sent_sum").alias("s"), F.sum("sent_cnt").alias("n"))
    return held.where("n > 0").select("lang", (F.col("s") / F.col("n")).alias("avg"), "n")


def heads(buckets: DataFrame, labels: int = LABELS) -> DataFrame:
    """What a checkpoint keeps: the first keys of each minute and family, and the first labels of each tag; sentiment never.

    What other labels of a kept tag count stays with it, under no label.
    """
    each = buckets.groupBy("minute", "family", "key", "label").agg(F.sum("cnt").alias("cnt"))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv]), F.col("family")), F.lit(1024))
    keys = each.groupBy("minute", "family", "key").agg(F.sum("cnt").alias("total"))
    placed = keys.withColumn("place", F.row_number().over(Window.partitionBy("minute", "family").orderBy(F.desc("total"), "key")))
    kept = each.join(placed.where(F.col("place") <= most).select("minute", "family", "key"), ["minute", "family", "key"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("minute", "family", "key").orderBy(F.col("label").isNull(), F.desc("cnt"), "label"))
    named = kept.withColumn("label", F.when(rank <= labels, F.col("label")))
    return named.groupBy("minute", "family", "key", "label").agg(F.sum("cnt").alias("cnt"))


def merge_slices(slices: DataFrame, n: int = TOP, counts_col: str = "counts") -> DataFrame:
    """(rank, key, cnt, keys) of maps of counts added up, saturating at the greatest 64-bit integer; keys is how many there are."""
    each = slices.select(F.explode(counts_col).alias("key", "c"))
    # decimals cannot overflow here; the sum of bigints could
    sums = each.groupBy("key").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    bounded = sums.select("key", F.least("s", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint").alias("cnt"))
    total = bounded.agg(F.count(F.lit(1)).alias("keys"))
    return ranked(bounded, n).crossJoin(total).select("rank", "key", "cnt", "keys")


def merge_packed(slices: DataFrame, n: int = TOP, raw_col: str = "raw", index_col: str = "index") -> tuple[DataFrame, bytes]:
    """``merge_slices`` of packed maps, and the merged top as canonical bytes; one bad slice fails all, and the error names the first."""
    read = slices.select(F.col(index_col).alias("index"), codec.counts_udf(F.col(raw_col)).alias("x")).persist()
    try:
        bad = read.where("x.error is not null").orderBy("index").select("index", "x.error").first()
        if bad is not None:
            raise ValueError(f"slice {bad['index']}: {bad['error']}")
        rows = merge_slices(read.select("x.counts"), n).orderBy("rank").collect()  # n rows at most
    finally:
        read.unpersist()
    made = slices.sparkSession.createDataFrame([tuple(r) for r in rows], "rank int, key string, cnt bigint, keys bigint")
    return made, codec.pack({r["key"]: r["cnt"] for r in rows})


def hit_rate(reads: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """(hits, misses, errors, hit_rate): the rate is null without reads, and errors are outside it."""
    of = lambda x: F.count_if(F.col(outcome_col) == x)
    sums = reads.agg(of("hit").alias("hits"), of("miss").alias("misses"), of("error").alias("errors"))
    return sums.withColumn("hit_rate", F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses")).cast("double")))
