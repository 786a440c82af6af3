"""The operators over the driver's tables, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, text_rules, web_rules
from ..functions.extract import COLLECTION, outcomes, posts
from ..operators import buckets as B
from ..operators import checkpoint
from ..operators.ledger import HORIZON, accept, fold_count
from ..shared import remove, written
from . import publish

DAY = 86_400
WIDE = {"5m": 5, "1h": 60, "24h": 1440, "7d": 10_080}
_SINCE = "timestamp_ntz'1970-01-01 00:00:00'"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with seconds and minutes since the epoch, whatever the session's time zone."""
    return _table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"), F.expr(f"timestampdiff(MICROSECOND, {_SINCE}, cast(ts as timestamp_ntz))").alias("us")).withColumn("minute", F.expr("us div 60000000"))


_TAG, _LINK = "app.bsky.richtext.facet#tag", "app.bsky.richtext.facet#link"
#: Arrival of the posts that are made of events: events of a user are squeezed, so that many repeat within the ledger's horizon.
_SQUEEZE = 512


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw frames of posts: tags and links as facets, some of them unusable, an embed, emoji, words that are scored, and now and then no source."""
    e = _events(spark, d).repartition("event_id")  # a file of one row group would keep one task busy with all frames
    k, uid = F.col("k").cast("bigint"), F.col("user_id").cast("bigint")

    def facet(kind: str, name: str, value, when=None):
        one = F.struct(F.array(F.struct(F.lit(kind).alias("$type"), (value if name == "tag" else F.lit(None).cast("string")).alias("tag"), (value if name == "uri" else F.lit(None).cast("string")).alias("uri"))).alias("features"))
        return one if when is None else F.when(when, one)

    url = F.concat(F.lit("HTTPS://Example.COM/p/"), F.col("k"), F.lit("?utm_source=x&id="), F.col("k"), F.lit("#top"))
    facets = F.filter(
        F.array(
            facet(_TAG, "tag", F.initcap("event_type"), k % 2 == 0),
            facet(_TAG, "tag", F.col("event_type"), k % 3 != 0),
            facet(_TAG, "tag", F.lit("SPAM"), k % 7 == 0),
            facet(_TAG, "tag", F.lit("not a tag"), k % 5 == 0),
            facet(_LINK, "uri", url, k % 4 != 0),
            facet(_LINK, "uri", F.lit("ftp://example.com/x"), k % 6 == 0),
            facet(_LINK, "uri", F.lit("http://printer.lan/"), k % 9 == 0),
            facet(_LINK, "uri", F.lit("https://a.pornhub.com/"), k % 10 == 0),
        ),
        lambda x: x.isNotNull(),
    )
    text = F.concat(F.when(k % 3 == 0, "so good #Plain ").otherwise(F.lit("")), F.when(k % 5 == 1, "bad day ").otherwise(F.lit("")), F.when(k % 2 == 1, "\U0001f525\U0001f525 \u26bd").otherwise(F.lit("")))
    langs = F.when(k % 8 == 0, F.array().cast("array<string>")).when(k % 8 == 1, F.array(F.lit("ja-JP"), F.lit("en"))).otherwise(F.array(F.lit("EN")))
    embed = F.when(k % 11 == 0, F.struct(F.lit("app.bsky.embed.external").alias("$type"), F.struct(url.alias("uri")).alias("external")))
    frame = F.struct(
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("user-"), uid.cast("string"))).alias("did"),
        F.col("us").alias("time_us"),
        F.lit("commit").alias("kind"),
        F.struct(F.lit("create").alias("operation"), F.lit(COLLECTION).alias("collection"), F.struct(text.alias("text"), langs.alias("langs"), facets.alias("facets"), embed.alias("embed")).alias("record")).alias("commit"),
    )
    return e.select(F.to_json(frame).alias("value"), (F.col("us") / (_SQUEEZE * 1e6)).alias("arrival"))


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return posts(_frames(spark, d), 4e9, arrival_col="arrival")


def _from_posts(spark: SparkSession, d: str, name: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives for the posts and their decided signals. Each frame is read once: posts are written for it, and go when the result is."""
    made, folder = written(_posts(spark, d), "posts")
    try:
        return written(make(made, accept(B.signals(made).drop("ts"))), name)[0]
    finally:
        remove(spark, folder)


def _buckets(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    """The bucket table of the frames, which stays for the caller to read; now is the minute of the last event (one row)."""
    return _from_posts(spark, d, "buckets", B.bucket), _events(spark, d).agg(F.max("minute")).first()[0] * 60.0


_EV = "WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS minute FROM events), n AS (SELECT max(minute) AS now_min FROM e)"


def ppm_by_window(spark, d):
    buckets, now = _buckets(spark, d)
    counts = B.merged(buckets, now, WIDE).where("family = 'post'")
    widths = F.create_map(*[F.lit(x) for kv in WIDE.items() for x in kv])
    return counts.select("window", F.col("cnt").alias("posts"), (F.col("cnt") / widths[F.col("window")]).alias("ppm"))


def minute_buckets(spark, d):
    """The whole rollup, through extraction and ledger."""
    return _buckets(spark, d)[0]


def extraction(spark, d):
    """What each post has of each family, and why something is left out."""
    made = _posts(spark, d)
    return made.groupBy("lang", (F.col("source").isNull()).alias("lost"), F.size("tags").alias("tags"), F.size("links").alias("links"), F.size("domains").alias("domains"), F.size("emoji").alias("emoji"), "sentiment").agg(F.count(F.lit(1)).alias("posts"))


def in_event_distinct(spark, d):
    made = _posts(spark, d).select(F.explode("exclusions").alias("reason", "n"))
    return made.groupBy("reason").agg(F.sum("n").alias("cnt"))


def trending(spark, d):
    buckets, now = _buckets(spark, d)
    return B.top(buckets, "url", "24h", now).select("rank", "key", "cnt")


def trending_tags(spark, d):
    buckets, now = _buckets(spark, d)
    return B.trending_hashtags(buckets, "24h", now)


def top_emoji(spark, d):
    buckets, now = _buckets(spark, d)
    return B.top(buckets, "emoji", "24h", now, B.SMALL_TOP).select("rank", F.col("key").alias("emoji"), "cnt")


def transparency(spark, d):
    buckets, now = _buckets(spark, d)
    return B.transparency(buckets, "24h", now)


def exclusions(spark, d):
    buckets, now = _buckets(spark, d)
    return B.exclusions(buckets, "24h", now)


def sentiment_by_language(spark, d):
    now = _events(spark, d).agg(F.max("minute")).first()[0] * 60.0
    return B.sentiment_average(B.sentiment_buckets(_posts(spark, d)), "24h", now)


def published_documents(spark, d):
    """The documents of a window as published and read back: one row a field, list entry or map entry."""
    buckets, now = _buckets(spark, d)
    store, rows = publish.Store(), []
    publish.publish(buckets, store, "24h", now, publish.Settings())
    for operation in publish.OPERATIONS:  # five documents of at most 50 entries a list
        status, body = publish.serve(store, operation, "24h", publish.Reads())
        for name, x in body["data"].items() if status == 200 else ():
            if isinstance(x, dict):
                rows += [(operation, name, k, None, float(v)) for k, v in x.items()]
            elif isinstance(x, list):
                rows += [(operation, name, next(v for k, v in i.items() if k not in ("display", "count")), i.get("display"), float(i["count"])) for i in x]
            elif name not in ("window", "normalization_version"):
                rows.append((operation, name, None, None, float(x)))
    return spark.createDataFrame(rows, "operation string, field string, key string, display string, amount double")


def restored_checkpoint(spark, d):
    """The heads of the bucket table, written as a snapshot's rows and taken back as untrusted ones."""
    buckets, now = _buckets(spark, d)
    saved = B.heads(buckets).withColumn("v", F.lit(checkpoint.VERSION)).withColumn("rules", F.lit(checkpoint.RULES))
    return checkpoint.restore(saved, now)


def packed_merge(spark, d):
    """Counts by day as packed slices, decoded strictly and merged."""
    slices = _events(spark, d).groupBy(F.expr("minute div 1440").alias("index"), "k").agg(F.count(F.lit(1)).alias("n")).groupBy("index").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))
    pack = F.udf(lambda m: codec.pack(dict(m)), "binary")  # a packed map a day
    return B.merge_packed(slices.select("index", pack("counts").alias("raw")), 10)[0]


def ranked_rows(spark, d):
    counts = _events(spark, d).groupBy(F.col("k").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return publish.ranked_rows(counts, "name", "n").select("rank", "name", "value", "bar")


def canonical_links(spark, d):
    return _table(spark, d, "pages").select("page_id", web_rules.link_udf("url").alias("l")).select("page_id", "l.uri", "l.domain", "l.reason")


def trending_domains(spark, d):
    counts = canonical_links(spark, d).where("domain is not null").groupBy(F.col("domain").alias("key")).agg(F.count(F.lit(1)).alias("cnt"))
    return B.ranked(counts, B.TOP).select("rank", F.col("key").alias("domain"), "cnt")


def tracking_strip(spark, d):
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return _table(spark, d, "pages").select("page_id", web_rules.without_tracking_sql(query).alias("query"))


def lang_mix_top_rest(spark, d):
    buckets = _table(spark, d, "documents").groupBy(F.lit("lang").alias("family"), text_rules.language(F.col("lang")).alias("key")).agg(F.count(F.lit(1)).alias("cnt")).withColumn("minute", F.lit(0).cast("bigint"))
    return B.lang_mix(buckets, "5m", 0, 2)


def top_families(spark, d):
    counts = _events(spark, d).groupBy("event_type", F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("cnt"))
    return B.ranked(counts, 3, ["event_type"])


def source_accepts(spark, d):
    """Of each (user, type), events at least a day after the one accepted before."""
    times = _events(spark, d).groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.col("us") / 1e6)).alias("t"))
    return times.select("user_id", "event_type", F.size("t").alias("seen"), fold_count(F.col("t"), DAY).alias("accepted"))


def excluded_by_reason(spark, d):
    """The ledger over the frames' signals, by family."""
    return _from_posts(spark, d, "excluded", lambda _, decided: decided.groupBy("family", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("cnt")))


def conservation_check(spark, d):
    """Candidates are what was accepted and what was excluded, minute by minute; those that aren't."""
    buckets, _ = _buckets(spark, d)
    total = lambda *f: F.coalesce(F.sum(F.when(F.col("family").isin(*f), F.col("cnt"))), F.lit(0))
    sums = buckets.groupBy("minute").agg(total("candidate").alias("candidates"), total("tag", "url", "domain", "emoji").alias("accepted"), total("excluded").alias("excluded"))
    return sums.agg(F.sum("candidates").alias("candidates"), F.sum("accepted").alias("accepted"), F.sum("excluded").alias("excluded"), F.count_if(F.expr("candidates <> accepted + excluded")).alias("unbalanced"))


def slice_merge_topn(spark, d):
    slices = _events(spark, d).groupBy(F.expr("minute div 1440").alias("day"), "k").agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))
    return B.merge_slices(slices, 10)


def label_majority(spark, d):
    counts = _events(spark, d).groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    return B.label_majority(counts)


def checkpoint_heads(spark, d):
    hours = _events(spark, d).withColumn("minute", F.expr("minute div 1440")).groupBy("minute", F.lit("emoji").alias("family"), F.col("k").alias("key"), F.lit(None).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    return B.heads(hours)


def hit_rate(spark, d):
    outcome = F.create_map(*[F.lit(x) for x in ("click", "hit", "view", "miss", "error", "error")])[F.col("event_type")]
    return B.hit_rate(_events(spark, d).withColumn("outcome", outcome))


def tags_in_texts(spark, d):
    found = _table(spark, d, "documents").where(F.col("text").rlike("[#\\uFF03\\uFE5F]")).select("doc_id", F.explode(text_rules.tags_in_udf("text")).alias("t"))
    return found.select("doc_id", text_rules.tag_udf("t").alias("x")).select("doc_id", "x.tag", "x.display", "x.reason")


def frame_outcomes(spark, d):
    """What becomes of raw frames: posts, other events, broken ones, and those dated beyond the skew of a clock that is a day behind."""
    events = _events(spark, d)
    now = events.agg(F.max("us")).first()[0] / 1e6 - DAY
    own = F.when(F.col("event_id") % 10 == 0, F.lit("{")).when(F.col("event_id") % 10 == 1, F.concat(F.lit('{"kind":"identity","time_us":'), F.col("us").cast("string"), F.lit("}")))
    frames = events.select(own.alias("value")).where("value is not null").unionByName(_frames(spark, d).select("value"))
    return outcomes(frames, now).groupBy("outcome", "missing_source").agg(F.count(F.lit(1)).alias("cnt"))


def frames_lang_mix(spark, d):
    """Documents as raw frames of posts, through extraction and buckets."""
    docs = _table(spark, d, "documents")
    record = F.struct(F.col("text"), F.array("lang").alias("langs"))
    frame = F.struct(
        F.col("source").alias("did"),
        (F.lit(1_700_000_000_000_000) + F.col("doc_id") * 1_000_000).alias("time_us"),
        F.lit("commit").alias("kind"),
        F.struct(F.lit("create").alias("operation"), F.lit(COLLECTION).alias("collection"), record.alias("record")).alias("commit"),
    )
    made = posts(docs.select(F.to_json(frame).alias("value")), 4e9)
    return made.groupBy(F.floor(F.col("ts") / 60).cast("bigint").alias("minute"), "lang").agg(F.count(F.lit(1)).alias("cnt"))


QUERIES = {
    f.__name__: f
    for f in (ppm_by_window, minute_buckets, extraction, in_event_distinct, trending, trending_tags, top_emoji, transparency, exclusions, sentiment_by_language, published_documents, restored_checkpoint,
              packed_merge, ranked_rows, canonical_links, trending_domains, tracking_strip, lang_mix_top_rest, top_families, source_accepts, excluded_by_reason, conservation_check, slice_merge_topn,
              label_majority, checkpoint_heads, hit_rate, tags_in_texts, frame_outcomes, frames_lang_mix)
}

_WIDTHS = ", ".join(f"('{w}', {m})" for w, m in WIDE.items())
_TRACKING = ", ".join(f"'{x}'" for x in sorted(web_rules.TRACKING))
_STRIP = f"array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: lower(string_split(p, '=')[1]) NOT IN ({_TRACKING})), '&')"
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
_FOLD = f"""{_EV}, o AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM e),
r AS (WITH RECURSIVE w AS (
    SELECT user_id, event_type, i, t AS last, true AS ok FROM o WHERE i = 1
    UNION ALL SELECT o.user_id, o.event_type, o.i, CASE WHEN o.t - w.last >= {DAY} THEN o.t ELSE w.last END, o.t - w.last >= {DAY}
    FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.i = w.i + 1) SELECT * FROM w)"""
#: The frames in SQL: what each post has (p), its signals (g) as the ledger decides them (d), its exclusions (x), and the bucket table (b).
_HAS = "(k % 2 = 0 OR k % 3 <> 0)"
_LINKED = "(k % 4 <> 0 OR k % 11 = 0)"
_LEFT = {
    "duplicate_in_event_tag": "k % 2 = 0 AND k % 3 <> 0", "filtered_tag": "k % 7 = 0", "malformed_tag": "k % 5 = 0", "duplicate_in_event_url": "k % 4 <> 0 AND k % 11 = 0",
    "duplicate_in_event_domain": "k % 4 <> 0 AND k % 11 = 0", "unsafe_scheme": "k % 6 = 0", "unsafe_host": "k % 9 = 0", "filtered_domain": "k % 10 = 0", "duplicate_in_event_emoji": "k % 2 = 1",
}
_GLAD, _SORRY = "((k % 3 = 0)::INT + 2 * (k % 2 = 1)::INT)", "(k % 5 = 1)::INT"
_SIGNAL = lambda family, key, label, where: f"SELECT event_id, user_id, arrival, minute, '{family}' AS family, {key} AS key, {label} AS label FROM p WHERE {where}"
_G = " UNION ALL ".join(
    [
        _SIGNAL("tag", f"CASE WHEN {_HAS} THEN event_type ELSE 'plain' END", "CASE WHEN k % 2 = 0 THEN upper(event_type[1]) || event_type[2:] WHEN k % 3 <> 0 THEN event_type ELSE 'Plain' END", "true"),
        _SIGNAL("url", "'https://example.com/p/' || k || '?id=' || k", "NULL", _LINKED),
        _SIGNAL("domain", "'example.com'", "NULL", _LINKED),
        _SIGNAL("emoji", "'\U0001f525'", "NULL", "k % 2 = 1"),
        _SIGNAL("emoji", "'\u26bd'", "NULL", "k % 2 = 1"),
    ]
)
_X = " UNION ALL ".join(f"SELECT minute, '{reason}' AS reason FROM p WHERE {when}" for reason, when in _LEFT.items())
_P = f"""WITH p AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us, epoch_us(ts) / {_SQUEEZE}e6 AS arrival, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS minute FROM events),
n AS (SELECT max(minute) AS now_min FROM p),
p2 AS (SELECT *, CASE WHEN k % 8 = 0 THEN 'und' WHEN k % 8 = 1 THEN 'ja' ELSE 'en' END AS lang, {_GLAD} AS glad, {_SORRY} AS sorry FROM p),
x AS ({_X})"""
_D = f"""{_P}, g AS ({_G}),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, family, key ORDER BY arrival) AS i FROM g WHERE event_id % 13 <> 0),
r AS (WITH RECURSIVE w AS (
    SELECT user_id, family, key, i, arrival AS last, true AS ok FROM o WHERE i = 1
    UNION ALL SELECT o.user_id, o.family, o.key, o.i, CASE WHEN o.arrival - w.last >= {HORIZON} THEN o.arrival ELSE w.last END, o.arrival - w.last >= {HORIZON}
    FROM w JOIN o ON o.user_id = w.user_id AND o.family = w.family AND o.key = w.key AND o.i = w.i + 1) SELECT * FROM w),
d AS (
    SELECT o.minute, o.family, o.key, o.label, CASE WHEN r.ok THEN NULL ELSE 'duplicate_source_' || o.family END AS reason FROM o JOIN r USING (user_id, family, key, i)
    UNION ALL SELECT minute, family, key, label, 'missing_source_' || family FROM g WHERE event_id % 13 = 0)"""
_B = f"""{_D}, each AS (
    SELECT minute, family, key, label, 1 AS n FROM d WHERE reason IS NULL
    UNION ALL SELECT minute, 'excluded', reason, NULL, 1 FROM d WHERE reason IS NOT NULL
    UNION ALL SELECT minute, 'excluded', reason, NULL, 1 FROM x
    UNION ALL SELECT minute, 'post', '', NULL, 1 FROM p2
    UNION ALL SELECT minute, 'lang', lang, NULL, 1 FROM p2
    UNION ALL SELECT minute, 'candidate', '', NULL, 1 FROM g
    UNION ALL SELECT minute, 'candidate', '', NULL, 1 FROM x),
b AS (SELECT minute, family, key, label, count(*) AS cnt FROM each GROUP BY ALL),
day AS (SELECT b.* FROM b, n WHERE minute > now_min - 1440)"""
_TOP = lambda family, n: f"(SELECT *, row_number() OVER (ORDER BY cnt DESC, key) AS rank FROM (SELECT key, CAST(sum(cnt) AS BIGINT) AS cnt FROM day WHERE family = '{family}' GROUP BY key) QUALIFY rank <= {n})"
_SUM = lambda *families: "CAST(coalesce(sum(cnt) FILTER (family IN (" + ", ".join(f"'{f}'" for f in families) + ")), 0) AS BIGINT)"
_LABELS = "(SELECT key, label FROM day WHERE family = 'tag' GROUP BY key, label QUALIFY row_number() OVER (PARTITION BY key ORDER BY sum(cnt) DESC, label) = 1)"
_TAGS = f"(SELECT t.rank, t.key AS tag, l.label AS display, t.cnt AS count FROM {_TOP('tag', 50)} t JOIN {_LABELS} l USING (key))"
_OPS = ", ".join(f"('{o}')" for o in publish.OPERATIONS)
_W = r"[\p{L}\p{M}\p{N}_]"

SQL = {
    "ppm_by_window": f"{_B} SELECT w AS \"window\", CAST(sum(cnt) AS BIGINT) AS posts, sum(cnt) / any_value(m) AS ppm FROM b, n, (VALUES {_WIDTHS}) v(w, m) WHERE family = 'post' AND minute > now_min - m GROUP BY w",
    "minute_buckets": f"{_B} SELECT * FROM b",
    "extraction": f"{_P} SELECT lang, event_id % 13 = 0 AS lost, 1 AS tags, {_LINKED}::INT AS links, {_LINKED}::INT AS domains, 2 * (k % 2 = 1)::INT AS emoji, CASE WHEN glad + sorry > 0 THEN (glad - sorry) / (glad + sorry) END AS sentiment, count(*) AS posts FROM p2 GROUP BY ALL",
    "in_event_distinct": f"{_P} SELECT reason, count(*) AS cnt FROM x GROUP BY reason",
    "trending": f"{_B} SELECT rank, key, cnt FROM {_TOP('url', 50)}",
    "trending_tags": f"{_B} SELECT * FROM {_TAGS}",
    "top_emoji": f"{_B} SELECT rank, key AS emoji, cnt FROM {_TOP('emoji', 25)}",
    "transparency": f"{_B} SELECT {_SUM('post')} AS total_posts, {_SUM('candidate')} AS candidates, {_SUM('tag', 'url', 'domain', 'emoji')} AS accepted, {_SUM('excluded')} AS excluded FROM day",
    "exclusions": f"{_B} SELECT key AS reason, CAST(sum(cnt) AS BIGINT) AS cnt FROM day WHERE family = 'excluded' GROUP BY key",
    "sentiment_by_language": f"{_P} SELECT lang, avg((glad - sorry) / (glad + sorry)) AS avg, count(*) AS n FROM p2, n WHERE glad + sorry > 0 AND minute > now_min - 1440 GROUP BY lang",
    "published_documents": f"""{_B}, head AS (SELECT {_SUM('post')} AS posts, {_SUM('candidate')} AS candidates FROM day), langs AS (SELECT key, sum(cnt) AS c FROM day WHERE family = 'lang' GROUP BY key)
        SELECT operation, field, NULL AS key, NULL AS display, CAST(amount AS DOUBLE) AS amount FROM (VALUES {_OPS}) v(operation), (SELECT unnest(['total_posts', 'total_events_considered', 'total_signal_candidates', 'generated_at']) AS field, unnest([posts, posts, candidates, 60 * now_min]) AS amount FROM head, n)
        UNION ALL SELECT operation, 'excluded_count_by_reason', key, NULL, sum(cnt) FROM (VALUES {_OPS}) v(operation), day WHERE family = 'excluded' GROUP BY operation, key
        UNION ALL SELECT 'trending_hashtags', 'hashtags', tag, display, count FROM {_TAGS}
        UNION ALL SELECT 'trending_links', 'links', key, NULL, cnt FROM {_TOP('url', 50)}
        UNION ALL SELECT 'trending_links', 'domains', key, NULL, cnt FROM {_TOP('domain', 50)}
        UNION ALL SELECT 'lang_mix', 'langs', key, NULL, round(c / (SELECT sum(c) FROM langs), 4) FROM langs
        UNION ALL SELECT 'posts_per_minute', 'ppm', NULL, NULL, round(posts / 1440, 3) FROM head
        UNION ALL SELECT 'top_emoji', 'emoji', key, NULL, cnt FROM {_TOP('emoji', 25)}""",
    "restored_checkpoint": f"{_B} SELECT * FROM day",
    "packed_merge": f"{_EV}, c AS (SELECT k AS key, count(*) AS cnt FROM e GROUP BY ALL) SELECT row_number() OVER (ORDER BY cnt DESC, key) AS rank, key, cnt, (SELECT count(*) FROM c) AS keys FROM c QUALIFY rank <= 10",
    "ranked_rows": f"{_EV}, c AS (SELECT k AS name, count(*) AS n FROM e GROUP BY ALL) SELECT row_number() OVER (ORDER BY n DESC, name) AS rank, name, CAST(n AS DOUBLE) AS value, n / (SELECT max(n) FROM c) AS bar FROM c QUALIFY rank <= 10",
    "frame_outcomes": f"""{_P}, f AS (SELECT 'malformed' AS outcome, false AS missing_source FROM p WHERE event_id % 10 = 0
        UNION ALL SELECT CASE WHEN us > (SELECT max(us) FROM p) - 1000000::BIGINT * ({DAY} - 300) THEN 'skewed' ELSE 'other' END, false FROM p WHERE event_id % 10 = 1
        UNION ALL SELECT CASE WHEN us > (SELECT max(us) FROM p) - 1000000::BIGINT * ({DAY} - 300) THEN 'skewed' ELSE 'post' END, us <= (SELECT max(us) FROM p) - 1000000::BIGINT * ({DAY} - 300) AND event_id % 13 = 0 FROM p)
        SELECT outcome, missing_source, count(*) AS cnt FROM f GROUP BY ALL""",
    "tags_in_texts": rf"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_#])#({_W}+(?:-{_W}+)*)', 1)) AS t FROM documents) SELECT doc_id, CASE WHEN lower(t) IN ({', '.join(repr(x) for x in sorted(text_rules.BLOCKED_TAGS))}) THEN NULL ELSE replace(lower(t), 'ß', 'ss') END AS tag, CASE WHEN lower(t) IN ({', '.join(repr(x) for x in sorted(text_rules.BLOCKED_TAGS))}) THEN NULL ELSE t END AS display, CASE WHEN lower(t) IN ({', '.join(repr(x) for x in sorted(text_rules.BLOCKED_TAGS))}) THEN 'filtered_tag' END AS reason FROM t",
    "excluded_by_reason": f"{_D} SELECT family, coalesce(reason, 'accepted') AS reason, count(*) AS cnt FROM d GROUP BY ALL",
    "conservation_check": f"{_B}, m AS (SELECT minute, {_SUM('candidate')} AS candidates, {_SUM('tag', 'url', 'domain', 'emoji')} AS accepted, {_SUM('excluded')} AS excluded FROM b GROUP BY minute) SELECT CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(excluded) AS BIGINT) AS excluded, count(*) FILTER (candidates <> accepted + excluded) AS unbalanced FROM m",
    "checkpoint_heads": f"{_EV}, c AS (SELECT minute // 1440 AS minute, 'emoji' AS family, k AS key, CAST(NULL AS VARCHAR) AS label, count(*) AS cnt FROM e GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY minute ORDER BY cnt DESC, key) <= 10",
    "canonical_links": f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_STRIP} = '' THEN '' ELSE '?' || {_STRIP} END AS uri, {_HOST} AS domain, CAST(NULL AS VARCHAR) AS reason FROM pages",
    "trending_domains": f"WITH c AS (SELECT {_HOST} AS domain, count(*) AS cnt FROM pages GROUP BY ALL) SELECT row_number() OVER (ORDER BY cnt DESC, domain) AS rank, domain, cnt FROM c QUALIFY rank <= 50",
    "tracking_strip": f"SELECT page_id, {_STRIP} AS query FROM pages",
    "lang_mix_top_rest": "WITH c AS (SELECT lang, count(*) AS cnt FROM documents GROUP BY lang), r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, lang) > 2 AS is_rest FROM c) SELECT CASE WHEN is_rest THEN 'other' ELSE lang END AS lang, is_rest, CAST(sum(cnt) AS BIGINT) AS cnt, sum(cnt) / (SELECT sum(cnt) FROM c) AS share FROM r GROUP BY 1, 2",
    "top_families": f"{_EV}, c AS (SELECT event_type, k AS key, count(*) AS cnt FROM e GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY cnt DESC, key) AS rank FROM c QUALIFY rank <= 3",
    "source_accepts": f"{_FOLD} SELECT user_id, event_type, count(*) AS seen, count(*) FILTER (ok) AS accepted FROM r GROUP BY ALL",
    "slice_merge_topn": f"{_EV}, c AS (SELECT k AS key, count(*) AS cnt FROM e GROUP BY ALL) SELECT row_number() OVER (ORDER BY cnt DESC, key) AS rank, key, cnt, (SELECT count(*) FROM c) AS keys FROM c QUALIFY rank <= 10",
    "label_majority": "WITH c AS (SELECT user_id AS key, event_type AS display, count(*) AS n FROM events GROUP BY ALL) SELECT key, display FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, display) = 1",
    "hit_rate": "WITH c AS (SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type = 'view') AS misses, count(*) FILTER (event_type = 'error') AS errors FROM events) SELECT *, hits / nullif(hits + misses, 0) AS hit_rate FROM c",
    "frames_lang_mix": "SELECT CAST(floor((1700000000 + doc_id) / 60) AS BIGINT) AS minute, lang, count(*) AS cnt FROM documents GROUP BY ALL",
}
