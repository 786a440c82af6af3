"""Operator 6: URL lists with dates, joined as of the time of capture.

A list is a table of dated entries ``(value, verdict, action, at)``: from ``at``
on, ``action`` (``add`` or ``remove``) puts the domain ``value`` on the list of
that ``verdict`` (``block`` or ``allow``) or takes it off. Entries become
intervals of validity; a capture meets the entries of its host and of the
host's parent domains that were active when it was fetched. The longest domain
decides; at equal length ``block`` goes before ``allow``.

How it scales. Hosts are far fewer than captures, so list and parents meet once
for each distinct host, and a host's intervals come as one array. Captures then
join on the host, one row to one row: nothing multiplies, a hot host may be
split by the adaptive skew join, and a small host table is broadcast by
Catalyst's own size check. The HTML is never read.

Results that hold by definition:

* a null or malformed URL has a null host and the verdict ``none``, as has a
  capture without a time;
* an interval begins at its ``add`` and ends before the next ``remove``; of
  several actions on one day ``remove`` wins, and an ``add`` to an active entry
  changes nothing;
* entries without value, verdict or date are ignored, and so are repeated ones;
* every row of the captures gives one row, repeated rows too; other columns
  pass through, whatever their names, unless named like a result column;
* URLs are read whole, however long; ties are settled by the rule above, as two
  entries of one domain and verdict are one;
* an empty list gives ``none`` everywhere; empty captures give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, col, table

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
#: A standing list; the feed of ``feed`` comes on top of it.
STANDING = (
    ("cheap-pills.example.com", "block", "add", "2024-01-01"),
    ("spam-farm.example.org", "block", "add", "2024-02-01"),
    ("spam-farm.example.org", "block", "remove", "2024-09-01"),
    ("spam-farm.example.org", "block", "add", "2024-10-15"),
    ("example.net", "block", "add", "2024-12-01"),
)


def host(url) -> F.Column:
    found = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(value, verdict, since, till) for each span in which an entry is active; ``till`` is null while it lasts."""
    days = (
        entries.where("value is not null and verdict in ('block', 'allow') and action in ('add', 'remove') and at is not null")
        .groupBy(F.lower("value").alias("value"), "verdict", F.to_date("at").alias("since"))
        .agg(F.min(F.col("action") == "add").alias("on"))
    )
    following = F.lead("since").over(Window.partitionBy("value", "verdict").orderBy("since"))
    return days.withColumn("till", following).where("on").select("value", "verdict", "since", "till")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_on") -> DataFrame:
    """``captures`` with the columns host, verdict and entry (the domain that decided)."""
    at = captures.withColumn(f"{OWN}host", host(col(url_col).cast("string"))).withColumn(f"{OWN}at", F.to_date(col(time_col)))
    labels = F.split("h", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = at.select(F.col(f"{OWN}host").alias("h")).where("h is not null").distinct().select("h", F.explode(parents).alias("value"))
    span = F.struct(F.length("value").alias("size"), "verdict", "value", "since", "till")
    listed = hosts.join(intervals(entries), "value").groupBy(F.col("h").alias(f"{OWN}h")).agg(F.collect_list(span).alias(f"{OWN}spans"))
    both = at.join(listed, F.col(f"{OWN}host") == F.col(f"{OWN}h"), "left")
    day = F.col(f"{OWN}at")
    active = F.filter(f"{OWN}spans", lambda s: (s["since"] <= day) & (s["till"].isNull() | (day < s["till"])))
    best = F.array_max(F.transform(active, lambda s: F.struct(s["size"].alias("size"), s["verdict"].alias("verdict"), s["value"].alias("value"))))
    return both.withColumn(f"{OWN}best", best).select(
        *[col(c) for c in captures.columns if c not in ("host", "verdict", "entry")],
        F.col(f"{OWN}host").alias("host"),
        F.coalesce(F.col(f"{OWN}best.verdict"), F.lit("none")).alias("verdict"),
        F.col(f"{OWN}best.value").alias("entry"),
    )


def feed(pages: DataFrame) -> DataFrame:
    """Dated entries for a third of the hosts, drawn by their digests: a stand-in for a list provider's history."""
    digest = F.md5("value")
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("int")
    start = F.to_date(F.lit("2024-01-01"))
    hosts = pages.select(host(F.col("url")).alias("value")).where("value is not null").distinct()
    drawn = hosts.where(number(1, 2) < 86).select(
        "value",
        F.when(number(1, 2) < 16, "allow").otherwise("block").alias("verdict"),
        F.date_add(start, number(3, 2)).alias("first"),
        F.date_add(start, number(3, 2) + 1 + number(5, 2)).alias("last"),
        (number(7, 1) < 8).alias("ends"),
    )
    moves = F.array(
        F.struct(F.lit("add").alias("action"), F.col("first").alias("at")),
        F.when(F.col("ends"), F.struct(F.lit("remove").alias("action"), F.col("last").alias("at"))),
    )
    return drawn.select("value", "verdict", F.explode(moves).alias("m")).where("m is not null").select("value", "verdict", "m.action", "m.at")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the lists of its day; the table has no fetch time, so the page id gives one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 7919, 366) as int))"))
    standing = spark.createDataFrame(list(STANDING), "value string, verdict string, action string, at string").withColumn("at", F.to_date("at"))
    return evaluate(captures, standing.unionByName(feed(pages))).select("page_id", "host", "verdict", "entry")


_STANDING_SQL = ", ".join(f"('{v}', '{w}', '{a}', DATE '{d}')" for v, w, a, d in STANDING)
SQL = rf"""
WITH captures AS (
    SELECT page_id, row_number() OVER () AS n, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS day,
           nullif(rtrim(regexp_extract(lower(url), '{HOST}', 1), '.'), '') AS host
    FROM pages),
hosts AS (SELECT DISTINCT host AS value, md5(host) AS d FROM captures WHERE host IS NOT NULL),
drawn AS (
    SELECT value, CASE WHEN CAST('0x' || d[1:2] AS INTEGER) < 16 THEN 'allow' ELSE 'block' END AS verdict,
           DATE '2024-01-01' + CAST('0x' || d[3:4] AS INTEGER) AS first,
           DATE '2024-01-01' + CAST('0x' || d[3:4] AS INTEGER) + 1 + CAST('0x' || d[5:6] AS INTEGER) AS last,
           CAST('0x' || d[7:7] AS INTEGER) < 8 AS ends
    FROM hosts WHERE CAST('0x' || d[1:2] AS INTEGER) < 86),
entries AS (
    SELECT value, verdict, 'add' AS action, first AS moved FROM drawn
    UNION ALL SELECT value, verdict, 'remove', last FROM drawn WHERE ends
    UNION ALL SELECT * FROM (VALUES {_STANDING_SQL})),
days AS (SELECT value, verdict, moved AS since, bool_and(action = 'add') AS active FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY value, verdict ORDER BY since) AS till FROM days),
hits AS (
    SELECT n, max(struct_pack(size := length(value), verdict := verdict, value := value)) AS best
    FROM captures JOIN spans ON active AND (host = value OR ends_with(host, '.' || value)) AND since <= day AND (till IS NULL OR day < till)
    GROUP BY n)
SELECT page_id, host, coalesce(best.verdict, 'none') AS verdict, best.value AS entry FROM captures LEFT JOIN hits USING (n)
"""
