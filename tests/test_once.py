"""Work that grows with the stream is done once: each frame is decoded once, signals are shuffled once, links are remembered."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_rules import LINK, facet, post

from tidewell.functions import extract, web_rules
from tidewell.operators.ledger import Book, accept
from tidewell.plans import queries as Q
from tidewell.shared import shared_dir

D = "/root/testdata/sf0.001"
SIGNALS = "source string, arrival double, family string, rank int, pos int, key string"


@pytest.mark.skipif(not Path(D).exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["trending", "restored_checkpoint", "excluded_by_reason"])
def test_each_frame_is_decoded_once(spark, monkeypatch, name):
    seen, plain = spark.sparkContext.accumulator(0), Q._posts

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(Q, "_posts", lambda s, d: (made := plain(s, d)).mapInArrow(counted, made.schema))
    assert Q.QUERIES[name](spark, D).toArrow().num_rows > 0
    assert seen.value == spark.read.parquet(f"{D}/events.parquet").count()
    assert not list(Path(shared_dir(spark).removeprefix("file:")).glob("posts-*"))


@pytest.mark.skipif(not Path(D).exists(), reason="no tables here")
def test_one_row_group_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert Q._frames(spark, D).rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_links_are_remembered():
    event = post("", facets=[facet(**{"$type": LINK, "uri": "https://once.example.com/?utm_id=1"})])
    first = extract.features(event)
    hits = web_rules._link.cache_info().hits
    assert extract.features(event) == first and web_rules._link.cache_info().hits == hits + 1
    assert web_rules._link.cache_info().maxsize == web_rules.KNOWN


def test_ledger_against_replay(spark):
    """Sources within the bound, beyond it and without a name, over many small batches, against one book a source."""
    rows = [(None if i % 11 == 0 else f"s{i % 5}", float(i * 37 % 4000), "tag" if i % 3 else "url", i % 3, i, f"k{i * 7 % (3 if i % 5 < 3 else 40)}") for i in range(900)]
    books, want = {}, {}
    for source, at, family, _, i, key in sorted(rows, key=lambda r: (r[1], r[3], r[4])):
        want[i] = f"missing_source_{family}" if source is None else books.setdefault(source, Book(300, 8)).decide(family, key, at)
    assert {f"rate_limited_source_{f}" for f in ("tag", "url")} < set(want.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        decided = accept(spark.createDataFrame(rows, SIGNALS), source_cap=8)
        got = {r["pos"]: r["reason"] for r in decided.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert decided._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
