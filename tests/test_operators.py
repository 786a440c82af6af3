import json

import pytest
from pyspark.sql import functions as F
from test_rules import LINK, TAG, facet, post

from tidewell.functions import codec
from tidewell.functions import extract
from tidewell.functions.extract import posts
from tidewell.operators import buckets as B
from tidewell.operators import checkpoint as C
from tidewell.operators.ledger import accept, fold, fold_count
from tidewell.plans import publish as P
from tidewell.sources import replay

NOW = 1_700_000_040
SIGNALS = "source string, minute bigint, arrival double, family string, rank int, pos int, key string"


def frames():
    at = lambda minutes: (NOW - 60 * minutes) * 1_000_000
    out = [post(f"good #Tag{i % 2} 🔥", ["en"], did=f"s{i}", t=at(i % 4)) for i in range(8)]
    out += [post("#old bad", ["ja-JP"], did="s9", t=at(30)), post("#tag0 #tag0", did=None, t=at(0))]
    out += [post("", did="s0", t=at(1), facets=[facet(**{"$type": LINK, "uri": "https://example.com/?utm_id=1"}), facet(**{"$type": TAG, "tag": "x" * 99})])]
    return out + [{"kind": "identity", "time_us": at(0)}]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("f") / "frames.jsonl")
    replay.write_frames(frames(), path)
    rows = posts(replay.read_frames(spark, path), NOW)
    decided = accept(B.signals(rows).withColumn("arrival", F.col("ts")))
    return path, rows, B.bucket(rows, decided).cache()


def test_windows(made):
    _, rows, buckets = made
    assert rows.count() == 11
    tags = {r["tag"]: (r["count"], r["display"]) for r in B.trending_hashtags(buckets, "5m", NOW).collect()}
    assert tags == {"tag0": (4, "Tag0"), "tag1": (4, "Tag1")}
    assert [r["key"] for r in B.top(buckets, "tag", "1h", NOW).orderBy("rank").collect()] == ["tag0", "tag1", "old"]
    assert B.posts_per_minute(buckets, "5m", NOW).first()["ppm"] == 2.0
    assert {r["lang"]: r["cnt"] for r in B.lang_mix(buckets, "1h", NOW).collect()} == {"en": 8, "ja": 1, "und": 2}
    for w in B.WINDOWS:
        t = B.transparency(buckets, w, NOW).first()
        assert t["candidates"] == t["accepted"] + t["excluded"]
    assert {r["reason"]: r["cnt"] for r in B.exclusions(buckets, "5m", NOW).collect()} == {"duplicate_in_event_tag": 1, "missing_source_tag": 1, "malformed_tag": 1}
    assert B.in_window(buckets, "5m", NOW + 6 * 60).count() == 0
    merged = {(r["window"], r["key"]): r["cnt"] for r in B.merged(buckets, NOW).where("family = 'tag'").groupBy("window", "key").agg(F.sum("cnt").alias("cnt")).collect()}
    assert merged["24h", "old"] == 1 and ("5m", "old") not in merged
    s = {r["lang"]: r["avg"] for r in B.sentiment_average(B.sentiment_buckets(rows), "1h", NOW).collect()}
    assert s == {"en": 1.0, "ja": -1.0}


def test_publish(made, spark):
    _, rows, buckets = made
    clock = [0.0]
    store, reads = P.Store(lambda: clock[0]), P.Reads()
    settings = P.Settings(master_key="ab" * 32)
    assert P.publish(buckets, store, "1h", NOW, settings, B.sentiment_buckets(rows)) == 6
    status, body = P.serve(store, "trending_hashtags", "1h", reads)
    assert status == 200 and body["data"]["hashtags"][0] == {"tag": "tag0", "display": "Tag0", "count": 4}
    assert P.serve(store, "x", "1h", reads)[0] == 404 and P.serve(store, "lang_mix", "2h", reads)[0] == 400
    assert P.serve(store, "lang_mix", "5m", reads)[0] == 404
    secret = store.get(codec.key("tidewell", P.SECRET, "1h"))
    assert b"langs" not in secret
    clear = spark.createDataFrame([(secret, bytes.fromhex("ab" * 32))], "v binary, k binary").select(F.aes_decrypt("v", "k", F.lit("GCM")).alias("x")).first()["x"]
    assert codec.unpack(bytes(clear))["langs"]["en"]["avg"] == 1.0
    clock[0] = 301
    assert P.serve(store, "lang_mix", "1h", reads)[0] == 404
    assert reads.snapshot() == {"hits": 1, "misses": 2, "errors": 0, "hit_rate": 1 / 3}
    assert P.due({"5m": 0, "1h": 0, "24h": 0}, 150) == ["5m", "1h"] and P.stale(0, "5m", 61)
    with pytest.raises(ValueError):
        P.value(buckets, "nothing", "5m", NOW)
    with pytest.raises(ValueError):
        P.Settings(master_key="zz")


def test_ledger(spark):
    times = spark.createDataFrame([([0.0, 100.0, 299.0, 300.0, 450.0, 600.0, 900.0],)], "t array<double>")
    assert times.select(fold(F.col("t")).alias("k")).first()["k"] == [0.0, 300.0, 600.0, 900.0]
    rows = [("a", 0, float(t), "tag", 0, 0, "x") for t in (0, 299, 300)] + [(None, 0, 1.0, "url", 1, 0, "y")] + [("b", 0, 0.0, "tag", 0, i, f"k{i}") for i in range(1026)]
    got = accept(spark.createDataFrame(rows, SIGNALS)).groupBy("source", "reason").count().collect()
    assert {(r["source"], r["reason"]): r["count"] for r in got} == {("a", None): 2, ("a", "duplicate_source_tag"): 1, (None, "missing_source_url"): 1, ("b", None): 1024, ("b", "rate_limited_source_tag"): 2}
    capped = accept(spark.createDataFrame(rows[4:20], SIGNALS), global_cap=10).where("reason = 'rate_limited_global_tag'").count()
    assert capped == 6
    counted = times.select(fold_count(F.col("t")).alias("k")).first()["k"]
    assert counted == 4
    # spread by signal or decided as wholes: the same where no source reaches its bound
    many = [(f"s{i % 3}", 0, float(i * 40 % 977), "tag", 0, i, f"k{i % 5}") for i in range(300)]
    each = lambda **x: sorted((r["source"], r["pos"], r["reason"] or "") for r in accept(spark.createDataFrame(many, SIGNALS), **x).collect())
    assert each() == each(global_cap=10**6)


def test_ledger_stream_equals_batch(spark, tmp_path):
    from tidewell.streaming.ledger import accept_stream

    rows = [(f"s{i % 3}", 0, float(i * 40), "tag", 0, i, f"k{i % 2}") for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SIGNALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    signals = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    query = accept_stream(signals).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    key = lambda df: sorted((r["source"], r["arrival"], r["reason"] or "") for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(accept(spark.createDataFrame(rows, SIGNALS)))


def count_rows(df):
    return sorted((r["minute"], r["family"], r["key"], r["label"] or "", r["cnt"]) for r in df.groupBy("minute", "family", "key", "label").agg(F.sum("cnt").alias("cnt")).collect())


def stream_parts(spark, folder, parts):
    """Files of frames with their time of arrival, one a micro-batch."""
    for rows in parts:
        spark.createDataFrame([(json.dumps(f, ensure_ascii=False), float(t)) for f, t in rows], "value string, came double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("value string, came double").option("maxFilesPerTrigger", 1).parquet(folder)


def test_bucket_stream(spark, made, tmp_path):
    from tidewell.streaming.buckets import append_buckets, read_buckets, trim

    spark.dataSource.register(replay.ReplaySource)
    frames_ = spark.readStream.format("frames").option("path", made[0]).load()
    query = append_buckets(frames_, str(tmp_path / "b"), str(tmp_path / "c"), NOW)
    assert query.awaitTermination(120)
    # all arrive at once, so the ledger of arrival sees what the batch form sees
    assert count_rows(read_buckets(spark, str(tmp_path / "b"), NOW)) == count_rows(made[2])
    scores = spark.read.parquet(str(tmp_path / "b") + "-sentiment")
    own = lambda df: sorted((r["minute"], r["lang"], r["sent_sum"], r["sent_cnt"]) for r in df.select("minute", "lang", "sent_sum", "sent_cnt").collect())
    assert own(scores) == own(B.sentiment_buckets(made[1]))
    assert trim(spark, str(tmp_path / "b"), NOW) == [] and len(trim(spark, str(tmp_path / "b"), NOW + 3 * 86_400)) > 0


def test_bucket_stream_remembers(spark, tmp_path):
    """Six posts of one source with one tag, a second apart, in three micro-batches count once; the clock is arrival, not the post's own time."""
    from tidewell.streaming.buckets import append_buckets, read_buckets

    t = lambda k: (NOW - 60 * k) * 1_000_000
    rows = [(post("#same", did="one", t=t(k * 9)), NOW + k) for k in range(6)]
    rows += [(post("#same", did="one", t=t(1)), NOW + 400), (post("#same good", did="two", t=t(0)), NOW + 401), (post("#same", did=None, t=t(0)), NOW + 402)]
    stream = stream_parts(spark, str(tmp_path / "in"), [rows[:2], rows[2:4], rows[4:6], rows[6:]])
    query = append_buckets(stream, str(tmp_path / "b"), str(tmp_path / "c"), NOW + 500, arrival_col="came")
    assert query.awaitTermination(180)
    held = read_buckets(spark, str(tmp_path / "b"), NOW)
    tags = {r["key"]: r["n"] for r in held.where("family in ('tag', 'excluded')").groupBy("key").agg(F.sum("cnt").alias("n")).collect()}
    assert tags == {"same": 3, "duplicate_source_tag": 5, "missing_source_tag": 1}
    made = posts(spark.createDataFrame([(json.dumps(f), float(c)) for f, c in rows], "value string, arrival double"), NOW + 500, arrival_col="arrival")
    assert count_rows(B.bucket(made, accept(B.signals(made)))) == count_rows(held)
    assert "one" not in "".join(open(f, "rb").read().decode("latin-1") for f in (tmp_path / "c").rglob("*") if f.is_file())


def test_global_cap_stream(spark, tmp_path):
    """One shard is the exact bound; several have their parts of it."""
    from tidewell.streaming.ledger import accept_stream

    rows = [(f"s{i}", 0, float(i), "tag", 0, i, f"k{i}") for i in range(40)]
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SIGNALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for shards in (1, 3):
        signals = spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = accept_stream(signals, shards=shards, global_cap=30)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / f"o{shards}")).option("checkpointLocation", str(tmp_path / f"c{shards}")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        taken = spark.read.parquet(str(tmp_path / f"o{shards}")).where("reason is null").count()
        assert taken == 30 if shards == 1 else taken <= 30
    assert accept(spark.createDataFrame(rows, SIGNALS), global_cap=30).where("reason is null").count() == 30


def test_replay_source(spark, tmp_path):
    """Whole lines in parts of a few bytes, taken up where the last run ended."""
    path, lines = tmp_path / "f.jsonl", [f"line {i} é" for i in range(23)]
    spark.dataSource.register(replay.ReplaySource)

    def run():
        stream = spark.readStream.format("frames").option("path", str(path)).option("bytes", "30").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "o")).collect())

    path.write_text("".join(x + "\n" for x in lines[:9]) + "not whole")
    assert run() == sorted(lines[:9])
    path.write_text("".join(x + "\n" for x in lines))
    assert run() == sorted(lines)


def test_resuming():
    asked, pauses = [], []
    sent = [["a5", "x"], OSError(), OSError(), ["a3", "a9"], []]

    def connect(address):
        asked.append(address)
        got = sent[len(asked) - 1]
        if isinstance(got, Exception):
            raise got
        yield from got

    cursor = replay.resuming(connect, "wss://host.example/s", lambda f: int(f[1:]) if f[0] == "a" else None, pauses.append, attempts=5)
    assert cursor == 9 and pauses == [1, 2, 4, 1] and "cursor" not in asked[0] and [a.rpartition("=")[2] for a in asked[1:]] == ["5", "5", "5", "9"]


def test_outcomes(spark):
    raw = [json.dumps(post("x", did=None)), json.dumps({"kind": "identity", "time_us": 1}), "{", "[1]", json.dumps(post("x", t=1 << 62)), json.dumps({"time_us": "5"})]
    rows = spark.createDataFrame([(r,) for r in raw], "value string")
    got = extract.outcomes(rows, NOW).collect()
    assert [r["outcome"] for r in got] == ["post", "other", "malformed", "malformed", "skewed", "skewed"] and [r["missing_source"] for r in got] == [True] + [False] * 5
    assert extract.quarantine(rows, NOW).count() == 4
    clock = [100.0]
    health = P.Health(lambda: clock[0])
    assert health.snapshot()[0] == 503
    health.connected = True
    counts = {}
    for r in got:
        counts[r["outcome"]] = counts.get(r["outcome"], 0) + 1
    health.batch(counts, 1)
    clock[0] = 107.25
    status, body = health.snapshot()
    assert status == 200 and body["events_seen"] == 2 and body["frames_dropped"] == 4 and body["events_missing_source"] == 1 and body["last_event_age_seconds"] == 7.2 and body["last_publish_age_seconds"] is None


def test_documents(made):
    """The keys of the published documents, by operation."""
    head = {"window", "generated_at", "normalization_version", "total_posts", "total_events_considered", "total_signal_candidates", "excluded_count_by_reason"}
    own = {"trending_hashtags": {"hashtags"}, "trending_links": {"links", "domains"}, "lang_mix": {"langs"}, "posts_per_minute": {"ppm"}, "top_emoji": {"emoji"}}
    for operation, keys in own.items():
        doc = P.value(made[2], operation, "5m", NOW)
        assert set(doc) == head | keys and doc["excluded_count_by_reason"] == {"duplicate_in_event_tag": 1, "malformed_tag": 1, "missing_source_tag": 1}
        assert doc["total_signal_candidates"] == sum(r["cnt"] for r in made[2].where("family in ('tag','url','domain','emoji')").where(F.col("minute") > NOW // 60 - 5).collect()) + 3
    assert P.value(made[2], "trending_links", "5m", NOW)["links"] == [{"uri": "https://example.com/", "count": 1}]


def test_language_remainder(spark):
    langs = [("en", 30), *[(f"a{chr(97 + i)}", 5) for i in range(25)]]
    rows = lambda xs: spark.createDataFrame([(NOW // 60, "lang", k, None, n) for k, n in xs], "minute bigint, family string, key string, label string, cnt bigint")
    doc = P.value(rows(langs), "lang_mix", "5m", NOW)
    assert doc["langs"]["other"] == round(5 / 155, 4) and len(doc["langs"]) == 26 and list(doc["langs"])[0] == "en" and "rest" not in doc
    doc = P.value(rows([*langs, ("other", 100)]), "lang_mix", "5m", NOW)
    assert doc["langs"]["other"] == round(100 / 255, 4) and doc["rest"] == round(10 / 255, 4)


def test_endpoints(made, spark):
    clock, reads = [0.0], P.Reads()
    store, cache = P.Store(lambda: clock[0]), P.ResponseCache(lambda: clock[0])
    assert cache.serve(store, "top_emoji", "5m", reads)[0] == 404 and cache.serve(store, "top_emoji", "5m", reads)[0] == 404 and reads.misses == 1
    last, settings, health = {"1h": 0.0, "24h": 0.0}, P.Settings(), P.Health(lambda: 5.0)
    assert P.tick(lambda: made[2], store, last, 40, settings, health=health) == ["5m"] and health.last_publish == 5.0
    store.values.clear()
    assert P.publish(made[2], store, "5m", NOW, settings) == 5 and last["5m"] == 40
    clock[0] = 11
    assert cache.serve(store, "top_emoji", "5m", reads)[0] == 200 and cache.serve(store, "top_emoji", "5m", reads)[0] == 200 and reads.hits == 1
    assert cache.serve(store, "stats", "", reads) == (200, {"hits": 1, "misses": 1, "errors": 0, "hit_rate": 0.5})
    assert len(P.cache_keys("n")) == len(set(P.cache_keys("n"))) == 16 and set(store.keys()) <= set(P.cache_keys("tidewell"))
    status, info = P.key_info("lang_mix", "5m")
    assert status == 200 and info["ttl_seconds"] == 60 and P.key_info("nothing", "5m")[0] == 400 and P.key_info("lang_mix", "9m")[0] == 400 and P.key_info(P.SECRET, "5m")[0] == 400
    raw = store.get(info["key"])
    assert P.verify_info(raw, codec.checksum(raw))[1]["matches_expected"] is True and P.verify_info(raw, "zz")[0] == 400 and P.verify_info(b"CK")[1]["valid_value"] is False
    assert P.read_info(store, "lang_mix", "5m")[1]["value"]["window"] == "5m" and P.read_info(store, "lang_mix", "1h")[0] == 404 and P.read_info(store, "x", "1h")[0] == 400
    assert P.raw_state(store, info["key"]) == "present" and P.raw_state(store, "none") == "absent"
    store.set("secret", P.encrypt(spark, raw, "ab" * 32))
    assert P.raw_state(store, "secret", ("langs",)) == "ciphertext"
    store.set("leak", b"\xc1 langs")
    with pytest.raises(ValueError):
        P.raw_state(store, "leak", ("langs",))

    class Broken(P.Store):
        def get(self, key):
            raise OSError

    assert P.serve(Broken(), "lang_mix", "5m", reads)[0] == 502 and reads.errors == 1
    assert P.service_info()["windows"] == B.TTL
    broken = made[2].withColumn("cnt", F.raise_error(F.lit("no")).cast("bigint"))
    assert P.publish(broken, store, "5m", NOW, settings, health=health) == 0 and health.failed == 5 and store.get(info["key"]) == raw


def test_ranked_rows(spark):
    rows = [("a", 4.0), ("b", None), (None, 9.0), ("c", float("nan")), ("d", float("inf")), ("e", -2.0), ("f", 2.0)] + [(f"z{i}", 0.5) for i in range(12)]
    got = P.ranked_rows(spark.createDataFrame(rows, "n string, v double"), "n", "v").orderBy("rank").collect()
    assert [(r["name"], r["bar"]) for r in got][:3] == [("a", 1.0), ("f", 0.5), ("z0", 0.125)] and len(got) == 10


def test_checkpoint(spark, made, tmp_path):
    path = str(tmp_path / "snap")
    assert C.load(spark, path, NOW).count() == 0
    C.snapshot(made[2], path, NOW)
    back = C.load(spark, path, NOW)
    assert count_rows(back) == count_rows(made[2])
    same = lambda df: df.orderBy("rank").collect()
    assert same(B.trending_hashtags(back, "24h", NOW)) == same(B.trending_hashtags(made[2], "24h", NOW))
    assert C.load(spark, path, NOW + C.LIFE + 1).count() == 0
    # a write that broke off is passed over, and so is what can't be read
    (tmp_path / "snap" / f"saved-{(NOW + 5) * 1000:016d}").mkdir()
    assert count_rows(C.load(spark, path, NOW)) == count_rows(made[2])
    for f in (tmp_path / "snap").rglob("*.parquet"):
        f.write_bytes(b"junk")
    assert C.load(spark, path, NOW).count() == 0 and C.load(spark, "nofs://x/y", NOW).count() == 0
    C.snapshot(made[2], path, NOW + 9)
    assert len(C._complete(spark, path)) == 1 and C.load(spark, path, NOW + 9).count() > 0


def test_untrusted_checkpoint(spark):
    m = NOW // 60
    rows = [(m, "tag", "ok", 3), (m, "tag", "Bad Tag", 1), (m, "url", "javascript:x", 1), (m, "tag", "neg", -1), (m, "lang", "en", 1 << 40), (m - 9999, "tag", "past", 1)] + [(m - 1, "tag", f"t{i}", 1) for i in range(1025)] + [(m - 2, "emoji", chr(0x1F300 + i), 1) for i in range(12)]
    rows += [(m - 3, "excluded", "made_up_reason", 5), (m - 3, "excluded", "unsafe_host", 2), (m - 3, "post", "x", 1), (m - 3, "odd", "x", 1)]
    bad = spark.createDataFrame([(*r[:3], None, r[3]) for r in rows] + [(m - 4, "tag", "ok", x, 2) for x in ("OK", "Ok", "oK", "ok", "no")], "minute bigint, family string, key string, label string, cnt bigint").withColumn("v", F.lit(2)).withColumn("rules", F.lit(C.RULES))
    back = C.restore(bad, NOW)
    got = {(r["minute"], r["family"], r["key"]): r["n"] for r in back.groupBy("minute", "family", "key").agg(F.sum("cnt").alias("n")).collect()}
    assert got[m, "tag", "ok"] == 3 and got[m, "excluded", "checkpoint_invalid_tag"] == 1 and got[m, "excluded", "checkpoint_invalid_count"] == 2
    assert got[m, "excluded", "checkpoint_invalid_url"] == 1 and got[m, "candidate", ""] == 4 and got[m - 2, "excluded", "checkpoint_invalid_emoji"] == 2
    assert not any(k[0] in (m - 1, m - 9999) for k in got)
    assert (m - 3, "excluded", "made_up_reason") not in got and got[m - 3, "excluded", "unsafe_host"] == 2 and got[m - 3, "excluded", "checkpoint_invalid_exclusion"] == 3
    assert got[m - 4, "tag", "ok"] == 10 and got[m - 4, "excluded", "checkpoint_invalid_label"] == 2
    assert {r["label"] for r in back.where(f"minute = {m - 4} and family = 'tag'").collect()} == {"OK", "Ok", "oK", None}
    assert C.restore(bad.withColumn("v", F.lit(1)), NOW).count() == 0 and len(C.REASONS) == 37


def test_merge_packed(spark):
    made = lambda *docs: spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(docs)], "index int, raw binary")
    good = [codec.pack({"a": codec.MAX_I64, "b": 2}), codec.pack({"a": 5, "c": 2}), codec.pack({})]
    rows, raw = B.merge_packed(made(*good), 2)
    assert [tuple(r) for r in rows.orderBy("rank").collect()] == [(1, "a", codec.MAX_I64, 3), (2, "b", 2, 3)] and codec.unpack(raw) == {"a": codec.MAX_I64, "b": 2}
    assert B.merge_packed(made(codec.pack({})), 5)[1] == b"\x80"
    for bad in (b"", b"\x80\x80", b"CK\x00", codec.pack([1]), codec.pack({"a": "1"}), codec.pack({"a": 1.5}), codec.pack({"a": 1 << 63}), codec.pack({"a": True})):
        with pytest.raises(ValueError, match="slice 1:"):
            B.merge_packed(made(good[0], bad, good[1]))


def test_merge(spark):
    big = (1 << 63) - 1
    got = B.merge_slices(spark.createDataFrame([({"a": big, "b": 2},), ({"a": 5, "c": 2},), ({},)], "counts map<string,bigint>"), 2).orderBy("rank").collect()
    assert [(r["key"], r["cnt"], r["keys"]) for r in got] == [("a", big, 3), ("b", 2, 3)]
    none = B.hit_rate(spark.createDataFrame([], "outcome string")).first()
    assert none["hit_rate"] is None and none["hits"] == 0


def test_source_helpers():
    assert replay.advanced(5, 3) == 5 and replay.advanced(None, 3) == 3
    assert "cursor=7" in replay.subscription_url("wss://host.example/subscribe", 7)
    assert json.loads(json.dumps(P.safe_numbers({"a": [1 << 60, 1]}))) == {"a": [str(1 << 60), 1]}
