"""The operators against brute force, and over nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import bpe, bpe_codec, cells, components, embedding_dedup, license_scan, packing, quality_rules, simhash_dedup, source_mixing, suffix_dedup, textscan, token_counts, url_filter
from tidewell.llm.common import shared_dir, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(300)
PASSAGE = prose(70)


def edited(text, k):
    w = text.split()
    for i in range(0, len(w), max(1, len(w) // k)):
        w[i] = "edit" + str(i)
    return " ".join(w)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, BASE, "en", "a", 1), (2, BASE, None, "a", None), (3, edited(BASE, 6), "en", None, 3), (4, None, "en", "b", 4), (None, BASE, "en", "b", 5), (5, "", "en", "b", 6), (6, "", "en", "b", 7), (7, "ab", "de", "b", 8)]
    rows += [(8, f"{prose(40)} {PASSAGE} {prose(40)}", "en", "c", 9), (9, f"{PASSAGE} {prose(30)}", "en", "c", 10), (10, prose(30_000), "en", "c", 11), (11, "same " * 500, "en", "c", 12), (12, "é ü x y\r\n\tz  ", "fr", "c", 13), (12, "é ü x y\r\n\tz  ", "fr", "c", 13)]
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("k")).withColumn("id", F.lit(1)).withColumn("a", F.lit(2)).withColumn("tokens", F.lit(3)).withColumn("root", F.lit(4)).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_quality(spark, odd, none):
    got = quality_rules.quality_filter(odd)
    assert got.columns == odd.columns and quality_rules.quality_filter(none).count() == 0
    assert {r["doc_id"] for r in got.select("doc_id").collect()} >= {1, 2, 3, 8, 9, 10, None}
    assert not {r["doc_id"] for r in got.select("doc_id").collect()} & {4, 5, 6, 11}
    bad = ["you idiot " * 2 + prose(30), prose(30).upper(), "### $$$ %%% " * 30, "1234567890 " * 20, "line\n" * 10]
    assert quality_rules.quality_filter(spark.createDataFrame([(x,) for x in bad], "text string")).count() == 0


def test_quality_order(spark):
    """The rule with the most rejections per cost goes first; then the most among what is left."""
    cost = np.array([1.0, 10.0, 1.0, 2.0])
    fails = np.zeros((10, 4), bool)
    fails[:6, 0] = fails[:9, 1] = fails[:6, 2] = True
    fails[6:8, 3] = True
    assert quality_rules.greedy(cost, fails) == [0, 3, 1, 2]  # rule 2 finds nothing that rule 0 leaves
    assert quality_rules.greedy(cost, np.zeros((0, 4), bool)) == [0, 2, 3, 1]
    slow = quality_rules.Rule("slow", "regexp_count(text, '(a+)+b') >= 0", "")
    cheap = quality_rules.Rule("cheap", "length(text) > 1000", "")
    never = quality_rules.Rule("never", "length(text) > 0", "")
    docs = spark.createDataFrame([(prose(60),) for _ in range(60)], "text string")
    assert [r.name for r in quality_rules.order_rules(docs, rules=(slow, never, cheap))][0] == "cheap"
    rows = spark.createDataFrame([(i, prose(60)) for i in range(60)], "_tw_row int, _tw_text string")
    spent, failed = quality_rules.measure(rows, (slow, never, cheap))
    assert spent[0] > spent[1] and failed.sum(axis=0).tolist() == [0, 0, 60]
    # a long text is judged like all others, though the order doesn't see it
    assert quality_rules.quality_filter(spark.createDataFrame([("x y " * 40_000,), (prose(90),)], "text string")).count() == 2


def brute_groups(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


MASK = (1 << 64) - 1


def plain_mix(h, seed=0):
    h = (h + seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def plain_fingerprint(text):
    """The majority of the hashes' bits over the distinct words, bit by bit."""
    base, words = 0x9E3779B97F4A7C15, set(text.lower().encode().split())
    keys = {plain_mix(sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(w)) & MASK) >> 20 for w in words}
    return [sum(1 << b for b in range(64) if 2 * sum(plain_mix(k, side) >> b & 1 for k in keys) > len(keys)) for side in (1, 2)]


def test_simhash(spark):
    texts = [prose(120) for _ in range(30)]
    texts += [edited(t, k) for t in texts[:15] for k in (2, 5, 9, 14)] + texts[:5]
    prints = [plain_fingerprint(t) for t in texts]
    data, offsets = textscan.buffer(pa.array(texts))
    hi, lo = simhash_dedup.fingerprints(textscan.scan(data, offsets))
    assert [[int(a), int(b)] for a, b in zip(hi, lo, strict=True)] == prints
    near = lambda i, j: sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= simhash_dedup.DISTANCE
    want = brute_groups(len(texts), near)
    different = {tuple(p): i for i, p in enumerate(prints)}
    links = [sum(near(i, j) for p, j in different.items() if p != tuple(prints[i])) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for m in (None, 8, 13):
        got = {r["id"]: (r["root"], r["links"]) for r in simhash_dedup.near_groups(docs, m=m).collect()}
        assert [got[i] for i in range(len(texts))] == list(zip(want, links, strict=True))
    assert sum(links) > 60


def test_simhash_blocks():
    """Any pair within the distance meets in a block: the budgets add up, however many blocks there are."""
    r = np.random.default_rng(4)
    for m in range(3, 22):
        t = simhash_dedup.budgets(m)
        assert sum(t) + m == simhash_dedup.DISTANCE + 1 and simhash_dedup.blocks(m)[-1][1] == 128
        flips = np.zeros((2, 200), np.uint64)
        for i in range(200):
            for bit in r.choice(128, r.integers(1, 21), replace=False).tolist():
                flips[bit // 64, i] |= np.uint64(1 << bit % 64)
        assert (simhash_dedup.first_block(flips[1], flips[0], m, 20) < m).all()
    assert [simhash_dedup.plan(n) for n in (1000, 10**5, 10**7)] == [21, 12, 10]


def test_simhash_hot_key(spark, monkeypatch):
    """A block value that most fingerprints share is dealt to several tasks, with the same classes and links."""
    monkeypatch.setattr(simhash_dedup, "PART", 16)
    monkeypatch.setattr(simhash_dedup, "TILE", 7)
    base = prose(150).split()
    texts = [" ".join(base[:140] + [f"word{i}"]) for i in range(90)] + [prose(100) for _ in range(30)]
    prints = [plain_fingerprint(t) for t in texts]
    near = lambda i, j: sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= simhash_dedup.DISTANCE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    distinct = len({tuple(p) for p in prints})
    for m in (9, 21):
        got = simhash_dedup.near_groups(docs, m=m).collect()
        assert [x["root"] for x in sorted(got, key=lambda x: x["id"])] == brute_groups(len(texts), near)
        assert max(x["links"] for x in got) <= distinct and sum(x["links"] > 20 for x in got) >= 90


def test_simhash_odd(odd, none):
    kept = simhash_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.select("doc_id").collect()) == [-1, 1, 4, 5, 7, 8, 9, 10, 11, 12]
    assert simhash_dedup.drop_near_copies(none).count() == 0
    every = simhash_dedup.classes(odd).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in every) == [-1, *range(1, 13)] and simhash_dedup.classes(none).count() == 0
    assert {r["doc_id"] for r in every if not r["kept"]} == {2, 3, 6} and all(r["links"] == 0 for r in every if r["doc_id"] in (None, 4, 12))
    dotted = odd.select(F.col("doc_id").alias("a.id"), F.col("text").alias("a.text"))
    assert simhash_dedup.drop_near_copies(dotted, "a.id", "a.text").count() == 10
    assert suffix_dedup.cut_repeats(dotted, "a.id", "a.text").count() == odd.count()


def test_components(spark):
    """A hub, a chain, a cycle and repeated edges."""
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1040)] + [(i, 2000 + (i - 1999) % 9) for i in range(2000, 2009)] + [(5, 5), (7, 0), (None, 3)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {i: 1000 for i in range(1001, 1041)} | {i: 2000 for i in range(2001, 2009)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_cut(docs, least):
    """Later copies by the definition: a word is cut if it lies in a run of ``least`` equal words that began earlier."""
    flat, owner = [], []
    for d, (_, text) in enumerate(docs):
        w = text.split()
        flat += [*w, ("end", d)]
        owner += [d] * (len(w) + 1)
    seen, gone = {}, [False] * len(flat)
    for i in range(len(flat) - least + 1):
        run = tuple(flat[i : i + least])
        if any(isinstance(x, tuple) for x in run):
            continue
        if run in seen:
            gone[i : i + least] = [True] * least
        else:
            seen[run] = i
    out = [[] for _ in docs]
    for w, d, g in zip(flat, owner, gone, strict=True):
        if not g and not isinstance(w, tuple):
            out[d].append(w)
    return [" ".join(x) for x in out]


def test_suffix(spark):
    r = random.Random(9)
    shared = [prose(n, r) for n in (50, 51, 80, 200)]
    docs = [(i, " ".join(r.choice(shared) if r.random() < 0.3 else prose(r.randint(1, 60), r) for _ in range(r.randint(1, 6)))) for i in range(60)]
    docs += [(60, "x " * 130 + "y"), (61, docs[3][1]), (62, shared[0][:-1])]
    docs += [(63, "a b c d e f " + "u " * 123 + "v " * 123 + "w " * 60), (64, "v " * 70 + "u " * 52 + "w " * 51)]
    want = brute_cut(docs, suffix_dedup.MIN_WORDS)
    # with anchors hot from the first repeat on, from a few, and with a filter that passes everything
    for given in ({}, {"hot_rows": 1}, {"hot_rows": 5}, {"filter_bits": 64}):
        got = {row["doc_id"]: row["text"] for row in suffix_dedup.cut_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), **given).collect()}
        assert [" ".join(got[i].split()) for i, _ in docs] == want


def test_suffix_odd(odd, none):
    got = suffix_dedup.cut_repeats(odd, removed="cut")
    assert got.columns == [*odd.columns, "cut"] and got.count() == odd.count() and suffix_dedup.cut_repeats(none).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[4]["text"] is None and by[5]["text"] == "" and by[2]["text"] == "" and by[1]["text"] == BASE
    assert by[9]["cut"] == 70 and by[None]["text"] == BASE


def test_codec(odd, none):
    path = tokenizer_path(bpe_codec.VOCABULARY)
    whole = bpe.codec(path).encoding
    got = bpe_codec.encode(odd)
    assert got.columns == [c for c in odd.columns if c != "text"] + ["n_tokens", "ids", "exact"] and bpe_codec.encode(none).count() == 0
    both = bpe_codec.encode(odd.select("doc_id", "text", F.col("text").alias("t2"))).collect()
    for r in both:
        if r["t2"] is None:
            assert r["ids"] is None and r["n_tokens"] == 0 and r["exact"] is None
        else:
            assert r["ids"] == whole.encode_ordinary(r["t2"]) and r["exact"] and r["n_tokens"] == len(r["ids"])
    back = bpe_codec.decode(bpe_codec.encode(odd.select("doc_id", "text", F.col("text").alias("t2"))))
    assert all(r["text"] == r["t2"] for r in back.collect())


def test_chunks_are_exact():
    own = bpe.ChunkEncoder(bpe.codec(tokenizer_path(bpe_codec.VOCABULARY)))
    r = random.Random(3)
    common = [prose(r.randint(1, 300), r) for _ in range(10)]
    texts = ["".join(r.choice([r.choice(common), "x" * r.randint(1, 3000), "  \n\t ", "日本語テキスト" * r.randint(1, 90), "don't 12,345!", " é"]) for _ in range(r.randint(0, 12))) for _ in range(200)]
    data, offsets = textscan.buffer(pa.array(texts))
    ids, cuts = own.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [own.bpe.encoding.encode_ordinary(t) for t in texts]
    assert own.reused > 0


def thue_morse(n):
    """Texts of two letters for which a polynomial modulo 2^64 is the same, whatever its base."""
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return [s, s.translate(str.maketrans("ab", "ba"))]


SAME_HASH = [t for n in (1 << 10, 1 << 11, 1 << 12) for t in thue_morse(n)]
WIDE_SPACES = ["a\u2003b  c", "x\u3000y", "\u2028", "a\u00a0 b", "“quoted” — d’accord…、日本。", "\u1680 \u205fz", "é\x85\x1c"]


def test_exact_whatever_the_hash(spark):
    """Encoding, packing and counting give the tokenizer's ids where texts differ and their hashes don't."""
    own = bpe.codec(tokenizer_path(bpe_codec.VOCABULARY))
    texts = SAME_HASH + WIDE_SPACES
    want = [own.encoding.encode_ordinary(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    assert [r["ids"] for r in bpe_codec.encode(docs).orderBy("doc_id").collect()] == want
    assert bpe_codec.encode(docs).where("not exact").count() == 0
    row = packing.pack_documents(docs, row=1 << 14).collect()
    found = {}
    for r in row:
        ids = np.frombuffer(r["ids"], "<u2")
        for a, b, d in zip(r["cu_seqlens"][:-1], r["cu_seqlens"][1:], r["doc_ids"], strict=True):
            found[d] = ids[a : b - 1].tolist()
    assert [found[i] for i in range(len(texts))] == want
    folder = f"{shared_dir(spark)}/same-hash"
    files = token_counts.write_flat(docs, folder)
    (uri,) = [r["uri"] for r in files.collect()]
    ids = np.frombuffer(open(uri.removeprefix("file:"), "rb").read(), "<u2")
    assert [x.tolist() for x in np.split(ids, np.flatnonzero(ids == own.end) + 1)[:-1]] == [[*w, own.end] for w in want]
    assert sorted(r["n_tokens"] for r in token_counts.count_flat(files, own.end).collect()) == sorted(map(len, want))
    # curly quotes, dashes and CJK stops are no white space: such texts are cut into chunks like others
    data, offsets = textscan.buffer(pa.array(WIDE_SPACES))
    assert bpe.odd_texts(data, offsets).tolist() == [True, True, True, True, False, True, True]


def test_decode_odd(spark):
    rows = spark.createDataFrame([(1, [10, 11]), (2, None), (3, []), (4, [0xF0])], "k int, ids array<int>")
    own = bpe.codec(tokenizer_path(bpe_codec.VOCABULARY))
    got = {r["k"]: r["text"] for r in bpe_codec.decode(rows).collect()}
    assert got[2] is None and got[3] == "" and got[1] == own.decode(np.array([10, 11])).decode(errors="replace")
    for bad in ([-1], [own.size], [None]):
        with pytest.raises(Exception, match="not in the vocabulary"):
            bpe_codec.decode(spark.createDataFrame([(bad,)], "ids array<int>")).collect()


def test_packing(spark, odd, none):
    end = bpe.codec(tokenizer_path(bpe_codec.VOCABULARY)).end
    rows = packing.pack_documents(odd, row=64, shard_tokens=5000).collect()
    assert packing.pack_documents(none).count() == 0
    parts = {}
    for r in rows:
        ids, places, marks = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 64 and marks[0] == 0 and marks[-1] == r["n_tokens"] and (ids[marks[-1] :] == end).all()
        for a, b, d, p in zip(marks[:-1], marks[1:], r["doc_ids"], r["parts"], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            parts.setdefault((d, p), []).append(ids[a:b].tolist())
    whole = bpe.codec(tokenizer_path(bpe_codec.VOCABULARY)).encoding
    for r in odd.where("doc_id is not null and text is not null and doc_id <> 12").collect():
        got = [x for k in sorted(k for k in parts if k[0] == r["doc_id"]) for x in parts[k][0]]
        assert got == [*whole.encode_ordinary(r["text"]), end]
    assert len(parts[12, 0]) == 2


def test_best_fit():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 101, 500)
    where, rows = packing.best_fit(lengths, 100)
    room, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [x for x in room if x >= lengths[i]]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - lengths[i])
        else:
            room.append(100 - lengths[i])
    used = np.bincount(where, lengths, rows)
    assert rows == len(room) and used.max() <= 100 and sorted(100 - used) == sorted(room)
    assert packing.best_fit(np.zeros(0, np.int64), 10)[1] == 0


@pytest.mark.parametrize("block", [4, 10, 1 << 20])
def test_token_counts(spark, tmp_path, block):
    end, r = 9, np.random.default_rng(2)
    files, want = [], []
    for f, tokens in enumerate([r.integers(0, 10, 300), np.full(5, 9), np.arange(9), np.zeros(0), np.array([9, 1, 2])]):
        raw = tokens.astype("<u2").tobytes()
        (tmp_path / f"{f}.bin").write_bytes(raw)
        files.append((f, f"file://{tmp_path}/{f}.bin", len(raw)))
        at = 0
        for d, s in enumerate("".join("|" if t == end else "." for t in tokens).split("|")):
            want.append((f, d, at, len(s)))
            at += len(s) + 1
        if want[-1][0] == f and want[-1][3] == 0:
            want.pop()
    got = token_counts.count_flat(spark.createDataFrame(files, "file int, uri string, bytes bigint"), end, 2, block)
    assert sorted(map(tuple, got.select("file", "doc", "start", "n_tokens").collect())) == want


def test_flat_files(spark, odd, none, tmp_path):
    own = bpe.codec(tokenizer_path(bpe_codec.VOCABULARY))
    files = token_counts.write_flat(odd, f"file://{tmp_path}/flat")
    counts = sorted(r["n_tokens"] for r in token_counts.count_flat(files, own.end).collect())
    assert counts == sorted(len(own.encoding.encode_ordinary(r["text"])) for r in odd.where("text is not null").collect())
    assert sorted(-1 if i is None else i for r in files.collect() for i in r["ids"]) == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in odd.where("text is not null").collect())
    assert token_counts.count_flat(token_counts.write_flat(none, f"file://{tmp_path}/none"), own.end).count() == 0


def test_counts_carry_ids(spark, odd, tmp_path):
    """The query's rows: each document with the tokens of its own text."""
    own = bpe.codec(tokenizer_path(bpe_codec.VOCABULARY))
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.op10_token_counts(spark, str(tmp_path)).collect())
    assert got == sorted((r["doc_id"] or -1, len(own.encoding.encode_ordinary(r["text"]))) for r in odd.where("text is not null").collect())


def plain_shingles(text):
    """Pairs of neighbouring words: letters, digits and other scripts, case folded."""
    words = "".join(c.lower() if c.isalnum() and c.isascii() or not c.isascii() else " " for c in text).split()
    return list(zip(words[:-1], words[1:], strict=True))


def test_licenses(spark, odd, none, monkeypatch):
    t = license_scan.TEMPLATES
    texts = [f"{prose(50)}. {x} {prose(60)}" for x in t.values()] + [prose(200), "Released under the", t["MIT-permission"].replace("merge, publish", "change, print"), "under the Apache License, Version 2.0", "", "one"]
    found = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    best = {(r["doc_id"], r["license"]): r["containment"] for r in found}
    for i, name in enumerate(t):
        assert best[i, name] == 1.0
    assert {d for d, _ in best} == {*range(len(t)), len(t) + 2, len(t) + 3}
    # brute force over every place
    for i, text in enumerate(texts):
        words = plain_shingles(text)
        for name, s in zip(t, map(plain_shingles, t.values()), strict=True):
            have = set(s)
            share = max((len(have & set(words[max(0, p - len(s)) : p + 2 * len(s)])) / len(have) for p in range(len(words))), default=0)
            assert (share >= license_scan.CONTAINMENT) == ((i, name) in best)
    # a long list is scanned for in groups, with the same result
    monkeypatch.setattr(license_scan, "GROUP_WORDS", 60)
    again = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(none).count() == 0
    with pytest.raises(ValueError):
        license_scan.Templates({"x": "one"})


def labelled(spark):
    r = random.Random(4)
    texts = [(prose(r.randint(20, 80), r) + (" awful nasty words" * 2 if i % 5 == 0 else ""), int(i % 5 == 0), int(i % 7 != 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t if q else t.upper() + " !!! ###", "en", "s", len(t)) for i, (t, _, q) in enumerate(texts)], DOCS)
    return docs, spark.createDataFrame([(i, q, t) for i, (_, t, q) in enumerate(texts) if i % 2], "doc_id bigint, quality int, toxic int")


def test_mixing(spark, odd, none):
    docs, labels = labelled(spark)
    got = source_mixing.mix(docs, docs, labels).toPandas()
    p, t, r = np.array(got["posterior"].tolist()), got["tokens"].to_numpy(float), got["rate"].to_numpy()
    true = ["toxic" if i % 5 == 0 else "good" if i % 7 else "low" for i in got["doc_id"]]
    held = [i for i, d in enumerate(got["doc_id"]) if d % 2 == 0]
    assert np.mean([got["domain"][i] == true[i] for i in held]) > 0.95  # documents that were not learnt from
    share = np.array([source_mixing.TARGETS[d] for d in source_mixing.DOMAINS])
    wanted = share / share[0] * (t @ p)[0] * source_mixing.SCALE
    assert (r >= 0).all() and np.abs((r * t) @ p / wanted - 1).max() < source_mixing.MISS
    assert source_mixing.mix(none, none, labels.where("false")).count() == 0
    alone = source_mixing.mix(odd, odd, labels.where("false")).collect()
    assert len(alone) == odd.count() and all(r["posterior"] == [1.0] and abs(r["rate"] - source_mixing.SCALE) < 0.01 for r in alone)
    again = source_mixing.mix(docs.unionByName(docs), docs, labels).toPandas()
    assert again.groupby("doc_id")["rate"].nunique().max() == 1  # repeated rows get one rate


def test_mixing_long_documents(spark):
    """The driver gets the weights only: the word counts of 60 long documents, some 4 MB, are more than it may take here."""
    r = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(12_000)) + " awful" * (i % 2), "en", "s", i) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    before = conf.get(key, "1g")
    conf.set(key, "1500k")
    try:
        assert {x["doc_id"] for x in source_mixing.apply_mix(docs, docs, labels).select("doc_id").collect()} <= set(range(60))
        weights, dense, names = source_mixing.learn(docs, labels)
    finally:
        conf.set(key, before)
    assert names == ["good", "toxic"] and weights.shape == (source_mixing.BUCKETS, 2) and (np.count_nonzero(weights, axis=0) > 10_000).all()


def test_mixing_learns(spark):
    """Weights against dense matrices, with rows that repeat, and with the sample in many parts."""
    docs, labels = labelled(spark)
    docs, labels = docs.where("doc_id < 200"), labels.where("doc_id < 200")
    twice = docs.unionByName(docs.where("doc_id < 100"))
    given = {x["doc_id"]: "toxic" if x["toxic"] else "good" if x["quality"] else "low" for x in labels.collect()}
    rows = [(x["text"], given[x["doc_id"]]) for x in twice.collect() if x["doc_id"] in given]
    f = source_mixing.features(*textscan.buffer(pa.array([t for t, _ in rows])))
    x, truth = np.zeros((len(rows), source_mixing.BUCKETS)), np.eye(3)[[source_mixing.DOMAINS.index(d) for _, d in rows]]
    np.add.at(x, (np.repeat(np.arange(len(rows)), f.tokens), f.bucket), 1)
    x = np.concatenate([x / np.sqrt(f.tokens)[:, None], f.extra, np.ones((len(rows), 1))], axis=1)
    w, m, v = (np.zeros((x.shape[1], 3)) for _ in range(3))
    for step in range(1, 121):
        g = x.T @ (source_mixing.softmax(x @ w) - truth) / len(rows) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights, dense, names = source_mixing.learn(twice, labels)
    assert names == list(source_mixing.DOMAINS) and np.abs(np.concatenate([weights, dense]) - w).max() < 1e-6
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([d for _, d in rows]), pa.array([1] * len(rows))], ["text", "domain", "times"])
    parts = [p for b in source_mixing._counted([batch]) for p in source_mixing._samples(b, 500)]
    assert len(parts) > 5 and np.abs(np.concatenate(source_mixing.train(parts, 3)) - w).max() < 1e-6


def test_mixing_keeps_columns(spark, odd):
    """The caller's own columns come back as they were, also those named like results."""
    docs, labels = labelled(spark)
    own = odd.withColumn("tokens", F.lit(-3)).withColumn("rate", F.lit(-7.5)).withColumn("copies", F.lit(-9)).withColumn("posterior", F.lit("p")).withColumn("domain", F.lit("d")).withColumn("a.b", F.lit(1))
    got = source_mixing.apply_mix(own, docs, labels)
    assert got.schema.names == own.schema.names and got.count() > 0
    want = {tuple(r) for r in own.collect()}
    assert {tuple(r) for r in got.collect()} <= want


def domains(r, least):
    toxic = np.where(r.random(2000) < 0.1, 0.9, least + 0.02 * r.random(2000))
    p = np.stack([0.945 / 0.995 * (1 - toxic), 0.05 / 0.995 * (1 - toxic), toxic], axis=1)
    return r.integers(50, 500, 2000), p


def test_mixing_targets(spark):
    """Rates are projected steps from 1: nonnegative, as good as plain projected gradient, and they meet what can be met."""
    r, names, targets = np.random.default_rng(3), list(source_mixing.DOMAINS), {"good": 0.945, "low": 0.05, "toxic": 0.005}
    for least in (0.0, 0.03):
        t, p = domains(r, least)
        known = spark.createDataFrame(list(zip(t.tolist(), p.tolist(), strict=True)), "tokens bigint, posterior array<double>")
        plan, reached, wanted = source_mixing.fit(known, names, targets, most=4.0)
        x = plan.rates(p)
        assert (x >= 0).all() and (x <= 4).all() and np.allclose((x * t) @ p, reached)
        got = known.withColumn("_tw_posterior", F.col("posterior")).select(source_mixing._rate(plan).alias("x"))
        assert np.allclose(np.sort([q["x"] for q in got.collect()]), np.sort(x))
        # plain projected gradient on all rates, one by one
        whole, y = float((t @ p).sum()), np.ones(len(t))
        for _ in range(20_000):
            y = np.clip(y - 2 * (p @ (((y * t) @ p - wanted) / whole)), 0, 4)
        miss = lambda z: ((((z * t) @ p - wanted) / whole) ** 2).sum()
        assert miss(x) <= miss(y) * 1.05 + 1e-9
        if not least:
            assert np.abs(reached / wanted - 1).max() < 0.01


def test_mixing_totals(spark, caplog):
    docs, labels = labelled(spark)
    for targets in (None, {"good": 0.5, "low": 0.0001, "toxic": 0.4999}):
        caplog.clear()
        rows = source_mixing.totals(docs, docs, labels, targets=targets).collect()
        assert [x["domain"] for x in rows] == list(source_mixing.DOMAINS)
        missed = [x["domain"] for x in rows if abs(x["reached"] - x["wanted"]) > source_mixing.MISS * x["wanted"]]
        assert [x.args[0] for x in caplog.records if x.name == source_mixing.__name__] == missed


def test_urls(spark):
    entries = spark.createDataFrame([("bad.example", "block", "add", "2024-02-01"), ("bad.example", "block", "remove", "2024-03-01"), ("ok.bad.example", "allow", "add", "2024-01-01"), ("two.example", "allow", "add", "2024-01-01"), ("two.example", "block", "add", "2024-01-01"), ("bad.example", "block", "add", "2024-02-01"), ("same.example", "block", "add", "2024-01-05"), ("same.example", "block", "remove", "2024-01-05"), (None, "block", "add", "2024-01-01"), ("x", "block", "add", None)], "value string, verdict string, action string, at string")
    rows = [("http://bad.example/", d) for d in ("2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", None)] + [(u, "2024-02-10") for u in ("https://a.ok.BAD.example.:80/x", "https://u@c.bad.example?q", "https://notbad.example/", "http://two.example", "http://same.example", "junk", None)] + [("http://bad.example/", "2024-02-01")]
    given = spark.createDataFrame([(u, d, 1) for u, d in rows], "url string, fetched_on string, value int")
    got = url_filter.evaluate(given, entries)
    assert got.columns == ["url", "fetched_on", "value", "host", "verdict", "entry"]
    out = sorted((str(r["url"]), str(r["fetched_on"]), r["verdict"]) for r in got.collect())
    want = ["none", "block", "block", "none", "none", "allow", "block", "none", "block", "none", "none", "none", "block"]
    assert out == sorted((str(u), str(d), w) for (u, d), w in zip(rows, want, strict=True))
    assert url_filter.evaluate(given.where("false"), entries).count() == 0
    assert {r["verdict"] for r in url_filter.evaluate(given, entries.where("false")).collect()} == {"none"}


@pytest.mark.parametrize("shape", [None, (1, 1), (4, 2), (8, 3)])
def test_embeddings(spark, monkeypatch, shape):
    r = np.random.default_rng(6)
    x = r.standard_normal((120, 24))
    x = np.concatenate([x, x[:40] + 0.05 * r.standard_normal((40, 24)), x[:20] * 3, x[:30] + 0.2 * r.standard_normal((30, 24))])
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    want = brute_groups(len(x), lambda i, j: ((unit[i] - unit[j]) ** 2).sum() <= 2 - 2 * embedding_dedup.SIMILARITY)
    if shape:
        monkeypatch.setattr(embedding_dedup, "plan", lambda *a: shape)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, [1.0, 2.0], 1), (905, [1.0, 2.0], 1), (None, x[0].tolist(), 1), (0, x[0].tolist(), 1)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, id int")
    rows = embedding_dedup.near_groups(table).collect()
    got = {q["id"]: q["root"] for q in rows}
    assert [got[i] for i in range(len(x))] == want and got[905] == got[904] == 904 and not {900, 901, 902, 903} & set(got)
    # links between different unit vectors, each once
    different = [i for i in range(len(x)) if not any(np.array_equal(unit[i], unit[j]) for j in range(i))]
    links = [sum(((unit[i] - unit[j]) ** 2).sum() <= 2 - 2 * embedding_dedup.SIMILARITY for j in different if not np.array_equal(unit[i], unit[j])) for i in range(len(x))]
    have = {q["id"]: q["links"] for q in rows}
    assert [have[i] for i in range(len(x))] == links and sum(links) > 60
    every = embedding_dedup.classes(table).collect()
    assert sorted(-1 if q["vec_id"] is None else q["vec_id"] for q in every) == [-1, *range(len(x)), *range(900, 906)] and all(q["links"] == 0 for q in every if q["vec_id"] in (None, 900, 905))
    kept = embedding_dedup.drop_near_copies(table)
    assert kept.count() == len(set(want)) + 1 + 4 + 1 + 1 and embedding_dedup.drop_near_copies(table.where("false")).count() == 0


def test_embedding_plan():
    r = np.random.default_rng(7)
    for dim in (64, 128):
        x = r.standard_normal((500, dim))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        for n in (10**3, 10**5, 10**7, 10**9):
            assert embedding_dedup.plan(n, dim, 0.1, x)[0] >= 2


def test_large_cells(spark, monkeypatch):
    """A cell that holds nearly everything is dealt to many keys, with the same groups."""
    monkeypatch.setattr(embedding_dedup, "SPLIT", 40)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "PART_BYTES", 64 * 24 * 4)
    r = np.random.default_rng(8)
    x = r.standard_normal((300, 24))
    x = np.concatenate([x, x[:100] + 0.05 * r.standard_normal((100, 24)), x[:60] + 0.2 * r.standard_normal((60, 24))])
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    want = brute_groups(len(x), lambda i, j: ((unit[i].astype(float) - unit[j]) ** 2).sum() <= 2 - 2 * embedding_dedup.SIMILARITY)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    for m, g in ((2, 1), (4, 2)):
        monkeypatch.setattr(embedding_dedup, "plan", lambda *a, m=m, g=g: (m, g))
        got = {q["id"]: q["root"] for q in embedding_dedup.near_groups(table).collect()}
        assert [got[i] for i in range(len(x))] == want
    vecs = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(unit)], "id bigint, vec binary")
    home = vecs.mapInArrow(embedding_dedup._cells(24, 2, 1, 0.1, None), "key bigint")
    assert home.groupBy("key").count().agg(F.max("count")).first()[0] > 150
    dealt = cells.deal(home, 920, 40, 64, 4)
    spread = vecs.mapInArrow(embedding_dedup._cells(24, 2, 1, 0.1, dealt), "key bigint, place bigint, block int, id bigint, vec binary")
    # no task's key holds more than two parts at home
    assert spread.where("place % 4 < 3").groupBy("key", F.shiftright("place", 2)).count().agg(F.max("count")).first()[0] < 200


def test_equal_vectors(spark):
    """Ten copies of a table are one table's work: equal vectors collapse, and are no links."""
    r = np.random.default_rng(9)
    x = r.standard_normal((150, 16))
    rows = [(i + 1000 * k, v.tolist()) for k in range(10) for i, v in enumerate(x)]
    got = embedding_dedup.classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 1500 and all(q["class_id"] == q["vec_id"] % 1000 and q["links"] == 0 for q in got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs = docs.where("doc_id < 240").coalesce(2)
    extra = spark.createDataFrame([(1000, BASE, "en", "s", 1), (1001, BASE, "en", "s", 1), (1002, PASSAGE + " " + prose(90), "en", "s", 1), (1003, prose(90) + " " + PASSAGE, "en", "s", 1), (1004, None, None, None, None), (1005, "", "en", "s", 0)], DOCS)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]
    ids = [r["doc_id"] for r in got.collect()]
    assert not {1001, 1004, 1005} & set(ids) and got.where("not exact").count() == 0
    # each stage by itself, by brute force or by its own definition, on what the one before kept
    step = docs.unionByName(extra)
    first = {n: f for n, f in corpus_pipeline.STAGES}
    kept = first["quality rules"](spark, step, str(tmp_path))
    rules = step.where(" and ".join(f"coalesce({r.passes}, false)" for r in quality_rules.RULES))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rules.collect()))
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    order = sorted(texts)
    prints = {i: plain_fingerprint(texts[i]) for i in order}
    groups = brute_groups(len(order), lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[order[a]], prints[order[b]], strict=True)) <= simhash_dedup.DISTANCE)
    alone = first["near copies"](spark, kept, str(tmp_path)).cache()
    assert sorted(r["doc_id"] for r in alone.collect()) == [d for k, d in enumerate(order) if groups[k] == k]
    rest = first["repeated passages"](spark, alone, str(tmp_path)).cache()
    left = {r["doc_id"]: r for r in rest.collect()}
    want = brute_cut([(i, texts[i]) for i in sorted(left)], suffix_dedup.MIN_WORDS)
    assert [" ".join(left[i]["text"].split()) for i in sorted(left)] == want and all(r["n_chars"] == len(r["text"]) for r in left.values())
    mixed = first["mixing"](spark, rest, str(tmp_path)).cache()
    rates = source_mixing.mix(rest, docs, labels).withColumn("n", source_mixing.copies(F.col("rate"), [F.col("doc_id")]))
    times = {r["doc_id"]: r["n"] for r in rates.collect() if r["n"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == times
    whole = bpe.codec(tokenizer_path(bpe_codec.VOCABULARY)).encoding
    out = got.collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, n in times.items() for _ in range(n))
    assert all(r["ids"] == whole.encode_ordinary(left[r["doc_id"]]["text"]) for r in out)


def test_pipeline_odd(spark, odd, none, tmp_path):
    """Empty tables, nulls everywhere and columns of clashing names go through all stages."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, 0), (9, None, 1)], "doc_id bigint, quality int, toxic int")
    for name, given in (("odd", odd.withColumn("rate", F.lit(-1)).withColumn("copies", F.lit("x"))), ("none", none)):
        folder = f"{tmp_path}/{name}"
        given.write.parquet(f"{folder}/documents.parquet")
        labels.where("true" if name == "odd" else "false").write.parquet(f"{folder}/labels.parquet")
        step = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, folder)
            assert step.columns == given.columns
        got = corpus_pipeline.run(spark, folder)
        ids = {r["doc_id"] for r in got.collect()}
        assert not ids & {2, 3, 4, 5, 6, 11} and (name == "odd" or not ids)
