"""Operator 3: exact substring deduplication by suffix arrays.

A passage of ``MIN_WORDS`` words or more that occurred before, in the order of
(doc_id, text hash, position), is cut; its first occurrence stays. Words are
runs of bytes without white space, upper and lower case apart. They travel as 32
bits of a hash, so a match of 50 words is one of 1,600 bits; two passages that
differ in a single word are taken for equal with a probability of 2^-32.

How it scales. One suffix array over a corpus cannot be built, so passages that
may match are brought together first. In each window of words the least hash of
``ANCHOR`` consecutive words is an anchor (winnowing): a repeated passage of
``MIN_WORDS`` words has the same anchor in all its copies. Anchors are counted
(8 bytes each); a Bloom filter of those that repeat lets a second scan send only
the surroundings of repeated anchors, as word ids, to the partition of their
anchor. The filter is broadcast and so has at most ``FILTER_BITS``; where more
anchors repeat than it can tell apart, it passes more than needed, never less:
at worst the surroundings of all anchors are shuffled.

In a partition, equal surroundings collapse to the first of them; the rest are
joined into texts whose suffix array is built by prefix doubling. The previous
and next smaller positions in suffix order give each position its longest
previous factor; where that reaches ``MIN_WORDS``, a later copy begins.

An anchor that occurs more than ``HOT`` times (a notice on a third of all pages)
would bring too much to one task. Around such anchors each run of ``MIN_WORDS``
words is a row of its own, by two hashes: the first place of each is found by
partial aggregation, and the others join it, which the adaptive skew join may
split. That finds the same spans. ``HOT`` grows with the table, so that the list
of hot anchors, which goes to every task, has ``cells.MOST_LARGE`` entries at most.

Results that hold by definition:

* null texts and null ids are neither cut nor compared; empty texts and those of
  fewer than ``MIN_WORDS`` words cannot hold a passage and stay as they are;
* a passage that repeats inside a document is cut there too; overlapping
  copies count (a long run of one word keeps its beginning);
* rows equal in id and text are one document and are cut alike; rows that share
  an id and differ in text are different documents, in the order of their
  text's hash, so there are no ties;
* a document that is cut wholly keeps its row, with an empty text;
* very long texts are read whole, each as a slice of its own;
* other columns pass through unread, whatever their names; an empty table gives
  an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cells, textscan
from .common import OWN, col, cut, table

MIN_WORDS = 50
#: Words of an anchor.
ANCHOR = 8
#: Most bits of the filter of repeated anchors (16 MB).
FILTER_BITS = 1 << 27
#: Rows of an anchor beyond which it is hot, at least.
HOT = 4096
#: Words of the texts whose suffixes are sorted together, about.
TEXT_WORDS = 400_000

_SEEN = "anchor bigint"
_AROUND = f"anchor bigint, {OWN}id bigint, tie bigint, pos int, off int, words binary"
_RUNS = f"run bigint, check bigint, {OWN}id bigint, tie bigint, pos int"
_SPANS = f"{OWN}id bigint, tie bigint, s int, e int"


def anchors(words: textscan.Words, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions, ascending, and the hash of each gram; any ``min_words`` equal words have an anchor at the same place."""
    n, w = len(words.hashes), min_words - k + 1
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(n, np.uint64)
    gram, whole = textscan.grams(words, k)
    gram |= np.uint64(1)
    gram[~whole] = np.uint64(2**64 - 1)
    end = np.repeat(words.first[1:], words.counts)
    least = np.zeros(n, np.uint64)
    least[: n - w + 1] = textscan.window_min(gram, w)
    least[np.arange(n) + min_words > end] = 0
    padded = np.concatenate([np.full(w - 1, 2**64 - 1, np.uint64), ~least])
    chosen = (~textscan.window_min(padded, w) == gram) & whole
    # in a run of one word all grams are equal: its ends and every few of it are enough
    same = np.zeros(n, bool)
    same[1:] = gram[1:] == gram[:-1]
    if same.any():
        begin = np.flatnonzero(~same)
        at = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        last = np.append(~same[1:], True)
        chosen &= (at % (w // 2) == 0) | last
    return np.flatnonzero(chosen), gram


def _scan_anchors(min_words: int, k: int):
    def run(batches):
        for batch in batches:
            data, offsets = textscan.buffer(batch.column(0))
            for a, b in textscan.slices(offsets):
                words = textscan.scan(data, offsets[a : b + 1], fold=False)
                if len(words.hashes) >= min_words:
                    at, gram = anchors(words, min_words, k)
                    yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64))], ["anchor"])

    return run


def _bits(anchor: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple((textscan.mix(anchor.view(np.uint64), s) & np.uint64(size - 1)).astype(np.int64) for s in (11, 12))


def _filter_words(size: int):
    def run(batches):
        for batch in batches:
            place = np.concatenate(_bits(batch.column(0).to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.left_shift(np.int64(1), place & 63))], ["w", "b"])

    return run


def _filter(repeated: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of the anchors that repeat."""
    n = repeated.count()
    size = 1 << 12
    while size < min(12 * n, most_bits):
        size *= 2
    out = np.zeros(size >> 6, np.int64)
    found = repeated.mapInArrow(_filter_words(size), "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out


def runs(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k words from each word on, where there are so many (by doubling)."""
    out, span, cur, done = None, 1, textscan.mix(hashes, seed), 0
    while True:
        if k & span:
            part = cur[done:]
            out = part if out is None else textscan.mix(out[: len(part)] * np.uint64(0xD6E8FEB86659FD93) + part, seed)
            done += span
        if done == k:
            return out[: max(0, len(hashes) - k + 1)]
        cur = textscan.mix(cur[:-span] * np.uint64(0x9E3779B97F4A7C15) + cur[span:], seed)
        span *= 2


def _scan_runs(min_words: int, k: int, hot):
    """Every run of ``min_words`` words that holds a hot anchor."""
    reach = min_words - k

    def run(batches):
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = textscan.buffer(batch.column(2))
            for a, b in textscan.slices(offsets):
                words = textscan.scan(data, offsets[a : b + 1], fold=False)
                n = len(words.hashes)
                if n < min_words:
                    continue
                at, gram = anchors(words, min_words, k)
                at = at[np.isin(gram[at].view(np.int64), hot.value)]
                if not len(at):
                    continue
                # starts of runs around the anchors, each once
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.maximum(at - reach, 0), 1)
                np.add.at(edge, at + 1, -1)
                start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                doc = np.searchsorted(words.first, start, side="right") - 1
                whole = start + min_words <= words.first[doc + 1]
                start, doc = start[whole], doc[whole]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(runs(words.hashes, min_words, seed)[start].view(np.int64)) for seed in (7, 8)), pa.array(ids[a:b][doc]), pa.array(ties[a:b][doc]), pa.array((start - words.first[doc]).astype(np.int32))],
                    ["run", "check", f"{OWN}id", "tie", "pos"],
                )

    return run


def _scan_around(min_words: int, k: int, filter_words, hot):
    reach = min_words - k

    def run(batches):
        bits = filter_words.value
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = textscan.buffer(batch.column(2))
            for a, b in textscan.slices(offsets):
                words = textscan.scan(data, offsets[a : b + 1], fold=False)
                if len(words.hashes) < min_words:
                    continue
                at, gram = anchors(words, min_words, k)
                key = gram[at]
                hit = np.ones(len(at), bool)
                for place in _bits(key, len(bits) << 6):
                    hit &= (bits[place >> 6] >> (place & 63)) & 1 == 1
                hit &= ~np.isin(key.view(np.int64), hot.value)
                at, key = at[hit], key[hit]
                if not len(at):
                    continue
                doc = np.searchsorted(words.first, at, side="right") - 1
                start = np.maximum(words.first[doc], at - reach)
                end = np.minimum(words.first[doc + 1], at + min_words)
                lengths = end - start
                tokens = words.hashes.astype(np.uint32)[textscan.flat(start, lengths)]
                where = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(where), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(ids[a:b][doc]),
                        pa.array(ties[a:b][doc]),
                        pa.array((start - words.first[doc]).astype(np.int32)),
                        pa.array((at - start).astype(np.int32)),
                        column,
                    ],
                    ["anchor", f"{OWN}id", "tie", "pos", "off", "words"],
                )

    return run


def suffix_order(text: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text`` by its first words (``reach`` at least), and how many words neighbours share (up to a power of 2)."""
    n = len(text)
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    h = 1
    while h < reach:
        r = levels[-1]
        after = np.zeros(n, np.int64)
        after[: n - h] = r[h:] + 1 if h < n else 0
        levels.append(np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        h *= 2
    order = np.argsort(levels[-1], kind="stable")
    i, j = order[:-1], order[1:]
    shared = np.where(levels[-1][i] == levels[-1][j], h, 0)
    rest = np.flatnonzero(shared == 0)
    i, j, got = i[rest], j[rest], np.zeros(len(rest), np.int64)
    for rank in reversed(levels[:-1]):
        h //= 2
        inside = np.maximum(i, j) + got < n
        equal = np.zeros(len(rest), bool)
        equal[inside] = rank[(i + got)[inside]] == rank[(j + got)[inside]]
        got += h * equal
    shared[rest] = got
    return order, shared


def previous_factors(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of each position, where it reaches ``least`` (else 0).

    The longest earlier match of a position is with its previous or its next
    smaller position in suffix order; both are found by pointer jumping.
    """
    n, out = len(order), np.zeros(len(order), np.int64)
    for side in (-1, 1):
        near = np.arange(n) + side
        width = np.concatenate([[0], shared]) if side < 0 else np.concatenate([shared, [0]])
        todo = np.flatnonzero(width >= least)
        while len(todo):
            p = near[todo]
            todo = todo[(order[p] > order[todo]) & (width[todo] >= least)]
            p = near[todo]
            near[todo], width[todo] = near[p], np.minimum(width[todo], width[p])
            todo = todo[width[todo] >= least]
        ok = np.flatnonzero(width >= least)
        out[order[ok]] = np.maximum(out[order[ok]], width[ok])
    return out


def _later(ids, ties, pos, tokens, offsets, least: int):
    """Spans (id, tie, start, end) that occurred before, in texts joined from pieces; pieces come in any order."""
    order = np.lexsort((np.diff(offsets), pos, ties, ids))
    ids, ties, pos = ids[order], ties[order], pos[order].astype(np.int64)
    lengths = np.diff(offsets)[order]
    begin = offsets[:-1][order]
    end = pos + lengths
    same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (ties[1:] == ties[:-1])])
    # pieces of a document overlap; their ends rise with their starts, and with their lengths where they share a start
    before = np.where(same, np.concatenate([[0], end[:-1]]), 0)
    skip = np.where(same, np.clip(before - pos, 0, lengths), 0)
    fresh = ~same | (pos > before)
    group = np.cumsum(fresh) - 1
    take = lengths - skip
    # a separator of its own ends each text
    closing = np.concatenate([fresh[1:], [True]])
    room = take + closing
    at = np.cumsum(room) - room
    n = int(room.sum())
    text = np.empty(n, np.int64)
    where = np.empty(n, np.int64)
    piece = np.empty(n, np.int64)
    target = textscan.flat(at, take)
    text[target] = tokens[textscan.flat(begin + skip, take)]
    where[target] = textscan.flat(pos + skip, take)
    piece[target] = np.repeat(np.arange(len(ids)), take)
    ends = (at + take)[closing]
    text[ends] = (1 << 33) + group[closing]
    where[ends] = -1
    piece[ends] = np.flatnonzero(closing)
    factors = previous_factors(*suffix_order(text, least), least)
    hit = np.flatnonzero(factors)
    if not len(hit):
        return None
    s = where[hit]
    e = s + factors[hit]
    doc = np.cumsum(~same)[piece[hit]]
    # spans of a text come in order; join those that touch
    span = int(e.max()) + 1
    upto = np.maximum.accumulate(doc * span + e)
    new = np.concatenate([[True], doc[1:] * span + s[1:] > upto[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    p = piece[hit[first]]
    return ids[p], ties[p], s[first].astype(np.int32), (upto[last] - doc[last] * span).astype(np.int32)


def _find_later(least: int):
    names = [f"{OWN}id", "tie", "s", "e"]

    def out(ids, ties, s, e):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, ties, s, e)], names)

    def run(batches):
        kept: list[tuple] = []
        held = 0
        seen, seen_anchor = np.zeros(0, np.uint64), None

        def work(parts):
            key, ids, ties, pos = (np.concatenate([p[c] for p in parts]) for c in range(4))
            lengths = np.concatenate([p[4] for p in parts])
            tokens = np.concatenate([p[5] for p in parts])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            several = np.zeros(len(key), bool)
            several[1:] = key[1:] == key[:-1]
            several[:-1] |= several[1:].copy()
            if several.any():
                pick = np.flatnonzero(several)
                tokens = tokens[textscan.flat(offsets[pick], lengths[pick])]
                offsets = np.concatenate([[0], np.cumsum(lengths[pick])])
                found = _later(ids[pick], ties[pick], pos[pick], tokens, offsets, least)
                if found is not None:
                    yield out(*found)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, ties, pos, off = (batch.column(c).to_numpy() for c in range(5))
            data, where = textscan.buffer(batch.column(5))
            tokens = np.frombuffer(data.tobytes(), np.uint32)
            where = where // 4
            lengths = np.diff(where)
            place = np.arange(len(tokens)) - np.repeat(where[:-1], lengths)
            each = textscan.mix(tokens.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
            whole = textscan.mix(np.add.reduceat(each, where[:-1]) + textscan.mix(key.view(np.uint64) + off.astype(np.uint64)), 5)
            # rows come sorted, so the first of equal surroundings is the earliest
            _, first = np.unique(whole, return_index=True)
            fresh = np.zeros(len(key), bool)
            fresh[first] = True
            if seen_anchor == key[0] and len(seen):
                fresh &= ~((key == key[0]) & np.isin(whole, seen))
            again = ~fresh & (lengths >= least)
            if again.any():
                yield out(ids[again], ties[again], pos[again], (pos + lengths)[again].astype(np.int32))
            tail = key == key[-1]
            seen = np.union1d(seen, whole[tail]) if seen_anchor == key[-1] else np.unique(whole[tail])
            seen_anchor = key[-1]
            pick = np.flatnonzero(fresh)
            part = (key[pick], ids[pick], ties[pick], pos[pick], lengths[pick], tokens[textscan.flat(where[:-1][pick], lengths[pick])])
            kept.append(part)
            held += len(part[5])
            if held >= TEXT_WORDS:
                # all anchors but the last are complete
                ready = [tuple(x) for x in kept]
                open_key = key[-1]
                rest, whole_parts = [], []
                for p in ready:
                    n = int(np.searchsorted(p[0], open_key, side="left"))
                    words = int(p[4][:n].sum())
                    whole_parts.append(tuple(c[:n] for c in p[:5]) + (p[5][:words],))
                    rest.append(tuple(c[n:] for c in p[:5]) + (p[5][words:],))
                if sum(len(p[0]) for p in whole_parts):
                    yield from work(whole_parts)
                    kept = [p for p in rest if len(p[0])]
                    held = sum(len(p[5]) for p in kept)
        if kept:
            yield from work(kept)

    return run


def _cut_text(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, s, e in zip(texts, starts, ends, strict=True):
        if text is None or s is None:
            out.append(text)
            continue
        raw = text.encode()
        words = textscan.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), fold=False)
        begin = np.append(words.starts, len(raw))
        parts, at = [], 0
        for i in np.argsort(s, kind="stable"):
            a, b = int(begin[s[i]]), int(begin[e[i]])
            if a > at:
                parts.append(raw[at:a])
            at = max(at, b)
        parts.append(raw[at:])
        out.append(b"".join(parts).decode())
    return pd.Series(out, dtype=object)


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor: int = ANCHOR, filter_bits: int = FILTER_BITS, hot_rows: int = HOT) -> DataFrame:
    """Spans of words, by id and text hash, that occurred before."""
    spark = docs.sparkSession
    text = col(text_col).cast("string")
    whole = docs.select(col(id_col).cast("bigint").alias(f"{OWN}id"), F.xxhash64(text).alias("tie"), text.alias(f"{OWN}text"))
    whole = whole.where(f"{OWN}id is not null and {OWN}text is not null")
    seen = whole.select(f"{OWN}text").mapInArrow(_scan_anchors(min_words, anchor), _SEEN)
    repeated = cut(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = repeated.where(F.col("n") > cells.threshold(total, hot_rows)).select("anchor").toArrow().column(0).to_numpy()
    hot = spark.sparkContext.broadcast(np.sort(many))
    bits = spark.sparkContext.broadcast(_filter(repeated.select("anchor"), filter_bits))
    around = whole.mapInArrow(_scan_around(min_words, anchor, bits, hot), _AROUND)
    grouped = around.repartition("anchor").sortWithinPartitions("anchor", f"{OWN}id", "tie", "pos")
    spans = grouped.mapInArrow(_find_later(min_words), _SPANS)
    if not len(many):
        return spans
    rows = cut(whole.mapInArrow(_scan_runs(min_words, anchor, hot), _RUNS))
    place = F.struct(f"{OWN}id", "tie", "pos")
    first = rows.groupBy("run", "check").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = rows.join(first, ["run", "check"]).where(place > F.col("first"))
    return spans.unionByName(later.select(f"{OWN}id", "tie", F.col("pos").alias("s"), (F.col("pos") + min_words).alias("e")))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor: int = ANCHOR, filter_bits: int = FILTER_BITS, hot_rows: int = HOT, removed: str | None = None) -> DataFrame:
    """``docs`` without later copies of passages; ``removed`` names a column for the number of words cut."""
    spans = later_copies(docs, id_col, text_col, min_words, anchor, filter_bits, hot_rows)
    joined = spans.groupBy(F.col(f"{OWN}id"), F.col("tie").alias(f"{OWN}tie")).agg(
        F.array_sort(F.collect_set(F.struct("s", "e"))).alias(f"{OWN}spans")
    )
    text = col(text_col).cast("string")
    left = docs.withColumn(f"{OWN}key", F.xxhash64(text))
    both = left.join(joined, (col(id_col).cast("bigint") == F.col(f"{OWN}id")) & (F.col(f"{OWN}key") == F.col(f"{OWN}tie")), "left")
    found = F.col(f"{OWN}spans").isNotNull() & col(text_col).isNotNull()
    starts = F.transform(f"{OWN}spans", lambda x: x["s"])
    ends = F.transform(f"{OWN}spans", lambda x: x["e"])
    shorter = F.pandas_udf(_cut_text, T.StringType())(F.when(found, text), starts, ends)
    columns = [F.when(found, shorter).otherwise(text).alias(c) if c == text_col else col(c) for c in docs.columns]
    if removed:
        # spans that overlap count once: what a span adds beyond the furthest end so far
        total = F.aggregate(
            f"{OWN}spans",
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda a, x: F.struct(
                (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")
            ),
        )["n"]
        columns.append(F.coalesce(total, F.lit(0)).alias(removed))
    return both.select(*columns)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="removed_words")
    return docs.select("doc_id", "text", "removed_words")
