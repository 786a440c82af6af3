"""Operator 7: near-duplicate documents by SimHash and pigeonhole blocks.

A document's fingerprint is the 128-bit SimHash of its set of distinct words
(case folded). Two documents are near copies when their fingerprints differ in
at most ``DISTANCE`` bits; a group (class) is a connected set of near copies,
and its document with the least id stays.

How it scales. Equal fingerprints collapse first in a partially aggregated
group, so exact copies, however many, cost one row. The rest are split into
blocks of bits. Of m blocks, with budgets that add up to ``DISTANCE`` - m + 1,
any close pair has a block in which it differs by that block's budget at most:
with 21 blocks all budgets are 0 and the pair shares a block, with fewer blocks
a fingerprint also probes the values near its own. ``plan`` picks m from the
number of fingerprints: few rows and many chance meetings for a small corpus,
more rows and wide blocks for a large one. The result is the same for any m.

A block's value is a key of an ordinary shuffle; keys with many fingerprints are
dealt to several tasks (``cells``). Candidates are verified by their Hamming
distance, and a pair counts in the first block that it shares, so each link
is counted once however often it is met. A task returns edges that connect its
close fingerprints and each one's number of links, not all pairs.

Results that hold by definition:

* a text of fewer than ``LEAST_WORDS`` distinct words has too few features; it
  equals only texts with the same words in the same order (case folded), and
  texts without words equal each other;
* a null text or a null id is never compared: it is its own class, has no links
  and stays;
* rows that repeat an id are one document, a member of the classes of all its
  texts: one row stays (that of the least text hash, where they differ; any of
  those that are equal);
* ties cannot occur, as ids are distinct after that;
* very long texts are read whole, each as a slice of its own;
* other columns pass through unread, whatever their names; an empty table gives
  an empty table.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells, textscan
from .common import OWN, col, cut, identified, table
from .components import components, spanning

BITS = 128
#: Most bits in which near copies differ.
DISTANCE = 20
#: Texts of fewer distinct words are compared as wholes.
LEAST_WORDS = 8
#: Fingerprints of a tile of distances.
TILE = 512
#: Fingerprints of a key that is dealt in parts, and of a part.
PART = 1 << 16

_FINGERPRINTS = f"{OWN}id bigint, {OWN}hi bigint, {OWN}lo bigint"


def fingerprints(words: textscan.Words) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the fingerprint of each text."""
    n = len(words.first) - 1
    out = np.zeros((2, n), np.uint64)
    if not len(words.hashes):
        return out[0], out[1]
    doc = words.doc.astype(np.uint64)
    low = np.uint64(44)
    mask = np.uint64((1 << 44) - 1)
    keys = np.sort((doc << low) | (words.hashes >> np.uint64(20)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    owner = (keys >> low).astype(np.int64)
    counts = np.bincount(owner, minlength=n)
    has = counts > 0
    starts = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
    half = counts[has].astype(np.uint64)
    lanes = 4 if counts.max() < 1 << 16 else 2  # counts of several bits are summed in one integer
    width = 64 // lanes
    one = np.uint64(sum(1 << (width * k) for k in range(lanes)))
    room = np.uint64((1 << width) - 1)
    for side in range(2):
        h, got = textscan.mix(keys & mask, side + 1), np.zeros(int(has.sum()), np.uint64)
        for s in range(width):
            sums = np.add.reduceat((h >> np.uint64(s)) & one, starts)
            for k in range(lanes):
                count = (sums >> np.uint64(width * k)) & room
                got |= (count * np.uint64(2) > half).astype(np.uint64) << np.uint64(s + width * k)
        out[side, has] = got
    short = counts < LEAST_WORDS
    if short.any():
        at = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)
        placed = words.hashes + at.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        sums = np.zeros((2, n), np.uint64)
        full = words.counts > 0
        for side in range(2):
            sums[side, full] = textscan.mix(np.add.reduceat(textscan.mix(placed, side + 3), words.first[:-1][full]))
        out[:, short] = sums[:, short]
    return out[0], out[1]


def _fingerprint_batches(batches):
    for batch in batches:
        ids = batch.column(0)
        data, offsets = textscan.buffer(batch.column(1))
        for a, b in textscan.slices(offsets):
            hi, lo = fingerprints(textscan.scan(data, offsets[a : b + 1]))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], [f"{OWN}id", f"{OWN}hi", f"{OWN}lo"]
            )


def budgets(m: int, distance: int = DISTANCE) -> list[int]:
    """Most bits in which a pair may differ in each of m blocks to meet there; within ``distance`` it meets in one at least."""
    return [(distance + 1 - m) // m + (b < (distance + 1 - m) % m) for b in range(m)]


def blocks(m: int, bits: int = BITS) -> list[tuple[int, int]]:
    return [(bits * j // m, bits * (j + 1) // m) for j in range(m)]


def plan(n: int, distance: int = DISTANCE, bits: int = BITS, row_ns: float = 500, pair_ns: float = 5) -> int:
    """The number of blocks of the least estimated cost for n distinct fingerprints, by rows and chance meetings.

    Of all numbers three are looked at: every bit of budget 0, and about 60 and
    112 rows a fingerprint (at the production distance). Fewer blocks would meet
    less by chance, but their rows take more disk than the table.
    """

    def cost(m: int) -> float:
        rows = met = 0.0
        for t, (a, b) in zip(budgets(m, distance), blocks(m, bits), strict=True):
            near = sum(comb(b - a, k) for k in range(t + 1))
            rows += 1 + (near - 1) / 2
            met += min(1.0, near * 2.0 ** (a - b))
        return n * rows * row_ns + n * n / 2 * met * pair_ns

    whole = distance + 1
    return min(sorted({whole, max(1, whole * 4 // 7), max(1, whole // 2)}, reverse=True), key=cost)


def _value(hi: np.ndarray, lo: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits a to b of fingerprints; of more than 58, what a hash of them keeps."""
    out = np.zeros(len(hi), np.uint64)
    if a < 64:
        out |= (lo >> np.uint64(a)) & np.uint64((1 << min(b, 64) - a) - 1)
    if b > 64:
        s = max(a, 64)
        out |= ((hi >> np.uint64(s - 64)) & np.uint64((1 << b - s) - 1)) << np.uint64(s - a)
    return out


def _keys(m: int, distance: int, dealt: cells.Deal | None):
    """Rows at home in each block, and those that probe the greater values within its budget; without ``dealt`` the keys at home alone."""
    each = list(zip(budgets(m, distance), blocks(m), strict=True))

    def run(batches):
        for batch in batches:
            ids, hi, lo = (batch.column(c).to_numpy() for c in range(3))
            high, low = hi.view(np.uint64), lo.view(np.uint64)

            def out(value, at, b, probe):
                key = (textscan.mix(value, b) >> np.uint64(6) if width > 58 else value) << np.uint64(5) | np.uint64(b)
                row, place = dealt(key.view(np.int64), ids[at], probe)
                pick = at[row]
                return pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)[row]), pa.array(place), *(pa.array(x[pick]) for x in (ids, hi, lo))], ["key", "place", "rep", "hi", "lo"]
                )

            for b, (most, (start, end)) in enumerate(each):
                width, own = end - start, _value(high, low, start, end)
                if dealt is None:
                    key = (textscan.mix(own, b) >> np.uint64(6) if width > 58 else own) << np.uint64(5) | np.uint64(b)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])
                    continue
                yield out(own, np.arange(len(ids)), b, False)
                for k in range(1, most + 1):
                    for changed in combinations(range(width), k):
                        mask = np.uint64(sum(1 << j for j in changed))
                        # of two values one is greater: the lesser probes it
                        at = np.flatnonzero((own >> np.uint64(changed[-1])) & np.uint64(1) == 0)
                        if len(at):
                            yield out(own[at] ^ mask, at, b, True)

    return run


class Tile:
    def __init__(self, columns):
        ids, hi, lo = (c.to_numpy() for c in columns)
        self.ids, self.hi, self.lo = ids, hi.view(np.uint64), lo.view(np.uint64)
        self.links = np.zeros(len(ids), np.int64)


def first_block(hi: np.ndarray, lo: np.ndarray, m: int, distance: int) -> np.ndarray:
    """The first block in which pairs of these differing bits are within the budget."""
    out, open_ = np.full(len(hi), m), np.arange(len(hi))
    for b, (most, (start, end)) in enumerate(zip(budgets(m, distance), blocks(m), strict=True)):
        near = np.bitwise_count(_value(hi[open_], lo[open_], start, end)) <= most
        out[open_[near]] = b
        open_ = open_[~near]
    return out


def _compare(m: int, distance: int):
    def run(batches):
        def compare(s: Tile, t: Tile):
            near = np.bitwise_count(s.hi[:, None] ^ t.hi[None])
            near += np.bitwise_count(s.lo[:, None] ^ t.lo[None])
            i, j = np.nonzero(near <= distance)
            if s is t:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                first = first_block(s.hi[i] ^ t.hi[j], s.lo[i] ^ t.lo[j], m, distance) == t.block
                i, j = i[first], j[first]
            if len(i):
                s.links += np.bincount(i, minlength=len(s.ids))
                t.links += np.bincount(j, minlength=len(t.ids))
                a, b = spanning(s.ids[i], t.ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "links"])

        def tile(key, columns):
            t = Tile(columns)
            t.block = key & 31
            return t

        def emit(t: Tile):
            has = np.flatnonzero(t.links)
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array(t.ids[has]), pa.nulls(len(has), pa.int64()), pa.array(t.links[has])], ["a", "b", "links"])

        yield from cells.stream(batches, 5, tile, compare, TILE, emit)

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, m: int | None = None) -> DataFrame:
    """(id, root, links) for each distinct id with a text: its class, by the class's least id, and the number of other fingerprints within the distance."""
    marks = cut(identified(docs, id_col, text_col).mapInArrow(_fingerprint_batches, _FINGERPRINTS))
    prints = cut(marks.groupBy(f"{OWN}hi", f"{OWN}lo").agg(F.min(f"{OWN}id").alias("rep")).select("rep", f"{OWN}hi", f"{OWN}lo"))
    n = prints.count()
    m = m or plan(n, distance)
    large = cells.deal(prints.mapInArrow(_keys(m, distance, None), "key bigint"), n * m, PART, PART)
    spread = prints.mapInArrow(_keys(m, distance, large), "key bigint, place bigint, rep bigint, hi bigint, lo bigint")
    keyed = spread.repartition(F.col("key"), F.shiftright("place", 2)).sortWithinPartitions("key", "place")
    met = cut(keyed.mapInArrow(_compare(m, distance), "a bigint, b bigint, links bigint"))
    links = met.where("links is not null").groupBy(F.col("a").alias("l_rep")).agg(F.sum("links").alias("n"))
    # an id with several texts is a member of all their groups
    linked = marks.join(prints, [f"{OWN}hi", f"{OWN}lo"]).groupBy(F.col(f"{OWN}id").alias("id"), "rep").agg(F.count(F.lit(1)).alias("rows"))
    several = linked.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    roots = components(met.where("b is not null").select("a", "b").unionByName(several))
    known = prints.select("rep").join(roots, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("l_rep"), "left")
    known = known.select("rep", F.coalesce("root", "rep").alias("root"), F.coalesce("n", F.lit(0)).alias("links"))
    return linked.join(known, "rep").groupBy("id").agg(F.min("root").alias("root"), F.sum("links").alias("links"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("texts"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, class_id, links, kept): each distinct id with its class, named by the class's least id, and each row that can't be compared as a class of its own."""
    found = near_groups(docs, id_col, text_col, distance).select(F.col("id").alias("doc_id"), F.col("root").alias("class_id"), "links", (F.col("id") == F.col("root")).alias("kept"))
    own = col(id_col).cast("bigint")
    alone = docs.where(own.isNull() | col(text_col).isNull()).select(own.alias("doc_id"), own.alias("class_id"), F.lit(0).cast("bigint").alias("links"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns."""
    groups = cut(near_groups(docs, id_col, text_col, distance).where("id <> root or rows > 1").select("id", (F.col("id") == F.col("root")).alias("first")))
    own, gone = col(id_col).cast("bigint"), F.col(f"{OWN}gone")
    # a row with a null text isn't compared, whatever other rows have its id
    known = docs.withColumn(f"{OWN}id", F.when(col(text_col).isNotNull(), own))
    kept = known.join(groups.where("not first").select(F.col("id").alias(f"{OWN}gone")), F.col(f"{OWN}id") == gone, "left_anti")
    again = groups.where("first").select(F.col("id").alias(f"{OWN}gone"))
    columns = [col(c) for c in docs.columns]
    if again.isEmpty():
        return kept.select(*columns)
    once = kept.join(again, F.col(f"{OWN}id") == gone, "left_anti").select(*columns)
    one = kept.join(again, F.col(f"{OWN}id") == gone, "left_semi").groupBy(f"{OWN}id").agg(F.min_by(F.struct(*columns), F.xxhash64(col(text_col))).alias(f"{OWN}row"))
    return once.unionByName(one.select(f"{OWN}row.*"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, links, kept) for each document."""
    return classes(table(spark, sf_dir, "documents"))
