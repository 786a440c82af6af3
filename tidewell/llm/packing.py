"""Operator 5: packed training rows of token ids, in binary.

Documents become token ids, closed by the id that ends documents. A document
longer than a row is split without loss into full rows and a rest. Rests and
shorter documents are packed by best fit decreasing: a segment tree over
capacities finds the open row of the least room that suffices. A packed row
carries the ids, where its segments end, and positions that start again at 0 in
each segment.

How it scales. Packing needs no order across the corpus, so each task packs what
it scans, in shards of about ``SHARD_TOKENS`` tokens: no shuffle, and memory is
bounded by the shard. Only the last row or so of a shard is not full, about one
in two thousand.

Results that hold by definition:

* null texts and null ids are left out; an empty text is one end id;
* rows are documents each by itself: repeated rows are packed repeatedly;
* ties: segments of equal length are packed in the order in which they were read;
* a text longer than a shard is a shard of its own;
* room that is left holds end ids, beyond the last of ``cu_seqlens``;
* other columns are never read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, textscan
from .bpe_codec import VOCABULARY
from .common import col, table, tokenizer_path

#: Ids of a packed row.
ROW = 2048
#: Tokens that are packed together, about.
SHARD_TOKENS = 4_000_000

SCHEMA = "shard bigint, row int, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, parts array<int>"


class Capacities:
    """Open rows by room left; the least room that suffices is found by descending a segment tree."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.has = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.has[i] += 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room of at least ``need``, taken out."""
        has, i = self.has, need + self.size
        if not has[i]:
            while i > 1 and (i & 1 or not has[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not has[i]:
                    i += 1
        room = i - self.size
        while i:
            has[i] -= 1
            i //= 2
        return room, self.rows[room].pop()


def best_fit(lengths: np.ndarray, row: int) -> tuple[np.ndarray, int]:
    """The row of each segment (none longer than ``row``), and how many rows there are."""
    out, rows, open_rows = np.zeros(len(lengths), np.int64), 0, Capacities(row)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_rows.take(need)
        if found is None:
            room, at = row, rows
            rows += 1
        else:
            room, at = found
        out[i] = at
        if room > need:
            open_rows.put(room - need, at)
    return out, rows


def pack(tokens: np.ndarray, lengths: np.ndarray, ids: np.ndarray, row: int, fill: int, shard: int) -> pa.RecordBatch:
    """The rows of a shard: ``tokens`` are the documents' ids one after the other."""
    parts = -(-lengths // row)
    doc = np.repeat(np.arange(len(lengths)), parts)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(lengths[doc] - part * row, row)
    source = (np.cumsum(lengths) - lengths)[doc] + part * row
    where, rows = best_fit(size, row)
    order = np.argsort(where, kind="stable")
    where, size, source, doc, part = where[order], size[order], source[order], doc[order], part[order]
    before = np.cumsum(size) - size
    first = np.searchsorted(where, np.arange(rows + 1))
    base = np.append(before, size.sum())[first[:-1]]
    offset = before - base[where]
    matrix = np.full((rows, row), fill, tokens.dtype)
    places = np.zeros((rows, row), "<u2" if row <= 1 << 16 else "<u4")
    target = textscan.flat(where * row + offset, size)
    matrix.reshape(-1)[target] = tokens[textscan.flat(source, size)]
    places.reshape(-1)[target] = textscan.flat(np.zeros(len(size), np.int64), size)
    used = np.add.reduceat(size, first[:-1]) if rows else np.zeros(0, np.int64)
    # cumulative lengths begin with 0: one more of them than segments
    marks = np.insert(offset + size, first[:-1], 0).astype(np.int32)
    edges = first.astype(np.int32)

    def binary(m: np.ndarray) -> pa.Array:
        width = m.shape[1] * m.itemsize
        return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(m)])

    def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values))

    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, shard)),
            pa.array(np.arange(rows, dtype=np.int32)),
            binary(matrix),
            pa.array(used.astype(np.int32)),
            lists(marks, edges + np.arange(rows + 1, dtype=np.int32)),
            binary(places),
            lists(ids[doc], edges),
            lists(part.astype(np.int32), edges),
        ],
        ["shard", "row", "ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "parts"],
    )


def closed(tokens: np.ndarray, cuts: np.ndarray, end: int) -> np.ndarray:
    """The tokens with the end id after each text."""
    return np.insert(tokens, cuts[1:], end)


def _pack(path: str, row: int, shard_tokens: int):
    def run(batches):
        own = bpe.encoder(path)
        held, count = [], 0
        shard = TaskContext.get().partitionId() << 32

        def out():
            tokens, lengths, ids = (np.concatenate([h[c] for h in held]) for c in range(3))
            packed = pack(tokens, lengths, ids, row, own.bpe.end, shard)
            for a in range(0, packed.num_rows, 512):
                yield packed.slice(a, 512)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = textscan.buffer(batch.column(1))
            for a, b in textscan.slices(offsets):
                tokens, cuts = own.encode(data, offsets[a : b + 1])
                held.append((closed(tokens, cuts, own.bpe.end), np.diff(cuts) + 1, ids[a:b]))
                count += len(held[-1][0])
                if count >= shard_tokens:
                    yield from out()
                    held, count, shard = [], 0, shard + 1
        if held:
            yield from out()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, vocabulary: str = VOCABULARY, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packed rows; ``ids`` and ``position_ids`` are little-endian unsigned integers, of 2 bytes where they fit."""
    given = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))
    return given.where("id is not null and text is not null").mapInArrow(_pack(tokenizer_path(vocabulary, folder), row, shard_tokens), SCHEMA)


def op5_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
