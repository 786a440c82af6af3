"""Operator 9: BPE encoding and decoding with content-defined chunk reuse.

Token ids are exactly those of the tokenizer on the whole text. ``ChunkEncoder``
(in ``bpe``) cuts texts where a rolling hash of their bytes says so, encodes
each distinct chunk once per worker and repairs the joins until both sides
agree with an encoding of what lies between. Tokens are compared with the text
byte for byte before they leave the encoder; a text that differs (two chunks of
one hash) is encoded whole. Packing and counting use the same encoder.

How it scales. It is a map over the scan: no shuffle, and only the columns asked
for are read. The pools of chunks and units live as long as a Python worker and
are bounded. A text longer than a slice is a slice of its own.

Results that hold by definition:

* a null text gives null ids, 0 tokens and a null ``exact``; an empty text gives
  an empty array;
* special tokens' strings in a text are ordinary text;
* each row is encoded by itself: repeated rows give repeated results;
* other columns pass through, whatever their names; result columns replace
  columns of the same name; an empty table gives an empty table;
* ids out of the vocabulary, and null ids in an array, make decoding fail, with
  the id in the message; a null array decodes to null. Bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, textscan
from .common import OWN, col, numbered, renamed, table, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"


def _encode(path: str):
    def run(batches):
        own = bpe.encoder(path)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            data, offsets = textscan.buffer(text)
            null = text.is_null().to_numpy(zero_copy_only=False)
            for a, b in textscan.slices(offsets):
                part = data[offsets[a] : offsets[b]]
                offs = offsets[a : b + 1] - offsets[a]
                ids, cuts = own.encode(part, offs)
                exact = own.exact
                gone = pa.array(null[a:b])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=gone)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(np.diff(cuts).astype(np.int32)), lists, pa.array(exact, mask=null[a:b])],
                    [*batch.schema.names[:-1], "n_tokens", "ids", "exact"],
                )

    return run


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, unless given) with n_tokens, ids and exact (whether decoding gives the text back)."""
    names = [c for c in (docs.columns if keep is None else keep) if c != text_col or keep is not None]
    names = [c for c in names if c not in ("n_tokens", "ids", "exact")]
    given = docs.select(*numbered(names), col(text_col).cast("string").alias(f"{OWN}text"))
    schema = T.StructType([T.StructField(f"{OWN}c{i}", docs.schema[c].dataType) for i, c in enumerate(names)])
    schema = schema.add("n_tokens", T.IntegerType()).add("ids", T.ArrayType(T.IntegerType())).add("exact", T.BooleanType())
    return given.mapInArrow(_encode(tokenizer_path(vocabulary, folder)), schema).select(*renamed(names), "n_tokens", "ids", "exact")


def _decode(path: str):
    def run(batches):
        own = bpe.codec(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            gone, sizes = lists.is_null().to_numpy(zero_copy_only=False), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            flat, known = lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])
            absent = flat.is_null().to_numpy(zero_copy_only=False)
            ids = flat.fill_null(0).to_numpy().astype(np.int64)
            bad = ids[(ids < 0) | (ids >= own.size)]
            if len(bad) or absent.any():
                raise ValueError(f"id {'null' if not len(bad) else bad[0]} is not in the vocabulary")
            raw = own.decode(ids)
            ends = np.concatenate([[0], np.cumsum(own.lengths[ids])])[known]
            texts = [None if g else raw[a:b].decode(errors="replace") for g, a, b in zip(gone, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return run


def decode(tokens: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """All columns but the ids, with the text that they stand for as ``text``."""
    names = [c for c in tokens.columns if c not in (ids_col, "text")]
    given = tokens.select(*numbered(names), col(ids_col).cast("array<int>").alias(f"{OWN}ids"))
    schema = T.StructType([T.StructField(f"{OWN}c{i}", tokens.schema[c].dataType) for i, c in enumerate(names)]).add("text", T.StringType())
    return given.mapInArrow(_decode(tokenizer_path(vocabulary, folder)), schema).select(*renamed(names), "text")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
