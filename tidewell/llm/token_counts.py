"""Operator 10: document lengths in flat token files that have no index.

A flat file is token ids one after the other, little-endian, with an end id
after each document. It is read in blocks of a fixed size by many tasks at
once. In a block numpy finds all end ids at once. A running maximum of the last
end before each block, over one small row a block, stitches the documents that
reach from block to block; a running sum numbers them.

How it scales. Tokens are read once, where the blocks are scheduled, and never
shuffled. What is shuffled is a row a block and 8 bytes a document, and 16 bytes
where documents get their ids back.

Results that hold by definition:

* a document's tokens don't include its end id; two end ids in a row hold a
  document of 0 tokens; what follows the last end id is a document if it isn't
  empty, else nothing;
* an empty file has no documents; a size that is no multiple of an id's is an
  error that names the file;
* null texts are not written to files; a null id is written like any other; an
  empty text is a document of 0 tokens; repeated rows are repeated documents, so
  there are no ties; a very long text may reach over many blocks; other columns
  are never read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, textscan
from .bpe_codec import VOCABULARY
from .common import col, cut, shared_dir, table, tokenizer_path
from .packing import closed

#: Bytes of a block; a multiple of 4.
BLOCK = 4 << 20


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if ":" in uri else (pa.fs.LocalFileSystem(), uri)


def _write(path: str, folder: str):
    def run(batches):
        own, task = bpe.encoder(path), TaskContext.get()
        # an attempt has a file of its own; only the names that successful attempts return are read
        uri = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        files, place = _open(uri)
        out, size, ids = None, 0, []
        for batch in batches:
            ids.append(batch.column(1))
            data, offsets = textscan.buffer(batch.column(0))
            for a, b in textscan.slices(offsets):
                tokens = closed(*own.encode(data, offsets[a : b + 1]), own.bpe.end)
                out = out or files.open_output_stream(place)
                out.write(pa.py_buffer(tokens))
                size += tokens.nbytes
        if out:
            out.close()
            every = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([uri]), pa.array([size]), lists], ["file", "uri", "bytes", "ids"])

    return run


def write_flat(docs: DataFrame, folder: str, text_col: str = "text", vocabulary: str = VOCABULARY, vocabulary_folder: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Write the texts to flat files in ``folder`` (a URI that all executors share); (file, uri, bytes, ids of its documents) of each."""
    files, place = _open(folder)
    files.create_dir(place, recursive=True)
    given = docs.select(col(text_col).cast("string").alias("text"), col(id_col).cast("bigint").alias("id")).where("text is not null")
    return cut(given.mapInArrow(_write(tokenizer_path(vocabulary, vocabulary_folder), folder), "file int, uri string, bytes bigint, ids array<bigint>"))


def _scan(end: int, width: int, block: int):
    kind = np.dtype(f"<u{width}")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["bytes"] % width:
                    raise ValueError(f"{row['uri']}: {row['bytes']} bytes are not whole ids")
                files, place = _open(row["uri"])
                with files.open_input_file(place) as f:
                    raw = f.read_at(min(block, row["bytes"] - row["at"]), row["at"])
                start = row["at"] // width
                ends = pa.array(np.flatnonzero(np.frombuffer(raw, kind) == end) + start)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), ends)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]], pa.int32()), pa.array([start]), pa.array([len(raw) // width]), lists], ["file", "start", "size", "ends"])

    return run


def count_flat(files: DataFrame, end: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, doc, start, n_tokens) of each document in flat files given as (file, uri, bytes); documents of a file are numbered from 0."""
    blocks = files.where("bytes > 0").select("file", "uri", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {block}L)")).alias("at"))
    found = cut(blocks.repartition("file", "at").mapInArrow(_scan(end, width, block), "file int, start bigint, size bigint, ends array<bigint>"))
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.try_element_at("ends", F.lit(-1)) + 1
    edges = found.select(
        "file",
        "start",
        F.coalesce(F.max(last).over(before), F.lit(0)).alias("from"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("doc"),
        F.lead("start").over(order).isNull().alias("final"),
    )
    both = found.join(edges, ["file", "start"])
    total = F.col("start") + F.col("size")
    rest = F.when(F.col("final") & (F.coalesce(last, "from") < total), F.array(total)).otherwise(F.array().cast("array<bigint>"))
    stops = both.select("file", "doc", "from", F.concat("ends", rest).alias("stops")).where("size(stops) > 0")
    # a document begins after the stop before its own
    begins = F.concat(F.array("from"), F.transform(F.slice("stops", 1, F.size("stops") - 1), lambda x: x + 1))
    each = stops.select("file", F.col("doc").alias("base"), F.posexplode(F.arrays_zip(begins.alias("start"), "stops")).alias("i", "d"))
    return each.select("file", (F.col("base") + F.col("i")).alias("doc"), F.col("d.start").alias("start"), (F.col("d.stops") - F.col("d.start")).alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as flat files in the shared folder, every document's tokens counted from those, and its id beside them."""
    import uuid

    own = bpe.codec(tokenizer_path(VOCABULARY))
    folder = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    written = write_flat(table(spark, sf_dir, "documents"), folder)
    counts = cut(count_flat(written, own.end, own.dtype.itemsize))
    files, place = _open(folder)
    files.delete_dir(place)
    ids = written.select("file", F.posexplode("ids").alias("doc", "doc_id"))
    return counts.join(ids, ["file", "doc"]).select("doc_id", "file", "doc", "start", "n_tokens")
