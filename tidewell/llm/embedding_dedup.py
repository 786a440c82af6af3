"""Operator 8: near-duplicate embeddings by a subspace pigeonhole join.

Vectors are scaled to length 1 and turned by a fixed random rotation, which
spreads distance evenly over the coordinates. These are split into blocks; two
vectors within a squared distance t have a block in which their squared
distance is at most that block's share of t. So each block is joined by range
under its share, on a grid of its leading coordinates, and the union of the
candidates is verified with exact distances. A class is a connected set of
vectors within the threshold; its least id stays.

How it scales. Equal vectors collapse first, by partial aggregation. A grid cell
is a key of an ordinary shuffle; a vector goes to its own cell and, among the
later ones, to those neighbours that its ball touches. ``plan`` chooses the
blocks, two at least, and how many coordinates the grid takes, by the rows and
meetings that a bounded sample of the vectors has under each choice. No choice
changes the result, and there is no cap on the vectors of a cell: a large one is
dealt in parts (``cells``), and a task holds two parts at most while the rest is
streamed tile by tile. In a tile a few of the block's coordinates reject nearly
all pairs before the whole block is looked at. A pair counts in the block in
which it takes the least of its share, so a link counts once. A cell returns
edges that connect what is close in it and numbers of links, not all pairs.

What stays. Vectors spread evenly over many dimensions lie so close together in
each coordinate, against the threshold, that the grid rejects next to nothing:
every choice then compares nearly all pairs by a block, and the work is
quadratic, though spread over the tasks. Parts grow in number with the cell,
and with them the rows that are shuffled.

Results that hold by definition:

* null, empty or zero vectors, and those with a null, infinite or NaN element,
  are compared with nothing: each is a class of its own without links and stays;
  so do rows with a null id;
* vectors of different lengths are never close;
* rows that repeat an id are one member, of the classes of all its vectors;
  equal vectors are close, and are no link; links are those between different
  vectors of length 1;
* ties: a distance equal to the threshold is within it;
* other columns are never read; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells, textscan
from .common import OWN, col, cut, table
from .components import components, spanning

#: Least cosine similarity of near copies.
SIMILARITY = 0.95
#: Rows of a tile of distances.
TILE = 1024
#: Vectors of a cell that is dealt, in how many parts if not too large for them, and bytes of a part at most.
SPLIT = 8192
SPREAD = 4
PART_BYTES = 32 << 20
#: Coordinates of a block that are looked at first.
FEW = 12
#: Rows of a vector in the grid, at most: they are shuffled, and take disk.
MOST_ROWS = 16
#: Vectors to plan by, at most.
SAMPLE = 2048
SLACK = 1e-3

_VECTORS = "id bigint, dim int, vec binary"
_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    if dim not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
        _rotations[dim] = (q * np.sign(np.diag(r))).astype(np.float32)
    return _rotations[dim]


def _parse(batches):
    """Unit vectors by length, as bytes; what cannot be compared is left out."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == dim)
            flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            x = np.asarray(flat, np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            if not ok.any():
                continue
            x = (x[ok] / norm[ok, None]).astype("<f4") + np.float32(0)  # no negative zero
            rows = binaries(x)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[ok])), pa.array(np.full(len(x), dim, np.int32)), rows], ["id", "dim", "vec"])


def binaries(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(x))])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """``binaries``, read back without a copy of each row."""
    data, _ = textscan.buffer(column)
    return np.frombuffer(data, "<f4").reshape(-1, dim)


def _blocks(dim: int, m: int) -> list[tuple[int, int]]:
    return [(dim * b // m, dim * (b + 1) // m) for b in range(m)]


def _later(g: int) -> list[np.ndarray]:
    return [np.array(o) for o in product((-1, 0, 1), repeat=g) if o > (0,) * g]


def _placed(x: np.ndarray, m: int, g: int, budget: float):
    """(block, rows, their cell's key, whether they only probe it): own cells, then later ones that a vector's ball touches."""
    dim = x.shape[1]
    turn, later = rotation(dim), {}
    for b, (start, end) in enumerate(_blocks(dim, m)):
        own = budget * (end - start) / dim
        side = np.sqrt(own) * (1 + SLACK)
        lead = (x @ turn[:, start : min(end, start + g)]).astype(np.float64)
        cell = np.floor(lead / side)
        inside = lead - cell * side
        cell = cell.astype(np.int64)

        def key(cells, b=b):
            k = textscan.mix(np.full(len(cells), b, np.uint64), 9)  # apart from any cell's number
            for c in cells.T:
                k = textscan.mix(k + c.astype(np.uint64))
            return k.view(np.int64)

        yield b, np.arange(len(x)), key(cell), False
        taken = lead.shape[1]
        for o in later.setdefault(taken, _later(taken)):
            gap = np.where(o > 0, side - inside, np.where(o < 0, inside, 0.0))
            at = np.flatnonzero((gap * gap).sum(axis=1) <= own * (1 + SLACK))
            if len(at):
                yield b, at, key(cell[at] + o), True


def measured(x: np.ndarray, m: int, g: int, budget: float) -> tuple[float, float]:
    """(rows of a vector, share of all pairs that meet, summed over blocks), as the vectors of a sample have them."""
    rows, home, probe = 0, [], []
    for _, at, key, only in _placed(x, m, g, budget):
        rows += len(at)
        (probe if only else home).append(key)
    cells, count = np.unique(np.concatenate(home), return_counts=True)
    met = float((count * (count - 1) / 2).sum())
    if probe:
        met += float(np.concatenate([[0], count])[1 + _where(cells, np.concatenate(probe))].sum())
    return rows / len(x), met / max(1, len(x) * (len(x) - 1) / 2)


def _where(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted cells, -1 if it is none of them."""
    at = np.minimum(np.searchsorted(cells, keys), len(cells) - 1)
    return np.where(cells[at] == keys, at, -1)


def plan(n: int, dim: int, budget: float, sample: np.ndarray, row_ns: float = 5000, pair_ns: float = 1.5, axis_ns: float = 0.06) -> tuple[int, int]:
    """(blocks, coordinates of a block that the grid takes) of the least estimated cost for n vectors like the sample's."""

    def cost(m: int, g: int) -> float:
        rows, met = measured(sample, m, g, budget)
        parts = 1 + n * met / m * dim * 4 / PART_BYTES  # a row of a large cell is sent once for each part
        return n * rows * parts * row_ns + n * n / 2 * met * (pair_ns + axis_ns * dim / m)

    options = [(m, g) for m in (2, 4, 8, 16) if m <= dim for g in range(1, min(4, dim // m) + 1)]
    options = [o for o in options if o == (2, 1) or measured(sample, *o, budget)[0] <= MOST_ROWS]
    return min(options, key=lambda o: cost(*o)) if options else (1, 1)


def _cells(dim: int, m: int, g: int, budget: float, dealt: cells.Deal | None):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            for b, at, key, probe in _placed(x, m, g, budget):
                if dealt is None:
                    if not probe:
                        yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                    continue
                row, place = dealt(key, ids[at], probe)
                pick = pa.array(at[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[row]), pa.array(place), pa.array(np.full(len(row), b, np.int32)), batch.column(0).take(pick), batch.column(1).take(pick)], ["key", "place", "block", "id", "vec"]
                )

    return run


class Tile:
    """Some vectors of a cell, with their block in a form whose product with another tile's is the squared distance."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: int, start: int, end: int):
        self.ids, self.x, self.block = ids, x, block
        self.links = np.zeros(len(ids), np.int64)
        self.u = x @ rotation(x.shape[1])[:, start:end]
        few = self.u[:, :FEW]
        size, one = (few * few).sum(axis=1)[:, None], np.ones((len(few), 1), np.float32)
        self.left, self.right = np.concatenate([-2 * few, size, one], axis=1), np.concatenate([few, one, size], axis=1)


def close_pairs(s: Tile, t: Tile, share: float, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of s and t within ``budget``: a few coordinates first, then the block's share, then the exact distance."""
    most = np.float32(share * (1 + SLACK) + 1e-6)
    i, j = np.nonzero(s.left @ t.right.T <= most)
    if s is t:
        keep = i < j
        i, j = i[keep], j[keep]
    for part, limit, kind in (("u", most, np.float32), ("x", budget, np.float64)):
        v, w, keep = getattr(s, part), getattr(t, part), np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            d = v[i[a : a + (1 << 16)]].astype(kind) - w[j[a : a + (1 << 16)]]
            keep[a : a + (1 << 16)] = np.einsum("ij,ij->i", d, d) <= limit
        i, j = i[keep], j[keep]
    return i, j


def counted(x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The block in which each pair takes the least of its share: the one in which it counts."""
    turned = (x.astype(np.float64) - y) @ rotation(x.shape[1]).astype(np.float64)
    ratio = [(turned[:, a:b] ** 2).sum(axis=1) / (b - a) for a, b in bounds]
    return np.argmin(np.stack(ratio).astype(np.float32), axis=0)


def _compare(dim: int, m: int, budget: float):
    bounds = _blocks(dim, m)

    def run(batches):
        def tile(key, columns):
            block = columns[0][0].as_py()
            return Tile(columns[1].to_numpy(), matrix(columns[2], dim), block, *bounds[block])

        def compare(s: Tile, t: Tile):
            start, end = bounds[s.block]
            i, j = close_pairs(s, t, budget * (end - start) / dim, budget)
            if len(i):
                a, b = spanning(s.ids[i], t.ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "links"])
                here = counted(s.x[i], t.x[j], bounds) == s.block
                s.links += np.bincount(i[here], minlength=len(s.ids))
                t.links += np.bincount(j[here], minlength=len(t.ids))

        def emit(t: Tile):
            has = np.flatnonzero(t.links)
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array(t.ids[has]), pa.nulls(len(has), pa.int64()), pa.array(t.links[has])], ["a", "b", "links"])

        yield from cells.stream(batches, 5, tile, compare, TILE, emit)

    return run


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """(id, root, links) for each distinct id with a vector that can be compared; the root is the class's least id."""
    budget, spark = 2 - 2 * similarity, vectors.sparkSession
    given = vectors.select(col(id_col).cast("bigint").alias("id"), col(vec_col).cast("array<double>").alias("v"))
    marks = cut(given.where("id is not null and v is not null").mapInArrow(_parse, _VECTORS))
    # a vector may repeat, and so may an id: of equal vectors the least id stands for all
    single = cut(marks.groupBy("dim", "vec").agg(F.min("id").alias("id")))
    met = None
    for dim, n in sorted(tuple(r) for r in single.groupBy("dim").count().collect()):
        vecs = single.where(F.col("dim") == dim).select("id", "vec")
        some = vecs.orderBy(F.xxhash64("vec"), "id").limit(SAMPLE).toArrow().column(1)
        m, g = plan(n, dim, budget, matrix(some, dim))
        large = cells.deal(vecs.mapInArrow(_cells(dim, m, g, budget, None), "key bigint"), n * m, SPLIT, max(TILE, PART_BYTES // (4 * dim)), SPREAD)
        spread = vecs.mapInArrow(_cells(dim, m, g, budget, large), "key bigint, place bigint, block int, id bigint, vec binary")
        # a fixed number of partitions: those merged by size would put the work on few tasks
        keyed = spread.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("key"), F.shiftright("place", 2)).sortWithinPartitions("key", "place")
        here = keyed.mapInArrow(_compare(dim, m, budget), "a bigint, b bigint, links bigint")
        met = here if met is None else met.unionByName(here)
    met = cut(met) if met is not None else spark.createDataFrame([], "a bigint, b bigint, links bigint")
    links = met.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    # the id that stands for each row's vector: equal vectors' least
    linked = marks.join(single.withColumnRenamed("id", "rep"), ["dim", "vec"]).groupBy("id", "rep").agg(F.count(F.lit(1)).alias("rows"))
    linked = cut(linked)
    roots = components(met.where("b is not null").select("a", "b").unionByName(linked.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    own = linked.join(links, "rep", "left").groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0))).alias("links"), F.sum("rows").alias("rows"))
    return own.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"), "links", "rows")


def classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, class_id, links): each distinct id with its class, named by the class's least id, and each id that has no vector to compare as a class of its own."""
    found = near_groups(vectors, id_col, vec_col, similarity).select(F.col("id").alias("vec_id"), F.col("root").alias("class_id"), "links")
    own = col(id_col).cast("bigint")
    every = vectors.select(own.alias("vec_id"))
    alone = every.join(found.select(F.col("vec_id").alias("have")), F.col("vec_id") == F.col("have"), "left_anti")
    alone = alone.where("vec_id is null").unionByName(alone.where("vec_id is not null").distinct())
    return found.unionByName(alone.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))


def drop_near_copies(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``vectors`` that are their class's first, or were compared with nothing."""
    gone = near_groups(vectors, id_col, vec_col, similarity).where("id <> root").select(F.col("id").alias(f"{OWN}gone"))
    known = vectors.withColumn(f"{OWN}id", col(id_col).cast("bigint"))
    return known.join(gone, F.col(f"{OWN}id") == F.col(f"{OWN}gone"), "left_anti").select(*[col(c) for c in vectors.columns])


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, class_id, links) for each vector."""
    return classes(table(spark, sf_dir, "embeddings"))
