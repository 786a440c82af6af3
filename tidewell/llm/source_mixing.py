"""Operator 4: mixing to target weights with soft membership.

Domains are the classes of a labelled table. A classifier learns them from a
bounded sample of labelled documents and gives every document a posterior over
domains. Each document then gets a rate from 0 to ``MOST``, how often it is to be used:
projected gradient descent on the squared differences between the domains'
expected tokens (the sum over documents of rate x tokens x posterior) and their
targets. The rates begin at 1. The gradient of a document, against its tokens, is
its posterior times one vector for all, the weighted misses; the weights are the
inverse moments of the documents that are at no bound, so that a step of length 1
is the whole way where no rate meets a bound. Several lengths are tried in one
pass; the rates are projected on the bounds and the best length is taken.

Targets can be out of reach: where all documents have some of a domain, no rates
bring it down to a small share. The steps then end at the least squares, the
largest domains first; ``totals`` gives what is reached against what is wanted,
and ``mix`` logs a warning for each domain that misses by ``MISS``.

How it scales. A document's rate after some steps follows from its posterior and
the steps' vectors, a few numbers each. So a step is one aggregation over a
narrow table (tokens and posteriors, written once to the shared folder, in the
one pass that scores the documents) to a few sums; rates are never stored
between steps, and nothing of the corpus' size is shuffled or collected. The
training sample is drawn by a hash of the id over all labels. One task holds its
word counts, 6 bytes for each different word of a document (``TRAIN_ROWS`` documents
of at most ``BUCKETS``: 393 MB at most, however long they are); only the weights go to the driver.

Results that hold by definition:

* a null or empty text has 0 tokens, the posterior of the intercepts and weighs
  nothing; its rate follows from its posterior like any other; very long texts
  are read whole;
* labels that are null in id, quality or toxic are ignored, and of several for an
  id the first domain by name counts; without labels all mass is on the anchor
  domain; a domain that no label names has posterior 0 and is left out of the
  targets;
* ties: of equal posteriors the domain named first is the likeliest;
* equal rows get equal rates; ids may repeat or be null, as rows aren't joined;
* ``apply_mix`` gives the caller's own columns, whatever their names; ``mix``
  replaces columns named like its results; an empty table gives an empty table.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import OWN, col, cut, numbered, renamed, table

DOMAINS = ("good", "low", "toxic")
#: Weights of the domains in the mix. The anchor's expected tokens are scaled by ``SCALE``, and the others follow in proportion.
TARGETS = {"good": 0.92, "low": 0.05, "toxic": 0.03}
ANCHOR, SCALE = "good", 1.25
#: Labelled documents to learn from, at most.
TRAIN_ROWS = 4000
#: A document is used so often at most: without a bound, targets that are out of reach would repeat a few documents without end.
MOST = 8.0
BUCKETS = 1 << 14
EXTRA = 5
#: Entries of word counts that a step of the training reads at once.
BLOCK = 1 << 20
#: Steps at most; they end when all domains are within ``CLOSE`` of their targets, or no length of a step brings them closer.
STEPS = 60
CLOSE = 1e-4
#: Lengths of a step that are tried at once.
LENGTHS = (1.0, 0.7, 0.4, 0.2, 0.1, 0.05, 0.02, 1e-2, 3e-3, 1e-3, 1e-4)
#: The part of the squared miss that a step has to take away.
GAIN = 1e-4
#: A domain whose expected tokens are off by more, against its target, is reported.
MISS = 0.01

_log = logging.getLogger(__name__)

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#$%&*|~^<>{}[]\\=_@!"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def domain_of(quality, toxic):
    """The label's domain."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").otherwise("good")


@dataclass
class Features:
    bucket: np.ndarray  #: of each word
    first: np.ndarray  #: words of text i: first[i]..first[i + 1]
    extra: np.ndarray  #: dense features of each text
    tokens: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    """Words hashed into buckets, and shares of symbols, capitals, digits and line breaks."""
    words = textscan.scan(data, offsets)
    raw = data[offsets[0] : offsets[-1]]
    edge = offsets - offsets[0]
    size = np.maximum(np.diff(edge), 1)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[raw])])
        return (total[edge[1:]] - total[edge[:-1]]) / size

    lines = np.zeros(256, np.int64)
    lines[10] = 1
    counts = words.counts
    extra = np.stack([5 * share(_SYMBOL), 5 * share(_UPPER), 5 * share(_DIGIT), 20 * share(lines), np.log1p(counts) / 10], axis=1)
    return Features((words.hashes >> np.uint64(50)).astype(np.int32), words.first, extra, counts.astype(np.int64))


def scores(f: Features, weights: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Log posteriors up to a constant: word weights over the root of the length, dense features, intercept."""
    n, k = len(f.tokens), weights.shape[1]
    out = np.zeros((n, k))
    full = f.tokens > 0
    if full.any():
        out[full] = np.add.reduceat(weights[f.bucket], f.first[:-1][full], axis=0) / np.sqrt(f.tokens[full])[:, None]
    return out + f.extra @ dense[:-1] + dense[-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Sample:
    """Word counts of some labelled documents: document d has the ``sizes[d]`` next entries, each ``count`` words of a ``bucket``."""

    label: np.ndarray
    times: np.ndarray  #: how often a document counts
    tokens: np.ndarray
    extra: np.ndarray
    sizes: np.ndarray
    bucket: np.ndarray
    count: np.ndarray

    def slopes(self, weights: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums over the documents of the loss' slopes."""
        k, bucket, count, full = weights.shape[1], self.bucket.astype(np.intp), self.count.astype(np.float64), self.sizes > 0
        starts, root = (np.cumsum(self.sizes) - self.sizes)[full], np.sqrt(np.maximum(self.tokens, 1))
        x = np.concatenate([self.extra, np.ones((len(self.label), 1))], axis=1)
        z = x @ dense
        if full.any():
            z[full] += np.stack([np.add.reduceat(count * weights[bucket, c], starts) for c in range(k)], axis=1) / root[full, None]
        off = (softmax(z) - np.eye(k)[self.label]) * self.times[:, None]
        words = [np.bincount(bucket, count * np.repeat(off[:, c] / root, self.sizes), BUCKETS) for c in range(k)]
        return np.stack(words, axis=1), x.T @ off


def train(sample: list[Sample], k: int, rounds: int = 120, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by Adam, on all rows at once."""
    n = sum(int(f.times.sum()) for f in sample)
    weights, dense = np.zeros((BUCKETS, k)), np.zeros((EXTRA + 1, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(dense), np.zeros_like(dense)]
    for step in range(1, rounds + 1):
        slope, other = decay * weights, decay * dense
        for f in sample:
            words, rest = f.slopes(weights, dense)
            slope += words / n
            other += rest / n
        for p, g, m in ((weights, slope, moments[:2]), (dense, other, moments[2:])):
            m[0] *= 0.9
            m[0] += 0.1 * g
            m[1] *= 0.99
            m[1] += 0.01 * g * g
            p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    return weights, dense


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of values[edges[i]:edges[i + 1]] as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _counted(batches):
    """The counts of the first column's words, after the other columns: at most ``BUCKETS`` entries, however long a text is."""
    for batch in batches:
        data, offsets = textscan.buffer(batch.column(0))
        for a, b in textscan.slices(offsets):
            f = features(data, offsets[a : b + 1])
            key, count = np.unique(np.repeat(np.arange(b - a), f.tokens) * BUCKETS + f.bucket, return_counts=True)
            edges = np.searchsorted(key, np.arange(b - a + 1) * BUCKETS)
            extra = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * EXTRA), pa.array(f.extra.reshape(-1)))
            lists = [_packed((key % BUCKETS).astype(np.uint16), edges), _packed(count.astype(np.int32), edges)]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array(f.tokens), extra, *lists], [*batch.schema.names[1:], "tokens", "extra", "bucket", "count"])


def _samples(batch: pa.RecordBatch, entries: int = BLOCK):
    """A batch of counted texts in parts of about ``entries`` entries, labelled by the places in ``DOMAINS``."""
    label = np.array([DOMAINS.index(d) for d in batch["domain"].to_pylist()], np.int64)
    extra, times, tokens = batch["extra"].flatten().to_numpy().reshape(-1, EXTRA), batch["times"].to_numpy(), batch["tokens"].to_numpy()
    (buckets, edges), (counts, _) = textscan.buffer(batch["bucket"]), textscan.buffer(batch["count"])
    edges = edges // 2
    for a, b in textscan.slices(edges, entries):
        # copies, so that the batch can go
        bucket, count = (np.frombuffer(x[w * edges[a] : w * edges[b]].tobytes(), kind) for x, w, kind in ((buckets, 2, np.uint16), (counts, 4, np.int32)))
        yield Sample(label[a:b], times[a:b].copy(), tokens[a:b].copy(), extra[a:b].copy(), np.diff(edges[a : b + 1]), bucket, count)


def _trained(batches):
    """One row: the domains that occur, and the weights that the counted texts give."""
    sample = [f for batch in batches if batch.num_rows for f in _samples(batch)]
    found = np.unique(np.concatenate([f.label for f in sample])) if sample else np.zeros(0, np.int64)
    if len(found) > 1:
        for f in sample:
            f.label = np.searchsorted(found, f.label)
        weights, dense = train(sample, len(found))
        yield pa.RecordBatch.from_pylist([{"names": [DOMAINS[i] for i in found], "weights": weights.tobytes(), "dense": dense.tobytes()}])
    elif len(found):
        yield pa.RecordBatch.from_pylist([{"names": [DOMAINS[found[0]]], "weights": b"", "dense": b""}])


def learn(labelled: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word weights, dense weights, domains that occur), from texts by doc_id and labels by doc_id."""
    named = labels.where("doc_id is not null and quality is not null and toxic is not null").select(
        F.col("doc_id").alias(f"{OWN}label_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")
    )
    drawn = named.groupBy(f"{OWN}label_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64(f"{OWN}label_id"), f"{OWN}label_id").limit(rows)
    texts = labelled.select(F.col("doc_id").alias(f"{OWN}id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # at most TRAIN_ROWS ids and names: safe to broadcast at any size of the corpus
    some = texts.join(F.broadcast(drawn), F.col(f"{OWN}id") == F.col(f"{OWN}label_id")).select("text", F.xxhash64("text").alias("hash"), "domain")
    # ids may repeat, so the sample is bounded again, by hashes: no task holds its texts
    first = some.select("hash", "domain").orderBy("hash", "domain").limit(rows).groupBy("hash", "domain").agg(F.count(F.lit(1)).alias("times"))
    counted = some.join(F.broadcast(first), ["hash", "domain"]).select("text", "hash", "domain", "times").mapInArrow(
        _counted, "hash bigint, domain string, times bigint, tokens bigint, extra array<double>, bucket binary, count binary"
    )
    each = counted.groupBy("hash", "domain").agg(*[F.first(c).alias(c) for c in ("times", "tokens", "extra", "bucket", "count")])
    # one task learns: it holds 6 bytes for each entry of the sample, and only the weights go to the driver
    got = each.coalesce(1).mapInArrow(_trained, "names array<string>, weights binary, dense binary").collect()
    if not got or len(got[0]["names"]) < 2:
        return np.zeros((BUCKETS, 1)), np.zeros((EXTRA + 1, 1)), got[0]["names"] if got else [ANCHOR]
    weights, dense = (np.frombuffer(bytes(got[0][c])).reshape(-1, len(got[0]["names"])) for c in ("weights", "dense"))
    return weights, dense, got[0]["names"]


_TOKENS, _POSTERIOR, _RATE = f"{OWN}tokens", f"{OWN}posterior", f"{OWN}rate"
_FOUND = [T.StructField(_TOKENS, T.LongType()), T.StructField(_POSTERIOR, T.ArrayType(T.DoubleType()))]


def _posteriors(model, keep_text: bool):
    """The columns with the tokens and posterior of the last one, a text."""

    def run(batches):
        weights, dense = model.value
        for batch in batches:
            data, offsets = textscan.buffer(batch.column(batch.num_columns - 1))
            for a, b in textscan.slices(offsets):
                f = features(data, offsets[a : b + 1])
                p = softmax(scores(f, weights, dense))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
                last = batch.num_columns - (not keep_text)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:last]), pa.array(f.tokens), lists], [*batch.schema.names[:last], _TOKENS, _POSTERIOR])

    return run


@dataclass(frozen=True)
class Plan:
    """Rates as the projected steps from 1 on leave them: a step takes a document's posterior times the step's vector away."""

    steps: tuple[tuple[float, ...], ...]
    most: float

    def rates(self, p: np.ndarray) -> np.ndarray:
        x = np.ones(len(p))
        for v in self.steps:
            x = np.clip(x - p @ np.array(v), 0.0, self.most)
        return x


def _sums(plan: Plan, moves: list[np.ndarray]):
    """Sums of one pass: expected tokens at rates of 1, and for each move after the plan's steps the tokens and the free documents' moments."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                t = batch.column(0).to_numpy().astype(np.float64)
                p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                got, at = [t @ p], plan.rates(p)
                for v in moves:
                    rate = np.clip(at - p @ v, 0.0, plan.most)
                    free = p * (t * ((rate > 0) & (rate < plan.most)))[:, None]
                    got += [(rate * t) @ p, (free.T @ p).reshape(-1)]
                got = np.concatenate(got)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pylist([{"sums": total.tolist()}])

    return run


def _totals(known: DataFrame, k: int, plan: Plan, moves: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Expected tokens of the domains at rates of 1, and (tokens, moments) after each move."""
    parts = known.select("tokens", "posterior").mapInArrow(_sums(plan, moves), "sums array<double>")
    # a row of under 2 KB from each task that has rows
    rows = parts.toArrow().column(0).to_pylist()
    row = np.array(rows).sum(axis=0) if rows else np.zeros(k + (k + k * k) * len(moves))
    return row[:k], [(x[:k], x[k:].reshape(k, k)) for x in row[k:].reshape(len(moves), k + k * k)]


def fit(known: DataFrame, names: list[str], targets: dict[str, float] | None = None, most: float | None = MOST, steps: int = STEPS) -> tuple[Plan, np.ndarray, np.ndarray]:
    """(plan, expected tokens reached, targets) for a table of tokens and posteriors."""
    targets, k = targets or TARGETS, len(names)
    plan = Plan((), np.inf if most is None else most)
    base, ((now, moments),) = _totals(known, k, plan, [np.zeros(k)])
    whole = max(float(base.sum()), 1.0)
    share = np.array([targets.get(d, 0.0) for d in names])
    anchor = names.index(ANCHOR) if ANCHOR in names and share[names.index(ANCHOR)] > 0 else int(np.argmax(share))
    wanted = share / share[anchor] * base[anchor] * SCALE if share[anchor] > 0 else base
    miss = lambda x: float((((x - wanted) / whole) ** 2).sum())
    for _ in range(steps):
        if (np.abs(now - wanted) <= CLOSE * wanted).all():
            break
        # the gradient of a document, against its tokens, is its posterior times the weighted misses
        weights = np.linalg.pinv(moments / whole + 1e-12 * np.eye(k), hermitian=True)
        moves = [length * (weights @ ((now - wanted) / whole)) for length in LENGTHS]
        # beside it, the plain gradient, which goes down wherever it can
        plain = (now - wanted) / whole / max(float(np.trace(moments)) / whole, 1e-12)
        moves += [length * plain for length in LENGTHS]
        _, tried = _totals(known, k, plan, moves)
        best = min(range(len(moves)), key=lambda i: miss(tried[i][0]))
        if not miss(tried[best][0]) < (1 - GAIN) * miss(now):
            break
        plan, (now, moments) = Plan((*plan.steps, tuple(moves[best].tolist())), plan.most), tried[best]
    return plan, now, wanted


def _scored(docs: DataFrame, kept: list[str], labelled: DataFrame, labels: DataFrame, text_col: str, rows: int) -> tuple[DataFrame, list[str]]:
    """(the kept columns with tokens and posterior, written once; the domains)."""
    weights, dense, names = learn(labelled, labels, rows)
    model = docs.sparkSession.sparkContext.broadcast((weights, dense))  # BUCKETS rows, whatever the corpus
    text, keep = col(text_col).cast("string").alias(f"{OWN}text"), text_col in kept
    others = [c for c in kept if c != text_col]
    schema = [*(T.StructField(f"{OWN}c{i}", docs.schema[c].dataType) for i, c in enumerate(others)), *([T.StructField(f"{OWN}text", T.StringType())] if keep else []), *_FOUND]
    known = cut(docs.select(*numbered(others), text).mapInArrow(_posteriors(model, keep), T.StructType(schema)))
    return known.select(*renamed(others), *known.columns[len(others) :]), names


def _fitted(known: DataFrame, names: list[str], targets: dict[str, float] | None, most: float | None) -> tuple[Plan, np.ndarray, np.ndarray]:
    """What ``fit`` gives; misses are logged."""
    plan, now, wanted = fit(known.select(F.col(_TOKENS).alias("tokens"), F.col(_POSTERIOR).alias("posterior")), names, targets, most)
    for domain, r, w in zip(names, now, wanted, strict=True):
        if abs(r - w) > MISS * w:
            _log.warning("domain %s: %.0f expected tokens, %.0f wanted, after %d steps", domain, r, w, len(plan.steps))
    return plan, now, wanted


def _rate(plan: Plan):
    """The rate as a built-in expression over the posterior."""
    x = F.lit(1.0)
    for v in plan.steps:
        taken = sum((F.col(_POSTERIOR)[i] * F.lit(float(c)) for i, c in enumerate(v)), F.lit(0.0))
        x = F.greatest(x - taken, F.lit(0.0))
        if np.isfinite(plan.most):
            x = F.least(x, F.lit(plan.most))
    return x


def totals(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text_col: str = "text", targets: dict[str, float] | None = None, most: float | None = MOST, rows: int = TRAIN_ROWS) -> DataFrame:
    """(domain, reached, wanted): the domains' expected tokens at the rates that ``mix`` gives, and the targets."""
    known, names = _scored(docs, [], labelled, labels, text_col, rows)
    _, now, wanted = _fitted(known, names, targets, most)
    return docs.sparkSession.createDataFrame(list(zip(names, now.tolist(), wanted.tolist(), strict=True)), "domain string, reached double, wanted double")


def mix(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text_col: str = "text", targets: dict[str, float] | None = None, most: float | None = MOST, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the text, with tokens, posterior, domain (the likeliest) and rate; ``most`` bounds the rates, unless it is None."""
    kept = [c for c in docs.columns if c not in ("tokens", "posterior", "domain", "rate", text_col)]
    known, names = _scored(docs, kept, labelled, labels, text_col, rows)
    plan, _, _ = _fitted(known, names, targets, most)
    likeliest = F.expr(f"array_position({_POSTERIOR}, array_max({_POSTERIOR}))").cast("int")
    domain = F.element_at(F.array(*[F.lit(d) for d in names]), likeliest).alias("domain")
    return known.select(*[col(c) for c in kept], F.col(_TOKENS).alias("tokens"), F.col(_POSTERIOR).alias("posterior"), domain, _rate(plan).alias("rate"))


def copies(rate, salt: list):
    """How often a row is used: its rate, rounded up with the probability of its fraction by a hash of ``salt``."""
    draw = F.pmod(F.xxhash64(*salt), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("int")


def apply_mix(docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, most: float | None = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with their own columns."""
    known, names = _scored(docs, docs.columns, labelled, labels, text_col, TRAIN_ROWS)
    plan, _, _ = _fitted(known, names, targets, most)
    text = F.col(f"{OWN}text").cast(docs.schema[text_col].dataType)
    own = known.withColumn(f"{OWN}copies", copies(_rate(plan), [F.col(f"{OWN}text") if id_col == text_col else col(id_col)])).where(f"{OWN}copies > 0")
    again = own.withColumn(f"{OWN}copies", F.explode(F.sequence(F.lit(1), F.col(f"{OWN}copies"))))
    return again.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns])


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "source", "text"), docs, table(spark, sf_dir, "labels"))
    return mixed.withColumn("copies", copies(F.col("rate"), [F.col("doc_id")])).select("doc_id", "source", "tokens", "posterior", "domain", "rate", "copies")
