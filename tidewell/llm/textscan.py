"""Vectorised word scanning over Arrow string buffers.

The operators of this subpackage look at every word of every document, so the
inner loops run in numpy over the value buffer of a whole Arrow batch and never
over Python strings.  A *word* is a maximal run of bytes above 0x20 (so ASCII
white space and control bytes separate words).  Hashes are taken over the
UTF-8 bytes, with ASCII letters lowered when ``fold`` is set.

Nulls read as empty texts; the callers decide what a null means to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Texts of one slice together; bounds the scratch arrays of a scan (about 60 bytes for each byte).
SLICE_BYTES = 2 << 20
#: Texts of one slice: their numbers take 20 bits at most.
SLICE_TEXTS = 1 << 19

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 16), _P if kind == "p" else _PINV, dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if n <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, in place on a copy."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text starts in them (n + 1 offsets from 0)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    values = texts.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start and its length."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of whole texts, of about ``limit`` bytes and at most ``SLICE_TEXTS`` texts each; a longer text is alone in its range."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + SLICE_TEXTS, n)
        yield at, end
        at = end


@dataclass
class Words:
    """The words of some texts, in order."""

    data: np.ndarray  #: bytes of the texts
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    first: np.ndarray  #: n + 1 offsets: the words of text i are first[i]..first[i + 1]
    hashes: np.ndarray  #: uint64 of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def scan(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; offsets need not start at 0."""
    base = offsets[0]
    raw, offs = data[base : offsets[-1]], offsets - base
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(raw, z, z, np.zeros(len(offs), np.int64), np.zeros(0, np.uint64))
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.greater(raw, 32, out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    # a text boundary inside a run of word bytes ends one word and starts another
    cuts = offs[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    marks = np.flatnonzero(edge)
    if len(cuts):
        marks = np.sort(np.concatenate([marks, cuts, cuts]), kind="stable")
    starts, ends = marks[0::2], marks[1::2]
    first = np.searchsorted(starts, offs).astype(np.int64)
    body = _FOLD[raw] if fold else raw
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _power("p", n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("i", n)[starts])
    return Words(raw, starts, ends, first, hashes)


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on (at word i), and whether all k lie in the text of word i."""
    h, n = words.hashes, len(words.hashes)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += h[j : n - k + 1 + j]
    out[: n - k + 1] = mix(acc)
    end = np.repeat(words.first[1:], words.counts)
    return out, np.arange(n) + k <= end


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of values[i:i + w], for each i with a whole window (van Herk)."""
    n = len(values)
    if w <= 1 or n < w:
        return values if w <= 1 else values[:0]
    out, span = values.copy(), 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: n - w + 1], out[rest : rest + n - w + 1]) if rest else out[: n - w + 1]
