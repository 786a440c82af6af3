"""Byte-level BPE over whole Arrow batches.

The vocabulary's pattern splits a text before any merge, and a *unit* (a run of
white space with the run of other characters that follows) always begins at
such a split. So units are encoded independently of what surrounds them: equal
units are encoded once, and any concatenation of units may be encoded in one
call and taken apart again by the byte lengths of its tokens.

That holds for blank, tab, CR and LF as white space. Texts that hold other
white space or control characters are encoded whole.

Units and chunks are found again by 64-bit hashes of their bytes, and different
bytes may have one hash. So ``ChunkEncoder`` compares what its tokens stand for
with the bytes that it was given, and encodes whole each text that differs.
"""

from __future__ import annotations

import base64

import numpy as np

from . import textscan

#: The split that goes with the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_ODD = np.zeros(256, bool)  # control bytes, and first bytes of characters that may be white space
_ODD[:9] = _ODD[11:13] = _ODD[14:32] = True
_ODD[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: UTF-8 of the other white space: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000.
_WIDE_SPACE = np.unique([int.from_bytes(chr(c).encode().rjust(3, b"\0"), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


class Codec:
    """A rank file; ``end`` is the free id that ends documents."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.path = path
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.end = self.size
        self.dtype = np.dtype("<u2") if self.size < 1 << 16 else np.dtype("<u4")
        by_id = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, raw: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(raw.decode()), dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.bytes[textscan.flat(self.starts[ids], self.lengths[ids])].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec of a file in each process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at each text, and at white space after anything else."""
    n = len(data)
    space = _SPACE[data]
    start = np.zeros(n + 1, bool)
    start[1:n] = space[1:] & ~space[:-1]
    start[offsets] = True
    start[n] = False
    return np.flatnonzero(start)


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold white space or control characters beyond blank, tab, CR and LF."""
    at = np.flatnonzero(_ODD[data])
    if len(at):
        first, second, third = (data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(3))
        code = np.where(first == 0xC2, (first << 8) | second, (first << 16) | (second << 8) | third)
        at = at[(first < 0x80) | np.isin(code, _WIDE_SPACE)]
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at, side="right") - 1] = True
    return out


class SpanHash:
    """Hashes of any spans of a buffer, from one pass over its bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * textscan._power("p", n), out=self.sums[1:])
        self.inverse = textscan._power("i", n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return textscan.mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def encode_spans(bpe: Codec, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of spans that each are whole units; n + 1 offsets into them.

    Spans that begin with white space are encoded in one call. The others (of
    texts' beginnings) follow a line feed, which is a token of its own there.
    """
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, bpe.dtype), np.zeros(1, np.int64)
    bare = ~_SPACE[data[np.minimum(starts, len(data) - 1)]] & (lengths > 0)
    size = lengths + bare
    at = np.cumsum(size) - size
    raw = np.empty(int(size.sum()), np.uint8)
    raw[at[bare]] = 10
    raw[textscan.flat(at + bare, lengths)] = data[textscan.flat(starts, lengths)]
    ids = bpe.encode(raw.tobytes())
    ends_at = np.cumsum(bpe.lengths[ids])
    cut = np.searchsorted(ends_at, at + size, side="left") + 1
    cut[size == 0] = np.searchsorted(ends_at, at[size == 0], side="right")
    offsets = np.concatenate([[0], cut])
    if bare.any():
        keep = np.ones(len(ids), bool)
        keep[offsets[:-1][bare]] = False
        gone = np.cumsum(bare)
        ids = ids[keep]
        offsets[1:] -= gone
    return ids, offsets


class UnitEncoder:
    """Encodes batches without odd texts; units seen before in this process come from a pool."""

    #: Units that the pool holds at most (about 40 bytes each); beyond, it starts afresh.
    POOL = 1_500_000

    def __init__(self, bpe: Codec):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, self.bpe.dtype)
        self.used = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts ``data[offsets[i]:offsets[i + 1]]``, and n + 1 offsets into them."""
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, self.bpe.dtype), np.zeros(len(offsets), np.int64)
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        unique, where, inverse = np.unique(SpanHash(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > self.POOL:
            self.clear()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            w = where[new]
            ids, cuts = encode_spans(self.bpe, data, starts[w], ends[w])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used, len(ids)) + len(ids), self.bpe.dtype)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.known = np.insert(self.known, at[new], unique[new])
            self.start = np.insert(self.start, at[new], cuts[:-1] + self.used)
            self.length = np.insert(self.length, at[new], np.diff(cuts))
            self.used += len(ids)
            at = np.searchsorted(self.known, unique)
        start, length = self.start[at][inverse], self.length[at][inverse]
        tokens = self.pool[textscan.flat(start, length)]
        total = np.concatenate([[0], np.cumsum(length)])
        return tokens, total[np.searchsorted(starts, offsets)]


class ChunkEncoder:
    """Encodes texts by chunks whose ends the content defines.

    A chunk ends where the hash of the last ``REACH`` bytes has ``MASK`` bits of
    zeros, so copies of a passage fall into the same chunks in whatever text
    they stand. A chunk is encoded once and comes from a pool afterwards. Tokens
    at a join may differ from those of the whole text: the join is widened to
    the nearest points on both sides where the pattern must split, and what lies
    between is encoded again. Both sides must agree on a token's end there; a
    text where they don't is encoded whole.
    """

    REACH = 16
    MASK = 9
    #: Tokens of the pool; beyond, it starts afresh.
    POOL = 8_000_000

    def __init__(self, bpe: Codec):
        self.bpe = bpe
        self.units = UnitEncoder(bpe)
        self.encoded = self.reused = 0
        #: Of each text encoded last: whether its tokens stand for its bytes.
        self.exact = np.zeros(0, bool)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, self.bpe.dtype)
        self.used = 0

    def chunk_starts(self, data: np.ndarray, offsets: np.ndarray, hashes: SpanHash) -> np.ndarray:
        n, w = len(data), self.REACH
        start = np.zeros(n + 1, bool)
        if n > w:
            rolled = (hashes.sums[w:n] - hashes.sums[: n - w]) * hashes.inverse[: n - w]
            start[w:n] = (textscan.mix(rolled) >> np.uint64(64 - self.MASK)) == 0
            start[:n] &= (data & 0xC0) != 0x80  # a character stays whole
        start[offsets] = True
        start[n] = False
        return np.flatnonzero(start)

    def _chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: SpanHash) -> np.ndarray:
        """Tokens of all chunks, each encoded by itself."""
        unique, where, inverse = np.unique(hashes.of(starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            w = where[new]
            lengths = ends[w] - starts[w]
            ids, cuts = self.units.encode(data[textscan.flat(starts[w], lengths)], np.concatenate([[0], np.cumsum(lengths)]))
            if self.used + len(ids) > self.POOL and self.used:
                self.clear()
                return self._chunks(data, starts, ends, hashes)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used, len(ids)) + len(ids), self.bpe.dtype)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.known = np.insert(self.known, at[new], unique[new])
            self.start = np.insert(self.start, at[new], cuts[:-1] + self.used)
            self.length = np.insert(self.length, at[new], np.diff(cuts))
            self.used += len(ids)
            at = np.searchsorted(self.known, unique)
        self.encoded += int(new.sum())
        self.reused += len(starts) - int(new.sum())
        return self.pool[textscan.flat(self.start[at][inverse], self.length[at][inverse])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the texts ``data[offsets[i]:offsets[i + 1]]``, exactly the tokenizer's, and n + 1 offsets into them."""
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            self.exact = np.ones(len(offsets) - 1, bool)
            return np.zeros(0, self.bpe.dtype), np.zeros(len(offsets), np.int64)
        odd = odd_texts(data, offsets)
        if odd.any():
            lengths = np.where(odd, 0, np.diff(offsets))
            own, edges = data[textscan.flat(offsets[:-1], lengths)], np.concatenate([[0], np.cumsum(lengths)])
        else:
            own, edges = data, offsets
        tokens, cuts = self._joined(own, edges) if len(own) else (np.zeros(0, self.bpe.dtype), np.zeros(len(offsets), np.int64))
        whole = odd | differing(self.bpe, tokens, cuts, own, edges)
        self.exact = np.ones(len(whole), bool)
        if whole.any():
            tokens, cuts = spliced(self.bpe, tokens, cuts, data, offsets, whole)
            for i in np.flatnonzero(whole):
                self.exact[i] = self.bpe.decode(tokens[cuts[i] : cuts[i + 1]]) == data[offsets[i] : offsets[i + 1]].tobytes()
        return tokens, cuts

    def _joined(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by chunks and repaired joins, right where no two chunks or units have one hash."""
        n = len(data)
        hashes = SpanHash(data)
        chunks = self.chunk_starts(data, offsets, hashes)
        tokens = self._chunks(data, chunks, np.append(chunks[1:], n), hashes)
        ends = np.cumsum(self.bpe.lengths[tokens])
        begins = np.concatenate([[0], ends[:-1]])
        units = np.append(unit_starts(data, offsets), n)
        place = np.searchsorted(units, chunks)
        torn = np.unique(place[units[place] != chunks])
        if len(torn):
            u, v = units[torn - 1], units[torn]
            again, cuts = self.units.encode(data[textscan.flat(u, v - u)], np.concatenate([[0], np.cumsum(v - u)]))
            i, j = np.searchsorted(begins, u), np.searchsorted(begins, v)
            agree = (begins[np.minimum(i, len(begins) - 1)] == u) & ((v == n) | (begins[np.minimum(j, len(begins) - 1)] == v))
            if not agree.all():
                return self.units.encode(data, offsets)
            keep_from = np.concatenate([[0], j])
            keep_to = np.append(i, len(tokens))
            starts = np.empty(2 * len(torn) + 1, np.int64)
            sizes = np.empty_like(starts)
            starts[0::2], sizes[0::2] = keep_from, keep_to - keep_from
            starts[1::2], sizes[1::2] = cuts[:-1] + len(tokens), np.diff(cuts)
            if (sizes < 0).any():
                return self.units.encode(data, offsets)
            tokens = np.concatenate([tokens, again])[textscan.flat(starts, sizes)]
            ends = np.cumsum(self.bpe.lengths[tokens])
        return tokens, np.searchsorted(ends, offsets, side="right")


def differing(bpe: Codec, tokens: np.ndarray, cuts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the tokens don't give back, byte for byte."""
    ends = np.concatenate([[0], np.cumsum(bpe.lengths[tokens])])
    got = np.diff(ends[cuts]) != np.diff(offsets)
    if got.any():  # lengths differ: each text is compared by itself
        for i in np.flatnonzero(~got):
            got[i] = bpe.decode(tokens[cuts[i] : cuts[i + 1]]) != data[offsets[i] : offsets[i + 1]].tobytes()
        return got
    wrong = np.flatnonzero(np.frombuffer(bpe.decode(tokens), np.uint8) != data)
    got[np.searchsorted(offsets, wrong, side="right") - 1] = True
    return got


def spliced(bpe: Codec, tokens: np.ndarray, cuts: np.ndarray, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens, with those texts encoded whole that ``whole`` marks."""
    parts, sizes, at = [], np.diff(cuts), 0
    for i in np.flatnonzero(whole):
        parts.append(tokens[cuts[at] : cuts[i]])
        parts.append(bpe.encode(data[offsets[i] : offsets[i + 1]].tobytes()))
        sizes[i], at = len(parts[-1]), i + 1
    parts.append(tokens[cuts[at] :])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One chunk encoder of a file in each process, so that its pools last from batch to batch."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(codec(path))
    return _encoders[path]
