"""Canonical MessagePack, cache keys and payload checksums."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_I64 = (1 << 63) - 1


def pack(value: object) -> bytes:
    """The shortest MessagePack form; map keys in order of their bytes."""
    if value is None or value is True or value is False:
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[value]
    if isinstance(value, int):
        if 0 <= value < 128 or -32 <= value < 0:
            return struct.pack("b" if value < 0 else "B", value)
        kinds = ((0xCC, ">B", 8), (0xCD, ">H", 16), (0xCE, ">I", 32), (0xCF, ">Q", 64)) if value >= 0 else ((0xD0, ">b", 7), (0xD1, ">h", 15), (0xD2, ">i", 31), (0xD3, ">q", 63))
        for code, form, bits in kinds:
            if -(1 << bits) <= value < (1 << bits):
                return bytes([code]) + struct.pack(form, value)
        raise ValueError("integer beyond 64 bits")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(len(raw), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(value, (bytes, bytearray)):
        return _head(len(value), None, 0, (0xC4, 0xC5, 0xC6)) + bytes(value)
    if isinstance(value, (list, tuple)):
        return _head(len(value), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack, value))
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: kv[0].encode())
        return _head(len(value), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(v) for k, v in items)
    raise TypeError(f"no MessagePack form for {type(value).__name__}")


def _head(n: int, short: int | None, below: int, codes: tuple) -> bytes:
    if short is not None and n < below:
        return bytes([short | n])
    for code, form, most in zip(codes, (">B", ">H", ">I"), (1 << 8, 1 << 16, 1 << 32), strict=True):
        if code is not None and n < most:
            return bytes([code]) + struct.pack(form, n)
    raise ValueError("too long")


_FIXED = {0xC0: None, 0xC2: False, 0xC3: True}
_NUMBER = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}
DEPTH = 64


def unpack(raw: bytes) -> object:
    """The one document that ``raw`` holds; trailing or missing bytes are errors, and so is nesting beyond ``DEPTH``."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise ValueError("the document is cut off")
        at += n
        return raw[at - n : at]

    def number(form: str):
        return struct.unpack(form, take(struct.calcsize(form)))[0]

    def read(depth: int):
        if depth > DEPTH:
            raise ValueError("nested too deeply")
        b = take(1)[0]
        if b < 0x80 or b >= 0xE0:
            return b if b < 0x80 else b - 256
        if b < 0xC0:
            kind, n = ("map", b & 15) if b < 0x90 else ("list", b & 15) if b < 0xA0 else ("str", b & 31)
        elif b in _FIXED:
            return _FIXED[b]
        elif b in _NUMBER:
            return number(_NUMBER[b])
        elif b in _SIZED:
            kind, n = _SIZED[b][0], number(_SIZED[b][1])
        else:
            raise ValueError(f"type {b:#x} is not allowed")
        if kind in ("str", "bin"):
            return take(n).decode() if kind == "str" else take(n)
        if kind == "list":
            return [read(depth + 1) for _ in range(n)]
        out = {}
        for _ in range(n):
            key = read(depth + 1)
            out[key] = read(depth + 1)
        return out

    value = read(0)
    if at != len(raw):
        raise ValueError(f"{len(raw) - at} bytes follow the document")
    return value


def key(namespace: str, operation: str, window: str) -> str:
    """``namespace:operation:digest`` of the packed argument list."""
    return f"{namespace}:{operation}:{hashlib.blake2b(pack([window]), digest_size=32).hexdigest()}"


def checksum(raw: bytes) -> str:
    return xxhash.xxh3_64(raw).hexdigest()


def parse_checksum(text: str) -> bytes:
    if len(text) != 16 or any(c not in "0123456789abcdefABCDEF" for c in text):
        raise ValueError("a checksum is 16 hex digits")
    return bytes.fromhex(text)


def verify(raw: bytes, expected: str | None = None) -> dict:
    """Size, checksum, whether it is the expected one (None if none is), and whether ``raw`` is one whole document."""
    try:
        unpack(raw)
        valid = True
    except (ValueError, TypeError):
        valid = False
    own = checksum(raw)
    return {"bytes": len(raw), "checksum": own, "matches": None if expected is None else bytes.fromhex(own) == parse_checksum(expected), "valid": valid}


def counts(raw: bytes) -> dict[str, int]:
    """A map of counts, strictly: one document, text keys, whole numbers of up to 64 bits."""
    value = unpack(raw)
    if not isinstance(value, dict):
        raise ValueError("not a map of counts")
    for k, n in value.items():
        if not isinstance(k, str) or type(n) is not int or not -MAX_I64 - 1 <= n <= MAX_I64:
            raise ValueError(f"{k!r}: {n!r} is no count")
    return value


@F.pandas_udf(T.StructType([T.StructField("counts", T.MapType(T.StringType(), T.LongType())), T.StructField("error", T.StringType())]))
def counts_udf(raw: pd.Series) -> pd.DataFrame:
    """The counts of packed maps, or why a map can't be taken."""

    def read(x):
        try:
            return counts(bytes(x)), None
        except (ValueError, TypeError) as e:
            return None, str(e)

    return pd.DataFrame([read(x) if x is not None else (None, "null") for x in raw], columns=["counts", "error"])
