"""Sources of frames: JSON lines, and a replaying stream whose offset is a byte."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.extract import COLLECTION


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A frame a line, as ``value``."""
    return spark.read.text(path)


def subscription_url(base: str, cursor: int | None = None) -> str:
    """The address that asks the server for posts only, from the cursor on."""
    parts = urlsplit(base)
    query = {"wantedCollections": COLLECTION} | ({} if cursor is None else {"cursor": cursor})
    return urlunsplit((parts.scheme, parts.netloc, parts.path, "&".join(x for x in (parts.query, urlencode(query)) if x), ""))


def advanced(cursor: int | None, time_us: int) -> int:
    """A cursor never goes back."""
    return time_us if cursor is None else max(cursor, time_us)


def resuming(connect: Callable[[str], Iterable[str]], base: str, handle: Callable[[str], int | None], sleep: Callable[[float], None] = time.sleep, attempts: int | None = None, first: float = 1.0, most: float = 60.0) -> int | None:
    """Read frames from ``connect(address)`` and take up again where it broke off; returns the cursor.

    ``handle`` returns a frame's time, or None if it is no use. After a break the
    pause doubles from ``first`` to ``most`` seconds, and begins anew only once a
    frame was of use. ``attempts`` bounds the connections (for tests and replays).
    """
    cursor, pause, left = None, first, attempts
    while left is None or left > 0:
        left = None if left is None else left - 1
        try:
            for frame in connect(subscription_url(base, cursor)):
                at = handle(frame)
                if at is not None:
                    cursor, pause = advanced(cursor, at), first
        except (OSError, EOFError):
            pass
        if left != 0:
            sleep(pause)
            pause = min(most, pause * 2)
    return cursor


@dataclass
class Part(InputPartition):
    start: int
    end: int


class ReplayReader(DataSourceStreamReader):
    """Offsets are bytes of whole lines, so a batch reads its own part of the file and nothing before it."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("bytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self) -> dict:
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            at = size
            while at > 0:  # a line that is still being written is left for later
                begin = max(0, at - (1 << 16))
                f.seek(begin)
                found = f.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return {"byte": begin + found + 1}
                at = begin
        return {"byte": 0}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        edges = [*range(start["byte"], end["byte"], self.most), end["byte"]]
        return [Part(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, part: Part) -> Iterator[tuple]:
        """The lines that begin in the part."""
        with open(self.path, "rb") as f:
            if part.start:
                f.seek(part.start - 1)
                f.readline()
            while f.tell() < part.end:
                yield (f.readline().decode("utf-8", "replace").rstrip("\n"),)


class ReplaySource(DataSource):
    """``spark.readStream.format("frames").option("path", ...)``: stands where a socket would be; register it with ``spark.dataSource``.

    The path is one that all executors can open.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)


def write_frames(frames: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(x, ensure_ascii=False) + "\n" for x in frames)
