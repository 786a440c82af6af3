"""A post's features from one raw event: the caps and orders of candidates matter, so one Arrow function makes them all."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_rules, web_rules

COLLECTION = "app.bsky.feed.post"
TEXT_LENGTH = 4096
MOST = {"feature": 64, "tag": 32, "url": 16, "emoji": 16}
EMOJI_LENGTH = 64
#: How far in the future a post may be dated, in seconds.
SKEW = 300

SCHEMA = (
    "source string, time_us bigint, ts double, lang string, tags array<string>, links array<string>, domains array<string>, "
    "emoji array<string>, labels map<string,string>, exclusions map<string,bigint>, sentiment double"
)

_STRINGS = pa.list_(pa.string())
_ARROW = {
    "source": pa.string(), "time_us": pa.int64(), "ts": pa.float64(), "lang": pa.string(), "tags": _STRINGS, "links": _STRINGS, "domains": _STRINGS,
    "emoji": _STRINGS, "labels": pa.map_(pa.string(), pa.string()), "exclusions": pa.map_(pa.string(), pa.int64()), "sentiment": pa.float64(),
}


def _dict(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x: object) -> list:
    return x if isinstance(x, list) else []


def _candidates(record: dict, left_out: dict[str, int]) -> tuple[list[str], list]:
    """Tags and links of the facets and the embed, as far as the caps go."""
    tags, links = [], []
    features = [f for facet in _list(record.get("facets")) if isinstance(facet, dict) for f in _list(facet.get("features"))]
    for feature in features[: MOST["feature"]]:
        if not isinstance(feature, dict):
            continue
        kind = feature.get("$type")
        if kind == "app.bsky.richtext.facet#link":
            links.append(feature.get("uri"))
        elif kind == "app.bsky.richtext.facet#tag":
            value = feature.get("tag")
            if not isinstance(value, str):
                left_out["malformed_tag"] = max(1, left_out["malformed_tag"])
            elif len(tags) < MOST["tag"]:
                tags.append(value)
            else:
                left_out["candidate_limit_tag"] += 1
    embed = record.get("embed")
    if isinstance(embed, dict) and embed.get("$type") == "app.bsky.embed.external":
        links.append(_dict(embed.get("external")).get("uri"))
    if len(links) > MOST["url"]:
        left_out["candidate_limit_url"] += len(links) - MOST["url"]
    return tags, links[: MOST["url"]]


def _accept_tags(candidates: list[str], labels: dict[str, str], refused: dict, left_out: dict[str, int]) -> None:
    for value in candidates:
        name, display, reason = text_rules.tag(value)
        if name is None:
            same = text_rules.rejected_key(value)
            before = refused.get(same)
            if before is not None and (before, reason) != ("malformed_tag", "filtered_tag"):
                continue
            if before is not None:
                left_out[before] -= 1
            left_out[reason] += 1
            refused[same] = reason
        elif name in labels:
            left_out["duplicate_in_event_tag"] += 1
        else:
            labels[name] = display


def features(event: object) -> dict | None:
    """The features of a post, or None for any other event."""
    event = _dict(event)
    commit, time_us = event.get("commit") or {}, event.get("time_us")
    if event.get("kind") != "commit" or not isinstance(commit, dict) or not isinstance(time_us, int):
        return None
    record = commit.get("record") or {}
    if commit.get("operation") != "create" or commit.get("collection") != COLLECTION or not isinstance(record, dict):
        return None
    text = record.get("text")
    text = unicodedata.normalize("NFKC", text[:TEXT_LENGTH])[:TEXT_LENGTH] if isinstance(text, str) else ""
    left_out: dict[str, int] = defaultdict(int)
    labels: dict[str, str] = {}
    refused: dict = {}
    tags, candidates = _candidates(record, left_out)
    _accept_tags(tags, labels, refused, left_out)
    if not labels:
        found = text_rules.tags_in(text)
        left_out["candidate_limit_tag"] += max(0, len(found) - MOST["tag"])
        _accept_tags(found[: MOST["tag"]], labels, refused, left_out)
    links: dict[str, None] = {}
    domains: dict[str, None] = {}
    for value in candidates:
        uri, host, reason = web_rules.link(value)
        if uri is None:
            left_out[reason] += 1
            continue
        for kind, value_, seen in (("url", uri, links), ("domain", host, domains)):
            if value_ in seen:
                left_out[f"duplicate_in_event_{kind}"] += 1
            seen[value_] = None
    found = [e for e in text_rules.emojis(text) if len(e) <= EMOJI_LENGTH]
    emoji = dict.fromkeys(found)
    left_out["duplicate_in_event_emoji"] += len(found) - len(emoji)
    left_out["candidate_limit_emoji"] += max(0, len(emoji) - MOST["emoji"])
    langs = _list(record.get("langs"))
    source = event.get("did")
    try:
        source = source if isinstance(source, str) and 0 < len(source) <= 2048 and source.encode() else None
    except UnicodeEncodeError:
        source = None
    return {
        "source": source,
        "time_us": time_us,
        "ts": time_us / 1e6,
        "lang": text_rules.primary_language(langs[0] if langs else None),
        "tags": list(labels),
        "links": list(links),
        "domains": list(domains),
        "emoji": list(emoji)[: MOST["emoji"]],
        "labels": labels,
        "exclusions": {k: n for k, n in left_out.items() if n > 0},
        "sentiment": text_rules.sentiment(text),
    }


def usable_time(time_us: object, now: float) -> bool:
    return type(time_us) is int and 0 <= time_us < 1 << 63 and time_us / 1e6 <= now + SKEW


def judge(raw: object, now: float) -> tuple[str, dict | None]:
    """(what became of a raw frame, its features): post, other, malformed (no JSON object), skewed (no usable time, or beyond the skew) or failed."""
    try:
        event = json.loads(raw)
    except (ValueError, TypeError, RecursionError):
        return "malformed", None
    if not isinstance(event, dict):
        return "malformed", None
    if not usable_time(event.get("time_us"), now):
        return "skewed", None
    try:
        found = features(event)
    except Exception:  # noqa: BLE001  # one event must not end the stream; it is counted
        return "failed", None
    return ("other", None) if found is None else ("post", found)


def decode(raw: object, now: float) -> dict | None:
    """The features of a raw frame; None for whatever is no post."""
    return judge(raw, now)[1]


_NUMBER = re.compile(r'\s*:\s*(-?\d+)\s*(?=[,}])')


def shallow_time(raw: str) -> int | None:
    """The first ``time_us`` of the outermost object, if it is a whole number of up to 63 bits; what is nested isn't parsed.

    A cursor for frames that can't be decoded; anything but an object has none.
    """
    at, n, depth = 0, len(raw), 0
    if raw.lstrip()[:1] != "{":
        return None
    while at < n:
        c = raw[at]
        if c == '"':
            end = at + 1
            while end < n and raw[end] != '"':
                end += 2 if raw[end] == "\\" else 1
            if depth == 1 and raw[at + 1 : end] == "time_us" and raw[end + 1 :].lstrip()[:1] == ":":
                found = _NUMBER.match(raw, end + 1)
                value = int(found[1]) if found and len(found[1]) < 20 else -1
                return value if 0 <= value < 1 << 63 else None
            at = end
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        at += 1
    return None


def source_digest(source: str | None, key: bytes) -> str | None:
    """What stands for a source outside of its post: a keyed digest, so that nothing that is kept names it."""
    return None if source is None else hashlib.blake2b(source.encode(), key=key, digest_size=16).hexdigest()


def posts(frames: DataFrame, now: float | Callable[[], float], raw_col: str = "value", arrival_col: str | None = None, digest_key: bytes | None = None) -> DataFrame:
    """The features of the posts among raw frames (batch or stream).

    ``now`` may be a clock, which is read for each batch. ``arrival_col`` (a
    double) is carried along; with a ``digest_key`` sources are digests.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = now() if callable(now) else now
            rows, places = [], []
            for i, raw in enumerate(batch[raw_col].to_pylist()):
                found = decode(raw, at)
                if found is not None:
                    if digest_key is not None:
                        found["source"] = source_digest(found["source"], digest_key)
                    rows.append(found)
                    places.append(i)
            made = [pa.array([list(r[c].items()) for r in rows] if pa.types.is_map(t) else [r[c] for r in rows], t) for c, t in _ARROW.items()]
            extra = [batch[arrival_col].take(pa.array(places, pa.int32()))] if arrival_col else []
            yield pa.RecordBatch.from_arrays([*made, *extra], [*_ARROW, *([arrival_col] if arrival_col else [])])

    extra = [F.col(arrival_col).cast("double").alias(arrival_col)] if arrival_col else []
    return frames.select(F.col(raw_col), *extra).mapInArrow(run, SCHEMA + (f", {arrival_col} double" if arrival_col else ""))


def outcomes(frames: DataFrame, now: float, raw_col: str = "value") -> DataFrame:
    """(value, outcome, missing_source) for each raw frame: what ``posts`` leaves out isn't lost unseen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [judge(r, now) for r in batch[raw_col]]
            yield pd.DataFrame({"value": batch[raw_col], "outcome": [o for o, _ in found], "missing_source": [f is not None and f["source"] is None for _, f in found]})

    return frames.select(F.col(raw_col)).mapInPandas(run, "value string, outcome string, missing_source boolean")


def quarantine(frames: DataFrame, now: float, raw_col: str = "value") -> DataFrame:
    """(value, outcome) of the frames that could not be used."""
    return outcomes(frames, now, raw_col).where("outcome in ('malformed', 'skewed', 'failed')").select("value", "outcome")
