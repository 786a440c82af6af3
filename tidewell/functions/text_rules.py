"""Rules for tags, emoji, languages and sentiment, and the Arrow functions over them.

Unicode normalisation, case folding and categories have no Spark built-in that
agrees with Python's tables, so these run in Arrow batches; what Spark can say
(``language``) is a built-in expression.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG_LENGTH = 64
#: Tags that a worker remembers; the oldest go first.
KNOWN = 1 << 14
BLOCKED_TAGS = frozenset("xxx spam porno porn nsfw followforfollow follow4follow adult".split())

_BLOCKS = "☀-⛿✀-➿\U0001f1e6-\U0001f1ff\U0001f300-\U0001f5ff\U0001f600-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff\U0001fa70-\U0001faff"
#: One emoji with its selectors, skin tones and joined parts; linear time on any input.
EMOJI = re.compile(f"[{_BLOCKS}](?:[️\U0001f3fb-\U0001f3ff]|‍[{_BLOCKS}])*")

_WORD, _LANGUAGE = re.compile("[a-z']+"), re.compile("[a-z]{2,8}")
GLAD = frozenset(
    "amazing awesome beautiful best cool excellent excited fun glad good great happy hope love loved nice perfect proud thank thanks win won wonderful".split()
)
SORRY = frozenset(
    "angry annoying awful bad broken disappointed fail failed hate hated horrible lose lost sad scared sick terrible tired ugly worst wrong".split()
)
GLAD_EMOJI = frozenset("😁🙏👍🎉🔥✨😊🥰😂😍💜💙💚💛🧡❤")
SORRY_EMOJI = frozenset("😨😰😞🤮😠💔👎😡😭😢")


def is_tag_char(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LMN"


def _display(value: object) -> str | None:
    return unicodedata.normalize("NFKC", value).strip() if isinstance(value, str) and len(value) <= TAG_LENGTH else None


def _canonical(display: str | None) -> str | None:
    """The folded form of a whole tag, or None where it isn't one."""
    if not display or len(display) > TAG_LENGTH or not any(map(str.isalnum, display)):
        return None
    if not all(part and all(map(is_tag_char, part)) for part in display.split("-")):
        return None
    folded = unicodedata.normalize("NFKC", display.casefold())  # folding may undo the normal form
    return folded if len(folded) <= TAG_LENGTH else None


def tag(value: object) -> tuple[str | None, str | None, str | None]:
    """(canonical tag, how it is shown, why it is excluded)."""
    return _tag(value) if isinstance(value, str) and len(value) <= TAG_LENGTH else (None, None, "malformed_tag")


@lru_cache(KNOWN)
def _tag(value: str) -> tuple[str | None, str | None, str | None]:
    display = _display(value)
    folded = _canonical(display)
    if folded is None:
        return None, None, "malformed_tag"
    return (None, None, "filtered_tag") if folded in BLOCKED_TAGS else (folded, display, None)


def rejected_key(value: object) -> tuple[str, str] | None:
    """What makes two rejected tags of an event the same."""
    if not isinstance(value, str):
        return None
    bare = value[1:] if value[:1] == "#" else value
    display = _display(bare)
    if display is None:
        return "malformed", bare[: TAG_LENGTH + 1]
    folded = _canonical(display)
    return ("malformed", display.casefold()) if folded is None else ("canonical", folded)


def tags_in(text: str) -> list[str]:
    """Tags after ``#`` where neither a tag character nor another ``#`` stands before it; hyphens only between tag characters."""
    s, out, at = unicodedata.normalize("NFKC", text), [], 0
    while (at := s.find("#", at)) >= 0:
        begin = end = at + 1
        if not at or not (s[at - 1] == "#" or is_tag_char(s[at - 1])):
            while end < len(s) and (is_tag_char(s[end]) or s[end] == "-" and end > begin and end + 1 < len(s) and is_tag_char(s[end + 1])):
                end += 1
            if end > begin:
                out.append(s[begin:end])
        at = max(end, at + 1)
    return out


def emojis(text: str) -> list[str]:
    return EMOJI.findall(text)


def sentiment(text: str) -> float | None:
    """(glad - sorry) / (glad + sorry) over lexicon words and emoji, or None without any."""
    words = _WORD.findall(text.lower())
    bases = [e.replace("️", "")[:1] for e in emojis(text)]
    up = sum(map(GLAD.__contains__, words)) + sum(map(GLAD_EMOJI.__contains__, bases))
    down = sum(map(SORRY.__contains__, words)) + sum(map(SORRY_EMOJI.__contains__, bases))
    return (up - down) / (up + down) if up + down else None


def primary_language(value: object) -> str:
    first = value.partition("-")[0].lower() if isinstance(value, str) else ""
    return first if _LANGUAGE.fullmatch(first) else "und"


def language(value: Column) -> Column:
    """``primary_language`` as a built-in expression."""
    first = F.lower(F.substring_index(value, "-", 1))
    return F.when(first.rlike("^[a-z]{2,8}$") & ~first.contains("\n"), first).otherwise(F.lit("und"))


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("tag", "display", "reason")]))
def tag_udf(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tag(v) for v in values], columns=["tag", "display", "reason"], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def tags_in_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: tags_in(v) if isinstance(v, str) else None)


@F.pandas_udf(T.DoubleType())
def sentiment_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: sentiment(v) if isinstance(v, str) else None).astype("float64")
