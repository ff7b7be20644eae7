"""Text expressions: folding, titles, series, ids and dates in free text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Letters with marks and the ASCII letters below them, by Unicode decomposition."""
    pairs = {}
    for start, stop in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(start, stop):
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
            if len(base) == 1 and base.isascii() and base.isalpha():
                pairs[chr(code)] = base
    pairs |= {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "Ł": "l", "Ø": "o", "Đ": "d", "Ð": "d"}
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _folds()


def fold(s: Column) -> Column:
    """Lower case without marks; runs of anything but a-z and digits become one space."""
    plain = F.regexp_replace(F.translate(F.regexp_replace(F.regexp_replace(s, "[ßẞ]", "ss"), "[þÞ]", "th"), _FROM, _TO), "\\p{M}+", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def _compat() -> tuple[str, str]:
    """Single characters that stand for another one (full-width forms, superscripts, circled letters)."""
    pairs = {}
    for start, stop in ((0xA0, 0x100), (0x2000, 0x3400), (0xFF00, 0xFFF0)):
        for code in range(start, stop):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain != chr(code):
                pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


_WIDE, _PLAIN = _compat()


def normalize_title(s: Column) -> Column:
    """A title as a cluster's key: compatibility forms and case levelled, & as and, a number at the end gone,
    punctuation as space, no leading article. Brackets with other contents stay, so volumes stay apart."""
    t = F.translate(F.lower(F.trim(s)), _WIDE, _PLAIN)
    for ligature in "\ufb00\ufb01\ufb02\ufb03\ufb04\ufb06":
        t = F.replace(t, F.lit(ligature), F.lit(unicodedata.normalize("NFKC", ligature)))
    t = F.replace(t, F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, "\\s*#\\s*\\d+\\s*$", "")
    t = F.regexp_replace(t, "\\s*\\(\\s*\\d+\\s*\\)\\s*$", "")
    t = F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}_]+", " "))
    return F.regexp_replace(t, "^(the|a|an) ", "")


def core_title(s: Column) -> Column:
    """The key of a title without anything in brackets."""
    return normalize_title(F.regexp_replace(s, "\\([^)]*\\)", " "))


#: Patterns of ids, series and dates.
SERIES = "^(.*?)\\s*\\(([^)]+),\\s*#(\\d+(?:\\.\\d+)?)\\)\\s*$"


def series_of(title: Column) -> tuple[Column, Column]:
    """Series name and volume number in a title such as `Name (Series, #2)`; null without one."""
    found = title.rlike(SERIES)
    return F.when(found, F.regexp_extract(title, SERIES, 2)), F.when(found, F.regexp_extract(title, SERIES, 3).cast("double"))


def id_in_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "(?:/book/show/)?([0-9]+)", 1), F.lit(""))


def author_in_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "author/show/([0-9]+)", 1), F.lit(""))


def year_in_text(text: Column, low: int = 1500, high: int = 2030) -> Column:
    """The number at the end of a free-text date if it lies in the band."""
    year = F.expr("null").cast("int") if text is None else F.regexp_extract(text, "(-?[0-9]{1,4})\\s*$", 1).try_cast("int")
    return F.when(year.between(low, high), year)


def clean(s: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(s), F.lit(""))


def int_like(s: Column) -> Column:
    """`1965`, `1965.0` and ` 1965 ` as an int; null otherwise."""
    return F.trim(s).try_cast("double").try_cast("int")


def weekday_timestamp(s: Column) -> Column:
    """Epoch seconds of `Tue Mar 05 10:11:12 -0800 2013`; null if empty or malformed."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(F.nullif(F.trim(s), F.lit("")), 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")))
