"""Words of texts as DataFrame expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def words(text: Column) -> Column:
    """The words of a text after A-Z are lower-cased: runs of a-z, digits and everything outside ASCII.
    A text without words, null too, gives one empty word, so that the text is cut only once; word_count
    knows it."""
    text = F.coalesce(text, F.lit(""))
    # Only ASCII letters may change: lower() is exact where every character is one byte, and quicker.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.split(F.btrim(low, F.lit(_PARTS)), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def word_count(w: Column) -> Column:
    """How many words an array made by words() holds."""
    return F.when(w[0] == "", F.lit(0)).otherwise(F.size(w))


def tokens(text: Column) -> Column:
    """How many runs free of ASCII white space a text has, as a long; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return (F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")
