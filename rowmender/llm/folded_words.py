"""Words of a text as SQL expressions: A to Z in lower case, runs of digits, letters and all beyond ASCII."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

#: What separates words: every ASCII character but digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """``text`` with A to Z in lower case and all other letters as they are."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def folded_words(text: Column) -> Column:
    """The words of ``text`` in order, an empty array for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")
