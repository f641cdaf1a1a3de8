"""Words, shingles and hashes of texts as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is U+0020 and U+0009 to U+000D; all else belongs to words.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
GAP_CHARACTERS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.coalesce(F.array_remove(F.split(text, GAP, -1), ""), F.array().cast("array<string>"))


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
