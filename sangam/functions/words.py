"""Words of a text: lower-cased, punctuation (categories P*) deleted, split at Unicode white space."""

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def words_col(text: Column) -> Column:
    """array<string>; null for a null text, empty for a text without words."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"\p{P}+", ""), SPACE), lambda w: w != "")


def words_key(text: Column) -> Column:
    """The words joined by one blank, without building an array."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{P}+", ""), SPACE, " "))


_PUNCT: dict = {}


def py_words(text: str) -> list[str]:
    """The same words in Python, for tests and Arrow functions."""
    if not _PUNCT:
        _PUNCT.update((i, None) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "P")
    return text.lower().translate(_PUNCT).split()

