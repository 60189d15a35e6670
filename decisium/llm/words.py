"""Words of a text as native columns: maximal runs of characters that aren't ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def spaced(text: Column) -> Column:
    """``text`` (null: empty) with every white space character as a blank. Byte searches, no regex."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """array<string>; empty for null, empty and blank texts. A split at single blanks takes no regex."""
    return F.array_remove(F.split(spaced(text), " "), "")


def n_words(text: Column) -> Column:
    """long; counts the runs without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
