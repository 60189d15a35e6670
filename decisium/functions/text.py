"""Text functions as columns: normalisers, tokens, sentences, replies, display."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: White space as Unicode sees it, in Java's regex dialect.
_WIDE = "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACES = r"\t-\r\x1c-\x20\x85\xa0" + _WIDE
SPACE = f"[{_SPACES}]"


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def collapsed(c) -> Column:
    """White-space runs become one space, ends are stripped; null is empty; case kept (N2)."""
    return F.trim(F.regexp_replace(text_of(c), SPACE + "+", " "))


def normal(c) -> Column:
    """``collapsed`` and lower case (N1)."""
    return F.lower(collapsed(c))


def stripped(c) -> Column:
    return F.regexp_replace(text_of(c), rf"\A{SPACE}+|{SPACE}+\z", "")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def model_text(c) -> Column:
    """NFKC, lower case, collapsed (N3). Only texts that aren't ASCII go through Python."""
    t = text_of(c)
    return normal(F.when(t.rlike(r"\A[\x00-\x7f]*\z"), t).otherwise(_nfkc(t)))


def tokens(c) -> Column:
    """Words with an inner apostrophe, else single characters that aren't space."""
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(rf"[\p{{L}}\p{{N}}]+(?:'[\p{{L}}\p{{N}}]+)?|[^{_SPACES}]"), F.lit(0))


def ascii_words(c) -> Column:
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9']+"), F.lit(0))


def word_count(c) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_count(text_of(c), F.lit(f"[^{_SPACES}]+"))


def sentences(c) -> Column:
    """Collapsed sentences that end in . ! or ?; blank ones dropped."""
    return F.filter(F.split(collapsed(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def parsed_choice(reply, n_options) -> Column:
    """The option that a reply names: a leading number, else the first letter A to H; null out of range.

    A leading number out of range doesn't fall through to the letter.
    """
    t = stripped(reply)
    n = n_options if isinstance(n_options, Column) else F.col(n_options)
    digits = F.regexp_extract(t, r"\A(\d+)", 1)
    letter = F.upper(F.regexp_extract(t, "([A-Ha-h])", 1))
    index = F.when(digits != "", F.when(F.length(digits) <= 9, F.expr("0") + F.try_to_number(digits, F.lit("999999999")).cast("int"))).when(letter != "", F.ascii(letter) - 65)
    return F.when((index >= 0) & (index < n), index.cast("int"))


def json_array_text(reply) -> Column:
    """From the first [ to the last ]; null if there is none."""
    found = F.regexp_extract(text_of(reply), r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def hour_label(hour) -> Column:
    h = F.pmod(F.col(hour) if isinstance(hour, str) else hour, F.lit(24)).cast("int")
    twelve = F.when(F.pmod(h, F.lit(12)) == 0, F.lit(12)).otherwise(F.pmod(h, F.lit(12)))
    return F.concat(twelve.cast("string"), F.when(h < 12, F.lit(" am")).otherwise(F.lit(" pm")))


def bar(p, width: int = 30) -> Column:
    return F.repeat(F.lit("#"), F.bround((F.col(p) if isinstance(p, str) else p) * width).cast("int"))


def shortened(c, n: int) -> Column:
    t = collapsed(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts (lower-cased and collapsed)."""
    from difflib import SequenceMatcher

    def one(x, y):
        return SequenceMatcher(None, " ".join((x or "").split()).lower(), " ".join((y or "").split()).lower()).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def has_number(text, number) -> Column:
    """The number stands in the text as a whole run of digits."""
    return F.array_contains(F.regexp_extract_all(text_of(text), F.lit(r"\d+"), F.lit(0)), (F.col(number) if isinstance(number, str) else number).cast("string"))


def first_int(c) -> Column:
    found = F.regexp_extract(text_of(c), r"-?\d+", 0)
    return F.when(F.length(found).between(1, 18), found.cast("long"))
