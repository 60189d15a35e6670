"""Row, question and topic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decisium.functions.text import collapsed, normal

ITEM, FIELD = "\x1f", "\x1e"


def _options(options, fn) -> Column:
    return F.array_join(F.transform(F.coalesce(F.col(options) if isinstance(options, str) else options, F.array().cast("array<string>")), fn), ITEM)


def row_key(context="context", question="question", options="options") -> Column:
    """Context, question and options, without case and spacing."""
    return F.sha2(F.concat_ws(FIELD, normal(context), normal(question), _options(options, normal)), 256)


def exact_row_key(context="context", question="question", options="options") -> Column:
    """As ``row_key`` with case."""
    return F.sha2(F.concat_ws(FIELD, collapsed(context), collapsed(question), _options(options, collapsed)), 256)


def question_key(question="question", options="options") -> Column:
    """Question and options; the context doesn't matter."""
    return F.sha2(F.concat_ws(FIELD, normal(question), _options(options, normal)), 256)


def topic(*fields) -> Column:
    """The first field that isn't blank, normalised; null if all are."""
    return F.coalesce(*[F.nullif(normal(f), F.lit("")) for f in fields])


def census_topic(*fields) -> Column:
    """The first field that isn't blank, with case, else ``(unset)``."""
    return F.coalesce(*[F.nullif(collapsed(f), F.lit("")) for f in fields], F.lit("(unset)"))
