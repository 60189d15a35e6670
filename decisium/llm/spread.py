"""Joins of many rows to one row a key, where a single key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of at most this many rows never needs to be spread.
HOT_ROWS = 512
#: No more keys than this are sent to every task.
HOT_KEYS = 500_000


def hot_from(total: int) -> int:
    """The number of rows from which on a key counts as hot: fewer than ``HOT_KEYS`` keys can be."""
    return max(HOT_ROWS, total // HOT_KEYS) + 1


def spread_join(rows: DataFrame, sides: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``sides`` by ``key``, which ``sides`` has at most once; ``how``: inner or left.

    ``sides`` says in column ``n`` (not returned) how many of the ``total`` rows a key has.
    Hot keys, fewer than ``HOT_KEYS`` by count, are sent to every task, and their rows stay
    where they are; the others are shuffled. ``rows`` is read twice: pass a written table.
    """
    hot = F.broadcast(sides.filter(F.col(n) >= hot_from(total)).drop(n))
    cold = sides.filter(F.col(n) < hot_from(total)).drop(n)
    near = rows.join(hot, key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far.select(near.columns))
