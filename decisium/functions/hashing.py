"""Deterministic hashes: content splits, byte n-grams, token ids, hash order."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

from decisium.functions.text import collapsed


def sha_order(seed, *cols) -> Column:
    """A sort key that is uniform, seeded and independent of partitioning."""
    parts = [F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]]
    return F.sha2(F.concat_ws("|", *parts), 256)


def sha_place(seed, n: Column, *cols) -> Column:
    """A place from 0 to ``n`` - 1 by the first 32 bits of ``sha_order``."""
    return F.pmod(F.conv(F.substring(sha_order(seed, *cols), 1, 8), 16, 10).cast("long"), n).cast("int")


#: Digits of sortable ids: all but the letters that read like others.
SORTABLE = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def sortable_id(millis: Column, *cols) -> Column:
    """26 digits that sort by time: ten of ``millis``, sixteen of the hash of ``cols``, so a rerun gives the same id."""
    digits, draw = F.array(*[F.lit(c) for c in SORTABLE]), F.sha2(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]), 256)
    parts = [F.get(digits, F.pmod(F.shiftright(millis.cast("long"), 5 * i), F.lit(32)).cast("int")) for i in reversed(range(10))]
    for k in range(4):  # five hexadecimal digits are four of these
        five = F.conv(F.substring(draw, 5 * k + 1, 5), 16, 10).cast("long")
        parts += [F.get(digits, F.pmod(F.shiftright(five, 5 * i), F.lit(32)).cast("int")) for i in reversed(range(4))]
    return F.concat(*parts)


def sha_mod(key: Column, modulus: int = 1000) -> Column:
    """The SHA-256 of ``key``, as a number, modulo ``modulus``: Horner over eight 32-bit words."""
    step = (1 << 32) % modulus
    digest = F.sha2(key, 256)  # outside of any lambda, so it is computed once a row
    value = F.lit(0).cast("long")
    for i in range(8):
        value = F.pmod(value * step + F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("long"), F.lit(modulus))
    return value


def content_key(family, context, question, options) -> Column:
    """family::context::question::options, the options joined by character 30."""
    opts = F.array_join(F.transform(options, collapsed), "\x1e")
    return F.concat_ws("::", collapsed(family), collapsed(context), collapsed(question), opts)


def content_split(key: Column, salt: str, fraction: float) -> Column:
    """``eval-half`` for the share ``fraction`` of keys, decided by content alone."""
    return F.when(sha_mod(F.concat(F.lit(salt), key)) < round(fraction * 1000), F.lit("eval-half")).otherwise(F.lit("train-half"))


def ngram_multipliers(orders: tuple[int, ...], heads: int, buckets: int, seed: int) -> dict[tuple[int, int], tuple[int, ...]]:
    """Odd multipliers for each (order, head), already reduced modulo ``buckets`` so that no product overflows."""
    rng = random.Random(seed)
    return {(o, h): tuple((rng.getrandbits(62) | 1) % buckets for _ in range(o)) for o in orders for h in range(heads)}


def byte_values(text: Column) -> Column:
    """array<int> of the text's UTF-8 bytes."""
    h = F.hex(F.encode(text, "UTF-8"))
    n = F.length(h) / 2
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda i: F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
    )


def ngram_hashes(values: Column, multipliers: tuple[int, ...], buckets: int) -> Column:
    """array<long>: sum of (byte + 1) * multiplier over each window, modulo ``buckets``."""
    order = len(multipliers)

    def window(i: Column) -> Column:
        total = F.lit(0).cast("long")
        for j, m in enumerate(multipliers):
            total = total + (F.get(values, i + j).cast("long") + 1) * m
        return F.pmod(total, F.lit(buckets))

    n = F.size(values) - order
    return F.when(n < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), window))


def number_bucket(token: Column, buckets: int = 4096, first: int = 2) -> Column:
    """The id of a run of digits of any length: its value modulo ``buckets``, by Horner over digits."""
    digits = F.split(token, "")
    value = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: F.pmod(a * 10 + d.cast("long"), F.lit(buckets)))
    return (value + first).cast("long")
