"""Array functions: probabilities, options, padding, ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(p) -> Column:
    return F.aggregate(_c(p), F.lit(0.0), lambda a, x: a + x)


def default_probs(n, gold, confidence: float = 0.95) -> Column:
    """Uniform without a gold option, else ``confidence`` on it and the rest shared by the others."""
    n, gold = _c(n), _c(gold)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(gold.isNull(), 1.0 / n).when(i == gold, F.lit(confidence)).otherwise((1.0 - confidence) / F.greatest(n - 1, F.lit(1))),
    )


def renormalised(p) -> Column:
    s = total(p)
    return F.when(s > 0, F.transform(_c(p), lambda x: x / s))


def softmax(logits, mask=None) -> Column:
    """Masked-out options get probability 0."""
    x = _c(logits)
    if mask is not None:
        x = F.zip_with(x, _c(mask), lambda v, m: F.when(m, v))
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.when(v.isNull(), 0.0).otherwise(F.exp(v - top)))
    return F.transform(e, lambda v: v / total(e))


def argmax(p) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(_c(p), F.array_max(_c(p))) - 1).cast("int")


def gold_probability(p, gold) -> Column:
    return F.get(_c(p), _c(gold))


def masked_kl(teacher, model) -> Column:
    """KL(teacher || model) over the options; 0 * ln 0 is 0."""
    terms = F.zip_with(_c(teacher), _c(model), lambda t, q: F.when(t > 0, t * (F.ln(t) - F.ln(F.greatest(q, F.lit(1e-9))))).otherwise(0.0))
    return total(terms)


def squared_distance(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def one_hot(n, gold) -> Column:
    return F.transform(F.sequence(F.lit(0), _c(n) - 1), lambda i: F.when(i == _c(gold), 1.0).otherwise(0.0))


def padded(a, length: int, fill=0) -> Column:
    a = F.slice(_c(a), 1, length)
    return F.concat(a, F.array_repeat(F.lit(fill).cast("int"), F.lit(length) - F.size(a)))


def valid_mask(a, length: int) -> Column:
    n = F.size(_c(a))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i < n)


def shuffled(a, seed, *ids) -> Column:
    """Seeded order of the elements, the same however rows are dealt."""
    prefix = F.concat_ws("|", F.lit(str(seed)), *[_c(i).cast("string") for i in ids])
    keyed = F.transform(_c(a), lambda x, i: F.struct(F.sha2(F.concat_ws("|", prefix, i.cast("string")), 256).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def permutation(n, seed, *ids) -> Column:
    return shuffled(F.sequence(F.lit(0), _c(n) - 1), seed, *ids)


def permuted(a, order) -> Column:
    return F.transform(_c(order), lambda i: F.get(_c(a), i))


def clean_options(options, gold) -> Column:
    """struct(options, gold): blank and case-insensitively repeated options dropped, first kept, gold remapped.

    The gold option keeps its place's text: a gold duplicate maps to the kept copy.
    """
    from decisium.functions.text import collapsed

    trimmed = F.transform(_c(options), collapsed)
    low = F.transform(trimmed, F.lower)
    kept = F.filter(trimmed, lambda x, i: (x != "") & (F.array_position(low, F.lower(x)) == i + 1))
    kept_low = F.transform(kept, F.lower)
    place = F.array_position(kept_low, F.get(low, _c(gold)))
    return F.struct(kept.alias("options"), F.when(place > 0, (place - 1).cast("int")).alias("gold"))


def bigrams(words) -> Column:
    """Neighbouring pairs joined by a space."""
    w = _c(words)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def masked_mean(values, mask) -> Column:
    v = F.filter(F.zip_with(_c(values), _c(mask), lambda x, m: F.when(m, x)), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, total(v) / F.size(v))
