"""Secret scans through a trigram inverted index.

Each rule is a byte regex. ``required`` derives a Boolean query over lower-cased
trigrams from the regex's syntax tree: what every match must contain. A segment
(whole documents, about ``SEGMENT_BYTES`` of text) gets an inverted index from
the trigrams that any rule asks for to the sorted numbers of the documents that
contain them; a rule's query intersects and unites postings, and the candidates
are verified with the regex. A rule from which no trigram follows scans the whole
segment. Index, query and verification happen where the text is, so nothing but
spans leaves a task.

Spans are in code points, end exclusive. A kind's matches are leftmost and don't
overlap one another; a match that fails its length test is dropped and its
characters stay used up.

Edge cases: null and empty texts have no spans. Texts of any length are scanned
whole (a segment holds at least one document). Repeated rows get equal spans. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisium.llm.tokens import text_bytes

SEGMENT_BYTES = 4 << 20
#: Strings that an exact set may hold before it is turned into a query.
MOST_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters at least; the span is the whole match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern.encode(), re.I if self.ignore_case else 0)


# fixed values: the base kinds, in the order that breaks ties
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Publicly documented key formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("userinfo", r"[a-z]+://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!$&*+=-]+@"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def _all(*queries: Query) -> Query:
    parts = tuple(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(*queries: Query) -> Query:
    parts = tuple(dict.fromkeys(queries))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _grams(strings: frozenset[bytes]) -> Query:
    """One of ``strings`` occurs."""
    return _any(*(True if len(s) < 3 else _all(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


_NOTHING = frozenset([b""])


def _analyse(nodes) -> tuple[frozenset[bytes] | None, Query]:
    """(the strings that match, or None if too many; the query) for a sequence of nodes."""
    run, query, exact = _NOTHING, True, True
    for node in nodes:
        strings, needs = _one(*node)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in strings)
            continue
        query = _all(query, _grams(run), needs)
        exact = False
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else _NOTHING
    return (run, True) if exact else (None, _all(query, _grams(run)))


def _one(op, arg) -> tuple[frozenset[bytes] | None, Query]:
    if op is sre.LITERAL:
        return frozenset([bytes([arg]).lower()]), True
    if op is sre.IN:
        chars: set[bytes] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(bytes([value]).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                chars |= {bytes([c]).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (frozenset(chars), True) if len(chars) <= MOST_STRINGS else (None, True)
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        found = [_analyse(branch) for branch in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return frozenset().union(*(s for s, _ in found)), True
        return None, _any(*(q if s is None else _grams(s) for s, q in found))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, needs = _analyse(inner)
        if most == 1 and least == 0:
            return (strings | _NOTHING, True) if strings is not None and len(strings) < MOST_STRINGS else (None, True)
        if least == 0:
            return None, True
        if strings is None:
            return None, needs
        many = _NOTHING
        for _ in range(min(least, 8)):
            if len(many) * len(strings) > MOST_STRINGS:
                return None, _grams(many)
            many = frozenset(a + b for a in many for b in strings)
        return (many, True) if least == most <= 8 else (None, _grams(many))
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return _NOTHING, True
    return None, True


def required(rule: Rule) -> Query:
    """The Boolean trigram query that every text with a match of ``rule`` satisfies."""
    strings, query = _analyse(sre_parser.parse(rule.pattern.encode()))
    return _grams(strings) if strings is not None else query


def trigrams(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set() if isinstance(query, bool) else set().union(*(trigrams(q) for q in query[1]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings of the ``wanted`` trigrams over a segment of texts."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]):
        self.n = len(texts)
        self.joined = b"\n".join(texts)
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.postings: dict[bytes, np.ndarray] = {w: np.zeros(0, np.int64) for w in wanted}
        if len(self.joined) < 3 or not wanted:
            return
        low = _LOWER[np.frombuffer(self.joined, np.uint8)]
        pair = low[:-2].astype(np.uint16) << 8 | low[1:-1]
        table = np.zeros(1 << 16, bool)
        table[[w[0] << 8 | w[1] for w in wanted]] = True
        at = np.flatnonzero(table[pair])
        code = pair[at].astype(np.uint32) << 8 | low[at + 2]
        for w in wanted:
            hits = at[code == (w[0] << 16 | w[1] << 8 | w[2])]
            self.postings[w] = np.unique(np.searchsorted(self.starts, hits, side="right") - 1)

    def candidates(self, query: Query) -> np.ndarray | None:
        """Sorted document numbers, or None for all."""
        if query is True:
            return None
        if isinstance(query, bytes):
            return self.postings[query]
        found = None
        for part in query[1]:
            docs = self.candidates(part)
            if found is None:
                found = docs
            else:
                found = np.intersect1d(found, docs, assume_unique=True) if query[0] == "and" else np.union1d(found, docs)
        return found


def scan_segment(texts: list[bytes], rules: tuple[Rule, ...], queries: list[Query]) -> list[list[tuple[int, str, int, int]]]:
    """For each text its spans (rule number, kind, start, end) by start, then rule."""
    index = TrigramIndex(texts, set().union(*(trigrams(q) for q in queries)) if queries else set())
    found: list[list[tuple[int, str, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex = rule.regex
        docs = index.candidates(query)
        if docs is None:
            docs = range(len(texts))
        for d in docs:
            text = texts[d]
            for m in regex.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[d].append((m.start(), k, m.end()))
    out = []
    for text, spans in zip(texts, found, strict=True):
        if spans and not text.isascii():
            spans = [(len(text[:a].decode("utf-8", "replace")), k, len(text[:b].decode("utf-8", "replace"))) for a, k, b in spans]
        out.append([(k, rules[k].kind, a, b) for a, k, b in sorted(spans)])
    return out


def segments(texts: list[bytes], most: int = SEGMENT_BYTES):
    """(first, last) ranges of whole texts of about ``most`` bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


_QUOTE = re.compile("[\"']")


def redact(text: str, spans: list[tuple[int, str, int, int]]) -> str:
    """``text`` with each stretch of overlapping spans replaced by ``[kind]`` of its first span.

    A quote that closes the last one opened within a span goes with it: ``token='abcdef'`` becomes ``[assign]``.
    """
    out, at = [], 0
    for _, kind, a, b in spans:
        quotes = _QUOTE.findall(text, a, b)
        if quotes and text.startswith(quotes[-1], b):
            b += 1
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<rule int, kind string, start int, stop int>>) of every row."""
    queries = [required(r) for r in rules]

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("rule", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            texts = text_bytes(batch.column(1))
            spans = []
            for a, b in segments(texts):
                for found in scan_segment(texts[a:b], rules, queries):
                    spans.append([{"rule": k, "kind": n, "start": s, "stop": e} for k, n, s, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, spans array<struct<rule: int, kind: string, start: int, stop: int>>"
    )


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[kind]`` and n_chars counted anew."""
    queries = [required(r) for r in rules]
    columns = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = text_bytes(batch.column(at))
            new = batch.column(at).to_pylist()
            for a, b in segments(texts):
                for i, found in enumerate(scan_segment(texts[a:b], rules, queries)):
                    if found:
                        new[a + i] = redact(texts[a + i].decode("utf-8", "replace"), found)
            yield batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)
