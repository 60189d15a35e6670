"""Main text of web pages through wrappers inferred per host.

A page is a stream of tags (name and class names without digits) and texts. Repeats that
stand side by side collapse into a repeated group, from the inside out, so pages of one
template have few skeletons. A host's skeletons are aligned one after another
into a union-free regular expression: equal items match, a group matches a single
occurrence of its body, items that only one side has become optional, and texts
that differ become slots; texts that are alike on every page that has their place stay
constants, and carry digests of the pages they were on (``MIN_PAGES`` different ones).

On every page the wrapper decides first, place by place: a constant that ``MIN_PAGES``
pages of different content have alike is template text and goes; slots, and texts at places
that fewer pages have, stay. Repeats with a body of over ``MOST_BODY`` items aren't
collapsed, so their texts have places of their own and fall under the same rule.

What it leaves is divided by names: elements that the markup names as something else (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) go. Class
words of ``html`` and ``body`` don't count. Within an article a word that is only part of a
class name and may as well name a subject (``entry-header``, ``search-theory``) takes an
element away only where all of its text is links. Of the rest the text inside ``article`` or
``main`` is the main text, unless the text outside of them is ``OUTWEIGHS`` times as long (a
teaser in an article, the body in a ``div``); then, and where no article is marked, it is all
of the rest. Where nothing is left and no article is marked, only element names count.

Plan: one Arrow pass folds pages into (host, skeleton) rows within each task, small
shuffles merge them per skeleton and per host (through ``FOLDS`` parts of a host, step by
step, so a host's skeletons needn't meet before they are folded), and a second
pass extracts each page where it is. The wrappers of the hosts with the most pages go to
every task, ``BROADCAST_BYTES`` of them at most, by their measured sizes; only pages of
hosts beyond are joined by host, of which none has many pages then.

Edge cases: null and empty html give the empty text. Unclosed and stray tags,
cut-off entities and comments are read as browsers do. Pages without a host share
the host ''. A host with a single page has a wrapper without slots, which decides
nothing. Repeated rows get equal texts. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisium.runtime import materialise

#: Pages of different content that must have a constant before it counts as template text.
MIN_PAGES = 4
#: Parts of a host after each step of folding.
FOLDS = (4096, 64)
BROADCAST_BYTES = 64 << 20
#: How many times as long as an article's text the text outside must be for the article not to decide.
OUTWEIGHS = 2
#: Longest body, in items, of a repeated group.
MOST_BODY = 24

# fixed values: element and class names of HTML practice
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
_OTHER = frozenset("head title nav footer aside form script style noscript template svg iframe object button select option textarea dialog menu canvas audio video map math".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OTHER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer dropdown footer
    gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related
    replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets contentinfo complementary""".split()
)
#: Of these, what may be part of a subject's name within an article.
_SUBJECT_WORDS = frozenset(
    "ad ads banner consent dropdown footer header login menu nav notice notices promo promoted promotion related search share sharing signup social subscribe".split()
)
#: In a class name, what follows one of these says what the element has or lacks, not what it is.
_STATES = frozenset("has with no without".split())
_RAW = "script|style|textarea|title|noscript|template|iframe|svg"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?P<rest>[^>]*)>(?P<inside>.*?)(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that a new one of the same kind closes.
_SIBLINGS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
_SIBLINGS = {k: frozenset(v.split()) for k, v in _SIBLINGS.items()}


def tokens(page: str):
    """("<", name, attributes) for a start tag, (">", name, "") for an end tag, ("T", text, "") for text."""
    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            yield "T", m["text"], ""
        elif m["name"]:
            name = m["name"].lower()
            if m["end"]:
                yield ">", name, ""
            else:
                yield "<", name, m["attrs"]
        elif m["raw"]:
            yield "<", m["raw"].lower(), ""
            yield ">", m["raw"].lower(), ""


def _values(pattern: re.Pattern, attributes: str) -> str:
    return " ".join("".join(g) for g in pattern.findall(attributes)).lower() if attributes else ""


def item_of(element: str, attributes: str) -> str:
    """What stands for a start tag in skeletons: ids, and class names with digits, belong to a page rather than to a template."""
    stable = [c for c in _values(_CLASS, attributes).split() if c.isalpha() or not any(map(str.isdigit, c))]
    return f"<{' '.join([element, *stable])}>"


def named_other(element: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(class, id or role name the element as something else, they may do so).

    Of ``article`` and ``main`` only whole names count, of ``html`` and ``body`` none:
    their classes describe the page.
    """
    named = _values(_NAMED, attributes).split()
    if not named or element in ("html", "body"):
        return False, False
    maybe = in_article and "header" in named  # as the element of that name, an article's own
    sure = any(n in _OTHER_WORDS and not (maybe and n == "header") for n in named)
    if element not in ("article", "main"):
        for name in named:
            for word in _WORD.findall(name):
                if word in _STATES:
                    break
                if word in _OTHER_WORDS:
                    if in_article and word in _SUBJECT_WORDS:
                        maybe = True
                    else:
                        sure = True
    return sure, maybe


class Page:
    """A page's blocks and its skeleton.

    ``blocks``: (text, inside an article, named as something else, perhaps so, in an element of another kind, all of it links).
    ``has_article``: an article that isn't inside something else.
    """

    __slots__ = ("blocks", "skeleton", "has_article")

    def __init__(self, page: str):
        stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, and the state of what is inside
        out: list[str] = []
        blocks: list[tuple[str, bool, bool, bool, bool, bool]] = []
        parts: list[str] = []
        state = (False, False, False, False)
        self.has_article = in_link = False
        plain = False  # whether the block has text outside of links

        def flush() -> None:
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    blocks.append((text, *state, not plain))
                    out.append("T")
                parts.clear()

        for kind, name, attributes in tokens(page):
            if kind == "T":
                parts.append(name)
                plain = plain or not (in_link or name.isspace())
                continue
            if name in _INLINE:
                if name == "br":
                    parts.append(" ")
                elif name == "a":
                    in_link = kind == "<"
                continue
            flush()
            plain = in_link = False
            if kind == "<":
                if name in _SIBLINGS:
                    for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                        if stack[i][0] in _SIBLINGS[name]:
                            del stack[i:]
                            break
                        if stack[i][0] in ("ul", "ol", "table", "article", "body", "div", "section"):
                            break
                _, up_article, up_other, up_maybe, up_kind = stack[-1] if stack else ("", False, False, False, False)
                sure, maybe = named_other(name, attributes, up_article)
                kind_other = up_kind or name in _OTHER or (name == "header" and not up_article)
                other = up_other or kind_other or sure
                main = name in ("article", "main") or (name in ("div", "section") and "main" in _WORD.findall(_values(_NAMED, attributes)))
                article = up_article or (main and not other)
                self.has_article |= article
                out.append(item_of(name, attributes))
                if name not in _VOID:
                    stack.append((name, article, other, up_maybe or maybe, kind_other))
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                if name not in _SIBLINGS:  # their ends may be left out, so they say nothing
                    out.append(f"</{name}>")
            state = stack[-1][1:] if stack else (False, False, False, False)
        flush()
        self.blocks = blocks
        self.skeleton = out


_REPEAT = re.compile(rf"(.{{1,{MOST_BODY}}}?)\1+", re.S)


#: Distinct items of a page that have a character of their own; those beyond share one.
MOST_ITEMS = 1_000_000


class Alphabet:
    """A character for each distinct item of a page, so that repeats can be found by a regex."""

    def __init__(self):
        self.char: dict[str, str] = {}
        self.item: list[str] = []

    def of(self, item: str) -> str:
        c = self.char.get(item)
        if c is None and len(self.item) >= MOST_ITEMS and item != "<>":
            return self.of("<>")
        if c is None:
            n = len(self.item) + 0x100
            c = self.char[item] = chr(n if n < 0xD800 else n + 0x800)
            self.item.append(item)
        return c

    def back(self, c: str) -> str:
        n = ord(c)
        return self.item[(n if n < 0xD800 else n - 0x800) - 0x100]


def collapse(items: list[str]) -> tuple[list, list[int]]:
    """(items with repeats collapsed into ["+", body], for each text its place among the collapsed texts)."""
    alphabet = Alphabet()
    coded = "".join(map(alphabet.of, items))
    texts = [i for i, x in enumerate(items) if x == "T"]
    # every original item points to the slots of the nested form; rebuilt by walking the same repeats
    tree: list = [[c] for c in coded]
    while True:
        groups = list(_REPEAT.finditer(coded))
        if not groups:
            break
        new_coded, new_tree, at = [], [], 0
        for m in groups:
            a, b, body = m.start(), m.end(), len(m[1])
            new_coded.append(coded[at:a])
            new_tree += tree[at:a]
            new_coded.append(alphabet.of("(" + m[1] + ")+"))
            new_tree.append(["+", [tree[a + k : a + k + body] for k in range(0, b - a, body)]])
            at = b
        new_coded.append(coded[at:])
        new_tree += tree[at:]
        coded, tree = "".join(new_coded), new_tree
    form: list = []
    places: list[int] = []
    count = [0]

    def visit(nodes, into, own) -> None:
        """Fill ``into`` on the first occurrence; later ones take the slots ``own`` of the first."""
        for node in nodes:
            if node[0] == "+":
                body: list = []
                begun = count[0]
                reps = node[1]
                if own is None:
                    visit(reps[0], body, None)
                    used = list(range(begun, count[0]))
                    for rep in reps[1:]:
                        visit(rep, None, iter(used))
                else:
                    first = [next(own) for _ in range(texts_in(reps[0]))]
                    for rep in reps:
                        visit(rep, None, iter(first))
                if into is not None:
                    into.append(["+", body])
            else:
                item = alphabet.back(node[0])
                if item == "T":
                    if own is None:
                        places.append(count[0])
                        count[0] += 1
                    else:
                        places.append(next(own))
                if into is not None:
                    into.append(item)

    def texts_in(nodes) -> int:
        return sum(texts_in(n[1][0]) if n[0] == "+" else alphabet.back(n[0]) == "T" for n in nodes)

    visit(tree, form, None)
    assert len(places) == len(texts)
    return form, places


def number_texts(form: list, values: list) -> list:
    """``form`` with its texts as ["T", *value], in order of ``values``."""
    feed = iter(values)

    def walk(items):
        return [["T", *next(feed)] if x == "T" else x if isinstance(x, str) else [x[0], walk(x[1])] for x in items]

    return walk(form)


def texts_of(wrapper: list) -> list:
    """The constants (or None) of all texts of a wrapper, in order."""
    out = []
    for x in wrapper:
        if not isinstance(x, str):
            if x[0] == "T":
                out.append(x[1])
            else:
                out += texts_of(x[1])
    return out


def _shape(item) -> str:
    if isinstance(item, str):
        return item
    if item[0] == "T":
        return "T"
    return f"({' '.join(map(_shape, item[1]))}){item[0]}"


def _some(*contents: list[int]) -> list[int]:
    """The ``MIN_PAGES`` smallest of the digests: enough to know whether that many pages differ."""
    return sorted(set().union(*contents))[:MIN_PAGES]


def _same(a, b):
    """The item that stands for both, whose shapes are equal."""
    if isinstance(a, str):
        return a
    if a[0] == "T":
        if a[1] is None or a[1] != b[1]:
            return ["T", None]
        return ["T", a[1], _some(*a[2:], *b[2:])]
    return [a[0], [_same(x, y) for x, y in zip(a[1], b[1], strict=True)]]


def _lift(items: list, other: list) -> list:
    """Single occurrences in ``items`` of the bodies that ``other`` repeats become groups too."""
    bodies = {}
    for x in other:
        if not isinstance(x, str) and x[0] in "+?":
            group = x if x[0] == "+" else (x[1][0] if len(x[1]) == 1 and not isinstance(x[1][0], str) and x[1][0][0] == "+" else None)
            if group:
                bodies[tuple(map(_shape, group[1]))] = True
    shapes = [_shape(x) for x in items]
    for body in sorted(bodies, key=len, reverse=True):
        n, i = len(body), 0
        while i + n <= len(items):
            if tuple(shapes[i : i + n]) == body:
                items = [*items[:i], ["+", items[i : i + n]], *items[i + n :]]
                shapes = [_shape(x) for x in items]
            i += 1
    return items


def _core(item):
    """An optional's content if it is a single item, else the item."""
    return item[1][0] if not isinstance(item, str) and item[0] == "?" and len(item[1]) == 1 else item


def _steps(sa: list[str], sb: list[str]):
    """(i, j) for items that a longest common subsequence matches, (i, None) and (None, j) for others, in order."""
    head = 0
    while head < min(len(sa), len(sb)) and sa[head] == sb[head]:
        head += 1
    tail = 0
    while tail < min(len(sa), len(sb)) - head and sa[-1 - tail] == sb[-1 - tail]:
        tail += 1
    m, n = len(sa) - tail, len(sb) - tail
    best = [[0] * (n - head + 1) for _ in range(m - head + 1)]
    for i in range(m - head - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(n - head - 1, -1, -1):
            row[j] = below[j + 1] + 1 if sa[head + i] == sb[head + j] else max(below[j], row[j + 1])
    yield from ((k, k) for k in range(head))
    i = j = head
    while i < m and j < n:
        if sa[i] == sb[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif best[i + 1 - head][j - head] >= best[i - head][j + 1 - head]:
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1
    yield from ((k, None) for k in range(i, m))
    yield from ((None, k) for k in range(j, n))
    yield from ((m + k, n + k) for k in range(tail))


def align(a: list, b: list) -> list:
    """The wrapper of everything that ``a`` or ``b`` matches."""
    a, b = _lift(a, b), _lift(b, a)
    steps = _steps([_shape(_core(x)) for x in a], [_shape(_core(x)) for x in b])
    return [_optional(a[i]) if j is None else _optional(b[j]) if i is None else _merged(a[i], b[j]) for i, j in steps]


def _optional(item):
    return item if not isinstance(item, str) and item[0] == "?" else ["?", [item]]


def _merged(x, y):
    same = _same(_core(x), _core(y))
    return ["?", [same]] if any(not isinstance(v, str) and v[0] == "?" for v in (x, y)) else same


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
_HOST_AT = re.compile(_HOST)


def host_of(url: str | None) -> str:
    found = _HOST_AT.match(url or "")
    return found[1].lower() if found else ""


def _text_mark(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) >> 1


def _content_mark(page: Page) -> int:
    """A digest of what the markup's names leave of a page; copies with other menus or adverts have equal ones."""
    own = named_blocks(page, range(len(page.blocks))) or range(len(page.blocks))
    return xxhash.xxh32_intdigest("\n".join(page.blocks[i][0] for i in own).encode())


def _page_form(page: Page, memory: dict) -> tuple[str, list, list[int]]:
    raw = "\n".join(page.skeleton)
    found = memory.get(raw)
    if found is None:
        if len(memory) > 20_000:
            memory.clear()
        form, places = collapse(page.skeleton)
        found = memory[raw] = (json.dumps(form, separators=(",", ":")), form, places)
    return found


def _constants(page: Page, places: list[int]) -> list[int | None]:
    """Per collapsed text its mark, None where repeats differ."""
    out: list = [0] * (max(places) + 1 if places else 0)
    seen = [False] * len(out)
    for block, place in zip(page.blocks, places, strict=True):
        mark = _text_mark(block[0])
        if not seen[place]:
            out[place], seen[place] = mark, True
        elif out[place] != mark:
            out[place] = None
    return out


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, n_pages, wrapper json) of every host of (url, html)."""

    def fold_pages(batches):
        import pyarrow as pa

        held: dict[tuple[str, str], list] = {}
        memory: dict = {}

        def rows():
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array([xxhash.xxh64_intdigest(k[1].encode()) >> 1 for k in keys], pa.int64()),
                    pa.array([held[k][0] for k in keys], pa.int64()),
                    pa.array([held[k][1] for k in keys], pa.list_(pa.int64())),
                    pa.array([held[k][2] for k in keys], pa.list_(pa.int64())),
                ],
                names=["host", "skeleton", "mark", "n_pages", "texts", "contents"],
            )

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parsed = Page(page or "")
                name, _, places = _page_form(parsed, memory)
                texts, content = _constants(parsed, places), [_content_mark(parsed)]
                key = (host_of(url), name)
                if key in held:
                    old = held[key]
                    old[0] += 1
                    old[1] = [x if x == y else None for x, y in zip(old[1], texts, strict=True)]
                    old[2] = _some(old[2], content)
                else:
                    held[key] = [1, texts, content]
            if len(held) > 20_000:
                yield rows()
                held.clear()
        yield rows()

    parts = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(fold_pages, "host string, skeleton string, mark long, n_pages long, texts array<long>, contents array<long>")
    parts = parts.withColumn("fold", F.pmod("mark", F.lit(FOLDS[0])))

    def fold_skeletons(batches):
        yield from _fold_sorted(batches, lambda r: (r[0], r[6]), lambda r: number_texts(json.loads(r[1]), [(t,) if t is None else (t, r[5]) for t in r[4]]), lambda r: r[3])

    def fold_wrappers(batches):
        yield from _fold_sorted(batches, lambda r: (r[0], r[4]), lambda r: json.loads(r[3]), lambda r: r[2])

    out = "host string, fold long, n_pages long, wrapper string"
    folded = parts.repartition("host", "fold").sortWithinPartitions("host", "fold", "mark").mapInArrow(fold_skeletons, out)
    for folds in (*FOLDS[1:], 1):
        folded = folded.withColumn("next", F.pmod("fold", F.lit(folds)))
        folded = folded.repartition("host", "next").sortWithinPartitions("host", "next", "fold").mapInArrow(fold_wrappers, out)
    return folded.drop("fold")


def _fold_sorted(batches, key, wrapper, pages):
    import pyarrow as pa

    now, n, held, done = None, 0, None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key(row) != now:
                if now is not None:
                    done.append((*now, n, json.dumps(held, separators=(",", ":"))))
                now, n, held = key(row), 0, None
            new = wrapper(row)
            held = new if held is None else align(held, new)
            n += pages(row)
    if now is not None:
        done.append((*now, n, json.dumps(held, separators=(",", ":"))))
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["host", "fold", "n_pages", "wrapper"])


def template_marks(wrapper: list, n_pages: int, form: list, n_texts: int) -> list[int | None]:
    """For each text of a page's form the mark of the template text that the host's wrapper has at its place, or None.

    Template text is alike on every page that has its place, and on at least
    ``MIN_PAGES`` pages of different content; a wrapper without slots has none.
    """
    marks: list[int | None] = [None] * n_texts
    if n_pages < MIN_PAGES or None not in texts_of(wrapper):
        return marks

    def walk(own, held) -> None:
        for x, y in zip(own, held, strict=True):
            if isinstance(x, str):
                continue
            if x[0] != "T":
                walk(x[1], y[1])
            elif y[1] is not None and len(y[2]) >= MIN_PAGES:
                marks[x[1]] = y[1]

    own, held = _lift(number_texts(form, [(i,) for i in range(n_texts)]), wrapper), [_core(x) for x in wrapper]
    for i, j in _steps([_shape(x) for x in own], [_shape(x) for x in held]):
        if i is not None and j is not None:
            walk([own[i]], [held[j]])
    return marks


def named_blocks(page: Page, live) -> list[int]:
    """The numbers, out of ``live``, of the blocks that the markup's names leave."""
    rest = [i for i in live if not (page.blocks[i][2] or (page.blocks[i][3] and page.blocks[i][5]))]
    inside = [i for i in rest if page.blocks[i][1]]
    length = lambda own: sum(len(page.blocks[i][0]) for i in own)
    own = inside if inside and length(rest) <= (1 + OUTWEIGHS) * length(inside) else rest
    return own if own or page.has_article else [i for i in live if not page.blocks[i][4]]


def main_text(page: Page, places: list[int], marks: list[int | None]) -> str:
    """``places``: of each block its text in the form; ``marks``: of each text of the form, as from ``template_marks``."""
    live = [i for i, block in enumerate(page.blocks) if marks[places[i]] is None or _text_mark(block[0]) != marks[places[i]]]
    return "\n\n".join(page.blocks[i][0] for i in named_blocks(page, live))


def _with_wrappers(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``keyed`` (with host) with n_pages and wrapper."""
    found = found.select(F.col("host").alias("own_host"), "n_pages", "wrapper")
    step = F.floor(F.log2("n_pages")).cast("int")
    sizes = found.groupBy(step.alias("step")).agg(F.sum(F.octet_length("wrapper") + F.octet_length("own_host") + 64).alias("bytes")).collect()
    least, held = 64, 0
    for r in sorted(sizes, reverse=True):  # a row for each power of two
        held += r["bytes"]
        if held > BROADCAST_BYTES:
            break
        least = r["step"]
    hot = F.broadcast(found.filter(step >= least))
    on = F.col("host") == F.col("own_host")
    if held <= BROADCAST_BYTES:
        return keyed.join(hot, on, "left")
    return keyed.join(hot, on).unionByName(keyed.join(hot, on, "left_anti").join(found.filter(step < least), on, "left"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    found = materialise(wrappers(pages), "wrappers")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))
    keyed = _with_wrappers(pages.select("page_id", "url", "html", host.alias("host")), found)

    def run(batches):
        import pyarrow as pa

        wrapped: dict[str, list] = {}
        known: dict[tuple[str, str], list[int | None]] = {}
        memory: dict = {}
        for batch in batches:
            texts = []
            for page, name, n, wrapper in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                parsed = Page(page or "")
                skeleton, form, places = _page_form(parsed, memory)
                key = (name, skeleton)
                if key not in known:
                    if len(known) > 20_000:
                        known.clear()
                    if name not in wrapped:
                        if len(wrapped) > 1000:
                            wrapped.clear()
                        wrapped[name] = json.loads(wrapper) if wrapper else []
                    known[key] = template_marks(wrapped[name], n or 0, form, max(places, default=-1) + 1)
                texts.append(main_text(parsed, places, known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    keyed = keyed.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "host", "n_pages", "wrapper")
    return keyed.mapInArrow(run, "page_id long, url string, text string")
