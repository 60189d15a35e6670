"""HTML, chat, WARC, near-duplicates, FLAC: against brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from decisium.llm import chat, flac, graph, html_wrappers, near_dup, queries, warc
from decisium.runtime import table


def test_html_of_the_tables(spark, sf_dir):
    """Given pages: the article's heading and paragraphs, read by an independent rule."""
    import html

    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def page(body, extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{extra}{body}</body></html>"


def test_html_edges(spark):
    rows = [
        (1, None, None), (2, "http://h/1", ""), (3, "x", "plain &amp; text"), (4, "http://h/2", "<p>a<br>b <i>c</i>d<p>e&nbsp;f&#233;&am"), (5, "http://h/3", "<!-- c --><script>var t='</p>'</script><p>x"),
        (6, "http://h/4", page("<article><header><h1>T</h1></header><p>one</p><aside>no</aside><div class='comments'><p>no</p></div><form>no</form></article><footer>no</footer>")),
        (7, "http://h/5", page("<main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>", "<nav>no</nav><div id='cookie-banner'>no</div>")), (7, "http://h/5", "<p>again"),
        (8, "http://h/6", "<p>" + "long " * 50_000), (None, "http://h/7", "<p>unclosed <b>bold"),
    ]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "page_id long, url string, html string, host int, wrapper string")
    got = defaultdict(list)
    for r in html_wrappers.extract(df).collect():
        got[r["page_id"]].append(r["text"])
    assert got[1] == got[2] == [""]
    assert got[3] == ["plain & text"]
    assert got[4] == ["a b cd\n\ne fé&am"]
    assert got[5] == ["x"] and got[6] == ["T\n\none"]
    assert sorted(got[7]) == ["a\n\nb\n\nc\n\nd", "again"]
    assert len(got[8][0]) == 249_999 and got[None] == ["unclosed bold"]
    assert html_wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_find_template_text(spark):
    """Pages without an article: what is alike on all of a host's pages goes, what differs stays."""
    rng = random.Random(1)
    rows = []
    for i in range(12):
        paras = "".join(f"<p>story {i} part {k} {rng.random()}</p>" for k in range(i % 4 + 1))
        more = "<p>Only sometimes the same.</p>" if i % 3 == 0 else ""
        rows.append((i, f"https://site.example/{i}", page(f"<div><b>All about ships</b></div><div>{paras}</div><div>Write to us{more}</div>")))
    rows.append((99, "https://lonely.example/1", page("<div>All about ships</div><p>alone</p>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_wrappers.extract(df).collect():
        if r["page_id"] == 99:
            assert r["text"] == "All about ships\n\nalone"
        else:
            assert "All about ships" not in r["text"] and "Write to us" not in r["text"]
            assert len(re.findall("story", r["text"])) == r["page_id"] % 4 + 1
    found = {r["host"]: r for r in html_wrappers.wrappers(df).collect()}
    assert found["site.example"]["n_pages"] == 12 and '["+",["<p>",["T",null]]]' in found["site.example"]["wrapper"]


def test_text_at_places_that_few_pages_have_stays(spark):
    """One-off markup, copies of a page, and a text that is template elsewhere on the page."""
    once = {1: "<blockquote>A word of the captain.</blockquote>", 2: "<h2>Tides</h2>", 3: "<pre>x = 1</pre>", 4: "<ul><li>one item</ul>", 5: "<h3>All about ships</h3>"}
    once |= {k: "<h4>Copied</h4><p>copied story</p>" for k in range(20, 26)}
    menus = lambda i: f"<nav><a>m{i}</a></nav>"
    rows = [(i, f"https://site.example/{i}", page(f"<div>All about ships</div><div><p>story {i if i < 20 else 20}</p>{once.get(i, '')}</div><div>Write to us</div>", menus(i))) for i in range(26)]
    long = "".join(f"<p><b>x</b></p><h{k % 5 + 1}>t</h{k % 5 + 1}><section class=k{k}>part {k}</section>" for k in range(12))
    rows.append((50, "https://site.example/50", page(f"<div>All about ships</div><div>{long * 2}</div><div>Write to us</div>")))
    rows += [(60 + i, f"https://other.example/{i}", page(f"<div>Ship news</div><p>tale {i}</p>{'<blockquote>Only here.</blockquote>' if i == 3 else ''}")) for i in range(8)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[60 + i] for i in range(8)] == [[f"tale {i}", "Only here."] if i == 3 else [f"tale {i}"] for i in range(8)]
    for i, more in {0: [], 1: ["A word of the captain."], 2: ["Tides"], 3: ["x = 1"], 4: ["one item"], 5: ["All about ships"]}.items():
        assert got[i] == [f"story {i}", *more]
    assert all(got[i] == ["story 20", "Copied", "copied story"] for i in range(20, 26))
    assert [t for t in got[50] if t.startswith("part")] == [f"part {k}" for k in range(12)] * 2


def test_class_words_don_t_take_whole_texts(spark):
    story = "<h1>T</h1><p>one</p>"
    comments = "<div class=comments><article><p>no</p></article></div>"
    cases = [
        f"<body class='home has-sidebar'><div>{story}</div><div class=sidebar>no</div></body>", page(f"<article class='post has-comments'>{story}<div class=comments>no</div></article>"),
        page(f"<div id=page class='page-with-sidebar no-banner'>{story}</div>"), page(f"<div>{story}</div>{comments}"), page(f"<div>{story}</div><aside><article>no</article></aside><footer><article>no</article></footer>"),
        page(f"<div>{story}</div><article class=comment>no</article>"), page(f"<div class=search-page>{story}</div><nav>no</nav>"), page(f"<main class=search>{story}</main><form>no</form>"),
        page(f"<article></article><div>{story}</div>{comments}"),
    ]
    rows = [(i, f"http://h{i}/", x) for i, x in enumerate(cases)] + [(99, "http://h/", page(f"<article></article>{comments}"))]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "T\n\none" for i in range(len(cases))} | {99: ""}


def test_wrappers_decide_inside_articles(spark):
    """A line that all of a host's articles share goes, by its place; an article's copies don't make its text a template."""
    rows = [(i, f"https://a.example/{i}", page(f"<article><h1>story {i}</h1><div>Share this page</div><p>text {i}</p><p>Share this page</p></article>")) for i in range(6)]
    rows += [(10 + i, f"https://b.example/{i}", page("<article><h1>one story</h1><p>its text</p></article>", f"<nav><a>m{i}</a></nav>")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"story {i}\n\ntext {i}\n\nShare this page" for i in range(6)]
    assert {got[10 + i] for i in range(6)} == {"one story\n\nits text"}


def test_parts_of_class_names_within_articles(spark):
    """A subject's name isn't a menu, and a teaser isn't the article; what is all links, or a comment, goes."""
    body = "<p>" + "a long tale of the sea " * 9 + "</p>"
    want = ("a long tale of the sea " * 9).strip()
    cases = {
        f"<article><div class=entry-header><h1>T</h1></div>{body}</article>": f"T\n\n{want}", f"<article class='post ad-free'>{body}</article>": want,
        f"<article><section id=search-theory>{body}</section></article>": want, f"<article><p>Teaser.</p></article><div>{body}</div>": f"Teaser.\n\n{want}",
        f"<article>{body}<ul class=related-posts><li><a>one</a><li><a>two</a> </ul><div class=post-comments><p>no</p></div><div class=share>no</div></article>": want,
        f"<article><div class=header><h1>T</h1></div>{body}</article><div class=header>no</div>": f"T\n\n{want}",
        f"<article>{body}<p class=search-notes>see <a>here</a></p></article><p>short</p>": f"{want}\n\nsee here",
    }
    rows = [(i, f"http://h{i}/", page(x)) for i, x in enumerate(cases)]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_pages_without_their_article_marks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    want = {r["page_id"]: r["text"] for r in html_wrappers.extract(pages).collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    assert {r["page_id"]: r["text"] for r in html_wrappers.extract(bare).collect()} == want


def test_wrappers_match_their_pages(spark):
    """Every page of a host is in the language of the host's wrapper, page ids in class names and ids notwithstanding."""
    rng = random.Random(5)

    def made(depth=0):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(5)
            tag = rng.choice(("div", "section", "p", "ul"))
            if kind == 0 and depth < 3:
                parts.append(f"<{tag} class='c post-{rng.randrange(10**6)}' id=x{rng.randrange(10**6)}>{made(depth + 1)}</{tag}>")
            elif kind == 1:
                parts.append("".join(f"<li><a>{rng.random()}</a></li>" for _ in range(rng.randrange(1, 5))))
            else:
                parts.append(f"<{tag}>{rng.choice(('alike', str(rng.random())))}</{tag}>")
        return "".join(parts)

    top = [made() for _ in range(3)]
    pages = [page(rng.choice(top) + made()) for _ in range(40)]
    df = spark.createDataFrame([(f"http://h/{i}", x) for i, x in enumerate(pages)], "url string, html string").repartition(3)
    found = html_wrappers.wrappers(df).collect()
    assert [r["n_pages"] for r in found] == [40]
    code = html_wrappers.Alphabet()

    def regex(items):
        return "".join(re.escape(code.of(x)) if isinstance(x, str) else re.escape(code.of("T")) if x[0] == "T" else f"(?:{regex(x[1])}){x[0]}" for x in items)

    whole = re.compile(regex(json.loads(found[0]["wrapper"])), re.S)
    for x in pages:
        assert whole.fullmatch("".join(map(code.of, html_wrappers.Page(x).skeleton)))
    assert html_wrappers.item_of("div", " class='post post-12345' id=\"p7\"") == "<div post>"
    html_wrappers.collapse([f"<x{i}>" for i in range(html_wrappers.MOST_ITEMS + 500_000)])


def test_alignment_keeps_both_sides():
    a = ["<a>", ["T", 1], "</a>", "<b>", ["+", ["<p>", ["T", None]]], "</b>"]
    b = ["<a>", ["T", 2], "</a>", "<hr>", "<b>", "<p>", ["T", 5], "</b>"]
    assert html_wrappers.align(a, b) == ["<a>", ["T", None], "</a>", ["?", ["<hr>"]], "<b>", ["+", ["<p>", ["T", None]]], "</b>"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name]) == []


def foreign(kind, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:x>", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
    return gzip.compress(b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def test_archives_that_others_wrote(spark, tmp_path):
    """Records of other types, digests of other kinds or none, folded headers; a wrong digest is found."""
    base32 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hello</p>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    made = [
        foreign("warcinfo", b"software: x\r\n\r\nmore", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http;msgtype=request", WARC_Payload_Digest=base32(b"")),
        foreign("response", http, Content_Type="application/http; msgtype=response", WARC_Block_Digest=base32(http), WARC_Payload_Digest=base32(b"<p>hello</p>"), WARC_Target_URI="http://x/\r\n y"),
        foreign("response", chunked, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=base32(b"abc")),
        foreign("resource", b"plain", Content_Type="text/plain", WARC_Payload_Digest="md5:" + hashlib.md5(b"plain").hexdigest().upper(), WARC_Block_Digest="crc9:zz"),
        foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", Content_Type="application/http", WARC_Payload_Digest=base32(b"<p>hello</p>")),
    ]
    got = [(h["warc-type"], payload) for h, payload in warc.read_records([b"".join(made)])]
    assert got == [("warcinfo", b"software: x\r\n\r\nmore"), ("request", b""), ("response", b"<p>hello</p>"), ("response", chunked.split(b"\r\n\r\n", 1)[1]), ("resource", b"plain"), ("revisit", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(made))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")).collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == got and rows[2]["url"] == "http://x/ y" and rows[4]["payload_digest"] == hashlib.sha256(b"plain").hexdigest()
    for broken in (foreign("resource", b"plain", WARC_Payload_Digest=base32(b"other")), foreign("resource", b"plain", WARC_Block_Digest="md5:00"), gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n")):
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_records([broken]))


def test_revisits_beyond_the_broadcast(spark, monkeypatch):
    """Too many repeated payloads to send to every task: hot ones spread, short ones left alone, the same plan of revisits."""
    rows = [(i, f"http://h/{i}", f"{i % 40} " * 60 if i < 900 else "common " * 40 if i < 2000 else "short" if i < 2500 else None) for i in range(2600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    want = sorted(map(tuple, warc.plan_revisits(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, warc.plan_revisits(df).collect())) == want
    assert sum(r[3] is not None for r in want) == 2000 - 41


def test_chat_pairs(spark):
    turns = "pair_id long, turn long, role string, text string, a int, n int"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "user", "only"), (4, 0, "user", "<|im_end|>"), (4, 0, "assistant", "tie"), (None, 0, "user", "n")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", ""), (2, 1, "", "x"), (2, 2, "assistant", "y"), (4, 0, "user", "<|im_end|>"), (5, 0, "assistant", "r")]
    make = lambda rows: spark.createDataFrame([(*r, 1, 1) for r in rows], turns)
    got = {r["pair_id"]: r for r in chat.preference_pairs(make(chosen), make(rejected)).collect()}
    one = got[1]
    assert one["n_prompt_turns"] == 1 and one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    s = one["chosen_spans"][0]
    assert one["chosen"][s["start"] : s["stop"]] == "good<|im_end|>\n" and len(one["chosen_spans"]) == 1
    assert got[2]["chosen"] == "" and got[2]["n_prompt_turns"] == 2 and len(got[2]["rejected_spans"]) == 1
    assert got[3]["rejected"] == "" and got[3]["n_prompt_turns"] == 0
    assert got[4]["n_prompt_turns"] == 0 and got[4]["rejected"].count("<|im_end|>") == 1
    assert got[5]["prompt"] == got[5]["chosen"] == "" and None in got
    assert chat.preference_pairs(make([]), make([])).count() == 0


def brute_warc(rows):
    by = defaultdict(list)
    for i, _, h in rows:
        by[(h or "").encode()].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = min((x for x in by[p] if x is not None), default=None)
        refers = first if len(p) >= 100 and len(by[p]) > 1 and first is not None and first != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return Counter(out)


def test_shortened_pairs_on_odd_conversations(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, no answer, empty answers, and columns with the operator's own names."""
    rows = [
        (1, 1, "user", "hi <|x"), (1, 2, "assistant", "answer one"), (1, 3, "user", None), (1, 4, "assistant", "né 😀 odd"), (2, 1, "user", "alone"), (3, 1, "assistant", ""), (3, 1, "assistant", "tie"),
        (4, None, None, "x"), (4, 1, "assistant", "abcd"), (4, 1, "assistant", "abcd"), (None, 1, "assistant", "no id"), (5, 1, "assistant", ""), (6, 1, "assistant", "y"),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, "p", 4) for r in rows], "conv_id long, turn long, role string, text string, a int, b int, n int, p string, turns int").repartition(3)
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        conversations[c].append((-1 if t is None else t, role or "", text or ""))
    esc = lambda x: x.replace("<|", "<\\|")
    head, body = (lambda t: f"<|im_start|>{esc(t[1])}\n"), (lambda t: f"{esc(t[2])}<|im_end|>\n")
    want = {}
    for c, turns in conversations.items():
        turns.sort()
        cut = list(turns)
        for i in reversed(range(len(cut))):
            if cut[i][1] == "assistant":
                cut[i] = (*cut[i][:2], cut[i][2][: len(cut[i][2]) // 2])
                break
        k = next((i for i, (x, y) in enumerate(zip(turns, cut, strict=True)) if x != y), len(turns))

        def spans(own):
            at, out = 0, []
            for t in own:
                if t[1] == "assistant":
                    out.append((at + len(head(t)), at + len(head(t)) + len(body(t))))
                at += len(head(t)) + len(body(t))
            return out

        said = lambda own: "".join(head(t) + body(t) for t in own)
        want[c] = (k, said(turns[:k]), said(turns[k:]), spans(turns[k:]), said(cut[k:]), spans(cut[k:]))
    got = {r["conv_id"]: (r["n_prompt_turns"], r["prompt"], r["chosen"], [tuple(x) for x in r["chosen_spans"]], r["rejected"], [tuple(x) for x in r["rejected_spans"]]) for r in chat.shortened_pairs(df).collect()}
    assert got == want
    assert chat.shortened_pairs(df.limit(0)).count() == 0


def test_warc_round_trip(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    big = "é" * 200
    rows += [(1000, "u\r\nX: y", big), (1001, None, big), (999, "u", big), (1002, "u", None), (1003, "u", ""), (1004, "u", "short"), (1005, "u", "short"), (None, "u", big), (999, "u", big), (1006, "u", "x" * 3_000_000), (1007, "u", "a\r\n\r\nb" * 30)]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, refers_to int, digest string").repartition(3)
    manifest = warc.write_archives(warc.plan_revisits(df), archive_bytes=15_000)
    assert manifest.count() > 3
    got = warc.resolved(warc.read_archives(manifest))
    assert Counter(map(tuple, got.collect())) == brute_warc(rows)
    assert warc.resolved(warc.read_archives(warc.write_archives(warc.plan_revisits(df.limit(0))))).count() == 0


def test_warc_reader():
    records = [warc.make_record(i, f"http://x/{i}", bytes([i]) * i * 1000, 0 if i == 3 else None) for i in range(6)]
    data = b"".join(records)
    for step in (1, 7, 1000, len(data)):
        found = list(warc.read_records(data[i : i + step] for i in range(0, len(data), step)))
        assert [len(p) for _, p in found] == [0, 1000, 2000, 0, 4000, 5000]
        assert found[3][0]["warc-type"] == "revisit"
    assert gzip.decompress(records[1]).startswith(b"WARC/1.1\r\n")
    with pytest.raises(warc.BrokenArchive):
        list(warc.read_records([data[:-5]]))
    spoilt = gzip.compress(gzip.decompress(records[2]).replace(b"\x02\x02", b"\x02\x03", 1))
    with pytest.raises(warc.BrokenArchive, match="digest"):
        list(warc.read_records([spoilt]))
    with pytest.raises(warc.BrokenArchive):
        list(warc.read_records([gzip.compress(gzip.decompress(records[2])[:-3])]))


def brute_near(rows, k, num, den):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(list)
    for i in sorted(sets):
        both = Counter(j for g in sets[i] for j in index[g])
        for g in sets[i]:
            index[g].append(i)
        for j, n in both.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def near_rows():
    """A large group of drifting near copies, exact copies, short texts and blanks."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c"), (7, "A  B\tc")]
    base = [word() for _ in range(150)]
    for i in range(120):
        if i % 10 == 0 and i:
            base = [*base]
            base[rng.randrange(150)] = word()
        own = [*base]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(150)] = word()
        rows.append((100 + i, " ".join(own)))
    rows += [(300 + i, rows[20][1].upper()) for i in range(40)]
    shared = " ".join(word() for _ in range(60))
    rows += [(400 + i, shared + " " + " ".join(word() for _ in range(60))) for i in range(60)]
    rows += [(500, "z " * 40_000), (501, "z " * 40_001)]
    return rows


@pytest.mark.parametrize("k,num,group", [(3, 85, 1024), (3, 85, 30), (5, 80, 1024)])
def test_near_duplicates(spark, k, num, group):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1, 1, "b") for r in rows] + [(None, "one", 1, 1, "b")], "doc_id long, text string, key int, hub int, bands string").repartition(5)
    want = brute_near(rows, k, num, 100) | {None: (1, None, True)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df, k, num, 100, group=group).collect()}
    assert got == want


def test_near_duplicates_keep_one_of_each(spark):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone_id int")
    kept = near_dup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in brute_near(rows, 5, 80, 100).items() if v[2])
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(8)
    for share in (0.3, 0.6, 0.9):
        a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 2000 - n).astype(np.uint64)])
        same = (near_dup.signature(np.unique(a)) == near_dup.signature(np.unique(b))).mean()
        assert abs(same - share) < 0.12
    bands, rows = near_dup.bands_for(0.85)
    assert bands * rows <= near_dup.COORDINATES and (1 - 0.85**rows) ** bands <= near_dup.MISS


def test_large_group_of_near_copies(spark):
    """Thousands of near copies of one text, of drifting ones and of one that only looks alike, in blocks of forty."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(2500):
        own = [*base]
        own[rng.randrange(120)] = word()
        rows.append((i, " ".join(own)))
    for i in range(300):  # each like the one before
        base[i % 120] = word()
        rows.append((5000 + i, " ".join(base)))
    rows += [(9000 + i, " ".join([*base[:60], *(word() for _ in range(40))])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, 3, 85, 100, group=40).collect()}
    assert all(got[i] == 0 for i in range(2500)) and all(got[9000 + i] == 9000 + i for i in range(30))
    want = brute_near(rows[2400:], 3, 85, 100)
    assert all(got[i] == (0 if want[i][1] == 2400 else want[i][1]) for i in range(5000, 5300))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    up = {i: i for e in edges for i in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if root(i) != i}


def decode_all(streams):
    out = [[] for _ in streams]
    for s, block, sample, place, x in flac.decode_blocks(streams):
        assert sample == sum(len(y) for y in out[s]) and place >= 42
        out[s].append(x)
    return [np.concatenate(x) if x else np.zeros(0, int) for x in out]


def test_flac_round_trip():
    rng = random.Random(2)
    payloads = [b"\0" * 64, bytes(range(256)) * 9, rng.randbytes(5000), b"The quick brown fox. " * 700, b"a" * 3000, bytes([127, 128]) * 2000, b"x"]
    payloads += [rng.randbytes(rng.randrange(1, 3000)) for _ in range(30)] + [bytes(int(128 + 60 * np.sin(i / 9)) for i in range(20_000))]
    streams = flac.encode_many(payloads)
    for p, x in zip(payloads, decode_all(streams), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p
    assert len(streams[-1]) < 0.8 * len(payloads[-1])
    without_seek = [b"fLaC" + bytes([0x80]) + s[5:42] + s[42 + 4 + int.from_bytes(s[43:46], "big") :] for s in streams]
    for p, x in zip(payloads, decode_all(without_seek), strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p


class Bits:
    def __init__(self):
        self.b = []

    def put(self, value, n):
        self.b += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.b += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        return np.packbits(self.b + [0] * (-len(self.b) % 8)).tobytes()


def frame(number, x, body):
    head = b"\xff\xf8\x70\x02" + flac._coded_number(number) + (len(x) - 1).to_bytes(2, "big")
    crc = 0
    for b in head:
        crc = int(flac._CRC8[crc ^ b])
    data = head + bytes([crc]) + body
    crc = 0
    for b in data:
        crc = (crc << 8 & 0xFFFF) ^ int(flac._CRC16[crc >> 8 ^ b])
    return data + crc.to_bytes(2, "big")


def predicted(x, kind, order, coefs, shift, precision, ks, partitions, wide=False, escape=None, wasted=0):
    """A subframe written bit by bit: any predictor, partitions, parameter widths, an escaped partition, wasted bits."""
    w = Bits()
    w.put(kind << 1 | (wasted > 0), 8)
    if wasted:
        w.put(1, wasted)
    x = [v >> wasted for v in x]
    for v in x[:order]:
        w.put(v & ((1 << (8 - wasted)) - 1), 8 - wasted)
    if kind >= 32:
        w.put(precision - 1, 4)
        w.put(shift & 31, 5)
        for c in coefs:
            w.put(c & ((1 << precision) - 1), precision)
    w.put(int(wide), 2)
    w.put(partitions, 4)
    size = len(x) >> partitions
    for p in range(1 << partitions):
        if escape == p:
            w.put(31 if wide else 15, 5 if wide else 4)
            w.put(12, 5)
        else:
            w.put(ks[p], 5 if wide else 4)
        for i in range(max(order, p * size), (p + 1) * size):
            r = x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift)
            if escape == p:
                w.put(r & 4095, 12)
            else:
                w.rice(r, ks[p])
    return w.bytes()


def test_flac_predictors_that_the_encoder_doesn_t_write():
    rng = random.Random(4)
    wave = [int(40 * np.sin(i / 5) + rng.randrange(-3, 4)) for i in range(64)]
    even = [2 * (v // 4) for v in wave]
    frames, want = [], []
    cases = [
        (wave, 8 + 3, 3, (3, -3, 1), 0, 0, [4, 4], 1, False, None, 0),
        (wave, 8 + 4, 4, (4, -6, 4, -1), 0, 0, [5] * 4, 2, True, None, 0),
        (wave, 32 + 1, 2, (15, -8), 3, 6, [3, 6], 1, False, None, 0),
        (wave, 32 + 7, 8, (5, 3, 2, -1, 0, 1, -2, 1), 3, 5, [4, 4], 1, False, 1, 0),
        (wave, 8 + 0, 0, (), 0, 0, [5], 0, True, 0, 0),
        (even, 8 + 1, 1, (1,), 0, 0, [3], 0, False, None, 1),
        (wave[:16], 8 + 2, 2, (2, -1), 0, 0, [4], 0, False, None, 0),
    ]
    for n, (x, *rest) in enumerate(cases):
        frames.append(frame(n, x, predicted(x, *rest)))
        want += x
    samples = np.array(want, np.int8).tobytes()
    head = flac._stream_head(len(want), 64, hashlib.md5(samples).digest(), [], np.array([len(f) for f in frames]))
    assert decode_all([head + b"".join(frames)])[0].tolist() == want


def test_flac_damage_is_found():
    stream = flac.encode_many([b"some text to store " * 200])[0]
    for at in (60, 200, len(stream) - 1):
        spoilt = bytearray(stream)
        spoilt[at] ^= 4
        with pytest.raises(flac.BrokenStream):
            decode_all([bytes(spoilt)])
    with pytest.raises(flac.BrokenStream):
        decode_all([stream[:-40]])
    with pytest.raises(flac.BrokenStream):
        decode_all([b"RIFF" + stream[4:]])


def test_flac_columns(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "x" * 64), (9003, "é" * 40_000), (None, "q"), (9004, "q"), (9004, "q")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, media int, n_bytes int").repartition(3)
    media = flac.encode_column(df)
    got = defaultdict(list)
    for r in flac.digests(media).collect():
        got[r["doc_id"]].append(r)
    for key, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        for r in got[key]:
            assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
            assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert got[None][0]["media_sha256"] == got[9004][0]["media_sha256"] and got[9004][0] == got[9004][1]
    blocks = flac.pcm_blocks(media.filter("doc_id = 9003")).orderBy("block").collect()
    assert b"".join(b["pcm"] for b in blocks) == ("é" * 40_000).encode()
    assert all(b["sample_offset"] == 1024 * b["block"] for b in blocks)
    stream = media.filter("doc_id = 9003").first()["media"]
    assert all(stream[b["byte_offset"] : b["byte_offset"] + 2] == b"\xff\xf8" for b in blocks)
    assert flac.digests(flac.encode_column(df.limit(0))).count() == 0
