"""Pages, WARC records and tool calls."""

import base64
import gzip
import hashlib
import json
import random
import time

import pytest

from shoebox.llm import html_text, tool_calls, warc

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="menu"><ul><li><a href=x>A</a><li><a href="y">B</a></ul></div><div id="cookie-notice">We use cookies to make this site work well for you and us, all of the time.</div>
<article><h2>My   title</h2><p>First para &amp; more text that is long enough to be dense, with words and words.<p>Second   one
with <a href=y>a link</a> inside<b> and bold</b> text that goes on. <br>Line<!-- no --></article>
<aside>Side text that is long and dense as well, really quite so, and goes on</aside><div class="sidebar">more side bar text</div>
<section id="comments"><article class="comment"><p>Reader says things that are long and dense, longer than all of the rest of the page taken together and so on and on.</p></article></section>
<form><label>Name</label><input></form><script>var a="<p>x</p>"</script><div class="ad">Buy it</div><footer>&copy; me</footer></body></html>"""
TEXT = "My title\nFirst para & more text that is long enough to be dense, with words and words.\nSecond one with a link inside and bold text that goes on. Line"


def test_main_text():
    assert html_text.main_text(PAGE) == TEXT
    assert html_text.main_text(PAGE.replace("article", "div").replace('<div class="comment">', "<div class='reply'>")) == TEXT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<p>x &lt;b&gt; &#233; &nbsp; y</p>", "x <b> é y"), ("<div><p>un<b>closed", "unclosed"),
        ("<p>a</p></div></p><p>b</p>", "a\nb"), ("<nav>menu</nav>", ""), ("<script>x</script>", ""), ("<!-- only", ""), ("<article><p>1</p></article><article><p>22</p></article>", "1\n22"), ("<p hidden>no</p><p>yes</p>", "yes"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_small_pages(page, want):
    assert html_text.main_text(page) == want


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(html_text.main_text("<p>" + "word " * 100_000 + "</p>")) == 499_999


def paragraphs(name, n, size):
    return [f"{name} {k} ".ljust(size, "x") for k in range(n)]


@pytest.mark.parametrize("page", ["<html><body>{}</body></html>", "{}", "<body><div>{}</div></body>", "<body><div><div>{}</div></div></body>"])
@pytest.mark.parametrize("kind", ["div", "section", "td"])
def test_dense_siblings_of_the_densest_container(page, kind):
    parts = [paragraphs(name, n, 300) for name, n in (("one", 5), ("two", 5), ("three", 7), ("four", 5))]
    inner = "".join(f"<{kind}>" + "".join(f"<p>{p}</p>" for p in part) + f"</{kind}>" for part in parts)
    links = "<div>" + "".join(f"<p><a href=x>link {k}</a></p>" for k in range(9)) + "</div>"
    got = html_text.main_text(page.format(links + inner + "<div class='sidebar'><p>" + "no " * 200 + "</p></div>" + links))
    assert got == "\n".join(p for part in parts for p in part)


def test_dense_loose_text_and_nested_parts():
    main, other, loose = paragraphs("main", 6, 300), paragraphs("other", 4, 300), "loose " * 60
    page = f"<body><div><div><p>{'</p><p>'.join(other)}</p></div><a href=x>more</a><a href=y>links</a></div>{loose}<b>bold</b><div><p>{'</p><p>'.join(main)}</p></div><div><a href=z>Contact</a></div></body>"
    assert html_text.main_text(page) == "\n".join([*other, loose + "bold", *main])


@pytest.mark.parametrize("tag", ["svg", "math", "object", "video", "select", "iframe", "canvas", "audio"])
def test_elements_without_an_end_take_no_text(tag):
    got = lambda inner: html_text.main_text(f"<article><p>a</p>{inner}</article>")
    assert got(f"<{tag} x='1'/><p>b</p><{tag}>no</{tag}><p>c</p>") == "a\nb\nc"
    assert got(f"<{tag} x='1'><p>b</p><{tag}>no</{tag}><p>c</p>") == "a\nb\nc"
    assert got(f"<{tag}><p>b</p><!-- </{tag}> --><script>'</{tag}>'</script><p>c</p>") == "a\nb\nc"
    assert got(f"<{tag}>no <{tag}>no</{tag}> no</{tag}><p>b</p>") == "a\nb"
    assert got(f"<{tag} src=http://x/>no</{tag.upper()} ><p>b</p>") == "a\nb"
    assert got("<p>b</p><script>no") == "a\nb"


def test_link_lists_inside_an_article_stay():
    links = "".join(f"<li><a href=x>source {k}</a>" for k in range(5))
    menu = "".join(f"<li><a href=x>page {k}</a>" for k in range(5))
    page = f"<body><ul>{menu}</ul><article><p>text</p><ul>{links}</ul><ul class=related>{menu}</ul><nav><ul>{menu}</ul></nav></article><ul>{menu}</ul></body>"
    assert html_text.main_text(page) == "\n".join(["text", *(f"source {k}" for k in range(5))])


def nested(r, depth=0):
    """A random part of an article, as markup and as its blocks; noise between the parts."""
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n)) + "."
    markup, want = "", []
    for _ in range(r.randrange(1, 5)):
        kind = r.choice(["p", "p", "short", "h2", "list", "box", "box", "noise", "sources"])
        if kind == "box" and depth < 4:
            inner, more = nested(r, depth + 1)
            tag = r.choice(["div", "section", "blockquote"])
            markup, want = markup + f"<{tag}>{inner}</{tag}>", want + more
        elif kind == "noise":
            markup += r.choice(["<nav><a href=x>n</a></nav>", "<div class='ad-box'>buy buy</div>", "<script>var x='<p>no</p>'</script>", "<aside>side text</aside>", "<form><p>Name</p></form>", "<div id=share-bar>share</div>"])
        elif kind == "list":
            items = [words(3) for _ in range(3)]
            markup, want = markup + "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", want + items
        elif kind == "sources" and want:  # behind text
            items = [f"source {k}" for k in range(4)]
            markup, want = markup + "<ul>" + "".join(f"<li><a href=x>{x}</a></li>" for x in items) + "</ul>", want + items
        else:
            tag, text = {"h2": ("h2", words(2))}.get(kind, ("p", words(3 if kind == "short" else 40)))
            markup, want = markup + f"<{tag}>{text}</{tag}>", want + [text]
    return markup, want


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_every_block_of_a_random_article_stays(tag):
    r = random.Random(tag)
    for _ in range(150):
        inner, want = nested(r)
        long = [" ".join(["long"] * 60) + str(k) for k in range(3)]
        head, tail = "<h1>Title</h1>", "".join(f"<p>{x}</p>" for x in long)
        menu = "<ul>" + "".join(f"<li><a href=x>page {k}</a></li>" for k in range(6)) + "</ul>"
        article = f"<{tag}>{head}{inner}<section>{tail}</section></{tag}>" if r.random() < 0.5 else f"<{tag}>{head}<div>{tail}</div>{inner}</{tag}>"
        want = ["Title", *want, *long] if article.endswith(f"</section></{tag}>") and f"</h1><div><p>{long[0]}" not in article else ["Title", *long, *want]
        page = f"<body><div class=navbar>{menu}</div><div>{menu}</div>{article}<div>{menu}</div><div class=comments><p>reader {long[0]}</p></div><footer>foot</footer></body>"
        assert html_text.main_text(page).split("\n") == want
        wrapped = f"<body><div><div>{menu}</div><div>{article}</div></div></body>"
        assert html_text.main_text(wrapped).split("\n") == want


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows) == [(1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", PAGE, 0), (2, None, None, 0), (3, "http://b", "", 0)], "page_id long, url string, html string, block int")
    rows = warc.derivatives(pages, with_source=True).collect()
    assert len(rows) == 9
    data = b"".join(warc.serialise(r["headers"], r["block"]) for r in rows)
    back = list(warc.read_records(data))
    assert len(back) == 9
    ids = {h["WARC-Record-ID"] for h, _ in back}
    assert len(ids) == 9
    for (head, block), r in zip(back, rows, strict=True):
        assert block.decode() == r["block"] and int(head["Content-Length"]) == len(block) == r["content_length"]
        assert head["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if head["WARC-Type"] != "resource":
            assert head["WARC-Refers-To"] in ids
        assert "X" not in head
    page = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "resource")
    assert page["block"] == PAGE and page["payload_digest"] == warc.digest(PAGE.encode())
    text = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert TEXT.split("\n")[0] in text["block"] and "var a" not in text["block"] and text["source_digest"] == page["payload_digest"]
    meta = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert "title: T & t\r\n" in meta["block"] and "outlink: y L a/@href\r\n" in meta["block"]
    again = warc.derivatives(pages).collect()
    assert {r["record_id"] for r in again} <= {r["record_id"] for r in rows} and len(again) == 6
    assert warc.derivatives(pages.limit(0)).count() == 0


def response(rid, uri, body, *fields, status="200 OK"):
    block = f"HTTP/1.1 {status}\r\n".encode() + b"".join(f"{f}\r\n".encode() for f in fields) + b"\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-02-0{rid}T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_responses_keep_their_heads(spark, tmp_path):
    page = "<html lang=nl><title>é</title><p>één <a href='/x'>twee</a>".encode("latin-1")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    chunked = b"".join(f"{len(c):x}\r\n".encode() + c + b"\r\n" for c in (b"<p>a", b"b</p>")) + b"0\r\n\r\n"
    members = [
        info, response(1, "http://a/", page, "Content-Type: text/html; charset=iso-8859-1", "Server: s", "Server: t"), response(2, "http://b/", gzip.compress(b"<p>packed"), "Content-Encoding: gzip", status="404 Not Found"),
        response(3, "http://c/", b"\x89PNG", "Content-Type: image/png"), response(4, "http://d/", chunked, "Transfer-Encoding: chunked"), response(5, "http://e/", b"a < b", "Content-Type: text/plain"), response(6, "http://f/", b""),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    (tmp_path / "in" / "2.warc").write_bytes(b"".join(members)[:-30])  # the last record is cut off
    (tmp_path / "in" / "3.warc.gz").write_bytes(b"\x1f\x8bbroken")
    (tmp_path / "in" / "4.warc").write_bytes(b"")
    captured = warc.read(spark, str(tmp_path / "in"))
    assert captured.count() == 13
    rows = warc.response_derivatives(captured.where("path like '%1.warc.gz'")).collect()
    got = {(r["target_uri"], r["record_type"]): r for r in rows}
    assert len(rows) == len(got) == 11 and ("http://c/", "conversion") not in got
    a = got["http://a/", "metadata"]
    assert a["refers_to"] == "<urn:uuid:1>" and "WARC-Date: 2020-02-01T00:00:00Z" in a["headers"] and a["source_digest"] == warc.digest(page)
    assert "sourceStatus: 200\r\nsourceHeader: Content-Type: text/html; charset=iso-8859-1\r\nsourceHeader: Server: s\r\nsourceHeader: Server: t\r\ntitle: é\r\nlanguage: nl\r\noutlink: /x L a/@href\r\n" in a["block"]
    assert "sourceStatus: 404" in got["http://b/", "metadata"]["block"]
    assert {u: got[f"http://{u}/", "conversion"]["block"] for u in "abdef"} == {"a": "één twee", "b": "packed", "d": "ab", "e": "a < b", "f": ""}
    # and out to files and back
    warc.write_files(warc.response_derivatives(captured), str(tmp_path / "out"))
    back = warc.read(spark, str(tmp_path / "out")).collect()
    assert sorted((r["record_id"], bytes(r["block"])) for r in back) == sorted((r["record_id"], r["block"].encode()) for r in warc.response_derivatives(captured).collect())
    assert warc.response_derivatives(captured.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    warc.write_files(warc.derivatives(pages, with_source=True), str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    assert back.count() == 6 and back.where("record_type = 'resource' and target_uri = 'u'").first()["block"] == PAGE.encode()


BROKEN = {
    "tags": "<a " * 330_000, "quotes": "<a b='" * 170_000, "quoted ends": "<a b='>' " * 110_000, "stray ends": "<b>" * 60_000 + "</i>" * 60_000, "titles": "<title>" * 140_000, "comments": "<!-- " * 200_000,
    "raw": "<svg>" * 100_000, "lists": "<li><ul>" + "<b>" * 50_000 + "<hr>" * 50_000, "links": "<a href" * 140_000, "values": "<a href=" + " " * 900_000, "paragraphs": "<p><b>" * 50_000,
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_pages_take_linear_time(name):
    start = time.perf_counter()
    html_text.main_text(BROKEN[name])
    warc.records(1, "u", BROKEN[name])
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("tag", ["article", "main", "div", "section", "td", ""])
def test_the_article_needs_no_name(tag):
    inner = "<h2>A title</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs("long", 6, 200)) + "<p>Short one.</p><ul><li>an item<li>another</ul>"
    text = "\n".join(["A title", *paragraphs("long", 6, 200), "Short one.", "an item", "another"])
    block = f"<{tag}>{inner}</{tag}>" if tag else inner
    teasers = "<div>" + "".join(f"<div><a href=x>teaser number {k} of the site</a></div>" for k in range(8)) + "</div>"
    got = html_text.main_text(f"<html><body>{teasers}{block}{teasers}<div>All rights <a href=z>reserved</a></div></body></html>")
    assert got == text


def test_names_do_not_choose_the_article():
    """An article element of links loses to the dense part beside it."""
    dense = paragraphs("dense", 5, 300)
    links = "".join(f"<p><a href=x>link {k}</a></p>" for k in range(9))
    page = f"<body><article>{links}</article><div>{''.join(f'<p>{p}</p>' for p in dense)}</div></body>"
    assert html_text.main_text(page) == "\n".join(dense)


SCHEMAS = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "text", "string", True), ("say", "opts", "object", False), ("say", "tags", "array", False), ("say", "loud", "boolean", False)]


def run(spark, calls, results):
    c, r = spark.createDataFrame(calls, tool_calls.CALLS), spark.createDataFrame(results, tool_calls.RESULTS)
    return {(x["conv_id"], x["call_id"]): x for x in tool_calls.linked(c, r, spark.createDataFrame(SCHEMAS, tool_calls.SCHEMAS)).collect()}


def test_calls_link_validate_and_serialise(spark):
    calls = [
        (1, 0, "c1", "add", '{"b": 2.50, "a": 1}', []), (1, 2, "c2", "say", '{"text":"h\\u00e9 \\"q\\"","opts":{"z":1,"a":[1,2]},"tags":[],"loud":true}', ["c1"]), (1, 3, "c3", "add", '{"a": "1", "x": 0}', None),
        (1, 4, "c4", "nope", "{}", []), (1, 5, "c5", "say", "[1]", []), (1, 6, "c6", "say", "not json", []), (2, 0, "c1", "add", None, []), (2, 1, None, "say", "{}", []),
    ]
    results = [(1, 1, "c1", "3"), (1, 9, "c1", "later"), (1, 3, "c2", None), (1, 7, "lost", "x"), (2, 5, None, "y")]
    got = run(spark, calls, results)
    a = got[1, "c1"]
    assert a["status"] == "linked" and a["valid"] and json.loads(a["record"]) == {"arguments": {"a": 1, "b": 2.5}, "id": "c1", "name": "add", "result": "3"}
    assert a["record"].startswith('{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add"')
    b = got[1, "c2"]
    assert b["valid"] and json.loads(b["record"])["arguments"] == {"text": 'hé "q"', "opts": {"a": [1, 2], "z": 1}, "tags": [], "loud": True}
    assert '{"loud":true,"opts":{"a":[1,2],"z":1},"tags":[],"text":' in b["record"] and b["status"] == "linked"
    assert got[1, "c3"]["problems"] == "unknown argument x; wrong type of a" and got[1, "c3"]["status"] == "unanswered"
    assert got[1, "c4"]["problems"] == "unknown tool"
    assert got[1, "c5"]["problems"] == got[1, "c6"]["problems"] == got[2, "c1"]["problems"] == "arguments are no object"
    assert json.loads(got[1, "c6"]["record"])["arguments"] == "not json" and json.loads(got[2, "c1"]["record"])["arguments"] is None
    assert got[1, "lost"]["status"] == "orphan" and len([k for k in got if k[0] == 2]) >= 2


def test_repeated_schemas_and_calls(spark):
    c = spark.createDataFrame([(1, 0, "c", "add", '{"a":1}', [])] * 2 + [(1, 1, "c", "add", '{"a":2,"z":0}', ["c"])], tool_calls.CALLS)
    schemas = spark.createDataFrame([("add", "a", "integer", True), ("add", "a", "integer", None), ("add", "a", "string", False), ("add", "z", None, None), (None, "x", "string", True), ("add", None, "string", True)], tool_calls.SCHEMAS)
    got = sorted((r["turn"], r["topo_order"], r["problems"]) for r in tool_calls.linked(c, spark.createDataFrame([], tool_calls.RESULTS), schemas).collect())
    # a call that needs its own identifier, in whatever turn, needs itself
    assert [(t, p) for t, _, p in got] == [(0, ""), (0, ""), (1, "unknown argument z")]
    assert tool_calls.linked(c.limit(0), spark.createDataFrame([], tool_calls.RESULTS), schemas.limit(0)).count() == 0


def test_order_is_topological(spark):
    calls = [(1, t, f"c{t}", "say", "{}", [f"c{p}" for p in after]) for t, after in ((0, [4]), (1, []), (2, [0, 1]), (3, [2]), (4, [1]), (5, [6]), (6, [5]), (7, [6, 1]), (8, [99]))]
    calls += [(2, t, f"c{t}", "say", "{}", [f"c{t - 1}"]) for t in range(5)]
    got = run(spark, calls, [])
    order = {k: x["topo_order"] for k, x in got.items()}
    for conv, t, name, _, _, after in calls:
        for p in after:
            if (conv, p) in order and order[conv, p] is not None and order[conv, name] is not None:
                assert order[conv, p] < order[conv, name]
    assert [order[1, f"c{k}"] for k in (5, 6, 7)] == [None] * 3 and order[1, "c1"] == 0 and order[1, "c8"] == 1
    assert sorted(order[1, f"c{k}"] for k in (0, 1, 2, 3, 4, 8)) == list(range(6))
    assert all(order[1, f"c{k}"] is not None for k in range(5)) and [order[2, f"c{k}"] for k in range(5)] == [0, 1, 2, 3, 4]


def test_levels_of_random_dependencies(spark):
    r = random.Random(21)
    for n, chains in ((12, False), (40, True), (40, False)):
        calls, level = [], {}
        for conv in range(4):
            names = [f"c{k}" for k in range(n)]
            place = r.sample(range(n), n)  # the order that holds; a call on a cycle breaks it
            need = {x: [] for x in names}
            for k, x in enumerate(names):
                below = [y for m, y in enumerate(names) if place[m] < place[k]]
                if below:
                    need[x] = [max(below, key=lambda y: place[names.index(y)])] if chains and r.random() < 0.8 else r.sample(below, min(len(below), r.randrange(3)))
            if conv == 3:
                a, b = r.sample(names, 2)
                need[a].append(b)
                need[b].append(a)
            calls += [(conv, t, x, "say", "{}", need[x]) for t, x in enumerate(names)]
            got, open_ = {}, dict(need)
            while ready := [x for x in open_ if all(y in got for y in open_[x])]:
                got |= {x: max((got[y] + 1 for y in need[x]), default=0) for x in ready}
                open_ = {x: y for x, y in open_.items() if x not in got}
            level |= {(conv, x): v for x, v in got.items()}
        d = spark.createDataFrame(calls, tool_calls.CALLS)
        found = tool_calls.levels(d.select("conv_id", "call_id"), d.selectExpr("conv_id", "call_id", "explode(after) needed"))
        assert {(x.conv_id, x.call_id): x.level for x in found.collect()} == level
        order = {(x.conv_id, x.call_id): x.topo_order for x in tool_calls.ordered(d).collect()}
        for conv, _, x, _, _, after in calls:
            assert (order[conv, x] is None) == ((conv, x) not in level)
            assert all(order[conv, x] is None or order[conv, y] < order[conv, x] for y in after)


def test_a_long_chain_takes_few_rounds(spark):
    n = 20_000
    d = spark.range(n).selectExpr("1L as conv_id", "id as turn", "concat('c', id) as call_id", "'say' as name", "'{}' as arguments", "array(concat('c', id + 1)) as after")
    begin = time.perf_counter()
    rows = {x.turn: x.topo_order for x in tool_calls.ordered(d).select("turn", "topo_order").collect()}
    assert rows == {k: n - 1 - k for k in range(n)} and time.perf_counter() - begin < 240


def test_chats(spark):
    chat = spark.createDataFrame([(1, 0, "system", "s", 1), (1, 1, "user", 'a "b"\n', 1), (1, 2, "assistant", "c", 1), (1, 3, "user", None, 1), (2, 0, "assistant", "lone", 1)], "conv_id long, turn long, role string, text string, call_id int")
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.linked(*tool_calls.from_chat(chat)).collect()}
    assert got[1, 1]["status"] == "linked" and json.loads(got[1, 1]["record"]) == {"arguments": {"prompt": 'a "b"\n', "turn": 1}, "id": "1:1", "name": "reply", "result": "c"}
    assert got[1, 0]["status"] == "unanswered" and got[2, 0]["status"] == "orphan" and got[1, 3]["problems"] == "wrong type of prompt"
    assert tool_calls.linked(*tool_calls.from_chat(chat.limit(0))).count() == 0


def test_main_path_is_native(spark, capsys):
    chat = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    tool_calls.linked(*tool_calls.from_chat(chat)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
