"""Operators on pages, embeddings and conversations: hard rows, brute force, round trips."""

import base64
import gzip
import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from pathweave.llm import chat, graph, html_paths, queries, range_join, warc

# -- embeddings


def brute_vectors(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding, label) rows."""
    def sound(r):
        return (r[0] is not None and r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]))

    links = defaultdict(set)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if sound(a) and sound(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[i].add(j)
                    links[j].add(i)
    root = [r[0] for r in rows]
    for _ in rows:
        for i in links:
            root[i] = min([root[i], *[root[j] for j in links[i]]])
    return Counter((r[0], len(links[i]), root[i], r[0] == root[i]) for i, r in enumerate(rows))


def near_groups(rng, n, dims, label):
    rows = []
    for _ in range(n):
        base = rng.normal(size=dims)
        for _ in range(rng.integers(1, 9)):
            rows.append((base + rng.normal(size=dims) * rng.choice([0, 0.05, 0.12, 0.2]), label))
    return rows


@pytest.mark.parametrize(("classes_a_pivot", "block"), [(4096, 1024), (8, 4)])
def test_near_vectors_by_brute_force(spark, classes_a_pivot, block):
    rng = np.random.default_rng(3)
    made = [*near_groups(rng, 25, 6, 1), *near_groups(rng, 20, 6, 2), *near_groups(rng, 5, 3, 1)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(made)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 6, 1), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (904, [float("nan")] * 6, 1),
             (905, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1), (906, rows[0][1], None), (None, rows[0][1], 1), rows[3], (907, [x * 8 for x in rows[5][1]], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns(
        {c: F.lit("clash") for c in ("rep", "cell", "n_links", "block", "dims", "fit")}).repartition(4)
    stored = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    got = range_join.near_vectors(table, classes_a_pivot=classes_a_pivot, block=block).collect()
    want = brute_vectors(stored)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(x[:3] for x in want.elements())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert range_join.near_vectors(empty).collect() == []
    one = spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int")
    assert [tuple(r) for r in range_join.near_vectors(one).collect()] == [(1, 0, 1, True)]


def test_cells_lose_no_pair():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    x = np.vstack([x, x + rng.normal(size=x.shape) * 0.1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own, copied = range_join.cells_of(x, x[:40], range_join.distances(x[:40]), 0.2)
    there = copied.copy()
    there[np.arange(len(x)), own] = True
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True):
        assert there[i, min(own[i], own[j])] and there[j, min(own[i], own[j])]


def test_components_do_not_pass_through_the_driver(spark):
    path = random.Random(5).sample(range(24), 24)  # takes several rounds
    found = graph.connected_components(spark.createDataFrame([*zip(path, path[1:])], "a bigint, b bigint"))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(24)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_size_guess_of_components_does_not_double_with_each_step(spark):
    path = random.Random(5).sample(range(300), 300)
    found = graph.connected_components(spark.createDataFrame([*zip(path, path[1:])], "a bigint, b bigint"))
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 1000  # a map of each round at most
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(300)}


def test_connected_components_by_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([*edges, (None, 5), (7, None)], "a bigint, b bigint")
    assert {tuple(r) for r in graph.connected_components(df).collect()} == set(root.items())
    assert graph.connected_components(df.limit(0)).collect() == []


# -- web archives

PAGES = [(1, "http://a.example/x y", "<p>one</p>"), (2, None, None), (3, "http://b.example/", "two\r\n\r\nthree\r\n\r\n"), (4, "http://c.example/", ""),
         (5, "http://a.example/é", "<p>one</p>"), (None, "http://n.example/", "<p>one</p>"), (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"),
         (7, "long", "ü\x00" * 300_000), (5, "http://again.example/", "same id"), (8, "filedesc://x", "8 1\n2 2")]


def write_and_read(spark, pages, tmp_path, **options):
    at = f"file://{tmp_path}/{random.getrandbits(40)}"
    warc.arc_to_warc(warc.arc_files(pages), at, **options)
    return warc.read_warc(spark, at, with_payload=True).collect()


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("path", "head", "key")})
    rows = write_and_read(spark, pages.repartition(3), tmp_path)
    digest = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): (h or "").encode() for _, _, h in PAGES}
    assert Counter((r.source_key, r.payload_digest) for r in rows) == Counter(
        (i, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in PAGES)
    for r in rows:
        assert r.payload_bytes == len(digest[r.payload_digest])
        assert r.record_type == "revisit" or r.payload == digest[r.payload_digest]
    assert {(r.source_key, r.refers_to) for r in rows if r.record_type == "revisit"} == {(5, 1), (None, 1), (4, 2)}
    few = write_and_read(spark, pages, tmp_path, min_bytes=5)
    assert {(r.source_key, r.refers_to) for r in few if r.record_type == "revisit"} == {(5, 1), (None, 1)}


def test_archives_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert write_and_read(spark, empty, tmp_path) == []


def test_header_lines_of_both_versions():
    body = b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\nhello\n"
    for version, middle in ((1, b""), (2, b"200 abc - 77 f.arc ")):
        about = f"{version} 0 me\nURL\n".encode()
        head = b"filedesc://f.arc 0.0.0.0 20010203 text/plain %s%d\n" % (middle, len(about))
        one = b"http://x/a b 1.2.3.4 20010203040506 text/html %s%d\n" % (middle, len(body)) + body + b"\n"
        cut = b"http://x/c 1.2.3.4 2001 text/html %s999\nabc" % middle
        for content in (head + about + b"\n" + one + cut, gzip.compress(head + about) + gzip.compress(b"\n" + one) + gzip.compress(cut)):
            a, b = warc.arc_records(content)
            assert (a.url, a.ip, a.date, a.mime, a.block, a.truncated) == ("http://x/a b", "1.2.3.4", "20010203040506", "text/html", body, False)
            assert b.truncated and b.block == b"abc"
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and warc.warc_date("2001") == "2001-01-01T00:00:00Z"
    assert warc.split_http(body) == (body[:-6], b"hello\n") and warc.split_http(b"raw") == (b"", b"raw")
    with pytest.raises(ValueError, match="no ARC header"):
        list(warc.arc_records(b"what is this\n"))


def arc_file(bodies, broken=()):
    out = [b"filedesc://f.arc 0.0.0.0 20010203 text/plain 8\n", b"1 0 me\nU", b"\n"]
    for k, body in enumerate(bodies):
        block = b"HTTP/1.0 200 OK\r\nX-Source-Key: %d\r\n\r\n" % k + body
        length = len(block) + (30 if k in broken else 0)  # a wrong length: the next header is swallowed in part
        out.append(b"http://x/%d 1.2.3.4 20010203040506 text/html %d\n" % (k, length) + block + b"\n")
    return b"".join(out)


def test_damaged_files_lose_no_other_record(spark, tmp_path):
    rng = random.Random(2)
    bodies = [bytes(rng.choices(b"abcdefgh \n", k=300)) for _ in range(60)]
    whole = arc_file(bodies)
    packed = gzip.compress(whole)
    line = whole.index(b"http://x/30 ")
    junk = whole[:line] + b"what is this\nand this: 20010203 3\n" + whole[line:]
    files = [("whole", whole), ("cut", packed[:len(packed) * 2 // 3]), ("junk", junk), ("length", arc_file(bodies, {20})), ("flipped", packed[:200] + b"\xff" * 9 + packed[209:]),
             ("none", None), ("empty", b""), ("garbage", b"\x00\xff\n" * 50)]
    rows = warc.convert(spark.createDataFrame(files, "path string, content binary")).collect()
    plain = {k: b for k, b in enumerate(bodies)}
    for name, _ in files:
        error = [r.error for r in rows if r.error and r.error.startswith(name + ",")]
        assert bool(error) == (name not in ("whole", "none", "empty")), name
    ids = lambda content: {r.url for r in warc.arc_records(content, strict=False) if r.kind == "response"}
    assert len(ids(whole)) == len(ids(junk)) == 60 and len(ids(arc_file(bodies, {20}))) >= 59
    cut = list(warc.arc_records(files[1][1], strict=False))
    assert len(cut) > 20 and cut[0].kind == "warcinfo" and cut[-1].kind == "error"
    assert all(warc.split_http(r.block)[1] == plain[int(r.url[9:])] for r in cut if r.kind == "response" and not r.truncated)
    at = str(tmp_path / "w")
    errors = warc.arc_to_warc(spark.createDataFrame(files, "path string, content binary"), at).collect()
    assert len(errors) >= 5 and {r.source_key for r in warc.read_warc(spark, at).collect()} >= set(range(60))
    stored = [f for (c,) in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("content").collect() for f in warc.warc_records(c)]
    about = [(f["warc-filename"], b) for f, b in stored if f["warc-type"] == "warcinfo"]
    assert ("f.arc", b"1 0 me\nU") in about and len(about) >= 4


def test_revisit_query_counts(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = queries.op4_arc_to_warc(spark, SF_SMALL).collect()
    want = {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, _, h in pages.select("page_id", "url", "html").collect()}
    assert {r.page_id: r.payload_digest for r in rows} == want


# -- main text

FURNITURE = ('<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy</div><header><h1>site</h1></header>'
             '<div id="cookie-notice">cookies</div><form><input><label>mail</label></form>')


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{FURNITURE}{body}{extra}<footer>&copy; foot</footer></body></html>"


def test_main_text_of_hard_pages(spark):
    long = " ".join(["word, and more"] * 30)
    rows = [
        (1, "http://www.A.example:80/x", page(f"<article><h1>Head &amp; line</h1><p><b>{long}<br><p>second\n  para</article>")),
        (2, "http://a.example/y", page(f'<article class="x9"><p>{long}</p><script>var a="</p>"</script><!-- no <p> --><p>a &lt;b&gt; c</p>'
                                       '<section class="comments"><p>reader says</p></section></article>')),
        (3, "http://b.example/1", page(f'<div class="post-17"><p>{long}</p><ul><li>one<li>two</ul></div><div class="sidebar"><p>{long}</p></div>')),
        (4, "http://b.example/2", page('<div class="post-18"><p>short</p></div>', "<div><p>" + '<a href="x">other</a> ' * 50 + "</p></div>")),
        (5, None, None), (6, "", ""), (7, "x", "just text &am"), (8, "http://c.example/", "<p>unclosed <b>text"), (9, "http://c.example/", "<nav>menu"),
        (10, "http://d.example/", "<div>" * 3000 + "deep" + "</div>" * 10), (11, "http://d.example/", "<article>" + "<p>long text</p>" * 50_000),
        (12, "http://d.example/", '<a title="x>' * 2000), (1, "http://www.A.example:80/x", page(f"<article><p>{long}</p></article>")),
    ]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "host", "paths", "u", "h", "row")})
    out = html_paths.extract_main_text(table.repartition(4))
    got = {(r.page_id, r.n_chars): r.text for r in out.collect()}
    by = {k[0]: v for k, v in got.items() if k[0] != 1}
    assert len(got) == len(rows) and all(k[1] == len(v) for k, v in got.items())
    assert f"Head & line\n{long}\nsecond para" in got.values() and got[1, len(long)] == long
    assert by[2] == f"{long}\na <b> c" and by[3] == f"{long}\none\ntwo" and by[4] == "short"
    assert by[5] == by[6] == by[9] == "" and by[7] == "just text &am" and by[8] == "unclosed text" and by[10] == "deep"
    assert by[11] == "\n".join(["long text"] * 50_000)
    assert html_paths.extract_main_text(table.limit(0)).collect() == []


def test_main_text_beside_the_inner_body():
    body, links = "<p>" + "word, and more " * 140 + "</p>", '<ul class="tags">' + '<li><a href="x">some tag</a>' * 9 + "</ul>"
    want = " ".join(["word, and more"] * 140)
    inner = f'<div class="entry-content">{body}</div>'
    unlike = "".join(f'<section class="s-{x}"><h2>{x}</h2>{body if x == "methods" else "<p>few words</p>"}</section>' for x in ("intro", "methods", "results"))
    more = '<div class="more">' + '<p><a href="x">another article</a></p>' * 200 + "</div>"
    cases = [
        (f"<article><h1>Head</h1><p>lead</p>{inner}</article>", f"Head\nlead\n{want}"),
        (f"<article><h1>Head</h1><p>lead</p>{links}{inner}</article>", f"Head\nlead\n{want}"),
        (f"<main><div><article><h1>Head</h1><div><div><div>{inner}</div></div></div></article></div>{more}</main>", f"Head\n{want}"),
        (f'<div id="content"><div><p>lead</p></div>{inner}<p>end</p></div>', f"lead\n{want}\nend"),
        (f"<article>{unlike}</article>", f"intro\nfew words\nmethods\n{want}\nresults\nfew words"),
        (f'<article>{body}<p class="comments">reader</p></article>', want),
    ]
    inner_path = html_paths.Page(page(cases[0][0]))
    inner_path = [inner_path.path(e) for e in inner_path.scores() if "entry-content" in inner_path.elements[e].name]
    for html, text in cases:
        assert html_paths.main_text(page(html), None) == html_paths.main_text(page(html), inner_path) == text


def test_main_text_is_not_swallowed():
    body = "<p>" + "word, and more " * 60 + "</p>"
    want = " ".join(["word, and more"] * 60)
    article = f"<article>{body}</article>"
    comments = '<div id="comments" class="comments-area">' + '<article class="comment"><p>' + "reader says " * 300 + "</p></article></div>"
    for html in (
            f'<svg-icon name="x"></svg-icon>{article}', f'<template-x></template-x>{article}', f"<svg/>{article}", f'<svg width="1" />{article}',
            f'<svg viewBox="0 0 1 1"><path d="M0"/><text>icon</text></svg>{article}', f"<article><p><math/></p>{body}</article>",
            f'<div class="content no-sidebar">{article}</div>', f'<div id="page" class="has-banner">{article}</div>', f"<form>{article}</form>",
            f'<form id="all"><div class="has-banner"><div class="no-sidebar">{body}</div></div></form>', f'<div class="content no-sidebar">{body}</div>',
            f'<div class="has-banner">{article}{comments}</div>', f"{article}{comments}", f'<div class="has-banner"><main>{body}</main></div>{comments}',
            f'{article}<div class="related"><article><p>teaser</p></article></div>', f'<div class="has-banner"><main><div class="sidebar-right">{article}</div></main></div>'):
        assert html_paths.main_text(page(html), None) == want, html[:80]
    some = [f'<div class="{x}"><p>{x} {"text " * n}</p></div>' for x, n in (("no-sidebar", 50), ("sidebar", 45), ("comments", 40))]
    assert html_paths.main_text(page("".join(some)), None) == "no-sidebar " + " ".join(["text"] * 50)


def test_words_of_sections_leave_nothing_out():
    body = "<p>" + "word, and more " * 60 + "</p>"
    want = " ".join(["word, and more"] * 60)
    links = '<a href="x">another article</a> ' * 9
    for inner, text in (
            (f'<h1 class="entry-header">Head</h1>{body}', f"Head\n{want}"), (f'<h2 class="section-header">Head</h2>{body}', f"Head\n{want}"),
            (f'{body}<p class="related-work">earlier work</p>', f"{want}\nearlier work"), (f'{body}<div class="search-results"><p>we found it</p></div>', f"{want}\nwe found it"),
            (f"<header><h1>Head</h1><p>lead</p></header>{body}", f"Head\nlead\n{want}"), (f'<header class="entry-header"><h1>Head</h1></header>{body}', f"Head\n{want}"),
            (f"{body}<p>the <label>word</label> stays</p>", f"{want}\nthe word stays"),
            (f'{body}<div class="related">{links}</div>', want), (f"<header>{links}</header>{body}", want), (f"{body}<form><label>mail</label></form>", want),
            (f'{body}<div class="ad">buy</div><aside>aside</aside><p class="share">share it</p>', want)):
        assert html_paths.main_text(page(f"<article>{inner}</article>"), None) == text, inner[:60]


@pytest.mark.parametrize("html", [
    "<a " * 350_000, "<div>t" * 170_000, "<b>" * 330_000 + "text", '<a title="x>' * 85_000, "<script " * 130_000, "<!x" * 300_000,
    "<div></span>" * 85_000, "<article>" * 110_000 + "text", "<ul><li>" * 120_000 + "x", "<p><svg " * 120_000 + ">", "</div>" * 160_000])
def test_a_broken_page_of_a_megabyte_takes_seconds(html):
    began = time.process_time()
    html_paths.main_text(html, None)
    assert time.process_time() - began < 10


def test_deep_paths_stay_short():
    deep = html_paths.Page('<div class="some-name">' * 2000 + "text")
    paths = [deep.path(e) for e in range(len(deep.elements))]
    assert max(map(len, paths)) < 2 * html_paths.LONGEST_PATH and len(set(paths)) == len(paths)


def test_votes_for_the_raised_container(spark):
    html = page("<article><h1>Head</h1><div class='entry-content'><p>" + "long " * 400 + "</p></div></article>")
    table = spark.createDataFrame([(i, "http://a.example/", html.replace("Head", f"Head {i}")) for i in range(5)], "page_id bigint, url string, html string")
    assert [r.paths for r in html_paths.winning_paths(html_paths.path_votes(table)).collect()] == [["html>body>article"]]
    assert {r.page_id: r.text.split("\n")[0] for r in html_paths.extract_main_text(table).collect()} == {i: f"Head {i}" for i in range(5)}


def test_hosts():
    assert html_paths.host_of("https://user@WWW.x.example:8/a?b") == "x.example" and html_paths.host_of(None) == html_paths.host_of("/rel") == ""


def test_pages_of_test_table(spark):
    import re
    from html import unescape
    rows = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in queries.op3_host_paths(spark, SF_SMALL).collect()}
    for i, h in rows:
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[i] == "\n".join(b for b in blocks if b)


# -- conversations

def test_events_fold(spark):
    events = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "he"), (1, 3, "delta", 1, None, "llo"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, "assistant", "bet"), (1, 7, "delta", 1, "assistant", "ter"),
        (1, 8, "message", 2, "user", "x"), (1, 9, "edit", 0, None, "hi there"), (1, 10, "delta", 0, None, "!"),
        (2, 1, "message", 0, "user", "a"), (2, 2, "message", 1, "assistant", "b"), (2, 3, "message", 2, "user", "c"), (2, 4, "regenerate", 1, None, None),
        (None, 1, "odd kind", None, None, None), (3, 1, "delta", 0, "user", "<turn x>\n\\l \\b </turn>"), (3, None, None, None, None, None),
    ]
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string").withColumns(
        {c: F.lit("clash") for c in ("log", "cut", "head", "span", "turns")})
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(df).collect()}
    assert got == {(1, 0): ("user", "hi there!"), (1, 1): ("assistant", "better"), (1, 2): ("user", "x"), (2, 0): ("user", "a"), (None, -1): ("", ""),
                   (3, 0): ("user", "<turn x>\n\\l \\b </turn>")}
    assert chat.read_back(chat.render(chat.fold_events(df.limit(0)))).collect() == []


def test_rendering_is_reversible(spark):
    rng = random.Random(8)
    parts = ["<", "\\", "l", "b", "</turn>", "<turn assistant>\n", "\n", "### Assistant: ", "é", "\U0001f600", "", "user"]
    rows = [(c, t, rng.choice(["user", "assistant", "<odd\\>", None]), rng.choice([None, "".join(rng.choices(parts, k=rng.randint(0, 9)))]))
            for c in range(40) for t in range(rng.randint(1, 7))] + [(50, 0, "user", "a"), (50, 0, "user", "a"), (51, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(chat.as_events(df)))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        learned = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_conversation_with_control_strings(spark):
    row = next(r for r in queries.op7_chat_formatting(spark, SF_SMALL).collect() if r.conv_id == -7)
    text = "\\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars) == (2, len(text)) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_a_streamed_log_folds_to_the_same_messages(spark):
    rows = [(c, t, ("user", "assistant", None)[t % 3], text) for c in range(30) for t, text in enumerate(["", "a", "ab", "one two three", None, "語ü\\<"])]
    log = chat.as_events(spark.createDataFrame([*rows, (None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string"))
    made = chat.streamed(log).cache()
    assert {r.kind for r in made.select("kind").distinct().collect()} == set(chat.KINDS)
    key = lambda r: (r.conv_id is None, r.conv_id, r.turn)
    assert sorted(chat.fold_events(made.repartition(5)).collect(), key=key) == sorted(chat.fold_events(log).collect(), key=key)
