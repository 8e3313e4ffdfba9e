"""Fixtures of a few rows for what the given tables don't hold."""

import datetime as dt
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as fx
from corpuscle.functions import urls as ux
from corpuscle.operators import analytics as an
from corpuscle.operators import logs, retrieval, storage, sync, web
from corpuscle.operators import text as tx
from corpuscle.plans import registry
from corpuscle.sources import formats as fm
from tests import oracle


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Ex.com:80/a/?utm_source=x&b=1%20c&d=#f", "http://ex.com/a/?b=1+c&d="),
        ("https://ex.com", "https://ex.com/"),
        ("https://ex.com:8443/x?a=*~&gclid=2", "https://ex.com:8443/x?a=%2A~"),
        ("ftp://ex.com/", None),
        ("https://u:p@ex.com/", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, ux.canonical_url) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("https://www.Docs.Example.org/a", "docs.example.org"), ("example.org", "example.org"), ("10.0.0.1", None), ("localhost", None), ("a.local", None), ("https://u:p@x.org", None), ("x.org:8080", None), ('"x.org"', "x.org")],
)
def test_domain(spark, value, want):
    assert one(spark, value, ux.domain) == want


def test_scope_is_bounded_by_the_directory(spark):
    df = spark.createDataFrame([("https://x.org/docs", "https://x.org/docs"), ("https://x.org/docs/a", "https://x.org/docs"), ("https://x.org/docs-other", "https://x.org/docs"), ("http://x.org/docs/a", "https://x.org/docs")], "l string, e string")
    assert [r[0] for r in df.select(ux.in_scope(F.col("l"), F.col("e"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize(("q", "want"), [("summarize this paper", "global"), ("帮我总结一下", "global"), ("总结一下 Radar 的流程", "local"), ("what is x", "local"), ("", "local"), ("What method does this paper propose?", "global")])
def test_intent(spark, q, want):
    assert one(spark, q, fx.intent) == want


def test_sections_and_fences(spark):
    md = "intro\n# A\ntext\n```\n# no\n```\n### C ##\nmore\n## \n\n# B\n"
    got = rows(tx.sections(spark.createDataFrame([(1, md)], "doc_id long, markdown string")), "section_no")
    assert [(r[2], r[3]) for r in got] == [([], "intro"), (["A"], "# A\ntext\n```\n# no\n```"), (["A", "C"], "### C ##\nmore\n##"), (["B"], "# B")]


def test_pack():
    assert tx.pack("  ") == []
    assert tx.pack("a b", 5) == ["a b"]
    assert tx.pack("a b c\n\nd e f", 4, 2) == ["a b c", "c\n\nd e f"]
    assert tx.pack(" ".join("abcdefgh"), 4, 1) == ["a b c d", "d e f g", "g h"]
    code = "```py\n" + "\n".join(["x y", "z w", "u v"]) + "\n```"
    room = tx._size("```py\n```")
    assert tx.pack(code, room + 4, 1) == ["```py\nx y\nz w\n```", "```py\nu v\n```"]


def test_chunk_ids_are_uuid5(spark):
    df = tx.with_chunk_ids(spark.createDataFrame([("d1", 3, "héllo")], "document_id string, chunk_index int, text string"))
    import hashlib

    h = hashlib.sha256("héllo".encode()).hexdigest()
    assert df.first()["chunk_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"d1:sync:3:{h}"))


def test_citations(spark):
    df = spark.createDataFrame([(1, "a [S1] b [[S2]] c [M3][S1] [W9] [S0]", ["S1", "S2", "M3"])], "answer_id long, text string, source_ids array<string>")
    assert [r[2] for r in rows(tx.citations(df), "position")] == ["S1", "M3"]


@pytest.mark.parametrize(("text", "want"), [("see https://a.b/c。ok", "see 。ok"), ("(http://a.b)", "()"), ("x https://a.b/c.html, y", "x , y"), ("end https://a.b.", "end ."), ("p https://a.b:80/x y", "p  y"), ("none", "none")])
def test_redact_urls(spark, text, want):
    assert tx.redact_urls(spark.createDataFrame([(text,)], "text string")).first()[0] == want


def test_segments_pack_greedily(spark):
    df = spark.createDataFrame([(1, i, "user", "x" * 10) for i in range(7)], "conv_id long, turn long, role string, text string")
    got = rows(tx.segment_conversations(df, messages=3), "segment_no")
    assert [(r[1], r[2], r[3]) for r in got] == [(0, 0, 2), (1, 3, 5), (2, 6, 6)]


def test_filter_comes_before_the_top_k(spark):
    v = spark.createDataFrame([(i, [1.0, i / 100], "a" if i < 98 else "b") for i in range(100)], "id long, embedding array<float>, kind string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "b")], "query_id long, embedding array<float>, kind string")
    assert [r["id"] for r in retrieval.vector_topk(q, v, 30, ["kind"]).orderBy("rank").collect()] == [98, 99]
    bad = spark.createDataFrame([(1, [1.0], "b")], "id long, embedding array<float>, kind string")
    with pytest.raises(Exception, match="dimensions"):
        retrieval.vector_topk(q, bad, 3).collect()


def test_archived_rows_leave_before_statistics(spark):
    chunks = spark.createDataFrame([(1, "a", "x y"), (2, "b", "x x"), (3, "c", "z")], "id long, document_id string, text string")
    docs = spark.createDataFrame([("a", None), ("b", "2024"), ("c", None)], "document_id string, archived_at string")
    rebuild = spark.createDataFrame([("c", False)], "document_id string, needs_rebuild boolean")
    live = retrieval.visible_chunks(chunks, docs, rebuild)
    stats = {r["term"]: (r["df"], r["n_docs"]) for r in retrieval.bm25_stats(tx.postings(live, "id")).collect()}
    assert stats == {"x": (1, 2), "y": (1, 2), "z": (1, 2)}


def test_robots(spark):
    body = "User-agent: *\nDisallow: /a # no\nDisallow:\nUser-agent: other\nDisallow: /\nCrawl-delay: 9\nUser-agent: Bot\nCrawl-delay: x\nCrawl-delay: 3"
    robots = spark.createDataFrame([("https://x.org", body)], "origin string, body string")
    urls = spark.createDataFrame([("https://x.org/a/b",), ("https://x.org/c",), ("https://y.org/",)], "url string")
    assert rows(web.robots_filter(urls, robots, "bot"), "url") == [("https://x.org/a/b", False, 3.0), ("https://x.org/c", True, 3.0), ("https://y.org/", False, None)]


def test_frontier(spark):
    e = spark.createDataFrame([("s", "https://x.org/docs")], "source string, entry string")
    edges = [("/docs", 0, "/docs/a"), ("/docs", 1, "/docs-other"), ("/docs", 2, "/docs/b"), ("/docs/a", 0, "/docs"), ("/docs/b", 0, "/docs/c"), ("/docs/c", 0, "/docs/d")]
    links = spark.createDataFrame([(f"https://x.org{a}", n, f"https://x.org{b}") for a, n, b in edges], "from_url string, link_no int, to_url string")
    got = rows(web.bfs_frontier(e, links, 2, 3), "position")
    assert [(r[1].removeprefix("https://x.org"), r[2]) for r in got] == [("/docs", 0), ("/docs/a", 1), ("/docs/b", 1)]
    assert all(r[4] for r in got)


def test_frontier_of_a_small_budget_equals_a_plain_walk(spark):
    pages = {f"/d/{i}": [f"/d/{(i * k + 1) % 23}" for k in range(1, 5)] for i in range(23)}
    links = spark.createDataFrame([(f"https://x.org{a}", n, f"https://x.org{b}") for a, out in pages.items() for n, b in enumerate(out)], "from_url string, link_no int, to_url string")
    first = [("https://x.org/d", n, f"https://x.org/d/{b}") for n, b in enumerate((0, 5))]
    links = links.unionByName(spark.createDataFrame(first, links.schema))
    e = spark.createDataFrame([(i, "https://x.org/d") for i in (0, 5)], "source int, entry string")
    for most in (1, 3, 7, 100):
        got = rows(web.bfs_frontier(e, links, 3, most))
        seen, level = ["/d"], ["/d"]
        for _ in range(3):
            new = []
            for a in level:
                for b in ["/d/0", "/d/5"] if a == "/d" else pages[a]:
                    new += [b] if b not in seen + new else []
            seen, level = seen + new, new
        for source in (0, 5):
            mine = sorted((r for r in got if r[0] == source), key=lambda r: r[3])
            assert [r[1].removeprefix("https://x.org") for r in mine] == seen[:most]
            assert {r[4] for r in mine} == {len(seen) > most}


def test_links_meet_entries_above_them(spark):
    links = [f"https://x.org{p}" for p in ("/", "/docs", "/docs/", "/docs/a/b?q=1", "/docs-other", "/docs//c", "/DOCS/a")] + ["http://x.org/docs/a", "https://y.org/docs/a"]
    entries = [f"https://x.org{p}" for p in ("/docs", "/docs/", "/docs/a/", "/docs//")] + ["https://y.org/"]
    df = spark.createDataFrame(list(enumerate([*links, links[1], None])), "page_id int, link string")
    got = rows(web.links_in_scope(df, spark.createDataFrame([(e,) for e in entries], "entry string")), "page_id", "entry")
    pairs = df.crossJoin(spark.createDataFrame([(e,) for e in entries], "entry string")).where(ux.in_scope(F.col("link"), F.col("entry"))).select("page_id", "link", "entry")
    assert got == rows(pairs, "page_id", "entry") and len(got) > 8


def test_topics(spark):
    d = spark.createDataFrame([(1, "# A\n- b\n\ntext - c\n-d\n###\n  - # e "), (2, None), (3, "")], "doc_id int, markdown string")
    assert rows(tx.topics(d), "topic_no") == [(1, 0, "A"), (1, 1, "b"), (1, 2, "e")]


def test_hashed_embedding(spark):
    d = spark.createDataFrame([(1, "A a @b"), (2, ""), (3, None)], "doc_id int, text string")
    at = lambda t: int.from_bytes(hashlib.blake2b(t, digest_size=2).digest(), "big") % 64
    want = np.zeros(64)
    want[at(b"a")] += 2
    want[at(b"@b")] += 12
    got = rows(tx.embed_hash(d), "doc_id")
    assert np.allclose(got[0][2], want / np.linalg.norm(want), atol=1e-6)
    assert not any(got[1][2]) and not any(got[2][2])


def test_graph_without_archived_documents(spark):
    docs = spark.createDataFrame([("1", "t1", "# Same\n[S1]"), ("2", "t2", "# Same\n# Own")], "document_id string, title string, content string")
    nodes, edges = an.visible_graph(*an.build_graph(docs), spark.createDataFrame([("2",)], "document_id string"))
    live = an.drop_orphans(nodes, edges, docs.where("document_id = '1'"))
    assert {r["node_id"] for r in live.collect()} == {"document:1", "topic:Same", "citation:S1"}
    got = {tuple(r) for r in an.neighbors(edges).collect()}
    assert got == {("document:1", "topic:Same", "mentions", True), ("topic:Same", "document:1", "mentions", False), ("document:1", "citation:S1", "references", True), ("citation:S1", "document:1", "references", False)}


def test_weak_signals_never_beat_an_explicit_one(spark):
    s = [("x.org", "explicit", "yours", None, True, 0)] + [("y.org", k, k, "Y", k == "seed", i) for i, k in enumerate(("seed", "documents", "nomination", "crawl_history", "upstream"), 1)]
    got = rows(web.score_candidates(spark.createDataFrame(s, "value string, signal string, evidence string, label string, verified boolean, at int"), 5))
    assert [(r[0], r[1]) for r in got] == [("x.org", 100), ("y.org", 56)]


def test_nominations(spark):
    text = 'Sure:\n[{"domain": "www.A.org", "reason": " two  words "}, "b.org", {"x": 1}, "a.org", "10.0.0.1"] bye'
    got = rows(web.parse_nominations(spark.createDataFrame([(1, text), (2, "none"), (3, "[broken")], "id long, text string")), "id", "position")
    assert got == [(1, 1, "a.org", "two words"), (1, 2, "b.org", None)]


def test_rejection_precedence(spark):
    s = "error_code string, status int, probe_state string, stored_reason string"
    df = spark.createDataFrame([("ROBOTS_DENIED", 503, None, None), ("X", 503, "tls_error", None), (None, None, "tls_error", None), (None, None, None, None), ("ROBOTS_DENIED", None, None, "gone"), (None, 451, None, "tls_error")], s)
    assert [r["reason"] for r in web.classify_rejections(df).collect()] == ["robots_denied", "throttled", "tls_error", "fetch_failed", "robots_denied", "tls_error"]


def test_sync_diff_states(spark):
    s = "document_id string, title string, sha256 string, path array<string>"
    prior = spark.createDataFrame([(i, "t", "h", ["p"]) for i in "bcdeft"], s)
    remote = spark.createDataFrame([("a", "t", "h", ["p"]), ("b", "t", "h2", ["p"]), ("c", "t", "h", ["q"]), ("d", "t", "h", ["p"]), ("e", "t", "h", ["p"]), ("t", "t", "h3", ["p"])], s)
    local = spark.createDataFrame([(i, None if i == "d" else "x", None) for i in "bcdeft"] + [("z", "x", "2024")], "document_id string, body string, archived_at string")
    removed = spark.createDataFrame([("t",)], "document_id string")
    assert dict(rows(sync.sync_diff(remote, prior, local, removed))) == {"a": "added", "b": "changed", "c": "changed", "d": "repair", "e": "unchanged", "f": "deleted"}


def test_conflict_decisions(spark):
    found = spark.createDataFrame([(i, "t", "mine", "theirs") for i in (1, 2, 3)], "document_id long, title string, local_content string, remote_content string")
    d = spark.createDataFrame([(1, "keep_local"), (2, "keep_remote"), (3, "keep_both")], "document_id long, decision string")
    got = rows(sync.resolve_conflicts(found, d).select("document_id", "content", "is_copy"), "document_id")
    assert got == [("1", "mine", False), ("2", "theirs", False), ("3", "theirs", False), ("3-copy", "mine", True)]


def test_backoff_and_asof(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    a = spark.createDataFrame([("h", i, t(i), x, r) for i, (x, r) in enumerate([(True, None), (True, None), (True, 60), (False, None), (True, None)])], "host string, attempt_id long, ts timestamp, throttled boolean, retry_after int")
    assert [r[2:] for r in rows(logs.backoff(a), "attempt_id")] == [(1, 5.0), (2, 10.0), (3, 60.0), (0, 0.0), (1, 5.0)]
    p = spark.createDataFrame([("h", 0, t(0), "ok")], "host string, probe_id long, ts timestamp, state string")
    q = spark.createDataFrame([("h", 1, t(0)), ("h", 2, t(359)), ("h", 3, t(360)), ("g", 4, t(1))], "host string, attempt_id long, ts timestamp")
    assert rows(logs.probe_asof(q, p), "attempt_id") == [(1, "ok", True), (2, "ok", True), (3, "ok", False), (4, None, False)]


def test_upsert_and_manifest(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert rows(storage.upsert(a, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), "k"), "k") == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="dimension 2"):
        v = spark.createDataFrame([(1, [1.0])], "k long, e array<double>")
        storage.upsert(v, v, "k", "e", 2).collect()
    m = spark.createDataFrame([("1", "p", "text/markdown", 3, "h"), ("2", "q", "text/markdown", 3, "h"), ("3", "r", "x/y", 3, "h"), ("4", "s", "text/markdown", 30 << 20, "h"), ("5", "t", "text/markdown", 3, "h"), ("6", "t", "text/markdown", 3, "h"), ("7", "u", "text/markdown", 3, "h"), ("8", "w", "text/markdown", 4, "h")], "staged_id string, relative_path string, media_type string, size_bytes long, sha256 string")
    f = spark.createDataFrame([("p", 3, "h"), ("r", 3, "h"), ("s", 3, "h"), ("t", 3, "h"), ("u", 3, "other"), ("w", 3, "h"), ("x", 1, "h")], "path string, length long, sha256 string")
    got = {(r[1] or r[0]): r[2] for r in rows(storage.verify_manifest(m, f, ["text/markdown"], 1 << 40))}
    assert got == {"1": "ok", "2": "missing", "3": "unsupported_type", "4": "too_large", "5": "duplicate_path", "6": "duplicate_path", "7": "hash_mismatch", "8": "size_mismatch", "x": "unlisted"}


def test_manifest_of_files_that_share_paths(spark):
    m = spark.createDataFrame([(1, "1", "p", "text/markdown", 3, "h"), (2, "2", "p", "text/markdown", 3, "h"), (3, "3", "q", "text/markdown", 3, "h"), (6, "6", None, "text/markdown", 3, "h"), (7, "7", "r", "text/markdown", None, "h"), (8, "8", "s", "text/markdown", 3, "h")], "k long, staged_id string, relative_path string, media_type string, size_bytes long, sha256 string")
    f = spark.createDataFrame([(1, "p", 3, "h"), (2, "p", 3, "h"), (4, "q", 3, "h"), (5, "q", 3, "h"), (6, None, 3, "h"), (7, "r", 3, "h"), (8, "s", 3, None)], "k long, path string, length long, sha256 string")
    got = rows(storage.verify_manifest(m, f, ["text/markdown"], 1 << 40, "k"), "staged_id")
    assert got == [("q", None, "unlisted")] * 2 + [("p", "1", "duplicate_path"), ("p", "2", "duplicate_path"), ("q", "3", "missing"), (None, "6", "ok"), ("r", "7", "size_mismatch"), ("s", "8", "hash_mismatch")]


def test_manifest_of_odd_pages_equals_its_sql(spark, tmp_path):
    for t in oracle.TABLES:
        if t != "pages":
            (tmp_path / f"{t}.parquet").symlink_to(f"{oracle.FOLDER}/{t}.parquet")
    url = lambda i: None if i % 500 == 9 else f"https://x.org/{i % 700}" if i % 3 else f"https://x.org/p/{i}"
    pages = [(i, url(i), None if i % 11 == 2 else ["", "a", "é", f"<p>{i}</p>"][i % 4]) for i in range(2000)]
    pq.write_table(pa.table(dict(zip(("page_id", "url", "html"), map(list, zip(*pages))))), tmp_path / "pages.parquet")
    oracle.same(spark, registry.QUERIES["s5_manifest"], registry.ORACLES["s5_manifest"], str(tmp_path))


def test_novelty_and_graph_and_diff(spark):
    t = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "a b c e"), (1, 2, "x y a"), (1, 3, "!!")], "document_id long, position int, text string")
    assert rows(an.merge_novel(t)) == [(1, "a b c d\n\nx y a", 2)]
    docs = spark.createDataFrame([("1", "t1", "# Same\n[S1] #tag #tag"), ("2", "t2", "# Same")], "document_id string, title string, content string")
    nodes, edges = an.build_graph(docs)
    assert {(r["node_id"], r["owner"]) for r in nodes.collect()} == {("document:1", "1"), ("document:2", "2"), ("topic:Same", None), ("citation:S1", "1"), ("tag:tag", "1")}
    assert edges.count() == 4
    v = spark.createDataFrame([("d", 1, "a\nb"), ("d", 2, "a\nc\nd")], "document_id string, version_no int, content string")
    assert [(r[3], r[4]) for r in rows(an.version_diff(v), "line_no")] == [("context", "a"), ("removed", "b"), ("added", "c"), ("added", "d")]


def test_formats(spark):
    files = spark.createDataFrame([("/a.md", "text/markdown", b"\xef\xbb\xbf```\n# no\n```\n# Yes #"), ("/b.md", "text/markdown", b"\xff"), ("/c.x", "x/y", b"1"), ("/d.html", "text/html", b"<title>T</title><nav>n</nav><main><h1>H</h1><p>a<br>b</p><div hidden>z</div></main>")], "path string, media_type string, content binary")
    got = {r[0]: r[1:] for r in rows(fm.parse_files(files))}
    assert got["/a.md"][0] == "Yes" and got["/b.md"][2] == "undecodable" and got["/c.x"][2] == "unsupported"
    assert got["/d.html"][:2] == ("H", "H\na\nb")
    assert {r["path"]: r["title"] for r in fm.read_markdown(files.where("path = '/b.md'")).collect()} == {"/b.md": None}


def test_main_container_of_a_page():
    prose, links = "plain words of the story " * 20, '<a href="/x">a link of the list</a> ' * 60
    page = f"<head><title>T</title></head><body><div class=list>{links}</div><div id=wrap><div class='post-body'><h2>Head</h2><p>{prose}</p><div class='share-bar'>tweet</div><form>send</form><p role=search>find</p><p style='visibility: hidden'>z</p></div></div><div>{prose[:230]}</div></body>"
    title, text = fm.parse_html(page.encode())
    assert (title, text) == ("T", "Head\n" + " ".join(prose.split()))
    # too little of the page: all of it, links included
    few = f"<body><p>{prose * 5}</p><div>{prose[:210]}</div></body>"
    assert fm.parse_html(few.encode())[1].count("story") > 100
    # decoration by name counts a quarter
    named = f"<div class='sidebar'>{prose}</div><div>{prose[:300]}</div>"
    assert fm.parse_html(named.encode())[1] == " ".join(prose[:300].split())
    # deep nesting, text left open, nothing at all
    assert fm.parse_html(b"<div>" * 5000 + b"deep")[1] == "deep"
    assert fm.parse_html(b"<p>open <b>text") == (None, "open text") and fm.parse_html(b"") == (None, "")


def test_images(spark):
    page = '<img srcset="a.png 100w, b.png 2x" src="c.png"><img data-src="/d.svg"><img src="data:x"><img src="e.png" width="20"><img src="e.png#f"><img src="http://127.0.0.1/f.png"><img src="/logo/g.png">'
    df = spark.createDataFrame([(1, "https://x.org/p/q", page)], "page_id long, url string, html string")
    got = {r["image"].rsplit("/", 1)[1]: (r["references"], r["rejected"]) for r in fm.extract_images(df).collect()}
    assert got == {"b.png": (1, None), "d.svg": (1, "svg"), "e.png": (2, "too_small"), "f.png": (1, "private_host"), "g.png": (1, "decorative")}


def test_memory_search(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10], "r", "note") for i in range(4)], "id long, embedding array<float>, repository_id string, kind string")
    r = spark.createDataFrame([(0, "note", 7, "ready", True), (1, "note", 7, "saved", True), (2, "note", 8, "stale", True), (3, "note", 9, "ready", False)], "id long, kind string, source_id long, state string, indexed boolean")
    q = spark.createDataFrame([(1, [1.0, 0.0], "r", "note")], "query_id long, embedding array<float>, repository_id string, kind string")
    assert [(x[3], x[4]) for x in rows(retrieval.memory_search(q, v, r, 3))] == [(7, 1.0)]
