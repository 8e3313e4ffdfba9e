"""Formats, references of pages, sections, chunks and line diffs: odd input, nulls, long texts."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import analytics as an
from corpuscle.operators import linediff, storage
from corpuscle.operators import text as tx
from corpuscle.sources import formats as fm


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


PAGE = """<!-- <a href="/comment"><img src="/c.png"> --><script>var x = '<a href="/script">';</script><style>a[href="/style"] {}</style>
<A HREF=/bare>x</A> <a class=k href='/q?a=1&amp;b=2&lang=de&#38;c=3'>y</a> <a href="
 /spaced ">z</a> <a name=n>no</a> <a href="">empty</a> <a href="mailto:x@y.z">m</a><noscript><a href="/noscript">n</a></noscript><textarea><a href="/raw"></textarea>
<img src=/bare.png width=200> <img data-src="/lazy.png?x=1&amp;y=2" src="data:image/gif;base64,AA" width="99px"> <img srcset="/s.png 1x, /l.png 3x" src="/s.png"> <IMG SRC='/bare.png#top'> <img alt=">" src="/quoted.png">"""


def test_references_come_from_markup_alone(spark):
    pages = spark.createDataFrame([(1, "https://h.test/d/p", PAGE), (2, "https://h.test/", None), (3, "https://h.test/", "")], "page_id long, url string, html string")
    links = [r["link"] for r in fm.extract_links(pages).orderBy("link_no").collect()]
    want = ["/bare", "/q?a=1&b=2&lang=de&c=3", "/spaced", "/d/p", "/noscript"]
    assert links[: len(want)] == [f"https://h.test{x}" for x in want] and not any("comment" in x or "script'" in x or "style" in x for x in links)
    images = {r["image"]: (r["references"], r["rejected"]) for r in fm.extract_images(pages).collect()}
    assert images == {"https://h.test/bare.png": (2, None), "https://h.test/lazy.png?x=1&y=2": (1, "too_small"), "https://h.test/l.png": (1, None), "https://h.test/quoted.png": (1, None)}


def test_null_and_empty_content(spark):
    files = spark.createDataFrame([("/a.md", "text/markdown", None), ("/b.html", "text/html", None), ("/c.md", "text/markdown", b""), ("/d", None, b"x"), (None, "text/markdown", b"# t")], "path string, media_type string, content binary")
    got = {r["path"]: (r["title"], r["text"], r["reject"]) for r in fm.parse_files(files).collect()}
    assert got == {"/a.md": (None, None, "no content"), "/b.html": (None, None, "no content"), "/c.md": (None, "", None), "/d": (None, None, "unsupported"), None: ("t", "# t", None)}
    got = {r["path"]: (r["title"], r["reject"]) for r in fm.read_markdown(files).collect()}
    assert got["/a.md"] == (None, "no content") and got["/c.md"] == ("c", None)
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x</p>")], "page_id long, html string")
    assert rows(fm.extract_pages(pages), "page_id") == [(1, None, ""), (2, None, ""), (3, None, "x")]


def test_formats_go_by_type_or_extension_and_are_validated(spark, monkeypatch):
    monkeypatch.setattr(fm, "FORMATS", dict(fm.FORMATS))
    fm.register_format("text/x-list", lambda raw: (None, raw.decode().upper()), "list", (".lst",), content_types=("text/list",), magic=b"L:", validate=lambda raw: "too short" if len(raw) < 4 else None)
    fm.register_format("text/x-list", lambda raw: ("again", raw.decode()), "list", ("LST",), magic=b"L:", validate=lambda raw: "too short" if len(raw) < 4 else None)
    with pytest.raises(ValueError, match="built in"):
        fm.register_format("text/html", lambda raw: (None, ""))
    with pytest.raises(ValueError, match="another format"):
        fm.register_format("text/x-other", lambda raw: (None, ""), extensions=("md",))
    data = [("/a.LST", None, b"L:ab"), ("/b", "text/x-list; charset=utf-8", b"L:cd"), ("/c.lst", "", b"L:"), ("/d.lst", None, b"nope"), ("/e.md", "text/x-list", b"L:ef"), ("/f.md", None, b"# t"), ("/g.md", "image/png", b"# t"), ("/h.txt", "text/plain", b"\xff"), ("/i.htm", None, b"<p>\xff"), ("/j.tar.md", None, b"x")]
    got = {r["path"]: (r["title"], r["text"], r["reject"]) for r in fm.parse_files(spark.createDataFrame(data, "path string, media_type string, content binary")).collect()}
    assert got == {
        "/a.LST": ("again", "L:ab", None), "/b": ("again", "L:cd", None), "/c.lst": (None, None, "invalid: too short"), "/d.lst": (None, None, "invalid: not list"), "/e.md": ("again", "L:ef", None),
        "/f.md": ("t", "# t", None), "/g.md": (None, None, "unsupported"), "/h.txt": (None, None, "undecodable"), "/i.htm": (None, None, "undecodable"), "/j.tar.md": (None, "x", None),
    }


def test_sections_and_chunks_of_nulls_and_long_texts(spark):
    long = "# one\n" + "\n".join(f"line {i} of it" for i in range(100_000)) + "\n```\n# no\n```\n### deep\n\n## two ##\ntext"
    md = [(1, None), (2, ""), (3, " \n "), (4, "pre\n# a\n### b\nx\n### c\n## d\n~~~\n# e\n~~~\n"), (5, long)]
    docs = spark.createDataFrame(md, "doc_id long, markdown string")
    began = time.time()
    got = rows(tx.sections(docs), "doc_id", "section_no")
    assert time.time() - began < 10
    assert [r[:3] for r in got] == [
        (4, 0, []), (4, 1, ["a"]), (4, 2, ["a", "b"]), (4, 3, ["a", "b", "c"]), (4, 4, ["a", "d"]), (5, 0, ["one"]), (5, 1, ["one", "deep"]), (5, 2, ["one", "two"]),
    ]
    whole = rows(tx.chunk_documents(docs, 50, 5), "doc_id", "chunk_index")
    assert whole == rows(tx.chunk(tx.sections(docs), 50, 5), "doc_id", "chunk_index") and len(whole) > 5000
    assert "Exchange" not in tx.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(1, 0, None, "x"), (1, 1, ["a"], None)], "doc_id long, section_no int, heading_path array<string>, markdown string")
    assert rows(tx.chunk(odd), "chunk_index") == [(1, 0, "", "x", 1)]


def _plain(a, b):
    out = []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        out += [("context", x) for x in a[i1:i2]] if op == "equal" else [("removed", x) for x in a[i1:i2]] + [("added", x) for x in b[j1:j2]]
    return out


@pytest.mark.parametrize("direct", [0, 4096])
def test_line_diff_aligns_like_longest_runs_first(monkeypatch, direct):
    monkeypatch.setattr(linediff, "DIRECT", direct)
    rnd = random.Random(direct)
    for _ in range(150):
        a = [str(rnd.randrange(rnd.choice([2, 5, 40]))) for _ in range(rnd.randrange(60))]
        b = list(a) if rnd.random() < 0.7 else [str(rnd.randrange(5)) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(12)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(3)] = [str(rnd.randrange(40)) for _ in range(rnd.randrange(3))]
        got = linediff.diff_lines("\n".join(a), "\n".join(b))
        assert got == _plain(a, b)


def test_line_diff_of_long_versions(spark):
    rnd = random.Random(1)
    a = [rnd.choice(["", "}", f"line {i}"]) for i in range(100_000)]
    few = list(a)
    for _ in range(40):
        few[rnd.randrange(len(few))] = "changed"
    shuffled = rnd.sample(a, len(a))
    began = time.time()
    for b in (few, shuffled, ["x"] * 100_000, [x if i % 2 else f"new {i}" for i, x in enumerate(a)]):
        got = linediff.diff_lines("\n".join(a), "\n".join(b))
        assert [x for k, x in got if k != "added"] == "\n".join(a).splitlines() and [x for k, x in got if k != "removed"] == "\n".join(b).splitlines()
    assert time.time() - began < 60
    versions = [(1, 1, None), (1, 2, "a\nb"), (1, 3, None), (1, 4, ""), (2, 1, "x"), (2, 2, "x")]
    df = spark.createDataFrame(versions, "document_id long, version_no int, content string").withColumn("before", F.lit(1))
    assert rows(an.version_diff(df), "document_id", "version_no", "line_no") == [(1, 2, 0, "added", "a"), (1, 2, 1, "added", "b"), (1, 3, 0, "removed", "a"), (1, 3, 1, "removed", "b"), (2, 2, 0, "context", "x")]


def test_updates_of_one_key_are_defined(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n long")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 1), (2, None, 9), (3, "x", 1), (3, "x", 1)], "k long, v string, n long").repartition(3)
    assert rows(storage.upsert(a, new, "k"), "k") == [(1, "a", 1), (2, "d", 1), (3, "x", 1)]
    assert rows(storage.upsert(a.select("k"), new.select("k"), "k"), "k") == [(1,), (2,), (3,)]


def test_token_windows_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "a b c d e f"), (5, "中文, x")], "doc_id long, text string")
    assert rows(tx.token_windows(docs, "doc_id", 3, 1), "doc_id", "window_no") == [(3, 0, "a b c", 3), (4, 0, "a b c", 3), (4, 1, "c d e", 3), (4, 2, "e f", 2), (5, 0, "中 文 ,", 3), (5, 1, ", x", 2)]
