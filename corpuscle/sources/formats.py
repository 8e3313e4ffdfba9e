"""Document formats: a registry of parsers, the Markdown and HTML jobs, and image references.

A parser is a small function from bytes to (title, text). Rows are split by media type, and each format's rows go through one
Arrow job; what can't be parsed is a row with a reason, not an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import urls as ux

Parser = Callable[[bytes], tuple[str | None, str]]


@dataclass(frozen=True)
class Format:
    """A document format. ``validate`` looks at the bytes before they are parsed and gives a reason against them, or None."""

    name: str
    media_type: str
    extensions: tuple[str, ...]
    parse: Parser
    content_types: tuple[str, ...] = ()
    magic: bytes | None = None
    validate: Callable[[bytes], str | None] | None = None
    builtin: bool = False

    def refusal(self, raw: bytes) -> str | None:
        if self.magic is not None and not raw.startswith(self.magic):
            return f"not {self.name}"
        return self.validate(raw) if self.validate is not None else None


FORMATS: dict[str, Format] = {}


def register_format(media_type: str, parser: Parser, name: str = "", extensions: tuple[str, ...] = (), **more) -> Format:
    """Add a format, or put another in place of one that isn't built in. An extension or content type belongs to one format."""
    entry = Format(name or media_type, media_type, tuple(x.lower().lstrip(".") for x in extensions), parser, **more)
    if media_type in FORMATS and FORMATS[media_type].builtin:
        raise ValueError(f"{media_type} is built in")
    taken = {x for f in FORMATS.values() if f.media_type != media_type for x in (*f.extensions, f.media_type, *f.content_types)}
    if clash := taken.intersection((*entry.extensions, media_type, *entry.content_types)):
        raise ValueError(f"{', '.join(sorted(clash))} belongs to another format")
    FORMATS[media_type] = entry
    return entry


def media_type_of(media_type: Column, path: Column) -> Column:
    """The media type of a registered format: by the declared type without its parameters, else, where none is declared, by the extension."""
    declared = F.lower(F.trim(F.regexp_replace(media_type, ";.*$", "")))
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    named = F.when(declared == "", None)
    for f in FORMATS.values():
        named = named.when(declared.isin(f.media_type, *f.content_types), f.media_type)
    ended = F.when(F.lit(False), None)
    for f in FORMATS.values():
        ended = ended.when(extension.isin(*f.extensions), f.media_type) if f.extensions else ended
    return F.when(F.coalesce(declared, F.lit("")) != "", named).otherwise(ended)


def parse_markdown(raw: bytes) -> tuple[str | None, str]:
    """UTF-8 with or without BOM; the title is the first level-1 heading outside fences."""
    text, fence, title = raw.decode("utf-8-sig"), False, None
    for line in text.splitlines():
        if line.startswith(("```", "~~~")):
            fence = not fence
        elif not fence and (m := re.match(r"#\s+(.+?)\s*$", line)):
            title = m[1].strip().rstrip("#").strip()
            break
    return title, text


# Tags and attributes that mark what isn't the page's own text.
_DROPPED = frozenset(("script", "style", "nav", "footer", "aside", "template"))
_INVISIBLE = frozenset(("display:none", "visibility:hidden"))
_NOISE_TAGS = frozenset(("form", "iframe", "noscript", "svg", "canvas", "button"))
_NOISE_ROLES = frozenset(("navigation", "banner", "complementary", "contentinfo", "search", "menu", "menubar", "dialog", "alert"))
# Names of elements that aren't, or are, the article.
_IS_NOISE = re.compile(
    r"(?:^|[-_ ])(?:nav(?:igation)?|menu|sidebar|footer|comment|comments|share|social|related|recommend|breadcrumb|pagination|toolbar|advert|ads?|promo|cookie|subscribe|newsletter|login|signup|banner)(?:$|[-_ ])", re.IGNORECASE
)
_IS_MAIN = re.compile(r"article|content|post|entry|main|story|markdown|rich_?text", re.IGNORECASE)
# How containers are rated.
_CONTAINERS, _INNER = frozenset(("article", "main", "div", "section", "td")), frozenset(("article", "main", "div", "section"))
_LEAST_TEXT, _OF_PARENT, _OF_PAGE = 200, 0.8, 0.15
_MAIN_NAME, _MAIN_TAG, _NOISE_NAME = 1.4, 1.5, 0.25

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_BLOCK = frozenset(("p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article", "table", "ul", "ol", "td", "th", "dt", "dd", "main"))


class _Node:
    """An element: its parts in order, and how much text and linked text lie below it."""

    __slots__ = ("chars", "linked", "name", "parts", "pieces", "role", "tag")

    def __init__(self, tag: str, name: str = "", role: str = ""):
        self.tag, self.name, self.role = tag, name, role
        self.parts: list[str | _Node] = []
        self.chars = self.pieces = self.linked = 0

    @property
    def length(self) -> int:
        """Characters of its text with one blank between the pieces."""
        return self.chars + max(0, self.pieces - 1)

    def take(self, child: _Node) -> None:
        self.parts.append(child)
        self.chars += child.chars
        self.pieces += child.pieces
        self.linked += child.linked + (child.length if child.tag == "a" else 0)

    @property
    def noise(self) -> bool:
        return self.tag in _NOISE_TAGS or self.role in _NOISE_ROLES or bool(_IS_NOISE.search(self.name))

    @property
    def rate(self) -> float:
        """Text outside links, more for what is named like an article, less for what is named like decoration."""
        own = self.length * (1 - min(1.0, self.linked / max(1, self.length)))
        own *= _MAIN_NAME if _IS_MAIN.search(self.name) else 1
        own *= _MAIN_TAG if self.tag in ("article", "main") else 1
        return own * (_NOISE_NAME if _IS_NOISE.search(self.name) else 1)

    def text(self, skip: Callable[[_Node], bool]) -> str:
        """Lines of text; blocks end lines. Nodes of ``skip`` are left out. Not recursive, as pages may nest deeply."""
        out: list[str] = []
        todo: list[str | _Node] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or not skip(x):
                edge = ["\n"] if x.tag in _BLOCK else []
                todo += [*edge, *reversed(x.parts), *edge]
        lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)


class _Page(HTMLParser):
    """The tree of a page without hidden and boilerplate elements; ``closed`` lists its elements as they end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("")
        self.open: list[tuple[_Node, bool]] = [(self.root, False)]
        self.closed: list[_Node] = []
        self.depth: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        style = {d.removesuffix("!important") for d in "".join(a.get("style", "").lower().split()).split(";")}
        hidden = tag in _DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or not _INVISIBLE.isdisjoint(style)
        self.open.append((_Node(tag, f"{a.get('id', '')} {' '.join(a.get('class', '').split())}".strip(), a.get("role", "").lower()), hidden or self.open[-1][1]))
        self.depth[tag] += 1
        if tag in _VOID:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if self.depth[tag]:
            while self.open[-1][0].tag != tag:
                self._end()
            self._end()

    def _end(self) -> None:
        node, hidden = self.open.pop()
        self.depth[node.tag] -= 1
        if not hidden:
            self.open[-1][0].take(node)
            self.closed.append(node)

    def handle_data(self, data: str) -> None:
        node = self.open[-1][0]
        node.parts.append(data)
        if piece := data.strip():
            node.chars += len(piece)
            node.pieces += 1

    def close(self) -> None:
        super().close()
        while len(self.open) > 1:
            self._end()


def _container(page: _Page) -> _Node | None:
    """The best rated container, narrowed while one part holds most of its text; None if it is too small a part of the page."""
    best = max((n for n in page.closed if n.tag in _CONTAINERS and n.length >= _LEAST_TEXT), key=lambda n: (n.rate, n.length), default=None)
    inner = best
    while inner is not None:
        best, least = inner, max(_LEAST_TEXT, inner.length * _OF_PARENT)
        inner = max((x for x in best.parts if isinstance(x, _Node) and x.tag in _INNER and x.length >= least), key=lambda x: x.length, default=None)
    body = next((n for n in page.closed if n.tag == "body"), page.root)
    return best if best is not None and best.length >= max(_LEAST_TEXT, body.length * _OF_PAGE) else None


def parse_html(raw: bytes) -> tuple[str | None, str]:
    """Title (first h1 with text, else <title>) and the text of the main container without noise, else of the whole page."""
    page = _Page()
    page.feed(raw.decode("utf-8", "replace"))
    page.close()
    found = {tag: next((n for n in page.closed if n.tag == tag and n.length), None) for tag in ("h1", "title")}
    title = found["h1"] or found["title"]
    box = _container(page)
    text = page.root.text(lambda n: n.tag in ("head", "title")) if box is None else box.text(lambda n: n.noise)
    return title.text(lambda n: False).replace("\n", " ") if title else None, text


def _utf8(raw: bytes) -> None:
    raw.decode("utf-8")  # what can't be decoded is a reject of its own


register_format("text/markdown", parse_markdown, "markdown", ("md", "markdown"), content_types=("text/x-markdown", "text/plain"), validate=_utf8, builtin=True)
register_format("text/html", parse_html, "html", ("html", "htm"), content_types=("application/xhtml+xml",), validate=_utf8, builtin=True)

_PARSED = "path string, title string, text string, reject string"


def _job(form: Format):
    def one(raw: bytes | None) -> tuple[str | None, str | None, str | None]:
        if raw is None:
            return None, None, "no content"
        try:
            raw = bytes(raw)
            if reason := form.refusal(raw):
                return None, None, f"invalid: {reason}"[:200]
            return *form.parse(raw), None
        except UnicodeDecodeError:
            return None, None, "undecodable"
        except ValueError as e:
            return None, None, f"invalid: {e}"[:200]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(path, *one(raw)) for path, raw in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(out, columns=["path", "title", "text", "reject"])

    return run


def parse_files(files: DataFrame) -> DataFrame:
    """path, title, text, reject of files (path, media_type, content).

    The format goes by the media type or, without one, by the extension. Rejects: unsupported (no format), no content (null), undecodable,
    invalid with the parser's or the format's reason.
    """
    null = F.lit(None).cast("string")
    files = files.withColumn("_type", media_type_of(F.col("media_type"), F.col("path")))
    out = files.where("_type is null").select("path", null.alias("title"), null.alias("text"), F.lit("unsupported").alias("reject"))
    for media_type, form in FORMATS.items():
        out = out.unionByName(files.where(F.col("_type") == media_type).select("path", "content").mapInPandas(_job(form), _PARSED))
    return out


def read_markdown(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) as Markdown documents; the file name stands in for a missing title, null content is a reject."""
    got = files.select("path", "content").mapInPandas(_job(FORMATS["text/markdown"]), _PARSED)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return got.withColumn("title", F.coalesce("title", F.when(F.col("reject").isNull(), name)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, text of pages (page_id, html); null html is an empty page."""
    rows = pages.select(F.col("page_id").cast("string").alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return rows.mapInPandas(_job(Format("page", "text/html", (), parse_html)), _PARSED).select(F.col("path").cast("long").alias("page_id"), "title", "text")


# Parts of a path that mark decoration, and attributes that lazy pages use.
DECORATIVE = ("/icon", "sprite", "logo", "/static/", "favicon", "avatar", "badge")
LAZY = ("data-src", "data-original", "data-lazy-src", "src")
#: Declared widths below this are decoration.
LEAST_WIDTH = 100


def _largest(srcset: str) -> str | None:
    """The candidate of largest width; a density x counts as x * 1000."""
    best = None
    for part in srcset.split(","):
        bits = part.split()
        if not bits or bits[0].startswith("data:"):
            continue
        size = 0.0
        if len(bits) > 1 and (m := re.fullmatch(r"([\d.]+)([wx])", bits[1])):
            size = float(m[1]) * (1000 if m[2] == "x" else 1)
        if best is None or size > best[0]:
            best = (size, bits[0])
    return best[1] if best else None


class _References(HTMLParser):
    """The links and images of a page in one pass; what stands in comments, scripts and styles isn't markup, and attributes are unescaped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, int | None]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ("a", "img"):
            return
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "a":
            if "href" in a:
                self.found.append(("link", a["href"], None))
            return
        src = _largest(a.get("srcset", "")) or next((a[k] for k in LAZY if a.get(k) and not a[k].startswith("data:")), None)
        if src:
            width = re.match(r"\d+", a.get("width", ""))
            self.found.append(("image", src, int(width[0]) if width else None))


def references(pages: DataFrame) -> DataFrame:
    """page_id, base, kind (link or image), n, value, width: what each page (page_id, url, html) refers to, n from 0 by kind; null html refers to nothing."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for page, url, text in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                parser, n = _References(), Counter[str]()
                parser.feed(text or "")
                parser.close()
                for kind, value, width in parser.found:
                    out.append((page, url, kind, n[kind], value, width))
                    n[kind] += 1
            yield pd.DataFrame(out, columns=["page_id", "base", "kind", "n", "value", "width"]).astype({"width": "Int64"})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, base string, kind string, n int, value string, width int")


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, link_no, link: anchors resolved against the page and made canonical; what can't be is dropped."""
    rows = references(pages).where("kind = 'link'")
    return rows.select("page_id", F.col("n").alias("link_no"), ux.canonical_url(ux.resolve(F.trim(F.regexp_replace("value", r"[\t\r\n]", "")), F.col("base"))).alias("link")).where("link is not null")


def extract_images(pages: DataFrame) -> DataFrame:
    """page_id, image, references, rejected (reason or null): distinct absolute image URLs of each page."""
    rows = references(pages).where("kind = 'image'")
    refs = rows.select("page_id", "n", "width", F.regexp_replace(ux.resolve(F.col("value"), F.col("base")), "#.*$", "").alias("image")).where("image is not null")
    one = refs.groupBy("page_id", "image").agg(F.count("*").alias("references"), F.max("width").alias("width"), F.min("n").alias("n"))
    path = F.lower(F.regexp_extract("image", r"^https?://[^/?#]*([^?#]*)", 1))
    host = F.lower(F.regexp_extract("image", r"^https?://([^/?#:]*)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)|\.(local|internal)$")
    reason = (
        F.when((path.endswith(".svg") | path.endswith(".svgz")), "svg")
        .when(private, "private_host")
        .when(path.rlike("|".join(map(re.escape, DECORATIVE))), "decorative")
        .when((F.col("width") > 0) & (F.col("width") < LEAST_WIDTH), "too_small")
    )
    return one.select("page_id", "n", "image", "references", reason.alias("rejected"))


Embedder = Callable[[list[str]], list[list[float]]]


def embed_with(rows: DataFrame, embedder: Embedder, dim: int, text: str = "text") -> DataFrame:
    """rows with ``embedding`` from a plug-in that maps a batch of texts to vectors; a wrong dimension is an error."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            got = embedder([t or "" for t in p])
            if len(got) != len(p) or any(len(v) != dim for v in got):
                raise ValueError(f"the embedder must give one vector of {dim} values for each text")
            yield pd.Series(got)

    return rows.withColumn("embedding", embed(text))
