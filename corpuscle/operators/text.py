"""Text to rows: postings, counts, sections, chunks, windows, sentences, ids, segments, citations, embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import text as fx

MAX_TOKENS, OVERLAP = 800, 100
# Marks of an overview chunk.
OVERVIEW_PATH, OVERVIEW_TITLE = "文档概览", "标题："
_ABSTRACT = r"(?i)^(?:abstract|summary|摘要|概要|概述)(?![\p{L}\p{N}_])"


def postings(chunks: DataFrame, key: str, text: str = "text", mark: bool = False) -> DataFrame:
    """key, term, tf, dl: one row for each text and distinct token; with ``mark`` also ``first``, true on one row of each text.

    A row holds its whole text, so its tokens are counted inside it, as runs of the sorted array: nothing is shuffled.
    """

    def runs(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        row = lambda i, j: F.struct(F.get(t, i).alias("term"), (j - i).cast("long").alias("tf"), F.size(t).alias("dl"), *([(i == 0).alias("first")] if mark else []))
        return F.get(F.transform(F.array(at), lambda a: F.zip_with(a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.array(F.size(t))), row)), F.lit(0))

    counted = F.get(F.transform(F.array(F.sort_array(fx.search_tokens(F.col(text)))), runs), F.lit(0))
    return chunks.select(key, F.inline(counted))


def token_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, fx.token_count(F.col("text")).cast("long").alias("token_count"))


def token_windows(docs: DataFrame, key: str, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows of a text read as one unit: ``size`` tokens, stride size - overlap, the last reaches the end; null text has none."""
    stride = size - overlap

    def windows(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(t) - size) / stride)).cast("int")
        cut = lambda i: F.struct(F.array_join(F.slice(t, i * stride + 1, size), " ").alias("text"), F.least(F.lit(size), F.size(t) - i * stride).alias("token_count"))
        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), last), cut))

    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(fx.UNIT_TOKEN), F.lit(0))
    made = F.get(F.transform(F.array(tokens), windows), F.lit(0))  # bound in a lambda, so that a text is matched once
    return docs.select(key, F.posexplode(made).alias("window_no", "w")).select(key, "window_no", "w.text", "w.token_count")


def sentences(docs: DataFrame, key: str) -> DataFrame:
    parts = F.filter(F.split("text", r"(?<=[.!?。！？])\s+"), lambda s: s.rlike(r"\S"))
    return docs.select(key, F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))).alias("sentence_no", "sentence"))


def detect_language(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    lang = fx.language(F.col("text"))
    return docs.select(key, lang.alias("lang_detected"), fx.language_threshold(lang).alias("threshold"))


_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")


def split_sections(markdown: str | None) -> list[tuple[list[str], str]]:
    """(heading path, Markdown) of the sections of a text, in one scan over its lines; null has none."""
    out, path, start, fence = [], [], 0, False
    lines, own = (markdown or "").splitlines(), []
    for i, line in enumerate(lines):
        if line.startswith(("```", "~~~")):
            fence = not fence
        elif not fence and line.startswith("#") and (m := _HEADING.match(line)):
            out.append((own, lines[start:i]))
            path = [*path[: len(m[1]) - 1], m[2].strip().rstrip("#").strip()]
            own, start = path, i
    out.append((own, lines[start:]))
    return [(p, text) for p, part in out if (text := "\n".join(part).strip())]


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section_no, heading_path, markdown: split at ATX headings outside fences, in Arrow batches.

    Skipped levels stay as written, blank sections are dropped, text before the first heading has an empty path; null text has no sections.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(k, i, p, m) for k, text in zip(pdf[key], pdf["markdown"], strict=True) for i, (p, m) in enumerate(split_sections(text))]
            yield pd.DataFrame(out, columns=[key, "section_no", "heading_path", "markdown"])

    return docs.select(key, "markdown").mapInPandas(run, f"{key} {kind}, section_no int, heading_path array<string>, markdown string")


_UNIT = re.compile(r"[一-鿿]|[A-Za-z0-9_]+|[^\s\w]")
_FENCED = re.compile(r"(`{3,}|~{3,})([^\n]*)\n(.*)\n(`{3,}|~{3,})", re.DOTALL)


def _size(text: str) -> int:
    return len(_UNIT.findall(text))


def _units(text: str) -> list[str]:
    """Fenced blocks and paragraphs, in order."""
    out = []
    for part in re.split(r"(^```.*?^```\s*$|^~~~.*?^~~~\s*$)", text, flags=re.MULTILINE | re.DOTALL):
        fenced = part.lstrip().startswith(("```", "~~~"))
        out += [p.strip() for p in ([part] if fenced else re.split(r"\n\s*\n", part)) if p.strip()]
    return out


def _code_line(line: str, room: int) -> Iterator[str]:
    body = line.lstrip(" \t")
    indent, ends = line[: len(line) - len(body)], [m.end() for m in _UNIT.finditer(body)]
    at = 0
    for i in range(0, len(ends), room):
        end = len(body) if i + room >= len(ends) else ends[i + room - 1]
        yield indent + body[at:end].lstrip(" \t")
        at = end


def _oversized(text: str, most: int, overlap: int) -> list[str]:
    """A unit over the limit: fenced code is cut by lines and fenced again, other text by token windows."""
    m = _FENCED.fullmatch(text)
    if m and m[1][0] == m[4][0] and (room := most - _size(f"{m[1]}{m[2]}\n{m[4]}")) > 0:
        out, held, used = [], [], 0

        def close() -> None:
            if held:
                out.append("\n".join([m[1] + m[2], *held, m[4]]))
                held.clear()

        for line in m[3].splitlines():
            n = _size(line)
            if n > room or used + n > room:
                close()
                used = 0
            if n > room:
                out.extend("\n".join([m[1] + m[2], piece, m[4]]) for piece in _code_line(line, room))
            else:
                held.append(line)
                used += n
        close()
        return out
    tokens = _UNIT.findall(text)
    last = max(0, -(-(len(tokens) - most) // (most - overlap)))
    return [" ".join(tokens[i * (most - overlap) : i * (most - overlap) + most]) for i in range(last + 1)] if tokens else []


def pack(text: str | None, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Chunks of one section: whole if it fits, else its units packed greedily with a tail overlap; null has none."""
    text = (text or "").strip()
    if not text or _size(text) <= most:
        return [text] if text else []
    units = _units(text)
    if len(units) == 1:
        return _oversized(units[0], most, overlap)
    out, held, used = [], [], 0
    for unit in units:
        n = _size(unit)
        if n > most:
            if held:
                out.append("\n\n".join(held))
            held, used = [], 0
            out += _oversized(unit, most, overlap)
            continue
        if held and used + n > most:
            out.append("\n\n".join(held))
            k = min(overlap, most - n)
            tail = " ".join(_UNIT.findall(out[-1])[-k:]) if k > 0 else ""
            held, used = [tail] if tail else [], _size(tail)
        held.append(unit)
        used += n
    return [*out, "\n\n".join(held)] if held else out


def _chunks(parts: list[tuple[list[str], str]], most: int, overlap: int) -> list[tuple[str, str, int]]:
    return [(" > ".join(p), t, _size(t)) for p, m in parts for t in pack(m, most, overlap) if t.strip()]


def chunk(rows: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, section_path, text, token_count of sections (key, section_no, heading_path, markdown) from anywhere.

    Packing is greedy inside a section only, so sections are packed where they stand; numbering a document's chunks is the only
    shuffle. ``chunk_documents`` numbers them without one.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(k, s, i, *c) for k, s, p, m in zip(pdf[key], pdf["section_no"], pdf["heading_path"], pdf["markdown"], strict=True) for i, c in enumerate(_chunks([(p, m)], most, overlap))]
            yield pd.DataFrame(out, columns=[key, "section_no", "part", "section_path", "text", "token_count"])

    parts = rows.select(key, "section_no", F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"), "markdown").mapInPandas(run, f"{key} {kind}, section_no int, part int, section_path string, text string, token_count long")
    order = Window.partitionBy(key).orderBy("section_no", "part")
    return parts.select(key, (F.row_number().over(order) - 1).alias("chunk_index"), "section_path", "text", "token_count")


def chunk_documents(docs: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, section_path, text, token_count of documents (key, markdown): split, packed and numbered where they stand, without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                out = [(k, i, *c) for k, text in zip(part[key], part["markdown"], strict=True) for i, c in enumerate(_chunks(split_sections(text), most, overlap))]
                yield pd.DataFrame(out, columns=[key, "chunk_index", "section_path", "text", "token_count"])

    return docs.select(key, "markdown").mapInPandas(run, f"{key} {kind}, chunk_index int, section_path string, text string, token_count long")


def overview_chunks(rows: DataFrame, key: str = "doc_id", least: int = 400, most: int = 1200) -> DataFrame:
    """One overview of each document with over ``least`` characters: title line, then the abstract section (else the first), collapsed and cut."""
    strip = F.regexp_replace("markdown", r"^\s+|\s+$", "")
    is_abstract = F.array_join("heading_path", " > ").rlike(_ABSTRACT) | strip.rlike(_ABSTRACT)
    rank = F.struct((~is_abstract).cast("int").alias("a"), F.col("section_no").alias("b"))
    best = rows.groupBy(key).agg(F.first("title").alias("title"), F.min_by(strip, rank).alias("body"), F.sum(F.length(strip)).alias("size"))
    title = F.when(F.trim("title") != "", F.concat(F.lit(OVERVIEW_TITLE), F.trim("title")))
    body = F.substring(fx.collapse(F.col("body")), 1, most)
    return best.where(F.col("size") > least).select(key, F.lit(-1).alias("chunk_index"), F.lit(OVERVIEW_PATH).alias("section_path"), F.concat_ws("\n", title, F.when(body != "", body)).alias("text"))


#: Fixed value: the URL name space of RFC 4122, as hex.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5, URL name space) of a string, from SHA-1 alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def with_chunk_ids(chunks: DataFrame, stage: str = "sync") -> DataFrame:
    """chunks (document_id, chunk_index, text) with a deterministic chunk_id."""
    name = F.concat_ws(":", F.col("document_id").cast("string"), F.lit(stage), F.col("chunk_index").cast("string"), F.sha2("text", 256))
    return chunks.withColumn("chunk_id", uuid5(name))


def segment_conversations(rows: DataFrame, messages: int = 100, chars: int = 7800) -> DataFrame:
    """conv_id, segment_no, first_turn, last_turn, text: ``role: content`` lines packed greedily up to the limits.

    A fold over the sorted rows of a conversation as they stream by: what is held is the open segment. A message without text
    gives its role alone.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    line = F.substring(F.concat_ws(": ", "role", "text"), 1, chars)

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, no, held, used, begun = None, 0, [], 0, False
        for pdf in it:
            out = []
            for conv, turn, text in zip(pdf["conv_id"], pdf["turn"], pdf["line"], strict=True):
                conv = None if pd.isna(conv) else conv
                other = begun and conv != at
                extra = len(text) + (1 if held else 0)
                if held and (other or len(held) >= messages or used + extra > chars):
                    out.append((at, no, held[0][0], held[-1][0], "\n".join(x for _, x in held)))
                    no, held, used, extra = no + 1, [], 0, len(text)
                at, no, begun = conv, 0 if other else no, True
                held.append((turn, text))
                used += extra
            yield pd.DataFrame(out, columns=["conv_id", "segment_no", "first_turn", "last_turn", "text"])
        if held:
            yield pd.DataFrame([(at, no, held[0][0], held[-1][0], "\n".join(x for _, x in held))], columns=["conv_id", "segment_no", "first_turn", "last_turn", "text"])

    dealt = rows.select("conv_id", "turn", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "line")
    return dealt.mapInPandas(fold, f"conv_id {kind}, segment_no int, first_turn long, last_turn long, text string")


def topics(docs: DataFrame, key: str = "doc_id", most: int = 20) -> DataFrame:
    """First lines that start with # or ``- ``, marks stripped."""
    lines = F.filter(F.transform(F.split("markdown", _LINE_END), lambda s: F.trim(s)), lambda s: s.startswith("#") | s.startswith("- "))
    names = F.filter(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, "^[#\\- ]+", ""))), lambda s: s != "")
    return docs.select(key, F.posexplode(F.slice(names, 1, most)).alias("topic_no", "topic"))


def citations(answers: DataFrame) -> DataFrame:
    """answer_id, position, source_id: known marks [S1] [M2] [W3], not doubled, distinct, in order of first occurrence."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!\[)\[([SMW][1-9]\p{Nd}*)\](?!\])"), F.lit(1)))
    return answers.select("answer_id", F.posexplode(F.array_intersect(found, "source_ids")).alias("position", "source_id"))


#: A URL ends at white space or one of these; a dot or colon ends it unless what follows can go on.
_STOP = r"\s，。！？、；;）)\]}>,'\"‘’“”"


def redact_urls(rows: DataFrame) -> DataFrame:
    """text without its http(s) URLs. In the path a colon ends the URL; a dot there goes on only before a lower-case letter or digit."""
    path = rf"(?i:https?://)((?:[^{_STOP}/?#.:]|\.(?=[A-Za-z0-9-])|:(?=[0-9]))*)([/?#](?:[^{_STOP}.:]|\.(?=[a-z0-9]))*)?"
    return rows.withColumn("text", F.regexp_replace("text", path, ""))


def hash_vector(text: str, dim: int) -> np.ndarray:
    v = np.zeros(dim)
    for token in re.findall(r"@?\w+", text.lower()):
        bucket = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=2).digest(), "big") % dim
        v[bucket] += 12.0 if token.startswith("@") else 1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def embed_hash(rows: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """rows with ``embedding``: hashed token counts of unit length; a text without tokens stays zero."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([hash_vector(t or "", dim).astype(np.float32) for t in p])

    return rows.withColumn("embedding", embed(text))


def clean_variants(rows: DataFrame, most: int = 3, chars: int = 200) -> DataFrame:
    """request_id, position, query: collapsed and cut, distinct without case (first kept), at most ``most``."""
    q = rows.select("request_id", "variant_no", F.substring(fx.collapse(F.col("query")), 1, chars).alias("query")).where("query <> ''")
    first = q.withColumn("_r", F.row_number().over(Window.partitionBy("request_id", F.lower("query")).orderBy("variant_no"))).where("_r = 1")
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("variant_no"))
    return first.select("request_id", n.alias("position"), "query").where(F.col("position") <= most)
