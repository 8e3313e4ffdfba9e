"""Overlap and repetition analytics, text quality reports, and the document graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.operators.linediff import diff_lines

#: Lower-cased overlap tokens: a CJK character or a word of letters and digits.
OVERLAP_TOKEN = r"[一-鿿]|[a-z0-9]+"


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(OVERLAP_TOKEN), F.lit(0)))


def repeated_assets(rasters: DataFrame, least: int = 3, ratio: float = 0.1) -> DataFrame:
    """Digests that occur at least ``least`` times, each time on at most ``ratio`` of its page."""
    return rasters.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("area_ratio").alias("most")).where((F.col("n") >= least) & (F.col("most") <= ratio)).select("digest", "n")


def markers(rasters: DataFrame, repeated: DataFrame) -> DataFrame:
    """figure_id, is_marker: it has rasters, some digest, and all its digests are repeated small assets."""
    r = rasters.join(repeated.select("digest", F.lit(True).alias("small")), "digest", "left")
    some = F.count("digest") > 0
    return r.groupBy("figure_id").agg((some & F.bool_and(F.col("digest").isNull() | F.coalesce("small", F.lit(False)))).alias("is_marker"))


def assign_by_overlap(figures: DataFrame, sections: DataFrame) -> DataFrame:
    """figure_id, section_no, share: the section that holds most of the figure's tokens; least number on ties, 0 without any.

    Tokens are the join key, so figures never meet sections that share none. figures: figure_id, document_id, text.
    """
    f = figures.select("figure_id", "document_id", token_set(F.col("text")).alias("t"))
    ft = f.select("figure_id", "document_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    st = sections.select("document_id", "section_no", F.explode(token_set(F.col("text"))).alias("token"))
    hits = ft.join(st, ["document_id", "token"]).groupBy("figure_id", "section_no").agg(F.round(F.count("*") / F.first("n"), 6).alias("share"))
    best = hits.groupBy("figure_id").agg(F.max(F.struct("share", (-F.col("section_no")).alias("m"))).alias("b"))
    return figures.select("figure_id").join(best, "figure_id", "left").select("figure_id", F.coalesce(-F.col("b.m"), F.lit(0)).cast("long").alias("section_no"), F.coalesce("b.share", F.lit(0.0)).alias("share"))


def merge_novel(texts: DataFrame, least: float = 0.4) -> DataFrame:
    """document_id, text, kept: texts in order (position, text), each appended if enough of its token set is new; the seen set grows.

    A fold over the sorted rows of a document as they stream by: what is held is its seen tokens and the result. A text
    without tokens, such as null, is never appended.
    """
    kind = texts.schema["document_id"].dataType.simpleString()

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen, kept = None, set(), []
        row = lambda: pd.DataFrame({"document_id": [at], "text": ["\n\n".join(kept)], "kept": [len(kept)]})
        begun = False
        for pdf in it:
            for doc, text, tokens in zip(pdf["document_id"], pdf["text"], pdf["t"], strict=True):
                doc = None if pd.isna(doc) else doc
                if not begun or doc != at:
                    if begun:
                        yield row()
                    at, seen, kept, begun = doc, set(), [], True
                new = [t for t in tokens if t not in seen]
                if len(tokens) and len(new) / len(tokens) >= least:
                    seen.update(new)
                    kept.append(text)
        if begun:
            yield row()

    rows = texts.select("document_id", "position", "text", token_set(F.col("text")).alias("t"))
    dealt = rows.repartition("document_id").sortWithinPartitions("document_id", "position", "text")
    return dealt.drop("position").mapInPandas(fold, f"document_id {kind}, text string, kept int")


def character_errors(pairs: DataFrame) -> DataFrame:
    """pairs (page_id, level, reference, hypothesis) with cer: edit distance of the texts without white space over the reference's length."""
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", "")
    r, h = bare("reference"), bare("hypothesis")
    return pairs.select("page_id", "level", F.when(F.length(r) == 0, 0.0).otherwise(F.levenshtein(r, h) / F.length(r)).alias("cer"))


def cer_report(pairs: DataFrame, base: int) -> DataFrame:
    """level, pages, mean, median (upper), and pages better, worse, equal against the base level."""
    c = character_errors(pairs)
    b = c.where(F.col("level") == base).select("page_id", F.col("cer").alias("base"))
    d = F.col("cer") - F.col("base")
    return (
        c.join(b, "page_id", "left")
        .groupBy("level")
        .agg(
            F.count("*").alias("pages"),
            F.round(F.avg("cer"), 6).alias("mean"),
            F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY cer DESC)"), 6).alias("median"),
            F.count_if(d < 0).alias("better"),
            F.count_if(d > 0).alias("worse"),
            F.count_if(d == 0).alias("equal"),
        )
    )


def build_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node_id, kind, label, owner; edges: source, target, kind) from titles, headings, citation marks and #tags.

    Nodes that several documents share have a null owner. docs: document_id, title, content.
    """
    me = F.concat(F.lit("document:"), F.col("document_id").cast("string"))
    heading = F.regexp_extract_all("content", F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1))
    cited = F.regexp_extract_all("content", F.lit(r"\[([SMW]\p{Nd}+)\]"), F.lit(1))
    tagged = F.regexp_extract_all("content", F.lit(r"(?:^|\s)#([\p{L}\p{N}_-]+)"), F.lit(1))
    parts = (("topic", "mentions", heading), ("citation", "references", cited), ("tag", "tags", tagged))

    def named(kind: str, edge: str, labels: Column) -> Column:
        return F.transform(F.array_distinct(labels), lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(edge).alias("edge"), v.alias("label")))

    found = F.concat(*[named(*p) for p in parts])
    links = docs.select(F.col("document_id").cast("string").alias("document_id"), me.alias("source"), F.inline(found)).withColumn("target", F.concat_ws(":", "kind", "label"))
    shared = links.groupBy("target", "kind", "label").agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("o"))
    own = docs.select(me.alias("node_id"), F.lit("document").alias("kind"), F.col("title").alias("label"), F.col("document_id").cast("string").alias("owner"))
    nodes = own.unionByName(shared.select(F.col("target").alias("node_id"), "kind", "label", F.when(F.col("n") == 1, F.col("o")).alias("owner")))
    return nodes, links.select("source", "target", F.col("edge").alias("kind")).distinct()


def drop_orphans(nodes: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes that have an edge or a live document."""
    used = edges.select(F.explode(F.array("source", "target")).alias("node_id")).unionByName(docs.select(F.concat(F.lit("document:"), F.col("document_id").cast("string")).alias("node_id"))).distinct()
    return nodes.join(used, "node_id", "left_semi")


def visible_graph(nodes: DataFrame, edges: DataFrame, archived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without archived documents. archived: document_id."""
    hidden = archived.select(F.concat(F.lit("document:"), F.col("document_id").cast("string")).alias("node_id"))
    e = edges.join(hidden.withColumnRenamed("node_id", "source"), "source", "left_anti").join(hidden.withColumnRenamed("node_id", "target"), "target", "left_anti")
    return nodes.join(hidden, "node_id", "left_anti"), e


def neighbors(edges: DataFrame) -> DataFrame:
    """node_id, neighbor, kind, outgoing: both directions of each edge, by one union."""
    out = edges.select(F.col("source").alias("node_id"), F.col("target").alias("neighbor"), "kind", F.lit(True).alias("outgoing"))
    return out.unionByName(edges.select(F.col("target").alias("node_id"), F.col("source").alias("neighbor"), "kind", F.lit(False).alias("outgoing")))


def version_diff(rows: DataFrame) -> DataFrame:
    """document_id, version_no, line_no, kind (context, added, removed), line of each version against the one before.

    rows: document_id, version_no, content; null content is a version without lines. The pair is built by a lag; the line diff itself is
    near-linear work on each pair, see ``linediff``.
    """
    order = Window.partitionBy("document_id").orderBy("version_no")
    pairs = rows.select("document_id", "version_no", F.lag("content").over(order).alias("before"), "content", F.row_number().over(order).alias("_n")).where("_n > 1").drop("_n")
    kind = rows.schema["document_id"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for doc, no, old, new in zip(pdf["document_id"], pdf["version_no"], pdf["before"], pdf["content"], strict=True):
                lines = diff_lines(old, new)
                for at in range(0, len(lines), 10_000):
                    part = lines[at : at + 10_000]
                    yield pd.DataFrame({"document_id": doc, "version_no": no, "line_no": range(at, at + len(part)), "kind": [k for k, _ in part], "line": [x for _, x in part]})

    return pairs.mapInPandas(run, f"document_id {kind}, version_no int, line_no int, kind string, line string")
