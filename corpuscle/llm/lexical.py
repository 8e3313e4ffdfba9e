"""Ranked lexical search with per-term geometric blocking (op 11).

Documents become sparse vectors: an integer impact for each term that any item asks for. They are dealt in the order of a sketch
(signs of a projection by term hashes), so that similar ones lie together, and cut into shards bounded by their postings. Each
shard has its own posting lists. Every list of at least LONG documents is clustered by their similarity (nearest of evenly
drawn centroids of the projected vectors) into blocks of at most BLOCK, and each block keeps the coordinatewise maximum of its
documents' impacts over the shard's long terms, rounded up. A shorter list is one block that is never skipped.

For an item, a shard is skipped if even its own maxima stay below the item's threshold (the k-th best score known). Within a
shard, the weakest terms whose maxima together stay below it aren't entered. Of the entered terms the short lists are scored
first; a document that is left then has none of their terms, so a block's bound is its summary weighed by the item's long terms, plus the
maxima of short terms that weren't entered. A block is skipped only if that bound stays below the threshold; documents of the
others are scored exactly, best bounds first. The threshold starts from the shard with the best bound for
the item, which is searched in a pass of its own, so it never exceeds the true k-th score and the result is exact.

Items are searched ITEM_BLOCK at a time against all shards; a block's terms and weights are broadcast, 16 bytes a term.

Defined results: null text has no terms; rows without doc_id count in the statistics and aren't ranked; rows with one doc_id are
documents of their own, each with its rank; items with one item_id are one item with all their terms, items without id or terms
have no result; equal scores go to the smaller doc_id; texts of any length count whole (read in stretches); empty tables give an empty
result; other columns of the input are ignored. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.common import KeyFilter, key_filter, materialise
from corpuscle.llm.lexemes import runs

K = 50
#: Documents of a block, documents from which a list is long, and postings of a shard (one document may have more).
BLOCK, LONG, SHARD_POSTINGS = 256, 32, 1 << 18
#: Dimensions of the projection; the first SKETCH_BITS of its signs order the documents.
DIMENSIONS, SKETCH_BITS = 32, 24
#: Block maxima are kept in units of this impact, rounded up.
UNIT = 4096
#: Items searched in one pass over the index.
ITEM_BLOCK = 1 << 16
#: Blocks scored before the threshold is looked at again.
ROUND = 8


def _signs(terms: np.ndarray) -> np.ndarray:
    bits = np.arange(DIMENSIONS, dtype=np.int64) + 8
    return ((terms[:, None] >> bits & 1) * 2 - 1).astype(np.float32)


def _counted(batch: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text's place, hash, count) of distinct terms in each run, for texts in order; a long text comes in several parts."""
    for owner, lap, lex in runs(batch):
        h = lex.hashes().view(np.int64)
        for i, again, a, b in zip(owner.tolist(), lap.tolist(), lex.off[:-1].tolist(), lex.off[1:].tolist(), strict=True):
            yield (i, *np.unique(h[a + again : b], return_counts=True))


def term_vectors(docs: DataFrame, wanted: KeyFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (terms with repeats), sketch, terms, tfs (of distinct terms that the filter lets through) of each row."""
    fields = [pa.field("key", pa.int64()), pa.field("n", pa.int64()), pa.field("sketch", pa.int64()), pa.field("terms", pa.list_(pa.int64())), pa.field("tfs", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = np.zeros(part.num_rows, dtype=np.int64)
                kept: list[list] = [[] for _ in n]
                for i, terms, count in _counted(part.column(1).cast(pa.binary()).to_pylist()):
                    n[i] += count.sum()
                    hit = wanted.hit(terms)
                    kept[i].append((terms[hit], count[hit]))
                terms, tfs, sketch = [], [], []
                for found in kept:
                    t, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
                    if len(found) > 1:
                        t, back = np.unique(t, return_inverse=True)
                        c = np.bincount(back, weights=c).astype(np.int64)
                    side = np.sqrt(c, dtype=np.float32) @ _signs(t) > 0
                    sketch.append(int(np.packbits(side[:SKETCH_BITS]).astype(np.int64) @ (256 ** np.arange(SKETCH_BITS // 8)[::-1])))
                    terms.append(t)
                    tfs.append(c)
                arrays = [part.column(0), pa.array(n), pa.array(sketch, pa.int64()), _lists(terms, pa.int64()), _lists(tfs, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text))
    return rows.mapInArrow(run, "key long, n long, sketch long, terms array<long>, tfs array<int>")


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, term: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, terms, _ in _counted(batch.column(1).cast(pa.binary()).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(terms), i))), pa.array(terms)], names=["item", "term"])

    return items.select(F.col(key).cast("long").alias("item"), F.col(text)).where("item is not null").mapInArrow(run, "item long, term long").distinct()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else [], kind, safe=False))


def _spans(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``rows`` in lists that begin at ``at``, one list after the other, and where each begins."""
    size = at[rows + 1] - at[rows]
    first = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(at[rows] - first, size), first


#: Columns of a shard, as bytes of these types. ``*_at`` are offsets: documents -> entries (forward index), terms -> list_doc, blocks -> list_doc.
_TYPES = {
    "docs": "<i8", "vocabulary": "<i8", "peak": "<i4", "fwd_at": "<i4", "fwd_term": "<i4", "fwd_impact": "<i4", "list_at": "<i4", "list_doc": "<i4",
    "long_term": "<i4", "block_at": "<i4", "block_col": "<i4", "summary": "u1",
}
_SHARD = "shard long, " + ", ".join(f"{c} binary" for c in _TYPES)


def _clusters(place: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of a list's documents by the nearest of evenly drawn centroids, and the sizes of its blocks."""
    n = -(-len(place) // BLOCK)
    if n == 1:
        return np.arange(len(place)), [len(place)]
    nearest = np.argmax(place @ place[np.arange(n) * len(place) // n].T, axis=1)
    return np.argsort(nearest, kind="stable"), [min(BLOCK, c - a) for c in np.bincount(nearest).tolist() for a in range(0, c, BLOCK)]


def build_shard(keys: np.ndarray, at: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> dict[str, np.ndarray]:
    """Forward index, clustered posting lists and block summaries of the documents whose entries begin at ``at``."""
    vocabulary, local = np.unique(terms, return_inverse=True)
    size, df = np.diff(at), np.bincount(local, minlength=len(vocabulary))
    weight = (impact * np.log1p(len(keys) / df)[local]).astype(np.float32)
    place = np.zeros((len(keys), DIMENSIONS), dtype=np.float32)
    some, signs = np.flatnonzero(size), _signs(vocabulary)
    for a in range(0, len(some), 512):  # bounds the temporaries
        part = some[a : a + 512]
        idx, first = _spans(at, part)
        place[part] = np.add.reduceat(signs[local[idx]] * weight[idx, None], first)
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)

    list_at = np.concatenate([[0], np.cumsum(df)])
    list_doc = np.repeat(np.arange(len(keys)), size)[np.argsort(local, kind="stable")]
    long_term = np.flatnonzero(df >= LONG)
    block_size, block_col = [], []
    for col, t in enumerate(long_term.tolist()):
        docs = list_doc[list_at[t] : list_at[t + 1]]
        order, sizes = _clusters(place[docs])
        list_doc[list_at[t] : list_at[t + 1]] = docs[order]
        block_size += sizes
        block_col += [col] * len(sizes)
    block_col = np.array(block_col, dtype=np.int64)
    done = np.cumsum(block_size, dtype=np.int64) - np.array(block_size, dtype=np.int64)
    # blocks of a list follow each other within it, but short lists lie between long ones
    skipped = np.concatenate([[0], np.cumsum(df[long_term])])[:-1]
    block_at = list_at[long_term[block_col]] + done - skipped[block_col]

    col_of = np.full(len(vocabulary), -1)
    col_of[long_term] = np.arange(len(long_term))
    kept = col_of[local] >= 0
    long_at = np.concatenate([[0], np.cumsum(kept)])[at]
    column, top = col_of[local[kept]], (-(-impact[kept] // UNIT)).astype(np.uint8)
    summary = np.zeros((len(block_size), len(long_term)), dtype=np.uint8)
    for row, a, n in zip(summary, block_at.tolist(), block_size, strict=True):
        idx, _ = _spans(long_at, list_doc[a : a + n])
        np.maximum.at(row, column[idx], top[idx])
    peak = np.zeros(len(vocabulary), dtype=np.int64)
    np.maximum.at(peak, local, impact)
    ends = np.stack([block_at, block_at + np.array(block_size, dtype=np.int64)]) if block_size else np.empty((2, 0))
    return {
        "docs": keys, "vocabulary": vocabulary, "peak": peak, "fwd_at": at, "fwd_term": local, "fwd_impact": impact, "list_at": list_at, "list_doc": list_doc,
        "long_term": long_term, "block_at": ends, "block_col": block_col, "summary": summary,
    }


def build_index(vectors: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """One row per shard of the documents in ``vectors`` that have an id and a term that counts."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        keys, n, terms, tfs = zip(*held, strict=True)
        at = np.concatenate([[0], np.cumsum([len(t) for t in terms], dtype=np.int64)])
        m = np.repeat(50 + 50 * np.array(n) * n_docs // n_terms, np.diff(at))
        tf = np.concatenate(tfs).astype(np.int64)
        shard = build_shard(np.array(keys), at, np.concatenate(terms), 1_000_000_000 * tf // (1000 * tf + 20 * m))
        return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *(pa.array([shard[c].astype(t).tobytes()], pa.binary()) for c, t in _TYPES.items())], names=["shard", *_TYPES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column("terms"), batch.column("tfs"))]
            for i, (key, n) in enumerate(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                terms, tfs = (values[at[i] : at[i + 1]] for at, values in lists)
                if held and entries + len(terms) > SHARD_POSTINGS:
                    yield rows(held)
                    held, entries = [], 0
                held.append((key, n, terms, tfs))
                entries += len(terms)
        if held:
            yield rows(held)

    order = ["sketch", "row"]  # copies share a sketch, so the row spreads them
    usable = vectors.where(F.col("key").isNotNull() & (F.size("terms") > 0)).select("key", "n", "terms", "tfs", *order)
    dealt = usable.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _SHARD).withColumn("shard", F.monotonically_increasing_id())


class _Items:
    """A block of items as arrays: ids, offsets, term hashes, weights and thresholds."""

    def __init__(self, rows: list):
        self.ids = [r["item"] for r in rows]
        self.at = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in rows], dtype=np.int64)])
        self.terms = np.array([t for r in rows for t in r["terms"]], dtype=np.int64)
        self.weights = np.array([w for r in rows for w in r["weights"]], dtype=np.int64)
        self.who = np.repeat(np.arange(len(rows)), np.diff(self.at))
        self.floor = np.ones(len(rows), dtype=np.int64)  # scores have to be above 0

    def bounds(self, vocabulary: np.ndarray, peak: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper bound of each item's scores in a shard; and each term's place in it, and whether it has one."""
        at = np.minimum(np.searchsorted(vocabulary, self.terms), len(vocabulary) - 1)
        known = vocabulary[at] == self.terms
        bound = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(bound, self.who[known], self.weights[known] * peak[at[known]])
        return bound, at, known


def _array(row: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(row.column(name)[0].as_buffer(), dtype=_TYPES[name])


def best_shards(items: _Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(place of the item, shard, bound): the shard of best bound among a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.zeros(len(items.ids), dtype=np.int64), np.full(len(items.ids), -1)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                bound, _, _ = items.bounds(_array(row, "vocabulary"), _array(row, "peak"))
                better = bound > best
                best[better], where[better] = bound[better], row.column("shard")[0].as_py()
        some = np.flatnonzero(where >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(where[some]), pa.array(best[some])], names=["place", "shard", "bound"])

    return run


class Shard:
    """A shard's arrays, searched item by item. ``blocks`` and ``entered`` count the long lists' blocks met and scored."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.block_at = self.block_at.reshape(2, -1)
        self.summary = self.summary.reshape(len(self.block_col), len(self.long_term))
        self.column = np.full(len(self.vocabulary), -1)
        self.column[self.long_term] = np.arange(len(self.long_term))
        self.weights = np.zeros(len(self.vocabulary), dtype=np.int64)
        self.blocks = self.entered = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, ids) of at most k with the documents that reach ``floor``."""
        reach = weights * self.peak[terms]
        order = np.argsort(reach, kind="stable")
        inside = np.zeros(len(terms), dtype=bool)
        inside[order[np.cumsum(reach[order]) >= floor]] = True
        column = self.column[terms]
        short, seen = column < 0, np.zeros(len(self.docs), dtype=bool)
        self.weights[terms] = weights

        def score(docs: np.ndarray) -> None:
            nonlocal best, floor
            docs = np.unique(docs)
            docs = docs[~seen[docs]]
            if not len(docs):
                return
            seen[docs] = True
            idx, at = _spans(self.fwd_at, docs)
            got = np.add.reduceat(self.weights[self.fwd_term[idx]] * self.fwd_impact[idx], at)
            good = got >= floor
            got, ids = np.concatenate([best[0], got[good]]), np.concatenate([best[1], self.docs[docs[good]]])
            top = np.lexsort((ids, -got))[:k]
            best = got[top], ids[top]
            if len(top) == k:
                floor = max(floor, int(best[0][-1]))

        score(self.list_doc[_spans(self.list_at, terms[inside & short])[0]])
        blocks = np.flatnonzero(np.isin(self.block_col, column[inside & ~short]))
        if len(blocks):
            long = column[~short]
            bound = self.summary[np.ix_(blocks, long)].astype(np.int64) @ weights[~short] * UNIT + int(reach[short & ~inside].sum())
            order = np.argsort(-bound, kind="stable")
            blocks, bound = blocks[order], bound[order]
            self.blocks += len(blocks)
            for a in range(0, len(blocks), ROUND):
                part = blocks[a : a + ROUND][bound[a : a + ROUND] >= floor]
                if not len(part):
                    break
                self.entered += len(part)
                score(np.concatenate([self.list_doc[x:y] for x, y in self.block_at[:, part].T.tolist()]))
        self.weights[terms] = 0
        return best


def search_shards(items: _Items, k: int, only: dict[int, list[int]] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(place of the item, doc, score): a task's k best of each item; ``only`` lists the items to look for by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        best, floor = {}, items.floor.copy()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard = Shard({c: _array(row, c) for c in _TYPES})
                bound, at, known = items.bounds(shard.vocabulary, shard.peak)
                look = np.flatnonzero(bound >= floor) if only is None else [q for q in only[row.column("shard")[0].as_py()] if bound[q] >= floor[q]]
                for q in map(int, look):
                    a, b = items.at[q], items.at[q + 1]
                    own = known[a:b]
                    best[q] = shard.search(at[a:b][own], items.weights[a:b][own], int(floor[q]), k, best.get(q, (none, none)))
                    if len(best[q][0]) == k:
                        floor[q] = max(floor[q], best[q][0][-1])
        place = np.repeat(np.array(list(best), dtype=np.int64), [len(x[0]) for x in best.values()])
        score, ids = (np.concatenate(x) if x else none for x in ([y[j] for y in best.values()] for j in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids), pa.array(score)], names=["place", "doc", "score"])

    return run


def _search_block(index: DataFrame, rows: list, k: int) -> DataFrame:
    items, spark = _Items(rows), index.sparkSession
    found = index.select("shard", "vocabulary", "peak").mapInArrow(best_shards(items), "place long, shard long, bound long")
    start: dict[int, list[int]] = {}
    for r in found.groupBy("place").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")).collect():  # a row for each item of the block
        start.setdefault(r["shard"], []).append(r["place"])
    shards = F.broadcast(spark.createDataFrame([(s,) for s in start], "shard long"))
    hits = "place long, doc long, score long"
    seeds = index.join(shards, "shard", "left_semi").mapInArrow(search_shards(items, k, start), hits)
    for r in seeds.groupBy("place").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():
        items.floor[r["place"]] = r["least"]
    got = index.mapInArrow(search_shards(items, k), hits)
    best = Window.partitionBy("place").orderBy(F.desc("score"), "doc")
    ranked = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(items.ids)), "place long, item long"))
    return ranked.join(names, "place").select("item", "rank", "doc", "score")


def weighed_items(terms: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """item, terms, weights: of each item's terms that some document has."""
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    pairs = terms.join(df, "term").select("item", F.struct("term", w.alias("w")).alias("p")).where("p.w > 0")
    return pairs.groupBy("item").agg(F.sort_array(F.collect_list("p")).alias("p")).select("item", F.col("p.term").alias("terms"), F.col("p.w").alias("weights"))


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """item, rank, doc, score: the k best documents of each item."""
    spark = docs.sparkSession
    terms = materialise(item_terms(items, item_key))
    wanted = key_filter(terms.select("term"), at_once=True)
    vectors = materialise(term_vectors(docs, wanted, key).withColumn("row", F.monotonically_increasing_id()))
    n_docs, n_terms = vectors.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    empty = spark.createDataFrame([], "item long, rank int, doc long, score long")
    if not n_docs:
        return empty
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = materialise(weighed_items(terms, df, n_docs))
    n_blocks = -(-asked.count() // ITEM_BLOCK)
    index = materialise(build_index(vectors, n_docs, n_terms))
    wanted.release()
    out = empty
    for block in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block).collect()  # about ITEM_BLOCK items
        if rows:
            out = out.unionByName(_search_block(index, rows, k))
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), corpus AS (SELECT count(*)::BIGINT AS big_n, sum(len(words))::BIGINT AS big_l FROM d WHERE len(words) > 0),
tf AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2.0 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term), corpus GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def op11_geometric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
