"""Top-k of a table of queries over a table of rows, block by block: both sides are dealt into blocks, each pair of blocks is one group, and
its partial lists of k are merged. Neither side passes the driver, and a group holds a bounded number of rows of each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
#: Vectors and queries of a block.
VECTORS, QUERIES = 8_192, 4_096
#: Postings of a block of documents (a document isn't cut), and documents that share an upper bound.
POSTINGS, BOUNDED = 1 << 20, 32
K1, B = 1.5, 0.75


def grid(rows: DataFrame, key: str, size: int, queries: DataFrame, query_key: str, query_size: int, where: list[str], count: str | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in blocks of about ``size`` rows (of ``query_size`` queries), each copied to the blocks of the other, and the columns that name a pair.

    Blocks are chosen by a hash of the key, and only rows and queries with equal ``where`` columns meet. The number of blocks
    follows from a count of both sides. ``count``: a column whose distinct values are counted instead of rows.
    """
    n = F.count_distinct(count) if count else F.count("*")
    blocks = lambda c, s: F.greatest(F.ceil(c / s), F.lit(1)).cast("int")
    made = rows.groupBy(*where).agg(blocks(n, size).alias("_n"))
    asked = queries.groupBy(*where).agg(blocks(F.count("*"), query_size).alias("_m"))
    if where:
        both = made.join(asked, where)
        rows, queries = rows.join(both, where), queries.join(both, where)
    else:
        one, two = made.first()[0], asked.first()[0]
        rows, queries = (x.withColumns({"_n": F.lit(one), "_m": F.lit(two)}) for x in (rows, queries))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda k, c: F.pmod(F.xxhash64(k), F.col(c)).cast("int")
    rows = rows.withColumn("_row_block", mine(key, "_n")).withColumn("_query_block", upto("_m")).drop("_n", "_m")
    queries = queries.withColumn("_query_block", mine(query_key, "_m")).withColumn("_row_block", upto("_n")).drop("_n", "_m")
    # both sides may come from one table: under new names for the engine they are told apart
    rows, queries = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (rows, queries))
    return rows, queries, [*where, "_row_block", "_query_block"]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    sizes = np.unique(pc.list_value_length(a).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and {sizes[-1]} dimensions")
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in their order."""
    at = pc.sort_indices(ids).to_numpy()
    out = np.empty(len(at), dtype=np.int64)
    out[at] = np.arange(len(at))
    return out


def _best(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller order; all ties with the k-th are looked at."""
    some = np.arange(len(score)) if k >= len(score) else np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return some[np.lexsort((order[some], -score[some]))[:k]]


def _found(query_ids: pa.ChunkedArray, ids: pa.ChunkedArray, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """query_id, id, score from (place of the query, places of ids, scores)."""
    q = np.repeat(np.array([p[0] for p in parts], dtype=np.int64), [len(p[1]) for p in parts])
    at, score = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in (1, 2))
    return pa.table({"query_id": query_ids.take(pa.array(q)), "id": ids.take(pa.array(at.astype(np.int64))), "score": pa.array(score.astype(np.float64))})


def nearest(vectors: DataFrame, queries: DataFrame, k: int, where: list[str]) -> DataFrame:
    """query_id, id, score: for each pair of blocks, the k of largest cosine (clamped, rounded to DIGITS) of each query."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            v, q, order = _matrix(left.column("embedding")), _matrix(right.column("embedding")), _order(left.column("id"))
            if v.shape[1] != q.shape[1]:
                raise ValueError(f"vectors have {v.shape[1]} dimensions, queries {q.shape[1]}")
            for at in range(0, len(q), 256):
                sims = np.round(np.clip(q[at : at + 256] @ v.T, -1, 1), DIGITS)
                parts += [(at + i, best := _best(s, order, k), s[best]) for i, s in enumerate(sims)]
        return _found(right.column("query_id"), left.column("id"), parts)

    rows, asked, pair = grid(vectors.where("embedding is not null"), "id", VECTORS, queries.where("embedding is not null"), "query_id", QUERIES, where)
    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())
    return rows.groupBy(*pair).cogroup(asked.groupBy(*pair)).applyInArrow(cell, "query_id {}, id {}, score double".format(*kinds))


class Postings:
    """The postings of a block of documents, in the order (term, document), with upper bounds for runs of BOUNDED documents.

    Documents are numbered by length, so those of a run have similar ones. For each term and run the greatest tf is
    kept; with the least length of the run it bounds the term's share of a score. ``scored`` counts postings scored, ``met`` those of
    all runs.
    """

    def __init__(self, table: pa.Table):
        ids = table.column("id").combine_chunks().dictionary_encode()
        terms = table.column("term").combine_chunks().dictionary_encode()
        doc, term = ids.indices.to_numpy(), terms.indices.to_numpy()
        tf, dl = table.column("tf").to_numpy().astype(np.float64), table.column("dl").to_numpy().astype(np.float64)
        length = np.zeros(len(ids.dictionary))
        length[doc] = dl
        by_length = np.argsort(length, kind="stable")
        number = np.empty(len(by_length), dtype=np.int64)
        number[by_length] = np.arange(len(by_length))
        self.ids, self.length = ids.dictionary.take(pa.array(by_length)), length[by_length]
        doc = number[doc]
        at = np.lexsort((doc, term))
        self.doc, self.tf, term = doc[at], tf[at], term[at]
        self.order = _order(pa.chunked_array([self.ids]))
        self.place = {t: i for i, t in enumerate(terms.dictionary.to_pylist())}
        run = self.doc // BOUNDED
        first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(run, prepend=-1)) if len(doc) else np.empty(0, dtype=np.int64)
        self.first, self.run, self.most = np.append(first, len(doc)), run[first], np.maximum.reduceat(self.tf, first) if len(first) else self.tf
        self.term_at = np.searchsorted(term[first], np.arange(len(self.place) + 1))
        self.least = self.length[::BOUNDED]
        self.met = self.scored = 0

    def entries(self, terms: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the (term, run) entries of known terms, and each one's weight."""
        spans = [(self.term_at[i], self.term_at[i + 1], w) for t, w in zip(terms, weights, strict=True) if (i := self.place.get(t)) is not None]
        if not spans:
            return np.empty(0, dtype=np.int64), np.empty(0)
        return np.concatenate([np.arange(a, b) for a, b, _ in spans]), np.repeat([w for _, _, w in spans], [b - a for a, b, _ in spans])

    def places(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of entries, and how many each has."""
        size = self.first[entries + 1] - self.first[entries]
        start = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.first[entries] - start, size), size

    def share(self, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))

    def search(self, terms: list[str], weights: np.ndarray, mean: float, base: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents, scores rounded to DIGITS): the k best of those that hold a term; runs of best bounds come first."""
        entries, weight = self.entries(terms, weights)
        if not len(entries):
            return np.empty(0, dtype=np.int64), np.empty(0)
        run = self.run[entries]
        bound = np.bincount(run, np.maximum(weight, 0) * self.share(self.most[entries], self.least[run], mean), minlength=len(self.least))
        held = np.bincount(run, minlength=len(self.least)) > 0
        self.met += int((self.first[entries + 1] - self.first[entries]).sum())
        runs = np.flatnonzero(held)
        runs = runs[np.argsort(-bound[runs], kind="stable")]
        docs, scores, least, at, step = np.empty(0, dtype=np.int64), np.empty(0), -np.inf, 0, max(2, k // BOUNDED)
        while at < len(runs):
            part = runs[at : at + step]
            part = part[bound[part] + base + 2 * 10.0**-DIGITS >= least]  # the slack covers rounding
            if not len(part):
                break
            wanted = np.zeros(len(self.least), dtype=bool)
            wanted[part] = True
            here = wanted[run]
            idx, size = self.places(entries[here])
            self.scored += len(idx)
            found, back = np.unique(self.doc[idx], return_inverse=True)
            value = np.bincount(back, np.repeat(weight[here], size) * self.share(self.tf[idx], self.length[self.doc[idx]], mean)) + base
            docs, scores = np.concatenate([docs, found]), np.concatenate([scores, np.round(value, DIGITS)])
            best = _best(scores, self.order[docs], k)
            docs, scores = docs[best], scores[best]
            least = scores[-1] if len(docs) == k else -np.inf
            at, step = at + step, 2 * step
        return docs, scores


def _pairs(hits: DataFrame, asked: DataFrame):
    """Postings and queries (query_id, terms, more) in pairs of blocks. A block of documents has POSTINGS postings or so."""
    per = hits.agg(F.count("*"), F.count_distinct("id")).first()
    size = max(1, int(POSTINGS * per[1] / max(per[0], 1)))
    return grid(hits, "id", size, asked, "query_id", QUERIES, [], "id")


def lexical_best(hits: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the k best of each query in each block of documents.

    hits: id, term, tf, dl; asked: query_id, terms, weights (one for each term), mean (length of a document), base (added to each score).
    """

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        post, parts = Postings(left), []
        for q, row in enumerate(right.select(["terms", "weights", "mean", "base"]).to_pylist()):
            parts.append((q, *post.search(row["terms"], np.array(row["weights"]), row["mean"], row["base"], k)))
        return _found(right.column("query_id"), pa.chunked_array([post.ids]), parts)

    return _cells(hits, asked, cell, "query_id {}, id {}, score double")


def candidates(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, n, mean: number and mean length of the documents that share a term with each query (asked: query_id, terms)."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        post, n, total = Postings(left), [], []
        for terms in right.column("terms").to_pylist():
            entries, _ = post.entries(terms, np.zeros(len(terms)))
            held = np.zeros(len(post.length), dtype=bool)
            held[post.doc[post.places(entries)[0]]] = True
            n.append(int(held.sum()))
            total.append(float(post.length[held].sum()))
        return pa.table({"query_id": right.column("query_id"), "n": pa.array(n, pa.int64()), "total": pa.array(total, pa.float64())})

    out = _cells(hits, asked, cell, "query_id {}, n long, total double").groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out.where("n > 0").select("query_id", "n", (F.col("total") / F.col("n")).alias("mean"))


def _cells(hits: DataFrame, asked: DataFrame, cell: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    rows, queries, pair = _pairs(hits, asked)
    kinds = (asked.schema["query_id"].dataType.simpleString(), hits.schema["id"].dataType.simpleString())
    return rows.groupBy(*pair).cogroup(queries.groupBy(*pair)).applyInArrow(cell, schema.format(*kinds))
