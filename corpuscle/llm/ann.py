"""Approximate nearest neighbours by additive quantisation (op 1).

Every vector, brought to unit length, is encoded as one code word from each of CODEBOOKS codebooks of full dimension;
its approximation is their sum. Codebooks are fitted on a bounded sample: residual k-means gives the start, then
encoding and a joint least-squares update of all code words alternate. Encoding is a beam search: after each codebook
the BEAM best partial sums are kept. With the codes is stored the norm of the sum, so a query scores a
vector by looking up one inner product for each codebook and dividing by that norm. The best of each block of
vectors by that score, and all that tie with the last of them, are scored exactly, in double precision on the original vectors.

Equal vectors are folded into one row with its k + 1 smallest vec_ids before anything is fitted or indexed, so copies
cost one row, don't crowd out others and tie as they should; k + 1, as a query leaves out its own id.

The queries are a stated set (vec_id divisible by EVERY). Vectors rest: the encoded blocks, cut by a hash of the vector with a
size that follows the input (so none is hot), are dealt once for each group of QUERY_GROUP queries, and the small
query vectors go to them; only the k best of each block and query are shuffled on. A query reranks about RERANK vectors
in all, ``width`` of them in each block: its share of RERANK by chance, and six standard deviations more. That is a beam of
the method; tests measure recall against brute force over several blocks and widths.

Defined results: vectors that are null, zero, or hold a null or non-finite component, and those whose dimension isn't the
table's most common (least on ties), take no part, and neither does a null vec_id; equal vec_ids are told apart only by their
vectors (a query leaves out all rows of its own id); ties go to the smaller vec_id; fewer candidates than k are all returned;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuscle.llm.common import materialise

NEAREST, EVERY = 5, 50
CODEBOOKS, WORDS, BEAM = 8, 256, 8
#: Vectors that a fit uses, and its rounds of encoding and least squares.
SAMPLE, ROUNDS = 8_192, 2
#: Vectors in a block, queries that meet one copy of the blocks, and vectors that are scored exactly for each query in all.
BLOCK, QUERY_GROUP, RERANK = 4_096, 16_384, 512


def width(rerank: int, blocks: int) -> int:
    """Vectors of a block that a query scores exactly, so that the ``rerank`` best of all are hardly ever cut off by the blocks."""
    share = rerank / blocks
    return min(rerank, math.ceil(share + 6 * math.sqrt(share * (1 - 1 / blocks)) + NEAREST))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, codebooks) by beam search, and the norm of each approximation."""
    codes = np.zeros((len(x), len(books)), dtype=np.uint8)
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        n = len(part)
        residual, kept, cost = part[:, None, :], np.zeros((n, 1, 0), dtype=np.uint8), None
        for book in books:
            b = residual.shape[1]
            # |r - c|^2 without the part that is the same for a row's whole beam
            dist = (residual**2).sum(2)[:, :, None] - 2 * (residual.reshape(n * b, -1) @ book.T).reshape(n, b, -1) + (book**2).sum(1)
            flat = dist.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            from_, word = best // len(book), best % len(book)
            rows = np.arange(n)[:, None]
            kept = np.concatenate([kept[rows, from_], word[:, :, None].astype(np.uint8)], axis=2)
            residual = residual[rows, from_] - book[word]
            cost = flat[rows, best]
        first = cost.argmin(1)
        codes[at : at + n] = kept[np.arange(n), first]
    # the norm of the code words' sum, once for each distinct code, so that equal codes score alike to the last bit
    distinct, of = np.unique(codes, axis=0, return_inverse=True)
    norms = np.linalg.norm(sum(book[distinct[:, j]] for j, book in enumerate(books)), axis=1)
    return codes, np.maximum(norms, 1e-6).astype(np.float32)[of.ravel()]


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (codebooks, words, dimension) of unit vectors x."""
    rng = np.random.default_rng(11)
    words = min(words, len(x))
    residual, books = x.astype(np.float32).copy(), []
    for _ in range(codebooks):
        c = _kmeans(residual, words, rng).astype(np.float32)
        residual -= c[((c**2).sum(1) - 2 * residual @ c.T).argmin(1)]
        books.append(c)
    out = np.stack(books)
    for _ in range(rounds):
        codes, _ = encode(x, out)
        column = codes.astype(np.int64) + np.arange(codebooks) * words
        gram = np.zeros((codebooks * words, codebooks * words))
        right = np.zeros((codebooks * words, x.shape[1]))
        for i in range(codebooks):
            np.add.at(right, column[:, i], x)
            for j in range(codebooks):
                np.add.at(gram, (column[:, i], column[:, j]), 1.0)
        gram[np.diag_indices_from(gram)] += 1e-2
        right += 1e-2 * out.reshape(-1, x.shape[1])
        out = np.linalg.solve(gram, right).reshape(out.shape).astype(np.float32)
    return out


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the vectors that take part."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(~bad & F.exists("v", lambda c: c != 0))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return v.join(F.broadcast(common), F.size("v") == F.col("d"), "left_semi")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, so that their squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = _scaled(x)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """dot / (norm * norm) of each row of x with q; both scaled."""
    return np.clip((x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())), -1.0, 1.0)


def fold(vectors: DataFrame, k: int) -> DataFrame:
    """v, vec_ids: a row for each distinct vector, with its k + 1 smallest distinct vec_ids (cut before the shuffle as well)."""
    order = Window.partitionBy("v").orderBy("vec_id")
    first = vectors.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))


def index(folded: DataFrame, blocks: int, books: np.ndarray) -> DataFrame:
    """block, vec_ids, counts, codes, norms, vectors: a row for each block of the encoded table."""
    shared = folded.sparkSession.sparkContext.broadcast(books)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["v"])
        codes, norms = encode(_unit(x).astype(np.float32), shared.value)
        ids, counts = np.concatenate(pdf["vec_ids"].tolist()).astype("<i8"), pdf["vec_ids"].map(len).to_numpy(dtype="<i8")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "vec_ids": [ids.tobytes()], "counts": [counts.tobytes()], "codes": [codes.tobytes()], "norms": [norms.tobytes()], "vectors": [x.tobytes()]})

    placed = folded.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    return placed.groupBy("block").applyInPandas(build, "block int, vec_ids binary, counts binary, codes binary, norms binary, vectors binary")


_FOUND = "query_id long, vec_id long, score double"


def _search(books_shared, k: int, wide: int):
    def run(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k best of one block for each query of one group."""
        out = []
        if len(blocks) and len(queries):
            books, row = books_shared.value, blocks.iloc[0]
            m, _, d = books.shape
            ids, counts = np.frombuffer(row.vec_ids, dtype="<i8"), np.frombuffer(row.counts, dtype="<i8")
            starts = np.cumsum(counts) - counts
            codes, norms = np.frombuffer(row.codes, dtype=np.uint8).reshape(-1, m), np.frombuffer(row.norms, dtype=np.float32)
            x, q, q_ids = _scaled(np.frombuffer(row.vectors).reshape(-1, d)), _scaled(_matrix(queries["v"])), queries["vec_id"].to_numpy()
            columns = [codes[:, j].astype(np.intp) for j in range(m)]
            for i in range(len(q)):
                table = books @ (q[i] / np.linalg.norm(q[i])).astype(np.float32)
                score = table[0][columns[0]]
                for j in range(1, m):
                    score = score + table[j][columns[j]]
                score = np.where((counts == 1) & (ids[starts] == q_ids[i]), -np.inf, score / norms)
                last = len(score) - min(wide, len(score))
                near = np.flatnonzero(score >= np.partition(score, last)[last])
                exact = cosine(x[near], q[i])
                # the ids of each row; an id with two vectors of one score counts once
                n = counts[near]
                mine, exact = ids[np.repeat(starts[near] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(exact, n)
                order = np.lexsort((mine, -exact))
                order = order[mine[order] != q_ids[i]]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (mine[order[1:]] != mine[order[:-1]]) | (exact[order[1:]] != exact[order[:-1]])
                best = order[new][:k]
                out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": mine[best], "score": exact[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, rerank: int = RERANK, block: int = BLOCK, group: int = QUERY_GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (a row with vec_id divisible by ``every``)."""
    spark = vectors.sparkSession
    v = materialise(usable(vectors))
    folded = materialise(fold(v, k))
    sample = folded.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not len(sample):
        return spark.createDataFrame([], schema)
    books = fit(_unit(_matrix(sample["v"])).astype(np.float32))
    blocks = max(1, -(-folded.count() // block))
    idx = materialise(index(folded, blocks, books))
    queries = materialise(v.where(F.pmod("vec_id", F.lit(every)) == 0))
    groups = max(1, -(-queries.count() // group))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    resting = idx.withColumn("q_group", every_of(groups)).groupBy("block", "q_group")
    dealt = queries.withColumn("q_group", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")).withColumn("block", every_of(blocks)).groupBy("block", "q_group")
    found = resting.cogroup(dealt).applyInPandas(_search(spark.sparkContext.broadcast(books), k, width(rerank, blocks)), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
