"""Quality classifier (op 9): ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor and not toxic, 2 good. One weight vector over hashed text is shared by all
grades and two ordered thresholds cut the score, ``P(grade <= k) = sigmoid(threshold_k - w.x)``; so
a text has an expected grade and a tail probability ``P(grade = 2)``, by which it is selected.

Features of a text, all read from the whole text: presence of each hashed word (letters and digits,
A-Z folded), the share of each hashed word *shape* (runs of lower, upper, digit, punctuation), the
share of words that equal the one before, and the share of distinct words. They are computed block by
block with numpy inside the tasks. The model is fitted on at most ``sample`` labelled rows, those
of smallest hash of doc_id, and on ``sample_bytes`` of their features, by L-BFGS on the driver; the second bound fixes what the driver
holds, however long the texts are, beside the broadcast weights (2 MB): the features come as Arrow batches, are kept as 8 bytes each, and the loss
and its gradient are summed over runs of FIT_BLOCK of them. Scoring is one pass without a shuffle.

Defined results: null text is empty text and has only the constant part of the score; labels with a
null in a rating are not used; repeated rows are scored alike, and of texts with one labelled doc_id the least is fitted; an empty table gives an empty
result; without any usable label there is no model, scores are null and every row is kept. Ties at
the tail threshold are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.common import TextBlock, blocks, materialise, mix

BITS = 18
#: Most labelled rows that a fit uses.
SAMPLE = 12_000
#: Bytes of features (6 for each) that a fit fetches, but for the last row's, which has 3 MB at most.
SAMPLE_BYTES = 64 << 20
#: Features, and those of one more row, that the loss widens to double precision at a time.
FIT_BLOCK = 1 << 18
#: Least P(grade = 2) of a row that is kept.
TAIL = 0.5
RIDGE = 0.15
_DENSE = 2

_LOW_PUNCT = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _LOW_PUNCT[_b] = ord(_c.lower()) if _c.isalnum() else 32
_WORDS = bytes(_LOW_PUNCT)
_SHAPE = bytearray(256)
for _b in range(256):
    _c = chr(_b)
    _SHAPE[_b] = ord("u") if _b >= 128 or _c.islower() else ord("U") if _c.isupper() else ord("9") if _c.isdigit() else 32 if _c.isspace() or _b < 32 else _b
_SHAPES = bytes(_SHAPE)


def _compressed(raw: bytes) -> bytes:
    a = np.frombuffer(raw.translate(_SHAPES), dtype=np.uint8)
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep].tobytes()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR matrix of a batch: row offsets, columns (int32), values (float32)."""
    sizes, cols, vals = [], [], []
    for first, end, block in blocks(texts):
        n = end - first
        parts = []
        raws = [block.raw[block.base[i] : block.base[i + 1] - 1] for i in range(n)]
        w = TextBlock([r.translate(_WORDS) for r in raws], False)
        row = np.repeat(np.arange(n), np.diff(w.off))
        key = np.unique((row.astype(np.uint64) << np.uint64(32)) | (w.h >> np.uint64(64 - BITS)))
        kr, kc = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
        parts.append((kr, kc, np.ones(len(kr), dtype=np.float32)))
        s = TextBlock([_compressed(r) for r in raws], False)
        row = np.repeat(np.arange(n), np.diff(s.off))
        total = np.maximum(np.diff(s.off), 1)
        key, count = np.unique((row.astype(np.uint64) << np.uint64(32)) | (mix(s.h ^ np.uint64(77)) >> np.uint64(64 - BITS)), return_counts=True)
        kr2, kc2 = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int32)
        parts.append((kr2, kc2, (8.0 * np.sqrt(count / total[kr2])).astype(np.float32)))
        wn = np.maximum(np.diff(w.off), 1)
        same = np.zeros(len(w.h), dtype=bool)
        same[1:] = w.h[1:] == w.h[:-1]
        same[w.off[:-1][w.off[:-1] < len(same)]] = False
        cum = np.concatenate([[0], np.cumsum(same)])
        share = (cum[w.off[1:]] - cum[w.off[:-1]]) / wn
        distinct = np.bincount(kr, minlength=n) / np.sqrt(wn)
        for k, v in enumerate((8.0 * np.sqrt(share), distinct / 4.0)):
            parts.append((np.arange(n), np.full(n, (1 << BITS) + k, dtype=np.int32), v.astype(np.float32)))
        r = np.concatenate([p[0] for p in parts])
        order = np.argsort(r, kind="stable")
        sizes.append(np.bincount(r, minlength=n))
        cols.append(np.concatenate([p[1] for p in parts])[order])
        vals.append(np.concatenate([p[2] for p in parts])[order])
    if not sizes:
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)
    off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return off, np.concatenate(cols), np.concatenate(vals)


def _dot(off: np.ndarray, cols: np.ndarray, vals: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row sums of w[cols] * vals; every row has its dense columns, so none is empty."""
    return np.add.reduceat(w[cols] * vals, off[:-1]) if len(off) > 1 else np.empty(0)


def _loss(theta: np.ndarray, off, cols, vals, row, grade) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of the cumulative-link model with a ridge, and its gradient.

    theta: weights, then the first threshold, then the log of the gap to the second. The result doesn't depend on FIT_BLOCK.
    """
    w, a, gap = theta[:-2], theta[-2], np.exp(theta[-1])
    edges = np.unique(np.append(np.searchsorted(off, np.arange(0, off[-1], FIT_BLOCK)), len(off) - 1)).tolist()
    runs = list(zip(edges, edges[1:], off[edges[:-1]].tolist(), off[edges[1:]].tolist(), strict=False))
    s = np.concatenate([_dot(off[i : j + 1] - x, cols[x:y], vals[x:y], w) for i, j, x, y in runs])
    lo, hi = np.array([-np.inf, a, a + gap])[grade], np.array([a, a + gap, np.inf])[grade]
    sig = lambda z: np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
    ph, pl = sig(hi - s), sig(lo - s)
    p = np.maximum(ph - pl, 1e-12)
    dh, dl = ph * (1 - ph), pl * (1 - pl)
    gs = (dh - dl) / p  # d loss / d score
    grad = np.zeros_like(theta)
    for _, _, x, y in runs:
        np.add.at(grad, cols[x:y].astype(np.intp), gs[row[x:y]] * vals[x:y])
    grad[:-2] += RIDGE * w
    d1 = np.where(grade == 0, -dh / p, np.where(grade == 1, dl / p, 0.0))
    d2 = np.where(grade == 1, -dh / p, np.where(grade == 2, dl / p, 0.0))
    grad[-2] = (d1 + d2).sum()
    grad[-1] = d2.sum() * gap
    return float(-np.log(p).sum() + 0.5 * RIDGE * (w @ w)), grad


def _lbfgs(f, x: np.ndarray, steps: int = 60, keep: int = 8) -> np.ndarray:
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y, rho), alpha in zip(pairs, reversed(alphas), strict=True):
            q += s * (alpha - rho * (y @ q))
        step, slope = 1.0, float(g @ q)
        while True:
            new, gn = f(x - step * q)
            if new <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = -step * q, gn - g
        if s @ y > 1e-10:
            pairs = [*pairs[-keep + 1 :], (s, y, 1 / float(s @ y))]
        done = abs(value - new) < 1e-6 * max(1.0, abs(value))
        x, value, g = x + s, new, gn
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray | None:
    """Weights and thresholds from at most ``sample`` labelled rows with about ``sample_bytes`` of features; None without any.

    The labelled rows of smallest hash are chosen by a top-k (no sort of all labels), so the broadcast
    join that fetches their texts has a proven bound. Their features are written, and fetched in the order of the hash up to the bound.
    """
    graded = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    chosen = graded.select("doc_id", grade.alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def featurize(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            off, cols, vals = features(pdf["text"].tolist())
            cut = lambda a: [a[off[i] : off[i + 1]].tobytes() for i in range(len(pdf))]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "cols": cut(cols), "vals": cut(vals.astype(np.float16))})

    made = materialise(rows.mapInPandas(featurize, "doc_id long, grade int, cols binary, vals binary"))
    size = F.length("cols") + F.length("vals")
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("size")
    inside = made.select("doc_id", size.alias("size")).select("doc_id", before.alias("before")).where(F.col("before") < sample_bytes)  # ``sample`` rows at most
    got = made.join(F.broadcast(inside), "doc_id", "left_semi").toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    grades = got["grade"].to_numpy()[order].astype(np.int64)
    raw_cols, raw_vals = got["cols"], got["vals"]
    size = pc.binary_length(raw_cols).to_numpy()[order] // 4
    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    cols, vals = np.empty(off[-1], dtype=np.int32), np.empty(off[-1], dtype=np.float16)
    for k, i in enumerate(order.tolist()):
        cols[off[k] : off[k + 1]] = np.frombuffer(raw_cols[i].as_buffer(), dtype=np.int32)
        vals[off[k] : off[k + 1]] = np.frombuffer(raw_vals[i].as_buffer(), dtype=np.float16)
    del got, raw_cols, raw_vals
    row = np.repeat(np.arange(len(size), dtype=np.min_scalar_type(len(size))), size)
    theta = np.zeros((1 << BITS) + _DENSE + 2)
    theta[-2] = -1.0
    return _lbfgs(lambda t: _loss(t, off, cols, vals, row, grades), theta)


def score(docs: DataFrame, model: np.ndarray | None, tail: float = TAIL) -> DataFrame:
    """docs with expected_grade, p_good and kept; clashing columns are replaced."""
    base = docs.drop("expected_grade", "p_good", "kept")
    if model is None:
        none = F.lit(None).cast("double")
        return base.select("*", none.alias("expected_grade"), none.alias("p_good"), F.lit(True).alias("kept"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model[:-2].astype(np.float32), float(model[-2]), float(model[-2] + np.exp(model[-1]))))

    @F.pandas_udf("struct<e:double,p:double>")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, t1, t2 = shared.value
        for texts in parts:
            off, cols, vals = features(texts.tolist())
            s = _dot(off, cols, vals, w).astype(np.float64)
            at_least_1, good = 1 / (1 + np.exp(t1 - s)), 1 / (1 + np.exp(t2 - s))
            yield pd.DataFrame({"e": at_least_1 + good, "p": good})

    free = "_"
    while any(c.lower().startswith(free) for c in base.columns):
        free += "_"
    rated = base.withColumn(free, rate("text"))
    good = F.col(free)["p"]
    return rated.select(*[F.col(f"`{c}`") for c in base.columns], F.col(free)["e"].alias("expected_grade"), good.alias("p_good"), (good >= tail).alias("kept"))


def op9_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).drop("text")
