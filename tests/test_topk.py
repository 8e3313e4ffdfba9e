"""Top-k by pairs of blocks against plain computation, with small blocks, ties, filters and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import retrieval as op
from corpuscle.operators import text as tx
from corpuscle.operators import topk


def _ranked(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score").collect())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sizes", [(8192, 4096), (7, 3), (1, 1)])
def test_nearest_vectors_equal_plain_computation(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "VECTORS", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 5)), 1)
    x[40:50] = x[0]  # ties
    vectors = [(i, v.tolist(), "ab"[i % 2] if i % 7 else None, i % 3) for i, v in enumerate(x)] + [(90, None, "a", 0)]
    queries = [(i, v.tolist(), "abz"[i % 3], i % 3) for i, v in enumerate(x[:11])] + [(99, None, "a", 0)]
    v = spark.createDataFrame(vectors, "id long, embedding array<double>, kind string, part int")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>, kind string, part int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for where in ([], ["kind"], ["kind", "part"]):
        want = []
        for qi, _, kind, part in queries[:-1]:
            mine = [i for i, _, k, p in vectors[:-1] if (not where or k == kind) and (len(where) < 2 or p == part)]
            best = sorted((-round(float(np.clip(unit[qi] @ unit[i], -1, 1)), 6), i) for i in mine)[:6]
            want += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
        got = _ranked(op.vector_topk(q, v, 6, where))
        assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
        assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want)], atol=2e-6)


def test_many_queries_make_no_bigger_plan(spark):
    v = spark.range(50).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("embedding"))
    few, many = (spark.range(n).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("embedding")) for n in (3, 30_000))
    plans = [_plan(op.vector_topk(q, v, 2)) for q in (few, many)]
    assert "Union" not in plans[1] and len(plans[0].splitlines()) == len(plans[1].splitlines())
    assert op.vector_topk(many, v, 2).count() == 60_000
    assert op.vector_topk(few.limit(0), v, 2).collect() == [] and op.vector_topk(few, v.limit(0), 2).collect() == []


def test_dimensions_must_agree(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="dimensions"):
        op.vector_topk(q, v, 1).collect()
    with pytest.raises(Exception, match="dimensions"):
        op.vector_topk(q, v.unionByName(q.withColumnRenamed("query_id", "id")), 1).collect()
    with pytest.raises(ValueError, match="512"):
        op.vector_topk(q, v, 513)


def _texts(n, seed=2):
    rnd = random.Random(seed)
    return [" ".join(f"w{int(120 * rnd.random() ** 3)}" for _ in range(rnd.randrange(1, 60))) for _ in range(n)]


def _bm25(docs, queries, k, plus):
    out, post = [], [(i, Counter((t or "").split() or ["_"])) for i, t in docs]
    df = Counter(t for _, c in post for t in c)
    n, mean = len(post), sum(sum(c.values()) for _, c in post) / len(post)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    for q, text in queries:
        asked, scores = Counter(t for t in (text or "").split() if t in df), []
        mine = [(i, c) for i, c in post if asked.keys() & c.keys()]
        if plus and mine:
            m = sum(sum(c.values()) for _, c in mine) / len(mine)
            idf = {t: math.log((len(mine) + 1) / df[t]) for t in asked}
        else:
            m, idf = mean, {t: raw[t] if raw[t] >= 0 else eps for t in asked}
        for i, c in mine:
            part = sum(f * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / m)) for t, f in asked.items() if t in c)
            s = round(part + (sum(f * idf[t] for t, f in asked.items()) if plus else 0), 6)
            if plus or s > 0:
                scores.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("plus", [False, True])
def test_lexical_rankings_equal_plain_computation(spark, monkeypatch, small, plus):
    if small:
        for name, value in (("POSTINGS", 200), ("QUERIES", 4), ("BOUNDED", 2)):
            monkeypatch.setattr(topk, name, value)
    docs = [(i, t) for i, t in enumerate(_texts(150))] + [(i, "w1 w2 w3 w1") for i in range(200, 230)] + [(300, None), (301, "")]
    queries = [(i, t) for i, t in enumerate(_texts(14, 3))] + [(50, None), (51, "nowhere"), (52, "w1 w1 w2"), (53, "w0")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    rank = op.bm25plus_rank if plus else op.bm25_topk
    for post in (tx.postings(d, "id", mark=True), tx.postings(d, "id")):
        got, want = _ranked(rank(q, post, 7)), _bm25(docs, queries, 7, plus)
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-6)
    if plus:
        assert op.bm25plus_rank(q, tx.postings(d, "id")).count() == len(_bm25(docs, queries, 10**9, True))
    assert rank(q.limit(0), tx.postings(d, "id", mark=True), 7).collect() == []


def test_runs_that_cannot_reach_the_best_are_not_scored():
    rnd = random.Random(5)
    topics = [[f"t{j}_{i}" for i in range(30)] for j in range(40)]
    rows = []
    for i in range(4000):
        own = topics[i * 40 // 4000]
        words = Counter(rnd.choice(own) if rnd.random() < 0.7 else f"w{int(200 * rnd.random() ** 2)}" for _ in range(60 + i // 40))
        rows += [(i, t, n, sum(words.values())) for t, n in words.items()]
    post = topk.Postings(pa.table(dict(zip(("id", "term", "tf", "dl"), map(list, zip(*rows, strict=True)), strict=True))))
    for q in range(20):
        asked = [*rnd.sample(topics[2 * q], 5), "w0", "w1", "w5"]
        weights = np.array([rnd.uniform(0.5, 6) for _ in asked[:5]] + [0.1, 0.2, -0.3])
        docs, scores = post.search(asked, weights, 80.0, 0.0, 10)
        share = lambda n, dl: n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / 80.0))
        want = Counter()
        for i, t, n, dl in rows:
            if t in asked:
                want[i] += weights[asked.index(t)] * share(n, dl)
        best = sorted((-round(s, 6), i) for i, s in want.items())[:10]
        assert [i for _, i in best] == post.ids.take(pa.array(docs)).to_pylist() and np.allclose(scores, [-s for s, _ in best], atol=2e-6)
    assert post.scored < 0.5 * post.met
