"""Cases in which an operator once did less than the whole job."""

import hashlib
import itertools
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import ann, bpe, minhash, quality, repeats, sharding, warc
from corpuscle.llm.common import key_filter, materialise
from corpuscle.plans import formats
from tests.llm.test_ops import collected, near_rows, table
from tests.oracle import FOLDER


def brute_components(rows, percent):
    """Kept doc_ids: the least of each component of texts whose five-word shingles are similar enough."""
    sets = [(d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for d, w in ((d, t.split(" ")) for d, t in rows)]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {d for d in parent if find(d) == d}


def between_rows():
    """Pairs of texts whose similarity lies between 0.80 and 0.85, and below 0.80, beside groups of edited copies."""
    rows = []
    for i in range(60):
        base = [f"p{i}_{k}" for k in range(100)]
        edited = [*base[: 82 + i % 14], *(f"q{i}_{k}" for k in range(18 - i % 14))]
        rows += [(10_000 + 2 * i, " ".join(base)), (10_001 + 2 * i, " ".join(edited))]
    return rows + [(d, t) for d, t in near_rows() if d is not None and t is not None and len(t.split(" ")) >= 50]


def test_pipeline_near_dedup_links_from_80_percent(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = between_rows()
    want = brute_components(rows, 80)
    assert want < brute_components(rows, 85)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in pipeline.near_dedup_stage(spark, docs, "").collect()} == want
    assert {r[0] for r in collected(minhash.near_dedup(table(spark, rows))) if r[3]} == brute_components(rows, 85)


def test_neighbours_beside_a_group_of_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x[rng.permutation(3000)[:1000]] = x[0] = x[1]
    x[50:1000:50] = x[0] + rng.normal(size=(19, 16)) * 0.05
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(3001, x[5].tolist()), (3001, (x[5] * 2).tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, rerank=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    u = np.concatenate([x, x[[5, 5]]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = np.append(ids, [3001, 3001])
    near = [q for q in np.flatnonzero(ids % 50 == 0) if u[q] @ u[0] > 0.9]
    assert len(near) > 10
    hit = 0
    for q in near:
        s = np.where(ids == ids[q], -np.inf, np.round(u @ u[q], 12))
        want = list(dict.fromkeys(ids[np.lexsort((ids, -s))[:12]].tolist()))[:5]
        assert sorted(got[ids[q]]) == [1, 2, 3, 4, 5] and len(set(got[ids[q]].values())) == 5
        hit += len(set(want) & set(got[ids[q]].values()))
    assert hit >= 0.95 * 5 * len(near)


def test_equal_codes_have_equal_norms():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    near = np.repeat(x, 20, axis=0) + rng.normal(size=(800, 8)).astype(np.float32) * np.float32(1e-5)
    codes, norms = ann.encode(near, ann.fit(x, 2, 16, 1))
    for c in np.unique(codes, axis=0):
        assert len(set(norms[(codes == c).all(axis=1)].tolist())) == 1


def test_session_stream_is_written_in_its_own_partitions(spark, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    made, folder = [], formats.st.shared_folder
    monkeypatch.setattr(formats.st, "shared_folder", lambda s: made.append(folder(s)) or made[-1])
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        got = formats._sessions(spark, str(tmp_path))
        whole = sorted(map(tuple, formats._sessions(spark, FOLDER).collect()))
        assert sorted(map(tuple, got.collect())) == whole
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(spark.read.parquet(made[0]).inputFiles()) > 2


@pytest.mark.parametrize("unit", [repeats.Bytes(20, 6), repeats.Words(8, 3)])
def test_a_long_text_is_segmented_stretch_by_stretch(unit):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "be", "see"], n)).encode() for n in (3, 900, 0, 40)]

    def anchors(u):
        key, text, start, count, _ = u.open(u, texts).segments()
        return {(int(t), s + i): int(k) for k, t, s, c in zip(key, text, start.tolist(), count.tolist(), strict=True) for i in range(c)}

    whole = anchors(unit)
    cut = type(unit)(unit.window, unit.gram, 50)
    assert len(whole) > 600 and anchors(cut) == whole
    # a text's segments don't depend on the texts around it
    alone = [tuple(map(int, (k, s, c, h))) for k, _, s, c, h in zip(*cut.open(cut, texts[1:2]).segments(), strict=True)]
    assert alone == [tuple(map(int, (k, s, c, h))) for k, t, s, c, h in zip(*cut.open(cut, texts).segments(), strict=True) if t == 1]


def test_key_filter_has_all_keys_and_few_others(spark):
    keys = materialise(spark.range(0, 30_000_000, 1_000).selectExpr("xxhash64(id) AS k"))
    own = keys.toPandas()["k"].to_numpy()
    found = key_filter(keys)
    other = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 100_000)
    assert found.hit(own).all() and found.hit(other).mean() < 0.006 and found.bits == 19 and not found.full
    assert not key_filter(keys.limit(0)).hit(other).any()


def test_later_places_of_a_segment_are_not_held():
    pdf = pd.DataFrame({"a_key": [1, 1, 1, 1, 2, 2, 2], "seg_key": [5, 5, 5, 6, 6, 6, 6], "doc": range(7)})
    for cut in range(8):
        got = pd.concat(repeats._first_places(iter([pdf[:cut], pdf[cut:]])))
        assert got["doc"].tolist() == [0, 3, 4]


def test_neighbours_over_many_blocks_and_query_groups(spark):
    """Recall by rerank width, with the blocks and query groups cut small; repeated rows tie by vec_id."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 32))
    x = (centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 32)) * 0.6).astype(np.float32).astype(np.float64)
    x[3000:3040] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] * 2, "vec_id long, embedding array<double>").repartition(5)
    norms = np.sqrt((x * x).sum(axis=1))
    want = {}
    for q in range(0, 6000, 50):
        s = np.array([(x[i] * x[q]).sum() for i in range(6000)]) / (norms * norms[q])
        s[q] = -np.inf
        want[q] = (np.lexsort((np.arange(6000), -s))[:5].tolist(), s)
    recall = {}
    for rerank in (16, 512):
        got = {}
        for r in ann.nearest(df, rerank=rerank, block=400, group=40).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
        assert all(abs(s - want[q][1][v]) < 1e-14 for q, g in got.items() for v, s in g.values())
        recall[rerank] = sum(len({v for v, _ in got[q].values()} & set(want[q][0])) for q in want) / (5 * len(want))
    assert recall[512] >= 0.97 and recall[16] >= 0.7
    assert [got[0][k][0] for k in range(1, 6)] == want[0][0] == [3000, 3001, 3002, 3003, 3004]


def test_archives_are_bounded_by_bytes_and_ranges_by_rows(spark):
    pages = spark.range(300).selectExpr("id AS page_id", "if(id % 3 = 0, 'http://hot/x', concat('http://h', id % 7, '/')) AS url", "concat(id, repeat('a', if(id % 50 = 0, 300000, 2000))) AS html")
    pages = pages.unionByName(spark.range(200).selectExpr("7L AS page_id", "'http://h0/' AS url", "repeat('b', 50) AS html"))
    path = warc.shared_dir(spark)
    warc.write_archives(pages, path, 1 << 20)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "length").collect()
    assert len(files) > 8 and max(f["length"] for f in files) <= 1.2 * (1 << 20)
    parts = warc.merge_runs(warc.materialise(warc.capture_runs(spark, path)), 40).rdd.glom().map(lambda p: [(r["url_key"], r["captured"], r["page_id"]) for r in p]).collect()
    rows = [r for p in parts for r in p]
    assert len(rows) == 500 and rows == sorted(rows) and max(map(len, parts)) <= 120
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.capture_runs(spark, path).collect()}
    assert got == {(r[0], len(r[2]), hashlib.sha1(r[2].encode()).hexdigest()) for r in pages.collect()}


def test_warc_and_quality_of_empty_tables(spark):
    path = warc.shared_dir(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.merge_runs(warc.materialise(warc.capture_runs(spark, path))).collect() == []
    none = table(spark, [(1, "x")]).limit(0)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(none, labels) is None
    model = quality.fit(table(spark, [(1, "good one"), (2, "poor"), (3, "bad")]), labels)
    assert quality.score(none, model).collect() == []
    clash = quality.score(table(spark, [(1, None), (2, "x")]).withColumn("_", F.lit("y")).withColumn("kept", F.lit(3)), model)
    assert [r["_"] for r in clash.collect()] == ["y", "y"] and clash.columns[-3:] == ["expected_grade", "p_good", "kept"]


def test_quality_loss_and_gradient_equal_a_slow_reference():
    rng = np.random.default_rng(4)
    off, cols, vals = quality.features(["a good text", None, "bad bad text", "Other words 12", "x y z x"])
    grade, size = np.array([2, 1, 0, 1, 2]), (1 << quality.BITS) + 2
    row = np.repeat(np.arange(5), np.diff(off))
    theta = np.append(rng.normal(size=size) * 0.1, [-0.3, 0.2])
    used = sorted(set(cols.tolist()))
    dense = np.zeros((5, size))
    np.add.at(dense, (row, cols), vals)

    def slow(t):
        s, cut = dense @ t[:-2], [t[-2], t[-2] + np.exp(t[-1])]
        below = [1 / (1 + np.exp(-(c - s))) for c in cut]
        p = np.stack([below[0], below[1] - below[0], 1 - below[1]])
        return -np.log(p[grade, np.arange(5)]).sum() + 0.5 * quality.RIDGE * (t[:-2] ** 2).sum()

    value, grad = quality._loss(theta, off, cols, vals.astype(float), row, grade)
    assert abs(value - slow(theta)) < 1e-6 * abs(value)
    for j in [*used[::3], size, size + 1]:
        step = np.zeros_like(theta)
        step[j] = 1e-5
        assert abs((slow(theta + step) - slow(theta - step)) / 2e-5 - grad[j]) < 1e-3


def test_quality_loss_widens_a_run_of_features_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    size = rng.integers(2, 1_000, 3_000)
    off, row, grade = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(3_000, dtype=np.uint16), size), rng.integers(0, 3, 3_000)
    cols, vals = rng.integers(0, (1 << quality.BITS) + 2, off[-1]).astype(np.int32), rng.random(off[-1]).astype(np.float16)
    theta = np.append(rng.normal(size=(1 << quality.BITS) + 2) * 0.01, [-0.3, 0.2])
    tracemalloc.start()
    value, grad = quality._loss(theta, off, cols, vals, row, grade)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert off[-1] > 1_400_000 and peak < 12_000_000
    for block in (1, 5_000, 1 << 30):
        monkeypatch.setattr(quality, "FIT_BLOCK", block)
        again, other = quality._loss(theta, off, cols, vals, row, grade)
        assert again == value and (other == grad).all()


def test_fit_fetches_features_without_rows_of_python_objects(spark, monkeypatch):
    docs = table(spark, [(i, f"{'good' if i % 2 else 'bad'} w{i} w{i + 1}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(type(docs), "toPandas", lambda self: 1 / 0)
    monkeypatch.setattr(type(docs), "collect", lambda self: 1 / 0)
    model = quality.fit(docs.repartition(5), labels)
    monkeypatch.undo()
    assert model is not None and [r["kept"] for r in quality.score(docs, model).orderBy("doc_id").collect()] == [bool(i % 2) for i in range(60)]


def test_bitmap_of_few_nodes_takes_a_few_jobs(spark):
    docs = table(spark, [(i, f"a b c d e f{i}") for i in range(300)])
    nodes = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("node"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("bitmap", "bitmap")
        sets = minhash.full_sets(docs, nodes)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(jobs) < 25 and sorted(r["node"] for r in sets.select("node").collect()) == list(range(0, 300, 3))


def test_shards_are_written_alike_each_time(spark, tmp_path):
    docs = table(spark, [(i % 40, f"t{i}") for i in range(400)] + [(None, None)])
    sharding.write_shards(docs.drop("shard"), "doc_id", str(tmp_path / "a"), 4, 3)
    got = spark.read.parquet(str(tmp_path / "a"))
    want = {(r["doc_id"], r["text"]): r["shard"] for r in sharding.place(docs.drop("shard"), "doc_id", 4).collect()}
    assert {(r["doc_id"], r["text"]): r["shard"] for r in got.collect()} == want and got.count() == 401


def test_bpe_memo_is_bounded(monkeypatch):
    e = bpe.Encoder(bpe.vocabulary_path())
    monkeypatch.setattr(bpe, "MEMO", 2_000)
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) + " " + "long" * 500 + str(i) for i in range(40)]
    fresh = bpe.Encoder(bpe.vocabulary_path())
    for t in texts:
        assert e.whole([t]) == fresh.whole([t])
        assert e.held <= 2_000 and len(e.long) <= 1
