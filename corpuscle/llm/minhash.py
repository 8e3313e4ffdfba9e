"""MinHash near-dedup with sequential Bayesian verification (op 7).

1. One pass over the texts: set size, set fingerprint and MinHash signature (bands x ROWS functions) of the distinct
   five-word shingles. Equal sets form a class (grouped by fingerprint with map-side combine); only classes go on.
2. Bands: classes that agree in all rows of a band share a bucket. At a link threshold t a pair shares none of
   the bands with probability (1 - t**ROWS)**bands; there are as many bands as bring that to BAND_MISS.
3. Star: each bucket's members are paired with its leader only, the member with the most bucket mates overall
   (the original among edited copies), never with each other.
4. Sequential Bayesian test: a pair's signatures are compared batch by batch; after n functions with m matches the
   posterior P(J >= t) under a uniform prior is P(Bin(n + 1, t) <= m), and the pair is pruned as soon as that is
   below MISS. Survivors are confirmed on their full sets.
5. The rest: buckets that still hold two components are searched through with numpy, small ones many at a time and
   larger ones in blocks of BLOCK members; a
   pair is tested in the first bucket the two share, if they are in different components. So every link between
   components is found, and no pairs within a group are emitted.
6. Components by alternating large-star and small-star rounds on tables in the shared folder.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; texts of one to four words have
one shingle, the whole sequence; rows of equal doc_id are one vertex; a row with null doc_id is linked
with nothing, its component_id is null and it is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import KeyFilter, blocks, key_filter, materialise, mix, ngrams

WORDS = 5
ROWS = 5
#: A link of op 7: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Probability that a pair at the threshold shares no band.
BAND_MISS = 3e-7
#: Chosen miss probability of one Bayesian test.
MISS = 1e-6
#: Hash functions compared at a time.
BATCH = 26
#: Members of a bucket compared at a time, and bucket size from which full sets travel with the members.
BLOCK, LARGE = 1024, 64
#: Most nodes whose bitmap, 2 MB then, is fetched in one job instead of one for each partition.
AT_ONCE = 1 << 19


@cache
def functions(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the hash functions: ROWS for each band that the threshold needs (26 bands at 85, 38 at 80)."""
    k = ROWS * math.ceil(math.log(BAND_MISS) / math.log(1 - (min(percent, 99) / 100) ** ROWS))
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(1, 1 << 63, size=k, dtype=np.uint64)


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest matches of n functions at which P(J >= percent / 100 | matches) is at least ``miss``."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def shingles(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, shingle hashes, offsets by text) of blocks of texts; a hash for each shingle occurrence."""
    for first, end, b in blocks(texts, lower=True):
        n = np.diff(b.off)
        g = ngrams(b.h, WORDS)
        count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
        off = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(off[-1], dtype=np.uint64)
        at = np.repeat(b.off[:-1] - off[:-1], count) + np.arange(off[-1])
        long = np.repeat(n >= WORDS, count)
        out[long] = g[at[long]]
        for i in np.flatnonzero((n > 0) & (n < WORDS)):
            out[off[i]] = mix(ngrams(b.h[b.off[i] : b.off[i + 1]], int(n[i])) ^ np.uint64(n[i]))[0]
        yield first, out, off


def _sketch(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mul, add = functions(percent)
        for pdf in it:
            ids = pdf["doc_id"]
            for first, h, off in shingles(pdf["text"].tolist()):
                size = len(off) - 1
                n, f1, f2 = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
                for i in range(size):
                    u = np.unique(h[off[i] : off[i + 1]])
                    n[i], f1[i], f2[i] = len(u), u.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(u)) if len(u) else 0
                some = np.flatnonzero(n > 0)
                sig = np.zeros((size, len(mul)), dtype=np.uint32)
                for k in range(len(mul) if len(some) else 0):
                    sig[some, k] = np.minimum.reduceat(h * mul[k] + add[k], off[:-1][some]) >> np.uint64(32)
                raw = [s.tobytes() for s in sig]
                yield pd.DataFrame({"doc_id": ids.iloc[first : first + size].astype("Int64"), "n": n, "f1": f1.view(np.int64), "f2": f2.view(np.int64), "sig": [r if k else None for r, k in zip(raw, n, strict=True)]})

    return run


def band_keys(sig: np.ndarray) -> np.ndarray:
    """64-bit key of each band, shape (rows, bands)."""
    bands = sig.shape[1] // ROWS
    out = np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C55) + sig[:, r::ROWS]
    return mix(out + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _signatures(column: pd.Series) -> np.ndarray:
    raw = b"".join(column)
    return np.frombuffer(raw, dtype=np.uint32).reshape(len(column), len(raw) // 4 // max(1, len(column)))


def _bands(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            keys = band_keys(_signatures(part["sig"]))
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "band": np.tile(np.arange(keys.shape[1], dtype=np.int32), len(part)), "node": np.repeat(part["node"].to_numpy(), keys.shape[1])})


@cache
def _least(k: int, percent: int) -> dict[int, int]:
    """Fewest matches at the end of each batch of k functions."""
    return {n: least_matches(n, percent) for n in [*range(BATCH, k, BATCH), k]}


def survivors(sa: np.ndarray, ia: np.ndarray, sb: np.ndarray, ib: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs (ia of sa, ib of sb) survive the sequential test; na, nb: set sizes, an exact bound on J."""
    x, y = na[ia], nb[ib]
    alive = np.flatnonzero(100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    matches = np.zeros(len(ia), dtype=np.int64)
    done = 0
    for n, least in _least(sa.shape[1], percent).items():
        for at in range(0, len(alive), 100_000):
            p = alive[at : at + 100_000]
            matches[p] += (sa[ia[p], done:n] == sb[ib[p], done:n]).sum(axis=1)
        alive, done = alive[matches[alive] >= least], n
    return alive


def _test(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 4000):
                p = pdf.iloc[at : at + 4000]
                i = np.arange(len(p))
                ok = survivors(_signatures(p["sig_a"]), i, _signatures(p["sig_b"]), i, p["n_a"].to_numpy(), p["n_b"].to_numpy(), percent)
                yield p.iloc[ok][["a", "b"]]

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on two sorted arrays of distinct shingle hashes."""
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ok = [linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    return run


def _sets(wanted: KeyFilter):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            part = pdf[wanted.hit(pdf["doc_id"].to_numpy(dtype=np.int64))]
            for first, h, off in shingles(part["text"].tolist()):
                ids = part["doc_id"].iloc[first : first + len(off) - 1]
                yield pd.DataFrame({"node": ids, "shingles": [np.unique(h[off[i] : off[i + 1]]).tobytes() for i in range(len(ids))]})

    return run


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles: full sets of the given distinct nodes, written out; texts are not shuffled (a bitmap picks them)."""
    nodes = materialise(nodes)
    # ids are not mixed: one bit tells dense ones apart, further probes would hit their neighbours
    wanted = key_filter(nodes, 1, at_once=nodes.count() <= AT_ONCE)
    picked = docs.where("doc_id is not null").mapInPandas(_sets(wanted), "node long, shingles binary")
    sets = materialise(picked.join(nodes, "node", "left_semi").distinct())
    wanted.release()
    return sets


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = full_sets(docs, nodes)
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInPandas(_confirm(percent), "a long, b long")


def _buckets(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Survivors (a, b) between different components of each bucket; pdf holds whole buckets, sorted by key."""
    key, comp, band, node = (pdf[c].to_numpy() for c in ("key", "comp", "band", "node"))
    sig, n = _signatures(pdf["sig"]), pdf["n"].to_numpy()
    keys = band_keys(sig)
    own = np.arange(len(pdf))
    count = np.searchsorted(key, key, "right") - own - 1
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for at in range(0, len(pdf), 1_000):
        c = count[at : at + 1_000]
        i = np.repeat(own[at : at + 1_000], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        other = comp[i] != comp[j]
        i, j = i[other], j[other]
        earlier = ((keys[i] == keys[j]) & (np.arange(keys.shape[1]) < band[i][:, None])).any(axis=1)
        i, j = i[~earlier], j[~earlier]
        ok = survivors(sig, i, sig, j, n, n, percent)
        a.append(node[i[ok]])
        b.append(node[j[ok]])
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "sure": False})


def _search_small(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``_buckets`` over a partition sorted by key; a bucket is at most LARGE members (times the texts of one doc_id)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in it:
            if len(pdf):
                held = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
                end = int(np.searchsorted(held["key"].to_numpy(), held["key"].iloc[-1], "left"))
                if end:
                    yield _buckets(held.iloc[:end].reset_index(drop=True), percent)
                    held = held.iloc[end:]
        if held is not None and len(held):
            yield _buckets(held.reset_index(drop=True), percent)

    return run


def _search(pdf: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """One block pair of one bucket: links (or, without sets, survivors) between different components."""
    bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    pdf = pdf.drop_duplicates(["node", "sig"])
    left = pdf[pdf["blk"] == bi]
    right = left if bi == bj else pdf[pdf["blk"] == bj]
    none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "sure": pd.Series(dtype="bool")})
    if not len(left) or not len(right):
        return none
    sa, sb = _signatures(left["sig"]), _signatures(right["sig"])
    ka, kb = band_keys(sa), band_keys(sb)
    band = int(pdf["band"].iloc[0])
    ca, cb, na, nb = (x.to_numpy() for x in (left["comp"], right["comp"], left["n"], right["n"]))
    ids_a, ids_b = left["node"].to_numpy(), right["node"].to_numpy()
    pairs_a, pairs_b = [], []
    for i in range(len(left)):
        j = np.flatnonzero(cb != ca[i])
        if bi == bj:
            j = j[j > i]
        if band and len(j):
            j = j[~(kb[j, :band] == ka[i, :band]).any(axis=1)]
        pairs_a.append(np.full(len(j), i))
        pairs_b.append(j)
    ia, ib = np.concatenate(pairs_a), np.concatenate(pairs_b)
    ok = survivors(sa, ia, sb, ib, na, nb, percent)
    ia, ib = ia[ok], ib[ok]
    sure = bool(pdf["shingles"].notna().all())
    if sure and len(ia):
        xa, xb = [np.frombuffer(s, dtype=np.uint64) for s in left["shingles"]], [np.frombuffer(s, dtype=np.uint64) for s in right["shingles"]]
        root = {c: c for c in np.concatenate([ca, cb]).tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        keep = []
        for k, (i, j) in enumerate(zip(ia.tolist(), ib.tolist(), strict=True)):
            x, y = find(int(ca[i])), find(int(cb[j]))
            if x != y and linked(xa[i], xb[j], percent):
                root[x] = y
                keep.append(k)
        ia, ib = ia[keep], ib[keep]
    return pd.DataFrame({"a": ids_a[ia], "b": ids_b[ib], "sure": sure}) if len(ia) else none


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node reachable, for the nodes of edges (a, b). Alternating star rounds."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = materialise(small.where("u <> v").distinct())
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")


def near_links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes: enough of them to connect every component. classes: node, n, sig; written out."""
    rows = classes.select("node", "sig").mapInPandas(_bands, "key long, band int, node long").dropDuplicates(["key", "node"])
    buckets = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = materialise(rows.join(buckets, "key"))
    degree = members.groupBy("node").agg(F.sum("m").alias("degree"))
    leader = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("l")).select("key", (-F.col("l.minus")).alias("leader"))
    pairs = members.join(leader, "key").where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    tested = materialise(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_test(percent), "a long, b long").distinct())
    star = materialise(confirm(tested, docs, percent))
    # buckets that still hold two components
    comp = components(star)
    placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = materialise(placed.join(open_, "key").select("key", "band", "node", "comp", "m"))
    sets = full_sets(docs, rest.where(F.col("m") > LARGE).select("node").distinct())
    blocks_of = F.ceil(F.col("m") / BLOCK).cast("int")
    small = rest.where(F.col("m") <= LARGE).select("key", "band", "node", "comp").join(classes.select("node", "n", "sig"), "node")
    found = small.repartition("key").sortWithinPartitions("key").mapInPandas(_search_small(percent), "a long, b long, sure boolean")
    blk = F.pmod(F.xxhash64("node"), F.greatest(blocks_of, F.lit(1))).cast("int")
    large = rest.where(F.col("m") > LARGE).withColumn("blk", blk).withColumn("other", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
    large = large.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other")
    large = large.join(sets, "node").join(classes.select("node", "n", "sig"), "node")
    found = materialise(found.unionByName(large.groupBy("key", "bi", "bj").applyInPandas(lambda pdf: _search(pdf, percent), "a long, b long, sure boolean")))
    return star.unionByName(found.where("sure").select("a", "b")).unionByName(confirm(found.where("not sure").select("a", "b").distinct(), docs, percent))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); a link has 100 * intersection >= percent * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(docs.mapInPandas(_sketch(percent), "doc_id long, n long, f1 long, f2 long, sig binary"))
    some = rows.where("doc_id is not null and n > 0")
    node = some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"))
    classes = some.join(node.select(F.col("node").alias("doc_id"), "f1", "f2", "n"), ["doc_id", "f1", "f2", "n"], "left_semi").select(F.col("doc_id").alias("node"), "n", "sig").dropDuplicates(["node", "sig"])
    links = near_links(docs, materialise(classes), percent)
    # rows of a class are linked through their node; rows of one doc_id are one vertex
    own = some.join(node, ["f1", "f2", "n"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    comp = components(links.unionByName(own))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(comp.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(sh) AS sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.y, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""
