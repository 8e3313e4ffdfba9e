"""Ops 11 to 13 against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import lexical, packing, resampling
from corpuscle.llm.lexemes import Lexemes, runs
from tests.oracle import FOLDER, same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _words(text):
    return TERM.findall((text or "").translate(LOWER))


def _texts(seed, n, most=60):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["Ärger", "ciónes", "東京", "ÉTÉ", "x" * 70, "A1b2"]
    out = []
    for _ in range(n):
        words = [vocabulary[int(len(vocabulary) * rnd.random() ** 3)] for _ in range(rnd.randrange(most))]
        out.append("".join(w + rnd.choice([" ", "  ", "\n", ", ", "-", "\x00"]) for w in words))
    return out


def test_runs_give_the_terms_of_every_text():
    texts = [*_texts(1, 40), "", None, "  ,, ", "one", "tail " * 500, "y" * 3000 + " z " + "q" * 900, "\x7f.a"]
    for size in (40, 500, 1 << 20):
        got = {i: [] for i in range(len(texts))}
        for owner, lap, lex in runs([t.encode() if t is not None else None for t in texts], size):
            for j, (i, again) in enumerate(zip(owner.tolist(), lap.tolist())):
                terms = [lex.data[a:b].tobytes().decode() for a, b in zip(lex.s[lex.off[j] : lex.off[j + 1]], lex.e[lex.off[j] : lex.off[j + 1]])]
                if again:
                    assert terms[0] == got[i][-1]
                got[i] += terms[again:]
        assert [got[i] for i in range(len(texts))] == [_words(t) for t in texts]


def test_crc_of_features_equals_zlib():
    words = ["a", "bc", "def", "ghij", "klmno", "x" * 63, "y" * 64, "z" * 65, "ü" * 40, "q", "東" * 50, "r" * 200, "s"]
    random.Random(3).shuffle(words)
    one, two = resampling.crc_features(Lexemes([" ".join(words).encode()]))
    assert one.tolist() == [zlib.crc32(w.encode()) for w in words]
    assert two.tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])]
    assert [len(x) for x in resampling.crc_features(Lexemes([b""]))] == [0, 0]


# ---- op 11


def _search(docs, items, k):
    words = [(d, _words(t)) for d, t in docs]
    n_docs, n_terms = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    asked, out = {}, []
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(_words(t))
    for i, terms in asked.items():
        scores = []
        for d, w in words:
            if d is not None and w:
                m, tf = 50 + 50 * len(w) * n_docs // n_terms, Counter(w)
                s = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
                if s > 0:
                    scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # many shards, blocks and rounds
        for name, value in (("BLOCK", 4), ("LONG", 3), ("SHARD_POSTINGS", 300), ("ROUND", 1), ("ITEM_BLOCK", 7)):
            monkeypatch.setattr(lexical, name, value)
    docs = [(i, t) for i, t in enumerate(_texts(5, 300))]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(7, docs[7][1]), (8, "w1 w2 other"), (None, "w1 w250 w251"), (2000, None), (2001, ""), (2002, " .. "), (2003, "w3 w299 " * 3000)]
    items = [(i, t) for i, t in enumerate(_texts(6, 25, 30))] + [(3, "w200 w201"), (100, None), (101, ""), (None, "w1"), (102, "nowhere"), (103, docs[7][1]), (104, "W1 w1 W1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "row", "n", "terms", "shard")}).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1)).withColumn("term", F.lit(2))
    got = sorted(tuple(r) for r in lexical.search(d, i, 20).collect())
    assert got == _search(docs, items, 20)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(items.toDF("doc_id", "text"), none.toDF("item_id", "text")).collect() == []
    assert lexical.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).collect() == []


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 16)
    monkeypatch.setattr(lexical, "LONG", 8)
    rng = np.random.default_rng(2)
    topics = [rng.choice(400, 40, replace=False) for _ in range(20)]
    rows = [np.unique(np.concatenate([rng.choice(topics[i % 20], 12), rng.integers(0, 400, 3)])) for i in range(1500)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms = np.concatenate(rows).astype(np.int64)
    impact = rng.integers(1, 10**6, len(terms))
    vocabulary = np.unique(rng.integers(-(2**62), 2**62, 500))[:400]
    arrays = lexical.build_shard(np.arange(1500), at, vocabulary[terms], impact)
    cold, warm = lexical.Shard(dict(arrays)), lexical.Shard(dict(arrays))
    none = np.empty(0, dtype=np.int64)
    for q in range(20):
        asked, weight = np.unique(topics[q][:10]), rng.integers(100, 9000, 10)
        w = np.zeros(400, dtype=np.int64)
        w[asked] = weight
        whole = np.add.reduceat(w[terms] * impact, at[:-1])
        places, expect = np.searchsorted(cold.vocabulary, vocabulary[asked]), sorted(zip(-whole, range(1500)))[:10]
        for floor, shard in ((1, cold), (-expect[-1][0], warm)):  # the least and the greatest threshold that a search may start from
            score, ids = shard.search(places, weight, floor, 10, (none, none))
            assert list(zip(-score, ids)) == expect
    assert cold.entered < 0.8 * cold.blocks and warm.entered < 0.5 * cold.blocks  # also fewer terms are entered when warm


def test_op11_equals_its_sql(spark):
    same(spark, lexical.op11_geometric_search, lexical.ORACLE)


# ---- op 12


def _plain(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _packed(rows, docs, ids_of, limit):
    """Checks rows against documents given as (doc_id, text) with unique ids."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = [*ids_of(text), 1], 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            raw = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["offset"], r["ids_crc32"]) == (at, len(ids), 0, zlib.crc32(raw))
            assert r["length"] <= limit and r["length"] & (r["length"] - 1) == 0
            at += r["length"]
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)  # a bucket's numbers follow each other


def test_packing_equals_brute_force(spark):
    path = packing.vocabulary_path()
    docs = [(i, t) for i, t in enumerate(_texts(9, 120, 200))]
    docs += [(200, None), (201, ""), (202, "a"), (203, "<|endoftext|>x <|endoftext|>"), (204, " " * 200_000 + "x"), (205, "b" * 100_000), (206, "word\n and, " * 30_000), (207, "é　  \x1c東京 " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("start", "length", "task", "key")}).repartition(6)
    got = packing.pack(df, path, 64)
    _packed(got.collect(), docs, _plain(path), 64)
    ids = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], dtype="<u4").tolist() for r in got.where("doc_id in (3, 203)").collect()}
    for d in (3, 203):
        assert sum((v for (k, _), v in sorted(ids.items()) if k == d), []) == [*_plain(path)(docs[d if d == 3 else 123][1]), 1]


def test_packing_repeated_rows_other_keys_and_no_rows(spark, tmp_path):
    path = packing.vocabulary_path()
    df = spark.createDataFrame([("a", "one two three"), ("a", "one two three"), (None, "x")], "doc_id string, text string")
    got = packing.pack(df, path, 2)
    assert Counter(r["doc_id"] for r in got.collect()) == {"a": 4, None: 1}
    assert got.select("sequence_id").distinct().count() == 5
    packing.write_buckets(got, str(tmp_path / "buckets"))
    assert spark.read.parquet(str(tmp_path / "buckets")).groupBy("length").count().count() == 1
    assert packing.pack(df.limit(0), path).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, path, 48)


def test_encoder_equals_the_tokenizers_library():
    path = packing.vocabulary_path()
    enc, plain = packing.ByteEncoder.of(path), _plain(path)
    texts = [f"ab{chr(c)}cd1{chr(c)}2 {chr(c)}{chr(c)} x.{chr(c)}.  " for c in [*range(0x3100), 0x1F600, 0x10FFFF]]
    texts += ["'s'S'll ''re don't", " \n\n  x", "\r\n\t", "a  b"]
    assert all(enc.ids(t).tolist() == plain(t) for t in texts)


def test_op12_over_its_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    _packed(packing.op12_binary_packing(spark, FOLDER).collect(), docs, _plain(packing.vocabulary_path()), 2048)


# ---- op 13


def _resampled(docs, target, percent=25, least=20):
    def features(text):
        w = _words(text)
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for table, out in ((docs, s), (target, t)):
        for _, text in table:
            out.update(features(text)[1])
    in_s, in_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * in_s / ((s[b] + 1) * in_t))) for b in range(10000)]
    out = []
    for d, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for i, r in enumerate(able):
        r[4] = i + 1 if i < percent * len(able) // 100 else None
    return sorted((tuple(None if x is False else x for x in r) for r in out), key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_equals_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(_texts(11, 400))] + [(500, None), (501, ""), (502, "a b c"), (None, "w1 w2 " * 15), (503, ("q" * 90 + " w5 Ü ") * 60_000)]
    target = [(i, t) for i, t in enumerate(_texts(12, 30))] + [(90, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "weight", "rank", "_row")}).repartition(5)
    t = spark.createDataFrame(target, "item_id long, text string")
    assert _rows(resampling.resample(d, t)) == _resampled(docs, target)
    assert _rows(resampling.resample(d, t.limit(0), 60, 5)) == _resampled(docs, [], 60, 5)


def test_resampling_of_equal_rows_and_no_rows(spark):
    text = "w1 w2 w3 w4 w5 " * 5
    d = spark.createDataFrame([(1, text)] * 41 + [(2, text)] * 3, "doc_id long, text string").repartition(4)
    t = spark.createDataFrame([("w1",)], "text string")
    got = resampling.resample(d, t).collect()
    assert len(got) == 44 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 12))
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert resampling.resample(d.limit(0), t).collect() == []
    assert resampling.selected(d.where("doc_id = 2").limit(1), resampling.resample(d, t, 100)).count() == 3


@pytest.mark.parametrize("pivots", [1, 3, 31])
def test_quickselect_finds_each_place(spark, pivots):
    rnd = random.Random(4)
    rows = [(rnd.randrange(5), rnd.choice([None, 1, 2]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    for k in (1, 2, 17, 59, 60):
        assert resampling.kth(df, ["a", "b", "c"], k, pivots)[0] == order[k - 1]


def test_op13_over_its_table(spark):
    docs, target = ([tuple(r) for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert _rows(resampling.op13_importance_resample(spark, FOLDER)) == _resampled(docs, target)
