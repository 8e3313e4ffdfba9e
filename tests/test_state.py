"""Keyed state of the streams and the jobs that use it: replays, restarts, what is written, order of arrival."""

import os
import random

from pyspark.sql import functions as F

from corpuscle.operators import logs, web
from corpuscle.operators import text as tx
from corpuscle.streaming import jobs
from corpuscle.streaming.state import KeyedState

ROWS = "k long, v string"


def table(spark, rows):
    return spark.createDataFrame(list(rows), ROWS)


def content(state, before=None):
    return sorted(map(tuple, state.current(before).collect()))


def test_epochs_change_replay_and_go_on_after_a_restart(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    state = KeyedState(root, table(spark, [(i, "a") for i in range(20)]), ["k"], buckets=4)
    state.apply(0, table(spark, [(1, "b"), (50, "b")]), table(spark, [(2, None), (3, None), (1, None)]).select("k"))
    after = [(1, "b"), *((i, "a") for i in range(20) if i not in (1, 2, 3)), (50, "b")]
    assert content(state) == sorted(after)
    again = KeyedState(root, table(spark, [(9, "other")]), ["k"], buckets=4)  # a new driver; its initial rows don't count
    assert content(again) == sorted(after) and len(content(again, 0)) == 20
    again.apply(0, table(spark, [(1, "c")]))  # the epoch runs once more and starts from the state before it
    assert content(again) == sorted([(1, "c"), *((i, "a") for i in range(20) if i != 1)])
    again.apply(1, table(spark, []), table(spark, [(i, None) for i in range(20)]).select("k"))
    assert content(again) == [] and content(again, 1)[0] == (0, "a")
    again.apply(2, table(spark, [(2, "d")]))
    assert content(again) == [(2, "d")]


def test_many_epochs_equal_a_dictionary(spark, tmp_path):
    rnd, root = random.Random(1), f"file://{tmp_path}/state"
    state, want = KeyedState(root, table(spark, []), ["k"], buckets=2), {}
    assert content(state) == []
    for epoch in range(9):
        changed = {rnd.randrange(40): f"{epoch}" for _ in range(rnd.choice([0, 1, 12]))}
        gone = {k for k in rnd.sample(range(40), rnd.choice([0, 3])) if k not in changed}
        state.apply(epoch, table(spark, changed.items()), table(spark, [(k, None) for k in gone]).select("k"))
        want = {k: v for k, v in (want | changed).items() if k not in gone}
        assert content(state) == sorted(want.items())
    assert max(len([f for f in state.files() if f["bucket"] == b]) for b in (0, 1)) <= 1 + 3 * 3  # a base and fewer than FAN files of each tier
    near = {r["k"] for r in state.near(table(spark, [(5, None)])).collect()}
    assert near == {k for k in want if k in near} and (5 in near) == (5 in want)


def _bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_its_share_and_old_files_go(spark, tmp_path):
    root = tmp_path / "state"
    wide = lambda lo, hi, tag: spark.range(lo, hi).select(F.col("id").alias("k"), F.sha2(F.concat(F.lit(tag), "id"), 256).alias("v"))
    state = KeyedState(f"file://{root}", wide(0, 40_000, "a"), ["k"], buckets=8)
    whole = _bytes(root / "data")
    for epoch in range(3):
        before = {f["path"] for f in state.files()}
        state.apply(epoch, wide(400 * epoch, 400 * epoch + 400, f"b{epoch}"))
        new = [f for f in state.files() if f["path"] not in before]
        assert sum(f["rows"] for f in new) == 400  # 1 % of the keys
        assert sum(_bytes(f["path"].removeprefix("file:")) for f in new) < 0.03 * whole
    state.apply(3, wide(0, 40_000, "c"))  # all of them: new bases
    state.apply(4, wide(0, 1, "d"))
    state.apply(5, wide(0, 1, "e"))
    assert all(f["base"] for f in state.files() if f["rows"] > 1)
    assert _bytes(root / "data") < 1.3 * whole and len(os.listdir(root / "manifest")) == 2
    assert state.current().count() == 40_000


# ---- sessions

EVENTS = "user_id long, event_id long, ts timestamp, ends boolean"


def _events(spark, rows):
    return spark.createDataFrame([(u, i, float(m), e) for u, i, m, e in rows], "user_id long, event_id long, minute double, ends boolean").select("user_id", "event_id", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("ts"), "ends")


def _minutes(df):
    m = lambda c: ((F.unix_micros(c) / 1_000_000 - 1_700_000_000) / 60).alias(c)
    return sorted((tuple(r) for r in df.select("user_id", m("start"), m("due"), "messages", "reason", "state").collect()), key=str)


CASES = [
    (1, 1, 0, False), (1, 2, 10, False), (1, 3, 40, False), (1, 4, 200, False),  # exactly 30 minutes later is a new session
    (2, 5, 0, False), (2, 6, 5, True), (2, 7, 6, False), (2, 8, 500, False),  # nothing counts after an end
    (3, 9, 0, False), (3, 10, 60, True),  # an end after the session was due
    (4, 11, 0, True), (4, 12, 1, False),  # an end without messages
    (5, 13, 3, False), (5, 14, 3, False), (5, 15, 3, True), (5, 16, 3, False),  # ties go by event_id
    (None, 17, 0, False),
]
WANT = [
    (1, 0, 40, 2, "idle", "stale"), (1, 40, 70, 1, "idle", "stale"), (1, 200, 230, 1, "idle", "ready"),
    (2, 0, 5, 1, "end", "ready"), (3, 0, 30, 1, "idle", "ready"), (5, 3, 3, 2, "end", "ready"),
]


def test_session_summaries(spark):
    assert _minutes(logs.session_summaries(_events(spark, CASES))) == sorted(WANT, key=str)
    assert logs.session_summaries(_events(spark, CASES[:0])).collect() == []


def test_stream_of_summaries_equals_its_twin_in_any_order_of_arrival(spark, tmp_path):
    rnd = random.Random(3)
    rows = CASES + [(u, 100 + 50 * u + i, float(rnd.randrange(400)), rnd.random() < 0.05) for u in range(10, 16) for i in range(40)]
    late = sorted(rows, key=lambda r: r[2] + rnd.uniform(0, 9))  # up to nine minutes out of order
    close = [(u, 9000 + u, 1e5, False) for u in {r[0] for r in rows if r[0] is not None}]
    end = [(99, 9999, 2e5, False)]
    source = str(tmp_path / "events")
    for part in [*(late[i::1][: len(late) // 5] for i in range(0, len(late), len(late) // 5)), close, end]:
        _events(spark, part).coalesce(1).write.mode("append").parquet(source)
        os.sync()
    files = sorted((os.path.getmtime(os.path.join(source, f)), f) for f in os.listdir(source) if f.endswith(".parquet"))
    assert len(files) >= 7
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")

    jobs.stream_summaries(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).where(F.col("start") < F.timestamp_seconds(F.lit(1_700_000_000 + 6e6 - 60)))
    changes = got.groupBy("user_id", "start").agg(*(F.max_by(c, "state").alias(c) for c in ("due", "messages", "reason", "state")))
    want = [r for r in _minutes(logs.session_summaries(_events(spark, rows + close))) if r[1] < 1e5]
    assert _minutes(changes) == want
    assert any(r[5] == "stale" for r in want) and any(r[4] == "end" for r in want)


# ---- crawls


def test_validators_of_kept_pages(spark):
    pages = spark.createDataFrame([("k", "h", "e1", "m1", 1), ("s", "h", "e1", "m1", 1), ("u", "h", "e1", "m1", 1), ("r", "h", "e1", "m1", 1), ("f", "h", "e1", "m1", 1), ("x", "h", None, None, 1)], "url string, sha256 string, etag string, last_modified string, fetched_at int")
    fetches = spark.createDataFrame([("k", 304, None, "e2", "", 2), ("s", 200, "h", None, "m2", 2), ("u", 200, "g", None, "m2", 2), ("r", 410, None, "e", "m", 2), ("f", 503, None, "e", "m", 2), ("n", 200, "g", "e", None, 2)], "url string, status int, sha256 string, etag string, last_modified string, fetched_at int")
    got = {r["url"]: tuple(r)[1:] for r in web.crawl_merge(pages, fetches).collect()}
    assert got == {
        "k": ("kept", "h", "e2", "m1", 2), "s": ("kept", "h", "e1", "m2", 2), "u": ("updated", "g", None, "m2", 2), "r": ("removed", None, None, None, None),
        "f": ("untouched", "h", "e1", "m1", 1), "x": ("untouched", "h", None, None, 1), "n": ("updated", "g", "e", None, 2),
    }


def test_chunks_after_a_merge(spark):
    chunks = spark.createDataFrame([("k1", "k"), ("u1", "u"), ("u2", "u"), ("r1", "r"), ("x1", "x")], "chunk_id string, url string")
    merged = spark.createDataFrame([("k", "kept"), ("u", "updated"), ("r", "removed"), ("n", "updated"), ("f", "failed")], "url string, action string")
    new = spark.createDataFrame([("u2", "u"), ("u3", "u"), ("n1", "n"), ("k9", "k"), ("f9", "f")], "chunk_id string, url string")
    got = sorted(map(tuple, web.merge_chunks(chunks, merged, new).collect()))
    assert got == [("k1", "k", "kept"), ("n1", "n", "added"), ("r1", "r", "deleted"), ("u1", "u", "deleted"), ("u2", "u", "added"), ("u3", "u", "added"), ("x1", "x", "kept")]


def test_stream_of_fetches_chunks_and_embeds_updated_pages_alone(spark, tmp_path):
    schema = "url string, status int, sha256 string, text string, fetched_at int"
    first = [("a", 200, "1", "one two", 1), ("b", 200, "1", "three", 1), ("c", 200, "1", "four", 1)]
    second = [("a", 200, "2", "one new", 2), ("a", 200, "0", "older", 1), ("b", 304, None, None, 2), ("c", 404, None, None, 2), ("d", 500, None, None, 2)]
    calls = []

    def chunk(pages):
        calls.extend(r["url"] for r in pages.select("url").collect())
        return pages.select("url", F.explode(F.split("text", " ")).alias("text")).withColumn("chunk_id", F.concat_ws("#", "url", "text"))

    embed = lambda rows: tx.embed_hash(rows, 16)
    root = f"file://{tmp_path}"
    none = spark.createDataFrame([], "url string, text string, chunk_id string")
    pages = KeyedState(f"{root}/pages", spark.createDataFrame([], "url string, sha256 string, fetched_at int"), ["url"], buckets=4)
    chunks = KeyedState(f"{root}/chunks", embed(none), ["url", "chunk_id"], ["url"], buckets=4)
    deleted = []
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        jobs.stream_corpus(stream, pages, chunks, chunk, f"{root}/check", embed, lambda ids, _: deleted.extend(r[0] for r in ids.collect())).awaitTermination()
    assert sorted(calls) == ["a", "a", "b", "c"] and sorted(deleted) == ["a#two", "c#four"]
    assert sorted(map(tuple, pages.current().collect())) == [("a", "2", 2), ("b", "1", 2)]
    got = {r["chunk_id"]: r["embedding"] for r in chunks.current().collect()}
    assert set(got) == {"a#one", "a#new", "b#three"} and all(len(v) == 16 for v in got.values())


def test_stream_sync_restarts_and_writes_only_changes(spark, tmp_path):
    schema = "document_id long, title string, sha256 string, path array<string>"
    root = f"file://{tmp_path}"
    make = lambda: KeyedState(f"{root}/state", spark.createDataFrame([(i, "t", "h", ["p"]) for i in range(30)], schema), ["document_id"], buckets=4)
    seen = []
    for rows in ([(1, "t", "h", ["p"]), (2, "t", "new", ["p"])], [(2, "t", "new", ["p"]), (40, "t", "h", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        state = make()  # a new driver each time
        jobs.stream_sync(spark.readStream.schema(schema).parquet(f"{root}/in"), state, lambda df, _: seen.extend((r["document_id"], r["action"]) for r in df.collect()), f"{root}/check").awaitTermination()
    assert seen == [(2, "changed"), (40, "added")]
    assert make().current().count() == 31 and sum(f["rows"] for f in make().files()) <= 33
