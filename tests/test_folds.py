"""Ordered folds over long groups, pages with filters, and backoff that forgets."""

import os
import random
import re
import time

from pyspark.sql import functions as F

from corpuscle.operators import analytics as an
from corpuscle.operators import logs
from corpuscle.operators import retrieval as op
from corpuscle.operators import text as tx
from corpuscle.streaming import jobs


def test_novel_texts_of_a_long_document_equal_a_plain_walk(spark):
    rnd = random.Random(2)
    rows = [(1, i, " ".join(f"w{rnd.randrange(50 + i // 20)}" for _ in range(6))) for i in range(100_000)]
    rows += [(2, 0, "A b"), (2, 1, None), (2, 2, ""), (2, 3, "a B c"), (2, 4, "a c d e"), (3, 0, "..."), (2, 4, "a c d e")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "document_id long, position long, text string").repartition(6)
    want = {}
    for doc in (1, 2, 3):
        seen, kept = set(), []
        for _, text in sorted((p, t or "") for d, p, t in rows if d == doc):
            tokens = set(re.findall("[a-z0-9]+", text.lower()))
            if tokens and len(tokens - seen) / len(tokens) >= 0.4:
                seen |= tokens
                kept.append(text)
        want[doc] = ("\n\n".join(kept), len(kept))
    began = time.time()
    got = {r["document_id"]: (r["text"], r["kept"]) for r in an.merge_novel(df).collect()}
    assert got == want and want[2] == ("A b\n\na c d e", 2) and want[3] == ("", 0) and time.time() - began < 30
    assert an.merge_novel(df.limit(0)).collect() == []


def test_segments_of_a_long_conversation_equal_a_plain_walk(spark):
    rnd = random.Random(3)
    rows = [("a", i, "user", "x" * rnd.randrange(60)) for i in range(50_000)] + [("b", 5, "user", None), ("b", 7, None, "q" * 500), (None, 1, "u", "t")]
    want = []
    for conv in ("a", "b", None):
        held, no = [], 0
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1]):
            line = ": ".join(x for x in (role, text) if x is not None)[:100]
            if held and (len(held) >= 7 or sum(len(x) for _, x in held) + len(held) + len(line) > 100):
                want.append((conv, no, held[0][0], held[-1][0], "\n".join(x for _, x in held)))
                held, no = [], no + 1
            held.append((turn, line))
        want.append((conv, no, held[0][0], held[-1][0], "\n".join(x for _, x in held)))
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5)
    got = [tuple(r) for r in tx.segment_conversations(df, 7, 100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tx.segment_conversations(df.limit(0)).collect() == []


def test_pages_with_filters(spark):
    rows = [(i, "ready" if i % 2 else "queued", i % 3 == 0, [i % 5, 9] if i % 7 else None) for i in range(60)] + [(100, None, None, [])]
    df = spark.createDataFrame(rows, "id long, state string, selected boolean, scope array<long>")
    want = [i for i, s, sel, sc in rows if s == "ready" and sel and sc and set(sc) & {2, 4} and i > 10]
    page = op.keyset_page(df, ["id"], [10], 2, {"state": "ready", "selected": True, "missing": None}, ("scope", [2, 4])).collect()
    assert [r["id"] for r in page] == want[:2] and page[-1]["next_cursor"] == str(want[1])
    rest = op.keyset_page(df, ["id"], [want[1]], 1000, {"state": "ready", "selected": True}, ("scope", [2, 4])).collect()
    assert [r["id"] for r in rest] == want[2:] and all(r["next_cursor"] is None for r in rest)
    assert op.keyset_page(df, ["id"], None, 5, None, ("scope", [])).collect() == []


ATTEMPTS = "host long, attempt_id long, ts timestamp, throttled boolean, retry_after int"


def test_backoff_state_of_hosts_that_never_succeed_goes(spark, tmp_path):
    day = lambda rows: spark.createDataFrame([(h, i, float(m), t, r) for h, i, m, t, r in rows], "host long, attempt_id long, minute double, throttled boolean, retry_after int").select("host", "attempt_id", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("ts"), "throttled", "retry_after")
    batches = [
        [(h, h, h % 50, True, None) for h in range(500)],  # 500 hosts are throttled and never seen again, but for two
        [(1, 1001, 60, True, 7), (2, 1002, 61, False, None), (1000, 1003, 3000, True, None)],  # the watermark moves on
        [(1, 1004, 3001, True, None), (1000, 1005, 3002, True, None), (1001, 1006, 3003, False, None)],
        [(1002, 1007, 9000, False, None)],
    ]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    held = []
    for rows in batches:
        day(rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ATTEMPTS).parquet(source)
        query = jobs.stream_backoff(stream, forget_s=86_400).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held == [500, 1, 2, 0]
    want = logs.backoff(day([r for rows in batches for r in rows]), forget_s=86_400)
    key = lambda df: sorted(tuple(r) for r in df.select("host", "attempt_id", "strikes", "wait_s").collect())
    assert key(spark.read.schema("host long, attempt_id long, strikes int, wait_s double").parquet(out)) == key(want)
    strikes = {r["attempt_id"]: r["strikes"] for r in want.collect()}
    assert strikes[1001] == 2 and strikes[1004] == 1 and strikes[1005] == 2 and os.path.isdir(check)
