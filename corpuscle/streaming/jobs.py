"""Structured Streaming forms of the maintenance operators. Each equals its batch twin on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuscle.operators import logs, sync, web
from corpuscle.streaming.state import KeyedState


def stream_sessions(messages: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Inactivity sessions (user_id, start, due, messages). The watermark bounds the state; append mode emits closed sessions."""
    return logs.sessions(messages.withWatermark("ts", late), gap)


_SUMMARY = "user_id long, start long, due long, messages long, reason string, state string"
_HELD = "ts array<long>, id array<long>, ends array<boolean>, ended boolean, start long, last long, messages long, ready_start long, ready_due long, ready_messages long, ready_reason string"


def stream_summaries(events: DataFrame, late: str = "10 minutes", gap_s: int = 1800) -> DataFrame:
    """The changes of session summaries, in append mode; the batch twin is ``logs.session_summaries``, its result the last change of each session.

    events: user_id, event_id, ts, ends. A session of messages becomes due ``gap_s`` after its last message, or at once at an event that
    ends the user's conversation; then it is emitted as ready. A later message emits it again as stale; nothing counts after an end.
    Events wait in the state until the watermark has passed them, so that they take effect in the order of (ts, event_id) even if
    they arrive out of order; a user's state holds these, the open session and the last summary.
    """
    us = 1_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(_FIELDS, state.get, strict=True)) if state.exists else dict.fromkeys(_FIELDS) | {"ts": [], "id": [], "ends": [], "ended": False}
        waiting = list(zip(held["ts"], held["id"], held["ends"], strict=True))
        for pdf in parts:
            waiting += zip(pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["ends"].tolist(), strict=True)
        now, out = state.getCurrentWatermarkMs() * 1000, []

        def emit(kind: str) -> None:
            out.append((key[0], held["ready_start"], held["ready_due"], held["ready_messages"], held["ready_reason"], kind))

        def close(due: int, reason: str) -> None:
            held.update(ready_start=held["start"], ready_due=due, ready_messages=held["messages"], ready_reason=reason, start=None)
            emit("ready")

        for ts, _, ends in sorted(w for w in waiting if w[0] <= now):
            if held["start"] is not None and ts >= held["last"] + gap_s * us:
                close(held["last"] + gap_s * us, "idle")
            if held["ended"]:
                continue
            if ends:
                held["ended"] = True
                if held["start"] is not None:
                    close(ts, "end")
            elif held["start"] is None:
                if held["ready_start"] is not None:
                    emit("stale")
                held.update(start=ts, last=ts, messages=1)
            else:
                held.update(last=ts, messages=held["messages"] + 1)
        waiting = sorted(w for w in waiting if w[0] > now) if not held["ended"] else []
        if held["start"] is not None and held["last"] + gap_s * us <= now:
            close(held["last"] + gap_s * us, "idle")
        held.update(zip(("ts", "id", "ends"), ([w[i] for w in waiting] for i in range(3)), strict=True))
        state.update(tuple(held[c] for c in _FIELDS))
        times = [w[0] for w in waiting[:1]] + ([held["last"] + gap_s * us] if held["start"] is not None else [])
        if times:
            state.setTimeoutTimestamp(max(min(times) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "start", "due", "messages", "reason", "state"])

    rows = events.where("user_id is not null").select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "ends").withWatermark("ts", late)
    changes = rows.groupBy("user_id").applyInPandasWithState(step, _SUMMARY, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("start", "due")})


_FIELDS = [c.split()[0] for c in _HELD.split(", ")]


def stream_backoff(attempts: DataFrame, base: float = 5.0, most: float = 300.0, forget_s: int = 7 * 86_400, late: str = "1 hour") -> DataFrame:
    """host, attempt_id, strikes, wait_s, as ``logs.backoff``; attempts of a host arrive in order from batch to batch.

    State is held for throttled hosts only: a success drops it, and so does the watermark when it is ``forget_s`` past a host's last
    attempt, as a later attempt starts anew. So hosts that never succeed don't stay either.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        strikes, last = state.get if state.exists else (0, None)
        out = []
        for r in pd.concat(list(parts)).sort_values(["at", "attempt_id"]).itertuples():
            strikes = 0 if last is not None and r.at >= last + forget_s * 1_000_000 else strikes
            strikes, last = strikes + 1 if r.throttled else 0, int(r.at)
            asked = None if pd.isna(r.retry_after) else float(r.retry_after)
            wait = 0.0 if not r.throttled else asked if asked is not None else min(most, base * 2.0 ** min(strikes - 1, 30))
            out.append((key[0], int(r.attempt_id), strikes, wait))
        end = last // 1000 + forget_s * 1000
        if strikes and end > state.getCurrentWatermarkMs():
            state.update((strikes, last))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["host", "attempt_id", "strikes", "wait_s"])

    rows = attempts.select("host", "attempt_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "throttled", "retry_after").withWatermark("ts", late)
    return rows.groupBy("host").applyInPandasWithState(step, "host long, attempt_id long, strikes int, wait_s double", "strikes int, last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_progress(items: DataFrame) -> DataFrame:
    """Live counters of each batch, for update mode. items: batch_id, state."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    return items.groupBy("batch_id").agg(F.count("*").alias("total"), n("COMPLETED"), n("FAILED"), n("SKIPPED"), n("CANCELLED"))


def stream_sync(snapshots: DataFrame, state: KeyedState, on_changes: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch of remote rows (document_id, title, sha256, path) against the last seen state: changed rows go to ``on_changes`` and into the state.

    Of rows of one document in a batch the greatest by (title, sha256, path) counts. The state has the key document_id; only the buckets of
    a batch's documents are read, and only changed rows are written.
    """
    order = ["title", "sha256", "path"]

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.groupBy("document_id").agg(F.max(F.struct(*order)).alias("r")).select("document_id", *[F.col(f"r.{c}") for c in order]).persist()
        try:
            seen = state.near(batch, epoch).join(batch.select("document_id"), "document_id", "left_semi")
            body = seen.select("document_id", F.lit("x").alias("body"), F.lit(None).cast("string").alias("archived_at"))
            diff = sync.sync_diff(batch, seen, body, seen.limit(0)).where("action in ('added', 'changed')")
            on_changes(diff.join(batch, "document_id"), epoch)
            state.apply(epoch, batch.join(diff.select("document_id"), "document_id", "left_semi"))
        finally:
            batch.unpersist()

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_corpus(
    fetches: DataFrame, pages: KeyedState, chunks: KeyedState, chunk: Callable[[DataFrame], DataFrame], checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None,
    on_deleted: Callable[[DataFrame, int], None] = lambda ids, epoch: None,
) -> StreamingQuery:
    """Each batch of fetches is merged into the pages; only updated pages are chunked and embedded again.

    fetches: url, status, sha256, text, and those of etag, last_modified and fetched_at that the pages have; of fetches of one url in a
    batch the greatest by (fetched_at if there is one, status, sha256) counts. ``chunk`` makes rows chunk_id, url, more from (url,
    text); ``embed`` adds what ``chunks`` holds beyond that. pages has the key url; chunks has the key (url, chunk_id), dealt by
    url. ``on_deleted`` gets the chunk_id of chunks that are gone.
    """
    order = [c for c in ("fetched_at", "status", "sha256") if c in fetches.columns]

    def step(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c != "url"]
        batch = batch.groupBy("url").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("url", "r.*").persist()
        try:
            known = pages.near(batch, epoch).join(batch.select("url"), "url", "left_semi")
            merged = web.crawl_merge(known, batch).persist()
            new = chunk(batch.join(merged.where("action = 'updated'").select("url"), "url", "left_semi").select("url", "text"))
            new = embed(new) if embed is not None else new
            touched = merged.where("action in ('updated', 'removed')").select("url")
            old = chunks.near(touched, epoch).join(touched, "url", "left_semi")
            change = web.merge_chunks(old, merged, new).persist()
            gone = change.where("state = 'deleted'").select("url", "chunk_id")
            on_deleted(gone.select("chunk_id"), epoch)
            chunks.apply(epoch, change.where("state = 'added'"), gone)
            pages.apply(epoch, merged.where("action in ('kept', 'updated')"), merged.where("action = 'removed'").select("url"))
            change.unpersist()
            merged.unpersist()
        finally:
            batch.unpersist()

    return fetches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
