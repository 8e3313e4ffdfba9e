"""Event and job logs: replay, backoff, transitions, recent context, as-of probes, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replay(events: DataFrame, cursors: DataFrame, terminal: list[str], reopen: list[str], keep: int = 100) -> DataFrame:
    """job_id, sequence, event_id, type after each job's cursor.

    Events after a terminal one are ignored until the job is reopened; accepted events are numbered from 1 and the last
    ``keep`` stay. events: job_id, event_id (order), type; cursors: job_id, cursor.
    """
    order = Window.partitionBy("job_id").orderBy("event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("type").isin(*terminal), "closed").when(F.col("type").isin(*reopen), "open")
    state = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit("open"))
    ok = events.withColumn("state", state).where((F.col("state") == "open") | F.col("type").isin(*reopen))
    n = ok.withColumn("sequence", F.row_number().over(order)).withColumn("top", F.max("event_id").over(Window.partitionBy("job_id")))
    n = n.withColumn("total", F.count("*").over(Window.partitionBy("job_id"))).where(F.col("sequence") > F.col("total") - keep)
    return n.join(cursors, "job_id", "left").where(F.col("sequence") > F.coalesce("cursor", F.lit(0))).select("job_id", "sequence", "event_id", "type")


def backoff(attempts: DataFrame, base: float = 5.0, most: float = 300.0, forget_s: int | None = None) -> DataFrame:
    """host, attempt_id, strikes, wait_s: consecutive throttles since the last success, and the wait they ask for.

    A Retry-After wins; else base * 2**(strikes - 1), at most ``most``; a success resets, and so does a pause of ``forget_s``
    since the host's last attempt. attempts: host, attempt_id, ts, throttled, retry_after.
    """
    order = Window.partitionBy("host").orderBy("ts", "attempt_id")
    new = ~F.col("throttled")
    if forget_s is not None:
        new = new | F.coalesce(F.col("ts") >= F.lag("ts").over(order) + F.make_dt_interval(secs=F.lit(forget_s)), F.lit(False))
    attempts = attempts.withColumn("new", new)
    island = F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    a = attempts.withColumn("island", island)
    strikes = F.sum(F.col("throttled").cast("int")).over(Window.partitionBy("host", "island").orderBy("ts", "attempt_id").rowsBetween(Window.unboundedPreceding, 0))
    a = a.withColumn("strikes", F.when(F.col("throttled"), strikes).otherwise(0).cast("int"))
    wait = F.when(~F.col("throttled"), 0.0).otherwise(F.coalesce(F.col("retry_after").cast("double"), F.least(F.lit(most), base * F.pow(F.lit(2.0), F.least(F.col("strikes") - 1, F.lit(30))))))
    return a.select("host", "attempt_id", "strikes", wait.alias("wait_s"))


def illegal_transitions(log: DataFrame, edges: DataFrame) -> DataFrame:
    """job_id, event_id, from_state, to_state of consecutive states that no edge allows; staying in a state is allowed.

    edges (from_state, to_state) is a declared table of states.
    """
    order = Window.partitionBy("job_id").orderBy("event_id")
    t = log.withColumn("from_state", F.lag("state").over(order)).where("from_state is not null and from_state <> state").withColumnRenamed("state", "to_state")
    return t.join(F.broadcast(edges), ["from_state", "to_state"], "left_anti").select("job_id", "event_id", "from_state", "to_state")


def recent_messages(rows: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each conversation, with their chronological position."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = rows.withColumn("r", F.row_number().over(last)).where(F.col("r") <= n)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).drop("r")


def probe_asof(attempts: DataFrame, probes: DataFrame, ok_s: float = 6 * 3600, other_s: float = 24 * 3600) -> DataFrame:
    """attempt_id, state, fresh: the host's latest probe at or before the attempt; at an age of exactly its lifetime it has expired.

    One union and one window, no range join. attempts: host, attempt_id, ts; probes: host, probe_id, ts, state.
    """
    a = attempts.select("host", "ts", F.lit(1).alias("side"), F.col("attempt_id").alias("id"), F.lit(None).cast("string").alias("state"))
    p = probes.select("host", "ts", F.lit(0).alias("side"), F.col("probe_id").alias("id"), "state")
    order = Window.partitionBy("host").orderBy("ts", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("side") == 0, F.struct("ts", "state")), ignorenulls=True).over(order)
    rows = a.unionByName(p).withColumn("probe", seen).where("side = 1")
    age = F.col("ts").cast("timestamp").cast("double") - F.col("probe.ts").cast("timestamp").cast("double")
    fresh = age < F.when(F.col("probe.state") == "ok", ok_s).otherwise(other_s)
    return rows.select(F.col("id").alias("attempt_id"), F.col("probe.state").alias("state"), F.coalesce(fresh, F.lit(False)).alias("fresh"))


def sessions(messages: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, due, messages: a session is due ``gap`` after its last message. The same grouping runs in a stream."""
    return messages.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("messages")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("due"), "messages")


def session_summaries(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """user_id, start, due, messages, reason, state of each session of messages.

    events: user_id, event_id, ts, ends. A session is due ``gap_s`` after its last message (reason idle), or at an event before that time
    that ends the user's conversation (reason end); nothing counts after a user's first end. A summary is stale if a
    message came after it, else ready.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    live = events.where("user_id is not null").withColumn("over", F.coalesce(F.max("ends").over(before), F.lit(False))).where(~F.col("over"))
    end = F.first(F.when(F.col("ends"), F.col("ts")), ignorenulls=True).over(Window.partitionBy("user_id"))
    rows = live.withColumn("end", end).where(~F.col("ends"))
    new = F.coalesce(F.col("ts") < F.lag("ts").over(order) + F.make_dt_interval(secs=F.lit(gap_s)), F.lit(False))
    rows = rows.withColumn("n", F.sum(F.when(new, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("user_id", "n").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("messages"), F.first("end").alias("end"))
    idle = F.col("last") + F.make_dt_interval(secs=F.lit(gap_s))
    ended = F.coalesce(F.col("end") < idle, F.lit(False))
    later = F.lead("n").over(Window.partitionBy("user_id").orderBy("n")).isNotNull()
    return out.select("user_id", "start", F.when(ended, F.col("end")).otherwise(idle).alias("due"), "messages", F.when(ended, "end").otherwise("idle").alias("reason"), F.when(later, "stale").otherwise("ready").alias("state"))
