"""Sync and maintenance: snapshot diffs, conflicts, tombstones, targets, versions, ordinals, batches, cascades, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sync_diff(remote: DataFrame, prior: DataFrame, local: DataFrame, removed: DataFrame) -> DataFrame:
    """document_id, action: added, changed (title, hash or path differ), repair (unchanged, body missing), unchanged, deleted.

    Tombstoned ids are skipped. deleted: a visible, remote-bound local row that the remote no longer has.
    remote, prior: document_id, title, sha256, path (array); local: document_id, body, archived_at.
    """
    gone = removed.select("document_id").distinct()
    r = remote.join(gone, "document_id", "left_anti").select("document_id", F.struct("title", "sha256", "path").alias("now"), F.lit(True).alias("there"))
    p = prior.select("document_id", F.struct("title", "sha256", "path").alias("was"), F.lit(True).alias("seen"))
    mine = local.join(gone, "document_id", "left_anti").select("document_id", F.col("body").isNotNull().alias("whole"), F.col("archived_at").isNull().alias("shown"))
    all_ = r.join(p, "document_id", "left").join(mine, "document_id", "full_outer")
    action = (
        F.when(F.col("there") & F.col("seen").isNull(), "added")
        .when(F.col("there") & ~F.col("now").eqNullSafe(F.col("was")), "changed")
        .when(F.col("there") & ~F.coalesce("whole", F.lit(False)), "repair")
        .when(F.col("there"), "unchanged")
        .when(F.col("shown"), "deleted")
    )
    return all_.select("document_id", action.alias("action")).where("action is not null")


def conflicts(local: DataFrame, remote: DataFrame, prior: DataFrame) -> DataFrame:
    """document_id, title, local_content, remote_content: edited here, and the remote hash moved from the last seen one."""
    r = remote.select("document_id", "title", F.col("sha256").alias("now"), F.col("content").alias("remote_content"))
    p = prior.select("document_id", F.col("sha256").alias("was"))
    return local.where("dirty").select("document_id", F.col("content").alias("local_content")).join(r, "document_id").join(p, "document_id").where("now <> was").select("document_id", "title", "local_content", "remote_content")


def resolve_conflicts(found: DataFrame, decisions: DataFrame, suffix: str = " (copy)") -> DataFrame:
    """document_id, title, content, remote_content, dirty, is_copy after each decision; keep_both adds a row with the local text."""
    d = found.join(decisions.select("document_id", "decision"), "document_id")
    row = lambda i, t, c, r, k: F.struct(i.alias("document_id"), t.alias("title"), c.alias("content"), r.alias("remote_content"), F.lit(False).alias("dirty"), F.lit(k).alias("is_copy"))
    me, title, mine, theirs = F.col("document_id").cast("string"), F.col("title"), F.col("local_content"), F.col("remote_content")
    out = F.when(d.decision == "keep_local", F.array(row(me, title, mine, mine, False))).when(d.decision == "keep_remote", F.array(row(me, title, theirs, theirs, False)))
    both = F.array(row(me, title, theirs, theirs, False), row(F.concat(me, F.lit("-copy")), F.concat(title, F.lit(suffix)), mine, mine, True))
    return d.select(F.inline(out.otherwise(F.when(d.decision == "keep_both", both))))


def apply_tombstones(listing: DataFrame, removed: DataFrame) -> DataFrame:
    return listing.join(removed.select("provider", "remote_id").distinct(), ["provider", "remote_id"], "left_anti")


def orphan_tombstones(removed: DataFrame, docs: DataFrame) -> DataFrame:
    """Tombstones whose document row is gone; order them by removed_at for a listing, newest first."""
    return removed.join(docs.select("document_id").distinct(), "document_id", "left_anti")


def resolve_targets(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, document_id, match, actions: by source identity, else by a 64-long content hash. The least id of a key wins."""
    first = lambda key: docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("document_id").alias(f"by_{key}"))
    h = F.regexp_replace("source_revision", "^sha256:", "")
    i = items.withColumn("sha256", F.when(F.length(h) == 64, h)).join(first("source_identity"), "source_identity", "left").join(first("sha256"), "sha256", "left")
    found = F.coalesce("by_source_identity", "by_sha256")
    kind = F.when(F.col("by_source_identity").isNotNull(), "identity").when(F.col("by_sha256").isNotNull(), "hash").otherwise("none")
    actions = F.when(kind == "identity", F.array(F.lit("update"), F.lit("skip"))).when(kind == "hash", F.array(F.lit("attach"), F.lit("create"), F.lit("skip"))).otherwise(F.array(F.lit("create"), F.lit("skip")))
    return i.select("item_id", found.alias("document_id"), kind.alias("match"), F.array_join(actions, ",").alias("actions"))


def unowned_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vector ids that no live chunk owns (a chunk owns its vector_id, else its own id)."""
    return vectors.select("vector_id").join(chunks.select(F.coalesce("vector_id", "id").alias("vector_id")).distinct(), "vector_id", "left_anti")


def cascade_delete(repositories: DataFrame, tables: dict[str, DataFrame], owners: dict[str, tuple[str, str]], scopes: DataFrame) -> DataFrame:
    """table, row_id, action of deleting repositories: children below them are deleted, scopes lose the ids.

    tables: each with ``id``; owners: table -> (parent table or 'repository', foreign key), parents first;
    scopes: id, repository_ids (array), nulled when nothing is left.
    """
    gone = {"repository": repositories.select(F.col("repository_id").alias("id")).distinct()}
    plan = None
    for name, (parent, key) in owners.items():
        gone[name] = tables[name].join(gone[parent].withColumnRenamed("id", key), key, "left_semi").select("id")
        part = gone[name].select(F.lit(name).alias("table"), F.col("id").cast("string").alias("row_id"), F.lit("delete").alias("action"))
        plan = part if plan is None else plan.unionByName(part)
    r = F.explode("repository_ids").alias("repository_id")
    hit = scopes.select("id", r).join(gone["repository"].withColumnRenamed("id", "repository_id"), "repository_id", "left").join(repositories.select("repository_id", F.lit(1).alias("x")).distinct(), "repository_id", "left")
    left = hit.groupBy("id").agg(F.count("x").alias("lost"), F.count("*").alias("n")).where("lost > 0")
    part = left.select(F.lit("scope").alias("table"), F.col("id").cast("string").alias("row_id"), F.when(F.col("lost") == F.col("n"), "nullify").otherwise("prune").alias("action"))
    return part if plan is None else plan.unionByName(part)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """document_id, sha256, keeper, role of texts that occur more than once in a repository; the least id keeps.

    Groups are counted with map-side combine and joined back, so a text copied everywhere is no hot window.
    """
    rows = docs.select("document_id", "repository_id", F.sha2("text", 256).alias("sha256"))
    groups = rows.groupBy("repository_id", "sha256").agg(F.min("document_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups, ["repository_id", "sha256"]).select("document_id", "sha256", "keeper", F.when(F.col("document_id") == F.col("keeper"), "keeper").otherwise("duplicate").alias("role"))


def repo_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """repository_id, documents, indexed: visible documents, and those of them that have chunks."""
    live = docs.where("archived_at is null").select("repository_id", "document_id")
    has = chunks.select("document_id").distinct().withColumn("has", F.lit(1))
    return live.join(has, "document_id", "left").groupBy("repository_id").agg(F.countDistinct("document_id").alias("documents"), F.countDistinct(F.when(F.col("has") == 1, F.col("document_id"))).alias("indexed"))


def mark_rebuild(docs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Ids of all documents with chunks, archived ones too, if any stored vector has another dimension."""
    other = vectors.where(F.size("embedding") != dim).limit(1).select(F.lit(True).alias("other"))
    return docs.where("chunk_count > 0").select("document_id").join(F.broadcast(other))


def batch_rollup(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Counts, progress and state of each batch; an empty batch is at 100. Cancel beats running beats errors beats completed."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s.lower())
    open_ = F.count_if(F.col("selected") & F.col("state").isin("QUEUED", "RUNNING", "DISCOVERED")).alias("open")
    agg = items.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if("selected").alias("selected"), n("COMPLETED"), n("FAILED"), n("SKIPPED"), n("CANCELLED"), open_)
    b = batches.join(agg, "batch_id", "left").na.fill(0)
    finished = F.col("completed") + F.col("failed") + F.col("skipped") + F.col("cancelled")
    progress = F.when(F.col("total") == 0, 100).otherwise(F.floor(finished * 100 / F.col("total"))).cast("int")
    state = F.when(F.col("cancel_requested"), "CANCELLED").when(F.col("open") > 0, "RUNNING").when(F.col("failed") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    return b.select("batch_id", "total", "selected", "completed", "failed", "skipped", progress.alias("progress"), state.alias("state"))


def versions(changes: DataFrame, keep: int = 20) -> DataFrame:
    """document_id, version_no, changed_at: numbered in order of change, the last ``keep`` of each document."""
    order = Window.partitionBy("document_id").orderBy("changed_at", "change_id")
    n = changes.withColumn("version_no", F.row_number().over(order))
    last = F.max("version_no").over(Window.partitionBy("document_id"))
    return n.withColumn("last", last).where(F.col("version_no") > F.col("last") - keep).select("document_id", "version_no", "changed_at")


def append_ordinals(existing: DataFrame, new: DataFrame) -> DataFrame:
    """batch_id, item_id, ordinal of new items: they go on from the batch's greatest ordinal."""
    top = existing.groupBy("batch_id").agg(F.max("ordinal").alias("top"))
    n = F.row_number().over(Window.partitionBy("batch_id").orderBy("item_id"))
    return new.withColumn("n", n).join(top, "batch_id", "left").select("batch_id", "item_id", (F.coalesce("top", F.lit(-1)) + F.col("n")).alias("ordinal"))
