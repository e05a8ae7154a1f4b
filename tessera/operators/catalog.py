"""Catalog: references, garbage collection in stages, tenants and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_refs(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """References after add and remove events; the last event of a (hash, ns, doc) counts, twice is once."""
    keys = ["file_hash", "namespace_id", "doc_id"]
    old = refs.select(*keys, F.lit(0).cast("long").alias("at"), F.lit("add").alias("op"))
    both = old.unionByName(changes.select(*keys, F.col("at").cast("long"), "op"))
    return both.groupBy(*keys).agg(F.max_by("op", "at").alias("op")).filter("op = 'add'").drop("op")


def ref_counts(files: DataFrame, refs: DataFrame) -> DataFrame:
    """file_hash, stored count, true count of active references."""
    true = refs.groupBy("file_hash").agg(F.count("*").alias("active"))
    return files.join(true, "file_hash", "left").withColumn("active", F.coalesce("active", F.lit(0)))


def gc_candidates(files: DataFrame, cutoff_ms: int, cap: int = 1000) -> DataFrame:
    """Unreferenced files deleted before the cutoff, oldest first."""
    return files.filter((F.col("ref_count") <= 0) & (F.col("deleted_at") <= cutoff_ms)).orderBy("deleted_at", "file_hash").limit(cap)


def gc_hard_delete(candidates: DataFrame, refs: DataFrame) -> DataFrame:
    """Candidates that really have no active reference: an anti join, whatever the stored count says."""
    return candidates.join(refs.select("file_hash").distinct(), "file_hash", "left_anti")


def blob_eligible(queue: DataFrame, now_ms: int, cap: int = 1000) -> DataFrame:
    return queue.filter((F.col("eligible_at") <= now_ms) & (F.col("status") == "pending")).orderBy("eligible_at", "file_hash").limit(cap)


def restored(files: DataFrame, hashes: list[str]) -> DataFrame:
    hit = F.col("file_hash").isin(*hashes) if hashes else F.lit(False)
    return files.withColumn("deleted_at", F.when(hit, F.lit(None).cast("long")).otherwise(F.col("deleted_at")))


def gc_status(files: DataFrame) -> DataFrame:
    gone = F.col("ref_count") <= 0
    return files.agg(
        F.count("*").alias("files"), F.sum(F.when(gone, 1).otherwise(0)).alias("unreferenced"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("reclaimable_bytes")
    )


def document_sweep(docs: DataFrame, cutoff_ms: int, cap: int) -> DataFrame:
    """Documents to purge: per namespace the oldest ``cap`` that were deleted before the cutoff."""
    at = Window.partitionBy("namespace_id").orderBy("deleted_at", "doc_id")
    rows = docs.filter((F.col("status") == "deleted") & (F.col("deleted_at") <= cutoff_ms))
    return rows.withColumn("nth", F.row_number().over(at)).filter(F.col("nth") <= cap)


def soft_deleted(docs: DataFrame, ids: list[int], at_ms: int) -> DataFrame:
    hit = F.col("doc_id").isin(*ids) if ids else F.lit(False)
    return docs.withColumns({"deleted_at": F.when(hit, F.lit(at_ms)).otherwise(F.col("deleted_at")), "status": F.when(hit, "deleted").otherwise(F.col("status"))})


def recovered(docs: DataFrame) -> DataFrame:
    """After a crash: processing starts over, what was being deleted is gone."""
    return docs.filter(F.coalesce("status", F.lit("")) != "deleting").withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def unit_stats(units: DataFrame, most_vectors: int, most_bytes: int) -> DataFrame:
    found = units.groupBy("unit_id").agg(F.sum("vectors").alias("vectors"), F.sum("bytes").alias("bytes"))
    return found.withColumn("sealed", (F.col("vectors") >= most_vectors) | (F.col("bytes") >= most_bytes))


def effective_role(resources: DataFrame, user_grants: DataFrame, tenant_grants: DataFrame) -> DataFrame:
    """A user's own grant, else the tenant's, else nothing."""
    own = user_grants.select("namespace_id", F.col("role").alias("user_role"))
    theirs = tenant_grants.select("namespace_id", F.col("role").alias("tenant_role"))
    joined = resources.join(own, "namespace_id", "left").join(theirs, "namespace_id", "left")
    return joined.withColumn("role", F.coalesce("user_role", "tenant_role", F.lit("NONE"))).drop("user_role", "tenant_role")


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    return memberships.join(users, "user_id")


def owner_counts(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("tenant_id").agg(F.sum(F.when(F.col("role") == "OWNER", 1).otherwise(0)).alias("owners"), F.count("*").alias("members"))


def stale(indexed: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    return indexed.join(on_disk.select(key).distinct(), key, "left_anti")


def change_grants(grants: DataFrame, changes: DataFrame) -> DataFrame:
    """Grants (namespace_id, subject, role) after changes (the same, op grant or revoke, at).

    The last change of a subject in a namespace counts; granting twice or revoking what isn't
    there changes nothing.
    """
    keys = ["namespace_id", "subject"]
    old = grants.select(*keys, "role", F.lit("grant").alias("op"), F.lit(-1).cast("long").alias("at"))
    both = old.unionByName(changes.select(*keys, "role", "op", F.col("at").cast("long")))
    last = both.groupBy(*keys).agg(F.max(F.struct("at", "op", "role")).alias("last"))
    return last.filter("last.op = 'grant'").select(*keys, "last.role")


def grants_of(grants: DataFrame, namespace_id: str) -> DataFrame:
    return grants.filter(F.col("namespace_id") == namespace_id).orderBy("subject")


def cascade_delete(gone: DataFrame, blocks: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and references that are left when documents go: both of a document go with it."""
    ids = gone.select("doc_id").distinct()
    return blocks.join(ids, "doc_id", "left_anti"), refs.join(ids, "doc_id", "left_anti")


def over_quota(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """tenant_id, used, quota, over: tenants without a limit are never over it."""
    used = usage.groupBy("tenant_id").agg(F.sum("size_bytes").alias("used"))
    return used.join(limits.select("tenant_id", "quota"), "tenant_id", "left").withColumn("over", F.coalesce(F.col("used") > F.col("quota"), F.lit(False)))
