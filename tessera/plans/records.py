"""Queries of cleaning, chunking, memory, logs and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.operators import catalog, chunking, cleaning, filters, logs, memory, metadata, retrieval
from tessera.operators.ordering import numbered
from tessera.plans.registry import query
from tessera.runtime import table
from tessera.sources import readers

NOW = 1_706_745_600  # 2024-02-01


# --- cleaning ---------------------------------------------------------------------------


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 2")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.exact_dedup(table(spark, d, "documents")).select("doc_id", "text_hash", "copies")


MARKED = """m AS (SELECT conv_id, turn, list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN octet_length(encode(text)) > 10000 THEN 'oversized' END,
  CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY text) > 1 THEN 'duplicate_id' END], lambda x: x IS NOT NULL) AS reasons FROM conversations)"""


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.anomalies(table(spark, d, "conversations"), "conv_id", "text")


@query("anomaly_flags", f"WITH {MARKED} SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(reasons)) AS BIGINT) AS reasons, CAST(sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS anomalous FROM m GROUP BY 1")
def anomaly_flags(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.size("reasons")).alias("reasons"), F.sum(F.col("anomalous").cast("int")).alias("anomalous"))


@query("anomaly_counts", f"WITH {MARKED} SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(reasons) AS reason FROM m) GROUP BY 1")
def anomaly_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.anomaly_counts(_marked(spark, d))


@query("cleaning_summary", f"WITH {MARKED} SELECT CAST(count(*) AS BIGINT) AS blocks, CAST(sum(CASE WHEN len(reasons) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS anomalous, CAST(sum(len(reasons)) AS BIGINT) AS reasons, CAST(0 AS INTEGER) AS duplicates FROM m")
def cleaning_summary(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.cleaning_summary(_marked(spark, d))


@query("oversized_blocks", "SELECT doc_id, octet_length(encode(text)) > 10000 AS anomalous FROM documents")
def oversized_blocks(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.anomalies(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "anomalous")


@query(
    "semantic_dedup",
    """
WITH RECURSIVE g AS (SELECT CAST(label AS VARCHAR) AS scope, vec_id AS o, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (SELECT scope, n, o, true AS kept, [e] AS ks FROM g WHERE n = 1
  UNION ALL SELECT x.scope, x.n, x.o, NOT x.near, CASE WHEN x.near THEN x.ks ELSE list_append(x.ks, x.e) END
  FROM (SELECT g.scope, g.n, g.o, g.e, r.ks, coalesce(list_bool_or(list_transform(r.ks, lambda k: list_cosine_similarity(k, g.e) >= 0.95)), false) AS near FROM r JOIN g ON g.scope = r.scope AND g.n = r.n + 1) x)
SELECT scope, o, kept FROM r
""",
)
def semantic_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Whole labels at the production threshold."""
    return cleaning.semantic_dedup(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("contextual_text", "SELECT conv_id, turn, CAST(CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS status, CASE turn % 3 WHEN 1 THEN 'ctx' || chr(10) || text ELSE text END AS embed_text FROM conversations")
def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    context = F.when(F.col("turn") % 3 == 1, "ctx").when(F.col("turn") % 3 == 2, "")
    body, status = cleaning.contextual(F.col("text"), context)
    return table(spark, d, "conversations").select("conv_id", "turn", status.alias("status"), body.alias("embed_text"))


@query("budget_cap", "SELECT event_id, event_type, cost FROM (SELECT *, coalesce(sum(cost) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT event_id, event_type, user_id * 3 AS cost FROM events)) WHERE spent < 50000")
def budget_cap(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") * 3).alias("cost"))
    return cleaning.within_budget(calls, 50_000, "event_id", "event_type")


@query("enrich_merge", "SELECT o_custkey AS block_id, min_by(o_orderstatus, o_orderkey) AS enricher, CAST(sum(o_orderkey % 7) AS BIGINT) AS tokens, max_by(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS summary FROM orders GROUP BY 1")
def enrich_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("block_id"), F.col("o_orderkey").alias("step"), F.col("o_orderstatus").alias("enricher"), (F.col("o_orderkey") % 7).alias("tokens"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("summary")
    )
    return cleaning.merge_enriched(rows, ["summary"])


@query("llm_cost", "SELECT event_id, (user_id * 150 + event_id * 600) // 1000 AS micro_usd FROM events")
def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scoring.cost_micro_usd(F.col("user_id"), F.col("event_id"), 150, 600).alias("micro_usd"))


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_recursive(table(spark, d, "documents"))


@query("chunk_parent_child")
def chunk_parent_child(spark: SparkSession, d: str) -> DataFrame:
    return chunking.children(chunking.chunk_units(table(spark, d, "documents")))


@query("chunk_parents")
def chunk_parents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.parents(chunking.chunk_units(table(spark, d, "documents")))


@query("chunk_stats")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return chunking.chunk_stats(chunking.children(chunking.chunk_units(docs)), docs)


@query(
    "chunk_invariants",
    """
SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (length(text) > 0) AS BIGINT) AS chunked, CAST(0 AS BIGINT) AS over_budget, CAST(0 AS BIGINT) AS gaps,
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20.!?;。！？；]'))) AS BIGINT) AS letters
FROM documents
""",
)
def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without overlap keep all but separators, keep to the budget and are numbered without a gap."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    letters = F.length(F.regexp_replace("chunk_text", r"[\x09-\x0D\x20.!?;。！？；]", ""))
    one = chunking.chunk_recursive(docs, overlap=0).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.sum(letters).alias("letters"), F.sum((F.col("tokens") > chunking.CHUNK).cast("long")).alias("over")
    )
    gap = ((F.col("low") != 0) | (F.col("high") + 1 != F.col("n"))).cast("long")
    some = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return docs.join(one, "doc_id", "left").agg(F.count("*").alias("documents"), F.count("n").alias("chunked"), some("over", "over_budget"), some(gap, "gaps"), some("letters", "letters"))


@query("metadata_blocks")
def metadata_blocks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("mime_type"), F.lit(1).alias("page_count"), F.lit(NOW * 1000).cast("long").alias("upload_ms"), "lang", F.array("lang", "source").alias("tags"))
    return metadata.metadata_blocks(docs)


# --- memory -----------------------------------------------------------------------------

FACTS = """f AS (SELECT event_id AS block_id, user_id, event_type AS content, CASE event_type WHEN 'click' THEN 'fact' WHEN 'purchase' THEN 'preference' ELSE 'event' END AS memory_type,
  CASE event_id % 5 WHEN 0 THEN 'invalidated' WHEN 1 THEN 'tentative' ELSE 'active' END AS status, value AS raw_score, CAST(floor(epoch(ts)) AS BIGINT) AS created_s FROM events)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "fact").when(F.col("event_type") == "purchase", "preference").otherwise("event")
    status = F.when(F.col("event_id") % 5 == 0, "invalidated").when(F.col("event_id") % 5 == 1, "tentative").otherwise("active")
    return table(spark, d, "events").select(
        F.col("event_id").alias("block_id"), "user_id", F.col("event_type").alias("content"), kind.alias("memory_type"), status.alias("status"), F.col("value").alias("raw_score"), F.unix_timestamp("ts").alias("created_s")
    )


AGE = f"greatest(0, floor(({NOW} - created_s) / 86400.0))"


@query(
    "memory_decay_rank",
    f"WITH {FACTS}, s AS (SELECT block_id, user_id, round(greatest(0, raw_score * CASE WHEN memory_type = 'event' THEN exp(-0.01::DOUBLE * {AGE}) ELSE 1.0::DOUBLE END), 6) AS score FROM f WHERE status <> 'invalidated') "
    "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, block_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3",
)
def memory_decay_rank(spark: SparkSession, d: str) -> DataFrame:
    return memory.rank_memories(_facts(spark, d), NOW, 3, by="user_id").select("block_id", "user_id", "score", "rank")


@query("memory_search", f"WITH {FACTS} SELECT block_id, round(greatest(0, raw_score * CASE WHEN memory_type = 'event' THEN exp(-0.01::DOUBLE * {AGE}) ELSE 1.0::DOUBLE END), 6) AS score FROM f WHERE user_id = 7 AND status <> 'invalidated' AND NOT (block_id % 3 > 0 AND {NOW} > created_s + block_id % 3 * 864000) ORDER BY 2 DESC, 1 LIMIT 10")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.retrieval import memory_search as search

    rows = _facts(spark, d).withColumn("ttl_s", F.col("block_id") % 3 * 864_000).withColumn("user_id", F.col("user_id").cast("string")).withColumnRenamed("memory_type", "kind")
    return search(rows, "7", NOW, 10).select("block_id", "score")


@query("memory_list", f"WITH {FACTS} SELECT block_id, memory_type, status FROM f WHERE user_id = 3 AND status IN ('active', 'tentative') AND memory_type = 'event'")
def memory_list(spark: SparkSession, d: str) -> DataFrame:
    return memory.listing(_facts(spark, d), "3", "event").select("block_id", "memory_type", "status")


@query("contradiction_pairs", f"WITH {FACTS}, r AS (SELECT user_id, block_id AS old_id, row_number() OVER (PARTITION BY user_id ORDER BY created_s DESC, block_id DESC) AS nth FROM f WHERE status = 'active' AND memory_type IN ('fact', 'preference') QUALIFY nth <= 5) SELECT n.user_id, n.block_id AS new_id, r.old_id, CAST(r.nth AS INTEGER) AS nth FROM f n JOIN r USING (user_id) WHERE n.block_id % 100 = 0")
def contradiction_pairs(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d)
    return memory.contradiction_pairs(facts.filter("block_id % 100 = 0"), facts).select("user_id", "new_id", "old_id", "nth")


@query("memory_invalidate", f"WITH {FACTS} SELECT block_id, CASE WHEN status = 'active' AND block_id % 10 = 3 THEN 'invalidated' ELSE status END AS status, CASE WHEN status = 'active' AND block_id % 10 = 3 THEN block_id + 1 END AS invalidated_by, CASE WHEN status = 'active' AND block_id % 10 = 3 THEN block_id % 20 < 10 END AS auto_revoke_eligible FROM f")
def memory_invalidate(spark: SparkSession, d: str) -> DataFrame:
    facts, i = _facts(spark, d), F.col("block_id")
    verdicts = facts.filter(i % 10 == 3).select(i.alias("old_id"), (i + 1).alias("new_id"), F.when(i % 20 < 10, 0.5).otherwise(0.9).alias("confidence"), F.lit("newer").alias("reason"))
    return memory.invalidate(facts, verdicts, NOW).select("block_id", "status", "invalidated_by", "auto_revoke_eligible")


@query("preference_immunity", f"SELECT user_id, event_type AS pref_key, CAST(count(*) AS BIGINT) AS mention_count, count(*) >= 2 AND {NOW} - min(CAST(floor(epoch(ts)) AS BIGINT)) <= 30 * 86400 AS immune FROM events GROUP BY ALL")
def preference_immunity(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "events").select("user_id", F.col("event_type").alias("pref_key"), F.unix_timestamp("ts").alias("at_s"))
    return memory.preferences(said, NOW).drop("first_s")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


PAIRS = """p AS (SELECT conv_id AS session_id, turn, text AS question, lead(role) OVER w AS nr, lead(text) OVER w AS answer, role FROM {src} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pp AS (SELECT session_id, turn, question, answer FROM p WHERE role = 'user' AND nr = 'assistant')"""


@query("turn_pairs", f"WITH {PAIRS.format(src='conversations')} SELECT * FROM pp")
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return memory.turn_pairs(_turns(spark, d))


@query(
    "recent_turns_budget",
    "WITH c AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6), "
    + PAIRS.format(src="c")
    + r""", k AS (SELECT *, 'User: ' || question || chr(10) || 'Assistant: ' || answer || chr(10) AS s FROM pp),
t AS (SELECT session_id, turn, CAST(len(regexp_extract_all(s, '[\x00-\x08\x0B\x0C\x0E-\x1F\x21-\x7F]+')) + 2 * len(regexp_extract_all(s, '[\x{800}-\x{FFFF}]')) + len(regexp_extract_all(s, '[\x{80}-\x{7FF}\x{10000}-\x{10FFFF}]')) AS INTEGER) AS tokens FROM k)
SELECT session_id, turn, tokens, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY turn) AS BIGINT) AS used FROM t QUALIFY used <= 400""",
)
def recent_turns_budget(spark: SparkSession, d: str) -> DataFrame:
    return memory.inject(_turns(spark, d), 3, 400).select("session_id", "turn", "tokens", "used")


@query("extraction_window", "SELECT conv_id AS session_id, turn, CAST(length(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS INTEGER) AS context_chars FROM conversations")
def extraction_window(spark: SparkSession, d: str) -> DataFrame:
    return memory.extraction_context(_turns(spark, d), 3).select("session_id", "turn", F.length("context").alias("context_chars"))


@query("session_list", "SELECT conv_id AS session_id, CAST(count(*) AS BIGINT) AS interaction_count, max(turn) AS updated_at FROM conversations GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20 OFFSET 5")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("interaction_count"), F.max("turn").alias("updated_at"))
    return filters.page(rows, 5, 20, F.desc("updated_at"), F.col("session_id"))[0]


# --- logs -------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"), F.col("value").alias("duration")
    )


LOG = "o AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS timestamp, CAST(user_id AS VARCHAR) AS user_id, event_type AS action, value FROM events)"
SINCE, UNTIL = 1_704_500_000_000, 1_706_000_000_000


@query("oplog_query", f"WITH {LOG} SELECT id, timestamp, user_id, action FROM o WHERE user_id = '9' AND action IN ('click', 'view') AND timestamp BETWEEN {SINCE} AND {UNTIL} ORDER BY timestamp DESC, id LIMIT 50")
def oplog_query(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.operation_log(_log(spark, d), user_id="9", actions=["click", "view"], since_ms=SINCE, until_ms=UNTIL)
    return filters.page(rows, 0, 50, F.desc("timestamp"), F.col("id"))[0].select("id", "timestamp", "user_id", "action")


@query("oplog_retention", f"WITH {LOG} SELECT id, timestamp FROM o WHERE timestamp >= {SINCE} ORDER BY timestamp DESC, id DESC LIMIT 777")
def oplog_retention(spark: SparkSession, d: str) -> DataFrame:
    return logs.retained(_log(spark, d), SINCE, 777).select("id", "timestamp")


@query("oplog_stats", f"WITH {LOG} SELECT CAST(count(*) AS BIGINT) AS total, min(timestamp) AS oldest, max(timestamp) AS newest FROM o")
def oplog_stats(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_stats(_log(spark, d))


@query("invalidation_audit", f"WITH {LOG} SELECT id, action FROM o WHERE action IN ('error', 'signup')")
def invalidation_audit(spark: SparkSession, d: str) -> DataFrame:
    return logs.operation_log(_log(spark, d), actions=["error", "signup"]).select("id", "action")


TRACE = """t AS (SELECT 's' || user_id AS session_id, event_type AS method, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CAST(floor(value) AS BIGINT) AS duration_ms, epoch_us(ts) // 1000 AS created_at, CASE WHEN user_id % 2 = 0 THEN 'mcp' ELSE 'http' END AS source FROM events)"""


def _trace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.concat(F.lit("s"), F.col("user_id")).alias("session_id"), F.col("event_type").alias("method"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.floor("value").alias("duration_ms"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), F.when(F.col("user_id") % 2 == 0, "mcp").otherwise("http").alias("source"),
    )


@query("trace_session_summary", f"WITH {TRACE} SELECT session_id, CAST(count(*) AS BIGINT) AS calls, min(created_at) AS first_at, max(created_at) AS last_at, CAST(sum(duration_ms) AS BIGINT) AS total_ms, CAST(count(*) FILTER (status = 'error') AS BIGINT) AS errors FROM t GROUP BY 1")
def trace_session_summary(spark: SparkSession, d: str) -> DataFrame:
    return logs.session_summary(_trace(spark, d))


@query("idle_sessions", f"WITH {TRACE} SELECT session_id, 'session_timeout' AS method, max(created_at) AS last_at, CAST({NOW}000 AS BIGINT) AS created_at FROM t WHERE source = 'mcp' GROUP BY 1 HAVING max(created_at) < {NOW}000 - 172800000 AND count(*) FILTER (method IN ('session_end', 'session_timeout')) = 0")
def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return logs.idle_sessions(_trace(spark, d), NOW * 1000, 172_800_000)


@query("trace_retention", f"WITH {TRACE} SELECT session_id, created_at FROM t WHERE created_at >= {SINCE}")
def trace_retention(spark: SparkSession, d: str) -> DataFrame:
    return logs.retained(_trace(spark, d), SINCE, 0, "created_at").select("session_id", "created_at")


@query("source_attribution", "SELECT conv_id AS interaction_id, CAST(count(*) AS BIGINT) AS sources, CAST(count(*) FILTER (d.doc_id IS NULL) AS BIGINT) AS deleted, round(avg(turn % 10 / 10.0::DOUBLE), 6) AS mean_relevance FROM conversations LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) d ON conv_id * 7 + turn = d.doc_id GROUP BY 1")
def source_attribution(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "conversations").select(F.col("conv_id").alias("interaction_id"), (F.col("conv_id") * 7 + F.col("turn")).alias("source_block_id"), (F.col("turn") % 10 / 10).alias("relevance"))
    return logs.source_attribution(sources, table(spark, d, "documents").filter("doc_id % 4 <> 0").select(F.col("doc_id").alias("block_id")))


@query("trace_owner", "SELECT conv_id AS trace_id, min_by(role, turn) AS namespace_id FROM conversations WHERE role <> 'system' GROUP BY 1")
def trace_owner(spark: SparkSession, d: str) -> DataFrame:
    traces = table(spark, d, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("role").alias("namespace_id"), F.col("turn").alias("at"))
    return logs.first_owner(traces, spark.createDataFrame([("user",), ("assistant",)], "namespace_id string"))


@query("latency_histogram", "SELECT event_type, le, CAST(count(*) FILTER (v <= le) AS BIGINT) AS n FROM (SELECT event_type, floor(value) AS v FROM events), (SELECT unnest([10.0::DOUBLE, 50.0, 100.0]) AS le) GROUP BY ALL")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.floor("value").alias("v"))
    return logs.latency_histogram(rows, "v", [10, 50, 100], "event_type").filter(F.col("le") < float("inf"))


@query("status_histogram", "SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return logs.histogram(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status")


# --- catalog ----------------------------------------------------------------------------

FILES = "fi AS (SELECT sha256(text) AS file_hash, CAST(sum(n_chars) AS BIGINT) AS size_bytes, CAST(count(*) FILTER (doc_id % 3 <> 0) AS BIGINT) AS ref_count, min(doc_id) * 1000 AS deleted_at FROM documents GROUP BY 1)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.sum("n_chars").alias("size_bytes"), F.sum(F.when(F.col("doc_id") % 3 != 0, 1).otherwise(0)).alias("ref_count"), (F.min("doc_id") * 1000).alias("deleted_at"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id % 4 <> 0").select(F.sha2("text", 256).alias("file_hash"), F.col("source").alias("namespace_id"), F.col("doc_id").cast("string").alias("doc_id"))


@query("gc_candidates", f"WITH {FILES} SELECT file_hash, deleted_at FROM fi WHERE ref_count <= 0 AND deleted_at <= 600000 ORDER BY deleted_at, file_hash LIMIT 100")
def gc_candidates(spark: SparkSession, d: str) -> DataFrame:
    return catalog.gc_candidates(_files(spark, d), 600_000, 100).select("file_hash", "deleted_at")


@query("gc_hard_delete", f"WITH {FILES} SELECT file_hash FROM (SELECT file_hash FROM fi WHERE ref_count <= 0 AND deleted_at <= 600000 ORDER BY deleted_at, file_hash LIMIT 100) WHERE file_hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 <> 0)")
def gc_hard_delete(spark: SparkSession, d: str) -> DataFrame:
    return catalog.gc_hard_delete(catalog.gc_candidates(_files(spark, d), 600_000, 100), _refs(spark, d)).select("file_hash")


@query("refcount_recount", f"WITH {FILES}, r AS (SELECT sha256(text) AS file_hash, count(*) AS active FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1) SELECT file_hash, ref_count, CAST(coalesce(active, 0) AS BIGINT) AS active FROM fi LEFT JOIN r USING (file_hash)")
def refcount_recount(spark: SparkSession, d: str) -> DataFrame:
    return catalog.ref_counts(_files(spark, d), _refs(spark, d)).select("file_hash", "ref_count", "active")


@query("gc_status", f"WITH {FILES} SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (ref_count <= 0) AS BIGINT) AS unreferenced, CAST(coalesce(sum(size_bytes) FILTER (ref_count <= 0), 0) AS BIGINT) AS reclaimable_bytes FROM fi")
def gc_status(spark: SparkSession, d: str) -> DataFrame:
    return catalog.gc_status(_files(spark, d))


@query("reference_upsert", "SELECT source AS namespace_id, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0 GROUP BY 1")
def reference_upsert(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    gone = refs.filter("CAST(doc_id AS BIGINT) % 5 = 0").withColumn("at", F.lit(2)).withColumn("op", F.lit("remove"))
    again = refs.withColumn("at", F.lit(1)).withColumn("op", F.lit("add"))
    return catalog.upsert_refs(refs, gone.unionByName(again)).groupBy("namespace_id").agg(F.count("*").alias("n"))


def _gc_docs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 4 == 0, "deleted").when(i % 4 == 1, "processing").when(i % 8 == 2, "deleting").otherwise("ready")
    return table(spark, d, "documents").select(i, F.col("source").alias("namespace_id"), status.alias("status"), (i * 1000).alias("deleted_at"))


@query("document_sweep", "SELECT doc_id, source AS namespace_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS nth FROM documents WHERE doc_id % 4 = 0 AND doc_id <= 800 QUALIFY nth <= 5")
def document_sweep(spark: SparkSession, d: str) -> DataFrame:
    return catalog.document_sweep(_gc_docs(spark, d), 800_000, 5).select("doc_id", "namespace_id", "nth")


@query("crash_recovery", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'deleted' WHEN doc_id % 4 = 1 THEN 'pending' ELSE 'ready' END AS status FROM documents WHERE doc_id % 8 <> 2")
def crash_recovery(spark: SparkSession, d: str) -> DataFrame:
    return catalog.recovered(_gc_docs(spark, d)).select("doc_id", "status")


@query("stale_docs", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def stale_docs(spark: SparkSession, d: str) -> DataFrame:
    return catalog.stale(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("members_join", "SELECT c_custkey AS user_id, n_name AS tenant FROM customer JOIN nation ON c_nationkey = n_nationkey")
def members_join(spark: SparkSession, d: str) -> DataFrame:
    ships = table(spark, d, "customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("user_id"))
    users = table(spark, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("tenant"))
    return catalog.members(ships, users).select(F.col("member").alias("user_id"), "tenant")


@query("tenant_owners", "SELECT c_nationkey AS tenant_id, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS owners, CAST(count(*) AS BIGINT) AS members FROM customer GROUP BY 1")
def tenant_owners(spark: SparkSession, d: str) -> DataFrame:
    return catalog.owner_counts(table(spark, d, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.when(F.col("c_mktsegment") == "BUILDING", "OWNER").otherwise("MEMBER").alias("role")))


@query("acl_fallback", "SELECT c_custkey AS namespace_id, CASE WHEN c_custkey % 3 = 0 THEN 'ADMIN' WHEN c_custkey % 5 = 0 THEN 'VIEWER' ELSE 'NONE' END AS role FROM customer")
def acl_fallback(spark: SparkSession, d: str) -> DataFrame:
    spaces = table(spark, d, "customer").select(F.col("c_custkey").alias("namespace_id"))
    return catalog.effective_role(spaces, spaces.filter("namespace_id % 3 = 0").withColumn("role", F.lit("ADMIN")), spaces.filter("namespace_id % 5 = 0").withColumn("role", F.lit("VIEWER")))


@query("unit_seal", "SELECT l_suppkey AS unit_id, CAST(count(*) AS BIGINT) AS vectors, CAST(sum(l_quantity) AS BIGINT) AS bytes, count(*) >= 600 OR sum(l_quantity) >= 15000 AS sealed FROM lineitem GROUP BY 1")
def unit_seal(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit_id"), F.lit(1).cast("long").alias("vectors"), F.col("l_quantity").cast("long").alias("bytes"))
    return catalog.unit_stats(units, 600, 15_000)


@query("document_list", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'processing' ELSE 'ready' END AS status FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 8 <> 2 ORDER BY doc_id DESC LIMIT 20 OFFSET 10")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _gc_docs(spark, d).filter(~F.col("status").isin("deleted", "deleting")).select("doc_id", "status")
    return filters.page(rows, 10, 20, F.desc("doc_id"))[0]


@query("block_count_backfill", "SELECT o_custkey AS doc_id, CAST(CASE WHEN o_custkey % 2 = 0 THEN count(*) ELSE 1 END AS BIGINT) AS n_blocks FROM orders GROUP BY 1")
def block_count_backfill(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"))
    stored = blocks.distinct().withColumn("stored", F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1))
    return readers.with_block_counts(stored, blocks).select("doc_id", "n_blocks")


@query("first_occurrence", "SELECT text_hash, position FROM (SELECT sha256(text) AS text_hash, min(doc_id) AS first_id, CAST(row_number() OVER (ORDER BY min(doc_id)) AS INTEGER) AS position FROM documents GROUP BY 1)")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select(F.lit(0).alias("query_id"), F.sha2("text", 256).alias("text_hash"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("block_id"))
    return numbered(retrieval.first_vote(hits, "text_hash"), "n", "rank").select("text_hash", (F.col("n") + 1).cast("int").alias("position"))
