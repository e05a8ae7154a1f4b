"""Queries of operators that the other modules' queries don't go through."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import hashes, scoring, text
from tessera.models import OverlapReranker, rerank_score
from tessera.operators import catalog, cleaning, filters, fusion, logs, memory, metadata, retrieval
from tessera.plans.records import NOW
from tessera.plans.registry import query
from tessera.runtime import scratch_path, table
from tessera.sources import blobs, codecs, readers


def _udf(kind: str, fn: Callable, *columns: Column) -> Column:
    """A plain function as an Arrow-batched column."""

    if len(columns) == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return pd.Series([fn(x) for x in a])

        return one(*columns)

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b, strict=True)])

    return two(*columns)


# --- sources ----------------------------------------------------------------------------


@query("docs_by_source", "SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def docs_by_source(spark: SparkSession, d: str) -> DataFrame:
    return readers.documents_by(table(spark, d, "documents"), source="src1").select("doc_id", "lang")


@query("block_codec", "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS payload_bytes, CAST(doc_id % 7 AS INTEGER) AS block_type, true AS whole, true AS damage_found FROM documents")
def block_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a binary block and back; one changed byte must be noticed."""

    def trip(doc: int, body: str) -> dict:
        raw = codecs.encode_block(doc % 7, 1, doc, 5, body.encode())
        block_type, flags, of, at, payload = codecs.decode_block(raw)
        try:
            codecs.decode_block(raw[:-5] + bytes([raw[-5] ^ 1]) + raw[-4:])
            found = False
        except ValueError:
            found = True
        return {"payload_bytes": len(payload), "block_type": block_type, "whole": (flags, of, at, payload) == (1, doc, 5, body.encode()), "damage_found": found}

    @F.pandas_udf("payload_bytes long, block_type int, whole boolean, damage_found boolean")
    def run(doc: pd.Series, body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([trip(a, b) for a, b in zip(doc, body, strict=True)])

    docs = table(spark, d, "documents")
    return docs.select("doc_id", run("doc_id", F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.*")


@query("sparse_codec", "SELECT vec_id, CAST(64 AS BIGINT) AS terms, CAST(2 + 6 * 64 AS BIGINT) AS n_bytes, round(sum(x), 4) AS total FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1")
def sparse_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as (term, weight) entries in binary form and back."""

    @F.pandas_udf("terms long, n_bytes long, total double")
    def run(v: pd.Series) -> pd.DataFrame:
        raw = [codecs.encode_sparse({i: float(x) for i, x in enumerate(row)}) for row in v]
        back = [codecs.decode_sparse(r) for r in raw]
        return pd.DataFrame({"terms": [len(b) for b in back], "n_bytes": [len(r) for r in raw], "total": [sum(b.values()) for b in back]})

    e = table(spark, d, "embeddings")
    return e.select("vec_id", run("embedding").alias("r")).select("vec_id", "r.terms", "r.n_bytes", F.round("r.total", 4).alias("total"))


@query("snapshot_round_trip", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The newest of two versions, as it was saved."""
    folder, rows = scratch_path(spark, "snapshots"), table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    readers.save_snapshot(rows.limit(1), folder, 1)
    readers.save_snapshot(rows, folder, 2)
    return readers.load_snapshot(spark, folder)


@query("batch_on_duplicate", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'rejected' WHEN doc_id % 3 = 0 THEN 'replaced' ELSE 'accepted' END AS outcome FROM documents WHERE doc_id < 90")
def batch_on_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """One batch of up to 100 documents, some of which are stored already."""
    docs = table(spark, d, "documents")
    return readers.submit_batch(docs.filter("doc_id < 90").select("doc_id", "text"), docs.filter("doc_id % 3 = 0"), "replace").select("doc_id", "outcome")


# --- filters ----------------------------------------------------------------------------


@query("post_filter_not_types", "SELECT event_id FROM events WHERE event_id % 5 NOT IN (1, 3)")
def post_filter_not_types(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").select("event_id", (F.col("event_id") % 5).alias("block_type"))
    return filters.post_filter(hits, not_types=[1, 3]).select("event_id")


@query("injection_words", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{p}')" for p in text.INJECTION_PHRASES) + " AS flagged FROM conversations")
def injection_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.has_injection(F.col("text")).alias("flagged"))


@query("query_guard", "SELECT doc_id, CAST(length(text) AS BIGINT) AS letters, true AS whole FROM documents WHERE octet_length(encode(text)) <= 2000")
def query_guard(spark: SparkSession, d: str) -> DataFrame:
    """Texts as queries: those within the limit come through the guard as they are."""
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    cut = _udf("string", lambda q: filters.check_request(q, ["*"]), F.col("text"))
    kept = docs.select("doc_id", "text", cut.alias("asked")).filter(F.col("asked") == F.col("text"))
    return kept.select("doc_id", F.length("asked").cast("long").alias("letters"), (F.octet_length("asked") <= 2000).alias("whole"))


@query("truncated_bytes", "SELECT doc_id, CAST(max(n) AS BIGINT) AS letters FROM (SELECT doc_id, n FROM (SELECT doc_id, text, unnest(range(0, least(200, length(text)) + 1)) AS n FROM documents WHERE text IS NOT NULL) WHERE octet_length(encode(substr(text, 1, CAST(n AS INTEGER)))) <= 200) GROUP BY 1")
def truncated_bytes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", F.length(text.truncate_bytes(F.substring("text", 1, 400), 200)).cast("long").alias("letters"))


@query("admin_users", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '0001') ORDER BY c_custkey DESC LIMIT 25")
def admin_users(spark: SparkSession, d: str) -> DataFrame:
    """The admin list: substring search, newest first; ``_`` is a plain character."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return filters.contains_text(rows, "c_name", "0001", "c_custkey", 25, "c_name")


# --- functions --------------------------------------------------------------------------


@query("hash_forms", "SELECT doc_id, doc_id % 2 = 0 AS is_hash, 'p' || doc_id AS trimmed, 'postgres://db:5432/shop/docs/' || doc_id AS uri, CASE WHEN doc_id % 3 = 0 THEN 'zh' ELSE 'en' END AS language, 'a\\%b\\_' AS escaped FROM documents")
def hash_forms(spark: SparkSession, d: str) -> DataFrame:
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    value = F.when(i % 2 == 0, text.content_hash(F.coalesce("text", F.lit("")))).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    asked = F.when(i % 3 == 0, F.concat(F.lit("问 "), i)).otherwise(F.concat(F.lit("ask "), i))
    return docs.select(
        "doc_id", text.is_content_hash(value).alias("is_hash"), text.trim_space(F.concat(F.lit(" \t\x0b\np"), i, F.lit("\r\n "))).alias("trimmed"),
        text.source_uri("db", 5432, "shop", "docs", i).alias("uri"), text.prompt_language(asked).alias("language"), F.lit(text.like_escape("a%b_")).alias("escaped"),
    )


@query(
    "score_forms",
    "SELECT event_id, round(1 / (1 + greatest(0, value - 50)), 6) AS rank_score, greatest(10.0::DOUBLE, least(60.0::DOUBLE, value)) AS clamped, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 900 END AS backoff, "
    "CAST(floor(epoch(ts)) AS BIGINT) + 86400 - ((CAST(floor(epoch(ts)) AS BIGINT) - 7200) % 86400) AS next_run, greatest(0, 512 - event_id % 600 - 3) AS budget, "
    "CASE WHEN event_id % 4096 <= greatest(0, 512 - event_id % 600 - 3) THEN 'normal' WHEN event_id % 4096 > 2048 THEN 'extremely_long' ELSE 'truncated' END AS length FROM events",
)
def score_forms(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.round(scoring.score_of_rank(50 - v), 6).alias("rank_score"), scoring.clamp(v, 10.0, 60.0).alias("clamped"), scoring.cleanup_backoff(i % 4).alias("backoff"),
        scoring.next_daily_run(F.unix_timestamp("ts")).alias("next_run"), scoring.passage_budget(i % 600).alias("budget"), scoring.passage_length(i % 600, i % 4096).alias("length"),
    )


@query(
    "level_forms",
    "WITH l AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE greatest(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, CASE doc_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END, CASE WHEN doc_id % 11 = 0 THEN 4 ELSE 0 END) END AS level FROM documents) "
    "SELECT doc_id, level, [0.2::DOUBLE, 0.4, 0.6, 0.8, 1.0][level + 1] AS score, CASE doc_id % 4 WHEN 0 THEN 'quota_exceeded' WHEN 1 THEN 'llm_timeout' WHEN 2 THEN 'circuit_open' ELSE 'llm_error' END AS reason FROM l",
)
def level_forms(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    parser, enricher = F.when(i % 3 == 0, "docling").when(i % 3 == 1, "paddleocr").otherwise("plain"), F.when(i % 5 == 0, "llm").when(i % 5 == 1, "hype").otherwise("")
    level = scoring.processing_level(parser, enricher, i % 11 == 0, i % 7 == 0)
    message = F.concat(F.lit("call failed: "), F.when(i % 4 == 0, "LLM_RATE_LIMIT 429").when(i % 4 == 1, "LLM_TIMEOUT").when(i % 4 == 2, "LLM_CIRCUIT_OPEN").otherwise("odd"))
    return table(spark, d, "documents").select("doc_id", level.alias("level"), scoring.level_score(level).alias("score"), scoring.error_class(message).alias("reason"))


@query("block_type_names", "SELECT count(*) = count(DISTINCT code) AS one_each, CAST(count(*) AS BIGINT) AS kinds FROM (VALUES " + ", ".join(f"({n})" for n in schemas.BLOCK_TYPES) + ") t(code)")
def block_type_names(spark: SparkSession, d: str) -> DataFrame:
    """Every code's name leads back to the code."""
    codes = spark.createDataFrame([(n,) for n in schemas.BLOCK_TYPES], "code int")
    back = codes.withColumn("back", _udf("int", schemas.block_type_code, schemas.block_type_name(F.col("code"))))
    return back.agg((F.sum((F.col("back") == F.col("code")).cast("int")) == F.count("*")).alias("one_each"), F.count("*").alias("kinds"))


# --- JSON -------------------------------------------------------------------------------


@query("json_forms", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(event_id AS VARCHAR) AS inner_id, event_type AS added FROM events")
def json_forms(spark: SparkSession, d: str) -> DataFrame:
    """Members set at one and two levels, read back from the flattened map."""
    made = metadata.json_set(metadata.json_set(F.col("props"), "a.id", F.col("event_id").cast("string")), "kind", F.col("event_type"))
    flat = table(spark, d, "events").select("event_id", metadata.flat_json(made).alias("m"))
    return flat.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["a.id"].alias("inner_id"), F.col("m")["kind"].alias("added"))


@query("repaired_json", "SELECT conv_id, turn, CAST(turn AS BIGINT) AS found FROM conversations")
def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    """A number from answers that are fenced, chatty or plain JSON."""
    body = F.concat(F.lit('{"turn": '), F.col("turn"), F.lit("}"))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("It is "), body, F.lit(" I think"))).otherwise(body)
    return table(spark, d, "conversations").select("conv_id", "turn", _udf("long", lambda a: json.loads(memory.repair_json(a))["turn"], said).alias("found"))


# --- reranking, routing -----------------------------------------------------------------


@query(
    "reranked",
    r"""
WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark),
p AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark)
SELECT query_id, id, round(CAST(len(list_intersect(q.w, p.w)) AS DOUBLE) / greatest(1, len(q.w)), 6) AS rerank FROM q, p WHERE (query_id + id) % 5 = 0
""",
)
def reranked(spark: SparkSession, d: str) -> DataFrame:
    """The reranking seam over pairs of benchmark texts, by the deterministic stand-in."""
    texts = table(spark, d, "benchmark")
    a, b = texts.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), texts.select(F.col("item_id").alias("id"), F.col("text").alias("p"))
    pairs = a.join(F.broadcast(b), (F.col("query_id") + F.col("id")) % 5 == 0)  # a fixed benchmark's items
    return pairs.select("query_id", "id", F.round(rerank_score(OverlapReranker())(F.col("q"), F.col("p")), 6).alias("rerank"))


@query("listwise_order", "SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY len DESC, first) AS INTEGER) AS position FROM (SELECT conv_id AS query_id, turn AS id, length(text) AS len, turn AS first FROM conversations WHERE turn < 20)")
def listwise_order(spark: SparkSession, d: str) -> DataFrame:
    """A model that puts longer passages first, over whole lists within one window."""

    def longest_first(_: str, passages: list[str]) -> list[int]:
        return fusion.parse_ranking(json.dumps(sorted(range(len(passages)), key=lambda i: -len(passages[i]))), len(passages))

    turns = table(spark, d, "conversations").filter("turn < 20")
    hits = turns.select(F.col("conv_id").alias("query_id"), F.lit("q").alias("query"), F.col("turn").alias("id"), F.col("text").alias("passage"), (100.0 - F.col("turn")).alias("score"))
    return fusion.listwise(hits, longest_first, orders=1).select("query_id", "id", "position")


@query("rankings_parsed", "SELECT event_id, concat_ws(',', event_id % 3, (event_id + 1) % 3, (event_id + 2) % 3) AS ranking FROM events")
def rankings_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a repeated and an impossible position, and the last one missing."""
    i = F.col("event_id")
    said = F.concat(F.lit("Ranking: ["), i % 3, F.lit(", 9, "), i % 3, F.lit(", "), (i + 1) % 3, F.lit("]"))
    return table(spark, d, "events").select("event_id", _udf("string", lambda a: ",".join(map(str, fusion.parse_ranking(a, 3))), said).alias("ranking"))


@query("rerank_windows", "SELECT n, CASE WHEN n <= 20 THEN 1 ELSE CAST(ceil((n - 20) / 10.0) AS BIGINT) + 1 END AS windows FROM (SELECT DISTINCT event_id % 200 + 1 AS n FROM events)")
def rerank_windows(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "events").select((F.col("event_id") % 200 + 1).alias("n")).distinct()
    return sizes.select("n", _udf("long", lambda n: len(fusion.windows(n)), F.col("n")).alias("windows"))


@query("namespaces_allowed", "SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a,b' WHEN doc_id % 3 = 1 THEN 'b' ELSE 'refused' END AS names FROM documents")
def namespaces_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Requests by rights on a and b: all, one of them twice, and one that may not be read."""

    def ask(i: int) -> str:
        try:
            return ",".join(fusion.authorised([["*"], ["b", "b"], ["b", "c"]][i % 3], ["b", "a", "b"]))
        except PermissionError:
            return "refused"

    return table(spark, d, "documents").select("doc_id", _udf("string", ask, F.col("doc_id")).alias("names"))


@query("top_of_none", "SELECT conv_id AS query_id, turn AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS INTEGER) AS rank FROM conversations QUALIFY rank <= 2")
def top_of_none(spark: SparkSession, d: str) -> DataFrame:
    """The two best of each query, and none where none are asked for."""
    scored = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), F.length("text").alias("score"))
    return retrieval.top(scored, 2).unionByName(retrieval.top(scored, 0)).unionByName(retrieval.top(scored, -1)).select("query_id", "doc_id", "rank")


@query("pool_sizes", "SELECT k, greatest(k, least(k * 3, 50)) AS plain, greatest(k, least(k * 12, 50)) AS wide FROM (SELECT DISTINCT event_id % 60 + 1 AS k FROM events)")
def pool_sizes(spark: SparkSession, d: str) -> DataFrame:
    ks = table(spark, d, "events").select((F.col("event_id") % 60 + 1).alias("k")).distinct()
    return ks.select("k", _udf("long", lambda k: retrieval.pool_size(k), F.col("k")).alias("plain"), _udf("long", lambda k: retrieval.pool_size(k, 3, 3.5), F.col("k")).alias("wide"))


# --- enrichment -------------------------------------------------------------------------


@query("enriched", "SELECT conv_id, turn, CAST(length(text) AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS absent, CAST(NULL AS VARCHAR) AS broken, 'broken' AS failed FROM conversations")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    """A member that works, one that isn't there and one that fails: no block is lost."""

    def broken(_: pd.Series) -> pd.Series:
        raise OSError("down")

    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return cleaning.enrich(rows, {"size": lambda t: t.str.len(), "absent": None, "broken": broken}).withColumn("failed", F.array_join("failed_members", ",")).drop("text", "failed_members")


@query("questions_parsed", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 END AS questions FROM events")
def questions_parsed(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_id") % 2 == 0, " what?\n\n why? \n").otherwise("what?\nwhy?\nwho?")
    found = cleaning.parse_questions(said, 2)
    return table(spark, d, "events").select("event_id", F.when(found.isNotNull(), F.size(found)).alias("questions"))


@query("summaries", "SELECT conv_id AS doc_id, CAST(sum(length(text)) AS VARCHAR) AS summary FROM conversations GROUP BY 1")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    """A summary that counts letters, so that summaries of summaries add up, one document a conversation."""

    def letters(body: str) -> str:
        return str(sum(int(x[1:]) if x.startswith("#") else len(x) for x in body.split("\x1f")[0].split("\n"))) if body.startswith("#") else str(len(body))

    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), F.concat(F.lit("#"), F.length("text")).alias("text"))
    return cleaning.summarise(chunks, letters)


@query("plugins_run", "SELECT doc_id, upper(lang) AS lang FROM documents WHERE doc_id % 2 = 0")
def plugins_run(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return cleaning.run_plugins(rows, [lambda df: df.filter("doc_id % 2 = 0"), lambda df: df.withColumn("lang", F.upper("lang"))])


# --- memory -----------------------------------------------------------------------------


def _facts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 5 == 0, "invalidated").otherwise("active")
    return table(spark, d, "events").select(i.alias("block_id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("content"), status.alias("status"), (i * 10).alias("modified_s"), F.lit(None).cast("long").alias("invalidated_by"))


@query("facts_parsed", "SELECT event_id, event_type AS content, CASE event_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'event' ELSE 'event' END AS type, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (event_id % 30 - 5) / 10.0::DOUBLE)) AS confidence FROM events")
def facts_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Extraction answers with an unknown kind, a confidence out of range and an item without text."""

    def parse(body: str) -> str:
        return json.dumps(memory.parse_facts(body))

    kind = F.when(F.col("event_id") % 3 == 0, "fact").when(F.col("event_id") % 3 == 1, "event").otherwise("rumour")
    item = F.concat(F.lit('[{"content": " '), F.col("event_type"), F.lit(' ", "type": "'), kind, F.lit('", "confidence": '), (F.col("event_id") % 30 - 5) / 10, F.lit('}, {"content": "  "}]'))
    one = F.from_json(_udf("string", parse, item), "array<struct<content: string, type: string, confidence: double>>")[0]
    return table(spark, d, "events").select("event_id", one.alias("f")).select("event_id", "f.*")


@query("memory_revoke", "SELECT event_id AS block_id, CASE WHEN event_id % 5 = 0 AND event_id NOT IN (5, 10) THEN 'invalidated' ELSE 'active' END AS status, CASE WHEN event_id IN (5, 10) THEN 'admin' END AS revoked_by FROM events")
def memory_revoke(spark: SparkSession, d: str) -> DataFrame:
    return memory.revoke(_facts(spark, d), [5, 10, 11], "admin", "wrong", NOW).select("block_id", "status", "revoked_by")


@query("memory_delete", f"SELECT event_id AS block_id, CASE WHEN event_id % 5 = 0 OR event_id IN (1, 2) THEN 'invalidated' ELSE 'active' END AS status, CASE WHEN event_id IN (1, 2) THEN {NOW} END AS invalidated_at FROM events")
def memory_delete(spark: SparkSession, d: str) -> DataFrame:
    once = memory.delete(_facts(spark, d), [1, 2, 5], NOW).withColumn("first_at", F.col("invalidated_at"))
    again = memory.delete(once.drop("invalidated_at"), [1, 2, 5], NOW + 9)
    return again.select("block_id", "status", F.col("first_at").alias("invalidated_at"))


@query("memory_edit", "SELECT event_id AS block_id, event_type AS content, CASE WHEN event_id % 5 = 0 OR event_id = 7 THEN 'invalidated' ELSE 'active' END AS status FROM events UNION ALL SELECT -7, 'new words', 'active' FROM events WHERE event_id = 7")
def memory_edit(spark: SparkSession, d: str) -> DataFrame:
    """An edit of what is there, and one that comes too late and changes nothing."""
    facts = _facts(spark, d)
    owner = facts.filter("block_id = 7").first()["user_id"]
    edited = memory.edit(facts, 7, owner, "new words", 70, NOW, -7)
    return memory.edit(edited, 8, owner, "never", 1, NOW, -8).select("block_id", "content", "status")


@query("sessions_touched", "SELECT conv_id AS session_id, CAST(5 + count(*) AS BIGINT) AS interaction_count, greatest(100, max(turn)) AS updated_at FROM conversations GROUP BY 1")
def sessions_touched(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"))
    old = turns.select("session_id").distinct().select("session_id", F.lit(5).cast("long").alias("interaction_count"), F.lit(100).cast("long").alias("updated_at"))
    return memory.touch_sessions(old, turns)


@query("opt_out_states", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'opted_out' WHEN 1 THEN 'active' ELSE 'refused' END AS state FROM events")
def opt_out_states(spark: SparkSession, d: str) -> DataFrame:
    def step(i: int) -> str:
        try:
            return memory.opt_out_step(*[("active", "opt_out", None), ("opted_out", "revoke", "asked"), ("opted_out", "revoke", " ")][i % 3])
        except ValueError:
            return "refused"

    return table(spark, d, "events").select("event_id", _udf("string", step, F.col("event_id")).alias("state"))


@query("interaction_scope", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 = 1 AND role = 'user'")
def interaction_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("user_id", (F.col("conv_id") % 4).cast("string"))
    return logs.interactions(rows, user_id="1", role="user").select("conv_id", "turn")


@query("interaction_retention", "SELECT conv_id, turn FROM conversations WHERE conv_id * 86400000 >= 1000000000")
def interaction_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("at", F.col("conv_id") * 86_400_000)
    return logs.retained(rows, 1_000_000_000, 0, "at").select("conv_id", "turn")


# --- catalog ----------------------------------------------------------------------------


def _queue(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.cast("string").alias("file_hash"), (i * 7 % 1000).alias("eligible_at"), F.when(i % 3 == 0, "done").otherwise("pending").alias("status"), i.alias("deleted_at"), i)


@query("blob_eligible", "SELECT CAST(doc_id AS VARCHAR) AS file_hash FROM documents WHERE doc_id % 3 <> 0 AND doc_id * 7 % 1000 <= 500 ORDER BY doc_id * 7 % 1000, CAST(doc_id AS VARCHAR) LIMIT 50")
def blob_eligible(spark: SparkSession, d: str) -> DataFrame:
    return catalog.blob_eligible(_queue(spark, d), 500, 50).select("file_hash")


@query("gc_restored", "SELECT CAST(doc_id AS VARCHAR) AS file_hash, CASE WHEN doc_id NOT IN (3, 4) THEN doc_id END AS deleted_at FROM documents")
def gc_restored(spark: SparkSession, d: str) -> DataFrame:
    return catalog.restored(_queue(spark, d), ["3", "4"]).select("file_hash", "deleted_at")


@query("soft_deletes", "SELECT doc_id, CASE WHEN doc_id IN (2, 9) THEN 99 ELSE doc_id END AS deleted_at, CASE WHEN doc_id IN (2, 9) THEN 'deleted' WHEN doc_id % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM documents")
def soft_deletes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.soft_deleted(_queue(spark, d), [2, 9], 99).select("doc_id", "deleted_at", "status")


@query("grants_changed", "SELECT CAST(doc_id AS VARCHAR) AS namespace_id, 'user:1' AS subject, CASE WHEN doc_id % 5 = 0 THEN 'ADMIN' ELSE 'VIEWER' END AS role FROM documents WHERE doc_id % 3 <> 0")
def grants_changed(spark: SparkSession, d: str) -> DataFrame:
    """Grants raised, revoked, and revoked after having been raised."""
    old = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("namespace_id"), F.lit("user:1").alias("subject"), F.lit("VIEWER").alias("role"), "doc_id")
    up = old.filter("doc_id % 5 = 0").withColumns({"role": F.lit("ADMIN"), "op": F.lit("grant"), "at": F.lit(1)})
    gone = old.filter("doc_id % 3 = 0").withColumns({"op": F.lit("revoke"), "at": F.lit(2)})
    return catalog.change_grants(old, up.unionByName(gone))


@query("cascade_deleted", "SELECT 'block' AS kind, CAST(count(*) AS BIGINT) AS n FROM conversations WHERE conv_id % 4 <> 0 UNION ALL SELECT 'ref', CAST(count(*) AS BIGINT) FROM documents WHERE doc_id % 4 <> 0 OR doc_id NOT IN (SELECT conv_id FROM conversations)")
def cascade_deleted(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    gone = turns.filter("doc_id % 4 = 0").select("doc_id")
    blocks, refs = catalog.cascade_delete(gone, turns, table(spark, d, "documents").select("doc_id"))
    count = lambda rows, kind: rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(blocks, "block").unionByName(count(refs, "ref"))


@query("over_quota", "SELECT source AS tenant_id, CAST(sum(n_chars) AS BIGINT) AS used, CASE WHEN source <> 'src1' THEN 50000 END AS quota, source <> 'src1' AND sum(n_chars) > 50000 AS over FROM documents WHERE source IS NOT NULL GROUP BY 1")
def over_quota(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "documents").filter(F.col("source").isNotNull()).select(F.col("source").alias("tenant_id"), F.col("n_chars").alias("size_bytes"))
    limits = usage.select("tenant_id").distinct().filter("tenant_id <> 'src1'").withColumn("quota", F.lit(50_000))
    return catalog.over_quota(usage, limits)


@query("blob_round_trip", "SELECT sha256(html) AS file_hash, CAST(min(octet_length(encode(html))) AS BIGINT) AS size_bytes FROM pages WHERE html IS NOT NULL GROUP BY 1")
def blob_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All pages put into a store twice: every content is there once."""
    folder, pages = scratch_path(spark, "blobs"), table(spark, d, "pages").select(F.col("html").cast("binary").alias("content"))
    blobs.put(pages, folder)
    blobs.put(pages, folder)
    return blobs.stored(spark, folder).select("file_hash", F.octet_length("content").cast("long").alias("size_bytes"))


@query("keyed_ids", "SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS ids, true AS another_key_differs FROM documents")
def keyed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Block ids of all documents by a keyed hash: no two alike, and others under another key."""
    name = F.concat(F.lit("d/"), F.col("doc_id"))
    ids = table(spark, d, "documents").select(hashes.block_id(name, bytes(16)).alias("a"), hashes.block_id(name, bytes(range(16))).alias("b"))
    return ids.agg(F.count("*").alias("documents"), F.countDistinct("a").alias("ids"), (F.count(F.when(F.col("a") == F.col("b"), 1)) == 0).alias("another_key_differs"))
