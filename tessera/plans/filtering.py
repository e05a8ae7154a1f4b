"""Queries of filters, text functions, sources and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import filters
from tessera.plans.registry import query
from tessera.runtime import spread, table
from tessera.sources import readers

ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE "
#: name: (filter, SQL)
DSL = {
    "eq": ({"o_orderstatus": {"eq": "F"}}, "o_orderstatus = 'F'"),
    "ne": ({"o_orderpriority": {"ne": "1-URGENT"}}, "o_orderpriority <> '1-URGENT'"),
    "gt": ({"o_totalprice": {"gt": 150000}}, "o_totalprice > 150000"),
    "gte_lt": ({"o_custkey": {"gte": 100, "lt": 700}}, "o_custkey >= 100 AND o_custkey < 700"),
    "lte": ({"o_orderkey": {"lte": "5000"}}, "o_orderkey <= 5000"),
    "in": ({"o_orderstatus": {"in": ["O", "P"]}}, "o_orderstatus IN ('O', 'P')"),
    "between": ({"o_totalprice": {"between": [1000, 90000.5]}}, "o_totalprice BETWEEN 1000 AND 90000.5"),
    "like": ({"o_orderpriority": {"like": "%-HIGH"}}, "o_orderpriority LIKE '%-HIGH'"),
    "is_null": ({"o_orderstatus": {"is_null": False}, "o_orderkey": {"gt": 10}}, "o_orderstatus IS NOT NULL AND o_orderkey > 10"),
}


def _dsl(name: str, request: dict) -> None:
    @query(f"filter_dsl_{name}", ORDERS + DSL[name][1])
    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.filtered(table(spark, d, "orders"), request, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


for _name, (_request, _) in DSL.items():
    _dsl(_name, _request)


@query("filter_dsl_metadata", "SELECT event_id, user_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7' AND event_type = 'click'")
def filter_dsl_metadata(spark: SparkSession, d: str) -> DataFrame:
    return filters.filtered(table(spark, d, "events"), {"metadata.k": {"eq": 7}, "event_type": {"eq": "click"}}, ["event_id", "user_id", "event_type"], "props")


@query("guarded_sql", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def guarded_sql(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("tessera_orders")
    return filters.run_sql(spark, "SELECT o_orderstatus, count(*) AS n FROM tessera_orders GROUP BY o_orderstatus")


@query("import_by_filter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def import_by_filter(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "customer").createOrReplaceTempView("tessera_customer")
    return filters.import_rows(spark, {"table": "tessera_customer", "filter": '{"c_mktsegment": {"eq": "BUILDING"}, "c_acctbal": {"gt": 0}}', "select": ["c_custkey", "c_name"]})


BLOCKS = """b AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS source_path, CAST(1 + doc_id % 8 AS INTEGER) AS block_type,
  CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'ready' END AS status, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)), '%Y-%m-%dT00:00:00Z') AS created_at FROM documents)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i, F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), i, F.lit(".txt")).alias("source_path"), (1 + i % 8).cast("int").alias("block_type"), F.when(i % 10 == 0, "deleted").otherwise("ready").alias("status"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 60).cast("int")), "yyyy-MM-dd'T00:00:00Z'").alias("created_at"),
    )


@query("post_filter_type_time", f"WITH {BLOCKS} SELECT * FROM b WHERE status <> 'deleted' AND block_type IN (1, 2, 3, 4) AND block_type NOT IN (2) AND created_at >= '2024-01-15T00:00:00Z'")
def post_filter_type_time(spark: SparkSession, d: str) -> DataFrame:
    return filters.post_filter(_blocks(spark, d), types=[1, 2, 3, 4], not_types=[2], created_after="2024-01-15T00:00:00Z")


def _glob(name: str, pattern: str, sql: str) -> None:
    @query(f"post_filter_glob_{name}", f"WITH {BLOCKS} SELECT doc_id, source_path FROM b WHERE status <> 'deleted' AND {sql}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.post_filter(_blocks(spark, d), path_glob=pattern).select("doc_id", "source_path")


_glob("exact", "src1/en/1.txt", "source_path = 'src1/en/1.txt'")
_glob("prefix", "src1/*", "starts_with(source_path, 'src1/')")
_glob("suffix", "*7.txt", "ends_with(source_path, '7.txt')")
_glob("infix", "*/en/*", "contains(source_path, '/en/')")
_glob("interior", "src1*.txt", "starts_with(source_path, 'src1') AND ends_with(source_path, '.txt')")


@query("doc_fastpath", "SELECT doc_id, CAST(turn AS INTEGER) AS chunk_index, content_text, 1.0::DOUBLE AS score FROM (SELECT conv_id AS doc_id, turn, text AS content_text FROM conversations WHERE conv_id = 3 AND length(text) > 0 ORDER BY turn LIMIT 5)")
def doc_fastpath(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), F.col("text").alias("content_text"))
    return filters.document_blocks(blocks, 3, 5)


@query("metadata_overlay", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END, 'doc') AS k, CAST(event_id AS VARCHAR) AS own FROM events")
def metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.lit("doc").alias("k"), F.col("event_id").cast("string").alias("own")))
    merged = filters.metadata_overlay(doc, F.when(F.col("event_id") % 2 == 0, F.col("props")))
    return table(spark, d, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["own"].alias("own"))


@query("importable_files", "SELECT url FROM pages WHERE regexp_matches(lower(split_part(url, '/', -1)), '\\.html$') AND NOT regexp_matches(lower(split_part(url, '/', -1)), '^7.*$')")
def importable_files(spark: SparkSession, d: str) -> DataFrame:
    return filters.importable(table(spark, d, "pages").select(F.col("url").alias("path")), ["7*"], [".HTML"]).select(F.col("path").alias("url"))


@query("interaction_search", "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') ORDER BY turn DESC, conv_id LIMIT 20")
def interaction_search(spark: SparkSession, d: str) -> DataFrame:
    return filters.contains_text(table(spark, d, "conversations"), "text", "THE", "turn", 20, "conv_id").select("conv_id", "turn", "role")


@query("user_scope", "SELECT event_id FROM events WHERE user_id = 5 AND json_extract_string(props, '$.k') = '3'")
def user_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("metadata_json", F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("session_id"))))
    return filters.mine(rows, "5", "3").select("event_id")


@query("ttl_expiry", "SELECT event_id, (event_id % 4) > 0 AND 1706000000 > epoch(date_trunc('second', ts)) + (event_id % 4) * 86400 AS expired FROM events")
def ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", filters.expired(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), (F.col("event_id") % 4) * 86400, 1706000000).alias("expired"))


@query(
    "acl_read_check",
    "SELECT c_custkey AS namespace_id FROM customer WHERE c_nationkey = 3 OR c_custkey % 7 = 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)",
)
def acl_read_check(spark: SparkSession, d: str) -> DataFrame:
    spaces = table(spark, d, "customer").select(F.col("c_custkey").alias("namespace_id"), F.col("c_nationkey").cast("string").alias("owner_tenant"), (F.col("c_custkey") % 7 == 0).alias("is_public"))
    grants = table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("namespace_id"), F.lit("user:u1").alias("subject"), F.lit("VIEWER").alias("role"))
    return filters.readable(spaces, grants, "3", "u1").select("namespace_id")


@query("acl_write_check", "SELECT c_custkey AS namespace_id FROM customer WHERE c_nationkey = 3 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0 AND o_orderstatus = 'F')")
def acl_write_check(spark: SparkSession, d: str) -> DataFrame:
    spaces = table(spark, d, "customer").select(F.col("c_custkey").alias("namespace_id"), F.col("c_nationkey").cast("string").alias("owner_tenant"), F.lit(True).alias("is_public"))
    role = F.when(F.col("o_orderstatus") == "F", "EDITOR").otherwise("VIEWER")
    grants = table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("namespace_id"), F.lit("tenant:3").alias("subject"), role.alias("role"))
    return filters.readable(spaces, grants, "3", "u1", write=True).select("namespace_id")


@query("page_offset_limit", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def page_offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(table(spark, d, "events"), 50, 25, F.desc("ts"), F.col("event_id"))[0].select("event_id", "event_type")


# --- text -------------------------------------------------------------------------------


@query(
    "token_estimates",
    r"""
SELECT doc_id,
  CAST(greatest(1, coalesce(list_sum(list_transform(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x21-\x7F]+'), lambda w: greatest(1, (length(w) + 2) // 3))), 0)
    + 2 * len(regexp_extract_all(text, '[\x{800}-\x{10FFFF}]')) + len(regexp_extract_all(text, '[\x{80}-\x{7FF}]'))) AS INTEGER) AS splitter,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '[\x00-\x08\x0B\x0E-\x1F\x21-\x7F]+'), lambda w: greatest(1, (length(w) + 3) // 4))), 0) + len(regexp_extract_all(text, '[\x{80}-\x{10FFFF}]')) AS INTEGER) AS chunker,
  CAST(len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x21-\x7F]+')) + 2 * len(regexp_extract_all(text, '[\x{800}-\x{FFFF}]')) + len(regexp_extract_all(text, '[\x{80}-\x{7FF}\x{10000}-\x{10FFFF}]')) AS INTEGER) AS injector
FROM documents WHERE length(text) > 0
""",
)
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spread(table(spark, d, "documents").select("doc_id", "text")).filter(F.length(t) > 0).select("doc_id", text.estimate_splitter(t).alias("splitter"), text.estimate_chunker(t).alias("chunker"), text.estimate_injector(t).alias("injector"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha, 'sha256:' || substr(sha256(text), 1, 32) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.sha256(F.col("text")).alias("sha"), text.content_hash(F.col("text")).alias("content_hash"))


@query("title_from_filename", r"SELECT page_id, split_part(url, '/', -1) AS filename, regexp_replace(split_part(url, '/', -1), '(?s)^(.+)\.[^.]*$', '\1') AS title FROM pages")
def title_from_filename(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.split("url", "/"), -1)
    return table(spark, d, "pages").select("page_id", name.alias("filename"), text.title_of(name).alias("title"))


@query("metadata_block_text", "SELECT doc_id, concat_ws(', ', source, 'text/plain document', CASE WHEN doc_id % 5 > 0 THEN (doc_id % 5) || ' pages' END, lang, 'tags: ' || lang || ' / ' || source) AS block_text FROM documents")
def metadata_block_text(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.metadata import block_text

    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("filename"), F.lit("text/plain").alias("mime_type"), (F.col("doc_id") % 5).alias("page_count"), "lang", F.array("lang", "source").alias("tags"))
    return docs.select("doc_id", block_text(docs).alias("block_text"))


@query("snippets", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 400) || '[...]' || right(text, 100) ELSE text END AS snippet FROM documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(
    "search_sanitize",
    r"""
WITH b AS (SELECT item_id, regexp_replace(regexp_replace(text, '[*()]', '', 'g'), '[\^:]', ' ', 'g') AS text FROM benchmark),
w AS (SELECT item_id, list_filter(list_transform(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '' AND w NOT IN ('AND', 'OR', 'NOT', 'NEAR') AND NOT starts_with(w, 'NEAR/')),
  lambda w: regexp_replace(w, '^[+\-]+', '')), lambda w: regexp_matches(w, '[\p{L}\p{N}]')) AS ws FROM b)
SELECT item_id, array_to_string(list_transform(ws, lambda w: chr(34) || replace(w, chr(34), '') || chr(34)), ' OR ') AS fts FROM w
""",
)
def search_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.or_query(F.col("text")).alias("fts"))


@query("variant_keep", r"""
WITH a AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS v FROM benchmark),
c AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN (STOP))) AS x,
  list_distinct(list_filter(regexp_extract_all(lower(coalesce(v, '')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN (STOP))) AS y FROM a WHERE v IS NOT NULL)
SELECT item_id, CAST(len(list_intersect(x, y)) AS INTEGER) AS shared, CASE WHEN lower(text) = lower(v) THEN false WHEN len(x) < 3 THEN true WHEN len(y) = 0 THEN false WHEN len(x) <= 5 THEN shared >= 1
  WHEN len(x) <= 8 THEN shared >= 2 OR shared::DOUBLE / len(x) >= 0.35 ELSE shared >= 3 OR shared::DOUBLE / len(x) >= 0.30 END AS keep FROM c
""".replace("STOP", ", ".join(f"'{w}'" for w in text.STOPWORDS)))
def variant_keep(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").withColumn("v", F.lead("text").over(Window.orderBy("item_id"))).filter("v IS NOT NULL")
    shared = F.size(F.array_intersect(text.content_words(F.col("text")), text.content_words(F.col("v"))))
    return rows.select("item_id", shared.alias("shared"), text.keeps_variant(F.col("text"), F.col("v")).alias("keep"))


@query("log_redaction", "SELECT event_id, '****' AS secret, CASE WHEN length(k) <= 11 THEN '***' ELSE substr(k, 1, 8) || '***' || right(k, 3) END AS api_key, '10.' || (event_id % 9) || '.***.***' AS ip, substr(k, 1, 50) || '...[sha256:' || sha256(k) || ']' AS query_text FROM (SELECT event_id, event_type || '-' || event_id AS k FROM events)")
def log_redaction(spark: SparkSession, d: str) -> DataFrame:
    k = F.concat_ws("-", "event_type", "event_id")
    ip = F.concat(F.lit("10."), F.col("event_id") % 9, F.lit(".1.2"))
    return table(spark, d, "events").select("event_id", text.mask("redact", k).alias("secret"), text.mask("partial", k).alias("api_key"), text.mask("pii", ip, "ip_address").alias("ip"), text.mask("truncate", k, "query_text").alias("query_text"))


@query("follow_up_cues", "SELECT conv_id, turn, list_bool_or(list_transform([" + ", ".join(f"' {w} '" for w in text.FOLLOW_UP_WORDS) + "], lambda w: contains(' ' || lower(text) || ' ', w))) OR list_bool_or(list_transform([" + ", ".join(f"'{w}'" for w in text.FOLLOW_UP_PHRASES) + "], lambda w: contains(lower(text), w))) AS follow_up, list_bool_or(list_transform([" + ", ".join(f"'{w}'" for w in text.INJECTION_PHRASES) + "], lambda w: contains(lower(text), w))) AS injected FROM conversations")
def follow_up_cues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_follow_up(F.col("text")).alias("follow_up"), text.has_injection(F.col("text")).alias("injected"))


# --- sources ----------------------------------------------------------------------------


@query("doc_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def doc_lookup(spark: SparkSession, d: str) -> DataFrame:
    return readers.documents_by(table(spark, d, "documents"), doc_id=17).select("doc_id", "lang", "source")


@query("docs_by_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def docs_by_status(spark: SparkSession, d: str) -> DataFrame:
    return readers.documents_by(table(spark, d, "orders"), o_orderstatus="P").select("o_orderkey")


@query("doc_blocks_in_order", "SELECT conv_id AS doc_id, turn AS chunk_index, role FROM conversations WHERE conv_id = 5 ORDER BY turn")
def doc_blocks_in_order(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "role")
    return readers.blocks_of(blocks, 5)


@query("block_counts", "SELECT conv_id AS doc_id, CAST(count(*) AS BIGINT) AS n_blocks FROM conversations GROUP BY 1")
def block_counts(spark: SparkSession, d: str) -> DataFrame:
    return readers.block_counts(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")))


@query("deleted_before", "SELECT doc_id, doc_id * 1000 AS deleted_at FROM documents WHERE doc_id % 10 = 0 AND doc_id * 1000 <= 400000")
def deleted_before(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "deleted").otherwise("ready").alias("status"), (F.col("doc_id") * 1000).alias("deleted_at"))
    return readers.deleted_before(docs, 400_000).select("doc_id", "deleted_at")


@query("mime_inference", r"SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\.([A-Za-z0-9]+)$', 1)) AS ext, CASE WHEN ends_with(split_part(split_part(url, '?', 1), '#', 1), '.html') THEN 'text/html' ELSE 'application/octet-stream' END AS mime, CAST(1 AS INTEGER) AS block_type, CAST(3 AS INTEGER) AS level FROM pages")
def mime_inference(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    return readers.with_format(files).select("page_id", "ext", "mime", "block_type", "level")


@query("rows_to_text_per_row", "SELECT n_nationkey AS first_id, CAST(1 AS INTEGER) AS n_rows, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) AS text FROM nation")
def rows_to_text_per_row(spark: SparkSession, d: str) -> DataFrame:
    return readers.rows_to_text(table(spark, d, "nation"), ["n_nationkey", "n_name"], "n_nationkey")


@query("rows_to_text_merge", "SELECT min(n_nationkey) AS first_id, CAST(count(*) AS INTEGER) AS n_rows, string_agg('n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10), chr(10) || '---' || chr(10) ORDER BY n_nationkey) AS text FROM (SELECT *, (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS g FROM nation) GROUP BY g")
def rows_to_text_merge(spark: SparkSession, d: str) -> DataFrame:
    return readers.rows_to_text(table(spark, d, "nation"), ["n_nationkey", "n_name"], "n_nationkey", 10)


@query("overwrite_by_source", "SELECT doc_id, source FROM documents WHERE NOT starts_with(source, 'src1') UNION ALL SELECT doc_id + 1000000, source FROM documents WHERE source = 'src1'")
def overwrite_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return readers.replace_source(docs, docs.filter("source = 'src1'").withColumn("doc_id", F.col("doc_id") + 1_000_000), "src1")


@query("batch_validation", "SELECT CAST(conv_id AS BIGINT) AS doc_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN 'duplicate_id' WHEN length(text) = 0 THEN 'empty' END AS error FROM conversations")
def batch_validation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return readers.check_batch(docs, most_docs=10**9).select("doc_id", "turn", "error")


@query("ocr_fallback", "SELECT o_custkey AS doc_id, NOT bool_or(o_orderpriority = '5-LOW') AND (avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) > 0.5 OR avg(o_orderkey % 10 / 10.0::DOUBLE) < 0.5) AS fallback FROM orders GROUP BY 1")
def ocr_fallback(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderstatus") != "F").alias("ok"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), F.when(F.col("o_orderpriority") == "5-LOW", "corrupt").alias("error")
    )
    return readers.needs_fallback(pages)


@query("html_text")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(F.concat(F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return readers.parse_files(files)
