"""Queries of the whole engine, and of what is left between its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.models import HashingEmbedder, embedding
from tessera.operators import filters, retrieval
from tessera.operators.ann import CellIndex
from tessera.operators.bloom import Bloom
from tessera.plans import retrieval as retrieval_plans
from tessera.plans.registry import query
from tessera.runtime import materialize, table
from tessera.search import Engine, Options
from tessera.sources import readers


def _engine(spark: SparkSession, d: str) -> tuple[Engine, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("namespace_id"), F.concat(F.col("source"), F.lit(".txt")).alias("filename"), "text", "lang")
    return Engine.ingest(docs), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("engine_search")
def engine_search(spark: SparkSession, d: str) -> DataFrame:
    engine, asked = _engine(spark, d)
    return engine.search(asked, options=Options(granularity="chunk")).drop("parent_text")


@query("engine_search_hybrid")
def engine_search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    engine, asked = _engine(spark, d)
    return engine.search(asked).drop("parent_text")


@query("dense_knn_cells", retrieval_plans.L2_SQL)
def dense_knn_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cell index with all cells probed is exact; ``dense_knn_cells_probed`` prunes."""
    e = table(spark, d, "embeddings")
    index = CellIndex(e)
    return index.search(e.filter(retrieval_plans.HUNDREDTHS), 10, probe=index.cells)


@query("dense_knn_cells_probed")
def dense_knn_cells_probed(spark: SparkSession, d: str) -> DataFrame:
    """The same queries with the production probe; ``dense_knn_cells_recall`` has its recall."""
    e = table(spark, d, "embeddings")
    return CellIndex(e).search(e.filter(retrieval_plans.HUNDREDTHS), 10)


@query("dense_knn_cells_recall", "SELECT true AS enough, CAST(count(*) FILTER (vec_id % 100 = 0) * 10 AS BIGINT) AS wanted FROM embeddings")
def dense_knn_cells_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the production probe finds nine tenths of the exact ten nearest."""
    e = table(spark, d, "embeddings")
    asked = e.filter(retrieval_plans.HUNDREDTHS)
    exact, found = retrieval.knn(e, asked, 10), CellIndex(e).search(asked, 10)
    both = exact.join(found.select("query_id", "vec_id", F.lit(True).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"), F.count("*").alias("wanted"))


@query("metadata_search", "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') IN ('5', '6')")
def metadata_search(spark: SparkSession, d: str) -> DataFrame:
    return filters.filtered(table(spark, d, "events"), {"metadata.k": {"in": ["5", "6"]}}, ["event_id", "event_type"], "props")


@query("block_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT conv_id * 3 FROM conversations)")
def block_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").select((F.col("conv_id") * 3).alias("doc_id"))
    return readers.by_ids(table(spark, d, "documents").select("doc_id", "lang"), ids)


@query("lookup_by_hash", "WITH h AS (SELECT doc_id, 'sha256:' || substr(sha256(text), 1, 32) AS content_hash FROM documents) SELECT min(doc_id) AS doc_id, content_hash FROM h WHERE content_hash IN (SELECT content_hash FROM h WHERE doc_id % 100 = 0) GROUP BY content_hash")
def lookup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hashes are stored once; the hashes looked up are those of every hundredth document."""
    stored = materialize(table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash")), "hashes")
    return readers.by_content_hash(stored, stored.filter("doc_id % 100 = 0"))


@query(
    "vector_hit_kinds",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN 'hype' WHEN doc_id % 4 = 0 THEN 'dropped' WHEN doc_id % 5 = 0 THEN 'contextualized' ELSE 'dense' END AS kind FROM documents",
)
def vector_hit_kinds(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    kind = retrieval.vector_kind(F.when(i % 4 == 0, 16).otherwise(1), F.when(i % 3 != 0, i), i % 5 == 0)
    return table(spark, d, "documents").select(i, kind.alias("kind"))


@query("hype_votes", "SELECT query_id, source_child_id, block_id, rank FROM (SELECT doc_id % 7 AS query_id, doc_id % 40 AS source_child_id, doc_id AS block_id, (doc_id * 31) % 101 AS rank FROM documents) QUALIFY row_number() OVER (PARTITION BY query_id, source_child_id ORDER BY rank, block_id) = 1")
def hype_votes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    hits = table(spark, d, "documents").select((i % 7).alias("query_id"), (i % 40).alias("source_child_id"), i.alias("block_id"), (i * 31 % 101).alias("rank"))
    return retrieval.first_vote(hits).select("query_id", "source_child_id", "block_id", "rank")


@query("parent_join", "SELECT c.conv_id AS child_id, c.turn, p.lang FROM conversations c LEFT JOIN documents p ON c.conv_id = p.doc_id AND p.doc_id % 2 = 0")
def parent_join(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("parent_id"), "lang")
    hits = table(spark, d, "conversations").select(F.col("conv_id").alias("child_id"), F.col("conv_id").alias("parent_id"), "turn")
    return retrieval.with_parents(hits, parents).select("child_id", "turn", "lang")


@query("entity_search", r"WITH e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS entity FROM documents) SELECT entity, CAST(count(*) AS BIGINT) AS documents FROM e GROUP BY 1 HAVING count(*) >= 3")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.entity_index(table(spark, d, "documents"))


@query("watcher_statistics", "SELECT event_type AS directory, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (event_id % 5 = 0) AS BIGINT) AS imported, CAST(count(*) FILTER (event_id % 5 = 1) AS BIGINT) AS skipped, CAST(grouping(event_type) AS INTEGER) AS overall FROM events GROUP BY ROLLUP (event_type)")
def watcher_statistics(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_id") % 5 == 0, "imported").when(F.col("event_id") % 5 == 1, "skipped").otherwise("seen")
    return readers.watcher_statistics(table(spark, d, "events").select(F.col("event_type").alias("directory"), state.alias("state")))


@query("bloom_precheck", "SELECT CAST(count(*) AS BIGINT) AS members, CAST(count(*) AS BIGINT) AS members_passed, CAST((SELECT count(DISTINCT -1 - event_id) FROM events) AS BIGINT) AS others, true AS within_rate FROM (SELECT DISTINCT doc_id FROM documents)")
def bloom_precheck(spark: SparkSession, d: str) -> DataFrame:
    """Members and others asked, members passed (all), and whether others pass within twice the rate aimed at."""
    members = table(spark, d, "documents").select(F.col("doc_id").alias("k")).distinct()
    others = table(spark, d, "events").select((-1 - F.col("event_id")).alias("k")).distinct()
    bloom = Bloom.build(members, "k", members.count())
    asked = members.withColumn("is_in", F.lit(True)).unionByName(others.withColumn("is_in", F.lit(False)))
    some = lambda rows: rows.agg(F.count(F.when(F.col("is_in"), 1)).alias("members"), F.count(F.when(~F.col("is_in"), 1)).alias("others"))
    passed = some(bloom.might_contain(asked, "k")).toDF("members_passed", "others_passed")
    joined = some(asked).crossJoin(passed)  # one row each
    return joined.select("members", "members_passed", "others", (F.col("others_passed") <= 0.02 * F.col("others")).alias("within_rate"))


@query("bloom_pass_counts")
def bloom_pass_counts(spark: SparkSession, d: str) -> DataFrame:
    """A filter of all documents' texts: how many of them it passes, and how many of the other texts of conversations."""
    texts = lambda name: table(spark, d, name).filter(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("k")).distinct()
    keys = texts("documents")
    others = texts("conversations").join(keys, "k", "left_anti")
    asked = keys.withColumn("is_in", F.lit(True)).unionByName(others.withColumn("is_in", F.lit(False)))
    passed = Bloom.build(keys, "k", keys.count()).might_contain(asked, "k").groupBy("is_in").agg(F.count("*").alias("passed"))
    rows = asked.groupBy("is_in").agg(F.count("*").alias("asked"))
    return rows.join(passed, "is_in", "left").select("is_in", "asked", F.coalesce("passed", F.lit(0)).alias("passed"))


@query(
    "explain_paths",
    f"""
WITH {retrieval_plans.BM25_CTES.replace('{k}', '30')}, n AS (SELECT count(*) AS n FROM documents), h AS (SELECT query_id, least(30, count(*)) AS hits FROM s GROUP BY 1)
SELECT query_id, route, CAST(hits AS BIGINT) AS hits FROM (SELECT query_id, unnest(['fts5', 'sparse']) AS route, hits FROM h) UNION ALL SELECT item_id, 'dense', CAST(least(30, n) AS BIGINT) FROM benchmark, n
""",
)
def explain_paths(spark: SparkSession, d: str) -> DataFrame:
    """Hits by route of the engine itself, over whole documents as blocks."""
    blocks = table(spark, d, "documents").select(F.col("doc_id").alias("block_id"), F.col("source").alias("namespace_id"), F.coalesce("text", F.lit("")).alias("content"))
    blocks = materialize(blocks.withColumn("embedding", embedding(HashingEmbedder())(F.col("content"))), "explain-blocks")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return Engine(blocks, blocks, blocks).explain(asked, Options(top_k=10))
