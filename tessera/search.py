"""The engine's front: ingest documents, then answer batches of queries over namespaces.

A query batch is a DataFrame (query_id, text). All routes are branches of one plan over
tables partitioned by namespace; their hits, and what these merge to, are written once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.models import Embedder, HashingEmbedder, Reranker, embedding, rerank_score
from tessera.operators import chunking, cleaning, filters, fusion, metadata, retrieval
from tessera.runtime import materialize, size_in_bytes


@dataclass
class Options:
    top_k: int = 10
    granularity: str = "auto"  # auto, hybrid, chunk, doc
    route: str = "complex"  # complex, simple, chat
    rerank: bool = False
    filter: dict | None = None
    per_parent: int = 3
    posting_cap: int | None = None  # postings of each (namespace, term) that the sparse route reads; None reads all


@dataclass
class Engine:
    """Tables of one store: documents, blocks (children), metadata blocks, parents, labels.

    Labels are vectors that stand for a block: questions it answers (``block_type`` 16) and
    its text with context. ``parents``, ``labels`` and the full-text ``index`` may be missing;
    parents are a table (parent_id, parent_text) or what makes it of hits (doc_id, parent_id).
    """

    documents: DataFrame
    blocks: DataFrame
    metadata: DataFrame
    embedder: Embedder = field(default_factory=HashingEmbedder)
    reranker: Reranker | None = None
    parents: Callable[[DataFrame], DataFrame] | DataFrame | None = None
    labels: DataFrame | None = None
    index: retrieval.TextIndex | None = None

    @classmethod
    def ingest(cls, docs: DataFrame, embedder: Embedder | None = None, reranker: Reranker | None = None) -> Engine:
        """Chunk, describe, embed, mark and deduplicate whole documents.

        ``docs``: doc_id, namespace_id, filename, text, and anything else. Blocks and their
        terms are written once; searches read them. Parents are not stored: a search chunks
        the documents of its answers again.
        """
        model = embedder or HashingEmbedder()
        live = docs.filter(F.coalesce(F.col("status"), F.lit("")) != "deleted") if "status" in docs.columns else docs
        named = chunking.chunk_units(live.filter(F.col("doc_id").isNotNull()), also=("namespace_id", "filename"))
        ids = F.concat_ws("/", "namespace_id", "doc_id", "chunk_index")
        parent = F.concat_ws("/", "doc_id", F.when(F.col("parent_id") != "", F.col("parent_id"))).alias("parent_id")
        blocks = named.select(
            F.xxhash64(ids).alias("block_id"), ids.alias("child_id"), "doc_id", "namespace_id", parent, "chunk_index",
            F.lit(1).alias("block_type"), F.col("child_text").alias("content"), F.col("filename").alias("source_path"), embedding(model)(F.col("child_text")).alias("embedding"),
        )
        marked = cleaning.searchable(cleaning.anomalies(materialize(blocks, "blocks"), "block_id", "content", "embedding", id_counts=False))
        described = live.select("doc_id", "namespace_id", "filename", F.lit("text/plain").alias("mime_type"), F.lit(-1).alias("page_count"), *(["lang"] if "lang" in live.columns else []))
        about = metadata.metadata_blocks(described, ("namespace_id", "filename"))
        index = retrieval.TextIndex.build(marked, "block_id", "content")

        def parents(hits: DataFrame) -> DataFrame:
            texts = live.select("doc_id", "text").join(_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
            return chunking.parents(chunking.chunk_units(texts)).select(parent, "parent_text").join(_small(hits.select("parent_id").distinct()), "parent_id", "left_semi")

        return cls(live, marked, about, model, reranker, parents, index=index)

    def labelled(self, questions: DataFrame | None = None, contexts: DataFrame | None = None) -> Engine:
        """The store with vectors of ``questions`` (child_id, question) and ``contexts`` (child_id, context)."""
        of = self.blocks.select("child_id", "namespace_id", "content")
        parts = []
        if questions is not None:
            parts.append(of.join(questions, "child_id").select("child_id", "namespace_id", F.lit(16).alias("block_type"), F.lit(False).alias("contextual"), F.col("question").alias("said")))
        if contexts is not None:
            whole = cleaning.contextual(F.col("content"), F.col("context"))[0]
            parts.append(of.join(contexts, "child_id").select("child_id", "namespace_id", F.lit(1).alias("block_type"), F.lit(True).alias("contextual"), whole.alias("said")))
        rows = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
        made = rows.select(F.xxhash64("child_id", "block_type", "contextual", "said").alias("block_id"), "namespace_id", F.col("child_id").alias("source_child_id"), "block_type", "contextual", embedding(self.embedder)(F.col("said")).alias("embedding"))
        return replace(self, labels=materialize(made, "labels"))

    def namespaces(self) -> list[str]:
        return [r[0] for r in self.documents.select("namespace_id").distinct().orderBy("namespace_id").collect()]

    # --- routes -------------------------------------------------------------------------

    def chunk_hits(self, queries: DataFrame, blocks: DataFrame, options: Options) -> DataFrame:
        """query_id, block_id, score, routes: up to five routes fused.

        Full text and dense vectors always; sparse terms, questions and contextual vectors on
        the complex route. Vector routes share one search, over three times the pool if there
        are labels, and then go by what was hit.
        """
        pool = retrieval.pool_size(options.top_k)
        index = self.index or retrieval.TextIndex.build(blocks, "block_id", "content")
        if self.index is not None and blocks is not self.blocks:
            index = index.among(blocks.select(F.col("block_id").alias("doc_id")))
        lexical = index.bm25(queries, pool, query_id="query_id")
        vectors = queries.select(F.col("query_id").alias("vec_id"), embedding(self.embedder)(F.col("text")).alias("embedding"))
        plain = blocks.select(F.col("block_id").alias("vec_id"), "embedding")
        lists = [lexical.select("query_id", F.lit("fts5").alias("route"), F.col("doc_id").alias("id"), "rank")]
        if options.route != "complex" or self.labels is None:
            dense = retrieval.knn(plain, vectors, pool, "cosine")
            lists.append(dense.select("query_id", F.lit("dense").alias("route"), F.col("vec_id").alias("id"), "rank"))
        else:
            lists.append(self._vector_routes(plain, blocks, vectors, pool))
        if options.route == "complex" and options.posting_cap is None:
            sparse = index.sparse(queries, pool)
            lists.append(sparse.select("query_id", F.lit("sparse").alias("route"), F.col("doc_id").alias("id"), "rank"))
        elif options.route == "complex":
            wanted = index.postings.join(retrieval.query_terms(queries, "query_id", "text").select("term").distinct(), "term", "left_semi")
            named = wanted.join(blocks.select(F.col("block_id").alias("doc_id"), F.col("namespace_id").alias("ns")), "doc_id")
            terms = named.select("ns", "term", F.col("doc_id").alias("child_id"), F.log1p(F.col("tf").cast("double")).alias("weight"))
            sparse = retrieval.sparse_dot(terms, retrieval.query_terms(queries, "query_id", "text").withColumn("qw", F.lit(1.0)), pool, options.posting_cap)
            lists.append(sparse.select("query_id", F.lit("sparse").alias("route"), F.col("child_id").alias("id"), "rank"))
        rows = lists[0]
        for part in lists[1:]:
            rows = rows.unionByName(part)
        return fusion.rrf(rows, rank_base=0).select("query_id", F.col("id").alias("block_id"), "score", "routes")

    def _vector_routes(self, plain: DataFrame, blocks: DataFrame, vectors: DataFrame, pool: int) -> DataFrame:
        """query_id, route, id, rank of dense, question and contextual hits; a label's hit is its block's."""
        named = self.labels.join(blocks.select(F.col("child_id").alias("source_child_id"), F.col("block_id").alias("of")), "source_child_id")
        found = retrieval.knn(plain.unionByName(named.select(F.col("block_id").alias("vec_id"), "embedding")), vectors, 3 * pool, "cosine")
        about = named.select(F.col("block_id").alias("vec_id"), "of", "block_type", "source_child_id", "contextual")
        hits = found.join(about, "vec_id", "left")
        route = retrieval.vector_kind(F.coalesce("block_type", F.lit(1)), F.col("source_child_id"), F.coalesce("contextual", F.lit(False)))
        hits = hits.select("query_id", route.alias("route"), F.coalesce("of", "vec_id").alias("id"), F.col("vec_id").alias("block_id"), "rank").filter("route <> 'dropped'")
        order = Window.partitionBy("query_id", "route", "id").orderBy("rank", "block_id")
        first = hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
        place = Window.partitionBy("query_id", "route").orderBy("rank", "block_id")
        return first.withColumn("rank", F.row_number().over(place).cast("int")).filter(F.col("rank") <= pool).select("query_id", "route", "id", "rank")

    def document_hits(self, queries: DataFrame, described: DataFrame, options: Options) -> DataFrame:
        """query_id, doc_id, rank (from 0): full text over titles, names and topics, and summary vectors."""
        fields = {"filename": 1.0, "doc_title": 2.0, "topics": 1.5}
        lexical = retrieval.field_bm25(described, fields, queries, 4 * options.top_k, query_id="query_id", query_text="text").withColumn("title", F.lit(None).cast("string"))
        vectors = queries.select(F.col("query_id").alias("vec_id"), embedding(self.embedder)(F.col("text")).alias("embedding"))
        summaries = described.select(F.col("doc_id").alias("vec_id"), embedding(self.embedder)(F.col("block_text")).alias("embedding"))
        dense = retrieval.knn(summaries, vectors, 4 * options.top_k, "cosine").select("query_id", F.col("vec_id").alias("doc_id"), F.col("rank") - 1, F.lit(None).cast("string").alias("title")).toDF("query_id", "doc_id", "rank", "title")
        fused = fusion.discovery_fusion(dense, lexical.select("query_id", "doc_id", (F.col("rank") - 1).alias("rank"), "title"))
        return fused.select("query_id", "doc_id", "score", (F.col("position") - 1).alias("rank"))

    # --- queries ------------------------------------------------------------------------

    def search(self, queries: DataFrame, namespaces: list[str] | None = None, options: Options | None = None, readable: list[str] | None = None) -> DataFrame:
        """query_id, position, namespace_id, child_id, doc_id, score, content, parent_text, sources."""
        options = options or Options()
        names = fusion.authorised(namespaces or ["*"], readable if readable is not None else self.namespaces())
        for n in names:
            filters.check_request("", [n], options.top_k)
        whole = readable is None and (namespaces or ["*"]) == ["*"]
        blocks = self.blocks if whole else self.blocks.filter(F.col("namespace_id").isin(*names))
        if options.filter:
            blocks = filters.filtered(blocks, options.filter)
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "text")
        # written first, as are their blocks and what they merge to: no other block's text is shuffled for them
        hits = materialize(self.chunk_hits(asked, blocks, options), "search-hits")
        found = materialize(blocks.drop("embedding").join(_small(hits), "block_id").withColumn("content_hash", text.content_hash(F.col("content"))), "search-found")
        found_blocks = found
        if options.granularity in ("auto", "hybrid", "doc"):
            found = self._by_document(asked, found, names, options)
        capped = fusion.children_per_parent(found, options.per_parent)
        if options.rerank and self.reranker is not None:
            scored = capped.join(asked, "query_id").withColumn("rerank", rerank_score(self.reranker)(F.col("text"), F.col("content")))
            capped = scored.withColumn("score", scoring.blend(F.col("rerank"), F.col("score")))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "child_id")
        merged = materialize(fusion.cross_namespace(capped.withColumn("at", F.row_number().over(order)), options.top_k), "search-merged")
        details = found_blocks.select("query_id", "namespace_id", "child_id", "doc_id", "content", "parent_id")
        answers = merged.join(details, ["query_id", "namespace_id", "child_id"])
        parents = self.parents if self.parents is not None else blocks.sparkSession.createDataFrame([], "parent_id string, parent_text string")
        if callable(parents):
            answers = materialize(answers, "search-answers")
            parents = materialize(parents(answers), "search-parents")
        return answers.transform(retrieval.with_parents, parents).withColumn("parent_text", F.coalesce("parent_text", F.lit(""))).select("query_id", "position", "namespace_id", "child_id", "doc_id", "score", "content", "parent_text", "sources")

    def _by_document(self, asked: DataFrame, found: DataFrame, names: list[str], options: Options) -> DataFrame:
        """Chunks scored by their document's fused rank: the best chunk stands for it."""
        described = self.metadata.filter(F.col("namespace_id").isin(*names))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "block_id")
        chunks = found.select("query_id", "doc_id", F.col("block_id").alias("chunk_id"), (F.row_number().over(order) - 1).alias("rank"))
        fused = fusion.hybrid_by_document(chunks, self.document_hits(asked, described, options)).filter(F.col("chunk_id").isNotNull())
        best = fused.select("query_id", F.col("chunk_id").alias("block_id"), F.col("score").alias("doc_score"))
        return found.join(best, ["query_id", "block_id"]).withColumn("score", F.col("doc_score")).drop("doc_score")

    def explain(self, queries: DataFrame, options: Options | None = None) -> DataFrame:
        """How many of each query's hits every route brought."""
        hits = self.chunk_hits(queries.select(F.col("query_id").cast("long").alias("query_id"), "text"), self.blocks, options or Options())
        return hits.select("query_id", F.explode(F.split("routes", ",")).alias("route")).groupBy("query_id", "route").agg(F.count("*").alias("hits"))


#: Bytes, as written, up to which hits and their ids are broadcast; they grow with the query batch only.
SMALL_BYTES = 8 << 20


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast if its own size, or that of what it was read from, is small."""
    return F.broadcast(rows) if size_in_bytes(rows) <= SMALL_BYTES else rows


def chat_facts(facts: DataFrame, user_id: str, top_k: int) -> DataFrame:
    """A pleasantry needs no retrieval: the user's newest active facts of all namespaces."""
    mine = facts.filter((F.col("user_id") == user_id) & (F.col("status") == "active"))
    return mine.orderBy(F.desc("created_s"), "block_id").limit(top_k)


# --- SQL functions ----------------------------------------------------------------------


SQL_SEARCH = r"""
CREATE OR REPLACE TEMPORARY FUNCTION tessera_search(ns STRING, asked STRING, top_k INT)
RETURNS TABLE(position INT, child_id STRING, doc_id BIGINT, score DOUBLE, content STRING)
RETURN
WITH st AS (SELECT namespace_id, count(*) AS n, avg(len) AS m FROM tessera_lengths GROUP BY 1),
df AS (SELECT namespace_id, term, count(*) AS df FROM tessera_postings GROUP BY 1, 2),
lex AS (SELECT p.block_id, round(sum(greatest({floor}D, ln((st.n - df.df + 0.5D) / (df.df + 0.5D))) * p.tf * {up}D / (p.tf + {k1}D * ({flat}D + {b}D * p.len / st.m))), 6) AS s
  FROM tessera_postings p JOIN st USING (namespace_id) JOIN df USING (namespace_id, term)
  WHERE p.namespace_id = tessera_search.ns AND array_contains(regexp_extract_all(lower(tessera_search.asked), '[\\p{{L}}\\p{{N}}]+', 0), p.term) GROUP BY 1),
near AS (SELECT block_id, embedding AS v, tessera_embed(tessera_search.asked) AS q FROM tessera_blocks WHERE namespace_id = tessera_search.ns),
vec AS (SELECT block_id, round(coalesce(aggregate(zip_with(v, q, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (t, x) -> t + x)
  / nullif(sqrt(aggregate(v, 0D, (t, x) -> t + CAST(x AS DOUBLE) * x)) * sqrt(aggregate(q, 0D, (t, x) -> t + CAST(x AS DOUBLE) * x)), 0D), 0D), 6) AS s FROM near),
ranks AS (
  SELECT block_id, row_number() OVER (ORDER BY s DESC, block_id) AS r FROM lex
  UNION ALL SELECT block_id, row_number() OVER (ORDER BY s DESC, block_id) AS r FROM vec),
fused AS (SELECT block_id, round(sum(1 / ({rrf}D + r - 1)), 9) AS score FROM ranks WHERE r <= greatest(tessera_search.top_k, least(3 * tessera_search.top_k, 50)) GROUP BY 1),
placed AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, block_id) AS INT) AS position FROM fused)
SELECT position, child_id, doc_id, score, content FROM placed JOIN tessera_blocks USING (block_id) WHERE position <= tessera_search.top_k
"""
SQL_DOCUMENTS = """
CREATE OR REPLACE TEMPORARY FUNCTION tessera_list_documents(ns STRING) RETURNS TABLE(doc_id BIGINT, filename STRING, n_blocks BIGINT)
RETURN SELECT d.doc_id, d.filename, count(b.block_id) FROM tessera_documents d LEFT JOIN tessera_blocks b ON b.doc_id = d.doc_id AND b.namespace_id = d.namespace_id
  WHERE d.namespace_id = tessera_list_documents.ns GROUP BY 1, 2
"""
SQL_MEMORY = """
CREATE OR REPLACE TEMPORARY FUNCTION tessera_memory_search(who STRING, now_s BIGINT, top_k INT) RETURNS TABLE(position INT, block_id BIGINT, content STRING, score DOUBLE)
RETURN WITH s AS (SELECT block_id, content, round(greatest(0D, raw_score * CASE WHEN coalesce(memory_type, '') IN ('fact', 'preference') THEN 1D ELSE exp(-{decay}D * greatest(0, floor((tessera_memory_search.now_s - created_s) / 86400))) END), 6) AS score
  FROM tessera_facts WHERE user_id = tessera_memory_search.who AND coalesce(status, '') <> 'invalidated'),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, block_id) AS INT) AS position FROM s)
SELECT position, block_id, content, score FROM r WHERE position <= tessera_memory_search.top_k
"""
SQL_INTERACTIONS = """
CREATE OR REPLACE TEMPORARY FUNCTION tessera_list_interactions(who STRING, needle STRING, most INT, skip INT) RETURNS TABLE(position INT, id BIGINT, created_at BIGINT, content STRING)
RETURN WITH r AS (SELECT id, created_at, content, CAST(row_number() OVER (ORDER BY created_at DESC, id) AS INT) AS position FROM tessera_interactions
  WHERE user_id = tessera_list_interactions.who AND contains(lower(content), lower(tessera_list_interactions.needle)))
SELECT position, id, created_at, content FROM r
WHERE position > tessera_list_interactions.skip AND position <= tessera_list_interactions.skip + greatest(1, least(100, tessera_list_interactions.most))
"""
SQL_BATCH = """
CREATE OR REPLACE TEMPORARY FUNCTION tessera_batch_submit(ns STRING, docs STRING, on_duplicate STRING) RETURNS TABLE(doc_id BIGINT, outcome STRING, error STRING)
RETURN WITH g AS (SELECT inline(from_json(tessera_batch_submit.docs, 'array<struct<doc_id: bigint, text: string>>'))),
c AS (SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM g),
k AS (SELECT DISTINCT doc_id AS known FROM tessera_documents WHERE namespace_id = tessera_batch_submit.ns),
e AS (SELECT doc_id, known IS NOT NULL AS known, CASE WHEN total > 100 THEN 'too_many' WHEN n > 1 THEN 'duplicate_id' WHEN coalesce(text, '') = '' THEN 'empty' WHEN octet_length(text) > 10485760 THEN 'too_large' END AS error FROM c LEFT JOIN k ON doc_id = known)
SELECT doc_id, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN NOT known THEN 'accepted' WHEN tessera_batch_submit.on_duplicate = 'replace' THEN 'replaced' WHEN tessera_batch_submit.on_duplicate = 'skip' THEN 'skipped' ELSE 'rejected' END AS outcome,
  CASE WHEN error IS NULL AND known AND tessera_batch_submit.on_duplicate NOT IN ('replace', 'skip') THEN 'exists' ELSE error END AS error FROM e
"""


def register_sql(spark: SparkSession, engine: Engine, facts: DataFrame | None = None, interactions: DataFrame | None = None) -> None:
    """Views and table functions for SQL callers.

    Views: ``tessera_documents``, ``tessera_blocks``, ``tessera_status``, and the index that
    the search reads, ``tessera_postings`` and ``tessera_lengths``, written once. Functions:
    ``tessera_search(namespace, query, top_k)`` (full text and vectors, fused),
    ``tessera_list_documents(namespace)``, ``tessera_batch_submit(namespace, json,
    on_duplicate)``, ``tessera_chunks(text, size)``, and, where the tables are given,
    ``tessera_memory_search(user, now, top_k)`` over ``facts`` and
    ``tessera_list_interactions(user, text, limit, offset)``.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, chunk_text string, tokens int")
    class Chunks:
        def eval(self, body: str, size: int):
            for c in chunking.recursive_chunks(body or "", size, 0):
                yield c.index, c.text, c.tokens

    spark.udtf.register("tessera_chunks", Chunks)
    spark.udf.register("tessera_embed", embedding(engine.embedder))
    engine.documents.createOrReplaceTempView("tessera_documents")
    engine.blocks.createOrReplaceTempView("tessera_blocks")
    index = engine.index or retrieval.TextIndex.build(engine.blocks, "block_id", "content")
    lengths = index.lengths.withColumnRenamed("doc_id", "block_id").join(engine.blocks.select("block_id", "namespace_id"), "block_id")
    materialize(lengths, "sql-lengths").createOrReplaceTempView("tessera_lengths")
    named = index.postings.withColumnRenamed("doc_id", "block_id").join(lengths, "block_id")
    materialize(named, "sql-postings").createOrReplaceTempView("tessera_postings")
    counts = engine.blocks.groupBy("namespace_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("blocks"))
    counts.createOrReplaceTempView("tessera_status")
    spark.sql(SQL_SEARCH.format(floor=retrieval.IDF_FLOOR, up=retrieval.K1 + 1, k1=retrieval.K1, flat=1 - retrieval.B, b=retrieval.B, rrf=fusion.RRF_K))
    spark.sql(SQL_DOCUMENTS)
    spark.sql(SQL_BATCH)
    if facts is not None:
        facts.createOrReplaceTempView("tessera_facts")
        spark.sql(SQL_MEMORY.format(decay=scoring.DECAY_PER_DAY))
    if interactions is not None:
        interactions.createOrReplaceTempView("tessera_interactions")
        spark.sql(SQL_INTERACTIONS)


def sql_search(spark: SparkSession, engine: Engine, namespace: str, query: str, top_k: int = 10, rerank: bool = False) -> DataFrame:
    """One query over one namespace, as a SQL caller asks it."""
    asked = spark.createDataFrame([(0, filters.check_request(query, [namespace], top_k))], "query_id long, text string")
    return engine.search(asked, [namespace], Options(top_k=top_k, rerank=rerank)).drop("query_id").orderBy("position")
