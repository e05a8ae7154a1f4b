"""Queries of the retrieval routes and of rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.operators import fusion, retrieval
from tessera.plans.registry import query
from tessera.runtime import table

BM25_CTES = """
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
l AS (SELECT doc_id, len(w) AS len FROM w),
st AS (SELECT count(*) AS n, avg(len) AS m FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (
  SELECT q.query_id, p.doc_id,
         round(sum(greatest(1e-6, ln((st.n - df.df + 0.5) / (df.df + 0.5))) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / st.m))), 6) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN l ON l.doc_id = p.doc_id CROSS JOIN st GROUP BY ALL),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= {k})
"""


def bm25(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), k)


@query("bm25_topk", f"WITH {BM25_CTES.replace('{k}', '10')} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25(spark, d)


@query("bm25_indexed", f"WITH {BM25_CTES.replace('{k}', '10')} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same answers from an index that is written first."""
    return retrieval.TextIndex.build(table(spark, d, "documents")).bm25(table(spark, d, "benchmark"), 10)


@query(
    "bm25_field_weighted",
    r"""
WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
f AS (SELECT doc_id, 2.0 AS weight, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[\p{L}\p{N}]+') AS w FROM documents
      UNION ALL SELECT doc_id, 1.0, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM documents
      UNION ALL SELECT doc_id, 1.5, regexp_extract_all(lower(source), '[\p{L}\p{N}]+') FROM documents),
l AS (SELECT doc_id, sum(len(w)) AS len FROM f GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(len) AS m FROM l),
p AS (SELECT doc_id, term, sum(weight) AS tf FROM (SELECT doc_id, weight, unnest(w) AS term FROM f) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.query_id, p.doc_id,
         round(sum(greatest(1e-6, ln((st.n - df.df + 0.5) / (df.df + 0.5))) * CAST(p.tf AS DOUBLE) * 2.2 / (CAST(p.tf AS DOUBLE) + 1.2 * (0.25 + 0.75 * l.len / st.m))), 6) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN l ON l.doc_id = p.doc_id CROSS JOIN st GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
""",
)
def bm25_field_weighted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("title", F.split("text", "\n")[0])
    return retrieval.field_bm25(docs, {"title": 2.0, "text": 1.0, "source": 1.5}, table(spark, d, "benchmark"), 10)


def _knn_sql(score: str, asked: str = "q.vec_id % 100 = 0") -> str:
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round({score}, 6) AS score FROM v q JOIN v ON {asked})
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
"""


L2 = "1 / (1 + list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
COSINE = "list_cosine_similarity(q.e, v.e)"
L2_SQL = _knn_sql(L2)
#: The query set, which grows with the table.
HUNDREDTHS = "vec_id % 100 = 0"


@query("dense_knn_l2", L2_SQL)
def dense_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.knn(e, e.filter(HUNDREDTHS), 10)


@query("dense_knn_cosine", _knn_sql(COSINE))
def dense_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.knn(e, e.filter(HUNDREDTHS), 10, "cosine")


@query(
    "vector_functions",
    """
SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm2,
       round(1 / (1 + abs(embedding[1]::DOUBLE)), 6) AS sim, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) = 0 AS bad FROM embeddings
""",
)
def vector_functions(spark: SparkSession, d: str) -> DataFrame:
    e, v = table(spark, d, "embeddings"), F.col("embedding")
    return e.select("vec_id", F.round(scoring.dot(v, v), 6).alias("norm2"), F.round(scoring.similarity_of_distance(F.abs(v[0].cast("double"))), 6).alias("sim"), scoring.bad_vector(v).alias("bad"))


SPARSE = r"""
w AS (SELECT source AS ns, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
x AS (SELECT ns, term, CAST(doc_id AS VARCHAR) AS child_id, round(ln(1 + count(*)), 6) AS weight FROM w GROUP BY ALL),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY ns, term ORDER BY weight DESC, child_id) <= {cap})
"""


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    p = retrieval.postings(table(spark, d, "documents"), also=("source",))
    return p.select(F.col("source").alias("ns"), "term", F.col("id").cast("string").alias("child_id"), F.round(F.log(1 + F.col("tf")), 6).alias("weight"))


@query(
    "sparse_dot_topk",
    f"WITH {SPARSE.replace('{cap}', '1000')}, q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark), "
    "s AS (SELECT query_id, child_id, round(sum(2.0 * weight), 6) AS score FROM q JOIN y USING (term) GROUP BY ALL) "
    "SELECT query_id, child_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10",
)
def sparse_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = retrieval.query_terms(table(spark, d, "benchmark"), "item_id", "text").withColumn("qw", F.lit(2.0))
    return retrieval.sparse_dot(_sparse(spark, d), asked, 10)


@query("posting_list_cap", f"WITH {SPARSE.replace('{cap}', '3')} SELECT ns, term, child_id, weight FROM y")
def posting_list_cap(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.capped_postings(_sparse(spark, d), 3).select("ns", "term", "child_id", "weight")


@query(
    "sparse_index_upsert",
    r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
x AS (SELECT CAST(doc_id AS VARCHAR) AS child_id, term, count(*) AS weight FROM w GROUP BY ALL)
SELECT child_id, CAST(count(*) AS BIGINT) AS terms, CAST(sum(weight) AS BIGINT) AS weight FROM (
  SELECT * FROM x WHERE CAST(child_id AS BIGINT) % 3 <> 0
  UNION ALL SELECT CAST(doc_id AS VARCHAR), lang, 7 FROM documents WHERE doc_id % 6 = 0) GROUP BY child_id
""",
)
def sparse_index_upsert(spark: SparkSession, d: str) -> DataFrame:
    index = retrieval.postings(table(spark, d, "documents")).select(F.col("id").cast("string").alias("child_id"), "term", F.col("tf").alias("weight"))
    docs = table(spark, d, "documents").filter("doc_id % 3 = 0")
    changed = docs.select(F.col("doc_id").cast("string").alias("child_id"), F.when(F.col("doc_id") % 6 == 0, F.col("lang")).alias("term"), F.lit(7).cast("long").alias("weight"))
    return retrieval.upsert(index, changed).groupBy("child_id").agg(F.count("*").alias("terms"), F.sum("weight").alias("weight"))


# --- fusion -----------------------------------------------------------------------------

#: Ranked lists of every query: BM25, and the newest documents of the first hit's source.
LISTS = f"""{BM25_CTES.replace('{k}', '20')},
x AS (SELECT query_id, doc_id AS id, 'bm25' AS route, rank, score AS raw_score FROM bm),
y AS (SELECT query_id, id, 'vector' AS route, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id % 7, id) AS INTEGER) AS rank, round(1 / (1 + id % 7), 6) AS raw_score FROM x WHERE id % 3 <> 0),
ls AS (SELECT * FROM x UNION ALL SELECT * FROM y)
"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    x = bm25(spark, d, 20).select("query_id", F.col("doc_id").alias("id"), F.lit("bm25").alias("route"), "rank", F.col("score").alias("raw_score"))
    order = Window.partitionBy("query_id").orderBy(F.col("id") % 7, "id")
    y = x.filter("id % 3 <> 0").select("query_id", "id", F.lit("vector").alias("route"), F.row_number().over(order).alias("rank"), F.round(1 / (1 + F.col("id") % 7), 6).alias("raw_score"))
    return x.unionByName(y)


def _rrf_sql(base: int) -> str:
    return f"""WITH {LISTS}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / ({60 + base - 1} + rank)), 9) AS score, string_agg(DISTINCT route, ',' ORDER BY route) AS routes FROM ls GROUP BY query_id, id)
SELECT query_id, id, score, routes, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS position FROM f"""


@query("rrf_two_route_base1", _rrf_sql(1))
def rrf_two_route_base1(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_lists(spark, d))


@query("rrf_five_path_base0", _rrf_sql(0))
def rrf_five_path_base0(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_lists(spark, d), rank_base=0)


@query(
    "rrf_route_flags",
    f"""WITH {LISTS}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CAST(bit_or(CASE route WHEN 'vector' THEN 1 ELSE 2 END) AS INTEGER) AS hit_routes,
  max(raw_score) FILTER (route = 'vector') AS vector_score, max(raw_score) FILTER (route = 'bm25') AS bm25_score FROM ls GROUP BY query_id, id)
SELECT *, CAST(bit_count(hit_routes) AS INTEGER) AS n_routes, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS position FROM f""",
)
def rrf_route_flags(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf_with_flags(_lists(spark, d))


VARIANTS = f"""{LISTS}, vs AS (SELECT query_id, CASE route WHEN 'bm25' THEN 0 ELSE 1 END AS variant, id, rank, raw_score FROM ls),
wf AS (SELECT query_id, id, round(sum(CASE variant WHEN 0 THEN 1.7::DOUBLE ELSE 0.5::DOUBLE END / (60 + rank)), 9) AS score, max(raw_score) AS raw_score,
  CAST(min(variant * 1000000 + rank) AS INTEGER) AS first_seen FROM vs GROUP BY query_id, id),
wp AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS INTEGER) AS position FROM wf)"""


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).withColumn("variant", F.when(F.col("route") == "bm25", 0).otherwise(1))


@query("rrf_weighted", f"WITH {VARIANTS} SELECT * FROM wp")
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted_fusion(_variants(spark, d))


@query(
    "rrf_weighted_anchor",
    f"""WITH {VARIANTS}, h AS (SELECT query_id, max(raw_score) FILTER (rank = 1) AS a, max(raw_score) FILTER (rank = 2) AS b, max(raw_score) FILTER (rank = 3) AS c FROM vs WHERE variant = 0 GROUP BY 1),
n AS (SELECT query_id, CASE WHEN a <= 0 OR b IS NULL THEN 1 WHEN coalesce(c, b) >= 0.45 * a THEN 3 WHEN b >= 0.35 * a THEN 2 ELSE 1 END AS anchors FROM h),
an AS (SELECT query_id, id, rank AS anchor FROM vs JOIN n USING (query_id) WHERE variant = 0 AND rank <= anchors)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY anchor IS NULL, anchor, position) AS INTEGER) AS final FROM wp LEFT JOIN an USING (query_id, id)""",
)
def rrf_weighted_anchor(spark: SparkSession, d: str) -> DataFrame:
    rows = _variants(spark, d)
    return fusion.with_anchors(fusion.weighted_fusion(rows), rows.filter("variant = 0")).select("query_id", "id", "score", "final")


@query(
    "hype_fusion",
    f"""WITH {LISTS}, u AS (SELECT query_id, id AS child_id, id % 50 AS parent_id, rank - 1 AS rank, CASE route WHEN 'vector' THEN 'q' || id END AS question, raw_score AS qs FROM ls),
f AS (SELECT query_id, child_id, parent_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(question) AS question FROM u GROUP BY ALL)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, child_id) = 1""",
)
def hype_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _lists(spark, d).select("query_id", F.col("id").alias("child_id"), (F.col("id") % 50).alias("parent_id"), (F.col("rank") - 1).alias("rank"), "route", F.col("raw_score").alias("score"))
    asked = rows.filter("route = 'vector'").withColumn("question_text", F.concat(F.lit("q"), F.col("child_id")))
    return fusion.hype_fusion(rows.filter("route = 'bm25'"), asked)


@query(
    "doc_discovery_fusion",
    f"""WITH {LISTS}, u AS (SELECT query_id, id AS doc_id, rank - 1 AS rank, CASE route WHEN 'vector' THEN 's' || id END AS s, CASE route WHEN 'bm25' THEN 'd' || id END AS dd FROM ls),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, coalesce(max(s), max(dd)) AS title FROM u GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS position FROM f""",
)
def doc_discovery_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = _lists(spark, d).select("query_id", F.col("id").alias("doc_id"), (F.col("rank") - 1).alias("rank"), "route")
    titled = lambda route, p: rows.filter(F.col("route") == route).withColumn("title", F.concat(F.lit(p), F.col("doc_id")))
    return fusion.discovery_fusion(titled("vector", "s"), titled("bm25", "d"))


@query(
    "hybrid_by_doc",
    f"""WITH {LISTS}, c AS (SELECT query_id, id % 40 AS doc_id, id AS chunk_id, rank FROM ls WHERE route = 'bm25'),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, chunk_id) = 1),
r AS (SELECT query_id, doc_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) - 1 AS rank FROM b),
u AS (SELECT query_id, doc_id, chunk_id, rank FROM r UNION ALL SELECT query_id, id, NULL, rank - 1 FROM ls WHERE route = 'vector'),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(chunk_id) AS chunk_id FROM u GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS position FROM f""",
)
def hybrid_by_doc(spark: SparkSession, d: str) -> DataFrame:
    rows = _lists(spark, d)
    chunks = rows.filter("route = 'bm25'").select("query_id", (F.col("id") % 40).alias("doc_id"), F.col("id").alias("chunk_id"), "rank")
    docs = rows.filter("route = 'vector'").select("query_id", F.col("id").alias("doc_id"), (F.col("rank") - 1).alias("rank"))
    return fusion.hybrid_by_document(chunks, docs)


@query(
    "rerank_blend_quality",
    """
SELECT d.doc_id, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 0.0::DOUBLE ELSE coalesce(CAST(l.quality AS DOUBLE), 0.5) END AS quality,
  round((0.7::DOUBLE * (d.doc_id % 10) / 10 + 0.3::DOUBLE / (60 + d.doc_id % 20)) * (1 + 0.2::DOUBLE * (CASE WHEN coalesce(l.toxic, 0) = 1 THEN 0.0 ELSE coalesce(CAST(l.quality AS DOUBLE), 0.5) END - 0.5)), 6) AS score
FROM documents d LEFT JOIN labels l USING (doc_id)
""",
)
def rerank_blend_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    quality = scoring.effective_quality(F.coalesce("toxic", F.lit(0)) == 1, F.col("quality").cast("double"), F.lit(0.5))
    blended = scoring.blend(F.col("doc_id") % 10 / 10, 1 / (60 + F.col("doc_id") % 20))
    return docs.select("doc_id", quality.alias("quality"), F.round(scoring.with_quality(blended, quality), 6).alias("score"))


@query(
    "semantic_level_score",
    """
SELECT doc_id, CAST(least(doc_id % 6, 4) AS INTEGER) AS level, [0.2::DOUBLE, 0.4, 0.6, 0.8, 1.0][1 + least(doc_id % 6, 4)] AS score,
  CAST([60, 300, 900, 3600, 21600][1 + least(4, doc_id % 9)] AS INTEGER) AS retry_s,
  greatest(exp(-0.01::DOUBLE * (doc_id % 400)), 0.1::DOUBLE) AS decay
FROM documents
""",
)
def semantic_level_score(spark: SparkSession, d: str) -> DataFrame:
    level = F.least(F.col("doc_id") % 6, F.lit(4)).cast("int")
    return table(spark, d, "documents").select(
        "doc_id", level.alias("level"), scoring.level_score(level).alias("score"), scoring.retry_delay((F.col("doc_id") % 9).cast("int")).alias("retry_s"), scoring.decay(F.col("doc_id") % 400, floor=0.1).alias("decay")
    )


ITEMS = """i AS (SELECT doc_id % 5 AS query_id, source AS namespace_id, CAST(doc_id AS VARCHAR) AS child_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE sha256(text) END AS content_hash,
  round(CAST((doc_id * 37) % 101 AS DOUBLE) / 101, 6) AS score, doc_id AS "at" FROM documents)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        (F.col("doc_id") % 5).alias("query_id"), F.col("source").alias("namespace_id"), F.col("doc_id").cast("string").alias("child_id"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.sha2("text", 256)).alias("content_hash"), F.round(((F.col("doc_id") * 37) % 101).cast("double") / 101, 6).alias("score"), F.col("doc_id").alias("at"),
    )


def _cross_sql(k: int | None) -> str:
    return f"""WITH {ITEMS}, g AS (SELECT *, CASE WHEN content_hash = '' THEN 'own/' || namespace_id || '/' || child_id ELSE content_hash END AS g FROM i),
m AS (SELECT query_id, g, string_agg(DISTINCT namespace_id || '/' || child_id, ',' ORDER BY namespace_id || '/' || child_id) AS sources, count(*) AS n_sources FROM g GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, "at") = 1)
SELECT query_id, namespace_id, child_id, score, "at", sources, CAST(n_sources AS BIGINT) AS n_sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "at") AS INTEGER) AS position
FROM b JOIN m USING (query_id, g) {f"QUALIFY position <= {k}" if k else ""}"""


@query("cross_ns_dedup", _cross_sql(None))
def cross_ns_dedup(spark: SparkSession, d: str) -> DataFrame:
    return fusion.cross_namespace(_items(spark, d), None)


@query("scatter_gather_dedup", _cross_sql(10))
def scatter_gather_dedup(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    names = [r[0] for r in items.select("namespace_id").distinct().orderBy("namespace_id").collect()]
    found, _ = fusion.scatter(names, lambda n: items.filter(F.col("namespace_id") == n))
    return fusion.cross_namespace(found, 10)


@query("scatter_coverage", "SELECT source AS namespace_id, CAST(count(*) AS BIGINT) AS hits, round((SELECT count(DISTINCT source) FROM documents) / ((SELECT count(DISTINCT source) FROM documents) + 1.0::DOUBLE), 6) AS coverage FROM documents WHERE source IS NOT NULL GROUP BY 1")
def scatter_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every namespace asked by itself, and the share that answered: one more doesn't exist."""
    docs = table(spark, d, "documents")
    names = [r[0] for r in docs.filter(F.col("source").isNotNull()).select("source").distinct().orderBy("source").collect()]

    def ask(name: str) -> DataFrame:
        if name not in names:
            raise LookupError(name)
        return docs.filter(F.col("source") == name).select("doc_id")

    found, failed = fusion.scatter([*names, "nowhere"], ask)
    coverage = round((len(names) + 1 - len(failed)) / (len(names) + 1), 6)
    return found.groupBy("namespace_id").agg(F.count("*").alias("hits")).withColumn("coverage", F.lit(coverage))


@query(
    "child_parent_top3",
    """
WITH h AS (SELECT doc_id % 3 AS query_id, CAST(doc_id AS VARCHAR) AS child_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE source END AS parent_id, round(CAST((doc_id * 53) % 97 AS DOUBLE) / 97, 6) AS score FROM documents),
g AS (SELECT *, CASE WHEN parent_id = '' THEN 'flat:' || child_id ELSE parent_id END AS group_key FROM h),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, group_key ORDER BY score DESC, child_id) AS INTEGER) AS child_position, max(score) OVER (PARTITION BY query_id, group_key) AS top FROM g)
SELECT query_id, child_id, group_key, score, child_position, child_position = 1 AS is_primary, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY top DESC, CASE WHEN parent_id = '' THEN child_id ELSE parent_id END, group_key) AS INTEGER) AS group_rank FROM r WHERE child_position <= 3
""",
)
def child_parent_top3(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select(
        (F.col("doc_id") % 3).alias("query_id"), F.col("doc_id").cast("string").alias("child_id"), F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("source")).alias("parent_id"),
        F.round(((F.col("doc_id") * 53) % 97).cast("double") / 97, 6).alias("score"),
    )
    return fusion.children_per_parent(hits).drop("parent_id")


CRAG = f"""{BM25_CTES.replace('{k}', '12')}, sc AS (SELECT query_id, doc_id, round(score / 100, 6) AS score FROM bm),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM sc),
sg AS (SELECT query_id, max(score) AS top1, median(score) AS med, stddev_pop(score) AS sd, avg(CASE WHEN score >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END) AS hr,
  max(score) - max(score) FILTER (n = 5) AS gap, count(*) AS n FROM rk GROUP BY 1),
cf AS (SELECT *, greatest(0, least(1, 0.7::DOUBLE * top1 + 0.3::DOUBLE * hr)) AS confidence FROM sg),
vd AS (SELECT *, CASE WHEN confidence >= 0.7 THEN 'correct' WHEN confidence < 0.3 THEN 'incorrect' ELSE 'ambiguous' END AS verdict FROM cf)"""


def _crag(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scored = bm25(spark, d, 12).select("query_id", "doc_id", F.round(F.col("score") / 100, 6).alias("score"))
    return scored, fusion.crag_signals(scored)


@query(
    "crag_signals",
    f"WITH {CRAG} SELECT query_id, round(top1, 6) AS top1, round(med, 6) AS median, round(sd, 6) AS std, round(hr, 6) AS high_ratio, round(gap, 6) AS gap, CAST(n AS BIGINT) AS n, round(confidence, 6) AS confidence, verdict FROM vd",
)
def crag_signals(spark: SparkSession, d: str) -> DataFrame:
    found = _crag(spark, d)[1]
    return found.withColumns({c: F.round(c, 6) for c in ("top1", "median", "std", "high_ratio", "gap", "confidence")})


@query(
    "crag_halve",
    f"WITH {CRAG} SELECT query_id, doc_id, sc.score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc.score DESC, doc_id) AS INTEGER) AS rank, verdict FROM sc JOIN vd USING (query_id) "
    "QUALIFY rank <= CASE verdict WHEN 'ambiguous' THEN ceil(n / 2.0) ELSE n END",
)
def crag_halve(spark: SparkSession, d: str) -> DataFrame:
    return fusion.crag_keep(*_crag(spark, d)).select("query_id", "doc_id", "score", "rank", "verdict")


@query("variant_policy", f"WITH {CRAG} SELECT query_id, max(score) FILTER (n = 1) AS first, max(score) FILTER (n = 2) AS second, NOT coalesce(count(*) >= 2 AND first > second AND first - second >= 0.01, false) AS expand FROM rk GROUP BY 1")
def variant_policy(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fusion.wants_variants(_crag(spark, d)[0].withColumn("rank", F.row_number().over(order)), 0.01)


@query(
    "degradation_level",
    "SELECT conv_id, turn, CAST(CASE WHEN conv_id % 2 = 0 AND turn % 2 = 0 AND conv_id % 3 = 0 THEN 0 WHEN conv_id % 2 = 0 AND turn % 2 = 0 THEN 1 WHEN conv_id % 2 = 0 OR turn % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS level FROM conversations",
)
def degradation_level(spark: SparkSession, d: str) -> DataFrame:
    level = fusion.degradation(F.col("conv_id") % 2 == 0, F.col("turn") % 2 == 0, F.col("conv_id") % 3 == 0)
    return table(spark, d, "conversations").select("conv_id", "turn", level.cast("int").alias("level"))


@query(
    "intent_keyword",
    "SELECT conv_id, turn, CASE WHEN list_bool_or(list_transform(["
    + ", ".join(f"'{w}'" for w in text.SQL_WORDS)
    + "], lambda w: contains(upper(text), w))) OR list_bool_or(list_transform(["
    + ", ".join(f"'{w}'" for w in text.SQL_WORDS_CJK)
    + "], lambda w: contains(text, w))) THEN 'sql' ELSE 'semantic' END AS intent FROM conversations",
)
def intent_keyword(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.sql_intent(F.col("text")).alias("intent"))


CHAT_SQL = r"regexp_replace(trim(lower(text), ' ' || chr(9) || chr(10) || chr(12) || chr(13) || chr(11)), '[.!?, \t\r\n]+$', '') IN (" + ", ".join("'" + p.replace("'", "''") + "'" for p in text.CHAT_PHRASES) + ")"


@query(
    "chat_route",
    f"""
WITH c AS (SELECT conv_id, turn, {CHAT_SQL} AS is_chat, CASE WHEN turn % 11 = 7 THEN 'simple' ELSE '' END AS override, CASE WHEN conv_id % 13 = 5 THEN 'complex' ELSE '' END AS forced, conv_id % 17 <> 3 AS available,
  CASE turn % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'simple' WHEN 2 THEN 'complex' END AS predicted, (conv_id % 10) / 10.0::DOUBLE AS confidence FROM conversations)
SELECT conv_id, turn, is_chat,
  CASE WHEN override <> '' THEN override WHEN forced <> '' THEN forced WHEN is_chat THEN 'chat' WHEN NOT available OR predicted IS NULL OR confidence < 0.5 OR predicted = 'chat' THEN 'complex' ELSE predicted END AS path,
  CASE WHEN override <> '' THEN 'override' WHEN forced <> '' THEN 'namespace' WHEN is_chat THEN 'chat_rule' WHEN NOT available THEN 'unavailable' WHEN predicted IS NULL THEN 'inference_failed'
       WHEN confidence < 0.5 THEN 'low_confidence' WHEN predicted = 'chat' THEN 'chat_demoted' ELSE 'predicted' END AS why
FROM c
""",
)
def chat_route(spark: SparkSession, d: str) -> DataFrame:
    """Every turn's route by all eight reasons; tests hold the columns against ``route_decision``."""
    turn, conv = F.col("turn"), F.col("conv_id")
    override, forced = F.when(turn % 11 == 7, "simple").otherwise(""), F.when(conv % 13 == 5, "complex").otherwise("")
    predicted = F.when(turn % 4 == 0, "chat").when(turn % 4 == 1, "simple").when(turn % 4 == 2, "complex")
    chat = text.is_chat(F.col("text"))
    path, why = fusion.routed(override, forced, chat, conv % 17 != 3, predicted, (conv % 10) / 10.0)
    return table(spark, d, "conversations").select("conv_id", "turn", chat.alias("is_chat"), path.alias("path"), why.alias("why"))
