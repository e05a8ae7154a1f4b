"""The engine from documents to answers, the model seams and the vector index."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import models, search
from tessera.operators import retrieval
from tessera.operators.ann import CellIndex
from tessera.operators.retrieval import knn
from tessera.plans import registry


@pytest.fixture(scope="module")
def engine(spark):
    docs = [
        (1, "a", "guides/setup.txt", "How to install the pump.\nConnect the hose to the valve.\nRetry the setup if the light is red."),
        (2, "a", "guides/refund.txt", "Refund policy.\nMoney is returned within ten days."),
        (3, "b", "faq/setup.txt", "How to install the pump.\nConnect the hose to the valve.\nRetry the setup if the light is red."),
        (4, "b", "faq/empty.txt", ""),
        (5, "b", "faq/other.txt", "Nothing about anything else here."),
    ]
    df = spark.createDataFrame(docs, "doc_id long, namespace_id string, filename string, text string")
    return search.Engine.ingest(df, reranker=models.OverlapReranker())


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_search_merges_namespaces(spark, engine):
    got = engine.search(asked(spark, "install the pump", "refund money")).orderBy("query_id", "position").collect()
    first = [r for r in got if r["query_id"] == 0][0]
    assert first["content"].startswith("How to install") and first["sources"] == "a/a/1/0,b/b/3/0"
    assert [r for r in got if r["query_id"] == 1][0]["doc_id"] == 2
    assert first["parent_text"] == first["content"]


@pytest.mark.parametrize("granularity", ["chunk", "hybrid"])
def test_hits_are_written_before_blocks_are_joined(spark, engine, granularity):
    found = engine.search(asked(spark, "install the pump"), options=search.Options(granularity=granularity))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0 and "MapInArrow" not in plan and "Window" not in plan and "Join" in plan


def test_postings_are_scored_where_they_stand(spark, tiny):
    """Both word routes hand on k rows a query and task; nothing of the index is joined or shuffled."""
    docs, asked_ = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{tiny}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    index = retrieval.TextIndex.build(docs)
    words = retrieval.query_terms(asked_, "query_id", "text").withColumn("qw", F.lit(1.0))
    weighed = index.postings.select(F.lit("a").alias("ns"), "term", F.col("doc_id").alias("child_id"), F.log1p(F.col("tf").cast("double")).alias("weight"))
    sparse = index.sparse(asked_, 5)
    assert {tuple(r) for r in sparse.collect()} == {tuple(r) for r in retrieval.sparse_dot(weighed, words, 5, None).collect()} and sparse.count() > 0
    for found in (sparse, index.bm25(asked_, 5, query_id="query_id")):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert index.bm25(asked_, 0, query_id="query_id").count() == 0 and index.bm25(asked_.limit(0), 5, query_id="query_id").count() == 0


def test_word_routes_with_ties_blocks_and_null_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "pump hose pump" if i % 2 else "valve") for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string").repartition(3)
    asked_ = spark.createDataFrame([(1, "pump"), (None, "hose"), (3, "none"), (4, "valve pump")], "item_id long, text string")
    index = retrieval.TextIndex.build(docs)
    want = {tuple(r) for r in retrieval.bm25(docs, asked_, 3).collect()}
    assert {r[:2] for r in want} >= {(1, 1), (1, 3), (1, 5), (None, 1)} and index.lengths.filter("len = 0").count() == 2
    for size in (1 << 20, 1):
        monkeypatch.setattr(retrieval, "SCORES", size)
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", size << 7)
        assert {tuple(r) for r in index.bm25(asked_, 3).collect()} == want


def test_parents_are_made_of_hits(spark, engine):
    hits = spark.createDataFrame([(1, "1/p0"), (5, "5/p9")], "doc_id long, parent_id string")
    assert [(r["parent_id"], r["parent_text"][:11]) for r in engine.parents(hits).collect()] == [("1/p0", "How to inst")]


@pytest.mark.parametrize("granularity", ["chunk", "doc", "hybrid"])
@pytest.mark.parametrize("route", ["simple", "complex"])
def test_granularity_and_route(spark, engine, granularity, route):
    got = engine.search(asked(spark, "refund policy"), ["a"], search.Options(top_k=1, granularity=granularity, route=route, rerank=True)).collect()
    assert [r["doc_id"] for r in got] == [2] and got[0]["namespace_id"] == "a"


def test_filters_and_rights(spark, engine):
    got = engine.search(asked(spark, "pump"), options=search.Options(filter={"source_path": {"like": "faq/%"}})).collect()
    assert {r["namespace_id"] for r in got} == {"b"}
    with pytest.raises(PermissionError):
        engine.search(asked(spark, "x"), ["a", "b"], readable=["a"])


def test_explain_and_sql(spark, engine):
    hits = {(r["route"], r["hits"]) for r in engine.explain(asked(spark, "refund")).collect()}
    assert {r for r, _ in hits} == {"dense", "fts5", "sparse"}
    search.register_sql(spark, engine)
    assert {tuple(r) for r in spark.sql("SELECT * FROM tessera_status").collect()} == {("a", 2, 2), ("b", 2, 2)}
    assert spark.sql("SELECT count(*) AS n FROM tessera_documents, LATERAL tessera_chunks(text, 8)").first()["n"] > 5
    assert search.sql_search(spark, engine, "a", "refund", 3).first()["doc_id"] == 2


def test_sql_functions(spark, engine):
    """Table functions by plain SQL, one call or one for each row of another table."""
    facts = spark.createDataFrame([(1, "u", "likes tea", "fact", "active", 0.5, 0), (2, "u", "met a friend", "event", "active", 0.9, 0), (3, "u", "old", "fact", "invalidated", 1.0, 0), (4, "v", "else", "fact", "active", 1.0, 0)], "block_id long, user_id string, content string, memory_type string, status string, raw_score double, created_s long")
    said = spark.createDataFrame([(i, "u", 100 + i, f"about 50% of x{i}") for i in range(5)] + [(9, "v", 1, "50% else")], "id long, user_id string, created_at long, content string")
    search.register_sql(spark, engine, facts, said)
    sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    got = sql("SELECT position, doc_id FROM tessera_search('a', 'refund money', 1)")
    assert got == [(1, 2)]
    each = sql("SELECT q.asked, t.doc_id FROM VALUES ('refund policy'), ('install the pump') AS q(asked), LATERAL tessera_search('a', q.asked, 1) t ORDER BY 1")
    assert each == [("install the pump", 1), ("refund policy", 2)]
    mine = engine.search(asked(spark, "refund money"), ["a"], search.Options(top_k=2, route="simple", granularity="chunk")).orderBy("position").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in mine] == [(d, round(s, 6)) for d, s in sql("SELECT doc_id, score FROM tessera_search('a', 'refund money', 2) ORDER BY position")]
    assert sorted(sql("SELECT doc_id, n_blocks FROM tessera_list_documents('b')")) == [(3, 1), (4, 0), (5, 1)]
    assert sql("SELECT block_id FROM tessera_memory_search('u', 8640000, 5) ORDER BY position") == [(1,), (2,)]
    assert sql("SELECT id FROM tessera_list_interactions('u', '50%', 2, 1) ORDER BY position") == [(3,), (2,)]
    batch = '[{"doc_id": 1, "text": "x"}, {"doc_id": 77, "text": "y"}, {"doc_id": 78, "text": ""}]'
    assert sorted(sql(f"SELECT * FROM tessera_batch_submit('a', '{batch}', 'skip')"), key=str) == [(1, "skipped", None), (77, "accepted", None), (78, "rejected", "empty")]
    assert ("a", 2, 2) in sql("SELECT * FROM tessera_status")


def test_labels_bring_two_more_routes(spark, engine):
    questions = spark.createDataFrame([("a/2/0", "when do I get my cash back"), ("a/1/0", "where does the hose go")], "child_id string, question string")
    contexts = spark.createDataFrame([("b/5/0", "An aside on sailing boats"), ("a/1/0", None)], "child_id string, context string")
    store = engine.labelled(questions, contexts)
    hits = {(r["query_id"], r["route"]) for r in store.explain(asked(spark, "when do I get my cash back", "sailing boats")).collect()}
    assert {(0, "hype"), (1, "contextualized"), (0, "dense")} <= hits
    ids = {r["child_id"]: r["block_id"] for r in engine.blocks.select("child_id", "block_id").collect()}
    found = store.chunk_hits(asked(spark, "when do I get my cash back", "sailing boats"), store.blocks, search.Options(top_k=1)).collect()
    routes = {(r["query_id"], r["block_id"]): r["routes"].split(",") for r in found}
    assert "hype" in routes[0, ids["a/2/0"]] and "contextualized" in routes[1, ids["b/5/0"]]


def test_ingest_chunks_once(spark, monkeypatch):
    """Chunks and blocks are files: no search runs the chunker or the embedder again."""
    docs = spark.createDataFrame([(i, "a", f"{i}.txt", f"text number {i} about pumps") for i in range(9)], "doc_id long, namespace_id string, filename string, text string")
    store = search.Engine.ingest(docs)
    plan = store.blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "chunk_units" not in plan and "Relation" in plan
    assert store.search(asked(spark, "pumps"), options=search.Options(top_k=3)).count() == 3


def test_knn_skips_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, []), (4, [None, 1.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r["query_id"], r["vec_id"]) for r in knn(df, df, 5).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert knn(df.limit(0), df, 5).count() == 0 and knn(df, df.limit(0), 5).count() == 0
    assert {r["vec_id"] for r in CellIndex(df.filter("vec_id < 5"), 2).search(df.filter("vec_id < 2"), 5, probe=2).collect()} == {0, 1}


def test_sparse_route_reads_whole_postings_of_every_namespace(spark):
    """A word of 1500 chunks of one namespace counts for the last one and for the chunk of a small namespace, too."""
    made = [(i, "big", "pump") for i in range(1499)] + [(1499, "big", "pump hose"), (5000, "small", "pump valve")]
    blocks = spark.createDataFrame(made, "block_id long, namespace_id string, content string").withColumn("embedding", models.embedding(models.HashingEmbedder())(F.col("content")))
    store = search.Engine(blocks, blocks, blocks)

    def sparse(query, **options):
        hits = store.chunk_hits(asked(spark, query), blocks, search.Options(top_k=1, **options)).collect()
        return {r["block_id"] for r in hits if "sparse" in r["routes"].split(",")}

    assert 1499 in sparse("pump hose") and 5000 in sparse("pump valve")
    assert 1499 not in sparse("pump hose", posting_cap=1000) and 5000 in sparse("pump valve", posting_cap=1000)


def test_posting_cap_is_per_namespace(spark):
    made = [(i, "a", "pump " * 3) for i in range(5)] + [(9, "b", "pump hose")]
    blocks = spark.createDataFrame(made, "block_id long, namespace_id string, content string")
    terms = retrieval.postings(blocks, "block_id", "content", ("namespace_id",)).select(F.col("namespace_id").alias("ns"), "term", F.col("id").alias("child_id"), F.col("tf").cast("double").alias("weight"))
    words = spark.createDataFrame([(0, "pump", 1.0)], "query_id long, term string, qw double")
    assert {r["child_id"] for r in retrieval.sparse_dot(terms, words, 10, 2).collect()} == {0, 1, 9}
    assert {r["child_id"] for r in retrieval.sparse_dot(terms, words, 10, None).collect()} == {0, 1, 2, 3, 4, 9}


def test_chat(spark):
    facts = spark.createDataFrame([(i, "u" if i % 2 else "v", "active" if i % 3 else "invalidated", i) for i in range(9)], "block_id long, user_id string, status string, created_s long")
    assert [r["block_id"] for r in search.chat_facts(facts, "u", 2).collect()] == [7, 5]


def test_cell_index(spark, small):
    data = spark.read.parquet(f"{small}/embeddings.parquet")
    queries = data.filter("vec_id < 30")
    exact = {(r["query_id"], r["vec_id"]) for r in knn(data, queries, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in CellIndex(data).search(queries, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    every = {(r["query_id"], r["vec_id"]) for r in CellIndex(data).search(queries, 10, probe=16).collect()}
    assert every == exact


def test_vector_queries_ask_every_hundredth_row(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 64))
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {n: registry.queries()[n](spark, str(tmp_path)).collect() for n in ("dense_knn_l2", "dense_knn_cosine", "dense_knn_cells_probed")}
    for got in found.values():
        assert {r["query_id"] for r in got} == set(range(0, 4000, 100)) and len(got) == 400
    brute = {(i, int(j)) for i in range(0, 4000, 100) for j in np.argsort(((v - v[i]) ** 2).sum(1))[:10]}
    assert {(r["query_id"], r["vec_id"]) for r in found["dense_knn_l2"]} == brute


def test_production_probe_prunes_and_recalls(spark):
    big = "/root/testdata/sf0.1"
    exact = {(r["query_id"], r["vec_id"]) for r in registry.queries()["dense_knn_l2"](spark, big).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in registry.queries()["dense_knn_cells_probed"](spark, big).collect()}
    assert 0.9 <= len(exact & found) / len(exact) < 1 and len(exact) == 200


def test_wordpiece():
    t = models.WordPiece(["[UNK]", "un", "##aff", "##able", "hello", ",", "你", "cafe"])
    assert t.encode("Unaffable, HELLO 你 café xyz") == [1, 2, 3, 5, 4, 6, 7, 0]


def test_model_answers():
    fields = {"summary": "", "level": 0}
    assert models.parse_batch_answer("oops", 2, fields) == [(3, fields)] * 2
    got = models.parse_batch_answer('x [{"index": "0", "summary": "a", "level": 2}, {"index": 2, "summary": "c\\d"}]', 3, fields)
    assert got == [(0, {"summary": "a", "level": 2}), (2, fields), (1, {"summary": "c\\d", "level": 0})]
    assert models.resolve_config({"a": 1, "b": 2, "c": 3}, '{"a": 5, "c": 9}', {"b": 7, "z": 1}, {"b"}, {"c"}) == {"a": 5, "b": 7, "c": 3}
    with pytest.raises(ValueError):
        models.resolve_config({}, "[]", None, set())


def test_embedding_column(spark):
    v = spark.range(1).select(models.embedding(models.HashingEmbedder(8))(F.lit("a b a")).alias("v")).first()["v"]
    assert len(v) == 8 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)


def test_circuit_breaker():
    now, calls, slept = [0.0], [], []
    breaker = models.CircuitBreaker(clock=lambda: now[0], sleep=slept.append)

    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        breaker.call(fails)
    assert len(calls) == 3 and slept == [0.05, 0.1]
    with pytest.raises(models.CircuitOpen):
        breaker.call(fails)
    now[0] = 31.0
    with pytest.raises(OSError):
        breaker.call(fails)
    assert len(calls) == 4
    now[0] = 62.0
    assert breaker.call(lambda: 5) == 5 and breaker.call(lambda: 6) == 6


def test_piece_tokenizer():
    import public_tokenizers
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    assert models.PieceTokenizer(file).encode("Hello world") == sentencepiece.SentencePieceProcessor(model_file=file).encode("Hello world")


def test_text_index_equals_the_direct_route(spark, tiny):
    """The same answers from written postings, over all documents and among some of them."""
    docs, asked_ = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    index = retrieval.TextIndex.build(docs)
    assert "MapInArrow" not in index.postings._jdf.queryExecution().optimizedPlan().toString()
    some = docs.filter("doc_id % 3 = 0")
    for among, rows in ((None, docs), (some.select("doc_id"), some)):
        mine, theirs = index.bm25(asked_, 5, among), retrieval.bm25(rows, asked_, 5)
        assert {tuple(r) for r in mine.collect()} == {tuple(r) for r in theirs.collect()} and mine.count() > 0
