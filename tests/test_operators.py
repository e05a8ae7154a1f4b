"""Operators on small worked cases."""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import catalog, chunking, cleaning, filters, fusion, memory, retrieval
from tessera.plans import registry
from tessera.sources import codecs, readers
from tessera.streaming import events


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def ranked(spark, **routes):
    data = [(1, route, i, n + 1, s) for route, hits in routes.items() for n, (i, s) in enumerate(hits)]
    return spark.createDataFrame(data, "query_id long, route string, id long, rank int, raw_score double")


def test_two_route_fusion(spark):
    lists = ranked(spark, vector=[(1, 0.95), (2, 0.87), (3, 0.72)], bm25=[(2, 12.3), (4, 9.1), (1, 7.5)])
    got = fusion.rrf_with_flags(lists).orderBy("position").collect()
    assert [r["id"] for r in got] == [2, 1, 4, 3]
    assert [r["score"] for r in got] == pytest.approx([1 / 62 + 1 / 61, 1 / 61 + 1 / 63, 1 / 62, 1 / 63], abs=1e-9)
    assert [r["hit_routes"] for r in got] == [3, 3, 2, 1]


def test_five_path_fusion(spark):
    data = [(1, "dense", "x", 1), (1, "dense", "y", 2), (1, "sparse", "y", 1), (1, "sparse", "x", 2), (1, "fts5", "x", 1)]
    lists = spark.createDataFrame(data, "query_id long, route string, id string, rank int")
    got = fusion.rrf(lists, rank_base=0).orderBy("position").collect()
    assert [(r["id"], r["routes"]) for r in got] == [("x", "dense,fts5,sparse"), ("y", "dense,sparse")]
    assert [r["score"] for r in got] == pytest.approx([1 / 60 + 1 / 61 + 1 / 60, 1 / 61 + 1 / 60], abs=1e-9)
    assert rows(fusion.rrf(lists, k=0, rank_base=0).orderBy("position"), "id") == [("x",), ("y",)]


def test_fusion_ignores_order(spark):
    lists = ranked(spark, vector=[(i, 1.0) for i in range(20)], bm25=[(i * 7 % 20, 1.0) for i in range(20)])
    a = rows(fusion.rrf(lists).orderBy("position"), "id", "score")
    assert a == rows(fusion.rrf(lists.repartition(5)).orderBy("position"), "id", "score")


def test_anchors(spark):
    counts = spark.createDataFrame([(1.0, 0.5, 0.45), (1.0, 0.35, 0.4), (1.0, 0.3, 0.2), (1.0, 0.5, None), (1.0, None, None), (0.0, 0.0, 0.0)], "a double, b double, c double")
    assert rows(counts.select(fusion.anchor_count(F.col("a"), F.col("b"), F.col("c")).alias("n")), "n") == [(3,), (2,), (1,), (3,), (1,), (1,)]


def test_sparse_dot(spark):
    index = spark.createDataFrame([("n", t, c, w) for c, v in {"c1": {1: 0.6, 2: 0.4, 3: 0.9}, "c2": {9: 1.0}}.items() for t, w in v.items()], "ns string, term int, child_id string, weight double")
    asked = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.5)], "query_id long, term int, qw double")
    assert rows(retrieval.sparse_dot(index, asked), "child_id", "score") == [("c1", 0.5)]
    gone = spark.createDataFrame([("n", None, "c1", None)], index.schema)
    assert rows(retrieval.upsert(index, gone), "child_id") == [("c2",)]


def test_knn_by_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(200)], "vec_id long, embedding array<float>")
    asked = data.filter("vec_id < 15")
    for metric in ("l2", "cosine", "dot"):
        whole = sorted(rows(retrieval.knn(data, asked, 5, metric), "query_id", "rank", "vec_id", "score"))
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 200)
        assert sorted(rows(retrieval.knn(data, asked, 5, metric), "query_id", "rank", "vec_id", "score")) == whole
        monkeypatch.undo()


def test_cross_namespace(spark):
    items = [("a", "1", "h", 0.5), ("b", "2", "h", 0.9), ("c", "3", "", 0.9), ("c", "4", "", 0.1), ("d", "5", "h", 0.9), ("e", "6", None, 0.2)]
    df = spark.createDataFrame([(1, *x, i) for i, x in enumerate(items)], "query_id long, namespace_id string, child_id string, content_hash string, score double, at long")
    got = fusion.cross_namespace(df, 10).orderBy("position")
    assert rows(got, "child_id", "sources") == [("2", "a/1,b/2,d/5"), ("3", "c/3"), ("6", "e/6"), ("4", "c/4")]


def test_cross_ns_dedup_keeps_every_group(spark, tmp_path):
    n = 600_000
    spark.range(n).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["cross_ns_dedup"](spark, str(tmp_path))
    per_query = got.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("a"), F.max("position").alias("b"))
    assert sorted(rows(per_query, "query_id", "n", "d", "a", "b")) == [(i, n // 5, n // 5, 1, n // 5) for i in range(5)]


def test_cross_namespace_without_limit_is_the_limited_one(spark):
    items = [(q, f"n{i % 4}", str(i), ["", "h1", "h2", "h3", None][i % 5] if i % 3 else f"g{i}", (i * 7 % 10) / 10, i) for q in (1, 2, None) for i in range(200)]
    df = spark.createDataFrame(items, "query_id long, namespace_id string, child_id string, content_hash string, score double, at long")
    columns = ("query_id", "position", "namespace_id", "child_id", "score", "at", "sources", "n_sources")
    assert sorted(rows(fusion.cross_namespace(df, None), *columns), key=str) == sorted(rows(fusion.cross_namespace(df, 10_000), *columns), key=str)


def test_namespaces():
    assert fusion.authorised(["*"], ["b", "a"]) == ["a", "b"]
    assert fusion.authorised(["b", "a", "b"], ["a", "b"]) == ["b", "a"]
    with pytest.raises(PermissionError):
        fusion.authorised(["a", "x"], ["a"])
    with pytest.raises(ValueError):
        fusion.authorised(["*"], [str(i) for i in range(5)], cap=3)


def test_scatter_is_partial(spark):
    def ask(name):
        if name == "bad":
            raise TimeoutError("late")
        return spark.range(2)

    found, failed = fusion.scatter(["a", "bad", "c"], ask)
    assert found.count() == 4 and list(failed) == ["bad"]


def test_children_per_parent(spark):
    hits = spark.createDataFrame([(1, c, p, s) for c, p, s in [("a", "p", 0.1), ("b", "p", 0.9), ("c", "p", 0.5), ("d", "p", 0.5), ("e", "", 0.7), ("f", "q", 0.9)]], "query_id long, child_id string, parent_id string, score double")
    got = fusion.children_per_parent(hits).orderBy("group_rank", "child_position")
    assert rows(got, "child_id", "group_rank", "is_primary") == [("b", 1, True), ("c", 1, False), ("d", 1, False), ("f", 2, True), ("e", 3, True)]


@pytest.mark.parametrize(("args", "path", "why"), [
    (("simple", None, False, True, "complex", 0.9), "simple", "override"), ((None, "chat", False, True, None, None), "chat", "namespace"), ((None, None, True, False, None, None), "chat", "chat_rule"),
    ((None, None, False, False, None, None), "complex", "unavailable"), ((None, None, False, True, None, None), "complex", "inference_failed"), ((None, None, False, True, "simple", 0.2, 0.1), "complex", "low_confidence"),
    ((None, None, False, True, "chat", 0.9), "complex", "chat_demoted"), ((None, None, False, True, "simple", 0.85, 0.99), "simple", "predicted"),
])
def test_routing(args, path, why):
    assert fusion.route_decision(*args) == (path, why)


def test_listwise(spark):
    assert fusion.windows(45) == [(25, 45), (15, 35), (5, 25), (0, 20)]
    assert fusion.parse_ranking("so: [2, 9, 2, 0]", 4) == [2, 0, 1, 3]
    assert fusion.parse_ranking("nothing", 2) == [0, 1]
    hits = spark.createDataFrame([(1, "q", i, f"p{i}", 1.0 - i / 100) for i in range(30)], "query_id long, query string, id long, passage string, score double")
    best_last = fusion.listwise(hits, lambda q, ps: sorted(range(len(ps)), key=lambda i: -int(ps[i][1:]))).orderBy("position").collect()
    assert [r["id"] for r in best_last][:10] == list(range(29, 19, -1))
    assert [r["id"] for r in sorted(best_last, key=lambda r: -r["score"])][:20] == [r["id"] for r in best_last][:20]
    same = fusion.listwise(hits, lambda q, ps: list(range(len(ps))), orders=1).orderBy("position").collect()
    assert [r["id"] for r in same] == list(range(30))


# --- cleaning and chunking --------------------------------------------------------------


def test_semantic_dedup_is_a_sweep(spark, monkeypatch):
    a = 0.3
    turn = lambda k: [float(np.cos(a * k)), float(np.sin(a * k))]
    data = [("d", i, turn(i)) for i in range(7)] + [("e", 0, [0.0, 0.0]), ("e", 1, [0.0, 0.0]), ("e", 2, None)]
    df = spark.createDataFrame(data, "s string, o long, v array<double>")
    for block in (1024, 2):
        monkeypatch.setattr(cleaning, "SWEEP_BLOCK", block)
        kept = {(r["scope"], r["o"]) for r in cleaning.semantic_dedup(df, "s", "o", "v", float(np.cos(a) - 1e-9)).collect() if r["kept"]}
        assert kept == {("d", 0), ("d", 2), ("d", 4), ("d", 6), ("e", 0), ("e", 1), ("e", 2)}


def test_semantic_dedup_of_whole_labels(spark, tmp_path):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(700, 64))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base[:600] + rng.normal(size=(600, 64)) * 0.05])
    label, ids = rng.integers(0, 2, len(v)), rng.permutation(len(v))
    made = [(int(i), [float(x) for x in w], int(n)) for i, w, n in zip(ids, v, label, strict=True)]
    spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept: dict[str, list[np.ndarray]] = {}
    expected = set()
    for i, w, n in sorted(made):
        u = np.array(w) / np.linalg.norm(w)
        if not any(u @ k >= 0.95 for k in kept.setdefault(str(n), [])):
            kept[str(n)].append(u)
            expected.add((str(n), i))
    got = registry.queries()["semantic_dedup"](spark, str(tmp_path)).collect()
    assert len(got) == len(v) and {(r["scope"], r["o"]) for r in got if r["kept"]} == expected
    assert 700 <= len(expected) <= 1400


def test_anomalies(spark):
    df = spark.createDataFrame([(1, "", [1.0], None), (1, "b", [0.0], '{"meta.parse_status":"ok"}'), (2, "x" * 10001, [1.0], '{"meta":{"parse_status":"failed"}}'), (3, "c", [1.0], '{"meta.parse_failed_page":4}')], "id long, t string, v array<double>, m string")
    got = {(r["id"], tuple(r["reasons"])) for r in cleaning.anomalies(df, "id", "t", "v", "m").collect()}
    assert got == {(1, ("empty",)), (1, ("invalid_embedding", "duplicate_id")), (2, ("oversized", "parse_failed")), (3, ("parse_failed",))}


def test_enrichers(spark):
    def fails(_):
        raise RuntimeError("down")

    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    row = cleaning.enrich(df, {"words": lambda s: s.str.split().str.len(), "absent": None, "broken": fails}).first()
    assert (row["words"], row["absent"], row["broken"], row["failed_members"]) == ("2", None, None, ["broken"])
    assert one_list(spark, cleaning.parse_questions(F.lit("a?\n\n b? "), 2)) == ["a?", "b?"]
    assert one_list(spark, cleaning.parse_questions(F.lit("a?"), 2)) is None


def one_list(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_summaries(spark):
    df = spark.createDataFrame([(d, i, f"{d}.{i}") for d, n in ((1, 3), (2, 60)) for i in range(n)], "doc_id long, chunk_index int, text string")
    got = dict(rows(cleaning.summarise(df, lambda t: f"<{len(t.splitlines())}>"), "doc_id", "summary"))
    assert got == {1: "<3>", 2: "<3>"}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!。é", max_size=300), st.integers(3, 40))
def test_split_loses_nothing(body, most):
    parts = chunking.split(body, most)
    assert all(chunking.splitter_tokens(p) <= most for p in parts)
    strip = lambda s: "".join(c for c in s if c not in " .\n!。")
    assert strip("".join(parts)) == strip(body)


def test_overlap_and_parents():
    body = " ".join(f"word{i:03d}" for i in range(200))
    chunks = chunking.recursive_chunks(body, 60, 10)
    assert all(b.text.startswith(a.text[-10:]) or a.text[-10:] in b.text for a, b in zip(chunks, chunks[1:]))
    rows_ = chunking.parents_and_children([(1, "alpha " * 50), (1, ""), (2, "beta " * 50), (3, "gamma " * 300)], parent=150, child=40, overlap=5)
    assert [r["parent_id"] for r in rows_] == sorted((r["parent_id"] for r in rows_), key=lambda p: int(p[1:]))
    assert {r["parent_id"]: (r["page_start"], r["page_end"]) for r in rows_} == {"p0": (1, 1), "p1": (2, 2), "p2": (3, 3)} or len({r["parent_id"] for r in rows_}) >= 2
    assert [r["chunk_index"] for r in rows_] == list(range(len(rows_)))
    flat = chunking.parents_and_children([(1, "a b c d e f")] * 5, parent=1, child=3, overlap=0, flat_above=2)
    assert {r["parent_id"] for r in flat} == {""}


# --- filters ----------------------------------------------------------------------------


@pytest.mark.parametrize("bad", ["[]", "x", {"a b": {"eq": 1}}, {"a": {}}, {"a": 1}, {"a": {"regex": "x"}}, {"a": {"in": []}}, {"a": {"in": "x"}}, {"a": {"between": [1]}}, {"a": {"is_null": 1}}, {"a": {"eq": [1]}}, {"zz": {"eq": 1}}, {"metadata.a-b": {"eq": 1}}])
def test_filters_refused(bad):
    with pytest.raises(filters.FilterError):
        filters.validate(bad, {"a"})


@pytest.mark.parametrize("bad", ["", "DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 1 -- x", "select * from a union select 1", "SELECT pg_sleep(1)", "WITH a AS (SELECT 1) SELECT 1", "SELECT /* */ 1", "SELECT 1 # x", "SELECT * FROM pg_authid", "SELECT " + "x" * 10_000])
def test_sql_refused(bad):
    with pytest.raises(filters.FilterError):
        filters.check_sql(bad)


def test_sql_allowed():
    assert filters.check_sql("select update_time from t where deleted = 1")


def test_requests():
    assert filters.check_request("é" * 1500, ["a-b_1"]) == "é" * 1000
    for names, k in ((["a b"], 10), (["a"], 0), (["a"], 101)):
        with pytest.raises(filters.FilterError):
            filters.check_request("q", names, k)


def test_pages_cover_everything(spark):
    df = spark.range(53)
    got, at = [], 0
    while True:
        part, total, more = filters.page(df, at, 10, F.col("id"))
        got += [r["id"] for r in part.collect()]
        at += 10
        if not more:
            break
    assert got == list(range(53)) and total == 53
    with pytest.raises(filters.FilterError):
        filters.page(df, 53, 10, F.col("id"))
    assert filters.page(df.limit(0), 0, 10, F.col("id"))[1] == 0


# --- memory, catalog, streams -----------------------------------------------------------


def test_memory(spark):
    assert memory.parse_facts('Sure: ```json\n[{"content": "likes tea", "type": "preference", "confidence": 3}, {"content": "x", "type": "odd"}, {"content": " "}]\n```') == [
        {"content": "likes tea", "type": "preference", "confidence": 1.0}, {"content": "x", "type": "event", "confidence": 0.5},
    ]
    assert memory.parse_facts("no json") == []
    assert memory.opt_out_step("active", "opt_out") == "opted_out" and memory.opt_out_step("opted_out", "revoke", "why") == "active"
    for state, action, reason in (("opted_out", "opt_out", None), ("active", "revoke", "x"), ("opted_out", "revoke", " ")):
        with pytest.raises(ValueError):
            memory.opt_out_step(state, action, reason)
    with pytest.raises(LookupError):
        memory.opt_out_step(None, "opt_out")


def test_memory_ranking(spark):
    now = 10_000_000
    data = [(1, "event", "active", 1.0, now - 30 * 86400), (2, "fact", "active", 0.7, 0), (3, "fact", "invalidated", 9.0, 0), (4, "", "active", 1.0, now + 5)]
    df = spark.createDataFrame(data, "block_id long, memory_type string, status string, raw_score double, created_s long")
    assert rows(memory.rank_memories(df, now, 10), "block_id", "score") == [(4, 1.0), (1, round(float(np.exp(-0.3)), 6)), (2, 0.7)]
    assert memory.rank_memories(df, now, 0).count() == 0
    assert rows(memory.rank_memories(df, now, 1, invalidated_too=True), "block_id") == [(3,)]


def test_memory_edit(spark):
    df = spark.createDataFrame([(1, "u", "old", "active", 5, None)], "block_id long, user_id string, content string, status string, modified_s long, invalidated_by long")
    done = {r["block_id"]: r for r in memory.edit(df, 1, "u", "new", 5, 9, 2).collect()}
    assert done[1]["status"] == "invalidated" and done[1]["invalidated_by"] == 2 and done[2]["content"] == "new" and done[2]["status"] == "active"
    assert memory.edit(df, 1, "u", "new", 4, 9, 2).count() == 1
    with pytest.raises(ValueError):
        memory.edit(df, 1, "u", "x" * 2001, 5, 9, 2)


def test_gc_recounts(spark):
    files = spark.createDataFrame([("a", 10, 0, 5), ("b", 20, 0, 1), ("c", 5, 2, 1)], "file_hash string, size_bytes long, ref_count long, deleted_at long")
    refs = spark.createDataFrame([("b", "n", "1")], "file_hash string, namespace_id string, doc_id string")
    assert rows(catalog.gc_hard_delete(catalog.gc_candidates(files, 9), refs), "file_hash") == [("a",)]
    assert catalog.gc_status(files).first().asDict() == {"files": 3, "unreferenced": 2, "reclaimable_bytes": 30}


KINDS = st.lists(st.sampled_from(["created", "modified", "deleted"]), min_size=1, max_size=8)


@settings(max_examples=8, deadline=None)
@given(st.lists(KINDS, min_size=1, max_size=12))
def test_event_folding(paths):
    from tessera.runtime import local_session

    spark = local_session("tests", 4)
    data = [(f"/{p}", kind, n) for p, kinds in enumerate(paths) for n, kind in enumerate(kinds)]
    got = {(r["path"], r["type"]) for r in events.coalesce_events(spark.createDataFrame(data, "path string, type string, seq long")).collect()}
    want = set()
    for p, kinds in enumerate(paths):
        held = None
        for kind in kinds:
            held = events.fold_event(held, kind)
        if held:
            want.add((f"/{p}", held))
    assert got == want


def test_event_stream_equals_batch(spark, tmp_path):
    schema = "path string, type string, seq long"
    data = [("/a", "created", 1), ("/b", "modified", 2), ("/a", "modified", 3), ("/a", "deleted", 4), ("/b", "deleted", 5), ("/c", "created", 6)]
    for i in range(0, 6, 2):
        spark.createDataFrame(data[i : i + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = events.coalesce_stream(source).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["path"]: r["type"] for r in seen}
    assert {k: v for k, v in last.items() if v} == {r["path"]: r["type"] for r in events.coalesce_events(spark.createDataFrame(data, schema)).collect()}


def test_fan_out(spark):
    got = []

    def bad(_):
        raise OSError("disk")

    assert list(events.fan_out(spark.range(3), {"bad": bad, "good": lambda df: got.append(df.count())})) == ["bad"] and got == [3]


# --- sources ----------------------------------------------------------------------------


def test_codecs():
    raw = codecs.encode_block(1, 2, 3, 4, b"payload")
    assert codecs.decode_block(raw) == (1, 2, 3, 4, b"payload")
    for bad in (raw[:-1], raw + b"x", b"", raw[:10] + b"\xff" + raw[11:]):
        with pytest.raises(ValueError):
            codecs.decode_block(bad)
    v = {3: 0.5, 1: 2.0}
    assert codecs.decode_sparse(codecs.encode_sparse(v)) == v
    for bad in (b"", b"\1\0", codecs.encode_sparse(v) + b"x"):
        with pytest.raises(ValueError):
            codecs.decode_sparse(bad)


def test_html_text():
    page = "<html><head><title>t</title></head><body><nav>a</nav><script>x()</script><p>One &amp; <b>two</b></p><!-- no --><p>three<br>four</p></body></html>"
    assert readers.html_text(page) == "a\nOne & two\nthree\nfour"
    assert readers.html_text(None) == ""


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "snap")
    assert readers.load_snapshot(spark, folder) is None
    for v in range(4):
        readers.save_snapshot(spark.range(v + 1), folder, v)
    assert readers.snapshots(spark, folder) == ["v0000000002", "v0000000003"]
    assert readers.load_snapshot(spark, folder).count() == 4


def test_directory(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# Title\n\n* item [link](http://x)\fpage two")
    (tmp_path / "in" / "sub" / "b.html").write_text("<p>hi</p>")
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF")
    got = {(r["path"].rsplit("/", 1)[1], r["page"], r["text"], r["error"]) for r in readers.parse_files(readers.scan_directory(spark, str(tmp_path / "in"))).collect()}
    assert got == {("a.md", 1, "Title\n\nitem link", None), ("a.md", 2, "page two", None), ("b.html", 1, "hi", None), ("c.pdf", None, None, "no parser for application/pdf")}


def test_global_order(spark):
    from tessera.operators.ordering import max_before, numbered

    df = spark.range(0, 500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") * 91 % 113).alias("v")).repartition(7)
    assert {(r["k"], r["n"]) for r in numbered(df, "n", "k").collect()} == {(i, i) for i in range(500)}
    values = [r["v"] for r in df.orderBy("k").collect()]
    got = {r["k"]: r["m"] for r in max_before(df, "m", F.col("v"), "k").collect()}
    assert got == {i: max(values[:i], default=None) for i in range(500)}
    assert numbered(df.limit(0), "n", "k").count() == 0


def test_chunk_stats_counts_pages_of_every_document(spark):
    docs = spark.createDataFrame([(1, "one\ftwo\f \n\f"), (2, ""), (3, None), (4, "only")], "doc_id long, text string")
    got = chunking.chunk_stats(chunking.children(chunking.chunk_units(docs)), docs).orderBy("doc_id")
    assert rows(got, "doc_id", "total_pages", "succeeded_pages", "failed_pages", "coverage_ratio") == [(1, 4, 2, 2, 0.5), (2, 1, 0, 1, 0.0), (3, 1, 0, 1, 0.0), (4, 1, 1, 0, 1.0)]
    assert [r["children"] > 0 for r in got.collect()] == [True, False, False, True]


def test_bloom(spark):
    from tessera.operators.bloom import Bloom

    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    bloom = Bloom.build(keys.filter("CAST(substring(k, 2) AS INT) < 1000"), "k", 1000, 0.02)
    found = bloom.might_contain(keys, "k")
    assert found.filter("CAST(substring(k, 2) AS INT) < 1000").count() == 1000
    assert found.count() - 1000 < 60 and bloom.false_positive_rate() < 0.04


def test_bloom_precheck_is_sized_by_its_keys(spark, monkeypatch):
    from tessera.operators.bloom import Bloom

    made = []
    build = Bloom.build.__func__
    monkeypatch.setattr(Bloom, "build", classmethod(lambda cls, *a, **k: made.append(build(cls, *a, **k)) or made[-1]))
    big = "/root/testdata/sf0.1"
    found = registry.queries()["bloom_precheck"](spark, big).first()
    assert found["members"] == found["members_passed"] == 10_000 and found["within_rate"]
    assert made[0].false_positive_rate() < 0.02
    got = {r["is_in"]: (r["asked"], r["passed"]) for r in registry.queries()["bloom_pass_counts"](spark, big).collect()}
    assert got[True][0] == got[True][1] > 9000
    assert got[False][0] > 5000 and got[False][1] / got[False][0] < 0.02


def test_routed_is_route_decision(spark):
    """The route as columns against the decision for one query, over all kinds of input."""
    import itertools

    cases = [
        (i, o, f, c, a, p, s)
        for i, (o, f, c, a, p, s) in enumerate(itertools.product(("", "simple"), ("", "chat"), (True, False), (True, False), (None, "chat", "simple", "complex"), (None, 0.1, 0.5, 0.9)))
    ]
    df = spark.createDataFrame(cases, "i int, o string, f string, c boolean, a boolean, p string, s double")
    path, why = fusion.routed(*(F.col(x) for x in "ofcaps"))
    got = {r["i"]: (r["path"], r["why"]) for r in df.select("i", path.alias("path"), why.alias("why")).collect()}
    assert got == {i: fusion.route_decision(o, f, c, a, p, s) for i, o, f, c, a, p, s in cases}


def test_json_maps_and_members(spark):
    from tessera.operators import metadata

    deep = '{"a":' * 20 + "1" + "}" * 20
    df = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [1, 2]}, "d": "x", "n": null}'), (2, "[1]"), (3, None), (4, "oops"), (5, deep)], "i int, j string")
    got = {r["i"]: r["m"] for r in df.select("i", metadata.flat_json(F.col("j")).alias("m")).collect()}
    assert got[1] == {"a.b": "1", "a.c": "[1,2]", "d": "x"} and got[2] == got[3] == got[4] == {}
    assert list(got[5]) == [".".join("a" * metadata.MOST_DEPTH)]
    made = {r["i"]: r["j"] for r in df.select("i", metadata.json_set(F.col("j"), "a.b", F.lit("new")).alias("j")).collect()}
    assert made[1].startswith('{"a":{"b":"new","c":[1,2]}') and made[2] == made[3] == made[4] == '{"a":{"b":"new"}}'


def test_batch_on_duplicate(spark):
    from tessera.sources import readers

    docs = spark.createDataFrame([(1, "x"), (2, ""), (3, "y"), (3, "z")], "doc_id long, text string")
    stored = spark.createDataFrame([(1,)], "doc_id long")
    for how, outcome, error in (("error", "rejected", "exists"), ("skip", "skipped", None), ("replace", "replaced", None)):
        got = {(r["doc_id"], r["outcome"], r["error"]) for r in readers.submit_batch(docs, stored, how).collect()}
        assert got == {(1, outcome, error), (2, "rejected", "empty"), (3, "rejected", "duplicate_id")}
    with pytest.raises(ValueError):
        readers.submit_batch(docs, stored, "merge")


def test_content_store(spark, tmp_path):
    from tessera.sources import blobs

    folder = str(tmp_path / "store")
    assert blobs.stored(spark, folder).count() == 0 and blobs.get(spark, folder, []).count() == 0
    df = spark.createDataFrame([(b"one",), (b"two",), (b"one",), (None,), (b"",)], "content binary")
    for _ in range(2):
        blobs.put(df, folder)
    kept = {r["file_hash"]: bytes(r["content"]) for r in blobs.stored(spark, folder).collect()}
    assert sorted(kept.values()) == [b"", b"one", b"two"] and blobs.stored(spark, folder).count() == 3
    one = next(h for h, c in kept.items() if c == b"one")
    assert [bytes(r["content"]) for r in blobs.get(spark, folder, [one]).collect()] == [b"one"]
    assert blobs.drop(spark, folder, spark.createDataFrame([(one,)], "file_hash string")).count() == 2


def test_fallback_adds_in_page_order(spark):
    rng = np.random.default_rng(3)
    tenths = [t for t in rng.integers(0, 10, (20_000, 10)).tolist() if sum(t) == 50][:300]
    rows = [(doc, page, t / 10) for doc, values in enumerate(tenths) for page, t in enumerate(values)]
    want = {doc: reduce(operator.add, (t / 10 for t in values)) / 10 < 0.5 for doc, values in enumerate(tenths)}
    assert len(set(want.values())) == 2
    pages = spark.createDataFrame(rows, "doc_id long, page long, confidence double").select("*", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    for dealt in (pages.coalesce(1).orderBy(F.desc("page")), pages.repartition(7, "confidence")):
        assert {r["doc_id"]: r["fallback"] for r in readers.needs_fallback(dealt).collect()} == want


def test_fallback_of_odd_pages(spark):
    rows = [(1, None, None, None, None), (2, 1, True, None, None), (3, 1, True, 0.9, "corrupt"), (3, 2, False, 0.1, None), (4, 1, False, 0.9, None), (None, 1, True, 0.9, None)]
    got = readers.needs_fallback(spark.createDataFrame(rows, "doc_id long, page long, ok boolean, confidence double, error string"))
    assert {r["doc_id"]: r["fallback"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, None: False}
