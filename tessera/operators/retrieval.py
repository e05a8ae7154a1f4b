"""Retrieval routes. Every operator answers a batch: ``query_id`` groups whatever is asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.runtime import materialize, spread

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Rows of one data block scored at a time against all query vectors of the task.
KNN_BLOCK = 4096
#: Scores of documents by queries that stand in a task's memory at once.
SCORES = 1 << 20
#: Bytes of query vectors that may go to every task; beyond it they are dealt into blocks.
BROADCAST_BYTES = 64 << 20


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """id, term, tf, len (and columns ``also``): one row per term of a document; counted before any shuffle by document."""
    words = spread(docs.select(id_col, text_col, *also)).select(F.col(id_col).alias("id"), *also, text.tokens(F.col(text_col)).alias("w")).withColumn("len", F.size("w"))
    return words.select("id", *also, "len", F.explode("w").alias("term")).groupBy("id", *also, "len", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("term"))


def top(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "doc_id", rank_from: int = 1) -> DataFrame:
    """The k best of each group; rank filters let Spark prune before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(k, 0))
    return ranked.withColumn("rank", (F.col("rank") - 1 + rank_from).cast("int"))


def _scored(asked: DataFrame, fields: DataFrame, k: int) -> DataFrame:
    """BM25 of (query_id, term) over (doc_id, weight, w): one row per document and field.

    The text is tokenised once. Every field adds an empty term that stands for the document
    itself, so that document lengths and counts come from the same filtered postings, which
    are written once: only terms that are asked for are shuffled.
    """
    terms = asked.select("term").distinct().unionByName(asked.sparkSession.range(1).select(F.lit("").alias("term")))
    words = fields.select("doc_id", "weight", F.size("w").alias("len"), F.explode(F.array_append("w", F.lit(""))).alias("term"))
    hit = words.join(terms, "term", "left_semi").groupBy("doc_id", "term").agg(F.sum("weight").alias("tf"), F.sum(F.when(F.col("term") == "", F.col("len"))).alias("len"))
    hit = materialize(hit, "postings")
    return _ranked(asked, hit.filter("term <> ''").select("doc_id", "term", "tf"), hit.filter("term = ''").select("doc_id", "len"), k)


def _ranked(asked: DataFrame, hit: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """BM25 from the postings (doc_id, term, tf) of the asked terms and the lengths (doc_id, len) of all documents."""
    n_docs, mean_len = lengths.agg(F.count("*"), F.avg("len")).first()
    df, tf = F.col("df"), F.col("tf")
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.lit(n_docs) - df + 0.5) / (df + 0.5)))
    weights = hit.groupBy("term").agg(F.count("*").alias("df")).select("term", idf.alias("idf"))
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(mean_len)))
    scored = hit.join(weights, "term").join(asked, "term").join(lengths, "doc_id").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, k).select("query_id", "doc_id", "score", "rank")


def bm25(docs: DataFrame, queries: DataFrame, k: int, *, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank by BM25 over OR-ed terms."""
    fields = spread(docs.select(doc_id, doc_text)).select(F.col(doc_id).alias("doc_id"), F.lit(1).alias("weight"), text.tokens(F.col(doc_text)).alias("w"))
    return _scored(query_terms(queries, query_id, query_text), fields, k)


def field_bm25(docs: DataFrame, fields: dict[str, float], queries: DataFrame, k: int, *, doc_id: str = "doc_id", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """BM25 over several fields whose term counts are weighted before saturation."""
    each = F.explode(F.array(*(F.struct(F.lit(float(w)).alias("weight"), text.tokens(F.col(f)).alias("w")) for f, w in fields.items())))
    rows = spread(docs.select(doc_id, *fields)).select(F.col(doc_id).alias("doc_id"), each.alias("f")).select("doc_id", "f.weight", "f.w")
    return _scored(query_terms(queries, query_id, query_text), rows, k)


@dataclass
class TextIndex:
    """Every document's distinct terms with their counts: (doc_id, len, terms, tfs), written once.

    What a search needs of a document stands in one row, so nothing of it is shuffled: a task
    scores its rows for all queries and hands on the best k of each. What it may find can be
    bounded by a table of ids: counts and lengths are then of those documents only.
    """

    rows: DataFrame

    @property
    def postings(self) -> DataFrame:
        """doc_id, term, tf."""
        return self.rows.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc_id", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))

    @property
    def lengths(self) -> DataFrame:
        """doc_id, len (words, repeated ones too)."""
        return self.rows.select("doc_id", "len")

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", doc_text: str = "text") -> TextIndex:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                words = lists.flatten().dictionary_encode()
                kinds = max(1, len(words.dictionary))
                pairs, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * kinds + words.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(len(lengths) + 1) * kinds), pa.int32())
                terms = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(pairs % kinds)))
                tfs = pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), terms, tfs], names=["doc_id", "len", "terms", "tfs"])

        words = spread(docs.select(doc_id, doc_text)).select(F.col(doc_id).alias("doc_id"), text.tokens(F.col(doc_text)).alias("w"))
        schema = f"doc_id {words.schema['doc_id'].dataType.simpleString()}, len int, terms array<string>, tfs array<int>"
        return cls(materialize(words.mapInArrow(run, schema), "index"))

    def bm25(self, queries: DataFrame, k: int, among: DataFrame | None = None, *, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
        """query_id, doc_id, score, rank, as ``bm25`` over the documents ``among`` (doc_id), or over all."""
        index = self.among(among)
        asked = query_terms(queries, query_id, query_text)
        n_docs, mean_len = index.lengths.agg(F.count("*"), F.avg("len")).first()
        wanted = index.postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weights = materialize(wanted.select("term", idf.alias("weight")), "index-idf")

        def part(weight: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
            return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_len))

        return index._best(asked.join(weights, "term"), k, part)

    def sparse(self, queries: DataFrame, k: int, among: DataFrame | None = None, *, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
        """query_id, doc_id, score, rank, as ``sparse_dot`` without a cap: ln(1 + tf) of a query's terms."""
        asked = query_terms(queries, query_id, query_text).withColumn("weight", F.lit(1.0))
        return self.among(among)._best(asked, k, lambda weight, tf, size: weight * np.log1p(tf))

    def among(self, ids: DataFrame | None) -> TextIndex:
        return self if ids is None else TextIndex(materialize(self.rows.join(ids.select("doc_id"), "doc_id", "left_semi"), "index-among"))

    def _best(self, asked: DataFrame, k: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """The k best sums of ``part(weight, tf, len)``, all positive, of each query; ``asked``: (query_id, term, weight).

        As in ``knn``, queries of bounded size go to every task, and more are dealt into blocks.
        """
        if k <= 0:
            return top(asked.select("query_id", F.lit(0.0).alias("score")).crossJoin(self.lengths.select("doc_id").limit(0)), 0).select("query_id", "doc_id", "score", "rank")
        bound = asked.agg(F.sum(F.octet_length("term") + 64).alias("n")).first()["n"] or 0
        blocks = max(1, -(-bound // BROADCAST_BYTES))
        parts = [self._best_block(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else asked, k, part) for i in range(blocks)]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return top(found, k).select("query_id", "doc_id", "score", "rank")

    def _best_block(self, asked: DataFrame, k: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        collected = asked.toArrow()  # at most BROADCAST_BYTES
        terms, ids = (collected[c].combine_chunks().dictionary_encode("encode") for c in ("term", "query_id"))
        at = terms.indices.to_numpy()
        weights = np.zeros(len(terms.dictionary))
        weights[at] = collected["weight"].to_numpy()
        order = np.argsort(at, kind="stable")  # a term's queries stand together
        first = np.searchsorted(at[order], np.arange(len(weights) + 1))
        shared = self.rows.sparkSession.sparkContext.broadcast((terms.dictionary, weights, first, ids.indices.to_numpy()[order].astype(np.int64), ids.dictionary))
        kinds = [(n, f.schema[n].dataType.simpleString()) for f, n in ((asked, "query_id"), (self.rows, "doc_id"))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, weights, first, column, ids = shared.value
            floor = np.zeros(len(ids))  # the k-th best so far
            step = max(1, SCORES // max(1, len(ids)))
            for batch in batches:
                for start in range(0, batch.num_rows if len(ids) else 0, step):
                    rows = batch.slice(start, step)
                    n, sizes = rows.num_rows, np.diff(rows.column("terms").offsets.to_numpy())
                    which = pc.fill_null(pc.index_in(rows.column("terms").flatten(), vocabulary), -1).to_numpy()
                    hit = np.flatnonzero(which >= 0)
                    owner, which = np.repeat(np.arange(n), sizes)[hit], which[hit]
                    tf = rows.column("tfs").flatten().to_numpy()[hit].astype(np.float64)
                    value = part(weights[which], tf, rows.column("len").to_numpy()[owner].astype(np.float64))
                    times = first[which + 1] - first[which]
                    # each posting as often as queries ask for it, and which of them does
                    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[which], times)
                    cell = column[place] * n + np.repeat(owner, times)
                    score = np.round(np.bincount(cell, np.repeat(value, times), len(ids) * n).astype(np.float64).reshape(len(ids), n), 6)
                    some = np.bincount(cell, minlength=len(ids) * n).reshape(len(ids), n) > 0
                    score[~some] = -1.0
                    if n >= k:
                        floor = np.maximum(floor, -np.partition(-score, k - 1, axis=1)[:, k - 1])
                    i, j = np.nonzero(score >= floor[:, None])  # ties at the limit all go on
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), rows.column("doc_id").take(pa.array(j)), pa.array(score[i, j])], names=["query_id", "doc_id", "score"])

        return self.rows.mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind in [*kinds, ("score", "double")]))


def knn(data: DataFrame, queries: DataFrame, k: int, metric: str = "l2", decimals: int = 6) -> DataFrame:
    """query_id, vec_id, score, rank: exact nearest neighbours; ``data`` and ``queries`` are (vec_id, embedding).

    Query vectors of bounded size go to every task, which keeps k rows a query and batch;
    beyond the bound they are dealt into blocks that meet the data one after the other.
    Vectors that are null, hold nulls or have another width than the queries' widest take no
    part on either side.
    """
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    queries = queries.filter(sound & (F.size("embedding") > 0))
    wide = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    fits = F.size("embedding") == wide
    data = data.filter(sound & fits)
    rows = queries.filter(fits).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    parts = [_knn_block(data, block, k, metric, decimals) for block in query_blocks(rows)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top(found, k, tie="vec_id").select("query_id", "vec_id", "score", "rank")


def query_blocks(rows: DataFrame) -> list[DataFrame]:
    """(query_id, q) dealt by id into blocks of at most BROADCAST_BYTES of vectors."""
    bound = rows.agg(F.sum(F.size("q") * 8).alias("n")).first()["n"] or 0
    blocks = max(1, -(-bound // BROADCAST_BYTES))
    return [rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else rows for i in range(blocks)]


def _knn_block(data: DataFrame, queries: DataFrame, k: int, metric: str, decimals: int) -> DataFrame:
    collected = queries.toPandas()  # at most BROADCAST_BYTES
    ids = collected["query_id"].to_numpy(np.int64)
    asked = np.array(collected["q"].tolist(), np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    shared = data.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, KNN_BLOCK):
                part = batch.slice(at, KNN_BLOCK)
                own = part.column(0).to_numpy(zero_copy_only=False)
                if not len(own) or not len(q_ids):
                    continue
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                if metric == "cosine":
                    scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
                    score = np.where(scale > 0, q @ v.T / np.where(scale > 0, scale, 1), 0.0)
                elif metric == "dot":
                    score = q @ v.T
                else:
                    d = np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T, 0)
                    score = 1 / (1 + d)
                score = np.round(score, decimals)
                n = min(k, len(own))
                limit = -np.partition(-score, n - 1, axis=1)[:, n - 1]  # ties at the limit all go on
                i, j = np.nonzero(score >= limit[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(own[j].astype(np.int64)), pa.array(score[i, j])], names=["query_id", "vec_id", "score"])

    return data.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def capped_postings(sparse: DataFrame, cap: int = 1000) -> DataFrame:
    """The heaviest ``cap`` entries of each (ns, term); ties by child."""
    order = Window.partitionBy("ns", "term").orderBy(F.desc("weight"), "child_id")
    return sparse.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def sparse_dot(sparse: DataFrame, queries: DataFrame, k: int = 100, cap: int | None = 1000) -> DataFrame:
    """Dot products of sparse vectors: (ns, term, child_id, weight) with (query_id, term, qw).

    Without ``cap`` every posting of the terms asked for counts.
    """
    asked = queries.select("term").distinct()
    hit = sparse.join(asked, "term", "left_semi")
    hit = hit if cap is None else capped_postings(hit, cap)
    scored = hit.join(queries, "term").groupBy("query_id", "child_id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))
    return top(scored, k, tie="child_id").select("query_id", "child_id", "score", "rank")


def upsert(index: DataFrame, changes: DataFrame, key: str = "child_id") -> DataFrame:
    """Replace all of a key's entries; a change with a null term removes the key."""
    return index.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.filter(F.col("term").isNotNull()))


def entity_index(docs: DataFrame, pattern: str = r"[A-Z][a-z]{5,}", least: int = 3) -> DataFrame:
    """entity, documents: names that at least so many documents hold."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))).alias("entity"))
    return found.groupBy("entity").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least)


def with_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Child hits with what ``parents`` (parent_id, ...) has of their parents; a flat child has none."""
    return hits.join(parents, "parent_id", "left")


def vector_kind(block_type: Column, source_child: Column, contextual: Column) -> Column:
    """Which route a vector hit belongs to: HyPE question, contextual label, plain, or none."""
    return F.when((block_type == 16) & source_child.isNotNull(), "hype").when(block_type == 16, "dropped").when(contextual, "contextualized").otherwise("dense")


def first_vote(hits: DataFrame, key: str = "source_child_id") -> DataFrame:
    """One hit per source child, the best-ranked."""
    order = Window.partitionBy("query_id", key).orderBy("rank", "block_id")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def memory_search(hits: DataFrame, user_id: str, now_s: int, top_k: int) -> DataFrame:
    """Scope to a user, drop expired entries, weigh by age, keep the best.

    ``hits``: block_id, user_id, kind, status, created_s, ttl_s, raw_score.
    """
    alive = ~F.coalesce((F.col("ttl_s") > 0) & (F.lit(now_s) > F.col("created_s") + F.col("ttl_s")), F.lit(False))
    days = scoring.age_days(now_s, F.col("created_s"))
    score = F.greatest(F.lit(0.0), F.col("raw_score") * scoring.memory_decay(F.col("kind"), days))
    mine = hits.filter((F.col("user_id") == user_id) & alive & (F.coalesce("status", F.lit("active")) != "invalidated"))
    return mine.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "block_id").limit(max(0, top_k))


def pool_size(k: int, multiplier: int = 3, oversample: float = 1.0, most: int = 50) -> int:
    """How many candidates a route fetches for k answers."""
    import math

    return max(k, min(k * multiplier * math.ceil(oversample), most))
