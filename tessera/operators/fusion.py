"""Rank fusion, reranking, cross-namespace merging, verdicts and routing."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered

RRF_K = 60
#: Bits of the routes that a fused block came by.
ROUTE_BITS = {"vector": 1, "bm25": 2, "sql": 4}


def rrf(lists: DataFrame, key: str = "id", by: str = "query_id", k: int = RRF_K, rank_base: int = 1) -> DataFrame:
    """Reciprocal rank fusion of (query_id, route, id, rank from 1).

    The best rank of a list adds 1 / (k + rank_base), the next one 1 / (k + rank_base + 1).
    query_id, id, score, routes (sorted, joined), position from 1; ties by id. A k of zero or
    less means the default.
    """
    k = k if k > 0 else RRF_K
    part = 1 / (F.lit(float(k + rank_base - 1)) + F.col("rank"))
    fused = lists.groupBy(by, key).agg(F.round(F.sum(part), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("route")), ",").alias("routes"))
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return fused.withColumn("position", F.row_number().over(order))


def route_mask(route: Column) -> Column:
    bits = F.lit(0)
    for name, bit in ROUTE_BITS.items():
        bits = F.when(route == name, bit).otherwise(bits)
    return bits


def rrf_with_flags(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Two-route form: rank from 1, failed routes skipped, raw scores kept, routes as bits."""
    raw = [F.max(F.when(F.col("route") == r, F.col("raw_score"))).alias(f"{r}_score") for r in ("vector", "bm25")]
    ok = lists.filter(F.col("status") == "success") if "status" in lists.columns else lists
    fused = ok.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.bit_or(route_mask(F.col("route"))).alias("hit_routes"), *raw)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("n_routes", F.bit_count("hit_routes")).withColumn("position", F.row_number().over(order))


def hype_fusion(dense: DataFrame, questions: DataFrame, k: int = RRF_K) -> DataFrame:
    """Children and generated questions fused, then the best child of each parent.

    ``dense`` (query_id, child_id, parent_id, rank), ``questions`` adds question_text and score;
    ranks from 0.
    """
    both = dense.select("query_id", "child_id", "parent_id", "rank", F.lit(None).cast("string").alias("question"), F.lit(None).cast("double").alias("q_score")).unionByName(
        questions.select("query_id", "child_id", "parent_id", "rank", F.col("question_text").alias("question"), F.col("score").alias("q_score"))
    )
    asked = F.when(F.col("question").isNotNull(), F.struct(F.col("q_score"), -F.col("rank"), F.col("question").alias("question")))
    fused = both.groupBy("query_id", "child_id", "parent_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.max(asked)["question"].alias("question"))
    order = Window.partitionBy("query_id", "parent_id").orderBy(F.desc("score"), "child_id")
    return fused.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def weighted_fusion(lists: DataFrame, original: float = 1.7, variant: float = 0.5, k: int = RRF_K) -> DataFrame:
    """Results of several wordings of one query: (query_id, variant, id, rank from 1, raw_score).

    Variant 0 is the original. Ties go to what was seen first.
    """
    weight = F.when(F.col("variant") == 0, original).otherwise(variant)
    seen = F.col("variant") * 1_000_000 + F.col("rank")
    fused = lists.groupBy("query_id", "id").agg(
        F.round(F.sum(weight / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.max("raw_score").alias("raw_score"), F.min(seen).alias("first_seen")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen")
    return fused.withColumn("position", F.row_number().over(order))


def anchor_count(first: Column, second: Column, third: Column, cap: int = 3) -> Column:
    """How many of the original query's leading results stay in front."""
    return F.when((first <= 0) | second.isNull(), 1).when(F.coalesce(third, second) >= 0.45 * first, cap).when(second >= 0.35 * first, min(2, cap)).otherwise(1)


def with_anchors(fused: DataFrame, original: DataFrame, cap: int = 3) -> DataFrame:
    """Put the original's leading results first, the rest of the fused order after them."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("raw_score")))
    heads = original.groupBy("query_id").agg(anchor_count(at(1), at(2), at(3), cap).alias("anchors"))
    anchored = original.join(heads, "query_id").filter(F.col("rank") <= F.col("anchors")).select("query_id", "id", F.col("rank").alias("anchor"))
    joined = fused.join(anchored, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("anchor").isNull(), "anchor", "position")
    return joined.withColumn("final", F.row_number().over(order))


def discovery_fusion(summaries: DataFrame, documents: DataFrame, k: int = RRF_K) -> DataFrame:
    """Summary-vector hits and document full-text hits by document; summaries' metadata wins."""
    both = summaries.select("query_id", "doc_id", "rank", F.col("title").alias("s"), F.lit(None).cast("string").alias("d")).unionByName(
        documents.select("query_id", "doc_id", "rank", F.lit(None).cast("string").alias("s"), F.col("title").alias("d"))
    )
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.coalesce(F.max("s"), F.max("d")).alias("title"))
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def hybrid_by_document(chunks: DataFrame, documents: DataFrame, k: int = RRF_K) -> DataFrame:
    """Chunk hits and document hits fused by document, the best chunk kept as evidence.

    ``chunks`` (query_id, doc_id, chunk_id, rank), ``documents`` (query_id, doc_id, rank); from 0.
    """
    order = Window.partitionBy("query_id", "doc_id").orderBy("rank", "chunk_id")
    best = chunks.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    place = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    by_doc = best.withColumn("rank", F.row_number().over(place) - 1)
    both = by_doc.select("query_id", "doc_id", "rank", "chunk_id").unionByName(documents.select("query_id", "doc_id", "rank", F.lit(None).cast("long").alias("chunk_id")))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 9).alias("score"), F.max("chunk_id").alias("chunk_id"))
    return fused.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def cross_namespace(items: DataFrame, top_k: int | None, by: str = "query_id") -> DataFrame:
    """Merge namespaces: one item per content hash, its best score, every source listed.

    ``items`` (query_id, namespace_id, child_id, content_hash, score, at); an empty hash never
    merges; of equal scores the earliest (``at``) stays. Without ``top_k`` all items stay, and are
    numbered without bringing a query's items into one task.
    """
    group = F.when(F.coalesce("content_hash", F.lit("")) == "", F.concat_ws("/", F.lit("own"), "namespace_id", "child_id")).otherwise(F.col("content_hash"))
    best = F.max(F.struct(F.col("score"), (-F.col("at")).alias("first"), F.col("namespace_id"), F.col("child_id"))).alias("b")
    sources = F.array_join(F.sort_array(F.collect_set(F.concat_ws("/", "namespace_id", "child_id"))), ",").alias("sources")
    merged = items.withColumn("_g", group).groupBy(by, "_g").agg(best, sources, F.count("*").alias("n_sources"))
    flat = merged.select(by, "b.namespace_id", "b.child_id", "b.score", (-F.col("b.first")).alias("at"), "sources", "n_sources")
    if top_k is None:
        placed = numbered(flat, "_n", by, F.desc("score"), "at", "namespace_id", "child_id")
        first = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_first"))
        joined = placed.join(first, F.col(by).eqNullSafe(F.col("_by")))
        return joined.withColumn("position", (F.col("_n") - F.col("_first") + 1).cast("int")).drop("_n", "_by", "_first")
    order = Window.partitionBy(by).orderBy(F.desc("score"), "at")
    return flat.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max(0, top_k))


def authorised(requested: list[str], readable: Iterable[str], cap: int = 100) -> list[str]:
    """The namespaces to ask, in order and once each; ``*`` is all that is readable.

    Too many, or one that may not be read, fails the whole request.
    """
    allowed = list(dict.fromkeys(readable))
    names = sorted(allowed) if requested == ["*"] else list(dict.fromkeys(requested))
    if refused := [n for n in names if n not in set(allowed)]:
        raise PermissionError(f"not readable: {', '.join(refused)}")
    if len(names) > max(1, min(1000, cap)):
        raise ValueError(f"{len(names)} namespaces; at most {cap} may be asked at once")
    return names


def scatter(names: list[str], ask: Callable[[str], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Ask each namespace by itself; failures are listed and don't stop the others."""
    found, failed = None, {}
    for name in names:
        try:
            part = ask(name).withColumn("namespace_id", F.lit(name))
            found = part if found is None else found.unionByName(part)
        except Exception as e:  # the contract: partial success
            failed[name] = f"{type(e).__name__}: {e}"
    return found, failed


def children_per_parent(hits: DataFrame, cap: int = 3, by: str = "query_id") -> DataFrame:
    """Group child hits by parent, best first, at most ``cap`` of each; a flat child is its own parent.

    Adds group_key, child_position, is_primary, group_rank.
    """
    key = F.when(F.coalesce("parent_id", F.lit("")) == "", F.concat(F.lit("flat:"), F.col("child_id"))).otherwise(F.col("parent_id"))
    inside = Window.partitionBy(by, "group_key").orderBy(F.desc("score"), "child_id")
    rows = hits.withColumn("group_key", key).withColumn("child_position", F.row_number().over(inside))
    rows = rows.withColumn("top", F.max("score").over(Window.partitionBy(by, "group_key"))).filter(F.col("child_position") <= cap)
    tie = F.when(F.coalesce("parent_id", F.lit("")) == "", F.col("child_id")).otherwise(F.col("parent_id"))
    groups = Window.partitionBy(by).orderBy(F.desc("top"), tie, "group_key")
    return rows.withColumn("group_rank", F.dense_rank().over(groups)).withColumn("is_primary", F.col("child_position") == 1).drop("top")


def crag_signals(scored: DataFrame, high: float = 0.5, by: str = "query_id") -> DataFrame:
    """Top score, median, population deviation, share of high scores, gap of first to fifth, verdict."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("_n", F.row_number().over(order))
    fifth = F.max(F.when(F.col("_n") == 5, F.col("score")))  # null with fewer than five
    found = ranked.groupBy(by).agg(
        F.max("score").alias("top1"), F.expr("percentile(score, 0.5)").alias("median"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("std"),
        F.avg(F.when(F.col("score") >= high, 1.0).otherwise(0.0)).alias("high_ratio"), (F.max("score") - fifth).alias("gap"), F.count("*").alias("n"),
    )
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("top1") + 0.3 * F.col("high_ratio")))
    verdict = F.when(confidence >= 0.7, "correct").when(confidence < 0.3, "incorrect").otherwise("ambiguous")
    return found.withColumn("confidence", confidence).withColumn("verdict", verdict)


def crag_keep(scored: DataFrame, signals: DataFrame, by: str = "query_id") -> DataFrame:
    """Ambiguous answers keep their better half, rounded up; all others stay as they are."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).join(signals.select(by, "verdict", "n"), by)
    keep = F.when(F.col("verdict") == "ambiguous", F.ceil(F.col("n") / 2)).otherwise(F.col("n"))
    return ranked.filter(F.col("rank") <= keep).drop("n")


def degradation(dense_ok: Column, bm25_ok: Column, sql_ok: Column) -> Column:
    """0 nothing failed, 1 only SQL failed, 2 one text route still works, 3 none."""
    return F.when(dense_ok & bm25_ok & sql_ok, 0).when(dense_ok & bm25_ok, 1).when(dense_ok | bm25_ok, 2).otherwise(3)


def route_decision(
    override: str | None, forced: str | None, is_chat: bool, available: bool, predicted: str | None, confidence: float | None, threshold: float = 0.5
) -> tuple[str, str]:
    """(path, why) of a query; whatever is unsure takes the complex path."""
    if override:
        return override, "override"
    if forced:
        return forced, "namespace"
    if is_chat:
        return "chat", "chat_rule"
    if not available:
        return "complex", "unavailable"
    if predicted is None or confidence is None:
        return "complex", "inference_failed"
    if confidence < min(0.8, max(0.3, threshold)):
        return "complex", "low_confidence"
    if predicted == "chat":
        return "complex", "chat_demoted"
    return predicted, "predicted"


def routed(override: Column, forced: Column, is_chat: Column, available: Column, predicted: Column, confidence: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """``route_decision`` for a whole table: (path, why) as columns."""
    unknown, unsure = predicted.isNull() | confidence.isNull(), confidence < min(0.8, max(0.3, threshold))
    cases = [
        (F.coalesce(override, F.lit("")) != "", override, "override"), (F.coalesce(forced, F.lit("")) != "", forced, "namespace"), (is_chat, F.lit("chat"), "chat_rule"), (~available, F.lit("complex"), "unavailable"),
        (unknown, F.lit("complex"), "inference_failed"), (unsure, F.lit("complex"), "low_confidence"), (predicted == "chat", F.lit("complex"), "chat_demoted"),
    ]
    path, why = predicted, F.lit("predicted")
    for test, to, reason in reversed(cases):
        path, why = F.when(test, to).otherwise(path), F.when(test, reason).otherwise(why)
    return path, why


def wants_variants(scores: DataFrame, margin: float = 0.2, least: int = 2, by: str = "query_id") -> DataFrame:
    """Whether rewriting a query is worth it: few results, or its first two scores lie close together."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    found = scores.groupBy(by).agg(at(1).alias("first"), at(2).alias("second"), F.count("*").alias("n"))
    clear = (F.col("n") >= max(2, least)) & (F.col("first") > F.col("second")) & (F.col("first") - F.col("second") >= margin)
    return found.withColumn("expand", ~F.coalesce(clear, F.lit(False))).drop("n")


# --- listwise reranking -----------------------------------------------------------------


def parse_ranking(answer: str, n: int) -> list[int]:
    """Positions from a model's answer; out-of-range and repeated ones go, missing ones follow."""
    found = re.search(r"\[[^\[\]]*\]", answer or "")
    try:
        items = json.loads(found[0]) if found else []
    except ValueError:
        items = []
    seen = list(dict.fromkeys(int(x) for x in items if isinstance(x, int) and not isinstance(x, bool) and 0 <= x < n))
    return seen + [i for i in range(n) if i not in set(seen)]


def presentations(n: int, how_many: int) -> list[list[int]]:
    """Orders in which a list is shown: as it is, reversed, evens before odds."""
    return [list(range(n)), list(range(n))[::-1], [*range(0, n, 2), *range(1, n, 2)]][: max(1, how_many)]


def windows(n: int, size: int = 20, stride: int = 10) -> list[tuple[int, int]]:
    """Windows from the tail to the head, the last one at 0."""
    if n <= size:
        return [(0, n)]
    starts = list(range(n - size, 0, -stride)) + [0]
    return [(s, s + size) for s in starts]


def listwise(hits: DataFrame, rank_list: Callable[[str, list[str]], list[int]], size: int = 20, stride: int = 10, orders: int = 3) -> DataFrame:
    """Rerank each query's hits by an injected model and Borda counts over presentation orders.

    ``hits``: query_id, query, id, passage, score. Windows slide from the tail up; a changed
    head gets scores above the tail's greatest, so that sorting by score gives the new order.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        order = list(range(len(group)))
        for low, high in windows(len(order), size, stride):
            part, points = order[low:high], [0] * (high - low)
            for shown in presentations(len(part), orders):
                answer = rank_list(group["query"][0], [group["passage"][part[i]] for i in shown])
                for place, at in enumerate(answer):
                    points[shown[at]] += len(part) - place
            order[low:high] = [part[i] for i in sorted(range(len(part)), key=lambda i: (-points[i], i))]
        out = group.iloc[order].reset_index(drop=True)
        n = min(len(out), size)
        if order[:n] != list(range(n)):
            tail = out["score"][n:].max() if len(out) > n else 0.0
            out.loc[: n - 1, "score"] = [tail + (n - i) / (n + 1) for i in range(n)]
        return out[["query_id", "id", "score"]].assign(position=range(1, len(out) + 1))

    return hits.select("query_id", "query", "id", "passage", "score").groupBy("query_id").applyInPandas(run, "query_id long, id long, score double, position int")
