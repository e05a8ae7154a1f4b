"""Cleaning of blocks: exact and semantic duplicates, anomalies, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring, text

MOST_BYTES = 10_000
SAME = 0.95
#: Rows of one scope that are compared as one dense block; more go block by block.
SWEEP_BLOCK = 1024


def exact_dedup(blocks: DataFrame, text_col: str = "text", order_col: str = "doc_id", scope: tuple[str, ...] = ()) -> DataFrame:
    """The first block of each text (by SHA-256), adding ``copies``.

    Folded by an aggregate, not a window: a text that a third of the rows share is combined
    before the shuffle. The first row's columns come back by a join on its order key, which
    must be unique.
    """
    named = blocks.withColumn("text_hash", text.sha256(F.coalesce(F.col(text_col), F.lit(""))))
    first = named.groupBy(*scope, "text_hash").agg(F.min(order_col).alias(order_col), F.count("*").alias("copies")).drop("text_hash", *scope)
    return named.join(first, order_col)


def _parse_failed(column: str) -> Column:
    """Either signal of the parser counts; keys are flat or nested."""
    at = lambda key: F.coalesce(F.get_json_object(column, f"$['meta.{key}']"), F.get_json_object(column, f"$.meta.{key}"))
    return F.coalesce(at("parse_status") == "failed", F.lit(False)) | at("parse_failed_page").isNotNull()


def anomalies(blocks: DataFrame, id_col: str, text_col: str, vector_col: str | None = None, status: str | None = None, id_counts: bool = True, order_col: str | None = None) -> DataFrame:
    """Adds ``reasons`` (array, in the fixed order) and ``anomalous``.

    empty, oversized (bytes), parse_failed, invalid_embedding, duplicate_id (all but the first
    by ``order_col``, else by text). ``status`` names the metadata column.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    again = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(order_col) if order_col else body)) > 1 if id_counts else F.lit(False)
    reasons = [
        F.when(F.length(body) == 0, "empty"), F.when(F.octet_length(body) > MOST_BYTES, "oversized"),
        F.when(_parse_failed(status), "parse_failed") if status else F.lit(None).cast("string"),
        F.when(scoring.bad_vector(F.col(vector_col)), "invalid_embedding") if vector_col else F.lit(None).cast("string"), F.when(again, "duplicate_id"),
    ]
    found = blocks.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return found.withColumn("anomalous", F.size("reasons") > 0)


def anomaly_counts(marked: DataFrame) -> DataFrame:
    return marked.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def cleaning_summary(marked: DataFrame, duplicates: int = 0) -> DataFrame:
    return marked.agg(F.count("*").alias("blocks"), F.sum(F.col("anomalous").cast("int")).alias("anomalous"), F.sum(F.size("reasons")).alias("reasons")).withColumn("duplicates", F.lit(duplicates))


def searchable(marked: DataFrame, flags: str | None = None, anomalous_bit: int = 1) -> DataFrame:
    """Blocks that go into the indexes."""
    skip = F.col("anomalous")
    return marked.filter(~(skip | (F.col(flags).bitwiseAND(anomalous_bit) != 0) if flags else skip))


def run_plugins(blocks: DataFrame, plugins: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for plugin in plugins:
        blocks = blocks.transform(plugin)
    return blocks


def semantic_dedup(blocks: DataFrame, scope: str, order_col: str, vector_col: str, same: float = SAME) -> DataFrame:
    """(scope, order, kept): row j goes if an earlier row that stays has a cosine of ``same`` or more.

    The sweep is in input order within a scope (one document's blocks), so it isn't
    connected components. Blocks of vectors meet the kept rows of each earlier block; a worker
    holds one scope's vectors and one product of two blocks.
    """

    def sweep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("o", kind="stable").reset_index(drop=True)
        kept = np.ones(len(group), bool)
        rows = [np.asarray(v, np.float64) if v is not None else np.zeros(0) for v in group["v"]]
        wide = max((len(r) for r in rows), default=0)
        unit = np.zeros((len(rows), wide))
        for i, r in enumerate(rows):
            norm = np.linalg.norm(r) if len(r) else 0.0
            if norm > 0 and np.isfinite(norm):
                unit[i, : len(r)] = r / norm
        for at in range(0, len(rows), SWEEP_BLOCK):
            now = unit[at : at + SWEEP_BLOCK]
            near = np.zeros(len(now), bool)
            for b in range(0, at, SWEEP_BLOCK):
                before = unit[b : b + SWEEP_BLOCK][kept[b : b + SWEEP_BLOCK]]
                near |= (now @ before.T >= same).any(1)
            inside = now @ now.T >= same
            for j in range(len(now)):
                kept[at + j] = not near[j] and not (inside[j, :j] & kept[at : at + j]).any()
        return pd.DataFrame({"scope": group["scope"], "o": group["o"], "kept": kept})

    rows = blocks.select(F.col(scope).cast("string").alias("scope"), F.col(order_col).cast("long").alias("o"), F.col(vector_col).alias("v"))
    return rows.groupBy("scope").applyInPandas(sweep, "scope string, o long, kept boolean")


def enrich(blocks: DataFrame, members: dict[str, Callable[[pd.Series], pd.Series] | None], text_col: str = "text") -> DataFrame:
    """A chain of enrichers: an unavailable one is skipped, a failing one is recorded, the block stays.

    Adds one column per member and ``failed_members``.
    """
    names = list(members)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            failed = [[] for _ in range(len(batch))]
            for name in names:
                batch[name] = None
                if members[name] is None:
                    continue
                try:
                    batch[name] = members[name](batch[text_col]).astype("string")
                except Exception:  # the contract: a failed member never costs the block
                    for f in failed:
                        f.append(name)
            batch["failed_members"] = failed
            yield batch

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema), *(f"`{n}` string" for n in names), "failed_members array<string>"])
    return blocks.mapInPandas(run, schema)


def contextual(block, context):
    """(text to embed, status): generated 1, failed 2, skipped without a model 3."""
    status = F.when(context.isNull(), 3).when(context == "", 2).otherwise(1)
    return F.when(status == 1, F.concat_ws("\n", context, block)).otherwise(block), status


def parse_questions(answer, k: int):
    """The questions of an answer of exactly k non-empty lines, else null."""
    lines = F.filter(F.transform(F.split(answer, "\n"), text.trim_space), lambda x: x != "")
    return F.when(F.size(lines) == k, lines)


def summarise(chunks: DataFrame, summary: Callable[[str], str], direct: int = 50, group: int = 20) -> DataFrame:
    """doc_id, summary: up to ``direct`` chunks at once, more by groups whose summaries are summarised."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_index")
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "part": [pdf["part"].iloc[0]], "body": [summary("\n".join(pdf["text"]))]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        done = pdf["body"].iloc[0] if len(pdf) == 1 else summary("\n".join(pdf["body"]))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "summary": [done]})

    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    part = F.when(F.col("n") <= direct, 0).otherwise(F.floor(F.col("chunk_index") / group)).cast("int")
    rows = chunks.join(n, "doc_id").select("doc_id", "chunk_index", "text", part.alias("part"))
    parts = rows.groupBy("doc_id", "part").applyInPandas(one, "doc_id long, part int, body string")
    return parts.groupBy("doc_id").applyInPandas(last, "doc_id long, summary string")


def within_budget(calls: DataFrame, cap: int, order_col: str = "call_id", scope: str = "namespace") -> DataFrame:
    """Calls until the running cost reaches the cap; a cap of 0 or less lets all pass."""
    if cap <= 0:
        return calls
    before = Window.partitionBy(scope).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost").over(before), F.lit(0))
    return calls.withColumn("spent", spent).filter(F.col("spent") < cap).drop("spent")


def merge_enriched(results: DataFrame, fields: list[str]) -> DataFrame:
    """Per block: the last non-empty value of each field, the first enricher's name, counters summed."""
    value = lambda f: F.max(F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct("step", F.col(f).alias("v"))))["v"].alias(f)
    return results.groupBy("block_id").agg(F.min_by("enricher", "step").alias("enricher"), F.sum("tokens").alias("tokens"), *map(value, fields))
