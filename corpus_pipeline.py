"""The corpus pipeline: line rules, quality classifier, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the
last return the columns of ``docs`` unchanged, extra ones included, whatever their names. An
empty table stays empty in every stage. Texts are read whole however long; a task holds the
texts of one Arrow batch, and a longer text by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_crf, minmax_dedup, mixing, packing, quality_knn
from tessera.runtime import materialize, prepare, table


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labeller keep.

    Null, empty and short texts go. Repeated rows are judged alike.
    """
    prepare(spark)
    verdict = line_crf.judge(spark, line_crf.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return docs.filter(verdict(F.col("text"))["kept"])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says that label 1 is likely. Repeated rows are judged alike.

    Null and empty texts score the labelled sample's mean and go or stay by it.

    Both learned stages learn from the labelled documents of ``sf_dir``, not from what came
    through so far: survivors alone would teach that everything is good.
    """
    prepare(spark)
    score = quality_knn.scorer(spark, quality_knn.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text")) >= quality_knn.KEEP_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, its smallest doc_id.

    Rows of one doc_id are one document; rows without an id all stay.
    """
    prepare(spark)
    dropped = minmax_dedup.deduplicated(docs).filter(~F.col("kept")).select("doc_id")
    dropped = materialize(dropped.distinct(), "dropped")
    return docs.join(dropped, docs["doc_id"] == dropped["doc_id"], "left_anti")


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it doesn't take go.

    Equal (doc_id, source) rows share their fate. Rows without an id or source are mixed too.
    Only the plan, one row per source, is joined: no text is shuffled.
    """
    prepare(spark)
    own = {n: _free(docs, n) for n in ("source_", "repeats", "threshold", "copies", "turn")}
    plan = mixing.plan(materialize(mixing.measured(docs), "mix-sizes"))
    marks = plan.select(F.col("source").alias(own["source_"]), F.col("repeats").alias(own["repeats"]), F.col("threshold").alias(own["threshold"]))
    taken = F.least(F.col(own["repeats"]) + F.when(mixing.id_hash(docs["doc_id"]) < F.col(own["threshold"]), 1).otherwise(0), F.lit(mixing.MOST_REPEATS))
    again = docs.join(marks, docs["source"].cast("string").eqNullSafe(marks[own["source_"]])).withColumn(own["copies"], taken).filter(F.col(own["copies"]) > 0)
    again = again.withColumn(own["turn"], F.explode(F.sequence(F.lit(1), F.col(own["copies"]))))
    return again.drop(*own.values())


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, every copy separately; null and empty texts are one token."""
    prepare(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("mixing", mixing_to_targets),
    ("packing", best_fit_packing),
]

#: SQL expresses neither the learned stages nor packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
