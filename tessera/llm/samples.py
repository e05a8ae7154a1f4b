"""Bounded, deterministic training samples and the hold-out rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(*columns: str) -> Column:
    """0 to 1, by the columns' hash."""
    return F.xxhash64(*columns, F.lit(7)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))


#: Classes whose shares are broadcast; with more, the shares are joined as Spark sees fit.
BROADCAST_CLASSES = 4096


def per_class(rows: DataFrame, key: str, most: Callable[[int], int], *identity: str) -> DataFrame:
    """About ``most(classes)`` rows of each value of ``key``, by a threshold on the hash of ``identity``.

    Identities are counted by class (by a sketch, so that repeated rows weigh nothing), and
    each class keeps the hashes below its own share; the table of shares has one row per
    class. Rows of one identity share a hash and so their fate: callers whose rows may repeat
    keep one of each identity afterwards.
    """
    counts = rows.groupBy(key).agg(F.approx_count_distinct(F.xxhash64(*identity), 0.02).alias("count")).collect()
    shares = rows.sparkSession.createDataFrame([(r[key], min(1.0, most(len(counts)) / max(1, r["count"]))) for r in counts], f"{key} {rows.schema[key].dataType.simpleString()}, share double")
    shares = F.broadcast(shares) if len(counts) <= BROADCAST_CLASSES else shares
    return rows.join(shares, key).filter(unit_hash(*identity) < F.col("share")).drop("share")


def labelled_texts(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """doc_id, quality, text of about ``per_label`` documents of each label, none held out.

    One row an id: of rows that share it, the one with the text of the smallest hash. The
    sample's ids, bounded by that number, are broadcast, and only its texts are shuffled.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = per_class(known, "quality", lambda n: per_label, "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return one.select("doc_id", "quality", "first.text")
