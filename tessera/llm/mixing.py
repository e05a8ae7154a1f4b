"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. A source whose target is ``q`` whole times its
size plus a rest takes each document ``q`` times and, once more, those whose hash lies under
the source's threshold. The threshold is found without sorting: words are summed by source
and by the hash's leading bits, the bucket in which the running sum passes the rest is the
boundary, and only that bucket is summed again by its next bits, until it holds one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
HASH_BITS, STEP_BITS = 60, 10


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), 0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5, which any SQL engine can repeat; a null id hashes as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> and target: shares by weight, none above ``most`` times its size.

    Sources in code-point order, null last, take the weights in turn. Capped sources are a
    prefix of the order by size a weight; whatever they leave goes to the others by weight.
    One row per source goes through one task; documents don't.
    """
    first = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(first) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto, everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    cap = F.col("source_size") * most
    before = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        (F.sum(cap).over(upto) - cap).alias("cap_before"),
        (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")).alias("weight_left"),
    )
    level = (F.col("all_size") - F.col("cap_before")) / F.col("weight_left")
    capped = level * F.col("weight") >= cap
    found = before.withColumn("capped", capped).withColumn("level", level)
    level_of_rest = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(level_of_rest * F.col("weight"))
    return found.withColumn("target", target).select("source", "source_size", "target")


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the repeats all documents get, and the hash below which one more is taken.

    ``sizes`` (source, h, size) is read once a level; a level beyond the first reads only
    boundary buckets. The cut lies where the sum is nearest the rest, the lower one on a tie.
    """
    whole = F.floor(F.col("target") / F.col("source_size"))
    repeats = F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("repeats", repeats).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = state.select("source", "repeats", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("done"))
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    for level in range(HASH_BITS // STEP_BITS):
        shift = HASH_BITS - STEP_BITS * (level + 1)
        open_ = state.filter(~F.col("done")).select("source", "low", "rest", "below")
        span = 1 << (shift + STEP_BITS)
        inside = sizes.alias("s").join(open_.alias("o"), F.expr(f"s.source <=> o.source AND s.h >= o.low AND s.h - o.low < {span}"))
        bucket = F.shiftright(F.col("s.h"), shift)
        sums = inside.groupBy(F.col("s.source").alias("source"), bucket.alias("bucket")).agg(
            F.sum("s.size").alias("size"), F.min("s.h").alias("h_min"), F.max("s.h").alias("h_max"), F.first("rest").alias("rest"), F.first("below").alias("below")
        )
        running = sums.withColumn("after", F.col("below") + F.sum("size").over(by_bucket))
        passing = running.filter((F.col("after") > F.col("rest"))).groupBy("source").agg(F.min_by(F.struct("bucket", "after", "size", "h_min", "h_max"), "bucket").alias("b"))
        joined = state.alias("t").join(passing.alias("p"), F.expr("t.source <=> p.source"), "left")
        b, rest, at = F.col("p.b"), F.col("t.rest"), F.col("p.b.after") - F.col("p.b.size")
        one = b["h_min"] == b["h_max"]
        nearer = (b["after"] - rest) < (rest - at)
        active = ~F.col("t.done")
        # no bucket passes: everything inside is under the threshold
        low = F.when(~active, F.col("t.low")).when(b.isNull(), F.col("t.low") + span).when(one & nearer, b["h_max"] + 1).when(one, b["h_max"]).otherwise(F.shiftleft(b["bucket"], shift))
        state = joined.select(
            F.col("t.source").alias("source"), "repeats", F.col("t.rest").alias("rest"), low.alias("low"),
            F.when(active & b.isNotNull(), at).otherwise(F.col("t.below")).alias("below"), (F.col("t.done") | b.isNull() | one).alias("done"),
        )
        state = materialize(state, f"mix-level{level}")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("source", "repeats", F.col("low").alias("threshold"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h of every document."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return sizes.withColumn("h", id_hash(F.col("doc_id")))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target, repeats, threshold: one row per source. ``sizes`` is read several times."""
    goals = materialize(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    cuts = thresholds(sizes, goals)
    return materialize(goals.alias("g").join(cuts.alias("c"), F.expr("g.source <=> c.source")).select("g.*", "repeats", "threshold"), "mix-plan")


def copies(h: Column, most: int = MOST_REPEATS) -> Column:
    """How often the mix takes a document, beside its source's ``repeats`` and ``threshold``."""
    return F.least(F.col("repeats") + F.when(h < F.col("threshold"), 1).otherwise(0), F.lit(most)).cast("int")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies (how often the mix takes it).

    A null source is a source. A null or wordless text has size 0 and takes 0 words. Equal
    doc_ids share their hash and so their fate. An empty table gives no rows. Joins are on
    the source; Spark broadcasts the table of sources where its size allows and splits a hot
    source's rows where not. A text is read whole however long, and only its word count is
    kept. Other columns are ignored.
    """
    sizes = materialize(measured(docs), "mix-sizes")
    rows = sizes.alias("s").join(plan(sizes, weights, most).alias("p"), F.expr("s.source <=> p.source")).withColumn("copies", copies(F.col("h"), most))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, sum(source_size) OVER () AS all_size,
         sum(3 * source_size) OVER r - 3 * source_size AS cap_before,
         sum(weight) OVER () - sum(weight) OVER r + weight AS weight_left
  FROM s WINDOW r AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, encode(source) ROWS UNBOUNDED PRECEDING)),
c AS (
  SELECT *, CAST(all_size - cap_before AS DOUBLE) / CAST(weight_left AS DOUBLE) AS level FROM l),
e AS (
  SELECT *, level * weight >= 3 * source_size AS capped FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE weight * (SELECT level FROM e WHERE NOT capped ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, encode(source) LIMIT 1) END AS target
  FROM e),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
g AS (
  SELECT d.source, d.h, sum(d.size) AS size FROM d GROUP BY d.source, d.h),
a AS (
  SELECT g.source, g.h, q.target - q.repeats * q.source_size AS rest,
         sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS after,
         sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) - g.size AS before
  FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source),
k AS (
  SELECT source, h, after <= rest OR (before <= rest AND after - rest < rest - before) AS one_more FROM a)
SELECT d.doc_id, d.size, q.source_size, q.target,
       CAST(d.size * least(q.repeats + CASE WHEN k.one_more THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken,
       CAST(least(q.repeats + CASE WHEN k.one_more THEN 1 ELSE 0 END, 3) AS INTEGER) AS copies
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
       JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
