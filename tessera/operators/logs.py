"""Operation log, traces, sessions and interactions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def operation_log(rows: DataFrame, *, actions: Sequence[str] | None = None, since_ms: int | None = None, until_ms: int | None = None, **equal: str | None) -> DataFrame:
    """Rows that pass every given test: equality on named columns, an action list, a time range."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    if actions:
        tests.append(F.col("action").isin(*actions))
    if since_ms is not None:
        tests.append(F.col("timestamp") >= since_ms)
    if until_ms is not None:
        tests.append(F.col("timestamp") <= until_ms)
    return rows.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def retained(rows: DataFrame, cutoff_ms: int, most: int, time_col: str = "timestamp", id_col: str = "id") -> DataFrame:
    """Rows young enough, and of those the newest ``most`` (0: all).

    The quota is found by counting per day first: only the one day in which it runs out is
    ranked row by row, so nothing sorts the whole log.
    """
    young = rows.filter(F.col(time_col) >= cutoff_ms)
    if most <= 0:
        return young
    day = F.floor(F.col(time_col) / 86_400_000)
    per_day = young.groupBy(day.alias("d")).agg(F.count("*").alias("n"))
    newer = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    quota = per_day.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
    state = quota.select("d", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(most) - F.col("newer"))).alias("keep"), "n").filter("keep > 0")
    joined = young.withColumn("d", day).join(state, "d")
    whole = joined.filter("keep = n")
    order = Window.partitionBy("d").orderBy(F.desc(time_col), F.desc(id_col))
    part = joined.filter("keep < n").withColumn("_n", F.row_number().over(order)).filter("_n <= keep").drop("_n")
    return whole.unionByName(part).drop("d", "keep", "n")


def log_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def session_summary(traces: DataFrame) -> DataFrame:
    return traces.groupBy("session_id").agg(
        F.count("*").alias("calls"), F.coalesce(F.min("created_at"), F.lit(0)).alias("first_at"), F.coalesce(F.max("created_at"), F.lit(0)).alias("last_at"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"),
    )


def idle_sessions(traces: DataFrame, now_ms: int, idle_ms: int) -> DataFrame:
    """A closing row for each agent session that is quiet for long and has no end yet."""
    ended = F.sum(F.when(F.col("method").isin("session_end", "session_timeout"), 1).otherwise(0))
    quiet = traces.filter("source = 'mcp'").groupBy("session_id").agg(F.max("created_at").alias("last_at"), ended.alias("ends"))
    rows = quiet.filter((F.col("last_at") < now_ms - idle_ms) & (F.col("ends") == 0))
    return rows.select("session_id", F.lit("session_timeout").alias("method"), "last_at", F.lit(now_ms).cast("long").alias("created_at"))


def interactions(rows: DataFrame, user_id: str | None = None, session_id: str | None = None, role: str | None = None) -> DataFrame:
    for column, value in (("user_id", user_id), ("session_id", session_id), ("role", role)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def source_attribution(sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per interaction: its sources, how many of their blocks are gone, the mean relevance."""
    there = blocks.select(F.col("block_id").alias("source_block_id")).distinct().withColumn("there", F.lit(1))
    return sources.join(there, "source_block_id", "left").groupBy("interaction_id").agg(
        F.count("*").alias("sources"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("deleted"), F.round(F.avg("relevance"), 6).alias("mean_relevance")
    )


def first_owner(traces: DataFrame, owners: DataFrame) -> DataFrame:
    """The namespace that a trace belongs to: its first one in order that exists."""
    return traces.join(owners, "namespace_id").groupBy("trace_id").agg(F.min_by("namespace_id", "at").alias("namespace_id"))


def latency_histogram(rows: DataFrame, column: str, bounds: Sequence[float], by: str) -> DataFrame:
    """Cumulative buckets as a metrics exporter has them: (by, le, n), the last one of infinity.

    One conditional count a bound, in one aggregate; bounds are unfolded from its one row a group.
    """
    every = [*map(float, bounds), float("inf")]
    one = rows.groupBy(by).agg(*(F.count(F.when(F.col(column) <= b, 1)).alias(f"_{i}") for i, b in enumerate(every)))
    return one.select(by, F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(every)))).alias("b")).select(by, "b.le", "b.n")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """column, n: how many rows are in each state."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def distinct_key(rows: DataFrame, column: str, path: str) -> DataFrame:
    """value: the different values that a JSON column has at a path."""
    return rows.select(F.get_json_object(column, path).alias("value")).distinct()
