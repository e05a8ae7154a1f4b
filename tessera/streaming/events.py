"""Stream operators, each with the batch function that gives the same result.

Folds that depend on order run per key; windows, late data and deduplication are Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tessera.operators.ordering import max_before

# --- file events ------------------------------------------------------------------------


def fold_event(held: str | None, event: str) -> str | None:
    """What remains of a path's earlier event and the next one; None: nothing happened."""
    if held == "created":
        return None if event == "deleted" else "created"
    return event


def coalesce_events(events: DataFrame) -> DataFrame:
    """path, type, seq of what is left per path: (path, type, seq) folded in order.

    A window finds the last point where a path was created and then deleted; what follows
    starts afresh. So the fold is two windows and an aggregate, not a loop per path.
    """
    order = Window.partitionBy("path").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("type", F.when(F.col("type").isin("created", "deleted"), F.col("type")).otherwise("modified"))
    # a creation opens a run unless one is open; a deletion closes it: the last of the two tells
    creation = F.max(F.when(F.col("type") == "created", F.col("seq"))).over(upto)
    deletion = F.max(F.when(F.col("type") == "deleted", F.col("seq"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce(creation > F.coalesce(deletion, F.lit(-1)), F.lit(False)))
    last = rows.groupBy("path").agg(F.max_by(F.struct("type", "fresh", "seq"), "seq").alias("l"))
    kind = F.when(F.col("l.fresh") & (F.col("l.type") == "deleted"), F.lit(None)).when(F.col("l.fresh"), "created").otherwise(F.col("l.type"))
    return last.select("path", kind.alias("type"), F.col("l.seq").alias("seq")).filter(F.col("type").isNotNull())


def coalesce_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream: each batch gives a path's state after it; None tells it is gone."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind in rows["type"]:
            held = fold_event(held, kind if kind in ("created", "deleted") else "modified")
        if held is None:
            state.remove()
        else:
            state.update((held,))
        yield pd.DataFrame({"path": [key[0]], "type": [held], "seq": [int(rows["seq"].max())]})

    return events.groupBy("path").applyInPandasWithState(step, "path string, type string, seq long", "type string", "update", "NoTimeout")


def changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """What to do with each file on disk: create, skip, requeue (pending or failed), or update."""
    old = known.select("path", F.col("hash").alias("old_hash"), F.col("status").alias("old_status"))
    action = F.when(F.col("old_hash").isNull(), "create").when(F.col("old_hash") != F.col("hash"), "update").when(F.col("old_status").isin("pending", "error"), "requeue").otherwise("skip")
    return files.join(old, "path", "left").withColumn("action", action).drop("old_hash", "old_status")


def fan_out(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Give one batch to every subscriber; a failing one doesn't stop the others."""
    failed, held = {}, batch.persist()
    try:
        for name, sink in sinks.items():
            try:
                sink(held)
            except Exception as e:  # the contract: subscribers are independent
                failed[name] = f"{type(e).__name__}: {e}"
    finally:
        held.unpersist()
    return failed


# --- tasks ------------------------------------------------------------------------------

# Fixed values: (state, event) to state.
TRANSITIONS = {
    ("queued", "start"): "processing", ("processing", "complete"): "completed", ("processing", "fail"): "failed",
    ("queued", "cancel"): "cancelled", ("processing", "cancel"): "cancelling", ("cancelling", "cancelled"): "cancelled",
}


def task_states(events: DataFrame) -> DataFrame:
    """task_id, state, rejected: events (task_id, event, seq) applied in order from ``queued``."""
    table = F.create_map(*[x for (s, e), t in TRANSITIONS.items() for x in (F.lit(f"{s}/{e}"), F.lit(t))])
    ordered = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("es"))
    start = F.struct(F.lit("queued").alias("state"), F.lit(0).alias("rejected"))

    def step(acc, x):
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("/"), x["event"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["rejected"] + F.when(to.isNull(), 1).otherwise(0)).alias("rejected"))

    return ordered.select("task_id", F.aggregate("es", start, step).alias("f")).select("task_id", "f.state", "f.rejected")


def debounced(tasks: DataFrame, seconds: int) -> DataFrame:
    """The first of each run of requests for (ns, doc, type) that are closer than ``seconds``, with the last hash."""
    order = Window.partitionBy("ns", "doc_id", "type").orderBy("at_s", "task_id")
    gap = F.col("at_s") - F.lag("at_s").over(order)
    runs = tasks.withColumn("run", F.sum(F.when(gap.isNull() | (gap > seconds), 1).otherwise(0)).over(order))
    return runs.groupBy("ns", "doc_id", "type", "run").agg(F.min_by("task_id", F.struct("at_s", "task_id")).alias("task_id"), F.max_by("hash", F.struct("at_s", "task_id")).alias("hash"), F.count("*").alias("merged"))


def swept(tasks: DataFrame, now_s: int, timeout_s: int, zombie_s: int) -> DataFrame:
    """Tasks that ran too long or stand still become failed."""
    late = F.col("started_s") < now_s - timeout_s
    still = F.col("updated_s") < now_s - zombie_s
    state = F.when((F.col("state") == "processing") & (late | still), "failed").otherwise(F.col("state"))
    return tasks.withColumn("why", F.when(F.col("state") == "processing", F.when(late, "timeout").when(still, "zombie"))).withColumn("state", state)


def requeued(tasks: DataFrame, now_s: int, zombie_s: int) -> DataFrame:
    fresh = (F.col("state") == "processing") & (F.col("updated_s") >= now_s - zombie_s)
    return tasks.withColumn("state", F.when(fresh, "queued").otherwise(F.col("state")))


def terminal_retained(tasks: DataFrame, now_s: int, days: int) -> DataFrame:
    return tasks.filter(~(F.col("state").isin("completed", "failed", "cancelled") & (F.col("updated_s") < now_s - days * 86400)))


def next_task(tasks: DataFrame) -> DataFrame:
    """The oldest queued task of a document that isn't being processed."""
    busy = tasks.filter("state = 'processing'").select("doc_id").distinct()
    return tasks.filter("state = 'queued'").join(busy, "doc_id", "left_anti").orderBy("at_s", "task_id").limit(1)


def queue_order(tasks: DataFrame) -> DataFrame:
    """Waiting tasks by priority, then age."""
    return tasks.filter("state = 'queued'").orderBy(F.desc("priority"), "at_s", "task_id")


def retry_due(state: DataFrame, now_s: int, n: int) -> DataFrame:
    due = state.filter((F.col("status") == "pending_retry") & (F.col("next_retry_at") <= now_s))
    return due.groupBy("doc_id").agg(F.min("next_retry_at").alias("due")).orderBy("due", "doc_id").limit(n)


def leased(state: DataFrame, docs: DataFrame, until_s: int) -> DataFrame:
    taken = docs.select("doc_id").distinct().withColumn("taken", F.lit(True))
    return state.join(taken, "doc_id", "left").withColumn("next_retry_at", F.when(F.col("taken"), F.lit(until_s)).otherwise(F.col("next_retry_at"))).drop("taken")


def replayed(records: DataFrame, snapshot_lsn: int) -> DataFrame:
    """Labels that live after a log: the last record of each beyond the snapshot wins."""
    last = records.filter(F.col("lsn") > snapshot_lsn).groupBy("label").agg(F.max_by("op", "lsn").alias("op"), F.max("lsn").alias("lsn"))
    return last.filter("op = 'insert'").drop("op")


# --- event time -------------------------------------------------------------------------


def tumbling(events: DataFrame, width: str, delay: str | None = None) -> DataFrame:
    return sliding(events, width, width, delay)


def sliding(events: DataFrame, width: str, step: str, delay: str | None = None) -> DataFrame:
    """Counts and sums by window and event type; with a delay late rows are dropped by watermark."""
    rows = events.withWatermark("ts", delay) if delay else events
    found = rows.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", delay) if delay else events
    found = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_stream(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def not_late(events: DataFrame, delay_s: int, order: str = "event_id") -> DataFrame:
    """Batch form of dropping late rows: behind the greatest earlier time by more than the delay."""
    rows = max_before(events, "_seen", F.unix_timestamp("ts"), order)
    return rows.filter(F.col("_seen").isNull() | (F.unix_timestamp("ts") >= F.col("_seen") - delay_s)).drop("_seen")


def clicks_to_purchases(events: DataFrame, within: str, delay: str | None = None) -> DataFrame:
    """Each purchase with its user's clicks in the time before it: an interval join, stream or batch."""
    side = lambda kind, p: events.filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"))
    clicks, buys = side("click", "c"), side("purchase", "p")
    if delay:
        clicks, buys = clicks.withWatermark("c_ts", delay), buys.withWatermark("p_ts", delay)
    return clicks.join(buys, F.expr(f"c_user = p_user AND c_ts <= p_ts AND c_ts >= p_ts - INTERVAL {within}"))
