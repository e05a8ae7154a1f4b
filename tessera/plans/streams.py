"""Batch twins of the stream operators, and the streams themselves over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.runtime import scratch_path, table
from tessera.streaming import events as ev


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return table(spark, d, "events").select(F.concat(F.lit("/f"), F.col("user_id")).alias("path"), kind.alias("type"), F.col("event_id").alias("seq"))


@query(
    "coalesce_file_events",
    """
WITH e AS (SELECT '/f' || user_id AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS type, event_id AS seq FROM events),
f AS (SELECT *, max(CASE WHEN type = 'created' THEN seq END) OVER w AS c, max(CASE WHEN type = 'deleted' THEN seq END) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM e WINDOW w AS (PARTITION BY path ORDER BY seq)),
l AS (SELECT *, coalesce(c > coalesce(x, -1), false) AS fresh FROM f QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)
SELECT path, CASE WHEN fresh THEN 'created' ELSE type END AS type, seq FROM l WHERE NOT (fresh AND type = 'deleted')
""",
)
def coalesce_file_events(spark: SparkSession, d: str) -> DataFrame:
    return ev.coalesce_events(_kinds(spark, d))


@query("file_changes", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'create' WHEN doc_id % 5 = 1 THEN 'update' WHEN doc_id % 5 = 2 THEN 'requeue' ELSE 'skip' END AS action FROM documents")
def file_changes(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"))
    known = files.filter("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 5 == 1, "old").otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 5 == 2, "error").otherwise("ready").alias("status"))
    return ev.changes(files, known).select("doc_id", "action")


@query("task_state_machine", """
WITH RECURSIVE e AS (SELECT user_id AS task_id, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'cancel' ELSE 'cancelled' END AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
tr AS (SELECT * FROM (VALUES ('queued', 'start', 'processing'), ('processing', 'complete', 'completed'), ('processing', 'fail', 'failed'), ('queued', 'cancel', 'cancelled'), ('processing', 'cancel', 'cancelling'), ('cancelling', 'cancelled', 'cancelled')) v(s, ev, t)),
r AS (SELECT DISTINCT task_id, 0::BIGINT AS n, 'queued' AS state, 0 AS rejected FROM e
  UNION ALL SELECT r.task_id, e.n, coalesce(tr.t, r.state), r.rejected + CASE WHEN tr.t IS NULL THEN 1 ELSE 0 END FROM r JOIN e ON e.task_id = r.task_id AND e.n = r.n + 1 LEFT JOIN tr ON tr.s = r.state AND tr.ev = e.event)
SELECT task_id, state, CAST(rejected AS INTEGER) AS rejected FROM r QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1
""")
def task_state_machine(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "cancel").otherwise("cancelled")
    return ev.task_states(table(spark, d, "events").select(F.col("user_id").alias("task_id"), kind.alias("event"), F.col("event_id").alias("seq")))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("queued", "processing", "completed", "failed", "cancelled"))), (i % 5 + 1).cast("int"))
    return table(spark, d, "events").select(i.alias("task_id"), F.lit("ns").alias("ns"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("type"), F.unix_timestamp("ts").alias("at_s"), state.alias("state"), (F.unix_timestamp("ts") + i % 7 * 1000).alias("updated_s"), F.unix_timestamp("ts").alias("started_s"), F.col("value").cast("int").alias("priority"), i.cast("string").alias("hash"))


TASKS = "k AS (SELECT event_id AS task_id, user_id AS doc_id, event_type AS type, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, ['queued', 'processing', 'completed', 'failed', 'cancelled'][event_id % 5 + 1] AS state, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 7 * 1000 AS updated_s, CAST(trunc(value) AS INTEGER) AS priority FROM events)"
NOW = 1_705_000_000


@query("debounce_latest", f"WITH {TASKS}, g AS (SELECT *, at_s - lag(at_s) OVER w AS gap FROM k WINDOW w AS (PARTITION BY doc_id, type ORDER BY at_s, task_id)), r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, type ORDER BY at_s, task_id) AS run FROM g) SELECT 'ns' AS ns, doc_id, type, CAST(run AS BIGINT) AS run, min_by(task_id, at_s * 1000000 + task_id) AS task_id, CAST(max_by(task_id, at_s * 1000000 + task_id) AS VARCHAR) AS hash, CAST(count(*) AS BIGINT) AS merged FROM r GROUP BY doc_id, type, run")
def debounce_latest(spark: SparkSession, d: str) -> DataFrame:
    return ev.debounced(_tasks(spark, d), 86_400)


@query("task_sweeps", f"WITH {TASKS} SELECT task_id, CASE WHEN state = 'processing' AND (at_s < {NOW - 86400} OR updated_s < {NOW - 43200}) THEN 'failed' ELSE state END AS state, CASE WHEN state = 'processing' THEN CASE WHEN at_s < {NOW - 86400} THEN 'timeout' WHEN updated_s < {NOW - 43200} THEN 'zombie' END END AS why FROM k")
def task_sweeps(spark: SparkSession, d: str) -> DataFrame:
    return ev.swept(_tasks(spark, d), NOW, 86_400, 43_200).select("task_id", "state", "why")


@query("task_requeue", f"WITH {TASKS} SELECT task_id, CASE WHEN state = 'processing' AND updated_s >= {NOW - 86400} THEN 'queued' ELSE state END AS state FROM k")
def task_requeue(spark: SparkSession, d: str) -> DataFrame:
    return ev.requeued(_tasks(spark, d), NOW, 86_400).select("task_id", "state")


@query("terminal_retention", f"WITH {TASKS} SELECT task_id FROM k WHERE NOT (state IN ('completed', 'failed', 'cancelled') AND updated_s < {NOW - 5 * 86400})")
def terminal_retention(spark: SparkSession, d: str) -> DataFrame:
    return ev.terminal_retained(_tasks(spark, d), NOW, 5).select("task_id")


@query("next_task", f"WITH {TASKS} SELECT task_id, doc_id FROM k WHERE state = 'queued' AND doc_id NOT IN (SELECT doc_id FROM k WHERE state = 'processing' AND task_id % 3 = 0) ORDER BY at_s, task_id LIMIT 1")
def next_task(spark: SparkSession, d: str) -> DataFrame:
    rows = _tasks(spark, d).filter("state <> 'processing' OR task_id % 3 = 0")
    return ev.next_task(rows).select("task_id", "doc_id")


@query("priority_queue", f"WITH {TASKS} SELECT task_id, priority FROM k WHERE state = 'queued' ORDER BY priority DESC, at_s, task_id LIMIT 30")
def priority_queue(spark: SparkSession, d: str) -> DataFrame:
    return ev.queue_order(_tasks(spark, d)).limit(30).select("task_id", "priority")


@query("enrich_due", "SELECT o_custkey AS doc_id, min(o_orderkey) AS due FROM orders WHERE o_orderstatus = 'O' AND o_orderkey <= 5000 GROUP BY 1 ORDER BY 2, 1 LIMIT 40")
def enrich_due(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "pending_retry").otherwise("done").alias("status"), F.col("o_orderkey").alias("next_retry_at"))
    return ev.retry_due(state, 5000, 40)


@query("wal_replay_latest", "SELECT user_id AS label, max(event_id) AS lsn FROM events WHERE event_id > 100 GROUP BY 1 HAVING max_by(event_type, event_id) <> 'error'")
def wal_replay_latest(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "events").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("label"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"))
    return ev.replayed(records, 100)


WINDOWS = "SELECT {start} AS start_s, {start} + {width} AS end_s, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM {src} GROUP BY ALL"


def _seconds(rows: DataFrame) -> DataFrame:
    return rows.select(F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("tumbling_counts", WINDOWS.format(start="CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400", width=86400, src="events"))
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return _seconds(ev.tumbling(_events(spark, d), "1 day"))


@query("sliding_counts", WINDOWS.format(start="(CAST(floor(epoch(ts) / 43200) AS BIGINT) - i) * 43200", width=86400, src="events, (SELECT unnest([0, 1]) AS i)"))
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return _seconds(ev.sliding(_events(spark, d), "1 day", "12 hours"))


@query("session_windows", "WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS s FROM g) SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, s")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(_events(spark, d), "6 hours").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("late_drop", "WITH m AS (SELECT event_id, user_id % 50 AS k, epoch(date_trunc('second', ts)) AS t, max(epoch(date_trunc('second', ts))) OVER (ORDER BY (event_id * 7919) % 10007, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT event_id FROM m WHERE seen IS NULL OR t >= seen - 864000")
def late_drop(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("_order", F.struct((F.col("event_id") * 7919) % 10007, "event_id"))
    return ev.not_late(rows, 864_000, "_order").select("event_id")


@query("interval_join", "SELECT c.event_id AS c_id, p.event_id AS p_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 2 DAY WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    return ev.clicks_to_purchases(_events(spark, d), "2 DAYS").select("c_id", "p_id")


@query("dedup_within_day", "SELECT user_id, event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_s, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_within_day(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_timestamp(F.date_trunc("day", "ts")).alias("day_s")
    return _events(spark, d).groupBy("user_id", "event_type", day).agg(F.min("event_id").alias("event_id"))


@query("stream_tumbling", WINDOWS.format(start="CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400", width=86400, src="events"))
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling query as a stream of the table's files, run to its end and read back."""
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet" if not d.endswith("events.parquet") else "*").parquet(d)
    rows = ev.tumbling(source.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    out = scratch_path(spark, "stream")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    q = rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return _seconds(spark.read.parquet(f"{out}/result"))
