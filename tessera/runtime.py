"""Session helpers: shared scratch space, table loading and worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Upper bound of one Arrow batch handed to a Python worker, so that long texts cannot swell it.
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and bound their Arrow batches.

    On a cluster the package is shipped with ``--py-files``; when workers see the same
    folder as the driver, the path set here is enough.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    env.setdefault("OMP_NUM_THREADS", "1")  # a task has one core; more threads only get in each other's way
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor sees.

    Only when a session on this machine alone names none (tests, notebooks) a temporary one
    is made and set; on a cluster that is an error, for no other machine would see it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        base = str(known.get()) if known.isDefined() else ""
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage at a replicated place: a lost executor costs a re-read, never a
    recomputation of what stands above.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores, dealt over all cores.

    For scans below long work on every row: one large row group would be one task. A table
    of many files has partitions enough and comes back as it is, as does a stream.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan, used before a broadcast is chosen."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def local_session(app: str = "tessera", cpus: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return prepare(builder.getOrCreate())
