"""A store of contents by their hash: each content once, found by reading one folder of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_hash string, size_bytes long, content binary, prefix string"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All contents of the store; an absent folder is an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def put(contents: DataFrame, folder: str) -> None:
    """Write the contents (binary ``content``) that aren't there yet; nulls are left out."""
    spark = contents.sparkSession
    named = contents.filter(F.col("content").isNotNull()).select(F.sha2("content", 256).alias("file_hash"), F.octet_length("content").cast("long").alias("size_bytes"), "content")
    fresh = named.dropDuplicates(["file_hash"]).join(stored(spark, folder).select("file_hash"), "file_hash", "left_anti")
    fresh.withColumn("prefix", F.substring("file_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(folder)


def get(spark: SparkSession, folder: str, hashes: list[str]) -> DataFrame:
    """file_hash, size_bytes, content of the hashes: only their prefixes' folders are read."""
    prefixes = sorted({h[:2] for h in hashes})
    return stored(spark, folder).filter(F.col("prefix").isin(*prefixes) & F.col("file_hash").isin(*hashes)).drop("prefix") if hashes else stored(spark, folder).drop("prefix").limit(0)


def drop(spark: SparkSession, folder: str, gone: DataFrame) -> DataFrame:
    """What is left without the hashes of ``gone`` (file_hash): the caller writes it anew."""
    return stored(spark, folder).join(gone.select("file_hash").distinct(), "file_hash", "left_anti")
