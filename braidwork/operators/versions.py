"""Versions of profiles: an append-only table of (candidate_id, version, created_at, sources, snapshot_hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.operators.score import snapshot_hash

SCHEMA = "candidate_id string, version int, created_at timestamp, sources array<string>, snapshot_hash string"


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def snapshot(profiles: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The next version of every profile; known is the table so far."""
    now = profiles.select("candidate_id", F.current_timestamp().alias("created_at"), F.array_sort("sources").alias("sources"), snapshot_hash(F.col("full_name"), F.array_sort("emails"), F.array_sort("phones")).alias("snapshot_hash"))
    last = known.groupBy("candidate_id").agg(F.max("version").alias("_last")) if known is not None else None
    joined = now.join(last, "candidate_id", "left") if last is not None else now.withColumn("_last", F.lit(None).cast("int"))
    return joined.select("candidate_id", (F.coalesce("_last", F.lit(0)) + 1).alias("version"), "created_at", "sources", "snapshot_hash")


def numbered(events: DataFrame, key: str, *order: str) -> DataFrame:
    """events with version, counted per key in the given order."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def append(versions: DataFrame, path: str) -> None:
    versions.write.mode("append").parquet(path)
