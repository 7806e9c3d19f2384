"""What a source is, and the order in which sources come together."""

from __future__ import annotations

from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.schema import as_records


class SourceAdapter(Protocol):
    """Anything that reads records; rec_id need only be ordered within the source."""

    def can_handle(self, path: str) -> bool: ...

    def read(self, spark: SparkSession, path: str) -> DataFrame: ...


def safely(read, spark: SparkSession, source: str, path: str) -> DataFrame:
    """read(spark, path), or one record with the error if Spark or the file system refuses the path; other errors are raised."""
    from braidwork.sources.csv import error_record

    try:
        return read(spark, path)
    except (PySparkException, OSError) as e:
        return error_record(spark, source, path, f"{type(e).__name__}: {str(e)[:200]}")


def collected(parts: list[DataFrame]) -> DataFrame:
    """All records; rec_id leads with the place of the source, so that earlier sources come first. Room for 2^44 partition-row numbers each."""
    out = None
    for i, part in enumerate(parts):
        # monotonically_increasing_id has the partition above bit 33; 11 bits of it and 33 of the row stay apart below bit 44.
        part = as_records(part).withColumn("rec_id", F.lit(i).cast("long") * (1 << 44) + F.col("rec_id"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source given")
    return out
