"""Tables that outlive executors: written to the shared folder of the cluster, then read back.

The folder is the one in ``spark.checkpoint.dir``. Only where that is unset (local tests) a folder of
this machine is taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; on a cluster without the setting this is an error, as local folders are not shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="braidwork-")
    return _local[app]


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/braidwork/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Tasks for each core of the cluster, so that slow ones do not keep the others waiting.
TASKS_PER_CORE = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, as read from files, dealt out by keys where it comes in fewer tasks than that: a file of a few MB is one task, whatever is to be done for each of its rows."""
    least = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least, *keys) if df.rdd.getNumPartitions() < least else df
