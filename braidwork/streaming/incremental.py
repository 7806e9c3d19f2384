"""Records that arrive as a stream: each micro-batch is validated and appended, its profiles are versioned.

An extension; clusters of the whole table are rebuilt by a batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from braidwork.config import EngineConfig
from braidwork.operators.validate import validate
from braidwork.plans.engine import normalize


def append_stream(records: DataFrame, path: str, checkpoint: str, cfg: EngineConfig | None = None):
    """A running query that writes each batch's validated records under path, one folder per batch, so a repeated batch overwrites itself."""
    cfg = cfg or EngineConfig()

    def batch(df: DataFrame, number: int) -> None:
        validate(normalize(df, cfg), cfg).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
