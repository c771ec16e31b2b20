"""Validated append as a stream (addition to E1): accepted and quarantined rows per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import split_valid, validate_rows


def append_stream(rows: DataFrame, accepted: str, quarantine: str, checkpoint: str, required: Sequence[str], score: str,
                  low: float = 0, high: float = 9, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch overwrites its own `batch=<id>` folder, so a replayed batch leaves one copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_rows(batch, required, score, low, high)
        # both outputs come from one read of the batch
        checked.persist()
        good, bad = split_valid(checked)
        good.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        checked.unpersist()

    stream = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def read_batches(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("batch")


def count_by_reason(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
