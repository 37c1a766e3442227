"""An optional stream: proposals that arrive as files go through the same verification as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from groundline.operators.rules import verified_fields

PROPOSAL = "id long, quote string, cents long"


def verify_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Verify every file that isn't in the checkpoint yet, then stop. A batch is written under its own number, so a repeated batch replaces itself."""

    def verified(batch: DataFrame, number: int) -> None:
        verified_fields(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(PROPOSAL).json(folder).writeStream.foreachBatch(verified).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
