"""Structured Streaming into a ledger: each micro-batch is one ingest; results come from closing alone."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.ledger import Ledger
from ..sources.evidence import OBSERVATION


def stream_evidence(ledger: Ledger, folder: str, checkpoint: str, files: int = 100):
    """Parquet observations that arrive in a folder; redelivered records are dropped against the table."""
    rows = ledger.spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files).parquet(folder)

    def put(batch: DataFrame, _: int) -> None:
        ledger.ingest(batch)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
