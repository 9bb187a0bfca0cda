"""Cleaning and enrichment of a stream, stored idempotently by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geolith.operators import clean, enrich
from geolith.sources import files


def clean_stream(raw: DataFrame) -> DataFrame:
    """Rules 1 to 6 and the derived columns; both look at one row at a time. Repeated keys are left to the store.

    Each row is an array of one when it is parsed: without that, the parsing of a text stands in the plan wherever its value is asked
    for, some hundred times a row, and the compiled code is too long to be fast.
    """
    judged = clean._typed(raw).withColumn("drop_reason", clean.drop_reason(raw.columns))
    rows = judged.select(F.inline(F.array(F.struct("*")))).where("drop_reason IS NULL").drop("drop_reason")
    return enrich.enriched(rows.withColumn("severity", F.col("severity").cast("int")))


def store_stream(events: DataFrame, path: str, checkpoint: str, key: str = "accident_id") -> StreamingQuery:
    """Appends every micro-batch by key; a batch that runs again after a failure adds nothing twice.

    The append reads its rows up to three times, so a batch is kept while it lasts and cleaned once.
    """

    def append(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            files.append_new(batch, path, key)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
