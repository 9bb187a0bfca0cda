"""Reproducible samples of whole blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolith.sources.shared import shared_dir


def file_blocks(df: DataFrame) -> DataFrame:
    """Adds ``block``: the file and the start of the split that a row was read from. Splits follow spark.sql.files.maxPartitionBytes."""
    return df.withColumn("block", F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string")))


def block_sample(df: DataFrame, block: str, target_rows: int, seed: int = 42, sequential: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """The rows of whole blocks, in the order of a seeded hash of the block (or of the block itself), until ``target_rows`` are reached.

    ``sizes`` holds the rows that count, with their blocks: ``df`` itself, or what is left of it. Blocks are put in order by
    ranges; only the sum of each range meets the others in one task.
    """
    order: Column = F.col(block) if sequential else F.md5(F.concat_ws(":", F.col(block).cast("string"), F.lit(str(seed))))
    counted = (df if sizes is None else sizes).groupBy(block).agg(F.count("*").alias("_n")).withColumn("_order", order)
    path = shared_dir(df.sparkSession, "blocks")
    counted.repartitionByRange("_order", block).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    starts = ranged.groupBy("_range").agg(F.sum("_n").alias("_rows"))
    starts = starts.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("_order", block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = ranged.withColumn("_within", within).join(F.broadcast(starts), "_range").where(F.col("_start") + F.col("_within") < target_rows).select(F.col(block).alias("_chosen"))
    return df.join(chosen, F.col(block).eqNullSafe(F.col("_chosen")), "left_semi")
