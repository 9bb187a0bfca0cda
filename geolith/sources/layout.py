"""Tables of points in files that are close together in space, and a directory of what each file holds.

Rows are put in order of a space-filling curve (the bits of longitude and latitude in turns, as geohashes have them) by ranges, so each file
and each row group of it covers a small area. The directory has the bounds of each file: a search opens only files whose
bounds meet its box, and the row groups' statistics do the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geo, rings
from geolith.operators.filters import check_range

#: Characters of the geohash that orders rows: 40 bits, cells of 40 metres.
CURVE = 8
#: Bytes of a row group, so that one file has several.
ROW_GROUP_BYTES = 8 << 20


def write_clustered(df: DataFrame, path: str, n_files: int | None = None) -> None:
    """Writes a table with columns lat and lon below ``path``; rows without a valid point are in the first files."""
    spark = df.sparkSession
    keyed = df.withColumn("_curve", geo.geohash(F.col("lat"), F.col("lon"), CURVE))
    ranged = keyed.repartitionByRange(n_files, "_curve") if n_files else keyed.repartitionByRange("_curve")
    ranged.sortWithinPartitions("_curve").drop("_curve").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), *bounds).coalesce(1).write.parquet(f"{path}/files")


def files_where(spark: SparkSession, path: str, boxes: Sequence[tuple[float, float, float, float]]) -> list[str]:
    """The files that may hold points of some boxes (min_lat, max_lat, min_lon, max_lon)."""
    meets = F.lit(False)
    for south, north, west, east in boxes:
        meets = meets | ((F.col("min_lat") <= north) & (F.col("max_lat") >= south) & (F.col("min_lon") <= east) & (F.col("max_lon") >= west))
    return sorted(r.file for r in spark.read.parquet(f"{path}/files").where(meets).select("file").collect())  # names of files to open


def _read(spark: SparkSession, path: str, boxes: Sequence[tuple[float, float, float, float]]) -> DataFrame:
    kind = spark.read.parquet(f"{path}/rows").schema
    found = files_where(spark, path, boxes)
    return spark.read.schema(kind).parquet(*found) if found else spark.createDataFrame([], kind)


def read_near(spark: SparkSession, path: str, lat: float, lon: float, radius_m: float) -> DataFrame:
    """The rows of all files that may hold points within the radius: give them to ``spatial.near`` and its kin."""
    check_range("lat", lat, -90, 90)
    check_range("lon", lon, -180, 180)
    return _read(spark, path, geo.near_boxes(lat, lon, radius_m))


def read_within(spark: SparkSession, path: str, polygons: Sequence[Sequence[rings.Ring]]) -> DataFrame:
    """The rows of all files that may hold points of a multipolygon."""
    geo.check_polygons(polygons)
    south, north, stretches = rings.bounds(polygons)
    stretches = [*stretches, (180.0, 180.0)] if any(a == -180 for a, _ in stretches) else stretches
    return _read(spark, path, [(south - 1e-3, north + 1e-3, a, b) for a, b in stretches])

