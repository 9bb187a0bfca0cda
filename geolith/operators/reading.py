"""Pages of the aggregate tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.operators.filters import check_page

#: Each table's order unless another is asked for (column, ascending) and the key that breaks ties.
ORDERS = {"grid": ("count", False, ["grid_id"]), "geohash": ("count", False, ["geohash"]), "hotspots": ("rank", True, ["grid_id"]), "temporal": ("bucket", True, ["dimension"]), "state": ("count", False, ["state"])}


def read_aggregate(tables: dict[str, DataFrame], name: str, limit: int = 100, skip: int = 0, dimension: str | None = None, min_count: int | None = None, bbox: tuple[float, float, float, float] | None = None, sort_by: str | None = None, ascending: bool = False) -> DataFrame:
    """A page of an aggregate table; ``bbox`` is min_lon, min_lat, max_lon, max_lat around the centroid."""
    if name not in ORDERS:
        raise ValueError(f"unknown aggregate {name!r}; there are {', '.join(ORDERS)}")
    check_page(limit, skip)
    df = tables[name]
    if dimension:
        df = df.where(F.col("dimension") == dimension)
    if min_count is not None:
        df = df.where(F.col("count") >= min_count)
    if bbox:
        xy = F.col("centroid.coordinates")
        df = df.where(geo.in_polygons(xy[1], xy[0], geo.box_rings(*bbox)))
    column, up, ties = ORDERS[name]
    if sort_by:
        column, up = sort_by, ascending
    return df.orderBy(F.col(column).asc() if up else F.col(column).desc(), *ties).offset(skip).limit(limit)


def matching(tables: dict[str, DataFrame], name: str, min_count: int = 0) -> DataFrame:
    return tables[name].where(F.col("count") >= min_count).agg(F.count("*").alias("total_matching"))


# --- pages of a stored order ---

#: The bits of a row's number in its range.
_AT_BITS = 33


class Place(NamedTuple):
    """Where the next page begins: a range of the stored order, and a row of it."""

    range: int
    at: int


class OrderedPages:
    """A table stored in an order, with a directory of its ranges, so that any page is read alone.

    Rows know their number in their range, ranges their first rank: a page is a few numbers of one range or of some next
    to each other. Other ranges are not opened, and of a range's file only row groups that hold the numbers are read.
    """

    def __init__(self, spark: SparkSession, path: str):
        columns = spark.read.parquet(f"{path}/columns").schema
        self.rows = spark.read.schema(columns).parquet(f"{path}/rows")
        self.sizes: list[tuple[int, int]] = sorted((r._range, r.n) for r in spark.read.parquet(f"{path}/ranges").collect())  # a row for each range

    @classmethod
    def store(cls, df: DataFrame, path: str, order: Sequence[Column], n_ranges: int | None = None) -> OrderedPages:
        """``order`` should be total, or pages are not the same each time they are stored."""
        ranged = df.repartitionByRange(n_ranges, *order) if n_ranges else df.repartitionByRange(*order)
        ranged = ranged.withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *order)
        ranged = ranged.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _AT_BITS) - 1)))
        ranged.write.option("parquet.block.size", 8 << 20).partitionBy("_range").parquet(f"{path}/rows")
        spark = df.sparkSession
        ranged.limit(0).write.parquet(f"{path}/columns")  # an empty order has no file that tells them
        spark.read.schema(ranged.schema).parquet(f"{path}/rows").groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/ranges")
        return cls(spark, path)

    def place(self, rank: int) -> Place | None:
        """Of the row with this rank, from 0."""
        for key, n in self.sizes:
            if rank < n:
                return Place(key, rank)
            rank -= n
        return None

    def page(self, limit: int, start: Place | int = 0) -> tuple[DataFrame, Place | None]:
        """Rows from a place or rank on, in order, and where the next page begins (None: nowhere)."""
        begin = self.place(start) if isinstance(start, int) else start
        keys, left, at = [], limit, begin.at if begin else 0
        following = None
        for key, n in self.sizes:
            if begin is None or key < begin.range:
                continue
            if left <= 0:
                following = following or Place(key, 0)
                break
            end = min(n, at + left)
            keys.append((F.col("_range") == key) & (F.col("_at") >= at) & (F.col("_at") < end))
            left -= end - at
            if end < n:
                following = Place(key, end)
                break
            at = 0
        wanted = F.lit(False)
        for k in keys:
            wanted = wanted | k
        return self.rows.where(wanted).orderBy("_range", "_at").drop("_range", "_at"), following
