"""Derived columns, and the document form of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.functions.values import finite

CELL_DEG = 0.1
PRECISION = 5

#: What a query returns of an event unless told otherwise.
DEFAULT_PROJECTION = ["accident_id", "severity", "start_time", "end_time", "city", "county", "state", "weather", "distance_mi", "temperature_f", "visibility_mi", "day_night", "lat", "lon", "location"]


def enriched(df: DataFrame, cell: float = CELL_DEG, precision: int = PRECISION) -> DataFrame:
    """Adds grid anchor and id, geohash, and the calendar columns."""
    lat, lon, t = F.col("lat"), F.col("lon"), F.col("start_time")
    glat, glon = geo.cell_anchor(lat, cell), geo.cell_anchor(lon, cell)
    dow = F.weekday(t)
    return df.withColumns(
        {
            "grid_lat": glat,
            "grid_lon": glon,
            "grid_id": geo.grid_id(glat, glon),
            "geohash": geo.geohash(lat, lon, precision),
            "year": F.year(t),
            "month": F.month(t),
            "day": F.dayofmonth(t),
            "hour": F.hour(t),
            "dow": dow,
            "is_weekend": dow >= 5,
        }
    )


def documents(df: DataFrame) -> DataFrame:
    """Events with a GeoJSON ``location``; doubles that are no numbers become null."""
    doubles = {c: finite(F.col(c)) for c, kind in df.dtypes if kind == "double"}
    return df.withColumns(doubles).withColumn("location", geo.point(F.col("lat"), F.col("lon")))


def projected(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The default projection, as far as the table has its columns."""
    return df.select(*[c for c in (columns or DEFAULT_PROJECTION) if c in df.columns])


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; times are ISO 8601 with their offset."""
    zoned = df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
    return zoned.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"}).alias("json"))
