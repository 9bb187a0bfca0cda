"""Ordered cleaning rules with an account of every rejected row.

The first rule that fails owns the row, so the counters are disjoint and add up to the rows read. One CASE
expression tags a row; the rule on repeated keys looks only at rows that the others keep and is global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions.geo import grid_id
from geolith.functions.values import to_number, to_time
from geolith.sources.shared import stored

#: Names of the raw columns and of the clean ones.
COLUMN_MAP = {
    "ID": "accident_id",
    "Severity": "severity",
    "Start_Time": "start_time",
    "End_Time": "end_time",
    "Start_Lat": "lat",
    "Start_Lng": "lon",
    "Distance(mi)": "distance_mi",
    "City": "city",
    "County": "county",
    "State": "state",
    "Temperature(F)": "temperature_f",
    "Visibility(mi)": "visibility_mi",
    "Weather_Condition": "weather",
    "Sunrise_Sunset": "day_night",
}

#: The rules in their order.
REASONS = ("null_coords", "out_of_range", "zero_island", "outside_box", "bad_time", "bad_severity", "duplicate")

#: The box that events must lie in (min_lat, max_lat, min_lon, max_lon).
BOX = (17.5, 72.0, -180.0, -64.5)


def renamed(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(COLUMN_MAP)


def _typed(raw: DataFrame) -> DataFrame:
    for need in ("lat", "lon"):
        if need not in raw.columns:
            raise ValueError(f"the raw table has no column {need}")
    numbers = {c: to_number(F.col(c)) for c in ("lat", "lon", "severity", "distance_mi", "temperature_f", "visibility_mi") if c in raw.columns}
    numbers = {c: F.when(~F.isnan(x), x) for c, x in numbers.items()}
    times = {c: to_time(F.col(c)) for c in ("start_time", "end_time") if c in raw.columns}
    return raw.withColumns(numbers | times)


def drop_reason(columns: list[str], box: tuple[float, float, float, float] = BOX) -> Column:
    """Rules 1 to 6 over typed columns; null where the row is kept."""
    lat, lon = F.col("lat"), F.col("lon")
    reason = (
        F.when(lat.isNull() | lon.isNull(), "null_coords")
        .when(~lat.between(-90, 90) | ~lon.between(-180, 180), "out_of_range")
        .when((lat == 0) & (lon == 0), "zero_island")
        .when(~lat.between(box[0], box[1]) | ~lon.between(box[2], box[3]), "outside_box")
    )
    if "start_time" in columns:
        reason = reason.when(F.col("start_time").isNull(), "bad_time")
    if "severity" in columns:
        reason = reason.when(~F.coalesce(F.col("severity").isin(1.0, 2.0, 3.0, 4.0), F.lit(False)), "bad_severity")
    return reason


def tagged(raw: DataFrame, position: str | Column = "pos", box: tuple[float, float, float, float] = BOX) -> DataFrame:
    """The typed rows with ``drop_reason``. ``position`` orders rows as the source does; rows that earlier rules reject never shadow others.

    The source is read and parsed once, when this is called: the rows with the verdict of rules 1 to 6 are written to the shared folder.
    Rule 7 reads ids and positions of the rows that are kept back from there, and ids that occur twice, which are few and a table of
    known size, meet the rows when these are read.
    """
    out = _typed(raw).withColumn("drop_reason", drop_reason(raw.columns, box))
    if "accident_id" in raw.columns:
        at = F.col(position) if isinstance(position, str) else position
        out = stored(out.withColumn("_at", at), "parsed")
        twice = out.where("drop_reason IS NULL").groupBy(F.col("accident_id").alias("_id")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        twice = stored(twice, "repeated")
        later = F.col("drop_reason").isNull() & (F.col("_at") > F.col("_first"))
        out = out.join(twice, F.col("accident_id").eqNullSafe(F.col("_id")), "left").withColumn("drop_reason", F.when(later, "duplicate").otherwise(F.col("drop_reason"))).drop("_at", "_id", "_first")
    return out.withColumn("severity", F.when(F.col("drop_reason").isNull(), F.col("severity")).cast("int")) if "severity" in raw.columns else out


def kept(tagged_rows: DataFrame) -> DataFrame:
    return tagged_rows.where("drop_reason IS NULL").drop("drop_reason")


def stats(tagged_rows: DataFrame) -> DataFrame:
    """One row: a counter per rule, rows_in, rows_out, dropped_total and retention_pct."""
    counters = [F.count_if(F.col("drop_reason") == r).alias(r) for r in REASONS]
    out = tagged_rows.agg(*counters, F.count("*").alias("rows_in"), F.count_if(F.col("drop_reason").isNull()).alias("rows_out"))
    out = out.withColumn("dropped_total", F.col("rows_in") - F.col("rows_out"))
    return out.withColumn("retention_pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("rows_out"), F.col("rows_in")), 2), F.lit(0.0)))


def merged_stats(many: DataFrame) -> DataFrame:
    """Stats of parts as the stats of the whole."""
    sums = [F.sum(c).alias(c) for c in (*REASONS, "rows_in", "rows_out", "dropped_total")]
    return many.agg(*sums).withColumn("retention_pct", F.coalesce(F.round(F.try_divide(100.0 * F.col("rows_out"), F.col("rows_in")), 2), F.lit(0.0)))


def shares(one: DataFrame) -> DataFrame:
    """``rule, dropped, share_pct`` of each rule against rows_in."""
    long = one.unpivot(["rows_in"], list(REASONS), "rule", "dropped")
    return long.select("rule", "dropped", F.coalesce(F.round(F.try_divide(100.0 * F.col("dropped"), F.col("rows_in")), 2), F.lit(0.0)).alias("share_pct"))


# --- checks of clean data ---


def document_error(location: Column, severity: Column) -> Column:
    """Why a document is not valid; null where it is."""
    xy = location["coordinates"]
    return (
        F.when(location.isNull(), "no location")
        .when(~location["type"].eqNullSafe("Point"), "not a point")
        .when(xy.isNull() | (F.size(xy) != 2), "not two coordinates")
        .when(F.get(xy, F.lit(0)).isNull() | F.get(xy, F.lit(1)).isNull(), "not two coordinates")
        .when(~F.get(xy, F.lit(0)).between(-180, 180) | ~F.get(xy, F.lit(1)).between(-90, 90), "coordinates out of range")
        .when(severity.isNotNull() & ~severity.between(1, 4), "severity out of range")
    )


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that should be unique and are not, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def invariants(events: DataFrame, grid: DataFrame, temporal: DataFrame, cell: float) -> DataFrame:
    """``name, holds``: what must be true between a table and its aggregates."""
    rows = events.agg(F.count("*").alias("n"))
    cells = grid.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("in_cells"),
        F.coalesce(F.bool_and((F.col("centroid.coordinates")[0].between(F.col("grid_lon"), F.col("grid_lon") + cell)) & (F.col("centroid.coordinates")[1].between(F.col("grid_lat"), F.col("grid_lat") + cell))), F.lit(True)).alias("centred"),
        F.coalesce(F.bool_and(F.col("grid_id") == grid_id(F.col("grid_lat"), F.col("grid_lon"))), F.lit(True)).alias("named"),
    )
    times = temporal.agg(F.count_if(F.col("dimension") == "hour").alias("hours"), F.count_if(F.col("dimension") == "dow").alias("days"), F.coalesce(F.sum(F.when(F.col("dimension") == "hour", F.col("count"))), F.lit(0)).alias("timed"))
    one = rows.crossJoin(cells).crossJoin(times)  # three frames of one row
    checks = {"cells_within_rows": F.col("in_cells") <= F.col("n"), "centroids_in_cells": F.col("centred"), "cell_names": F.col("named"), "hours_at_most_24": F.col("hours") <= 24, "days_at_most_7": F.col("days") <= 7, "timed_within_rows": F.col("timed") <= F.col("n")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("holds")) for k, v in checks.items()])).alias("c")).select("c.*")
