"""Aggregates from stored partial states, so that new events cost their own number and not that of all events.

A state is what sums, means, extremes and distinct counts need and what two parts of a table can be merged from: counts, sums, greatest
and least values, the earliest event's state, and a sketch of the cities (HLL). ``partial`` makes the states of some events by the keys
of one table, ``merged`` adds states up, ``finished`` turns them into the columns of ``aggregate``. The same states also roll up: a
geohash table of any length comes from a longer one, without the events.

Distinct counts from sketches are estimates. With ``LG_K`` 12 their relative standard error is 1.04 / sqrt(4096) = 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.operators import aggregate

LG_K = 12
#: Keys of each table's states.
KEYS = {"grid": ["i", "j"], "geohash": ["geohash"], "temporal": ["dimension", "bucket"], "state": ["state"]}
#: What events are grouped by first, where those are other keys.
BASE = {"geohash": ["x", "y"], "temporal": ["hour", "dow", "month", "year"]}


def _sketch(city: Column) -> Column:
    return F.hll_sketch_agg(city, F.lit(LG_K))


def _states() -> list[Column]:
    has_state = F.when(F.col("state").isNotNull(), F.struct("start_time", "accident_id"))
    sums = [F.sum(c).alias(f"{c}_sum") for c in ("severity", "distance_mi", "lat", "lon")]
    counts = [F.count(c).alias(f"{c}_n") for c in ("severity", "distance_mi", "lat", "lon")]
    return [
        F.count("*").alias("n"),
        *sums,
        *counts,
        F.count_if(F.col("severity") >= 3).alias("severe"),
        F.max("severity").alias("max_severity"),
        F.min("start_time").alias("first_event"),
        F.max("start_time").alias("last_event"),
        F.min(has_state).alias("state_order"),
        F.min_by("state", has_state).alias("sample_state"),
        _sketch(F.col("city")).alias("cities"),
    ]


def _keyed(events: DataFrame, table: str, cell: float, precision: int) -> DataFrame:
    lat, lon, t = F.col("lat"), F.col("lon"), F.col("start_time")
    if table == "grid":
        return events.where("lat IS NOT NULL AND lon IS NOT NULL").withColumns({"i": geo.cell_index(lat, cell), "j": geo.cell_index(lon, cell)})
    if table == "geohash":
        x, y = geo.geohash_indices(lat, lon, precision)
        return events.where(geo.valid_point(lat, lon)).withColumns({"x": x, "y": y})
    if table == "state":
        return events.where("state <> ''")
    return events.where(t.isNotNull()).withColumns({"hour": F.hour(t), "dow": F.weekday(t), "month": F.month(t), "year": F.year(t)})


def partial(events: DataFrame, table: str, cell: float = 0.1, precision: int = 5, also: dict[str, Column] | None = None) -> DataFrame:
    """The states of some events by the keys of ``table``, and by what ``also`` names."""
    if table not in KEYS:
        raise ValueError(f"there are {', '.join(KEYS)}")
    by = {k: F.col(k) for k in BASE.get(table, KEYS[table])} | (also or {})
    own = {f"key_{k}": k for k in by}  # a key may be called like a column that is summed up
    out = _keyed(events, table, cell, precision).groupBy(*[v.alias(f"key_{k}") for k, v in by.items()]).agg(*_states()).withColumnsRenamed(own)
    if table == "temporal":  # each event is counted in one hour of a weekday of a month, and only those states go to all their buckets
        parts = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("bucket")) for k in BASE[table]]))
        return merged(out.select("*", parts.alias("_p")).select("*", "_p.*"), *KEYS[table], *(also or {}))
    # cells are grouped by their numbers, and only result rows get their text
    return out.withColumn("geohash", geo.geohash_text(F.col("x"), F.col("y"), precision)).drop("x", "y") if table == "geohash" else out


def merged(states: DataFrame, *keys: str | Column) -> DataFrame:
    """States of parts by the same or coarser keys as states of the whole."""
    added = [c for c in states.columns if c in ("n", "severe") or c.endswith(("_sum", "_n"))]
    return states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in added],
        F.max("max_severity").alias("max_severity"),
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
        F.min("state_order").alias("state_order"),
        F.min_by("sample_state", "state_order").alias("sample_state"),
        F.hll_union_agg("cities").alias("cities"),
    )


def shortened(geohashes: DataFrame, precision: int) -> DataFrame:
    """States by the first ``precision`` characters, from states by longer geohashes."""
    return merged(geohashes.withColumn("geohash", F.substring("geohash", 1, precision)), "geohash")


def _mean(c: str) -> Column:
    return F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n"))


def finished(states: DataFrame, table: str, cell: float = 0.1) -> DataFrame:
    """The columns of the table as ``aggregate`` makes them; distinct counts are estimates."""
    out = states.withColumns({"count": F.col("n"), "avg_severity": F.round(_mean("severity"), 4), "distinct_cities": F.hll_sketch_estimate("cities"), "avg_distance_mi": F.round(_mean("distance_mi"), 4)})
    if table == "grid":
        out = out.withColumns({"grid_lat": F.round(F.col("i") * F.lit(float(cell)), 4), "grid_lon": F.round(F.col("j") * F.lit(float(cell)), 4)})
        named = geo.grid_id(F.col("grid_lat"), F.col("grid_lon")), geo.point(F.col("grid_lat") + F.lit(cell / 2), F.col("grid_lon") + F.lit(cell / 2))
        out = out.withColumns({"grid_id": named[0], "centroid": named[1], "cell_deg": F.lit(float(cell))})
        columns = ["count", "avg_severity", "max_severity", "avg_distance_mi", "distinct_cities", "first_event", "last_event", "sample_state", "grid_lat", "grid_lon", "grid_id", "centroid", "cell_deg"]
        return out.select(*columns).orderBy(F.desc("count"), "grid_id")
    centre = {"mean_lat": F.round(_mean("lat"), 6), "mean_lon": F.round(_mean("lon"), 6), "centroid": geo.point(_mean("lat"), _mean("lon"))}
    if table == "geohash":
        out = out.withColumns({**centre, "precision": F.length("geohash")})
        return out.select("count", "avg_severity", "distinct_cities", "geohash", "mean_lat", "mean_lon", "precision", "centroid").orderBy(F.desc("count"), "geohash")
    if table == "state":
        out = out.withColumns({**centre, "severe_count": F.col("severe"), "severe_pct": F.round(100.0 * F.col("severe") / F.col("n"), 4)})
        return out.select("state", "count", "avg_severity", "severe_count", "distinct_cities", "severe_pct", "mean_lat", "mean_lon", "centroid").orderBy(F.desc("count"), "state")
    return out.select("dimension", "bucket", aggregate.time_label(F.col("dimension"), F.col("bucket")).alias("label"), "count", "avg_severity", "avg_distance_mi").orderBy("dimension", "bucket")


class Increments:
    """Partial states of the four tables below a folder, one part for each increment, in folders by the month of the events.

    An increment has a name; adding it again puts it in place of itself, so a step that failed can be repeated. ``tables`` merges all
    parts, which are as many rows as the tables times increments and months, whatever the number of events.
    """

    def __init__(self, folder: str, cell: float = 0.1, precision: int = 5):
        self.folder, self.cell, self.precision = folder.rstrip("/"), cell, precision

    def add(self, events: DataFrame, name: str) -> None:
        """A month's states of a table meet before they are written: a file for each month, not for each month and task."""
        month = F.coalesce(F.date_format("start_time", "yyyy-MM"), F.lit("none"))
        for table in KEYS:
            states = partial(events, table, self.cell, self.precision, {"event_month": month})
            states.hint("rebalance", "event_month").write.mode("overwrite").partitionBy("event_month").parquet(f"{self.folder}/{table}/increment={name}")

    def tables(self, spark: SparkSession, top_n: int = 200, months: list[str] | None = None) -> dict[str, DataFrame]:
        """The five tables of ``jobs.aggregates``, of all months or some."""
        out = {}
        for table, keys in KEYS.items():
            states = spark.read.option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}")
            if months is not None:
                states = states.where(F.col("event_month").isin(months))
            out[table] = finished(merged(states, *keys), table, self.cell)
        out["hotspots"] = aggregate.hotspots(out["grid"], top_n)
        return out
