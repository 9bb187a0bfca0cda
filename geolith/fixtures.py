"""The event model as views over the test tables, in text that Spark and DuckDB read alike but for ``{shift}``.

Distances are divided by a prime, so that averages rounded to four digits are no exact ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK_SHIFT = "ts - make_dt_interval(cast((event_id * 37) % 2900 as int))"
_DUCKDB_SHIFT = "ts - to_days(cast((event_id * 37) % 2900 as int))"

_EVENTS = """
    select concat('E-', cast(event_id as varchar(20))) as accident_id, event_id,
           33.60e0 + ((event_id * 7919) % 9000) / 1e4 + ((event_id * 31) % 97) / 1e3 as lat,
           -118.70e0 + ((event_id * 6007) % 9000) / 1e4 + ((event_id * 17) % 89) / 1e3 as lon,
           case when event_type = 'error' then 4 when event_type = 'purchase' then 3 when event_type = 'signup' then 1 else 2 end as severity,
           {shift} as start_time,
           concat('City', cast(user_id % 40 as varchar(20))) as city,
           value / 997e0 as distance_mi,
           case when user_id % 11 = 0 then null else concat('S', cast(user_id % 7 as varchar(20))) end as state,
           case event_id % 5 when 0 then 'Light Rain' when 1 then 'Clear' when 2 then 'Heavy rain' when 3 then null else 'Fog' end as weather
    from events"""

_RAW = """
    with copies as (
        select *, event_id * 2 as pos from events
        union all select *, event_id * 2 + 1 as pos from events where event_id % 200 = 0)
    select pos, concat('E-', cast(event_id as varchar(20))) as accident_id,
           case event_id % 97 when 6 then '9' when 7 then '2.5' when 8 then '' else case when event_type = 'error' then '4' when event_type = 'purchase' then '3' else '2' end end as severity,
           case event_id % 97 when 5 then 'N/A' else cast(ts as varchar(40)) end as start_time,
           case event_id % 97 when 1 then '' when 9 then 'no-numero' when 2 then '120.5' when 3 then '0.0' when 4 then '48.8566'
                else cast(33.60e0 + ((event_id * 7919) % 9000) / 1e4 + ((event_id * 31) % 97) / 1e3 as varchar(40)) end as lat,
           case event_id % 97 when 10 then '-300.0' when 3 then '0.0' when 4 then '2.3522'
                else cast(-118.70e0 + ((event_id * 6007) % 9000) / 1e4 + ((event_id * 17) % 89) / 1e3 as varchar(40)) end as lon,
           concat('City', cast(user_id % 40 as varchar(20))) as city
    from copies"""

#: Centres and regions that grow with the tables.
_CENTRES = """
    select s_suppkey as centre_id, 33.60e0 + ((s_suppkey * 7919) % 900) / 1e3 as centre_lat, -118.70e0 + ((s_suppkey * 6007) % 900) / 1e3 as centre_lon
    from supplier"""
_REGIONS = """
    select s_suppkey as region_id, -118.70e0 + ((s_suppkey * 131) % 80) / 1e2 as x1, 33.60e0 + ((s_suppkey * 37) % 80) / 1e2 as y1,
           -118.60e0 + ((s_suppkey * 131) % 80) / 1e2 as x2, 33.70e0 + ((s_suppkey * 37) % 80) / 1e2 as y2
    from supplier"""

#: Events all over the sphere, and regions across the antimeridian (kind 0), around the poles (1 north, 2 south) and elsewhere (3).
_FAR_EVENTS = """
    select concat('E-', cast(event_id as varchar(20))) as accident_id,
           ((event_id * 6007) % 18000) / 1e2 - 90 + ((event_id * 31) % 97) / 1e4 as lat, ((event_id * 7919) % 36000) / 1e2 - 180 + ((event_id * 17) % 89) / 1e4 as lon
    from events"""
_FAR_REGIONS = """
    select s_suppkey as region_id, s_suppkey % 4 as kind, cast((s_suppkey * 37) % 100 - 50 as double) as y1, cast((s_suppkey * 37) % 100 - 38 as double) as y2,
           case when s_suppkey % 4 = 0 then 165e0 + s_suppkey % 13 else -150e0 + (s_suppkey * 11) % 200 end as x1,
           case when s_suppkey % 4 = 0 then 183e0 + s_suppkey % 11 else -90e0 + (s_suppkey * 11) % 200 end as x2,
           case when s_suppkey % 4 = 2 then -50e0 - s_suppkey % 31 else 50e0 + s_suppkey % 31 end as around
    from supplier"""


def duckdb(view: str) -> str:
    return {"accidents": _EVENTS, "raw_accidents": _RAW, "centres": _CENTRES, "regions": _REGIONS, "far_events": _FAR_EVENTS, "far_regions": _FAR_REGIONS}[view].format(shift=_DUCKDB_SHIFT)


def _view(spark: SparkSession, sf_dir: str, text: str, table: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text.format(shift=_SPARK_SHIFT).replace(f"from {table}", "from {source}"), source=source)


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _EVENTS, "events")


def raw_accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _RAW, "events")


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _CENTRES, "supplier")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id and the box as a multipolygon."""
    ring = "array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2), array(x1, y1))"
    return _view(spark, sf_dir, _REGIONS, "supplier").selectExpr("region_id", f"array(array({ring})) as polygons")


def far_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _FAR_EVENTS, "events")


def far_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id and a multipolygon: a box, or a ring of six positions around a pole."""
    east = "case when x2 >= 180 then x2 - 360 else x2 end"
    box = f"array(array(x1, y1), array({east}, y1), array({east}, y2), array(x1, y2), array(x1, y1))"
    cap = "transform(sequence(0, 6), m -> array(cast(-175 + 60 * (m % 6) as double), around))"
    return _view(spark, sf_dir, _FAR_REGIONS, "supplier").selectExpr("region_id", f"array(array(case when kind in (1, 2) then {cap} else {box} end)) as polygons")
