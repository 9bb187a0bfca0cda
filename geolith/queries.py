"""The registered queries of the event operators and their SQL, under the names of the operator list."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith import fixtures
from geolith.functions import geo
from geolith.functions.values import finite, to_number, to_time
from geolith.operators import aggregate, clean, enrich, filters, partials, reading, sample, spatial, tables
from geolith.plans import jobs
from geolith.sources import blocks, files, layout, shared
from geolith.sources import keys as key_index
from geolith.streaming import ingest as stream

LAT, LON, RADIUS = 34.0522, -118.2437, 20_000.0
BOX = (-118.6, 33.85, -118.0, 34.25)
#: A triangle with a hole, and a box beside it.
AREA = [
    [[[-118.6, 33.8], [-118.0, 33.8], [-118.3, 34.4], [-118.6, 33.8]], [[-118.35, 33.95], [-118.25, 33.95], [-118.3, 34.05], [-118.35, 33.95]]],
    [[[-117.95, 34.0], [-117.8, 34.0], [-117.8, 34.2], [-117.95, 34.2], [-117.95, 34.0]]],
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    """Registers a function under its name. ``sql`` reads the views ``a`` (events, enriched) or ``r`` (raw rows)."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if sql.lstrip().lower().startswith("with") else (_RAW if raw else _BASE) + sql
        return f

    return register


# --- SQL pieces ---


def _sql_index(x: str, low: float, span: float, bits: int) -> str:
    n = 1 << bits
    k = f"greatest(0, least({n - 1}, cast(ceil(({x} - ({low}e0)) / ({span}e0 / {n})) as bigint) - 1))"
    return f"(select case when {x} > {low}e0 + (k + 1) * {span}e0 / {n}e0 and k < {n - 1} then k + 1 when {x} <= {low}e0 + k * {span}e0 / {n}e0 and k > 0 then k - 1 else k end from (select {k} as k))"


def _sql_geohash(lat: str, lon: str, p: int) -> str:
    nx, ny = (5 * p + 1) // 2, 5 * p // 2
    x, y = _sql_index(lon, -180.0, 360.0, nx), _sql_index(lat, -90.0, 180.0, ny)
    chars = []
    for c in range(p):
        bits = []
        for j in range(5):
            bit = 5 * c + j
            axis, shift = ("gx", nx - 1 - bit // 2) if bit % 2 == 0 else ("gy", ny - 1 - bit // 2)
            bits.append(f"(({axis} >> {shift}) & 1) * {1 << (4 - j)}")
        chars.append(f"substr('{geo.GEOHASH_ALPHABET}', cast({' + '.join(bits)} as bigint) + 1, 1)")
    return f"(select {' || '.join(chars)} from (select {x} as gx, {y} as gy))"


def _sql_distance(lat: str, lon: str, lat0: str, lon0: str) -> str:
    return f"12756274e0 * asin(least(1e0, sqrt(pow(sin((radians({lat}) - radians({lat0})) / 2), 2) + cos(radians({lat0})) * cos(radians({lat})) * pow(sin(radians({lon} - ({lon0})) / 2), 2))))"


def _sql_inside(lat: str, lon: str, polygons) -> str:
    alternatives = []
    for rings in polygons:
        edges = []
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                if x1 != x2:
                    arc = f"atan(({math.tan(math.radians(y1))!r}e0 * sin(radians({x2!r}e0 - {lon})) + {math.tan(math.radians(y2))!r}e0 * sin(radians({lon} - ({x1!r}e0)))) / {math.sin(math.radians(x2 - x1))!r}e0)"
                    edges.append(f"(case when ({x1!r}e0 > {lon}) <> ({x2!r}e0 > {lon}) and {arc} > radians({lat}) then 1 else 0 end)")
        alternatives.append(f"({' + '.join(edges)}) % 2 = 1")
    return f"({' or '.join(alternatives)})"


_BASE = f"""with events_view as ({fixtures.duckdb("accidents")}),
    a as (select *, round(floor(lat / 0.1e0) * 0.1e0, 3) as grid_lat, round(floor(lon / 0.1e0) * 0.1e0, 3) as grid_lon,
            printf('%.4f_%.4f', round(floor(lat / 0.1e0) * 0.1e0, 3), round(floor(lon / 0.1e0) * 0.1e0, 3)) as grid_id,
            {_sql_geohash("lat", "lon", 5)} as geohash,
            cast(year(start_time) as int) as year, cast(month(start_time) as int) as month, cast(day(start_time) as int) as day,
            cast(hour(start_time) as int) as hour, cast(isodow(start_time) - 1 as int) as dow, isodow(start_time) >= 6 as is_weekend,
            {_sql_distance("lat", "lon", f"{LAT}e0", f"{LON}e0")} as d
        from events_view) """
_TAGGED = f"""with raw_view as ({fixtures.duckdb("raw_accidents")}),
    typed as (select pos, accident_id, try_cast(trim(lat) as double) as lat, try_cast(trim(lon) as double) as lon, try_cast(trim(severity) as double) as severity,
            try_cast(trim(start_time) as timestamp) as start_time, city from raw_view),
    ruled as (select *, case when lat is null or lon is null then 'null_coords' when not lat between -90 and 90 or not lon between -180 and 180 then 'out_of_range'
            when lat = 0 and lon = 0 then 'zero_island' when not lat between 17.5 and 72 or not lon between -180 and -64.5 then 'outside_box'
            when start_time is null then 'bad_time' when severity is null or severity not in (1, 2, 3, 4) then 'bad_severity' end as reason from typed),
    r as (select * exclude (reason), case when reason is null and row_number() over (partition by accident_id, reason is null order by pos) > 1 then 'duplicate' else reason end as drop_reason from ruled) """
_RAW = _TAGGED
_INSIDE = _sql_inside("lat", "lon", AREA)
_IN_BOX = _sql_inside("lat", "lon", geo.box_rings(*BOX))
_GRID = """grid as (select floor(lat / 0.1e0) as i, floor(lon / 0.1e0) as j, count(*) as count, round(avg(severity), 4) as avg_severity, max(severity) as max_severity,
        round(avg(distance_mi), 4) as avg_distance_mi, count(distinct city) as distinct_cities, min(start_time) as first_event, max(start_time) as last_event,
        arg_min(state, row(start_time, accident_id)) filter (state is not null) as sample_state from a group by all),
    cells as (select * exclude (i, j), round(i * 0.1e0, 4) as grid_lat, round(j * 0.1e0, 4) as grid_lon, printf('%.4f_%.4f', round(i * 0.1e0, 4), round(j * 0.1e0, 4)) as grid_id,
        round(j * 0.1e0, 4) + 0.05e0 as centroid_lon, round(i * 0.1e0, 4) + 0.05e0 as centroid_lat, 0.1e0 as cell_deg from grid) """


def _with_grid(sql: str) -> str:
    return _BASE.rstrip() + ", " + _GRID + sql


# --- Spark pieces ---


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enriched(fixtures.accidents(spark, sf_dir))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.tagged(fixtures.raw_accidents(spark, sf_dir))


def _flat(df: DataFrame) -> DataFrame:
    """The centroid as two columns, which both engines print alike."""
    xy = F.col("centroid.coordinates")
    return df.withColumns({"centroid_lon": xy[0], "centroid_lat": xy[1]}).drop("centroid")


_GRIDS: dict[tuple[str, str], str] = {}


def stored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the events, stored once in a session: readers of aggregates read tables that exist."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRIDS or not key_index.exists(spark, _GRIDS[key]):
        _GRIDS[key] = files.shared_dir(spark, "grid")
        files.overwrite(aggregate.grid(fixtures.accidents(spark, sf_dir), exact=True), _GRIDS[key])
    return spark.read.parquet(_GRIDS[key])


def _unrounded(df: DataFrame) -> DataFrame:
    """The means from the centroid: at six digits, means of such coordinates are often exact ties, which engines round differently."""
    xy = F.col("centroid.coordinates")
    return df.withColumns({"mean_lon": F.round(xy[0], 10), "mean_lat": F.round(xy[1], 10)}).drop("centroid")


# --- sources and sinks ---


@query("select drop_reason, count(*) as count, min(pos) as first_pos from r group by drop_reason", raw=True)
def src1_csv_scan(spark, sf_dir):
    raw = fixtures.raw_accidents(spark, sf_dir)
    path, wanted = files.shared_dir(spark, "csv"), raw.columns
    raw.select("city", *[c for c in wanted if c not in ("city", "pos")], F.lit("x").alias("other"), "pos").write.option("emptyValue", "").csv(path, header=True)
    back = files.read_csv(spark, path, wanted).withColumn("pos", F.col("pos").cast("long"))
    return clean.tagged(back).groupBy("drop_reason").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"))


@query("select drop_reason, count(*) as count, cast(sum(pos) as bigint) as positions from r group by drop_reason", raw=True)
def src2_csv_splits(spark, sf_dir):
    raw = fixtures.raw_accidents(spark, sf_dir)
    path = files.shared_dir(spark, "csv")
    raw.write.option("emptyValue", "").csv(path, header=True)
    back = files.read_csv(spark, path, raw.columns, split_bytes=100_000).withColumn("pos", F.col("pos").cast("long"))
    return clean.tagged(files.gathered(back)).groupBy("drop_reason").agg(F.count("*").alias("count"), F.sum("pos").alias("positions"))


@query("with t as (select event_type, count(*) as rows, cast(sum(event_id) as bigint) as ids from events group by event_type) select * from t")
def src4_read_splits(spark, sf_dir):
    events_in_splits = files.read_table(spark, f"{sf_dir}/events.parquet", split_bytes=200_000)
    return events_in_splits.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


@query("with t as (select count(*) as rows, count(distinct user_id) as users from events) select * from t")
def src3_schema_scan(spark, sf_dir):
    return files.read_table(spark, f"{sf_dir}/events.parquet", "event_id long, user_id long").agg(F.count("event_id").alias("rows"), F.count_distinct("user_id").alias("users"))


@query("with t as (select s_suppkey, case when s_suppkey % 4 = 2 then 1 + s_suppkey % 3 else 1 end as polygons, case when s_suppkey % 4 = 3 then 5 else 5 + s_suppkey % 2 end as positions, -10e0 - s_suppkey % 7 as x1 from supplier) select * from t")
def src5_geometry_bodies(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.lit(-10) - F.col("s_suppkey") % 7).cast("double").alias("x"))
    corners = [F.concat_ws(",", F.col("x") + dx, F.lit(y)) for dx, y in ((0, 1), (2, 1), (2, 3), (0, 3), (0, 1))]
    more = F.when(F.col("s_suppkey") % 2 == 1, F.concat_ws(",", F.col("x") + 1, F.lit(4)))  # odd keys have a sixth corner
    ring = F.concat(F.lit("[["), F.concat_ws("],[", *corners[:3], more, *corners[3:]), F.lit("]]"))
    rings = F.array_join(F.array_repeat(F.concat(F.lit("["), ring, F.lit("]")), (1 + F.col("s_suppkey") % 3).cast("int")), ",")
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))
    body = (
        F.when(F.col("s_suppkey") % 4 == 0, polygon)
        .when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit('{"type":"Feature","geometry":'), polygon, F.lit("}")))
        .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), rings, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"bbox":['), F.concat_ws(",", F.col("x"), F.lit(1), F.col("x") + 2, F.lit(3)), F.lit("]}")))
    )
    p = files.polygons_of(body)
    return s.select("s_suppkey", p.alias("p")).select("s_suppkey", F.size("p").alias("polygons"), F.size(F.col("p")[0][0]).alias("positions"), F.col("p")[0][0][0][0].alias("x1"))


@query("with t as (select count(*) as rows from events) select rows as written, rows from t")
def snk1_overwrite(spark, sf_dir):
    path = files.shared_dir(spark, "table")
    written = files.overwrite(fixtures.accidents(spark, sf_dir), path)
    return spark.read.parquet(path).agg(F.lit(written).cast("long").alias("written"), F.count("*").alias("rows"))


@query("""with k as (select l_orderkey, l_linenumber, bool_or(l_orderkey % 2 = 0) as old from lineitem group by all)
    select count(*) as keys, count(*) filter (not old) as appended from k""")
def snk2_idempotent_append(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    path = files.shared_dir(spark, "append")
    keys = ("l_orderkey", "l_linenumber")
    files.append_new(items.where("l_orderkey % 2 = 0"), path, *keys)
    told = files.append_new(items, path, *keys)
    files.append_new(items, path, *keys)  # adds nothing
    return spark.read.parquet(path).agg(F.count("*").alias("keys"), F.lit(told["appended"]).cast("long").alias("appended"))


@query("""select count(*) as keys, count(*) filter (l_orderkey % 100 = 7) as appended, count(*) filter (l_orderkey % 100 <> 7 and l_orderkey % 3 = 0) as skipped
    from (select distinct l_orderkey, l_linenumber from lineitem)""")
def snk2_indexed_append(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").dropDuplicates(["l_orderkey", "l_linenumber"])
    path, keys = files.shared_dir(spark, "append"), ("l_orderkey", "l_linenumber")
    files.append_new(items.where("l_orderkey % 100 <> 7"), path, *keys, bucket_keys=2000, index_from=1)
    told = files.append_new(items.where("l_orderkey % 100 = 7"), path, *keys, bucket_keys=2000, index_from=1)
    again = files.append_new(items.where("l_orderkey % 100 <> 7 and l_orderkey % 3 = 0"), path, *keys, bucket_keys=2000, index_from=1)
    return spark.read.parquet(path).agg(F.count("*").alias("keys"), F.lit(told["appended"]).cast("long").alias("appended"), F.lit(again["skipped"]).cast("long").alias("skipped"))


@query("select count(*) as total_matching, min(accident_id) as first_id, true as few_files from a where d <= 5000")
def snk4_clustered_search(spark, sf_dir):
    """A search of 5 km opens fewer than a third of the files of a table that is laid out by a curve."""
    path = files.shared_dir(spark, "clustered")
    layout.write_clustered(fixtures.accidents(spark, sf_dir), path, n_files=24)
    near = layout.read_near(spark, path, LAT, LON, 5000.0)
    found = spatial.near(near, LAT, LON, 5000.0, limit=None)
    few = F.lit(3 * len(near.inputFiles()) < len(spark.read.parquet(f"{path}/rows").inputFiles()))
    return found.agg(F.count("*").alias("total_matching"), F.min("accident_id").alias("first_id"), few.alias("few_files"))


@query("""select year, month, count(*) as count, case when year is null then 'sin_fecha' else printf('%d-%02d', year, month) end as label
    from (select case when event_id % 50 = 0 then null else year end as year, case when event_id % 50 = 0 then null else month end as month from a) group by year, month having count(*) >= 2""")
def snk4_month_layout(spark, sf_dir):
    dated = fixtures.accidents(spark, sf_dir).withColumn("start_time", F.when(F.col("event_id") % 50 != 0, F.col("start_time")))
    path = files.shared_dir(spark, "months")
    files.overwrite(dated.withColumns({"year": F.year("start_time"), "month": F.month("start_time")}), path, "year", "month")
    return files.month_buckets(spark.read.parquet(path), 2)


@query("select accident_id, severity, strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f+00:00') as start_time, 'Point' as kind, round(lon, 6) as lon, round(lat, 6) as lat, 4 as fields from a")
def snk5_json_rows(spark, sf_dir):
    rows = enrich.as_json(enrich.documents(events(spark, sf_dir)).select("accident_id", "severity", "start_time", "location"))

    def at(path: str):
        return F.get_json_object("json", f"$.{path}")

    lon, lat = (F.round(at(f"location.coordinates[{i}]").cast("double"), 6) for i in (0, 1))
    return rows.select(
        at("accident_id").alias("accident_id"), at("severity").cast("int").alias("severity"), at("start_time").alias("start_time"), at("location.type").alias("kind"), lon.alias("lon"), lat.alias("lat"), F.size(F.json_object_keys("json")).alias("fields")
    )


@query("select count(*) as rows, count(distinct accident_id) as ids, count(*) as stored from r where drop_reason is null", raw=True)
def snk3_drop_and_reload(spark, sf_dir):
    path = files.shared_dir(spark, "events")
    raw = fixtures.raw_accidents(spark, sf_dir)
    jobs.ingest(raw.where("pos % 3 = 0"), path)
    told = jobs.ingest(raw, path, replace=True)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.count_distinct("accident_id").alias("ids"), F.lit(told["stored"]).cast("long").alias("stored"))


@query("with t as (select 'events' as name, count(*) as rows from events union all select 'orders', count(*) from orders union all select 'region', count(*) from region) select name, rows, name <> 'events' or rows > 0 as ready from t")
def snk6_inventory(spark, sf_dir):
    return files.inventory({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders", "region")}, "events")


# --- projections, casts, filters ---


@query("select pos, accident_id, severity, start_time, lat, lon, city from (select pos, accident_id, lat, lon, severity, start_time, city from typed) where lat is not null", raw=True)
def prj1_renamed(spark, sf_dir):
    names = {clean_name: raw_name for raw_name, clean_name in clean.COLUMN_MAP.items()}
    raw = fixtures.raw_accidents(spark, sf_dir).withColumnsRenamed(names)
    typed = clean.renamed(raw).withColumns({c: to_number(F.col(c)) for c in ("lat", "lon", "severity")}).withColumn("start_time", to_time(F.col("start_time")))
    return typed.where("lat IS NOT NULL").select("pos", "accident_id", "severity", "start_time", "lat", "lon", "city")


@query("select accident_id, severity, start_time, city, state, weather, distance_mi, lat, lon from a")
def prj2_default_projection(spark, sf_dir):
    return enrich.projected(events(spark, sf_dir))


@query("select accident_id, 'Point' as kind, lon as x, lat as y from a")
def prj4_documents(spark, sf_dir):
    d = enrich.documents(events(spark, sf_dir))
    xy = F.col("location.coordinates")
    return d.select("accident_id", F.col("location.type").alias("kind"), xy[0].alias("x"), xy[1].alias("y"))


@query("with v as (" + fixtures.duckdb("raw_accidents") + ") select pos, try_cast(trim(lat) as double) as lat, try_cast(trim(severity) as double) as severity, try_cast(trim(start_time) as timestamp) as start_time from v")
def sca_tolerant_casts(spark, sf_dir):
    r = fixtures.raw_accidents(spark, sf_dir)
    return r.select("pos", to_number(F.col("lat")).alias("lat"), to_number(F.col("severity")).alias("severity"), to_time(F.col("start_time")).alias("start_time"))


@query("with t as (select l_orderkey % 100 as k, sum(case when l_linenumber % 3 = 0 then null else l_quantity end) as q, count(*) as n from lineitem group by all) select k, q, n from t")
def sca3_finite(spark, sf_dir):
    q = F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.sum(finite(q)).alias("q"), F.count("*").alias("n"))


@query("""with v as (""" + fixtures.duckdb("raw_accidents") + """), t as (select pos, try_cast(trim(lat) as double) as y, try_cast(trim(lon) as double) as x from v)
    select pos, coalesce(y between -90 and 90, false) as ok_lat, coalesce(x between -180 and 180, false) as ok_lon,
           coalesce(y between -90 and 90 and x between -180 and 180 and not (x = 0 and y = 0), false) as ok_point from t""")
def prd1_valid_points(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return fixtures.raw_accidents(spark, sf_dir).select("pos", geo.valid_lat(lat).alias("ok_lat"), geo.valid_lon(lon).alias("ok_lon"), geo.valid_point(lat, lon).alias("ok_point"))


@query("""select 'severity' as filter, count(*) as n from a where severity in (1, 4) union all select 'min_severity', count(*) from a where severity >= 3
    union all select 'state', count(*) from a where state = 'S3' union all select 'city', count(*) from a where lower(city) = 'city7'
    union all select 'weather', count(*) from a where contains(lower(weather), 'rain') union all select 'dates', count(*) from a where start_time between '2020-01-01' and '2021-06-30T12:00:00'
    union all select 'year', count(*) from a where year = 2019 union all select 'hours', count(*) from a where hour >= 22 or hour <= 4
    union all select 'all', count(*) from a where severity >= 2 and state = 'S1' and contains(lower(weather), 'rain') and year = 2020 and hour between 6 and 18""")
def prd_attribute_filters(spark, sf_dir):
    given = {
        "severity": {"severity": [1, 4], "min_severity": 3},
        "min_severity": {"min_severity": 3},
        "state": {"state": "s3"},
        "city": {"city": "CITY7"},
        "weather": {"weather": "RAIN"},
        "dates": {"start": "2020-01-01", "end": "2021-06-30T12:00:00"},
        "year": {"year": 2019},
        "hours": {"hour_from": 22, "hour_to": 4},
        "all": {"min_severity": 2, "state": "S1", "weather": "rain", "year": 2020, "hour_from": 6, "hour_to": 18},
    }
    counts = events(spark, sf_dir).agg(*[F.count_if(filters.attribute_filter(**g)).alias(k) for k, g in given.items()])
    return counts.unpivot([], list(given), "filter", "n")


# --- cleaning ---


@query("select pos, accident_id, lat, lon, case when drop_reason is null then cast(severity as int) end as severity, start_time, drop_reason from r", raw=True)
def cln8_tagged_rows(spark, sf_dir):
    return tagged(spark, sf_dir).select("pos", "accident_id", "lat", "lon", "severity", "start_time", "drop_reason")


_COUNTS = ", ".join(f"count(*) filter (drop_reason = '{r}') as {r}" for r in clean.REASONS)


@query(f"select {_COUNTS}, count(*) as rows_in, count(*) filter (drop_reason is null) as rows_out, count(drop_reason) as dropped_total, round(100e0 * count(*) filter (drop_reason is null) / count(*), 2) as retention_pct from r", raw=True)
def cln9_stats(spark, sf_dir):
    return clean.stats(tagged(spark, sf_dir))


@query(f"select {_COUNTS}, count(*) as rows_in, count(*) filter (drop_reason is null) as rows_out, count(drop_reason) as dropped_total, round(100e0 * count(*) filter (drop_reason is null) / count(*), 2) as retention_pct from r", raw=True)
def cln9_merged_stats(spark, sf_dir):
    rows = tagged(spark, sf_dir)
    return clean.merged_stats(clean.stats(rows.where("pos % 3 = 0")).unionByName(clean.stats(rows.where("pos % 3 <> 0"))))


@query("select rule, count(drop_reason) as dropped, round(100e0 * count(drop_reason) / (select count(*) from r), 2) as share_pct from (select unnest([" + ", ".join(f"'{r}'" for r in clean.REASONS) + "]) as rule) left join r on rule = drop_reason group by rule", raw=True)
def cln10_shares(spark, sf_dir):
    return clean.shares(clean.stats(tagged(spark, sf_dir)))


# --- derived columns ---


@query("select accident_id, grid_lat, grid_lon, grid_id, geohash, year, month, day, hour, dow, is_weekend from a")
def enr6_enriched(spark, sf_dir):
    return events(spark, sf_dir).select("accident_id", "grid_lat", "grid_lon", "grid_id", "geohash", "year", "month", "day", "hour", "dow", "is_weekend")


@query(f"select accident_id, {_sql_geohash('lat', 'lon', 9)} as geohash9 from a")
def enr2_geohash_long(spark, sf_dir):
    return fixtures.accidents(spark, sf_dir).select("accident_id", geo.geohash(F.col("lat"), F.col("lon"), 9).alias("geohash9"))


@query(f"""select accident_id, -90e0 + gy * 180e0 / 4096e0 as min_lat, -180e0 + gx * 360e0 / 8192e0 as min_lon, -90e0 + (gy + 1) * 180e0 / 4096e0 as max_lat, -180e0 + (gx + 1) * 360e0 / 8192e0 as max_lon,
    ((-90e0 + gy * 180e0 / 4096e0) + (-90e0 + (gy + 1) * 180e0 / 4096e0)) / 2 as mid_lat, ((-180e0 + gx * 360e0 / 8192e0) + (-180e0 + (gx + 1) * 360e0 / 8192e0)) / 2 as mid_lon
    from (select accident_id, {_sql_index("lon", -180.0, 360.0, 13)} as gx, {_sql_index("lat", -90.0, 180.0, 12)} as gy from a)""")
def enr3_geohash_boxes(spark, sf_dir):
    gh = F.col("geohash")
    e = events(spark, sf_dir).select("accident_id", geo.geohash_bbox(gh, 5).alias("b"), geo.geohash_center(gh, 5).alias("m"))
    return e.select("accident_id", "b.*", F.col("m.lat").alias("mid_lat"), F.col("m.lon").alias("mid_lon"))


@query("select accident_id, round(d, 3) as distance_m, round(d / 6378137e0, 12) as angle from a")
def enr7_haversine(spark, sf_dir):
    d = geo.haversine_m(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))
    return fixtures.accidents(spark, sf_dir).select("accident_id", F.round(d, 3).alias("distance_m"), F.round(geo.meters_to_radians(d), 12).alias("angle"))


@query("select accident_id, 5 as positions, grid_lon as x1, grid_lat + 0.1e0 as y2 from a")
def enr9_box_polygons(spark, sf_dir):
    lat, lon = F.col("grid_lat"), F.col("grid_lon")
    p = events(spark, sf_dir).select("accident_id", geo.bbox_polygon(lon, lat, lon + 0.1, lat + 0.1)["coordinates"][0].alias("ring"))
    return p.select("accident_id", F.size("ring").alias("positions"), F.col("ring")[0][0].alias("x1"), F.col("ring")[2][1].alias("y2"))


# --- spatial queries ---


@query(f"select accident_id, round(d, 2) as distance_m from a where d <= {RADIUS} and severity >= 2 order by d, accident_id limit 100 offset 50")
def geo1_near(spark, sf_dir):
    page = spatial.near(events(spark, sf_dir), LAT, LON, RADIUS, limit=100, skip=50, condition=filters.attribute_filter(min_severity=2))
    return page.select("accident_id", F.round("distance_m", 2).alias("distance_m"))


@query(f"with p as ({fixtures.duckdb('far_events')}), m as (select accident_id, {_sql_distance('lat', 'lon', '71e0', '-179.5e0')} as d from p) select accident_id, round(d, 2) as distance_m from m order by d, accident_id limit 25")
def geo1_nearest(spark, sf_dir):
    found = spatial.nearest(fixtures.far_events(spark, sf_dir), 71.0, -179.5, 25)
    return found.select("accident_id", F.round("distance_m", 2).alias("distance_m"))


@query(f"select count(*) as total_matching from a where d <= {RADIUS} and d >= 5000")
def geo2_near_count(spark, sf_dir):
    return spatial.near_count(events(spark, sf_dir), LAT, LON, RADIUS, min_m=5000.0)


@query(f"select accident_id, lat, lon from a where {_INSIDE} and hour between 6 and 18 order by accident_id limit 200 offset 10")
def geo3_within(spark, sf_dir):
    return spatial.within(events(spark, sf_dir), AREA, limit=200, skip=10, condition=filters.attribute_filter(hour_from=6, hour_to=18)).select("accident_id", "lat", "lon")


@query(f"select count(*) as total_matching from a where {_INSIDE}")
def geo4_within_count(spark, sf_dir):
    return spatial.within_count(events(spark, sf_dir), AREA)


_SUMMARY = """count(*) as count, round_even(avg(severity), 4) as avg_severity, max(severity) as max_severity, count(*) filter (severity >= 3) as severe_count, round_even(avg(distance_mi), 4) as avg_distance_mi,
    min(start_time) as first_event, max(start_time) as last_event, count(distinct city) + coalesce(max(case when city is null then 1 else 0 end), 0) as distinct_cities"""


@query(f"select {_SUMMARY} from a where {_INSIDE}")
def geo5_area_summary(spark, sf_dir):
    return spatial.area_summary(events(spark, sf_dir), AREA)


@query(f"select accident_id from a where {_IN_BOX} order by accident_id limit 1000")
def geo6_box(spark, sf_dir):
    return spatial.within(events(spark, sf_dir), geo.box_rings(*BOX), limit=1000).select("accident_id")


_GROUP_COLUMNS = """count(*) as count, count(*) filter (severity >= 3) as severe_count, arg_min(accident_id, row(d, accident_id)) as nearest_id, round_even(min(d), 2) as nearest_m, round_even(avg(d), 2) as avg_distance_m,
    round_even(max(d), 2) as max_distance_m, round_even(avg(severity), 4) as avg_severity, round_even(100 * count(*) filter (severity >= 3) / count(*), 3) as severe_pct"""


def _grouped(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, F.col("group").cast("string").alias("name"), "count", "severe_count", F.col("nearest.accident_id").alias("nearest_id"), F.bround("nearest.distance_m", 2).alias("nearest_m"), "avg_distance_m", "max_distance_m", "avg_severity", "severe_pct")


_PLAIN_KEYS = ("severity", "state", "city", "hour", "dow", "weather", "grid_id", "geohash")


@query(
    " union all ".join(f"select '{k}' as key, cast({k} as varchar) as name, {_GROUP_COLUMNS} from a where d <= {RADIUS} group by {k}" for k in _PLAIN_KEYS)
    + f" union all select 'none', null, {_GROUP_COLUMNS} from a where d <= {RADIUS}"
    + f" union all select 'distance_band', cast(cast(floor(d / 2000) * 2000 as double) as varchar), {_GROUP_COLUMNS} from a where d <= {RADIUS} group by floor(d / 2000) * 2000"
)
def geo7_near_groups(spark, sf_dir):
    every = spatial.near_all_groups(events(spark, sf_dir), LAT, LON, RADIUS, band_m=2000.0)
    return _grouped(every, "key")


@query(f"select cast(city as varchar) as name, {_GROUP_COLUMNS} from a where d <= {RADIUS} group by city order by count desc, city limit 10")
def geo7_top_cities(spark, sf_dir):
    return _grouped(spatial.near_groups(events(spark, sf_dir), LAT, LON, RADIUS, "city", limit=10))


@query(_BASE + f", c as ({fixtures.duckdb('centres')}) select centre_id, count(*) as events, round(min({_sql_distance('lat', 'lon', 'centre_lat', 'centre_lon')}), 2) as nearest_m from a, c where {_sql_distance('lat', 'lon', 'centre_lat', 'centre_lon')} <= 3000 group by centre_id")
def geo12_near_join(spark, sf_dir):
    totals = [F.count("*").alias("events"), F.round(F.min("distance_m"), 2).alias("nearest_m")]
    return spatial.near_totals(fixtures.accidents(spark, sf_dir).select("lat", "lon"), fixtures.centres(spark, sf_dir), 3000.0, totals)


_ARC = "atan((tan(radians({y})) * sin(radians(x2 - lon)) + tan(radians({y})) * sin(radians(lon - x1))) / sin(radians(x2 - x1)))"
_IN_REGION = f"(x1 > lon) <> (x2 > lon) and (({_ARC.format(y='y1')} > radians(lat)) <> ({_ARC.format(y='y2')} > radians(lat)))"


@query(_BASE + f", g as ({fixtures.duckdb('regions')}) select region_id, {_SUMMARY} from a join g on {_IN_REGION} group by region_id")
def geo13_region_summaries(spark, sf_dir):
    return spatial.region_summaries(fixtures.accidents(spark, sf_dir), fixtures.regions(spark, sf_dir))


_FAR_ARC = "atan((tan(radians({y1})) * sin(radians({x2} - {lon})) + tan(radians({y2})) * sin(radians({lon} - {x1}))) / sin(radians({x2} - {x1})))"


def _far_arc(lon: str, x1: str, x2: str, y: str) -> str:
    return _FAR_ARC.format(lon=lon, x1=x1, x2=x2, y1=y, y2=y)


@query(f"""with p as ({fixtures.duckdb('far_events')}), r as ({fixtures.duckdb('far_regions')}),
    met as (select *, case when lon < x1 then lon + 360 else lon end as x, -175 + 60 * floor((case when lon < -175 then lon + 360 else lon end + 175) / 60) as left_end, case when lon < -175 then lon + 360 else lon end as along from p, r)
    select region_id, count(*) as events, min(accident_id) as first_id, max(accident_id) as last_id from met
    where case when kind in (1, 2) then ({_far_arc('along', 'left_end', '(left_end + 60)', 'around')} > radians(lat)) = (kind = 2)
        else x >= x1 and x < x2 and ({_far_arc('x', 'x1', 'x2', 'y1')} > radians(lat)) <> ({_far_arc('x', 'x1', 'x2', 'y2')} > radians(lat)) end
    group by region_id""")
def geo13_far_regions(spark, sf_dir):
    states = [F.count("*").alias("events"), F.min("accident_id").alias("first_id"), F.max("accident_id").alias("last_id")]
    totals = [F.sum("events").alias("events"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")]
    return spatial.region_totals(fixtures.far_events(spark, sf_dir), fixtures.far_regions(spark, sf_dir), states, totals)


#: An outline of so many positions: a circle with waves.
OUTLINE = 10_000


def _outline() -> list:
    ring = [(0.25 + 0.1 * math.cos(17 * 2 * math.pi * i / OUTLINE), 2 * math.pi * i / OUTLINE) for i in range(OUTLINE)]
    ring = [[-118.25 + r * math.cos(a), 34.05 + r * math.sin(a)] for r, a in ring]
    return [[[*ring, ring[0]]]]


_OUTLINE_RADIUS = f"(0.25e0 + 0.1e0 * cos(17 * 2 * pi() * i / {OUTLINE}))"


@query(_BASE + f""", v as (select i, -118.25e0 + {_OUTLINE_RADIUS} * cos(2 * pi() * i / {OUTLINE}) as x, 34.05e0 + {_OUTLINE_RADIUS} * sin(2 * pi() * i / {OUTLINE}) as y from range({OUTLINE}) t(i)),
    e as (select v.x as x1, v.y as y1, w.x as x2, w.y as y2 from v join v w on w.i = (v.i + 1) % {OUTLINE}),
    n as (select accident_id, city from a join e on least(x1, x2) <= lon and lon < greatest(x1, x2) where {_FAR_ARC.format(lon='lon', x1='x1', x2='x2', y1='y1', y2='y2')} > radians(lat) group by accident_id, city having count(*) % 2 = 1)
    select city, count(*) as events, min(accident_id) as first_id from n group by city""")
def geo3_outline(spark, sf_dir):
    inside = spatial.within(events(spark, sf_dir), _outline(), limit=None)
    return inside.groupBy("city").agg(F.count("*").alias("events"), F.min("accident_id").alias("first_id"))


@query("with t as (select c_custkey as region_id, case c_custkey % 5 when 1 then 'a ring needs four positions' when 2 then 'a position is out of range' when 3 then 'a ring is not closed' when 4 then 'no rings' end as error from customer) select * from t")
def geo11_polygon_errors(spark, sf_dir):
    k = F.col("c_custkey")
    xs = [F.array(F.lit(0.0) + k % 7, F.lit(1.0)), F.array(F.lit(10.0) + k % 7, F.lit(1.0)), F.array(F.when(k % 5 == 2, 190.0).otherwise(10.0), F.lit(5.0))]
    closed = F.array(*xs, F.when(k % 5 == 3, F.array(F.lit(-1.0), F.lit(1.0))).otherwise(xs[0]))
    ring = F.when(k % 5 == 1, F.array(*xs)).otherwise(closed)
    polygons = F.when(k % 5 != 4, F.array(F.array(ring)))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("region_id"), spatial.polygon_error(polygons).alias("error"))


# --- aggregates ---


@query(_with_grid("select * from cells"))
def agg1_grid(spark, sf_dir):
    return _flat(aggregate.grid(events(spark, sf_dir), exact=True))


@query("select geohash, count(*) as count, round(avg(severity), 4) as avg_severity, round(avg(lat), 10) as mean_lat, round(avg(lon), 10) as mean_lon, count(distinct city) as distinct_cities, 5 as precision from a group by geohash")
def agg2_geohash(spark, sf_dir):
    return _unrounded(aggregate.geohashes(fixtures.accidents(spark, sf_dir), exact=True))


@query("select p as level, substr(geohash, 1, cast(p as int)) as geohash, count(*) as count from a, (select cast(unnest(range(1, 6)) as int) as p) group by all")
def agg3_geohash_levels(spark, sf_dir):
    return aggregate.geohash_levels(events(spark, sf_dir))


@query("""select level, geohash, count(*) as count, count(distinct city) as cities, true as close from (select p as level, substr(geohash, 1, cast(p as int)) as geohash, city from a, (select cast(unnest(range(1, 6)) as int) as p)) group by level, geohash""")
def agg3_distinct_rollup(spark, sf_dir):
    """Tables of five levels, each from the one before by its sketches; estimates are within four times their stated error of exact counts."""
    e = events(spark, sf_dir)
    exact = e.select("city", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda p: F.struct(p.alias("level"), F.col("geohash").substr(F.lit(1), p).alias("geohash")))).alias("g"))
    exact = exact.groupBy("g.level", "g.geohash").agg(F.count_distinct("city").alias("cities"))
    states, out = shared.stored(partials.partial(fixtures.accidents(spark, sf_dir), "geohash"), "geohashes"), None
    for level in range(5, 0, -1):
        states = partials.shortened(states, level)
        one = states.select(F.lit(level).alias("level"), "geohash", F.col("n").alias("count"), F.hll_sketch_estimate("cities").alias("estimate"))
        out = one if out is None else out.unionByName(one)
    error = F.greatest(F.lit(1.0), 4 * 1.04 / math.sqrt(1 << partials.LG_K) * F.col("cities"))
    return out.join(exact, ["level", "geohash"]).select("level", "geohash", "count", "cities", (F.abs(F.col("estimate") - F.col("cities")) <= error).alias("close"))


@query(_with_grid("""select row_number() over (order by concentration_index desc, count desc, grid_id) as rank, grid_id, grid_lat, grid_lon, count, avg_severity, max_severity, concentration_index,
    round(100e0 * count / sum(count) over (), 6) as pct_of_total, distinct_cities, sample_state, cell_deg, centroid_lon, centroid_lat
    from (select *, round(count * avg_severity, 4) as concentration_index from cells where count >= 10) order by rank limit 50"""))
def agg4_hotspots(spark, sf_dir):
    return _flat(aggregate.hotspots(stored_grid(spark, sf_dir), top_n=50))


def _names(values: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][cast({at} as int)]"


_TIMES = "count(*) as count, round(avg(severity), 4) as avg_severity, round(avg(distance_mi), 4) as avg_distance_mi"


@query(f"""select 'hour' as dimension, hour as bucket, printf('%02d:00', hour) as label, {_TIMES} from a group by hour
    union all select 'dow', dow, {_names(aggregate.DAY_NAMES, 'dow + 1')}, {_TIMES} from a group by dow
    union all select 'month', month, {_names(aggregate.MONTH_NAMES, 'month')}, {_TIMES} from a group by month
    union all select 'year', year, cast(year as varchar), {_TIMES} from a group by year""")
def agg9_temporal(spark, sf_dir):
    return aggregate.temporal(events(spark, sf_dir))


@query("""select state, count(*) as count, round(avg(severity), 4) as avg_severity, count(*) filter (severity >= 3) as severe_count, round(100e0 * count(*) filter (severity >= 3) / count(*), 4) as severe_pct,
    round(avg(lat), 10) as mean_lat, round(avg(lon), 10) as mean_lon, count(distinct city) as distinct_cities from a where state <> '' group by state""")
def agg10_state(spark, sf_dir):
    return _unrounded(aggregate.states(events(spark, sf_dir), exact=True))


@query("select severity, count(*) as count, cast(sum(count(*)) over () as bigint) as total from a where state = 'S2' group by severity")
def agg11_state_severity(spark, sf_dir):
    return aggregate.severity_of_state(events(spark, sf_dir), "s2")


_SMALL = "select cast(floor(lat / 0.1e0) as bigint) as cell_lat, cast(floor(lon / 0.1e0) as bigint) as cell_lon, count(*) as count, cast(sum(severity) as bigint) as sum_severity from a group by all"


@query(_SMALL)
def agg12_small_grid(spark, sf_dir):
    return aggregate.small_grid(fixtures.accidents(spark, sf_dir))


@query(_SMALL)
def set2_combined_grids(spark, sf_dir):
    e = fixtures.accidents(spark, sf_dir)
    return aggregate.combined_grids(*[aggregate.small_grid(e.where(f"event_id % 3 = {k}")) for k in range(3)])


@query(_with_grid("select grid_id, count, avg_severity, max_severity, avg_distance_mi, first_event, last_event, sample_state, grid_lat, grid_lon, cell_deg, centroid_lon, centroid_lat from cells"))
def set2_increments(spark, sf_dir):
    """The grid of all events from the states of three increments."""
    e = fixtures.accidents(spark, sf_dir)
    parts = partials.Increments(files.shared_dir(spark, "increments"))
    for k in range(3):
        parts.add(e.where(f"event_id % 3 = {k}"), f"part{k}")
    return _flat(parts.tables(spark)["grid"]).drop("distinct_cities")


@query(f"select *, round(sum_severity / count, 4) as avg_severity from ({_SMALL}) order by count desc, cell_lat, cell_lon limit 10")
def agg13_top_cells(spark, sf_dir):
    return aggregate.top_cells(aggregate.small_grid(fixtures.accidents(spark, sf_dir)))


@query("select year, count(*) as count, round(100e0 * count(*) / sum(count(*)) over (), 2) as share_pct from a group by year")
def agg14_year_coverage(spark, sf_dir):
    return aggregate.year_coverage(fixtures.accidents(spark, sf_dir))


@query("select cast(y as int) as year from (select unnest(range(min(year), max(year) + 1)) as y from a where year not in (2018, 2021)) where y not in (select year from a where year not in (2018, 2021))")
def agg15_missing_years(spark, sf_dir):
    return aggregate.missing_years(fixtures.accidents(spark, sf_dir).where("year(start_time) NOT IN (2018, 2021)"))


@query("select state, count(distinct city) as cities, true as close from a where state <> '' group by state")
def agg18_approximate_cities(spark, sf_dir):
    """The estimates are within three times the sketch's error of 5 % of the exact counts, which stand beside them."""
    e = events(spark, sf_dir)
    exact = aggregate.states(e, exact=True).select("state", F.col("distinct_cities").alias("cities"))
    return exact.join(aggregate.states(e).select("state", "distinct_cities"), "state").select("state", "cities", (F.abs(F.col("distinct_cities") - F.col("cities")) <= F.greatest(F.lit(1.0), 0.15 * F.col("cities"))).alias("close"))


_ALL_FIVE = _with_grid(""", spots as (select *, round(count * avg_severity, 4) as weight from cells where count >= 10 order by weight desc, count desc, grid_id limit 200),
    by_time as (select hour as b, count(*) as n, round(avg(severity), 4) as s from a group by hour union all select dow, count(*), round(avg(severity), 4) from a group by dow
        union all select month, count(*), round(avg(severity), 4) from a group by month union all select year, count(*), round(avg(severity), 4) from a group by year)
    select 'grid' as name, count(*) as rows, sum(count)::bigint as events, round(sum(avg_severity), 2) as severity, count(sample_state) + sum(max_severity)::bigint as other from cells
    union all select 'geohash', count(*), sum(n)::bigint, round(sum(s), 2), count(*) * 5 from (select geohash, count(*) as n, round(avg(severity), 4) as s from a group by geohash)
    union all select 'hotspots', count(*), sum(count)::bigint, round(sum(avg_severity), 2), sum(max_severity)::bigint from spots
    union all select 'temporal', count(*), sum(n)::bigint, round(sum(s), 2), sum(b)::bigint from by_time
    union all select 'state', count(*), sum(n)::bigint, round(sum(s), 2), sum(k)::bigint from (select state, count(*) as n, round(avg(severity), 4) as s, count(*) filter (severity >= 3) as k from a where state <> '' group by state)""")
_OTHER = {"grid": "count(sample_state) + sum(max_severity)", "geohash": "sum(precision)", "hotspots": "sum(max_severity)", "temporal": "sum(bucket)", "state": "sum(severe_count)"}


def _contents(tables: dict[str, DataFrame]) -> DataFrame:
    """A row about each of the five tables: rows, events, severities and what is its own."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows"), F.sum("count").alias("events"), F.round(F.sum("avg_severity"), 2).alias("severity"), F.expr(_OTHER[name]).cast("long").alias("other")).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(_ALL_FIVE)
def agg20_all_aggregates(spark, sf_dir):
    return _contents(jobs.aggregates(fixtures.accidents(spark, sf_dir)))


@query(_ALL_FIVE)
def agg20_stored_aggregates(spark, sf_dir):
    folder = files.shared_dir(spark, "aggregates")
    return _contents({name: spark.read.parquet(f"{folder}/{name}") for name in jobs.write_aggregates(fixtures.accidents(spark, sf_dir), folder)})


# --- reading, comparing, sampling, checking ---


@query(_with_grid(f"select grid_id, count, avg_severity from cells where count >= 20 and {_sql_inside('centroid_lat', 'centroid_lon', geo.box_rings(*BOX))} order by avg_severity, grid_id limit 15 offset 2"))
def srt4_read_aggregate(spark, sf_dir):
    tables = {"grid": stored_grid(spark, sf_dir)}
    page = reading.read_aggregate(tables, "grid", limit=15, skip=2, min_count=20, bbox=BOX, sort_by="avg_severity", ascending=True)
    return page.select("grid_id", "count", "avg_severity")


@query(_BASE + f""", whole as ({_SMALL}), part as (select cell_lat, cell_lon, sum(n) as count from (select cast(floor(lat / 0.1e0) as bigint) as cell_lat, cast(floor(lon / 0.1e0) as bigint) as cell_lon, count(*) as n from a group by event_id % 3, 1, 2) group by all)
    select bool_and(w.count is not distinct from p.count) as results_match, count(w.count) as cells_a, count(p.count) as cells_b, cast(sum(w.count) as bigint) as rows_a, cast(sum(p.count) as bigint) as rows_b
    from whole w full join part p using (cell_lat, cell_lon)""")
def set3_compare_runs(spark, sf_dir):
    return aggregate.compare_grids(agg12_small_grid(spark, sf_dir), set2_combined_grids(spark, sf_dir))


@query("""select l_orderkey, l_linenumber, case when l_orderkey % 97 = 5 then 'only_a' when l_orderkey % 89 = 7 then 'changed' when l_orderkey % 83 = 9 then 'repeated' end as what
    from (select distinct l_orderkey, l_linenumber from lineitem) where l_orderkey % 97 = 5 or l_orderkey % 89 = 7 or l_orderkey % 83 = 9
    union all select -l_orderkey, l_linenumber, 'only_b' from (select distinct l_orderkey, l_linenumber from lineitem) where l_orderkey % 79 = 3""")
def set3_differences(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    a = shared.stored(tables.one_each(items, "l_orderkey", "l_linenumber"), "rows")
    b = a.where("l_orderkey % 97 <> 5").withColumn("l_quantity", F.when(F.col("l_orderkey") % 89 == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    more = b.where("l_orderkey % 83 = 9 AND l_orderkey % 89 <> 7").unionByName(a.where("l_orderkey % 79 = 3").withColumn("l_orderkey", -F.col("l_orderkey")))
    return tables.differences(a, b.unionByName(more), "l_orderkey", "l_linenumber")


@query(_BASE.rstrip() + """, r as (select accident_id, severity, row_number() over (order by severity desc, accident_id) - 1 as k, count(*) over () as n from a)
    select case when k < 50 then 'first' when k < 100 then 'second' else 'deep' end as page, accident_id, severity from r where k < 100 or (k >= greatest(100, n - n % 1000 - 30) and k < greatest(100, n - n % 1000 - 30) + 50)""")
def srt2_seek_pages(spark, sf_dir):
    """The first page, the one that its key leads to, and a page far behind."""
    e = fixtures.accidents(spark, sf_dir).select("accident_id", "severity")
    pages = reading.OrderedPages.store(e, files.shared_dir(spark, "pages"), [F.desc("severity"), F.asc("accident_id")], n_ranges=7)
    first, then = pages.page(50)
    n = sum(size for _, size in pages.sizes)
    parts = {"first": first, "second": pages.page(50, then)[0], "deep": pages.page(50, max(100, n - n % 1000 - 30))[0]}
    out = None
    for name, page in parts.items():
        one = page.select(F.lit(name).alias("page"), "accident_id", "severity")
        out = one if out is None else out.unionByName(one)
    return out


_BLOCKS = "select event_id, event_id // 50 as block from a"


@query(f"""select event_id, block from ({_BLOCKS}) where block in (select block from (select block, sum(count(*)) over (order by md5(block || ':42'), block rows between unbounded preceding and 1 preceding) as before
    from ({_BLOCKS}) group by block) where coalesce(before, 0) < 300)""")
def smp1_block_sample(spark, sf_dir):
    rows = fixtures.accidents(spark, sf_dir).select("event_id", F.expr("event_id div 50").alias("block"))
    return sample.block_sample(rows, "block", 300)


@query(f"""select event_id, block from ({_BLOCKS}) where block in (select block from (select block, sum(count(*)) over (order by block rows between unbounded preceding and 1 preceding) as before
    from ({_BLOCKS}) group by block) where coalesce(before, 0) < 300)""")
def smp2_prefix_sample(spark, sf_dir):
    rows = fixtures.accidents(spark, sf_dir).select("event_id", F.expr("event_id div 50").alias("block"))
    return sample.block_sample(rows, "block", 300, sequential=True)


@query("""with t as (select l_orderkey, l_linenumber, case l_orderkey % 6 when 1 then 'no location' when 2 then 'not a point' when 3 then 'not two coordinates' when 4 then 'coordinates out of range'
    else case when l_linenumber > 4 then 'severity out of range' end end as error from lineitem) select error, count(*) as count from t group by error""")
def dq1_document_errors(spark, sf_dir):
    k = F.col("l_orderkey") % 6
    xy = F.when(k == 3, F.array(F.lit(1.0))).when(k == 4, F.array(F.lit(1.0), F.lit(91.0))).otherwise(F.array(F.lit(-118.0), F.lit(34.0)))
    location = F.when(k != 1, F.struct(F.when(k == 2, "Line").otherwise("Point").alias("type"), xy.alias("coordinates")))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(clean.document_error(location, F.col("l_linenumber")).alias("error")).agg(F.count("*").alias("count"))


@query("with t as (select l_orderkey, l_linenumber, count(*) as count from lineitem group by all having count(*) > 1) select * from t")
def dq2_repeated_keys(spark, sf_dir):
    return clean.repeated_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_linenumber")


@query(_with_grid(""", hours as (select hour, count(*) as n from a group by hour)
    select 'cells_within_rows' as name, (select sum(count) from cells) <= (select count(*) from a) as holds
    union all select 'centroids_in_cells', (select bool_and(centroid_lon between grid_lon and grid_lon + 0.1e0 and centroid_lat between grid_lat and grid_lat + 0.1e0) from cells)
    union all select 'cell_names', (select bool_and(grid_id = printf('%.4f_%.4f', grid_lat, grid_lon)) from cells)
    union all select 'hours_at_most_24', (select count(*) <= 24 from hours)
    union all select 'days_at_most_7', (select count(distinct dow) <= 7 from a)
    union all select 'timed_within_rows', (select sum(n) from hours) <= (select count(*) from a)"""))
def dq3_invariants(spark, sf_dir):
    e = events(spark, sf_dir)
    return clean.invariants(e, aggregate.grid(e), aggregate.temporal(e), 0.1)


# --- whole jobs ---


@query(_TAGGED + f" select count(*) filter (drop_reason is null) as stored, count(*) as rows_in, {_COUNTS}, (select count(distinct accident_id) from r where drop_reason is null) as ids from r")
def smp1_csv_blocks(spark, sf_dir):
    """All blocks of some CSV files, in waves: together they are the table. Copies of a row stand beside it, so that one wave has both."""
    base = files.shared_dir(spark, "csv")
    raw = fixtures.raw_accidents(spark, sf_dir).withColumnsRenamed({v: k for k, v in clean.COLUMN_MAP.items()})
    raw.repartitionByRange(3, "pos").sortWithinPartitions("pos").drop("pos").write.csv(f"{base}/raw", header=True)
    source = blocks.CsvBlocks(spark, f"{base}/raw", block_bytes=1 << 22, seed=None)
    told = jobs.ingest_sample(source, f"{base}/events", target_rows=1 << 40, wave=64, cell=0.1)
    kinds = ", ".join(f"{c} {'double' if c == 'retention_pct' else 'long'}" for c in told)
    account = spark.createDataFrame([tuple(told.values())], kinds).select("stored", "rows_in", *clean.REASONS)
    return account.crossJoin(F.broadcast(spark.read.parquet(f"{base}/events").agg(F.count_distinct("accident_id").alias("ids"))))  # one row each


_ACCOUNT = f"{_COUNTS}, count(*) as rows_in, count(*) filter (drop_reason is null) as rows_out, count(drop_reason) as dropped_total, round(100e0 * count(*) filter (drop_reason is null) / count(*), 2) as retention_pct"


@query(_TAGGED + f""", one as (select {_ACCOUNT}, count(*) filter (drop_reason is null) as rows from r)
    select 'first' as run, *, rows as stored, 0 as stored_before from one union all select 'second', *, 0, rows from one""")
def ingest_twice(spark, sf_dir):
    path = files.shared_dir(spark, "events")
    raw = fixtures.raw_accidents(spark, sf_dir).withColumn("distance_mi", F.lit(None).cast("string"))
    told = [{"run": name, **jobs.ingest(raw, path)} for name in ("first", "second")]
    kinds = ", ".join(f"{c} {'string' if c == 'run' else 'double' if c == 'retention_pct' else 'long'}" for c in told[0])
    account = spark.createDataFrame([tuple(t.values()) for t in told], kinds)
    return account.crossJoin(F.broadcast(spark.read.parquet(path).agg(F.count("*").alias("rows"))))  # two rows and one


@query("select count(*) as rows, count(distinct accident_id) as ids, sum(severity) as severities from r where drop_reason is null", raw=True)
def stream_ingest(spark, sf_dir):
    base = files.shared_dir(spark, "stream")
    fixtures.raw_accidents(spark, sf_dir).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    stream.store_stream(stream.clean_stream(raw), f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("rows"), F.count_distinct("accident_id").alias("ids"), F.sum(F.col("severity").cast("double")).alias("severities"))
