"""Operators on small tables with known answers, edge cases, and invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolith import queries
from geolith.functions import geo
from geolith.operators import aggregate, clean, enrich, filters, partials, reading, sample, spatial, tables
from geolith.plans import jobs
from geolith.sources import blocks, files, keys, layout
from geolith.streaming import ingest

DIRTY = [
    ("A-1", "2", "2021-02-08 05:46:00", "34.0522", "-118.2437", "Los Angeles", "CA"),
    ("A-2", "3", "2021-03-09 06:07:59", "40.7128", "-74.0060", "New York", "NY"),
    ("A-3", "4", "2022-07-11 17:30:00", "41.8781", "-87.6298", "Chicago", "IL"),
    ("A-4", "1", "2022-12-25 23:15:00", "29.7604", "-95.3698", "Houston", "TX"),
    ("A-5", "2", "2023-01-01 08:00:00.5", "25.7617", "-80.1918", "Miami", "FL"),
    ("A-6", "2", "2023-05-20 12:00:00", "47.6062", "-122.3321", "Seattle", "WA"),
    ("D-1", "2", "2021-02-08 05:46:00", None, None, "X", "CA"),
    ("D-2", "2", "2021-02-08 05:46:00", "120.5", "-118.0", "X", "CA"),
    ("D-3", "2", "2021-02-08 05:46:00", "34.0", "-300.0", "X", "CA"),
    ("D-4", "2", "2021-02-08 05:46:00", "0.0", "0.0", "X", "CA"),
    ("D-5", "2", "2021-02-08 05:46:00", "48.8566", "2.3522", "Paris", "FR"),
    ("D-6", "2", "no-es-una-fecha", "34.05", "-118.25", "X", "CA"),
    ("D-7", "9", "2021-02-08 05:46:00", "34.06", "-118.26", "X", "CA"),
    ("A-1", "2", "2021-02-08 05:46:00", "34.0522", "-118.2437", "Los Angeles", "CA"),
]
COLUMNS = "accident_id string, severity string, start_time string, lat string, lon string, city string, state string"


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [(*r, i) for i, r in enumerate(DIRTY)]
    return spark.createDataFrame(rows, COLUMNS + ", pos long")


@pytest.fixture(scope="module")
def events(dirty):
    return enrich.enriched(clean.kept(clean.tagged(dirty))).withColumn("distance_mi", F.lit(1.0)).withColumn("weather", F.lit("Rain"))


def test_rules_drop_exactly_their_rows(dirty):
    s = clean.stats(clean.tagged(dirty)).first()
    assert [s[r] for r in clean.REASONS] == [1, 2, 1, 1, 1, 1, 1]
    assert (s.rows_in, s.rows_out, s.dropped_total, s.retention_pct) == (14, 6, 8, 42.86)
    shares = {r.rule: r.share_pct for r in clean.shares(clean.stats(clean.tagged(dirty))).collect()}
    assert shares["out_of_range"] == 14.29


def test_cleaning_edges(spark, dirty):
    empty = clean.stats(clean.tagged(dirty.limit(0))).first()
    assert (empty.rows_in, empty.rows_out, empty.retention_pct) == (0, 0, 0.0)
    with pytest.raises(ValueError):
        clean.tagged(dirty.drop("lat"))
    rows = [(None, "2", "2021-01-01", "61.2", "-149.9", "", "AK", 0), (None, "2", "2021-01-01", "21.3", "-157.8", "", "HI", 1), ("P", "2.5", "2021-01-01", "18.2", "-66.5", "", "PR", 2), ("P", "2", "2021-01-01", "18.2", "-66.5", "", "PR", 3)]
    tags = [r.drop_reason for r in clean.tagged(spark.createDataFrame(rows, COLUMNS + ", pos long")).orderBy("pos").collect()]
    assert tags == [None, "duplicate", "bad_severity", None]
    fewer = clean.tagged(dirty.select("pos", "lat", "lon"))
    assert clean.stats(fewer).first().rows_out == 9


def test_calendar(events):
    r = {x.accident_id: x for x in events.collect()}
    assert (r["A-1"].dow, r["A-1"].is_weekend, r["A-1"].hour, r["A-1"].year) == (0, False, 5, 2021)
    assert (r["A-4"].dow, r["A-4"].is_weekend) == (6, True)


def test_filters(events):
    def n(**given):
        return events.where(filters.attribute_filter(**given)).count()

    assert n() == 6
    assert n(severity=[2]) == 3 and n(severity=[2], min_severity=4) == 3 and n(min_severity=3) == 2
    assert n(state="ca") == 1 and n(city="CHICAGO") == 1 and n(city="Chi.*") == 0 and n(weather="rai") == 6
    assert n(start="2022-07-11T17:30:00", end="2023-01-01") == 2
    assert n(hour_from=22, hour_to=6) == 3 and n(hour_from=22) == 6
    for bad in ({"severity": [5]}, {"min_severity": 0}, {"year": 1800}, {"hour_from": 24, "hour_to": 1}, {"start": "soon"}):
        with pytest.raises(ValueError):
            filters.attribute_filter(**bad)


def test_near_invariants(events):
    lat, lon = 34.0522, -118.2437
    wide = spatial.near(events, lat, lon, 2_000_000).collect()
    assert [r.accident_id for r in wide] == ["A-1", "A-6"]
    assert wide[0].distance_m < 1 and [r.distance_m for r in wide] == sorted(r.distance_m for r in wide)
    assert [r.accident_id for r in spatial.near(events, lat, lon, 2_000_000, limit=1, skip=1).collect()] == ["A-6"]
    groups = spatial.near_groups(events, lat, lon, 2_000_000, "state", limit=None).collect()
    assert sum(g["count"] for g in groups) == spatial.near_count(events, lat, lon, 2_000_000).first()[0] == 2
    assert {g.group: g.nearest.accident_id for g in groups} == {"CA": "A-1", "WA": "A-6"}
    for bad in ({"radius_m": 0.5}, {"radius_m": 3e6}, {"radius_m": 10, "limit": 0}, {"radius_m": 10, "skip": -1}):
        with pytest.raises(ValueError):
            spatial.near(events, lat, lon, **bad)
    with pytest.raises(ValueError):
        spatial.near_groups(events, lat, lon, 10, "colour")


def test_area(events):
    sea = [[[[-150, 0], [-140, 0], [-140, 5], [-150, 5], [-150, 0]]]]
    assert spatial.area_summary(events, sea).first()["count"] == 0
    both = [*[[[[-119, 33], [-117, 33], [-117, 35], [-119, 35], [-119, 33]]]], [[[-75, 40], [-73, 40], [-73, 41], [-75, 41], [-75, 40]]]]
    assert {r.accident_id for r in spatial.within(events, both).collect()} == {"A-1", "A-2"}
    s = spatial.area_summary(events, both).first()
    assert (s["count"], s.avg_severity, s.max_severity, s.severe_count, s.distinct_cities) == (2, 2.5, 3, 1, 2)


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_batch_joins_equal_single_searches(spark, events, monkeypatch, broadcast_rows):
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", broadcast_rows)
    rows = [(1, 34.0, -118.0), (2, 41.0, -80.0), (3, 0.0, 179.9), (4, 89.9, 0.0)]
    centres = spark.createDataFrame(rows, "centre_id long, centre_lat double, centre_lon double")
    points = events.select("accident_id", "lat", "lon").union(spark.createDataFrame([("W", 0.0, -179.9), ("N", 89.95, 180.0), ("S", -90.0, 0.0)], "accident_id string, lat double, lon double"))
    for radius in (50_000.0, 1_000_000.0):
        met = {(r.centre_id, r.accident_id) for r in spatial.near_join(points, centres, radius).collect()}
        want = {(i, r.accident_id) for i, lat, lon in rows for r in spatial.near(points, lat, lon, radius).collect()}
        assert met == want
    assert (3, "W") in met and (4, "N") in met
    ring = [[-119.0, 33.0], [-117.0, 33.0], [-117.0, 35.0], [-119.0, 35.0], [-119.0, 33.0]]
    regions = spark.createDataFrame([(7, [[ring]])], "region_id long, polygons array<array<array<array<double>>>>")
    assert [r.accident_id for r in spatial.within_join(points, regions).collect()] == ["A-1"]


def test_copies_of_a_region_are_summed_up_once(spark, monkeypatch):
    ring = [[-119.0, 33.0], [-117.0, 33.0], [-117.0, 35.0], [-119.0, 35.0], [-119.0, 33.0]]
    cap = [[float(x), 50.0] for x in (-175, -60, 60, -175)]
    regions = spark.createDataFrame([(i, [[ring if i % 2 else cap]]) for i in range(300)] + [(900, None), (901, [])], "region_id long, polygons array<array<array<array<double>>>>")
    points = spark.range(2000).selectExpr("concat('E', id) as id", "id * 7919 % 1799 / 10 - 89.9 as lat", "id * 6007 % 3600 / 10 - 180 as lon")
    points = points.union(spark.range(300).selectExpr("concat('N', id)", "32.9 + id * 7 % 220 / 100", "-119.1 + id * 11 % 220 / 100"))
    want = spatial.within_join(points, regions).groupBy("region_id").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    plain, covered = spatial.region_cells, []

    def counted(df):
        covered.append(df.count())
        return plain(df)

    monkeypatch.setattr(spatial, "region_cells", counted)
    for most in (32 << 20, 0):
        monkeypatch.setattr(spatial, "BROADCAST_BYTES", most)
        got = spatial.region_totals(points, regions, [F.count("*").alias("n"), F.min("id").alias("first")], [F.sum("n").alias("n"), F.min("first").alias("first")]).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 300
    assert max(covered) == 4
    assert spatial.region_totals(points, regions.limit(0), [F.count("*").alias("n")], [F.sum("n").alias("n")]).isEmpty()


def test_summaries_of_copies_of_regions(spark, monkeypatch):
    boxes = [[[x, 33.0], [x + 1, 33.0], [x + 1, 34.0], [x, 34.0], [x, 33.0]] for x in (-119.0, -118.5, 10.0)]
    regions = spark.createDataFrame([(i, [[boxes[i % 3]]]) for i in range(90)], "region_id long, polygons array<array<array<array<double>>>>")
    points = spark.range(500).selectExpr("33 + id * 37 % 101 / 100.0D as lat", "-119 + id * 53 % 149 / 100.0D as lon", "cast(if(id % 9 = 0, null, 1 + id % 4) as int) as severity", "if(id % 7 = 0, null, id / 7) as distance_mi", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id as int)) as start_time", "if(id % 11 = 0, null, concat('c', id % 13)) as city")
    want = spatial.within_join(points, regions).groupBy("region_id").agg(*spatial._summary())
    plain, covered = spatial.region_cells, []

    def counted(df):
        covered.append(df.count())
        return plain(df)

    monkeypatch.setattr(spatial, "region_cells", counted)
    got = spatial.region_summaries(points, regions)
    assert rounded(got.select(*want.columns).orderBy("region_id")) == rounded(want.orderBy("region_id")) and got.count() == 60
    assert set(covered) == {3}


def test_copies_of_a_centre_meet_the_points_once(spark, events, monkeypatch):
    rows = [(i, 34.0 if i % 2 else 41.0, -118.0 if i % 2 else -80.0) for i in range(100)] + [(900, 0.0, 0.0), (901, None, 0.0)]
    centres = spark.createDataFrame(rows, "centre_id long, centre_lat double, centre_lon double")
    points = events.select("accident_id", "lat", "lon")
    totals = [F.count("*").alias("n"), F.min("distance_m").alias("m")]
    want = spatial.near_join(points, centres, 1_000_000.0).groupBy("centre_id").agg(*totals).collect()
    plain, met = spatial.near_join, []

    def counted(points, centres, radius_m):
        met.append(centres.count())
        return plain(points, centres, radius_m)

    monkeypatch.setattr(spatial, "near_join", counted)
    got = spatial.near_totals(points, centres, 1_000_000.0, totals).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 100
    assert met == [4]


def test_aggregates(events):
    cells = aggregate.grid(events)
    assert cells.count() == 6 and cells.agg(F.sum("count")).first()[0] == 6
    spots = aggregate.hotspots(cells, top_n=2, min_count=1).collect()
    assert [s.rank for s in spots] == [1, 2] and spots[0].max_severity == 4 and spots[0].pct_of_total == 16.666667
    assert aggregate.hotspots(cells.limit(0)).count() == 0
    t = {(r.dimension, r.bucket): (r.label, r["count"]) for r in aggregate.temporal(events).collect()}
    assert t[("hour", 5)] == ("05:00", 1) and t[("dow", 0)] == ("Lunes", 2) and t[("month", 12)] == ("Diciembre", 1) and t[("year", 2023)] == ("2023", 2)
    assert all(r.holds for r in clean.invariants(events, cells, aggregate.temporal(events), 0.1).collect())
    assert [r.year for r in aggregate.missing_years(events.where("year <> 2022")).collect()] == [2022]
    assert aggregate.missing_years(events.limit(0)).count() == 0
    stale = events.withColumn("geohash", F.substring("geohash", 1, 2))
    assert aggregate.geohashes(stale, 4).agg(F.min(F.length("geohash"))).first()[0] == 4


def test_comparison_sees_a_difference(events):
    a = aggregate.small_grid(events)
    assert aggregate.compare_grids(a, a).first().results_match
    assert not aggregate.compare_grids(a, aggregate.small_grid(events.where("accident_id <> 'A-1'"))).first().results_match


def test_reader(events):
    tables = jobs.aggregates(events)
    assert [r.state for r in reading.read_aggregate(tables, "state", limit=2).collect()] == ["CA", "FL"]
    assert reading.read_aggregate(tables, "temporal", dimension="hour").count() == 6
    assert reading.matching(tables, "grid", 1).first()[0] == 6
    with pytest.raises(ValueError):
        reading.read_aggregate(tables, "speed")


def test_sample_is_whole_blocks_and_repeats(spark):
    df = spark.range(1000).selectExpr("id", "id div 100 as block")
    a = {r.id for r in sample.block_sample(df, "block", 250, seed=1).collect()}
    assert len(a) == 300 and a == {r.id for r in sample.block_sample(df.repartition(3), "block", 250, seed=1).collect()}
    assert a != {r.id for r in sample.block_sample(df, "block", 250, seed=2).collect()}
    assert {r.id for r in sample.block_sample(df, "block", 150, sequential=True).collect()} == set(range(200))


def test_csv_by_name_and_rows_that_are_too_long_or_short(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Start_Lng,Other,ID,Start_Lat\n3,x,1,2\n3,x,2\n3,x,4,5,6\n3,x,5,6,\n3,x,6,6,,\n\"3,1\",x,8\n,x,7,\"\"\n")
    raw = files.read_csv(spark, str(tmp_path))
    assert raw.columns == list(clean.COLUMN_MAP)
    rows = clean.renamed(raw).orderBy("accident_id").collect()
    assert [(r.accident_id, r.lat, r.lon, r.city) for r in rows] == [("1", "2", "3", None), ("2", None, "3", None), ("7", None, None, None), ("8", None, "3,1", None)]
    split = sample.file_blocks(spark.read.csv(str(tmp_path)))
    assert split.select("block").distinct().count() == 1


def test_split_bytes_hold_for_one_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,City\n" + "".join(f"{i},somewhere {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    fine = files.read_csv(spark, str(tmp_path), ["ID", "City"], split_bytes=10_000)
    assert fine.rdd.getNumPartitions() > 4 * files.read_csv(spark, str(tmp_path), ["ID", "City"]).rdd.getNumPartitions()
    assert fine.count() == fine.select("ID").distinct().count() == 5000
    assert files.read_table(spark, str(tmp_path), "ID string, City string", split_bytes=10_000, form="csv").rdd.getNumPartitions() > 4
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_small_splits_are_not_as_many_files(spark, tmp_path):
    spark.range(20_000).selectExpr("concat('E', id) as ID", "concat('City', id % 7) as City").write.csv(str(tmp_path / "csv"), header=True)
    fine = files.read_csv(spark, str(tmp_path / "csv"), ["ID", "City"], split_bytes=5_000)
    files.gathered(fine).write.parquet(str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert fine.rdd.getNumPartitions() > 40 and len(stored.inputFiles()) <= 8
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, fine.collect()))


def test_geometry_bodies(spark):
    ring = "[[0,0],[1,0],[1,1],[0,0]]"
    bodies = [f'{{"type":"Polygon","coordinates":[{ring}]}}', f'{{"geometry":{{"type":"MultiPolygon","coordinates":[[{ring}],[{ring}]]}}}}', '{"bbox":[0,0,1,1]}', '{"bbox":[1,0,0,1]}', '{"type":"Point","coordinates":[1,2]}', "no json"]
    got = [r[0] and len(r[0]) for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(files.polygons_of(F.col("b"))).collect()]
    assert got == [1, 2, 1, None, None, None]


def test_append_is_idempotent(spark, events, tmp_path):
    path = str(tmp_path / "t")
    assert files.append_new(events, path, "accident_id") == {"rows_in": 6, "appended": 6, "skipped": 0}
    assert files.append_new(events.union(events), path, "accident_id")["appended"] == 0
    assert spark.read.parquet(path).count() == 6
    assert files.overwrite(events.where("severity = 2"), path) == 3
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    path = str(tmp_path / "n")
    assert [files.append_new(nulls, path, "k")["appended"] for _ in range(3)] == [2, 0, 0]
    assert files.append_new(nulls.limit(0), path, "k") == {"rows_in": 0, "appended": 0, "skipped": 0}


def test_ingest_accounts_for_every_row(spark, dirty, tmp_path):
    raw = dirty.unionByName(dirty.withColumn("pos", F.col("pos") + 100))
    first, second = (jobs.ingest(raw, str(tmp_path / "t")) for _ in range(2))
    for told in (first, second):
        assert told["rows_in"] == 28 and sum(told[r] for r in clean.REASONS) == told["dropped_total"] == 22 and told["rows_out"] == 6
    assert (first["stored"], first["stored_before"], second["stored"], second["stored_before"]) == (6, 0, 0, 6)
    assert jobs.ingest(dirty, str(tmp_path / "t"), replace=True)["stored"] == 6
    blocks = dirty.withColumn("block", F.expr("pos div 2"))
    told = jobs.ingest(blocks, str(tmp_path / "s"), sample_rows=3)
    assert 3 <= told["rows_out"] < 6 and told["rows_in"] < 14 and told["stored"] == told["rows_out"]


def test_times_do_not_depend_on_the_zones(spark, events):
    import os
    import time

    old, session = os.environ.get("TZ"), spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Tokyo"):
            for own in ("UTC", zone):
                os.environ["TZ"] = zone
                time.tzset()
                spark.conf.set("spark.sql.session.timeZone", own)
                assert events.where(filters.attribute_filter(start="2022-07-11T17:30:00", end=dt.datetime(2023, 1, 1))).count() == 2
                aware = dt.datetime(2022, 7, 11, 19, 30, tzinfo=dt.timezone(dt.timedelta(hours=2)))
                assert events.where(filters.attribute_filter(start=aware, end="2022-12-25")).count() == 1
    finally:
        os.environ.pop("TZ") if old is None else os.environ.update(TZ=old)
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", session)


def test_unlimited_searches(events):
    assert spatial.near(events, 34.0, -118.0, 2_000_000, limit=None).count() == 2
    assert spatial.within(events, [[[[-119, 33], [-117, 33], [-117, 35], [-119, 35], [-119, 33]]]], limit=None).count() == 1


def test_all_groups_equal_each_group(events):
    lat, lon = 34.0522, -118.2437
    every = spatial.near_all_groups(events.withColumn("state", F.when(F.col("state") != "WA", F.col("state"))), lat, lon, 2_000_000)
    got = {(r.key, r.group, r["count"], r.nearest.accident_id) for r in every.collect()}
    assert ("state", None, 1, "A-6") in got and ("none", None, 2, "A-1") in got
    for key in ("severity", "city", "distance_band"):
        each = spatial.near_groups(events, lat, lon, 2_000_000, key, limit=None).select(F.col("group").cast("string").alias("g"), "count", "nearest.accident_id").collect()
        assert {(key, *r) for r in each} == {g for g in got if g[0] == key}


def test_within_join_of_regions_of_all_sizes(spark):
    import random

    rnd = random.Random(4)
    points = spark.createDataFrame([(i, rnd.uniform(-80, 80), rnd.uniform(-179, 179)) for i in range(400)] + [(1000 + i, 10 + i / 1e4, 20.0) for i in range(20)], "point long, lat double, lon double")
    boxes = [(k, *sorted(rnd.uniform(-170, 170) for _ in range(2)), *sorted(rnd.uniform(-70, 70) for _ in range(2))) for k in range(40)]
    boxes = [b for b in boxes if b[2] - b[1] < 170] + [(100, 19.9999, 20.0001, 10.0, 10.001), (101, -5.0, 5.0, 1.0, 1.001)]
    rings = {k: [[[[x1, y1], [x2, y1], [x2, y2], [x1, y2], [x1, y1]]]] for k, x1, x2, y1, y2 in boxes}
    regions = spark.createDataFrame(list(rings.items()), "region_id long, polygons array<array<array<array<double>>>>")
    got = {(r.region_id, r.point) for r in spatial.within_join(points, regions).collect()}
    want = {(k, r.point) for k, area in rings.items() for r in points.where(spatial.geo.in_polygons(F.col("lat"), F.col("lon"), area)).collect()}
    assert got == want and any(k == 100 for k, _ in got)


def test_document_errors(spark):
    point = "location struct<type: string, coordinates: array<double>>, severity int"
    rows = [((("Point", [1.0, 2.0])), 2), (None, 2), (("Line", [1.0, 2.0]), 2), (("Point", [1.0]), 2), (("Point", [1.0, None]), 2), (("Point", [1.0, 91.0]), None), (("Point", [1.0, 2.0]), 5)]
    got = [r[0] for r in spark.createDataFrame(rows, point).select(clean.document_error(F.col("location"), F.col("severity"))).collect()]
    assert got == [None, "no location", "not a point", "not two coordinates", "not two coordinates", "coordinates out of range", "severity out of range"]


def test_json_times_have_an_offset(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 2, 8, 5, 46),)], "start_time timestamp_ntz")
    assert enrich.as_json(df).first()[0] == '{"start_time":"2021-02-08T05:46:00.000000+00:00"}'


# --- keys, blocks, increments ---


def stored_rows(spark, path):
    return sorted((r.k, r.v) for r in spark.read.parquet(path).collect())


def test_an_append_reads_few_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(40_000).select(F.concat(F.lit("key-"), F.col("id") * 7919).alias("k"), F.col("id").alias("v"))
    files.append_new(df, path, "k", bucket_keys=500, index_from=1)
    index = keys.KeyIndex(spark, path, ("k",), bucket_keys=500)
    fresh = spark.range(40_000, 40_400).select(F.concat(F.lit("key-"), F.col("id") * 7919).alias("k"), F.col("id").alias("v"))
    index.existing(fresh)
    assert index.bytes_read < 0.1 * index.bytes_all
    some = df.where("v % 100 = 3")
    found = index.existing(some)
    assert some.join(found, "k", "left_anti").isEmpty() and index.bytes_read > 0
    assert files.append_new(fresh.union(some), path, "k", bucket_keys=500, index_from=1) == {"rows_in": 800, "appended": 400, "skipped": 400}
    assert spark.read.parquet(path).count() == 40_400


def test_small_buckets_share_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(40_000).select(F.concat(F.lit("key-"), F.col("id") * 7919).alias("k"), F.col("id").alias("v"))
    df.write.parquet(path)
    index = keys.KeyIndex(spark, path, ("k",), bucket_keys=50)
    some = df.where("v % 1000 = 3")
    assert some.join(index.existing(some), "k", "left_anti").isEmpty()
    assert 0 < index.bytes_read < index.bytes_all
    assert len(list(tmp_path.glob("t/_keys/*/*/keys/**/*.parquet"))) <= 64  # of 1,024 buckets
    every = index.existing(df)
    assert df.join(every, "k", "left_anti").isEmpty()


def test_a_large_append_makes_no_index(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(2000).select(F.col("id").alias("k"))
    told = [files.append_new(df.where(w), path, "k", index_from=1)["appended"] for w in ("k < 1000", "k < 1900", "k % 2 = 1")]
    assert told == [1000, 900, 50] and not (tmp_path / "t" / "_keys").exists()
    assert files.append_new(df.where("k > 1990"), path, "k", index_from=1) == {"rows_in": 9, "appended": 4, "skipped": 5}
    assert (tmp_path / "t" / "_keys").exists() and spark.read.parquet(path).distinct().count() == spark.read.parquet(path).count() == 1954


def test_the_data_files_are_the_truth(spark, tmp_path, monkeypatch):
    """Tables without an index, appends that the index has not seen, files that have gone, and many segments."""
    path, rows = str(tmp_path / "t"), [("a", 1), ("b", 2), (None, 3)]
    monkeypatch.setattr(files.append_new, "__kwdefaults__", files.append_new.__kwdefaults__ | {"index_from": 1})
    df = spark.createDataFrame(rows, "k string, v long")
    df.write.parquet(path)
    assert files.append_new(df, path, "k")["appended"] == 0
    spark.createDataFrame([("c", 4)], "k string, v long").write.mode("append").parquet(path)
    more = spark.createDataFrame([("c", 9), ("d", 5)], "k string, v long")
    assert files.append_new(more, path, "k")["appended"] == 1
    files.overwrite(more, path)
    assert files.append_new(df, path, "k")["appended"] == 3
    monkeypatch.setattr(keys, "MAX_SEGMENTS", 3)
    for i in range(8):
        assert files.append_new(spark.createDataFrame([(f"n{i}", i), ("a", 0)], "k string, v long"), path, "k")["appended"] == 1
    segments = keys.KeyIndex(spark, path, ("k",)).refresh()
    assert len(segments) <= 4 and sum(x.n for x in segments) == 13
    assert files.append_new(spark.read.parquet(path), path, "k")["appended"] == 0


def test_the_data_files_are_the_truth_for_an_index(spark, tmp_path, monkeypatch):
    """The same, where each append goes by the index."""
    monkeypatch.setattr(files, "INDEX_SHARE", 1000.0)
    test_the_data_files_are_the_truth(spark, tmp_path, monkeypatch)
    assert (tmp_path / "t" / "_keys").exists()


def test_an_empty_folder_is_an_empty_table(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    assert files.append_new(df, str(path), "k")["appended"] == 1
    assert files.replace(df.union(df), str(path)) == 2 and stored_rows(spark, str(path)) == [("a", 1)] * 2
    assert files.replace(df.limit(0), str(path)) == 0


def test_a_failed_replacement_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    files.replace(df, path)
    with pytest.raises(Exception, match="no such luck"):
        files.replace(df.withColumn("v", F.raise_error(F.lit("no such luck")).cast("long")), path)
    assert stored_rows(spark, path) == [("a", 1)]


def test_blocks_of_files_are_all_lines_once(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("ID,Severity,City\n" + "".join(f"A{i},2,Town {i}\n" for i in range(200)))
    (folder / "b.csv").write_bytes(b"City,ID,Other\r\n" + b"".join(f'"x, ""{i}""",B{i},y\r\n'.encode() for i in range(50)) + b"\nlast,B50,y")
    (folder / "c.csv").write_text("ID,City\nC1,one\nC2,two,too many\nC3\n")
    want = [(f"A{i}", "2", f"Town {i}") for i in range(200)] + [(f"B{i}", None, f'x, "{i}"') for i in range(50)] + [("B50", None, "last"), ("C1", None, "one"), ("C3", None, None)]
    for size in (1 << 20, 97, 1):
        source = blocks.CsvBlocks(spark, str(folder), block_bytes=size, columns=["ID", "Severity", "City"])
        chosen = source.blocks()
        if size == 1:
            lines = [x for b in chosen for x in blocks.lines(b.file, b.start, b.length)]
            assert len(lines) == len(set(lines)) == 200 + 51 + 3
            continue
        got = sorted((tuple(r)[2:] for r in source.read(chosen).collect()), key=repr)
        assert got == sorted(want, key=repr)


def test_a_sample_reads_few_blocks(spark, tmp_path):
    folder = tmp_path / "csv"
    rows = spark.range(6000).select(F.concat(F.lit("E"), "id").alias("ID"), F.lit("2").alias("Severity"), F.lit("2021-02-08 05:46:00").alias("Start_Time"), F.lit("34.05").alias("Start_Lat"), F.when(F.col("id") % 3 == 0, "").otherwise("-118.25").alias("Start_Lng"), F.lit("LA").alias("City"), F.lit("1").alias("Distance(mi)"))
    rows.repartition(3).write.csv(str(folder), header=True)
    source = blocks.CsvBlocks(spark, str(folder), block_bytes=8 << 10)
    told = jobs.ingest_sample(source, str(tmp_path / "t"), 500, wave=2)
    assert 500 <= told["stored"] < 1200 and told["bytes"] < 0.3 * sum(n for _, n in source.files)
    assert told["rows_in"] == told["rows_out"] + told["null_coords"] and spark.read.parquet(str(tmp_path / "t")).count() == told["stored"]
    again = blocks.CsvBlocks(spark, str(folder), block_bytes=8 << 10)
    assert again.blocks() == source.blocks() and blocks.CsvBlocks(spark, str(folder), block_bytes=8 << 10, seed=1).blocks() != source.blocks()
    assert jobs.ingest_sample(source, str(tmp_path / "t"), 1, wave=2)["stored_before"] > 0
    with pytest.raises(FileNotFoundError):
        blocks.CsvBlocks(spark, str(tmp_path / "t"))


def test_headers_that_differ_are_an_error(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("ID,City\nA1,one\n")
    (folder / "b.csv").write_text("City,ID\ntwo,B1\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(folder), ["ID", "City"]).collect()


def rounded(df):
    """Rows whose sums may have been added up in another order."""

    def one(v):
        return float(f"{v:.12g}") if isinstance(v, float) else [one(x) for x in v] if isinstance(v, list) else {k: one(x) for k, x in v.items()} if isinstance(v, dict) else v

    return [one(r.asDict(True)) for r in df.collect()]


def test_increments_equal_one_run(spark, tmp_path):
    rows = [(f"E{i}", 33.0 + i % 37 / 10, -118.0 - i % 23 / 10, i % 4 + 1, dt.datetime(2020 + i % 3, i % 12 + 1, 1 + i % 28, i % 24), f"City{i % 19}", i / 7, None if i % 5 == 0 else f"S{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "accident_id string, lat double, lon double, severity int, start_time timestamp_ntz, city string, distance_mi double, state string")
    parts = partials.Increments(str(tmp_path))
    parts.add(df.where("accident_id < 'E2'"), "one")
    parts.add(df.where("accident_id >= 'E2' AND accident_id < 'E4'"), "two")
    parts.add(df.where("accident_id >= 'E4'"), "three")
    parts.add(df.where("accident_id >= 'E4'"), "three")  # again, after a failure
    got, want = parts.tables(spark), jobs.aggregates(df, exact=True)
    for name, table in want.items():
        columns = [c for c in table.columns if c != "distinct_cities"]
        assert set(got[name].columns) == set(table.columns)
        assert rounded(got[name].select(*columns)) == rounded(table.select(*columns)), name
    estimates = got["state"].join(want["state"].select("state", F.col("distinct_cities").alias("n")), "state").collect()
    assert estimates and all(abs(r.distinct_cities - r.n) <= 1 for r in estimates)
    months = ["2020-01", "2021-02"]
    some = parts.tables(spark, months=months)["state"].agg(F.sum("count")).first()[0]
    assert some == df.where(F.date_format("start_time", "yyyy-MM").isin(months) & F.col("state").isNotNull()).count()


def test_geohashes_roll_up(spark):
    df = spark.range(300).select(F.concat(F.lit("E"), "id").alias("accident_id"), (33 + F.col("id") % 17).cast("double").alias("lat"), (-118 + F.col("id") % 13).cast("double").alias("lon"), F.lit(2).alias("severity"), F.lit(None).cast("timestamp_ntz").alias("start_time"), (F.col("id") % 29).cast("string").alias("city"), F.lit(1.0).alias("distance_mi"), F.lit(None).cast("string").alias("state"))
    longest = partials.partial(df, "geohash", precision=6)
    for p in (1, 3, 5):
        got = {r.geohash: (r["count"], r.distinct_cities, r.precision) for r in partials.finished(partials.shortened(longest, p), "geohash").collect()}
        want = {r.geohash: (r["count"], r.distinct_cities, p) for r in aggregate.geohashes(df, p, exact=True).collect()}
        assert got == want  # so few cities are counted exactly


def test_differences_of_tables(spark):
    kind = "k long, g string, v double"
    a = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 3}", i / 2) for i in range(500)] + [(None, "x", 1.0)], kind)
    assert tables.differences(a, a.repartition(7).select("v", "k", "g"), "k").isEmpty()
    b = a.where("k <> 7 OR k IS NULL").withColumn("v", F.when(F.col("k") == 11, 99.0).otherwise(F.col("v")))
    b = b.union(a.where("k = 13")).union(spark.createDataFrame([(900, "new", 1.0)], kind)).withColumn("g", F.when(F.col("k") == 15, F.lit("0")).otherwise(F.col("g")))
    b = b.where("k IS NOT NULL")
    got = {(r.k, r.what) for r in tables.differences(a, b, "k").collect()}
    assert got == {(7, "only_a"), (11, "changed"), (13, "repeated"), (900, "only_b"), (15, "changed"), (None, "only_a")}
    assert {r.what for r in tables.differences(a, a.limit(0), "k").collect()} == {"only_a"}
    moved = a.withColumns({"g": F.col("v").cast("string"), "v": F.lit(None).cast("double")})
    assert not tables.differences(a, moved, "k").isEmpty()
    with pytest.raises(ValueError):
        tables.differences(a, a.drop("v"), "k")


def test_differences_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id % 700 as l_orderkey", "cast(1 + id % 2 as int) as l_linenumber", "id * 1.0D as l_quantity", "if(id % 5 = 0, 'N', 'R') as l_returnflag")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))

    class Shuffled:
        """A session whose tables come in another order each time that they are evaluated."""

        sparkContext, conf, read = spark.sparkContext, spark.conf, None

        def parquet(self, path):
            df = spark.read.parquet(path).coalesce(1)
            return df.mapInArrow(lambda batches: (b.take(np.random.default_rng().permutation(len(b))) for b in batches), df.schema)

    session = Shuffled()
    session.read = session
    got = {tuple(r) for r in queries.set3_differences(session, str(tmp_path)).collect()}
    keys_there = {(r[0], r[1]) for r in rows.select("l_orderkey", "l_linenumber").distinct().collect()}
    want = {(k, n, "only_a" if k % 97 == 5 else "changed" if k % 89 == 7 else "repeated") for k, n in keys_there if k % 97 == 5 or k % 89 == 7 or k % 83 == 9}
    assert got == want | {(-k, n, "only_b") for k, n in keys_there if k % 79 == 3}


def test_pages_are_disjoint_and_complete(spark, tmp_path):
    df = spark.range(1003).select(F.col("id"), (F.col("id") % 10).alias("v"))
    pages = reading.OrderedPages.store(df, str(tmp_path / "p"), [F.desc("v"), F.asc("id")], n_ranges=5)
    want = sorted(range(1003), key=lambda i: (-(i % 10), i))
    got, place, n = [], 0, 0
    while place is not None:
        page, place = pages.page(97, place)
        got += [r.id for r in page.collect()]
        n += 1
    assert got == want and n == 11
    deep, after = pages.page(20, 700)
    assert [r.id for r in deep.collect()] == want[700:720] and [r.id for r in pages.page(5, after)[0].collect()] == want[720:725]
    assert 0 < len(deep.inputFiles()) <= len(pages.rows.inputFiles())
    assert pages.page(10, 5000)[0].isEmpty() and pages.page(10, 5000)[1] is None
    nothing = reading.OrderedPages.store(df.limit(0), str(tmp_path / "q"), [F.asc("id")])
    assert nothing.page(5)[0].isEmpty()


def test_nearest_without_a_radius(spark):
    import random

    rnd = random.Random(2)
    rows = [(f"E{i}", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(600)] + [("N", 90.0, 0.0), ("W", 0.0, -180.0), ("E", 0.0, 180.0), ("null", None, None)]
    df = spark.createDataFrame(rows, "accident_id string, lat double, lon double")
    cells = spatial.cell_counts(df)
    far = geo.haversine_m
    for lat, lon, k in ((89.9, 10.0, 5), (0.0, 179.99, 3), (-45.0, 3.0, 40), (10.0, 10.0, 10_000), (-90.0, 0.0, 1)):
        got = [r.accident_id for r in spatial.nearest(df, lat, lon, k, cells).collect()]
        d = far(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
        assert got == [r.accident_id for r in df.where("lat IS NOT NULL").orderBy(d, "accident_id").limit(k).collect()]
    radius = spatial.nearest_radius(cells, -45.0, 3.0, 5)
    assert df.where(far(F.lit(-45.0), F.lit(3.0), F.col("lat"), F.col("lon")) <= radius).count() < 60
    assert spatial.nearest(df.limit(0), 0, 0, 3).count() == 0


def test_clustered_files_are_pruned(spark, tmp_path):
    rows = [(i, -89 + (i * 37) % 178 + 0.5, -179 + (i * 101) % 358 + 0.25) for i in range(4000)] + [(9000, None, 1.0), (9001, 0.0, 180.0), (9002, 0.0, -180.0)]
    df = spark.createDataFrame(rows, "accident_id long, lat double, lon double")
    path = str(tmp_path / "t")
    layout.write_clustered(df, path, n_files=30)
    every = len(spark.read.parquet(f"{path}/rows").inputFiles())
    for lat, lon, radius in ((34.0, -118.0, 400_000.0), (0.0, 179.9, 300_000.0), (89.0, 0.0, 200_000.0)):
        part = layout.read_near(spark, path, lat, lon, radius)
        want = {r.accident_id for r in spatial.near(df, lat, lon, radius, limit=None).collect()}
        assert want and {r.accident_id for r in spatial.near(part, lat, lon, radius, limit=None).collect()} == want
        assert len(part.inputFiles()) < every / 2
    area = [[[[170.0, -5.0], [-175.0, -5.0], [-175.0, 5.0], [170.0, 5.0], [170.0, -5.0]]]]
    part = layout.read_within(spark, path, area)
    want = {r.accident_id for r in spatial.within(df, area, limit=None).collect()}
    assert {9001, 9002} <= want and {r.accident_id for r in spatial.within(part, area, limit=None).collect()} == want
    assert layout.read_near(spark, path, -89.9, 0.0, 1.0).count() >= 0
    layout.write_clustered(df.limit(0), str(tmp_path / "e"))
    assert layout.read_near(spark, str(tmp_path / "e"), 0, 0, 10.0).count() == 0


def test_a_stream_parses_each_text_once(spark):
    raw = spark.createDataFrame([("A", "2", "2021-02-08 05:46:00", " 34.05", "-118.25", "LA"), ("B", "9", "2021-02-08 05:46:00", "34.05", "-118.25", "LA"), ("C", "2", "no time", "34.05", "-118.25", "LA"), ("D", None, None, None, "no-numero", None)], "accident_id string, severity string, start_time string, lat string, lon string, city string")
    got = ingest.clean_stream(raw)
    want = enrich.enriched(clean.kept(clean.tagged(raw.withColumn("pos", F.monotonically_increasing_id())))).drop("pos")
    assert got.count() == 1 and got.select(*want.columns).collect() == want.collect()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    for c in ("lat", "lon", "severity", "start_time"):
        assert 1 <= plan.count(f"try_cast(trim({c}#") <= 2  # a number is asked for twice, to leave out NaN


def test_increments_are_a_file_for_each_month(spark, tmp_path):
    """And an event is counted once for its four buckets of time."""
    df = spark.range(0, 3000, 1, 16).select(F.concat(F.lit("E"), "id").alias("accident_id"), (33 + F.col("id") % 37 / 10).alias("lat"), (-118 - F.col("id") % 23 / 10).alias("lon"), (F.col("id") % 4 + 1).cast("int").alias("severity"), F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id % 300 as int), cast(id % 24 as int))").alias("start_time"), F.concat(F.lit("City"), F.col("id") % 19).alias("city"), F.lit(1.0).alias("distance_mi"), F.lit("S1").alias("state"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks as there are with more rows
    try:
        partials.Increments(str(tmp_path)).add(df, "one")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table in partials.KEYS:
        months = [p for p in (tmp_path / table / "increment=one").iterdir() if p.is_dir()]
        assert len(months) == 10 and all(len(list(p.glob("*.parquet"))) == 1 for p in months)
    lines = partials.partial(df, "temporal")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert next(i for i, x in enumerate(lines) if "Generate" in x) < max(i for i, x in enumerate(lines) if "Aggregate" in x)  # below it, events are added up


def test_a_batch_is_kept_while_it_is_appended(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").cast("string").alias("accident_id")).repartition(4).write.parquet(str(tmp_path / "in"))
    append, kept = files.append_new, []

    def appended(batch, *args):
        kept.append(batch.storageLevel.useMemory)
        return append(batch, *args)

    monkeypatch.setattr(files, "append_new", appended)
    rows = spark.readStream.schema("accident_id string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    ingest.store_stream(rows, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert kept == [True, True] and spark.read.parquet(str(tmp_path / "out")).distinct().count() == 40
