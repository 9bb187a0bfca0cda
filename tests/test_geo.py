"""Golden values, and geohash against bisection."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.operators import spatial
from geolith.operators.spatial import polygon_error


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("lat", "lon", "p", "want"),
    [
        (42.6, -5.6, 5, "ezs42"),
        (57.64911, 10.40744, 11, "u4pruydqqvj"),
        (-25.382708, -49.265506, 6, "6gkzwg"),
        (38.8977, -77.0365, 8, "dqcjqcpe"),
        (51.5074, -0.1278, 7, "gcpvj0d"),
        (0.0, 0.1, 3, "kpb"),
        (100.0, 0.0, 5, None),
        (0.0, 0.0, 5, None),
    ],
)
def test_geohash_golden(spark, lat, lon, p, want):
    assert one(spark, geo.geohash(F.lit(lat), F.lit(lon), p))[0] == want


def bisected(lat, lon, p):
    low, high, out, axis = [-90.0, -180.0], [90.0, 180.0], "", 1
    for _ in range(p):
        v = 0
        for _ in range(5):
            mid, x = (low[axis] + high[axis]) / 2, (lat, lon)[axis]
            v = v * 2 + (x > mid)
            if x > mid:
                low[axis] = mid
            else:
                high[axis] = mid
            axis = 1 - axis
        out += geo.GEOHASH_ALPHABET[v]
    return out


def test_geohash_bisection_prefix_and_box(spark):
    rnd = random.Random(3)
    rows = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(300)]
    rows += [(float(a) / 8, float(b) / 8) for a in range(-720, 721, 144) for b in range(-1440, 1441, 288)]
    rows = [r for r in rows if r != (0.0, 0.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    out = df.select("lat", "lon", geo.geohash(lat, lon, 7).alias("g7"), geo.geohash(lat, lon, 4).alias("g4"))
    out = out.withColumns({"b": geo.geohash_bbox(F.col("g7"), 7), "m": geo.geohash_center(F.col("g7"), 7)})
    for r in out.collect():
        assert r.g7 == bisected(r.lat, r.lon, 7)
        assert r.g7.startswith(r.g4)
        assert r.b.min_lat <= r.lat <= r.b.max_lat and r.b.min_lon <= r.lon <= r.b.max_lon
        assert r.b.min_lat < r.m.lat < r.b.max_lat
    assert one(spark, geo.geohash_bbox(F.lit("ezsa2"), 5))[0] is None


def test_grid_and_distance(spark):
    def cell(lat, lon):
        return one(spark, geo.cell_anchor(F.lit(lat), 0.1), geo.cell_anchor(F.lit(lon), 0.1))

    assert tuple(cell(34.0522, -118.2437)) == (34.0, -118.3)
    assert tuple(cell(-33.95, -70.61)) == (-34.0, -70.7)
    assert one(spark, geo.grid_id(F.lit(34.0), F.lit(-118.3)))[0] == "34.0000_-118.3000"
    d = one(spark, geo.haversine_m(F.lit(34.0522), F.lit(-118.2437), F.lit(40.7128), F.lit(-74.0060)))[0]
    assert 3.9e6 < d < 4.0e6
    assert geo.meters_to_radians(6378137.0) == 1.0
    with pytest.raises(ValueError):
        geo.cell_anchor(F.lit(1.0), 1e-5)


def test_valid_points(spark):
    rows = [("34.05", "1", True), ("x", "1", False), (None, "1", False), ("0", "0", False), ("0", "1", True), ("90", "180", True), ("91", "0", False), ("NaN", "1", False)]
    df = spark.createDataFrame(rows, "lat string, lon string, want boolean")
    assert all(r.ok == r.want for r in df.select("want", geo.valid_point(F.col("lat"), F.col("lon")).alias("ok")).collect())


def test_near_box_holds_the_circle(spark):
    rnd = random.Random(5)
    for lat0, lon0, radius in ((0, 179.9, 50_000), (60, -179.95, 30_000), (89.9, 10, 20_000), (34, -118, 5_000), (-75, 0, 500_000)):
        rows = [(lat0 + rnd.uniform(-8, 8), (lon0 + rnd.uniform(-30, 30) + 180) % 360 - 180) for _ in range(400)]
        df = spark.createDataFrame([(max(-90.0, min(90.0, a)), b) for a, b in rows], "lat double, lon double")
        far = geo.haversine_m(F.lit(float(lat0)), F.lit(float(lon0)), F.col("lat"), F.col("lon"))
        assert df.where((far <= radius) & ~geo.near_box(F.col("lat"), F.col("lon"), lat0, lon0, radius)).isEmpty()


def test_containment(spark):
    area = [[[[0, 40], [40, 40], [40, 50], [0, 50], [0, 40]], [[10, 44], [20, 44], [20, 46], [10, 46], [10, 44]]]]
    cases = [(20.0, 41.0, False), (20.0, 43.0, True), (15.0, 45.0, False), (20.0, 50.5, True), (20.0, 53.0, False), (41.0, 45.0, False)]
    df = spark.createDataFrame(cases, "lon double, lat double, want boolean")
    column = F.lit(None)
    rings = [[F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ring]) for ring in p] for p in area]
    column = F.array(*[F.array(*p) for p in rings])
    out = df.select("want", geo.in_polygons(F.col("lat"), F.col("lon"), area).alias("a"), geo.in_polygon_column(F.col("lat"), F.col("lon"), column).alias("b"))
    for r in out.collect():
        assert r.want == r.a == r.b


@pytest.mark.parametrize(
    "bad", [[], [[]], [[[[0, 0], [1, 0], [0, 0]]]], [[[[0, 0], [1, 0], [1, 1], [0, 1]]]], [[[[0, 0], [1, 0], [1, 99], [0, 0]]]], [[[[-170, 0], [10, 0], [0, 20], [-170, 0]]]]]
)
def test_polygons_that_cannot_be_used(bad):
    with pytest.raises(ValueError):
        geo.check_polygons(bad)


def test_polygon_errors_as_column(spark):
    kind = "array<array<array<array<double>>>>"
    good = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]
    rows = [(good,), (None,), ([],), ([[[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]],), ([[[[0.0, 0.0], [1.0, 0.0], [1.0, 95.0], [0.0, 0.0]]]],), ([[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]]],)]
    got = [r[0] for r in spark.createDataFrame(rows, f"p {kind}").select(polygon_error(F.col("p"))).collect()]
    assert got == [None, "no rings", "no rings", "a ring needs four positions", "a position is out of range", "a ring is not closed"]


def star(cx, cy, r, n, seed):
    rnd = random.Random(seed)
    ring = [[(cx + r * rnd.uniform(0.4, 1) * math.cos(2 * math.pi * k / n) + 180) % 360 - 180, cy + r * rnd.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]
    return [*ring, ring[0]]


def around_pole(n, lat):
    ring = [[(-173 + 360 * k / n + 180) % 360 - 180, lat + 3 * math.sin(3 * k)] for k in range(n)]
    return [*ring, ring[0]]


#: Across the antimeridian, with a hole, around either pole (one with a hole), several polygons, tiny, and of many positions.
FAR_AREAS = [
    [[star(178, 10, 9, 40, 1)]],
    [[star(-120, 40, 30, 300, 2), star(-120, 40, 5, 10, 3)]],
    [[around_pole(12, 70.0)]],
    [[around_pole(12, -60.0), around_pole(8, -80.0)]],
    [[star(0, 0, 3, 5, 4)], [star(100, -30, 20, 17, 5)], [star(179, -50, 10, 30, 6)]],
    [[star(5, 5, 1e-4, 50, 7)]],
]


def turned_inside(area, lat, lon):
    """Containment in a frame where no edge crosses the antimeridian, or by the pole's own meridian count."""
    x = -180.0 if lon == 180 else lon
    for rings_ in area:
        n = 0
        for ring in rings_:
            total = mean = 0.0
            for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                d = (x2 - x1 + 180) % 360 - 180
                total += d
                mean += d * (math.sin(math.radians(y1)) + math.sin(math.radians(y2)))
                low, high = min(0.0, d), max(0.0, d)
                for turn in (-360, 0, 360):
                    at = x - x1 + turn
                    if low <= at < high:
                        a, b = math.radians(d - at), math.radians(at)
                        arc = math.atan((math.tan(math.radians(y1)) * math.sin(a) + math.tan(math.radians(y2)) * math.sin(b)) / math.sin(math.radians(d)))
                        n += arc > math.radians(lat)
            n += abs(total) > 180 and mean / total > 0
        if n % 2:
            return True
    return False


@pytest.fixture(scope="module")
def far_points():
    rnd = random.Random(9)
    far = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(1500)] + [(rnd.uniform(-90, 90), x) for x in (180.0, -180.0) for _ in range(40)]
    return [*far, (90.0, 3.0), (-90.0, 10.0)] + [(5 + rnd.uniform(-1.2e-4, 1.2e-4), 5 + rnd.uniform(-1.2e-4, 1.2e-4)) for _ in range(200)]


@pytest.mark.parametrize("written", [0, 10_000])
def test_containment_on_the_whole_sphere(spark, far_points, monkeypatch, written):
    monkeypatch.setattr(geo, "WRITTEN_EDGES", written)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(far_points)], "i long, lat double, lon double")
    for area in FAR_AREAS:
        if written and sum(len(r) for p in area for r in p) > 60:
            continue
        got = {r.i for r in df.where(geo.in_polygons(F.col("lat"), F.col("lon"), area)).collect()}
        assert got == {i for i, p in enumerate(far_points) if turned_inside(area, *p)}
    column = F.lit(json.dumps(FAR_AREAS[3]))
    column = F.from_json(column, "array<array<array<array<double>>>>")
    got = {r.i for r in df.where(geo.in_polygon_column(F.col("lat"), F.col("lon"), column)).collect()}
    assert got == {i for i, p in enumerate(far_points) if turned_inside(FAR_AREAS[3], *p)}


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_regions_on_the_whole_sphere(spark, far_points, monkeypatch, most):
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", most)
    kind = "array<array<array<array<double>>>>"
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(far_points)] + [(-1, None, 1.0)], "i long, lat double, lon double")
    bad = [(90, None), (91, []), (92, [[[[0.0, 0.0], [180.0, 0.0], [90.0, 5.0], [0.0, 0.0]]]])]
    regions = spark.createDataFrame([*enumerate(FAR_AREAS), *bad], f"region_id long, polygons {kind}")
    got = {(r.region_id, r.i) for r in spatial.within_join(df, regions).collect()}
    assert got == {(k, i) for k, area in enumerate(FAR_AREAS) for i, p in enumerate(far_points) if turned_inside(area, *p)}
    assert spatial.within_join(df, regions.limit(0)).count() == 0 and spatial.within_join(df.limit(0), regions).count() == 0
    assert [r.e for r in regions.where("region_id >= 90").orderBy("region_id").select(polygon_error(F.col("polygons")).alias("e")).collect()] == ["no rings", "no rings", "an edge of 180 degrees has no direction"]


def test_few_points_are_tested(spark, far_points):
    """Inner cells spare the test, and a cell on a boundary brings few of a long outline's edges."""
    ring = [[(20 + math.cos(50 * a)) * math.cos(a), (20 + math.cos(50 * a)) * math.sin(a)] for a in (2 * math.pi * k / 10_000 for k in range(10_000))]
    outline = [[[*ring, ring[0]]]]
    regions = spark.createDataFrame([(1, outline)], "region_id long, polygons array<array<array<array<double>>>>")
    cells = spatial.region_cells(regions).select("_inside", F.aggregate("_polygons", F.lit(0), lambda n, p: n + F.size(p["edges"])).alias("n")).collect()
    assert sum(r._inside for r in cells) > 50 and len(cells) < 1500
    began = time.perf_counter()
    df = spark.range(1000).select((F.col("id") % 40 - 20).cast("double").alias("lat"), (F.col("id") % 37 - 18).cast("double").alias("lon"))
    df.where(geo.in_polygons(F.col("lat"), F.col("lon"), outline)).count()
    assert time.perf_counter() - began < 20


def test_wide_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 170.0), (10.0, -175.0), (10.0, 179.0), (40.0, 0.0)], "lat double, lon double")
    inside = df.where(geo.in_polygons(F.col("lat"), F.col("lon"), geo.box_rings(-170, -20, 175, 20))).collect()
    assert {(r.lat, r.lon) for r in inside} == {(0.0, 0.0), (10.0, 170.0)}
