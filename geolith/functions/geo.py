"""Geometry as Column expressions: validity, grid cells, geohashes, distances, containment.

Distances are metres on a sphere of radius ``EARTH_RADIUS_M``; coordinates are degrees, GeoJSON order is
longitude, latitude. Everything is built from functions that Spark compiles; nothing here is a UDF.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolith.functions import rings
from geolith.functions.rings import Ring
from geolith.functions.values import to_number

# Fixed values.
EARTH_RADIUS_M = 6378137.0
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def valid_lat(c: Column) -> Column:
    return _within(c, 90.0)


def valid_lon(c: Column) -> Column:
    return _within(c, 180.0)


def _within(c: Column, most: float) -> Column:
    x = to_number(c)
    return F.coalesce(~F.isnan(x) & x.between(-most, most), F.lit(False))


def valid_point(lat: Column, lon: Column) -> Column:
    """Both in range, and not exactly (0, 0)."""
    return valid_lat(lat) & valid_lon(lon) & ~F.coalesce((to_number(lat) == 0.0) & (to_number(lon) == 0.0), F.lit(False))


def point(lat: Column, lon: Column) -> Column:
    """A GeoJSON point."""
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def bbox_polygon(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """A box as a GeoJSON polygon of one closed ring."""
    corners = [(min_lon, min_lat), (max_lon, min_lat), (max_lon, max_lat), (min_lon, max_lat), (min_lon, min_lat)]
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(*[F.array(x, y) for x, y in corners])).alias("coordinates"))


def box_rings(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> list[list[list[list[float]]]]:
    """A box as the coordinates of a multipolygon. ValueError if it is not ordered.

    Edges go the shorter way, so one that is 180 degrees wide or more has further corners.
    """
    if not (min_lon < max_lon and min_lat < max_lat):
        raise ValueError("a box needs min_lon < max_lon and min_lat < max_lat")
    parts = math.ceil((max_lon - min_lon) / 90) if max_lon - min_lon >= 180 else 1
    between = [min_lon + (max_lon - min_lon) * i / parts for i in range(1, parts)]
    xs = [min_lon, *between, max_lon]
    return [[[[x, min_lat] for x in xs] + [[x, max_lat] for x in reversed(xs)] + [[min_lon, min_lat]]]]


def cell_index(x: Column, cell: float) -> Column:
    return F.floor(x / F.lit(float(cell)))


def cell_anchor(x: Column, cell: float, digits: int | None = None) -> Column:
    """The lower edge of the cell that holds x."""
    if cell < 1e-4:
        raise ValueError("cells below 0.0001 degrees have no distinct names")
    d = max(0, -math.floor(math.log10(cell)) + 2) if digits is None else digits
    return F.round(cell_index(x, cell) * F.lit(float(cell)), d)


def grid_id(lat: Column, lon: Column) -> Column:
    """Name of the cell with this lower left corner."""
    return F.format_string("%.4f_%.4f", lat, lon)


def _axis_index(x: Column, low: float, span: float, bits: int) -> Column:
    """The interval of x among 2**bits; a point on a boundary belongs to the lower one."""
    n = 1 << bits
    x = F.greatest(F.lit(low), F.least(F.lit(low + span), x))
    k = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((x - low) / (span / n)) - 1)).cast("long")

    def bound(i: Column) -> Column:
        return F.lit(low) + i * F.lit(span) / F.lit(float(n))

    return F.when((x > bound(k + 1)) & (k < n - 1), k + 1).when((x <= bound(k)) & (k > 0), k - 1).otherwise(k)


def geohash_indices(lat: Column, lon: Column, precision: int) -> tuple[Column, Column]:
    """The numbers of a valid point's geohash cell along longitude and latitude."""
    if not 1 <= precision <= 12:
        raise ValueError("precision is 1 to 12")
    return _axis_index(lon, -180.0, 360.0, (5 * precision + 1) // 2), _axis_index(lat, -90.0, 180.0, 5 * precision // 2)


def geohash_text(x: Column, y: Column, precision: int) -> Column:
    """The geohash of the cell with these numbers."""
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            bit = 5 * c + j
            axis, shift = (x, lon_bits - 1 - bit // 2) if bit % 2 == 0 else (y, lat_bits - 1 - bit // 2)
            value = value + F.shiftleft(F.shiftright(axis, shift).bitwiseAND(F.lit(1)), 4 - j)
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash(lat: Column, lon: Column, precision: int = 5) -> Column:
    """Geohash of a point; null where the point is not valid.

    Nothing but the last, empty piece depends on a condition, so compiled code computes the two cell numbers once.
    """
    text = geohash_text(*geohash_indices(lat, lon, precision), precision)
    return F.concat(text, F.when(valid_point(lat, lon), F.lit("")))


def geohash_bbox(gh: Column, precision: int) -> Column:
    """struct(min_lat, min_lon, max_lat, max_lon) of a geohash of this length; null if a character is not in the alphabet."""
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    values = F.transform(F.sequence(F.lit(1), F.lit(precision)), lambda i: F.position(F.substring(gh, i, F.lit(1)), F.lit(GEOHASH_ALPHABET)) - 1)

    def boxed(v: Column) -> Column:
        x = y = F.lit(0).cast("long")
        for bit in range(5 * precision):
            b = F.shiftright(v[bit // 5], 4 - bit % 5).bitwiseAND(F.lit(1)).cast("long")
            if bit % 2 == 0:
                x = x + F.shiftleft(b, lon_bits - 1 - bit // 2)
            else:
                y = y + F.shiftleft(b, lat_bits - 1 - bit // 2)

        def bound(i: Column, low: float, span: float, bits: int) -> Column:
            return F.lit(low) + i * F.lit(span) / F.lit(float(1 << bits))

        box = F.struct(
            bound(y, -90.0, 180.0, lat_bits).alias("min_lat"),
            bound(x, -180.0, 360.0, lon_bits).alias("min_lon"),
            bound(y + 1, -90.0, 180.0, lat_bits).alias("max_lat"),
            bound(x + 1, -180.0, 360.0, lon_bits).alias("max_lon"),
        )
        return F.when((F.length(gh) == precision) & (F.array_min(v) >= 0), box)

    return F.transform(F.array(values), boxed)[0]


def geohash_center(gh: Column, precision: int) -> Column:
    """struct(lat, lon) of the middle of a geohash cell."""
    return F.transform(F.array(geohash_bbox(gh, precision)), lambda b: F.when(b.isNotNull(), F.struct(((b["min_lat"] + b["max_lat"]) / 2).alias("lat"), ((b["min_lon"] + b["max_lon"]) / 2).alias("lon"))))[0]


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def meters_to_radians(m: Column | float) -> Column | float:
    return m / EARTH_RADIUS_M


def near_boxes(lat0: float, lon0: float, radius_m: float) -> list[tuple[float, float, float, float]]:
    """Boxes (min_lat, max_lat, min_lon, max_lon) that together hold all points within the radius: two across the antimeridian."""
    angle = radius_m / EARTH_RADIUS_M * (1 + 1e-9) + 1e-12
    dlat = math.degrees(angle)
    south, north = lat0 - dlat, lat0 + dlat
    if abs(lat0) + dlat >= 90 or angle >= math.pi / 2:
        return [(south, north, -180.0, 180.0)]
    dlon = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat0))))) + 1e-9
    west, east = lon0 - dlon, lon0 + dlon
    if west < -180:
        return [(south, north, -180.0, east), (south, north, west + 360, 180.0)]
    if east > 180:
        return [(south, north, -180.0, east - 360), (south, north, west, 180.0)]
    return [(south, north, west, east)]


def near_box(lat: Column, lon: Column, lat0: float, lon0: float, radius_m: float) -> Column:
    """Plain comparisons that hold for all points within the radius; they reach the Parquet scan."""
    boxes = near_boxes(lat0, lon0, radius_m)
    south, north, west, east = boxes[0]
    box = lat.between(south, north)
    if (west, east) == (-180.0, 180.0):
        return box
    if len(boxes) == 2:
        return box & ((lon >= boxes[1][2]) | (lon <= east))
    return box & lon.between(west, east)


def check_polygons(polygons: Sequence[Sequence[Ring]]) -> None:
    """ValueError unless these are the coordinates of a usable multipolygon."""
    if error := rings.ring_error(polygons):
        raise ValueError(error)


#: Edges up to which a containment test is written out, one comparison for each; more are looked up.
WRITTEN_EDGES = 24


def in_polygons(lat: Column, lon: Column, polygons: Sequence[Sequence[Ring]]) -> Column:
    """Whether a point is in a multipolygon (coordinates as in GeoJSON) whose edges are great-circle arcs.

    Holes count by parity within a polygon; the polygons are joined by OR. Edges may cross the antimeridian and rings go around a
    pole (see ``rings``). A box around the arcs comes first as plain comparisons. Of many edges only those at the point's longitude are
    tested: a constant tree over slabs of longitude holds them, and a binary search finds the slab.
    """
    check_polygons(polygons)
    south, north, stretches = rings.bounds(polygons)
    slack = 1e-3
    box = lat.between(south - slack, north + slack)
    if stretches != [(-180.0, 180.0)]:
        beside = functools.reduce(operator.or_, [lon.between(a, b) for a, b in stretches])
        box = box & (beside | (lon == 180.0) if stretches[0][0] == -180 else beside)
    x = _on_sphere(lon)
    parts = [rings.polygon_edges(p) for p in polygons]
    return box & (_written_out(lat, x, parts) if sum(len(e) for e, _ in parts) <= WRITTEN_EDGES else _looked_up(lat, x, rings.slab_index(polygons)))


def _on_sphere(lon: Column) -> Column:
    return F.when(lon == 180.0, -180.0).otherwise(lon)


def _arc_above(lat: Column, lon: Column, x1: Column, x2: Column, t1: Column, t2: Column, s: Column) -> Column:
    """Whether the arc from (x1, y1) to (x2, y2), given by t = tan(y) and s = sin(x2 - x1), passes north of a point."""
    return F.atan((t1 * F.sin(F.radians(x2 - lon)) + t2 * F.sin(F.radians(lon - x1))) / s) > F.radians(lat)


def _written_out(lat: Column, lon: Column, parts: list) -> Column:
    inside = F.lit(False)
    for edges, holds_north in parts:
        crossings = F.lit(int(holds_north))
        for lo, hi, *arc in edges.tolist():
            crossings = crossings + F.when((lon >= lo) & (lon < hi) & _arc_above(lat, lon, *map(F.lit, arc)), 1).otherwise(0)
        inside = inside | (crossings % 2 == 1)
    return inside


def _looked_up(lat: Column, lon: Column, index: dict) -> Column:
    """Text constants that Spark reads when it plans: the expression is as long as for any other number of edges."""
    edge = rings.EDGE_TYPE.removesuffix(">") + ", polygon: int>"
    kinds = {"breaks": "double", "steps": "int", "nodes": "array<int>", "edges": edge, "flips": "int"}
    fixed = {c: F.from_json(F.lit(json.dumps(index[c])), f"array<{kind}>") for c, kind in kinds.items()}
    size, slabs = 1 << index["depth"], len(index["breaks"]) - 1
    passed = F.aggregate(fixed["steps"], F.lit(0), lambda n, step: n + F.when(F.get(fixed["breaks"], n + step - 1) <= lon, step).otherwise(0))

    def polygons_above(n: Column) -> Column:
        """The numbers of the polygons of all edges above the point, each as often as it has some."""
        path = F.transform(F.sequence(F.lit(0), F.lit(index["depth"])), lambda k: F.get(fixed["nodes"], F.call_function("shiftright", n - 1 + size, k)))
        here = F.when((n >= 1) & (n <= slabs), F.flatten(path)).otherwise(F.array().cast("array<int>"))
        edges = F.transform(here, lambda i: F.get(fixed["edges"], i))
        above = F.filter(edges, lambda e: _arc_above(lat, lon, *(e[c] for c in rings.EDGE[2:])))
        return F.concat(F.transform(above, lambda e: e["polygon"]), fixed["flips"])

    def odd(found: Column) -> Column:
        return F.exists(F.array_distinct(found), lambda p: F.size(F.filter(found, lambda q: q == p)) % 2 == 1)

    return F.exists(F.transform(F.array(passed), polygons_above), odd)


def polygon_edges(polygons: Column) -> Column:
    """What ``inside_edges`` needs of a column of multipolygons (array<array<array<array<double>>>>): of each polygon its edges, and whether it holds the north pole (``odd``)."""

    def turn(a: Column, b: Column) -> Column:
        d = b[0] - a[0]
        return F.when(F.abs(d) == 360, 0.0).when(F.abs(d) > 180, d - F.signum(d) * 360).otherwise(d)

    def pieces(a: Column, b: Column) -> Column:
        def piece(x1: Column, x2: Column) -> Column:
            lo, hi = F.greatest(F.least(x1, x2), F.lit(-180.0)), F.least(F.greatest(x1, x2), F.lit(180.0))
            values = lo, hi, x1, x2, F.tan(F.radians(a[1])), F.tan(F.radians(b[1])), F.sin(F.radians(x2 - x1))
            return F.struct(*[v.alias(c) for v, c in zip(values, rings.EDGE, strict=True)])

        x1, x2 = a[0], b[0]
        d, whole = x2 - x1, F.signum(x2 - x1) * 360
        one, two = F.array(piece(x1, x2)), F.array(piece(x1, x2 - whole), piece(x1 + whole, x2))
        return F.when(F.abs(d) == 360, F.array_remove(one, one[0])).when(F.abs(d) > 180, two).otherwise(F.filter(one, lambda e: e["lo"] < e["hi"]))

    def sides(ring: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))

    def total(ring: Column, of) -> Column:
        return F.aggregate(sides(ring), F.lit(0.0), lambda sum_, e: sum_ + of(e["a"], e["b"]))

    def holds_north(ring: Column) -> Column:
        north = total(ring, lambda a, b: (F.sin(F.radians(a[1])) + F.sin(F.radians(b[1]))) * turn(a, b))
        around = total(ring, turn)
        return (F.abs(around) > 180) & (north * around > 0)

    def whole(ring: Column) -> Column:
        return F.flatten(F.transform(sides(ring), lambda e: pieces(e["a"], e["b"])))

    return F.transform(polygons, lambda p: F.struct((F.size(F.filter(p, holds_north)) % 2 == 1).alias("odd"), F.flatten(F.transform(p, whole)).alias("edges")))


def inside_edges(lat: Column, lon: Column, polygons: Column) -> Column:
    """Whether a point is in one of several polygons (array<struct<odd, edges>>): whether the edges that count at its longitude and pass north of it are odd in number, or even if ``odd``."""
    x = _on_sphere(lon)

    def crossed(e: Column) -> Column:
        return (x >= e["lo"]) & (x < e["hi"]) & _arc_above(lat, x, *(e[c] for c in rings.EDGE[2:]))

    return F.exists(polygons, lambda p: (F.size(F.filter(p["edges"], crossed)) % 2 == 1) != p["odd"])


def in_polygon_column(lat: Column, lon: Column, polygons: Column) -> Column:
    """``in_polygons`` for a column of multipolygons."""
    return inside_edges(lat, lon, polygon_edges(polygons))
