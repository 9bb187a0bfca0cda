"""Rings of great-circle arcs as edges, and two indexes over them: slabs of longitude for one area, cells for many regions.

A point is inside a polygon if the meridian from it to the north pole crosses the polygon's edges an odd number of times (so
holes are rings like others). Two things make that hold on the whole sphere: an edge goes the shorter way, so one whose ends lie more
than 180 degrees apart crosses the antimeridian and counts as two pieces; and a ring that winds around a pole divides the
sphere in two, of which the smaller side is meant: if that holds the north pole, inside and outside change places. Longitude 180 is -180.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

Ring = Sequence[Sequence[float]]
#: Of each edge: the longitudes [lo, hi) where it counts, and its arc: longitudes of its ends, tangents of their latitudes, sine between.
EDGE = ("lo", "hi", "x1", "x2", "t1", "t2", "s")
EDGE_TYPE = "struct<" + ", ".join(f"{c}: double" for c in EDGE) + ">"


def ring_error(polygons: Sequence[Sequence[Ring]] | None) -> str | None:
    """Why a multipolygon (coordinates as in GeoJSON) cannot be used; None where it can."""
    if not polygons or not all(polygons):
        return "no rings"
    for rings in polygons:
        for ring in rings:
            if ring is None or len(ring) < 4:
                return "a ring needs four positions"
            if any(xy is None or len(xy) < 2 or xy[0] is None or xy[1] is None or not (-180 <= xy[0] <= 180 and -90 <= xy[1] <= 90) for xy in ring):
                return "a position is out of range"
            if list(ring[0]) != list(ring[-1]):
                return "a ring is not closed"
            if any(abs(a[0] - b[0]) == 180 for a, b in zip(ring, ring[1:], strict=False)):
                return "an edge of 180 degrees has no direction"
    return None


def ring_edges(ring: Ring) -> tuple[np.ndarray, float, bool]:
    """A ring's edges (rows of EDGE), the degrees of longitude that it goes around, and whether it holds the north pole."""
    x, y = (np.array([xy[i] for xy in ring], np.float64) for i in (0, 1))
    x1, x2, y1, y2 = x[:-1], x[1:], y[:-1], y[1:]
    d = x2 - x1
    turn = np.where(np.abs(d) > 180, d - np.copysign(360.0, d), d)
    turn[np.abs(d) == 360] = 0
    around = turn.sum()
    holds_north = bool(abs(around) > 180 and ((np.sin(np.radians(y1)) + np.sin(np.radians(y2))) * turn).sum() / around > 0)
    pieces = []
    for mask, shift1, shift2 in ((np.abs(d) <= 180, 0, 0), ((d > 180) & (d < 360), 0, -360), ((d > 180) & (d < 360), 360, 0), ((d < -180) & (d > -360), 0, 360), ((d < -180) & (d > -360), -360, 0)):
        mask = mask & (turn != 0)
        a, b = x1[mask] + shift1, x2[mask] + shift2
        lo, hi = np.maximum(np.minimum(a, b), -180.0), np.minimum(np.maximum(a, b), 180.0)
        arc = [a, b, np.tan(np.radians(y1[mask])), np.tan(np.radians(y2[mask])), np.sin(np.radians(b - a))]
        rows = np.column_stack([lo, hi, *arc])
        pieces.append(rows[rows[:, 0] < rows[:, 1]])
    return np.concatenate(pieces), float(around), holds_north


def polygon_edges(rings: Sequence[Ring]) -> tuple[np.ndarray, bool]:
    """All edges of a polygon, and whether inside and outside change places."""
    found = [ring_edges(r) for r in rings]
    return np.concatenate([e for e, _, _ in found]), sum(n for _, _, n in found) % 2 == 1


def _meridians(rings: Sequence[Ring]) -> np.ndarray:
    """The edges of a polygon along meridians, which no count needs but which bound it: as rows of EDGE of no width, and their least and greatest latitude."""
    ends = np.array([(*a[:2], *b[:2]) for ring in rings for a, b in zip(ring, ring[1:], strict=False) if abs(a[0] - b[0]) in (0, 360)], np.float64).reshape(-1, 4)
    x, one = ends[:, 0], np.ones(len(ends))
    return np.column_stack([x, x, x, x + 1, one, one, one, np.minimum(ends[:, 1], ends[:, 3]), np.maximum(ends[:, 1], ends[:, 3])])


def _arc(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """C and D of tan(latitude) = C cos(longitude) + D sin(longitude)."""
    x1, x2 = np.radians(edges[:, 2]), np.radians(edges[:, 3])
    return (edges[:, 4] * np.sin(x2) - edges[:, 5] * np.sin(x1)) / edges[:, 6], (edges[:, 5] * np.cos(x1) - edges[:, 4] * np.cos(x2)) / edges[:, 6]


def _lat_range(c: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest latitude of arcs between two longitudes, in degrees."""
    a, b = np.radians(lo), np.radians(hi)
    ends = [np.arctan(c * np.cos(x) + d * np.sin(x)) for x in (a, b)]
    low, high, most, peak = np.minimum(*ends), np.maximum(*ends), np.arctan(np.hypot(c, d)), np.arctan2(d, c)
    high = np.where(np.mod(peak - a, 2 * np.pi) <= b - a, most, high)
    low = np.where(np.mod(peak + np.pi - a, 2 * np.pi) <= b - a, -most, low)
    return np.degrees(low), np.degrees(high)


def bounds(polygons: Sequence[Sequence[Ring]]) -> tuple[float, float, list[tuple[float, float]]]:
    """Least and greatest latitude of a multipolygon, and the stretches of longitude that it may touch (at most four)."""
    lats, stretches = [], []
    for rings in polygons:
        edges, flips = polygon_edges(rings)
        around = max((abs(a) for _, a, _ in map(ring_edges, rings)), default=0.0)
        if len(edges):
            low, high = _lat_range(*_arc(edges), edges[:, 0], edges[:, 1])
            lats += [float(low.min()), float(high.max())]
        lats += [float(xy[1]) for ring in rings for xy in ring]
        if around > 180:
            lats.append(90.0 if flips else -90.0)
            stretches.append((-180.0, 180.0))
        else:
            stretches += [(float(e[0]), float(e[1])) for e in edges]
            stretches += [(float(xy[0]), float(xy[0])) for ring in rings for xy in ring]
    merged: list[list[float]] = []
    for a, b in sorted(stretches):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    if len(merged) > 4:
        merged = [[merged[0][0], merged[-1][1]]]
    return min(lats), max(lats), [(a, b) for a, b in merged]


# --- one area: slabs of longitude ---


def slab_index(polygons: Sequence[Sequence[Ring]]) -> dict:
    """The edges of a multipolygon with the number of their polygon, in a tree over the slabs between the longitudes where edges begin and end.

    Slab i lies below nodes (size + i) >> 0, 1, ..., depth; an edge stands at the few nodes that make up its slabs, so the edges at
    a longitude are those of one path. ``flips``: polygons that hold the north pole.
    """
    parts = [polygon_edges(rings) for rings in polygons]
    edges = np.concatenate([e for e, _ in parts])
    of = np.repeat(np.arange(len(parts)), [len(e) for e, _ in parts])
    breaks = np.unique(edges[:, :2])
    slabs = max(1, len(breaks) - 1)
    depth = math.ceil(math.log2(slabs)) if slabs > 1 else 0
    nodes: list[list[int]] = [[] for _ in range(2 << depth)]
    firsts, ends = np.searchsorted(breaks, edges[:, 0]).tolist(), np.searchsorted(breaks, edges[:, 1]).tolist()
    for e, (a, b) in enumerate(zip(firsts, ends, strict=True)):
        a, b = a + (1 << depth), b + (1 << depth)
        while a < b:
            if a & 1:
                nodes[a].append(e)
                a += 1
            if b & 1:
                b -= 1
                nodes[b].append(e)
            a, b = a >> 1, b >> 1
    steps = [1 << k for k in range(max(0, len(breaks)).bit_length(), -1, -1)]
    rows = [dict(zip(EDGE, row, strict=True)) | {"polygon": p} for row, p in zip(edges.tolist(), of.tolist(), strict=True)]
    return {"breaks": breaks.tolist(), "steps": steps, "depth": depth, "nodes": nodes, "edges": rows, "flips": [i for i, (_, f) in enumerate(parts) if f]}


# --- many regions: cells ---

#: Cells of level k are 360 / 2**k degrees high and wide. Regions are covered by cells of three levels that are even, the finest such that
#: a square of a region's size has 8 to 32 of them along its side, but none finer than LAST_LEVEL.
LAST_LEVEL, STEP = 26, 2
#: Degrees by which a cell is taken larger than it is, so that a rounded point is in it.
SLACK = 1e-9
#: Edges of regions that are covered together.
BATCH_EDGES = 20_000


def _roots(polygons: Sequence[Sequence[Ring]]) -> tuple[int, np.ndarray, np.ndarray]:
    """The level of the first cells, and their rows and columns."""
    south, north, stretches = bounds(polygons)
    wide = sum(b - a for a, b in stretches) if len(stretches) < 4 else 360.0
    high = north - south
    side = max(math.sqrt(high * wide), max(high, wide) / 16, 360 * 2.0**-LAST_LEVEL)  # the shape counts, and a long one does not have too many
    first = max(0, min(LAST_LEVEL - 2 * STEP, STEP * math.floor((math.log2(360 / side) + 1) / STEP)))
    size = 360 / 2**first
    i = np.arange(math.floor((south + 90 - SLACK) / size), math.floor((north + 90 + SLACK) / size) + 1)
    j = np.unique(np.concatenate([np.arange(math.floor((a + 180 - SLACK) / size), math.floor((b + 180 + SLACK) / size) + 1) % 2**first for a, b in stretches]))
    return first, np.repeat(i, len(j)), np.tile(j, len(i))


class _Cells:
    """Cells of regions, what is known of each polygon there (an entry: is the number of its edges above all of the cell odd?), and the edges that matter there."""

    def __init__(self, region, level, i, j, entry_cell, odd, pair_entry, pair_edge):
        self.region, self.level, self.i, self.j = region, level, i, j
        self.entry_cell, self.odd, self.pair_entry, self.pair_edge = entry_cell, odd, pair_entry, pair_edge

    def settle(self, edges: np.ndarray, c: np.ndarray, d: np.ndarray, stands: np.ndarray) -> np.ndarray:
        """Drops what cannot matter. Returns each cell's kind: 0 outside, 1 on a boundary, 2 inside. ``stands``: latitudes of edges along meridians, else NaN."""
        size = 360.0 / 2.0**self.level
        x0, y0 = -180 + self.j * size - SLACK, -90 + self.i * size - SLACK
        x1, y1 = x0 + size + 2 * SLACK, y0 + size + 2 * SLACK
        at, e = self.entry_cell[self.pair_entry], self.pair_edge
        lo, hi = edges[e, 0], edges[e, 1]
        beside = (lo < x1[at]) & (hi > x0[at])
        low, high = _lat_range(c[e], d[e], np.maximum(lo, np.minimum(x0[at], hi)), np.minimum(hi, np.maximum(x1[at], lo)))
        upright = ~np.isnan(stands[e, 0])
        low, high = np.where(upright, stands[e, 0], low), np.where(upright, stands[e, 1], high)
        over = beside & (low > y1[at]) & (lo <= x0[at]) & (hi >= x1[at])
        n = len(self.entry_cell)
        self.odd = self.odd ^ (np.bincount(self.pair_entry[over], minlength=n) % 2 == 1)
        keep = beside & (high >= y0[at]) & ~over
        touches = np.bincount(self.pair_entry[keep & (low <= y1[at])], minlength=n) > 0
        middle = (x0[at] + x1[at]) / 2
        above = np.bincount(self.pair_entry[keep & (lo <= middle) & (middle < hi)], minlength=n)  # where nothing touches the cell, all of these are above it
        inside = ~touches & (self.odd ^ (above % 2 == 1))
        kind = np.zeros(len(self.region), np.int8)
        kind[self.entry_cell[touches]] = 1
        kind[self.entry_cell[inside]] = 2
        keep &= touches[self.pair_entry]
        self.pair_entry, self.pair_edge = self.pair_entry[keep], self.pair_edge[keep]
        self._only_entries(touches)
        return kind

    def _only_entries(self, mask: np.ndarray) -> None:
        place = np.cumsum(mask) - 1
        kept = mask[self.pair_entry]
        self.pair_entry, self.pair_edge = place[self.pair_entry[kept]], self.pair_edge[kept]
        self.entry_cell, self.odd = self.entry_cell[mask], self.odd[mask]

    def only(self, cells: np.ndarray) -> _Cells:
        """Some of the cells."""
        self._only_entries(cells[self.entry_cell])
        place = np.cumsum(cells) - 1
        return _Cells(self.region[cells], self.level[cells], self.i[cells], self.j[cells], place[self.entry_cell], self.odd, self.pair_entry, self.pair_edge)

    def children(self) -> _Cells:
        """The 4**STEP cells in each, with all that their parents know."""
        side = 1 << STEP
        n, n_entries, k = len(self.region), len(self.entry_cell), side * side
        part = np.arange(k)

        def each(x: np.ndarray, total: int) -> np.ndarray:
            return (x[:, None] * k + part).reshape(-1) if total else x

        i = (self.i[:, None] * side + part // side).reshape(-1)
        j = (self.j[:, None] * side + part % side).reshape(-1)
        return _Cells(np.repeat(self.region, k), np.repeat(self.level + STEP, k), i, j, each(self.entry_cell, n_entries), np.repeat(self.odd, k), each(self.pair_entry, n), np.repeat(self.pair_edge, k))


def covers(many: list[Sequence[Sequence[Ring]]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """The cells of several multipolygons at once: number of the multipolygon, level, row, column, and what decides there.

    That is None in a cell that lies inside; else a list of the polygons whose boundary meets the cell, each as whether the number of
    edges above all of the cell is odd, and the edges (rows of EDGE) that may lie above a point there.
    """
    edge_rows, latitudes, flips, of_region, roots = [], [], [], [], []
    for r, polygons in enumerate(many):
        for rings in polygons:
            rows, flip = polygon_edges(rings)
            upright = _meridians(rings)
            edge_rows.append(np.concatenate([rows, upright[:, :-2]]))
            latitudes += [np.full((len(rows), 2), np.nan), upright[:, -2:]]
            flips.append(flip)
            of_region.append(r)
        roots.append(_roots(polygons))
    if not many:
        return []
    edges = np.concatenate(edge_rows)
    stands = np.concatenate(latitudes)
    c, d = _arc(edges)
    n_edges = np.array([len(e) for e in edge_rows])
    starts = np.cumsum(n_edges) - n_edges
    region = np.repeat(np.arange(len(many)), [len(i) for _, i, _ in roots])
    level = np.repeat([k for k, _, _ in roots], [len(i) for _, i, _ in roots])
    i, j = (np.concatenate([x[k] for x in roots]).astype(np.int64) for k in (1, 2))
    # an entry for each root cell and each polygon of its region
    first_polygon = np.searchsorted(of_region, np.arange(len(many)))
    n_polygons = np.bincount(of_region, minlength=len(many))
    per_cell = n_polygons[region]
    entry_cell = np.repeat(np.arange(len(region)), per_cell)
    polygon = first_polygon[region[entry_cell]] + np.arange(len(entry_cell)) - np.repeat(np.cumsum(per_cell) - per_cell, per_cell)
    per_entry = n_edges[polygon]
    pair_entry = np.repeat(np.arange(len(polygon)), per_entry)
    pair_edge = starts[polygon[pair_entry]] + np.arange(len(pair_entry)) - np.repeat(np.cumsum(per_entry) - per_entry, per_entry)
    cells = _Cells(region, level, i, j, entry_cell, np.array(flips, bool)[polygon], pair_entry, pair_edge)
    out = []
    for depth in range(3):
        kind = cells.settle(edges, c, d, stands)
        inner = kind == 2
        if inner.any():
            out.append((cells.region[inner], cells.level[inner], cells.i[inner], cells.j[inner], [None] * int(inner.sum())))
        cells = cells.only(kind == 1)
        if depth < 2:
            cells = cells.children()
    by_entry = cells.pair_edge[np.argsort(cells.pair_entry, kind="stable")]
    held = np.split(by_entry, np.cumsum(np.bincount(cells.pair_entry, minlength=len(cells.entry_cell)))[:-1]) if len(cells.entry_cell) else []
    what: list[list] = [[] for _ in cells.region]
    for cell, odd, own in zip(cells.entry_cell.tolist(), cells.odd.tolist(), held, strict=True):
        what[cell].append((odd, edges[own[np.isnan(stands[own, 0])]]))
    out.append((cells.region, cells.level, cells.i, cells.j, what))
    return out
