"""Planar geometry on rings (arrays of struct<x, y>) as column expressions.

Polygon clipping and line simplification have no built-in form; they are Arrow UDFs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring points, the last with the first."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """struct<x, y>; null for a ring without area."""
    a = signed_area(ring)

    def moment(axis):
        return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e[f"{axis}1"] + e[f"{axis}2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]))

    return F.when(a != 0, F.struct((moment("x") / (6 * a)).alias("x"), (moment("y") / (6 * a)).alias("y")))


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule. Pair it with a test of bounds, which can be pushed down."""

    def crosses(e):
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.aggregate(_edges(ring), F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))


def hexagon(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the pointy-top hexagon of a point, by cube rounding."""
    q = (math.sqrt(3) / 3 * x - y / 3) / size
    r = (2 / 3 * y) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr).cast("long")


def hexagon_centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    return size * math.sqrt(3) * (q + r / 2), size * 1.5 * r


def hexagon_ring(q: Column, r: Column, size: float) -> Column:
    cx, cy = hexagon_centre(q, r, size)
    return F.array(*(F.struct((cx + size * math.cos(math.pi / 6 + k * math.pi / 3)).alias("x"), (cy + size * math.sin(math.pi / 6 + k * math.pi / 3)).alias("y")) for k in range(6)))


def clip_ring(subject: list[tuple[float, float]], convex: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a ring inside a convex ring given counter-clockwise."""
    out = list(subject)
    for k, (ax, ay) in enumerate(convex):
        bx, by = convex[(k + 1) % len(convex)]
        side = [(bx - ax) * (py - ay) - (by - ay) * (px - ax) for px, py in out]
        cut = []
        for i, (p, d) in enumerate(zip(out, side)):
            q, e = out[i - 1], side[i - 1]
            if (d >= 0) != (e >= 0):
                t = e / (e - d)
                cut.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d >= 0:
                cut.append(p)
        out = cut
        if not out:
            break
    return out


@F.udf(RING, useArrow=True)
def clipped(subject, convex):
    """Ring of a polygon clipped by a convex ring, as an Arrow UDF."""
    if subject is None or convex is None:
        return None
    return [{"x": x, "y": y} for x, y in clip_ring([(p["x"], p["y"]) for p in subject], [(p["x"], p["y"]) for p in convex])]


def simplify_line(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Keeps the points farther than the tolerance from the chord of their part (Douglas-Peucker)."""
    if len(points) < 3:
        return list(points)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = points[a], points[b]
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        far, at = -1.0, None
        for i in range(a + 1, b):
            px, py = points[i]
            t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / length)) if length else 0.0
            d = math.hypot(px - ax - t * dx, py - ay - t * dy)
            if d > far:
                far, at = d, i
        if at is not None and far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def simplified(tolerance: float):
    @F.udf(RING, useArrow=True)
    def run(line):
        return None if line is None else [{"x": x, "y": y} for x, y in simplify_line([(p["x"], p["y"]) for p in line], tolerance)]

    return run


def stitch(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from pieces that share end points; an open or empty boundary is an error."""
    if not ways:
        raise ValueError("the boundary has no ways")
    left, rings = [list(w) for w in ways], []
    while left:
        ring = left.pop()
        while ring[0] != ring[-1]:
            for i, w in enumerate(left):
                if w[0] == ring[-1] or w[-1] == ring[-1]:
                    ring += (w if w[0] == ring[-1] else w[::-1])[1:]
                    del left[i]
                    break
            else:
                raise ValueError(f"a ring ends at {ring[-1]} and is not closed")
        rings.append(ring)
    return rings


def union_area(rings: list[list[tuple[float, float]]]) -> float:
    """The area that at least one of some rings covers, exactly.

    Between two neighbouring values of x at which a corner or a crossing lies, no edges cross, so
    what is covered grows in a straight line and its middle stands for the whole strip."""
    edges = []
    for k, ring in enumerate(rings):
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ax != bx:
                edges.append((ax, ay, bx, by, k) if ax < bx else (bx, by, ax, ay, k))
    edges.sort()
    stops = {x for e in edges for x in (e[0], e[2])}
    for i, (ax, ay, bx, by, _) in enumerate(edges):
        for cx, cy, dx, dy, _ in edges[i + 1 :]:
            if cx >= bx:
                break
            one, other = (by - ay) / (bx - ax), (dy - cy) / (dx - cx)
            if one != other:
                x = ax + (cy - ay + other * (ax - cx)) / (one - other)
                if max(ax, cx) < x < min(bx, dx):
                    stops.add(x)
    total, places = 0.0, sorted(stops)
    for left, right in zip(places, places[1:]):
        middle, by_ring = (left + right) / 2, {}
        for ax, ay, bx, by, k in edges:
            if ax > middle:
                break
            if bx > middle:
                by_ring.setdefault(k, []).append(ay + (by - ay) * (middle - ax) / (bx - ax))
        spans = sorted(pair for ys in by_ring.values() for ys in [sorted(ys)] for pair in zip(ys[::2], ys[1::2]))
        covered, top = 0.0, -math.inf
        for low, high in spans:
            covered += max(0.0, high - max(low, top))
            top = max(top, high)
        total += covered * (right - left)
    return total


@F.udf(T.DoubleType(), useArrow=True)
def covered_area(rings):
    """Area of the union of an array of rings, as an Arrow UDF; for the few rings of one cell."""
    return None if rings is None else union_area([[(p["x"], p["y"]) for p in ring] for ring in rings if ring is not None])


def drawn(lon: Column, lat: Column, west: float, north: float, middle: float, pixels_a_degree: float) -> tuple[Column, Column]:
    """Whole pixels from the upper left corner of a map whose scale is right at the middle latitude."""
    across = pixels_a_degree * math.cos(math.radians(middle))
    return F.floor((lon - west) * across + 0.5).cast("long"), F.floor((north - lat) * pixels_a_degree + 0.5).cast("long")


def svg_path(points: Column) -> Column:
    """A closed path of an array of struct<x, y> of whole pixels."""
    steps = F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string")))
    return F.concat(F.lit("M"), F.array_join(steps, " L"), F.lit("Z"))


def scale_bar(pixels_a_degree: float, most_pixels: int) -> tuple[int, int]:
    """The longest round number of metres (1, 2 or 5 and zeros) that fits, and its pixels."""
    a_metre = pixels_a_degree / (6_371_008.8 * math.pi / 180)
    best = max((m * 10**k for k in range(8) for m in (1, 2, 5) if m * 10**k * a_metre <= most_pixels), default=1)
    return best, math.floor(best * a_metre + 0.5)


@F.udf(T.ArrayType(RING), useArrow=True)
def stitched(ways):
    """Closed rings of an array of pieces of a boundary, as an Arrow UDF; see ``stitch``."""
    if ways is None:
        return None
    return [[{"x": x, "y": y} for x, y in ring[:-1]] for ring in stitch([[(p["x"], p["y"]) for p in way] for way in ways])]


def boundary_area(outer: Column, inner: Column) -> Column:
    """What outer rings cover together, less what inner rings do; rings may overlap or touch."""
    return covered_area(outer) - F.coalesce(covered_area(inner), F.lit(0.0))


def in_boundary(outer: Column, inner: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside an outer ring and in no inner one."""
    return F.exists(outer, lambda r: contains(r, x, y)) & ~F.exists(inner, lambda r: contains(r, x, y))
