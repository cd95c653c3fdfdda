"""Scalar geometry as native column expressions over ``array<struct<x, y, bulge>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6
POINT_TOLERANCE = 5e-5


def larger(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """a > b beyond the tolerance."""
    return (a > b) & (F.abs(a - b) > tol)


def equal(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= tol


def cross(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of (a, b, c): positive where c lies left of a-b."""
    return (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)


def _steps(v: Column, closed: Column | bool) -> Column:
    """Index pairs of consecutive vertices, the closing pair included where closed."""
    n = F.size(v)
    last = F.when(F.lit(closed) if isinstance(closed, bool) else closed, n - 1).otherwise(n - 2)
    none = F.array().cast("array<int>")
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(none)


def _next(v: Column, i: Column) -> Column:
    return F.get(v, (i + 1) % F.greatest(F.size(v), F.lit(1)))


def length(v: Column, closed: Column | bool = False) -> Column:
    """Chord length."""
    return F.aggregate(
        _steps(v, closed),
        F.lit(0.0),
        lambda acc, i: acc + F.sqrt(F.pow(_next(v, i)["x"] - F.get(v, i)["x"], 2) + F.pow(_next(v, i)["y"] - F.get(v, i)["y"], 2)),
    )


def arc_length(v: Column, closed: Column | bool = False) -> Column:
    """Length along the arcs: a bulge b over a chord c is an arc of 4 atan(b) radians."""

    def one(i: Column) -> Column:
        a, b = F.get(v, i), _next(v, i)
        chord = F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
        bulge = F.abs(a["bulge"])
        return F.when(bulge < TOLERANCE, chord).otherwise(chord * (1 + bulge * bulge) * F.atan(bulge) / bulge)

    return F.aggregate(_steps(v, closed), F.lit(0.0), lambda acc, i: acc + one(i))


def signed_area(v: Column) -> Column:
    """Shoelace area: positive where the ring runs counter-clockwise."""
    return (
        F.aggregate(
            _steps(v, True),
            F.lit(0.0),
            lambda acc, i: acc + F.get(v, i)["x"] * _next(v, i)["y"] - _next(v, i)["x"] * F.get(v, i)["y"],
        )
        / 2
    )


def bulge_area(v: Column) -> Column:
    """Signed area with the circular segments that bulges add."""

    def segment(i: Column) -> Column:
        a, b = F.get(v, i), _next(v, i)
        chord2 = F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)
        s = a["bulge"]
        angle = 4 * F.atan(s)
        radius2 = chord2 * F.pow(1 + s * s, 2) / (16 * s * s)
        return F.when(F.abs(s) < TOLERANCE, 0.0).otherwise(radius2 * (angle - F.sin(angle)) / 2)

    return signed_area(v) + F.aggregate(_steps(v, True), F.lit(0.0), lambda acc, i: acc + segment(i))


def centroid(v: Column) -> Column:
    """Centroid of the ring; the mean of the vertices where the area is zero."""

    def moment(axis: str) -> Column:
        return F.aggregate(
            _steps(v, True),
            F.lit(0.0),
            lambda acc, i: acc
            + (F.get(v, i)[axis] + _next(v, i)[axis])
            * (F.get(v, i)["x"] * _next(v, i)["y"] - _next(v, i)["x"] * F.get(v, i)["y"]),
        )

    area = signed_area(v)
    mean = lambda axis: F.aggregate(v, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(v)
    at = lambda axis: F.when(F.abs(area) > TOLERANCE, moment(axis) / (6 * area)).otherwise(mean(axis))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def extents(v: Column) -> Column:
    axis = lambda f, a: f(F.transform(v, lambda p: p[a]))
    return F.struct(
        axis(F.array_min, "x").alias("minx"), axis(F.array_min, "y").alias("miny"),
        axis(F.array_max, "x").alias("maxx"), axis(F.array_max, "y").alias("maxy"),
    )


def has_arc(v: Column, tol: float = 1e-5) -> Column:
    return F.exists(v, lambda p: F.abs(p["bulge"]) > tol)


def has_duplicate_vertex(v: Column, tol: float) -> Column:
    """A vertex within tol of the next; the last is compared with the first even in an open curve."""
    near = lambda i: (
        F.pow(_next(v, i)["x"] - F.get(v, i)["x"], 2) + F.pow(_next(v, i)["y"] - F.get(v, i)["y"], 2) <= tol * tol
    )
    return (F.size(v) >= 2) & F.exists(_steps(v, True), near)


def sharp_corners(v: Column, degrees: float) -> Column:
    """Positions of ring vertices whose angle is at most so many degrees, compared on squared cosines."""
    import math

    c2 = math.cos(math.radians(degrees)) ** 2
    n = F.size(v)

    def sharp(i: Column) -> Column:
        p, a, b = F.get(v, i), F.get(v, (i + n - 1) % n), _next(v, i)
        ux, uy, wx, wy = a["x"] - p["x"], a["y"] - p["y"], b["x"] - p["x"], b["y"] - p["y"]
        dot, uu, ww = ux * wx + uy * wy, ux * ux + uy * uy, wx * wx + wy * wy
        return (uu > 0) & (ww > 0) & (dot > 0) & (dot * dot >= c2 * uu * ww)

    return F.filter(_steps(v, True), sharp)


def point_in_ring(x: Column, y: Column, v: Column) -> Column:
    """1 inside, 0 outside, -1 on the boundary; crossing count, half-open in y."""

    def edge(i: Column) -> Column:
        a, b = F.get(v, i), _next(v, i)
        side = cross(a["x"], a["y"], b["x"], b["y"], x, y)
        on = (
            (side == 0)
            & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
            & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        )
        up = (a["y"] <= y) & (b["y"] > y) & (side > 0)
        down = (a["y"] > y) & (b["y"] <= y) & (side < 0)
        return F.when(on, 1000000).when(up, 1).when(down, -1).otherwise(0)

    turns = F.aggregate(_steps(v, True), F.lit(0), lambda acc, i: acc + edge(i))
    return F.when(F.abs(turns) >= 500000, -1).when(turns != 0, 1).otherwise(0)


def canonical_ring(v: Column) -> Column:
    """The ring's points from its least vertex on, in the direction that sorts first."""
    xy = F.transform(v, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))

    def turned(ring: Column) -> Column:
        at = F.array_position(ring, F.array_min(ring)).cast("int") - 1
        n = F.size(ring)
        return F.concat(F.slice(ring, at + 1, n), F.slice(ring, F.lit(1), at))

    return F.least(turned(xy), turned(F.reverse(xy)))


def rectangle_like(v: Column, share: float = 0.95) -> Column:
    box = extents(v)
    area = (box["maxx"] - box["minx"]) * (box["maxy"] - box["miny"])
    return (area > 0) & (F.abs(signed_area(v)) >= share * area)


def moved(v: Column, dx, dy) -> Column:
    return affine(v, 1.0, 0.0, 0.0, 1.0, dx, dy)


def affine(v: Column, a, b, c, d, dx, dy) -> Column:
    """x' = a x + b y + dx, y' = c x + d y + dy; a mirror turns bulges over."""
    flip = -1.0 if all(isinstance(k, (int, float)) for k in (a, b, c, d)) and a * d - b * c < 0 else 1.0
    return F.transform(
        v,
        lambda p: F.struct(
            (a * p["x"] + b * p["y"] + dx).alias("x"), (c * p["x"] + d * p["y"] + dy).alias("y"), (flip * p["bulge"]).alias("bulge")
        ),
    )
