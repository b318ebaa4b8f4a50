"""Distances and affinities of points. A point is a mapping from names (px, py, c0..c2, x, y, z, nx, ny, nz, radius_px) to
columns; a metric is a function of a point and a centre, so that users can pass their own."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.mathx import dot, dot_diff, inverse_sqrt

Point = Mapping[str, Column]
Metric = Callable[[Point, Point], Column]
COLOR, POSITION, NORMAL = ("c0", "c1", "c2"), ("x", "y", "z"), ("nx", "ny", "nz")
COLOR_SCALE = 0.01  # times the root of the number of clusters


def point(prefix: str = "", columns=("px", "py", *COLOR, *POSITION, *NORMAL, "radius_px")) -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in columns}


def _of(p: Point, names) -> list[Column]:
    return [p[n] for n in names]


def pixel_distance2(p: Point, q: Point) -> Column:
    return dot_diff(_of(p, ("px", "py")), _of(q, ("px", "py")))


def image_distance(p: Point, q: Point) -> Column:
    return pixel_distance2(p, q) / (q["radius_px"] * q["radius_px"])


def spatial_distance(p: Point, q: Point) -> Column:
    return dot_diff(_of(p, POSITION), _of(q, POSITION))


def color_distance(p: Point, q: Point) -> Column:
    return dot_diff(_of(p, COLOR), _of(q, COLOR))


def normal_distance(p: Point, q: Point) -> Column:
    return 1 - dot(_of(p, NORMAL), _of(q, NORMAL))


def normal_distance_by_depth(p: Point, q: Point) -> Column:
    return 2 * normal_distance(p, q) / (p["z"] + q["z"])


def rgb_metric(spatial: float = 1.0, color: float = 2.0) -> Metric:
    return lambda p, q: spatial * image_distance(p, q) + color * color_distance(p, q)


def rgbd_metric(spatial: float = 1.0, color: float = 2.0, depth: float = 3.0) -> Metric:
    return lambda p, q: spatial * image_distance(p, q) + color * color_distance(p, q) + depth * F.abs(p["z"] - q["z"])


def depth_metric(base_radius: float, spatial: float = 1.0, color: float = 2.0, normal: float = 3.0) -> Metric:
    """Distance in space by the radius, colour and normals."""
    w = spatial / (base_radius * base_radius)
    return lambda p, q: w * spatial_distance(p, q) + color * color_distance(p, q) + normal * normal_distance_by_depth(p, q)


def _concave(p: Point, q: Point) -> Column:
    """How far the normals turn toward each other along the line from p to q; 0 for convex edges."""
    d = [b - a for a, b in zip(_of(p, POSITION), _of(q, POSITION), strict=True)]
    turn = dot([a - b for a, b in zip(_of(p, NORMAL), _of(q, NORMAL), strict=True)], d)
    return F.greatest(F.lit(0.0), turn * inverse_sqrt(dot(d)))


def classic_affinity(count: int, radius: float, spatial: float = 1.0, color: float = 1.0, normal: float = 1.0, suppress_convex: bool = True) -> Metric:
    def of(p: Point, q: Point) -> Column:
        s = F.greatest(F.lit(0.0), spatial_distance(p, q) * (spatial / (4.0 * radius * radius)) - 1.2)
        n = _concave(p, q) if suppress_convex else normal_distance(p, q)
        return F.exp(-(s + color / (math.sqrt(count) * COLOR_SCALE) * color_distance(p, q) + normal * n))

    return of


def improved_affinity(radius: float, spatial: float = 1.0, color: float = 1.0, normal: float = 1.0) -> Metric:
    total = spatial + color + normal

    def of(p: Point, q: Point) -> Column:
        s = F.greatest(F.lit(0.0), spatial_distance(p, q) / (4.0 * radius * radius) - 1.2)
        return F.exp(-(spatial / total * s + color / total * 3.2 * color_distance(p, q) + normal / total * _concave(p, q)))

    return of


def color_affinity(count: int, color: float = 1.0) -> Metric:
    return lambda p, q: F.exp(-color * (4.0 * color_distance(p, q) / (math.sqrt(count) * COLOR_SCALE)))
