"""Camera geometry, finite differences and normals as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.mathx import dot, trunc
from tessella.params import Camera


def metres(depth: Column, cam: Camera) -> Column:
    return depth * F.lit(cam.z_slope)


def millimetres(z: Column, cam: Camera) -> Column:
    return trunc(z / cam.z_slope).cast("int")


def z_over_f(depth: Column, cam: Camera) -> Column:
    return metres(depth, cam) / cam.focal


def unproject(px: Column, py: Column, zf: Column, cam: Camera) -> list[Column]:
    return [zf * (px - cam.cx), zf * (py - cam.cy), zf * cam.focal]


def project(x: Column, y: Column, z: Column, cam: Camera) -> list[Column]:
    return [x / z * cam.focal + cam.cx, y / z * cam.focal + cam.cy]


def field_of_view(cam: Camera, width: int, height: int) -> list[Column]:
    """Horizontal and vertical, in degrees."""
    return [F.lit(math.degrees(2 * math.atan(s / (2 * cam.focal)))) for s in (width, height)]


def radius_px(base_radius, zf: Column) -> Column:
    return base_radius / zf


def difference5(v: Sequence[Column]) -> Column:
    """Difference over five samples, 0 being missing: the inner pair if only the outer is missing, one side if the other has
    a hole, else both sides, each weighed by the other's curvature."""
    v0, v1, v2, v3, v4 = v
    bend_l, bend_r = F.abs(v2 + v0 - 2 * v1), F.abs(v4 + v2 - 2 * v3)
    both = F.when(bend_l + bend_r == 0, 0.5 * (v4 - v0)).otherwise((bend_r * (v2 - v0) + bend_l * (v4 - v2)) / (bend_l + bend_r))
    return _sided(v, both)


def difference5_simple(v: Sequence[Column]) -> Column:
    """The same, taking the less curved side alone."""
    v0, v1, v2, v3, v4 = v
    return _sided(v, F.when(F.abs(v2 + v0 - 2 * v1) < F.abs(v4 + v2 - 2 * v3), v2 - v0).otherwise(v4 - v2))


def _sided(v: Sequence[Column], both: Column) -> Column:
    v0, v1, v2, v3, v4 = v
    left, right = (v0 == 0) | (v1 == 0), (v3 == 0) | (v4 == 0)
    inner = (v0 == 0) & (v4 == 0) & (v1 != 0) & (v3 != 0)
    return F.when(inner, v3 - v1).when(left & right, 0).when(left, v4 - v2).when(right, v2 - v0).otherwise(both)


def half_window(window: Column) -> Column:
    """An even number of pixels, four at least."""
    w = F.greatest(trunc(window + 0.5), F.lit(4)).cast("int")
    return w + w % 2


def normal_from_gradient(gx: Column, gy: Column, position: Sequence[Column]) -> list[Column]:
    """Unit normal, turned toward the camera; straight at it where that can't be told."""
    s = 1 / F.sqrt(gx * gx + gy * gy + 1)
    n = [s * gx, s * gy, -s]
    q = -dot(n, position)
    return [F.when(q < 0, -c).when(q == 0, at).otherwise(c) for c, at in zip(n, (0.0, 0.0, -1.0), strict=True)]


def gradient_of(n: Sequence[Column]) -> list[Column]:
    return [n[0] / n[2], n[1] / n[2]]


def gradient_direction(n: Sequence[Column]) -> list[Column]:
    s, flat = 1 / F.sqrt(n[0] * n[0] + n[1] * n[1]), (n[0] == 0) & (n[1] == 0)
    return [F.when(flat, 1.0).otherwise(s * n[0]), F.when(flat, 0.0).otherwise(s * n[1])]


def circularity(n: Sequence[Column]) -> Column:
    return F.abs(n[2])


def badly_visible(z: Column, n: Sequence[Column], base_radius: float, cam: Camera, pixels: int = 5) -> Column:
    return z * (math.sqrt(pixels / math.pi) / cam.focal) > base_radius * circularity(n)
