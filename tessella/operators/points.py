"""From frames (keys, px, py, r, g, b, depth) to points with positions, normals and radii.

Invalid pixels stay as rows with is_valid false. keys are the columns that name a frame; every operator works within it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import color as K
from tessella.functions import geometry as G
from tessella.params import Camera

STEPS = (("x", -2), ("x", -1), ("x", 1), ("x", 2), ("y", -2), ("y", -1), ("y", 1), ("y", 2))


def in_roi(roi: tuple[int, int, int, int]) -> Column:
    """x_min, y_min, x_max, y_max; a region that is empty is no region."""
    x0, y0, x1, y1 = roi
    if not (x0 < x1 and y0 < y1):
        return F.lit(True)
    return F.col("px").between(x0, x1) & F.col("py").between(y0, y1)


def in_clip(box: tuple[float, float, float, float, float, float]) -> Column:
    """x, y, z minima, then maxima; inert if one side is empty."""
    low, high = box[:3], box[3:]
    if not all(a < b for a, b in zip(low, high, strict=True)):
        return F.lit(True)
    out = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        out = out & F.col(c).between(a, b)
    return out


def depth_gradient(pixels: DataFrame, base_radius: float, cam: Camera, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, px, py, gx, gy: the depth's slope over a window that depends on the depth itself; 0 at borders and holes.

    The eight samples of a pixel are asked for in rows of their own, joined on coordinates and put side by side again."""
    zf = G.z_over_f(F.col("depth"), cam)
    own = pixels.where("depth != 0").select(*keys, "px", "py", "depth", zf.alias("zf"), G.half_window(G.radius_px(base_radius, zf)).alias("w"))
    free = F.col("px").between(F.col("w"), F.lit(width - 1) - F.col("w")) & F.col("py").between(F.col("w"), F.lit(height - 1) - F.col("w"))
    own = own.where(free)
    half = (F.col("w") / 2).cast("int")
    ask = F.array(*(F.struct(F.lit(i).alias("i"), (half * n if a == "x" else F.lit(0)).alias("dx"), (half * n if a == "y" else F.lit(0)).alias("dy")) for i, (a, n) in enumerate(STEPS)))
    asked = own.select(*keys, "px", "py", "depth", "zf", "w", F.explode(ask).alias("o"))
    asked = asked.withColumns({"_x": (F.col("px") + F.col("o.dx")).cast("int"), "_y": (F.col("py") + F.col("o.dy")).cast("int")})
    seen = pixels.select(*keys, F.col("px").alias("_x"), F.col("py").alias("_y"), F.col("depth").alias("v"))
    got = asked.join(seen, [*keys, "_x", "_y"], "left")
    wide = got.groupBy(*keys, "px", "py").agg(F.first("depth").alias("d"), F.first("zf").alias("zf"), F.first("w").alias("w"), *(F.coalesce(F.max(F.when(F.col("o.i") == i, F.col("v"))), F.lit(0)).alias(f"v{i}") for i in range(8)))
    v = [F.col(f"v{i}") for i in range(8)]
    scale = 1 / (F.col("w") * F.col("zf"))
    slope = lambda s: scale * G.metres(G.difference5([s[0], s[1], F.col("d"), s[2], s[3]]), cam)
    grad = wide.select(*keys, "px", "py", slope(v[:4]).alias("gx"), slope(v[4:]).alias("gy"))
    out = pixels.select(*keys, "px", "py").join(grad, [*keys, "px", "py"], "left")
    return out.select(*keys, "px", "py", F.coalesce("gx", F.lit(0.0)).alias("gx"), F.coalesce("gy", F.lit(0.0)).alias("gy"))


def make_points(
    pixels: DataFrame,
    base_radius: float,
    cam: Camera,
    width: int,
    height: int,
    keys: Sequence[str] = (),
    color_space: str = "RGB",
    roi: tuple[int, int, int, int] | None = None,
    clip: tuple[float, float, float, float, float, float] | None = None,
    drop_badly_visible: bool = False,
) -> DataFrame:
    """keys, px, py, c0..c2, x, y, z, nx, ny, nz, radius_px, is_valid. Columns of invalid points are zeros."""
    grad = depth_gradient(pixels, 0.5 * base_radius, cam, width, height, keys)
    zf = G.z_over_f(F.col("depth"), cam)
    color = K.from_rgb(K.unit([F.col(c) for c in "rgb"]), color_space)
    rows = pixels.join(grad, [*keys, "px", "py"]).withColumns({f"c{i}": c for i, c in enumerate(color)} | {"_zf": zf})
    rows = rows.withColumns(dict(zip("xyz", G.unproject(F.col("px"), F.col("py"), F.col("_zf"), cam), strict=True)))
    valid = F.col("depth") != 0
    if roi:
        valid = valid & in_roi(roi)
    if clip:
        valid = valid & in_clip(clip)
    rows = rows.withColumn("is_valid", valid)
    rows = rows.withColumns(dict(zip(("nx", "ny", "nz"), G.normal_from_gradient(F.col("gx"), F.col("gy"), [F.col(c) for c in "xyz"]), strict=True)))
    if drop_badly_visible:
        bad = G.badly_visible(F.col("z"), [F.col(c) for c in ("nx", "ny", "nz")], base_radius, cam)
        rows = rows.withColumn("is_valid", F.col("is_valid") & ~bad)
    zero = lambda c: F.when(F.col("is_valid"), c).otherwise(0.0)
    geo = [zero(F.col(c)).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")]
    return rows.select(*keys, "px", "py", "c0", "c1", "c2", *geo, zero(G.radius_px(base_radius, F.col("_zf"))).alias("radius_px"), "is_valid")


def normals(pixels: DataFrame, cam: Camera, width: int, height: int, keys: Sequence[str] = (), radius: float = 0.025) -> DataFrame:
    """keys, px, py, nx, ny, nz alone, straight at the camera where there is no depth."""
    p = make_points(pixels, radius, cam, width, height, keys)
    at = dict(zip(("nx", "ny", "nz"), (0.0, 0.0, -1.0), strict=True))
    return p.select(*keys, "px", "py", *(F.when(F.col("is_valid"), F.col(c)).otherwise(v).alias(c) for c, v in at.items()))
