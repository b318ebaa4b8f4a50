"""Scalar fields on the pixel grid (keys, px, py, v): densities, kernels, pyramids, smoothing and saliency."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.mathx import dot_diff, kernel_square
from tessella.operators.stencil import box

FLATTEST = 0.174  # circularity of the steepest surface that still adds density
BOX_RADIUS, SOFT, REACH, GAIN = 3, 0.5, 1.3886, 1.001  # of the point density
SMOOTH_REACH = 2.5


def depth_density(points: DataFrame, keys: Sequence[str] = (), adaptive: bool = True) -> DataFrame:
    """1 / (pi r^2), more on slanted surfaces; 0 where invalid."""
    v = 1 / (math.pi * F.col("radius_px") * F.col("radius_px"))
    if adaptive:
        v = v / F.greatest(F.lit(FLATTEST), G.circularity([F.col(c) for c in ("nx", "ny", "nz")]))
    return points.select(*keys, "px", "py", F.when(F.col("is_valid"), v).otherwise(0.0).alias("v"))


def constant_density(pixels: DataFrame, width: int, height: int, count: int = 0, base_radius: float = 0.024, px_per_metre: float = 400.0) -> DataFrame:
    """Adds v and radius_px, the same for all pixels: of the count over the actual image size, or of the radius."""
    r = base_radius * px_per_metre if count == 0 else math.sqrt(width * height / (math.pi * count))
    rho = 1 / (r * r * math.pi) if count == 0 else count / (width * height)
    return pixels.withColumns({"v": F.lit(rho), "radius_px": F.lit(r)})


def normalise(field: DataFrame, count: float, keys: Sequence[str] = ()) -> DataFrame:
    """Scaled to sum to count; scale_radius is what radii must be multiplied by. The sum is one row per frame."""
    total = field.groupBy(*keys).agg(F.sum("v").alias("_sum"))
    p = F.lit(float(count)) / F.col("_sum")
    joined = field.join(F.broadcast(total), list(keys)) if keys else field.crossJoin(F.broadcast(total))  # one row
    return joined.select(*keys, "px", "py", (F.col("v") * p).alias("v"), (1 / F.sqrt(p)).alias("scale_radius"))


def point_density(seeds: DataFrame, target: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Density that seeds (keys, seed_id, x, y) achieve: a kernel each, as wide as the target is thin around it."""
    at = seeds.select(*keys, "seed_id", "x", "y", F.floor(F.col("x") + 0.5).cast("int").alias("sx"), F.floor(F.col("y") + 0.5).cast("int").alias("sy"))
    near = box(at, F.lit(BOX_RADIUS), width, height).join(target.select(*keys, "px", "py", "v"), [*keys, "px", "py"])
    rho = near.groupBy(*keys, "seed_id").agg(F.avg("v").alias("rho")).where("rho > 0")
    soft = at.join(rho, [*keys, "seed_id"]).withColumn("soft", F.col("rho") * SOFT)
    spread = box(soft, F.ceil(REACH / F.sqrt("soft")).cast("int"), width, height)
    d2 = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    total = spread.groupBy(*keys, "px", "py").agg(F.sum(F.col("soft") * kernel_square(F.col("soft") * d2)).alias("_d"))
    out = target.join(total, [*keys, "px", "py"], "left")
    return out.select(*keys, "px", "py", F.when(F.col("v") != 0, GAIN * F.coalesce("_d", F.lit(0.0))).otherwise(0.0).alias("v"))


def halve(field: DataFrame, keys: Sequence[str] = (), by: int = 2) -> DataFrame:
    """Sums over by x by cells; cells without pixels are no rows (zeros)."""
    cell = lambda c: F.floor(F.col(c) / by).cast("int").alias(c)
    return field.groupBy(*keys, cell("px"), cell("py")).agg(F.sum("v").alias("v"))


def halve_exact(field: DataFrame, width: int, height: int, by: int, keys: Sequence[str] = ()) -> DataFrame:
    if width % by or height % by:
        raise ValueError(f"{width} x {height} can't be divided by {by}")
    return halve(field, keys, by)


def exponent(n: int) -> int:
    """The smallest a with 2^a >= n."""
    return max(0, (n - 1).bit_length())


def pyramid(field: DataFrame, width: int, height: int, least: int = 1, levels: int | None = None, keys: Sequence[str] = (), first: int = 2) -> DataFrame:
    """keys, level, px, py, v: level 0 is already `first` times smaller, every further one halves. The image is padded with
    zeros to a square of a power of two, so that absent cells are zeros. All levels are direct sums over pixels."""
    n = exponent(max(width, height)) - exponent(least) if levels is None else levels
    size = lambda i: first * 2**i
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.lit(size(i)).alias("s")) for i in range(n))))
    rows = field.withColumn("_l", each)
    cell = lambda c: F.floor(F.col(c) / F.col("_l.s")).cast("int").alias(c)
    return rows.groupBy(*keys, F.col("_l.level").alias("level"), cell("px"), cell("py")).agg(F.sum("v").alias("v"))


def pyramid_640x480(field: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells of 5, then five halvings."""
    return pyramid(field, 640, 480, levels=6, keys=keys, first=5)


def pyramid_with_abs(field: DataFrame, width: int, height: int, least: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """The pyramids of the value and of its absolute value, v and v_abs."""
    plain = pyramid(field, width, height, least, keys=keys)
    positive = pyramid(field.withColumn("v", F.abs("v")), width, height, least, keys=keys).withColumnRenamed("v", "v_abs")
    return plain.join(positive, [*keys, "level", "px", "py"])


def scale_up(field: DataFrame, by: int, keys: Sequence[str] = ()) -> DataFrame:
    cells = F.explode(F.sequence(F.lit(0), F.lit(by * by - 1)))
    rows = field.withColumn("_k", cells)
    return rows.select(*keys, (F.col("px") * by + F.col("_k") % by).cast("int").alias("px"), (F.col("py") * by + F.floor(F.col("_k") / by)).cast("int").alias("py"), "v")


def _weighted(field: DataFrame, radius: Column, width: int, height: int, keys: Sequence[str], value: DataFrame, along: str | None, skip_zero: bool) -> DataFrame:
    """Kernel mean around each pixel with rho > 0 of `value` over a box, a row or a column."""
    own = field.where("rho > 0").select(*keys, F.col("px").alias("sx"), F.col("py").alias("sy"), "rho")
    if along:
        c, size = ("sx", width) if along == "px" else ("sy", height)
        span = F.explode(F.sequence(F.greatest(F.col(c) - radius, F.lit(0)).cast("int"), F.least(F.col(c) + radius, F.lit(size - 1)).cast("int")))
        asked = own.withColumn(along, span).withColumn("py" if along == "px" else "px", F.col("sy" if along == "px" else "sx"))
    else:
        asked = box(own, radius, width, height)
    got = asked.join(value.select(*keys, "px", "py", F.col("v").alias("_v")), [*keys, "px", "py"])
    if skip_zero:
        got = got.where("_v > 0")
    d2 = (F.col("px") - F.col("sx")) * (F.col("px") - F.col("sx")) + (F.col("py") - F.col("sy")) * (F.col("py") - F.col("sy"))
    w = kernel_square(F.col("rho") * d2)
    mean = got.groupBy(*keys, F.col("sx").alias("px"), F.col("sy").alias("py")).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("v"))
    return field.select(*keys, "px", "py").join(mean, [*keys, "px", "py"], "left").select(*keys, "px", "py", F.coalesce("v", F.lit(0.0)).alias("v"))


def _reach() -> Column:
    return F.ceil(SMOOTH_REACH / F.sqrt("rho")).cast("int")


def smooth2d(field: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian mean as wide as the density is thin."""
    return _weighted(field.withColumnRenamed("v", "rho"), _reach(), width, height, keys, field, None, False)


def smooth_separated(field: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Along rows, then columns, leaving out zeros; both passes take their width from the first field."""
    rho = field.withColumnRenamed("v", "rho")
    first = _weighted(rho, _reach(), width, height, keys, field, "px", True)
    return _weighted(rho, _reach(), width, height, keys, first, "py", True)


def saliency(points: DataFrame, base_radius: float, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Root of the mean colour difference to the neighbours within the radius, weighed by nearness in space; brought to
    [-1, 1] around its mean over all pixels."""
    ok = points.where("is_valid")
    own = ok.select(*keys, F.col("px").alias("sx"), F.col("py").alias("sy"), *(F.col(c).alias(f"o{c}") for c in ("c0", "c1", "c2", "x", "y", "z")), F.floor(F.col("radius_px") + 0.5).cast("int").alias("rad"))
    got = box(own, F.col("rad"), width, height).join(ok.select(*keys, "px", "py", "c0", "c1", "c2", "x", "y", "z"), [*keys, "px", "py"])
    pair = lambda names: dot_diff([F.col(c) for c in names], [F.col(f"o{c}") for c in names])
    w = 1 / (1 + pair("xyz") * (1 / (base_radius * base_radius)))
    raw = got.groupBy(*keys, F.col("sx").alias("px"), F.col("sy").alias("py")).agg(F.sqrt(F.sum(w * pair(("c0", "c1", "c2"))) / F.sum(w)).alias("s"))
    every = points.select(*keys, "px", "py").join(raw, [*keys, "px", "py"], "left").select(*keys, "px", "py", F.coalesce("s", F.lit(0.0)).alias("s"))
    stats = every.groupBy(*keys).agg(F.avg("s").alias("m"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    both = every.join(F.broadcast(stats), list(keys)) if keys else every.crossJoin(F.broadcast(stats))  # one row
    return both.select(*keys, "px", "py", ((F.col("s") - F.col("m")) / F.greatest(F.col("m") - F.col("lo"), F.col("hi") - F.col("m"))).alias("v"))


def radius_by_saliency(radius: Column, s: Column) -> Column:
    return radius * F.pow(F.lit(0.5), -s)


def density_error(approximation: DataFrame, density: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the absolute differences over the sum of the density."""
    both = density.join(approximation.withColumnRenamed("v", "_a"), [*keys, "px", "py"])
    return both.groupBy(*keys).agg((F.sum(F.abs(F.col("_a") - F.col("v"))) / F.sum("v")).alias("error"))


def parts(delta: Column) -> tuple[Column, Column]:
    """The positive and the negative part."""
    return F.greatest(delta, F.lit(0.0)), F.greatest(-delta, F.lit(0.0))
