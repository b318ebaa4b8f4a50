"""Repair and smoothing of depth images: keys, px, py, depth in and out; 0 is a hole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.stencil import BOX9, inside, shifted, total

CENTRE = 4  # of BOX9


def fill(pixels: DataFrame, value: int = 1000) -> DataFrame:
    return pixels.withColumn("depth", F.when(F.col("depth") == 0, value).otherwise(F.col("depth")))


def _weighted(pixels: DataFrame, keys: Sequence[str], centre: int) -> DataFrame:
    n = shifted(pixels, "depth", BOX9, keys)
    weights = [(centre if i == CENTRE else 4 >> (abs(dx) + abs(dy))) for i, (dx, dy) in enumerate(BOX9)]
    w = total([F.when(F.col(f"depth_{i}") != 0, k).otherwise(0) for i, k in enumerate(weights)])
    v = total([F.col(f"depth_{i}") * k for i, k in enumerate(weights)])
    return n.withColumn("_mean", F.when(w > 0, F.floor(v / w)).otherwise(0).cast("int"))


def grow(pixels: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Holes off the border take the weighted mean of their valid neighbours."""
    n = _weighted(pixels, keys, 0)
    return n.select(*keys, "px", "py", F.when((F.col("depth") == 0) & inside(width, height), F.col("_mean")).otherwise(F.col("depth")).alias("depth"))


def smooth9(pixels: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    n = _weighted(pixels, keys, 4)
    return n.select(*keys, "px", "py", F.when(inside(width, height), F.col("_mean")).otherwise(F.col("depth")).alias("depth"))


def repair(pixels: DataFrame, keys: Sequence[str] = (), samples: int = 4) -> DataFrame:
    """Fills holes between valid runs of a scan line with the mean of up to `samples` nearest pixels of the run on the
    farther side (the right one on a tie); leading and trailing holes stay. Runs are islands of equal validity."""
    line = Window.partitionBy(*keys, "py").orderBy("px")
    ok = F.col("depth") != 0
    rows = pixels.withColumn("_new", F.when(ok == F.lag(ok).over(line), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(line))
    runs = _runs(rows, keys, ok, samples)
    by = Window.partitionBy(*keys, "py").orderBy("_run")
    prev, nxt = (lambda c: F.lag(c).over(by)), (lambda c: F.lead(c).over(by))
    left = prev("_last") > nxt("_first")
    value = F.when(left, F.floor(prev("_sr") / prev("_n"))).otherwise(F.floor(nxt("_sl") / nxt("_n")))
    gaps = runs.withColumn("_value", F.when(~F.col("_ok") & prev("_run").isNotNull() & nxt("_run").isNotNull(), value))
    out = rows.join(gaps.select(*keys, "py", "_run", "_value"), [*keys, "py", "_run"])
    return out.select(*keys, "px", "py", F.coalesce("_value", "depth").cast("int").alias("depth"))


def _runs(rows: DataFrame, keys: Sequence[str], ok: Column, samples: int) -> DataFrame:
    """Per run: validity, first and last depth, sums of up to `samples` depths from either end and how many these are."""
    run = Window.partitionBy(*keys, "py", "_run")
    ranked = rows.withColumns({"_l": F.row_number().over(run.orderBy("px")), "_r": F.row_number().over(run.orderBy(F.desc("px")))})
    return ranked.groupBy(*keys, "py", "_run").agg(
        F.max(ok).alias("_ok"),
        F.min_by("depth", "px").alias("_first"),
        F.max_by("depth", "px").alias("_last"),
        F.sum(F.when(F.col("_l") <= samples, F.col("depth"))).alias("_sl"),
        F.sum(F.when(F.col("_r") <= samples, F.col("depth"))).alias("_sr"),
        F.least(F.count(F.lit(1)), F.lit(samples)).alias("_n"),
    )


def extrapolate(values: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    """values: keys, i (0 nearest the hole), v. Constant mean, two-point line and least-squares line, each at -1 - at."""
    x = F.lit(-1.0) - at
    return values.groupBy(*keys).agg(
        F.floor(F.avg("v")).alias("constant"),
        (F.min_by("v", "i") + (F.min_by("v", "i") - F.max_by("v", "i")) / F.greatest(F.max("i") - F.min("i"), F.lit(1)) * (-x)).alias("two_point"),
        (F.regr_intercept(F.col("v").cast("double"), F.col("i").cast("double")) + F.regr_slope(F.col("v").cast("double"), F.col("i").cast("double")) * x).alias("least_squares"),
    )


def _one_sided(v: Sequence[Column]) -> Column:
    a, b, c, d, e = v
    left, right = (a == 0) | (b == 0), (d == 0) | (e == 0)
    minus, plus = F.floor((4 * c + 3 * b + a) / 8), F.floor((4 * c + 3 * d + e) / 8)
    return F.when(left & right, 0).when(left, plus).when(right, minus).when(F.abs(e - c) < F.abs(a - c), plus).otherwise(minus).cast("int")


def _smooth_along(pixels: DataFrame, axis: str, size: int, keys: Sequence[str], margin: int) -> DataFrame:
    other = "py" if axis == "px" else "px"
    w = Window.partitionBy(*keys, other).orderBy(axis)
    v = [F.lag("depth", 2).over(w), F.lag("depth", 1).over(w), F.col("depth"), F.lead("depth", 1).over(w), F.lead("depth", 2).over(w)]
    return pixels.withColumn("depth", F.when(F.col(axis).between(margin, size - 1 - margin), _one_sided(v)).otherwise(F.col("depth")))


def smooth(pixels: DataFrame, width: int, height: int, keys: Sequence[str] = (), margin: int = 4) -> DataFrame:
    """Edge-preserving: five taps of the side with the smaller jump, first along columns, then along rows."""
    return _smooth_along(_smooth_along(pixels, "py", height, keys, margin), "px", width, keys, margin)
