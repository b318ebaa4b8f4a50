"""Reads of neighbouring pixels.

Fixed offsets go through windows along rows and columns where the neighbours are dense, and through an equi-join on
shifted coordinates in general, never through a comparison of all pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shifted(pixels: DataFrame, value: str, offsets: Sequence[tuple[int, int]], keys: Sequence[str] = (), default=0) -> DataFrame:
    """Adds value_0, value_1, ...: the value at (px + dx, py + dy) for each offset, or the default where there's no pixel.

    One explode of the offsets, one shuffle on (keys, px, py) and one grouped pick, whatever the number of offsets."""
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(offsets))))
    sent = pixels.select(*keys, "px", "py", F.col(value).alias("_v"), at.alias("_o"))
    sent = sent.select(*keys, (F.col("px") - F.col("_o.dx")).cast("int").alias("px"), (F.col("py") - F.col("_o.dy")).cast("int").alias("py"), F.col("_o.i").alias("_i"), "_v")
    picked = sent.groupBy(*keys, "px", "py").agg(*(F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"{value}_{i}") for i in range(len(offsets))))
    out = pixels.join(picked, [*keys, "px", "py"], "left")
    return out.select(*pixels.columns, *(F.coalesce(f"{value}_{i}", F.lit(default)).alias(f"{value}_{i}") if default is not None else F.col(f"{value}_{i}") for i in range(len(offsets))))


NEAR4 = ((-1, 0), (1, 0), (0, -1), (0, 1))
NEAR8 = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))
BOX9 = tuple((dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1))


def inside(width: int, height: int, margin: int = 1) -> Column:
    return F.col("px").between(margin, width - 1 - margin) & F.col("py").between(margin, height - 1 - margin)


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def box(centres: DataFrame, radius: Column, width: int, height: int) -> DataFrame:
    """Explodes each centre (sx, sy) over the pixels of its box, clipped to the image: adds px, py. The range join of centres
    with pixels is then an equi-join on (px, py)."""
    r = radius
    xs = F.sequence(F.greatest(F.col("sx") - r, F.lit(0)).cast("int"), F.least(F.col("sx") + r, F.lit(width - 1)).cast("int"))
    ys = F.sequence(F.greatest(F.col("sy") - r, F.lit(0)).cast("int"), F.least(F.col("sy") + r, F.lit(height - 1)).cast("int"))
    hit = (F.col("sx") + r >= 0) & (F.col("sx") - r <= width - 1) & (F.col("sy") + r >= 0) & (F.col("sy") - r <= height - 1)
    return centres.where(hit).withColumn("py", F.explode(ys)).withColumn("px", F.explode(xs))
