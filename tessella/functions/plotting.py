"""Colours of points and clusters by mode, colour tables, and what paints them onto pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color as K
from tessella.functions.rng import uniform

PI = 3.1415  # fixed value: the results to match use this many places


def _flat(*byte: int) -> list[Column]:
    return [F.lit(b / 255.0) for b in byte]


def _if_valid(yes: Sequence[Column], no: Sequence[Column]) -> list[Column]:
    return [F.when(F.col("is_valid"), a).otherwise(b) for a, b in zip(yes, no, strict=True)]


def _of_points(mode: str, space: str) -> list[Column] | None:
    grey, black, r = _flat(128, 128, 128), _flat(0, 0, 0), F.col("radius_px")
    return {
        "uni_black": lambda: black,
        "uni_white": lambda: _flat(255, 255, 255),
        "valid": lambda: _if_valid(_flat(0, 128, 0), _flat(255, 128, 128)),
        "color": lambda: K.to_rgb([F.col(c) for c in ("c0", "c1", "c2")], space),
        "depth": lambda: K.depth_color(F.col("z")),
        "gradient": lambda: _if_valid(K.gradient_color(F.col("nx") / F.col("nz"), F.col("ny") / F.col("nz")), black),
        "gradient_nz": lambda: _if_valid(K.grey(F.abs(F.col("nz")), 0.0, 1.0), black),
        "cluster_radius": lambda: _if_valid(K.intensity(r, 4.0, 20.0), grey),
        "density": lambda: _if_valid(K.intensity(1.0 / (PI * r * r), 0.0, 0.025), grey),
    }.get(mode, lambda: None)()


def _of_clusters(mode: str) -> list[Column] | None:
    return {
        "thickness": lambda: K.intensity(F.col("thickness"), 0.0, 0.05),
        "eccentricity": lambda: K.intensity(F.col("eccentricity"), 0.0, 1.0),
        "shape_0": lambda: K.intensity(F.col("shape_0"), 0.5, 3.5),
        "shape_x": lambda: K.plus_minus(F.col("shape_x"), 1.0),
        "shape_y": lambda: K.plus_minus(F.col("shape_y"), 1.0),
        "shape_xy": lambda: K.plus_minus(F.col("shape_xy"), 10.0),
        "shape_xx": lambda: K.plus_minus(F.col("shape_xx"), 10.0),
        "shape_yy": lambda: K.plus_minus(F.col("shape_yy"), 10.0),
        "area_quotient": lambda: K.intensity(F.abs(F.col("area_quotient") - 1.0), 0.0, 1.0),
        "coverage_error": lambda: K.intensity(F.col("coverage_error"), 0.0, 1.0),
    }.get(mode, lambda: None)()


def point_color(mode: str, space: str = "RGB") -> list[Column]:
    """Red, green, blue from 0 to 1 of a point by mode, from the columns that make_points gives."""
    got = _of_points(mode, space)
    if got is None:
        raise ValueError(f"no point colour named {mode}")
    return got


def cluster_color(mode: str, space: str = "RGB") -> list[Column]:
    """As point_color, of a cluster's centre, or by its shape."""
    got = _of_clusters(mode)
    return point_color(mode, space) if got is None else got


def random_colors(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """color_id, r, g, b: at least count colours around the hue circle in three brightnesses, in an order drawn at random."""
    n = (count // 3 + 1) * 3
    i = F.col("id")
    base = spark.range(n).select("id", F.floor((i - i % 3) * 255 / n).cast("int").alias("h"), F.element_at(F.array(*(F.lit(v) for v in (255, 171, 85))), (i % 3 + 1).cast("int")).alias("v"))
    rgb = K.hsv_to_rgb8([F.col("h"), F.lit(255), F.col("v")])
    drawn = base.select("id", uniform(seed, "shuffle", i).alias("u"), *(c.alias(x) for c, x in zip(rgb, "rgb", strict=True)))
    # the place of each is the number of smaller draws; the table is as small as the number of colours asked for
    other = drawn.select(F.col("u").alias("_u"), F.col("id").alias("_i"))
    before = drawn.join(other, (F.col("_u") < F.col("u")) | ((F.col("_u") == F.col("u")) & (F.col("_i") < F.col("id"))), "left")
    return before.groupBy("id", "r", "g", "b").agg(F.count("_i").alias("color_id")).select("color_id", "r", "g", "b")


def paint_labels(labels: DataFrame, clusters: DataFrame, colors: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """keys, px, py, r, g, b: every labelled pixel in the colour of its cluster."""
    rgb = clusters.select(*keys, F.col("cluster_id").alias("label"), *(c.alias(n) for c, n in zip(colors, "rgb", strict=True)))
    return labels.join(rgb, [*keys, "label"]).select(*keys, "px", "py", "r", "g", "b")


def paint_squares(places: DataFrame, colors: Sequence[Column], reach: int, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, px, py, r, g, b: a square of 2 * reach + 1 pixels around each place (px, py, cluster_id); later clusters cover earlier ones."""
    at = places.select(*keys, "px", "py", F.struct(F.col("cluster_id"), *(c.alias(n) for c, n in zip(colors, "rgb", strict=True))).alias("paint"))
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.col(c) - reach, F.lit(0)).cast("int"), F.least(F.col(c) + reach, F.lit(n - 1)).cast("int")))
    inside = at.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    rows = inside.withColumn("_y", span("py", height)).withColumn("_x", span("px", width))
    top = rows.groupBy(*keys, F.col("_x").alias("px"), F.col("_y").alias("py")).agg(F.max("paint").alias("paint"))
    return top.select(*keys, "px", "py", "paint.r", "paint.g", "paint.b")
