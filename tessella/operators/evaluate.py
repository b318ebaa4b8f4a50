"""Quality of label images: labels and truths are keys, px, py, label; -1 is unassigned."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import circularity
from tessella.functions.mathx import dot, dot_diff
from tessella.operators.stencil import NEAR4, NEAR8, box, shifted
from tessella.params import Camera


def under_segmentation(labels: DataFrame, truth: DataFrame, keys: Sequence[str] = (), share: float = 0.05) -> DataFrame:
    """keys, error: area of all segments that reach into a true region by more than `share` of themselves, over the area of the
    regions, less one. Unassigned pixels count where they lie."""
    both = labels.join(truth.withColumnRenamed("label", "_t"), [*keys, "px", "py"])
    part = both.groupBy(*keys, "_t", "label").agg(F.count(F.lit(1)).alias("_n"))
    area = part.groupBy(*keys, "label").agg(F.sum("_n").alias("_all"))
    size = F.when(F.col("label") == -1, F.col("_n")).otherwise(F.col("_all"))
    seen = part.join(area, [*keys, "label"]).withColumn("_size", size)
    sums = seen.groupBy(*keys).agg(F.sum(F.when(F.col("_n") / F.col("_size") > share, F.col("_size")).otherwise(0)).alias("_c"), F.sum("_n").alias("_r"))
    return sums.select(*keys, (F.col("_c") / F.col("_r") - 1).alias("error"))


def boundary(labels: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, px, py, boundary (0 or 1): some neighbour differs, or the pixel lies at the image's border."""
    n = shifted(labels, "label", NEAR4, keys, None)
    same = F.lit(True)
    for i in range(4):
        same = same & (F.col(f"label_{i}") == F.col("label"))
    inner = F.col("px").between(1, width - 2) & F.col("py").between(1, height - 2)
    return n.select(*keys, "px", "py", F.when(inner & same, 0).otherwise(1).alias("boundary"))


def label_edges(labels: DataFrame, keys: Sequence[str] = (), size: int = 1) -> DataFrame:
    """keys, px, py, edge: more than `size` of the eight neighbours have another label (inner contours on both sides)."""
    n = shifted(labels, "label", NEAR8, keys, None)
    many = sum(F.when(F.col(f"label_{i}") != F.col("label"), 1).otherwise(0) for i in range(8))
    return n.select(*keys, "px", "py", (many > size).alias("edge"))


def _inside(margin: int, width: int, height: int) -> Column:
    return F.col("px").between(margin, width - 1 - margin) & F.col("py").between(margin, height - 1 - margin)


def nearest_within(wanted: DataFrame, marked: DataFrame, d: int, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Adds d2, the squared distance to the nearest marked pixel of the box, null if there's none. Boxes are exploded and
    joined on coordinates; both sides hold boundary pixels only."""
    asked = box(wanted.select(*keys, F.col("px").alias("sx"), F.col("py").alias("sy")), F.lit(d), width, height)
    hit = asked.join(marked.select(*keys, "px", "py", F.lit(True).alias("_m")), [*keys, "px", "py"])
    d2 = (F.col("px") - F.col("sx")) * (F.col("px") - F.col("sx")) + (F.col("py") - F.col("sy")) * (F.col("py") - F.col("sy"))
    near = hit.groupBy(*keys, F.col("sx").alias("px"), F.col("sy").alias("py")).agg(F.min(d2).alias("d2"))
    return wanted.join(near, [*keys, "px", "py"], "left")


def recall(relevant: DataFrame, retrieved: DataFrame, d: int, width: int, height: int, keys: Sequence[str] = (), border: int = 50) -> DataFrame:
    """keys, recall: share of relevant boundary pixels off the border with a retrieved one within d; 1 if there are none."""
    want = relevant.where((F.col("boundary") != 0) & _inside(border + d, width, height))
    got = nearest_within(want, retrieved.where("boundary != 0"), d, width, height, keys)
    return got.groupBy(*keys).agg(F.coalesce(F.count("d2") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)).alias("recall"))


def precision_recall(relevant: DataFrame, retrieved: DataFrame, d: int, width: int, height: int, keys: Sequence[str] = (), border: int = 50) -> DataFrame:
    """Counts of relevant and retrieved pixels and of those met by the other side, with precision, recall and their harmonic
    mean."""

    def side(a: DataFrame, b: DataFrame, n: str) -> DataFrame:
        want = a.where((F.col("boundary") != 0) & _inside(border + d, width, height))
        return nearest_within(want, b.where("boundary != 0"), d, width, height, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{n}"), F.count("d2").alias(f"n_{n}_met"))

    x, y = side(relevant, retrieved, "relevant"), side(retrieved, relevant, "retrieved")
    both = x.join(y, list(keys)) if keys else x.crossJoin(F.broadcast(y))  # one row each
    p, r = F.col("n_retrieved_met") / F.col("n_retrieved"), F.col("n_relevant_met") / F.col("n_relevant")
    return both.withColumns({"precision": p, "recall": r}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def recall_gaussian(relevant: DataFrame, retrieved: DataFrame, sigma: float, width: int, height: int, keys: Sequence[str] = (), border: int = 50) -> DataFrame:
    d = round(sigma * math.sqrt(-2 * math.log(0.05)))
    want = relevant.where((F.col("boundary") != 0) & _inside(border + d, width, height))
    got = nearest_within(want, retrieved.where("boundary != 0"), d, width, height, keys)
    return got.groupBy(*keys).agg(F.avg(F.coalesce(F.exp(F.col("d2") * (-0.5 / (sigma * sigma))), F.lit(0.0))).alias("recall"))


def recall_classes(relevant: DataFrame, retrieved: DataFrame, d: int, width: int, height: int, keys: Sequence[str] = (), border: int = 50) -> DataFrame:
    """keys, px, py, kind: met (relevant, with a retrieved pixel near), echo (retrieved only, with a relevant pixel near),
    missed, extra or none."""
    a = nearest_within(relevant.where("boundary != 0").select(*keys, "px", "py"), retrieved.where("boundary != 0"), d, width, height, keys).withColumnsRenamed({"d2": "_a"}).withColumn("_ra", F.lit(True))
    b = nearest_within(retrieved.where("boundary != 0").select(*keys, "px", "py"), relevant.where("boundary != 0"), d, width, height, keys).withColumnsRenamed({"d2": "_b"}).withColumn("_rb", F.lit(True))
    at = relevant.where(_inside(border + d, width, height)).select(*keys, "px", "py").join(a, [*keys, "px", "py"], "left").join(b, [*keys, "px", "py"], "left")
    kind = F.when(F.col("_a").isNotNull(), "met").when(F.col("_b").isNotNull(), "echo").when(F.col("_ra"), "missed").when(F.col("_rb"), "extra").otherwise("none")
    return at.select(*keys, "px", "py", kind.alias("kind"))


def pixel_area(cam: Camera) -> Column:
    """Surface that a pixel covers, from its depth and normal."""
    size = F.col("z") / cam.focal
    return size * size / circularity([F.col(c) for c in ("nx", "ny", "nz")])


def mean_area(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return labels.where("label >= 0").groupBy(*keys).agg((F.count(F.lit(1)) / F.count_distinct("label")).alias("area"))


def mean_area_3d(labels: DataFrame, points: DataFrame, cam: Camera, keys: Sequence[str] = ()) -> DataFrame:
    rows = labels.where("label >= 0").join(points, [*keys, "px", "py"])
    return rows.groupBy(*keys).agg((F.sum(pixel_area(cam)) / F.count_distinct("label")).alias("area"))


def isoperimetric(labels: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Area-weighted mean of 4 pi A / L^2, A counting inner pixels and L boundary pixels."""
    rows = labels.where("label >= 0").join(boundary(labels, width, height, keys), [*keys, "px", "py"])
    each = rows.groupBy(*keys, "label").agg(F.count_if(F.col("boundary") == 0).alias("a"), F.sum("boundary").alias("l"))
    return _quotient(each, keys)


def isoperimetric_3d(labels: DataFrame, points: DataFrame, cam: Camera, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """The same on the surface; here A counts all pixels."""
    rows = labels.where("label >= 0").join(boundary(labels, width, height, keys), [*keys, "px", "py"]).join(points, [*keys, "px", "py"])
    long = (1.571 - 0.571 * circularity([F.col(c) for c in ("nx", "ny", "nz")])) * (F.col("z") / cam.focal)
    return _quotient(rows.groupBy(*keys, "label").agg(F.sum(pixel_area(cam)).alias("a"), F.sum(F.when(F.col("boundary") == 1, long).otherwise(0.0)).alias("l")), keys)


def _quotient(each: DataFrame, keys: Sequence[str]) -> DataFrame:
    q = 4 * math.pi * F.col("a") / (F.col("l") * F.col("l"))
    return each.groupBy(*keys).agg((F.sum(q * F.col("a")) / F.sum("a")).alias("quotient"))


KINDS = {"color": ("c0", "c1", "c2"), "depth": ("z",), "position": ("x", "y", "z"), "normal": ("nx", "ny", "nz")}


def _apart(kind: str, a: Sequence[Column], b: Sequence[Column]) -> Column:
    return 1 - dot(a, b) if kind == "normal" else F.sqrt(dot_diff(a, b))


def explained_variation(labels: DataFrame, points: DataFrame, centres: DataFrame, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """Squared distances of segment centres (keys, label, features) to the overall mean over those of their pixels."""
    names = KINDS[kind]
    whole = points.where("is_valid").groupBy(*keys).agg(*(F.avg(n).alias(f"_m{n}") for n in names))
    if kind == "normal":
        size = F.sqrt(dot([F.col(f"_m{n}") for n in names]))
        whole = whole.select(*keys, *((F.col(f"_m{n}") / size).alias(f"_m{n}") for n in names))
    rows = labels.where("label >= 0").join(points.select(*keys, "px", "py", *names), [*keys, "px", "py"])
    rows = rows.join(centres.select(*keys, "label", *(F.col(n).alias(f"_c{n}") for n in names)), [*keys, "label"])
    rows = rows.join(F.broadcast(whole), list(keys)) if keys else rows.crossJoin(F.broadcast(whole))  # one row
    mean = [F.col(f"_m{n}") for n in names]
    s, p = _apart(kind, [F.col(f"_c{n}") for n in names], mean), _apart(kind, [F.col(n) for n in names], mean)
    return rows.groupBy(*keys).agg((F.sum(s * s) / F.sum(p * p)).alias("explained"))


def compression_error(labels: DataFrame, points: DataFrame, centres: DataFrame, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """Root mean square distance of pixels to their segment's centre; degrees for normals."""
    names = KINDS[kind]
    rows = labels.where("label >= 0").join(points.select(*keys, "px", "py", *names), [*keys, "px", "py"])
    rows = rows.join(centres.select(*keys, "label", *(F.col(n).alias(f"_c{n}") for n in names)), [*keys, "label"])
    a, b = [F.col(n) for n in names], [F.col(f"_c{n}") for n in names]
    d = F.degrees(F.acos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b))))) if kind == "normal" else F.sqrt(dot_diff(a, b))
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("error"))
