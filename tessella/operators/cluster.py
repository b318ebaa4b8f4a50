"""Local iterative clustering: pixels go to the nearest centre among those whose box they lie in.

The range join of centres and pixels is a box explode and an equi-join on (keys, px, py); the nearest centre is
min(struct(distance, cluster_id)), which combines map-side and breaks ties by the lowest id. Centres are few per frame and
are never collected; loops cut their lineage through the shared folder."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metric as D
from tessella.functions.geometry import circularity, project
from tessella.functions.mathx import dot, dot_diff, trunc
from tessella.operators.stencil import NEAR4, box, shifted
from tessella.params import Camera
from tessella.scratch import cut

FEATURES = ("c0", "c1", "c2", "x", "y", "z")
SIGMA = 1.959964  # standard deviations that hold 95 % of a normal distribution
PLACES = 9  # centres are rounded, so that results don't depend on the order of sums


def seeds_at(points: DataFrame, places: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Seeds (keys, seed_id, x, y) rounded to pixels; those outside or on invalid pixels go. Adds px, py, radius_px."""
    at = places.select(*keys, "seed_id", F.round("x").cast("int").alias("px"), F.round("y").cast("int").alias("py"))
    return at.join(points.where("is_valid").select(*keys, "px", "py", "radius_px"), [*keys, "px", "py"]).select(*keys, "seed_id", "px", "py", "radius_px")


def find_seeds(mode: str, density: DataFrame, points: DataFrame, width: int, height: int, seed: int = 42, keys: Sequence[str] = (), before: DataFrame | None = None) -> DataFrame:
    """keys, seed_id, px, py, radius_px, label: seeds by the name of a sampler. For dds, before holds the last clusters (cluster_id,
    px, py), and label is the one a seed comes from, or -1; other samplers know no last clusters and leave -1."""
    from tessella.operators import sampling

    old = None if before is None else before.select(*keys, F.col("cluster_id").cast("long").alias("seed_id"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))
    got = sampling.sample(mode, density, width, height, seed, keys, old)
    got = got if "origin" in got.columns else got.withColumn("origin", F.lit(-1).cast("long"))
    got = cut(got.withColumn("seed_id", F.xxhash64("x", "y", "origin")), "seeds")
    return seeds_at(points, got, keys).join(got.select(*keys, "seed_id", F.col("origin").alias("label")), [*keys, "seed_id"])


def edges(points: DataFrame, metric: D.Metric, width: int, height: int, keys: Sequence[str] = (), none: float = 1e6) -> DataFrame:
    """Edge strength: the distance of the left and right plus that of the upper and lower neighbour; `none` at the border
    and beside invalid pixels."""
    names = ["px", "py", *D.COLOR, *D.POSITION, *D.NORMAL, "radius_px", "is_valid"]
    packed = points.select(*keys, "px", "py", "is_valid", F.struct(*names).alias("p"))
    n = shifted(packed, "p", NEAR4, keys, None)
    at = lambda i: {c: F.col(f"p_{i}.{c}") for c in names}
    ok = F.col("is_valid")
    for i in range(4):
        ok = ok & F.coalesce(F.col(f"p_{i}.is_valid"), F.lit(False))
    return n.select(*keys, "px", "py", F.when(ok, metric(at(0), at(1)) + metric(at(2), at(3))).otherwise(none).alias("edge"))


def improve_seeds(seeds: DataFrame, edge: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each seed moves to the weakest edge among itself and its eight neighbours; on ties to the first in the order of
    itself, west, north-west and on around. Fixed seeds (column is_fixed, if there) stay."""
    order = [(0, 0), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]
    if "is_fixed" not in seeds.columns:
        seeds = seeds.withColumn("is_fixed", F.lit(False))
    ask = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(order)))
    ask = F.when(F.col("is_fixed"), F.slice(ask, 1, 1)).otherwise(ask)
    asked = seeds.select(*keys, "seed_id", "px", "py", F.explode(ask).alias("o"))
    asked = asked.select(*keys, "seed_id", (F.col("px") + F.col("o.dx")).cast("int").alias("px"), (F.col("py") + F.col("o.dy")).cast("int").alias("py"), F.col("o.i").alias("i"))
    best = asked.join(edge, [*keys, "px", "py"]).groupBy(*keys, "seed_id").agg(F.min(F.struct("edge", "i", "px", "py")).alias("b"))
    return best.select(*keys, "seed_id", F.col("b.px").alias("px"), F.col("b.py").alias("py"))


def _centre(rows: DataFrame, by: Sequence[str], mode: str, cam: Camera | None) -> DataFrame:
    """Means of grouped pixels with n; the centre's pixel is the mean pixel (rgb) or the projected mean position, truncated."""
    mean = lambda c: F.round(F.avg(c), PLACES).alias(c)
    got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(mean(c) for c in FEATURES), F.first("radius").alias("radius_px"), F.sum("px").alias("_sx"), F.sum("py").alias("_sy"))
    if mode == "rgb":
        at = [F.col("_sx") / F.col("n"), F.col("_sy") / F.col("n")]
    else:
        at = [p + 0.5 for p in project(F.col("x"), F.col("y"), F.col("z"), cam)]
    return got.withColumns({"px": trunc(at[0]).cast("int"), "py": trunc(at[1]).cast("int")}).drop("_sx", "_sy")


def _numbered(clusters: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """cluster_id from 0 in the order of the old ids; one frame's centres are few."""
    w = Window.partitionBy(*keys).orderBy(order)
    return clusters.withColumn("_id", F.row_number().over(w) - 1).drop(order, *(["cluster_id"] if order != "cluster_id" else [])).withColumnRenamed("_id", "cluster_id")


def create_clusters(seeds: DataFrame, points: DataFrame, width: int, height: int, keys: Sequence[str] = (), mode: str = "rgbd", cam: Camera | None = None) -> DataFrame:
    """One centre per seed from the valid pixels within at most two pixels around it, if there are more than three."""
    at = seeds.select(*keys, "seed_id", F.col("px").alias("sx"), F.col("py").alias("sy"), F.col("radius_px").alias("radius"))
    near = box(at, F.least(F.lit(2), F.ceil(F.col("radius") * 0.35)).cast("int"), width, height)
    rows = near.join(points.where("is_valid").select(*keys, "px", "py", *FEATURES), [*keys, "px", "py"])
    return _numbered(_centre(rows, [*keys, "seed_id"], mode, cam).where("n > 3"), keys, "seed_id")


def assign(clusters: DataFrame, points: DataFrame, metric: D.Metric, coverage: float, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, px, py, label, distance: the nearest centre of every valid pixel that lies in a centre's box."""
    c = clusters.withColumnsRenamed({n: f"_{n}" for n in clusters.columns if n not in (*keys, "cluster_id")})
    c = c.withColumns({"sx": F.col("_px"), "sy": F.col("_py")})
    reach = F.greatest(F.lit(2), trunc(F.col("_radius_px") * coverage + 0.5)).cast("int")
    pairs = box(c, reach, width, height).join(points.where("is_valid"), [*keys, "px", "py"])
    centre = {n: F.col(f"_{n}") for n in clusters.columns if n not in (*keys, "cluster_id")}
    pairs = pairs.withColumn("distance", metric(D.point(columns=[x for x in points.columns if x not in keys]), centre))
    best = pairs.groupBy(*keys, "px", "py").agg(F.min(F.struct("distance", "cluster_id")).alias("b"))
    return best.select(*keys, "px", "py", F.col("b.cluster_id").alias("label"), F.col("b.distance").alias("distance"))


def update(labels: DataFrame, points: DataFrame, clusters: DataFrame, keys: Sequence[str] = (), mode: str = "rgbd", cam: Camera | None = None) -> DataFrame:
    """New centres of the clusters with more than three pixels, renumbered in order; radii stay as they were."""
    radius = clusters.select(*keys, F.col("cluster_id").alias("label"), F.col("radius_px").alias("radius"))
    rows = labels.join(points.select(*keys, "px", "py", *FEATURES), [*keys, "px", "py"]).join(radius, [*keys, "label"])
    return _numbered(_centre(rows, [*keys, "label"], mode, cam).where("n > 3"), keys, "label")


def full_labels(labels: DataFrame, pixels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A label for every pixel, -1 where there's none."""
    out = pixels.select(*keys, "px", "py").join(labels.select(*keys, "px", "py", "label"), [*keys, "px", "py"], "left")
    return out.select(*keys, "px", "py", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def segment(points: DataFrame, seeds: DataFrame, metric: D.Metric, width: int, height: int, keys: Sequence[str] = (), iterations: int = 5, coverage: float = 1.7, mode: str = "rgbd", cam: Camera | None = None, conquer: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole loop: centres from seeds, then assign, purge and update a number of times. Returns the labels of all pixels,
    numbered like the returned centres."""
    points = cut(points, "points")
    clusters = cut(create_clusters(seeds, points, width, height, keys, mode, cam), "clusters")
    labels = None
    for _ in range(iterations):
        moved = cut(assign(clusters, points, metric, coverage, width, height, keys), "labels")
        kept = moved.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
        number = _numbered(kept.withColumn("old", F.col("label")), keys, "label").select(*keys, F.col("old").alias("label"), "cluster_id")
        labels = moved.join(number, [*keys, "label"]).select(*keys, "px", "py", F.col("cluster_id").alias("label"))
        clusters = cut(update(moved, points, clusters, keys, mode, cam), "clusters")
    full = full_labels(labels, points, keys)
    if conquer:
        full = mini_enclaves(full, points, width, height, keys)
    return full, clusters


def mini_enclaves(labels: DataFrame, points: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Inner pixels unlike all four neighbours take the label of the labelled neighbour nearest in space (left, right, upper,
    lower on ties). All are judged on the labels as they come in."""
    rows = labels.join(points.select(*keys, "px", "py", *D.POSITION), [*keys, "px", "py"])
    rows = rows.withColumn("p", F.struct("label", *D.POSITION))
    n = shifted(rows, "p", NEAR4, keys, None)
    inner = F.col("px").between(1, width - 2) & F.col("py").between(1, height - 2)
    near = [F.col(f"p_{i}.label") for i in range(4)]
    alone, some = F.lit(True), F.lit(False)
    for x in near:
        alone, some = alone & (x != F.col("label")), some | (x != -1)
    far = [dot_diff([F.col(c) for c in D.POSITION], [F.col(f"p_{i}.{c}") for c in D.POSITION]) for i in range(4)]
    best = F.array_min(F.array(*(F.struct(F.when(x != -1, d).otherwise(math.inf).alias("d"), F.lit(i).alias("i"), x.alias("l")) for i, (x, d) in enumerate(zip(near, far, strict=True)))))
    return n.select(*keys, "px", "py", F.when((F.col("label") != -1) & inner & alone & some, best["l"]).otherwise(F.col("label")).cast("int").alias("label"))


def covariance(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n and the six covariances of positions, divided by n."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(a, b).alias(f"s{a}{b}") for a, b in pairs))


def eigenvalues(s: Sequence[Column]) -> list[Column]:
    """Of a symmetric 3 x 3 matrix (xx, xy, xz, yy, yz, zz), ascending, in closed form."""
    a, b, c, d, e, f = s
    q = (a + d + f) / 3
    p2 = (a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)
    p = F.sqrt(p2 / 6)
    det = (a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))
    phi = F.acos(r) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    flat = p == 0
    return [F.when(flat, q).otherwise(v) for v in (low, 3 * q - high - low, high)]


def eigenvector(s: Sequence[Column], value: Column) -> list[Column]:
    """Unit eigenvector of a simple eigenvalue: the longest cross product of two rows of the shifted matrix."""
    a, b, c, d, e, f = s
    rows = [(a - value, b, c), (b, d - value, e), (c, e, f - value)]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    options = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    best = F.array_max(F.array(*(F.struct(dot(o).alias("l"), *(v.alias(f"v{i}") for i, v in enumerate(o))) for o in options)))
    return [F.when(best["l"] > 0, best[f"v{i}"] / F.sqrt(best["l"])).otherwise(float(i == 2)) for i in range(3)]


def cluster_normals(cov: DataFrame, centres: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, e0..e2 and the normal: the flattest direction, facing the camera."""
    s = [F.col(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")]
    got = cov.withColumns({f"e{i}": v for i, v in enumerate(eigenvalues(s))})
    got = got.withColumns({n: v for n, v in zip(D.NORMAL, eigenvector(s, F.col("e0")), strict=True)})
    got = got.join(centres.select(*by, *D.POSITION), list(by))
    q = -dot([F.col(c) for c in D.NORMAL], [F.col(c) for c in D.POSITION])
    turned = [F.when(q < 0, -F.col(c)).when(q == 0, at).otherwise(F.col(c)).alias(c) for c, at in zip(D.NORMAL, (0.0, 0.0, -1.0), strict=True)]
    return got.select(*by, "n", "e0", "e1", "e2", *turned)


def shape_descriptors(e: Sequence[Column], base_radius: float) -> dict[str, Column]:
    e0, e1, e2 = (F.abs(v) for v in e)
    area = SIGMA * SIGMA * F.sqrt(e1 * e2)
    return {"thickness": SIGMA * F.sqrt(e0) * 2, "eccentricity": F.sqrt(1 - e1 / e2), "flatness": F.sqrt(1 - e0 / e2), "area": area * math.pi, "area_quotient": area / (base_radius * base_radius)}


def plane_thickness(rows: DataFrame, by: Sequence[str], share: float = 0.95) -> DataFrame:
    """by, thickness_plane: twice the order statistic floor(share * n) of the signed distances d."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy("d")), "_n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("_r") == F.floor(F.col("_n") * share) + 1).select(*by, (F.col("d") * 2).alias("thickness_plane"))


def extended(labels: DataFrame, points: DataFrame, centres: DataFrame, base_radius: float, cam: Camera, coverage: float, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Plane thickness, actual and expected area and the coverage error of centres (with normals)."""
    at = centres.select(*keys, F.col("cluster_id").alias("label"), *(F.col(c).alias(f"_{c}") for c in (*D.POSITION, *D.NORMAL)), F.col("px").alias("sx"), F.col("py").alias("sy"), "radius_px")
    own = labels.where("label >= 0").select(*keys, "px", "py", "label")
    offset = [F.col(c) - F.col(f"_{c}") for c in D.POSITION]
    lam = dot(offset, [F.col(f"_{c}") for c in D.NORMAL])
    position = points.select(*keys, "px", "py", *D.POSITION, *D.NORMAL)
    rows = own.join(position.select(*keys, "px", "py", *D.POSITION), [*keys, "px", "py"]).join(at, [*keys, "label"])
    thick = plane_thickness(rows.withColumn("d", lam), [*keys, "label"])
    boxes = box(at.join(thick, [*keys, "label"]), (F.col("radius_px") * coverage * 1.5).cast("int"), width, height)
    seen = boxes.drop("radius_px").join(position, [*keys, "px", "py"]).join(own.withColumnRenamed("label", "_own"), [*keys, "px", "py"], "left")
    size = F.col("z") / cam.focal
    area = size * size / circularity([F.col(c) for c in D.NORMAL])
    expected = (lam < F.col("thickness_plane") / 2) & (dot(offset) - lam * lam < base_radius * base_radius)
    actual = F.coalesce(F.col("_own") == F.col("label"), F.lit(False))
    seen = seen.withColumns({"_a": F.when(F.col("nz") != 0, area).otherwise(0.0), "_e": expected, "_t": actual})
    got = seen.groupBy(*keys, "label", "thickness_plane").agg(F.sum(F.when(F.col("_t"), F.col("_a")).otherwise(0.0)).alias("area_actual"), F.sum(F.when(F.col("_e"), F.col("_a")).otherwise(0.0)).alias("area_expected"), F.sum(F.when(F.col("_t") != F.col("_e"), F.col("_a")).otherwise(0.0)).alias("_err"))
    return got.select(*keys, "label", "thickness_plane", "area_actual", "area_expected", F.when(F.col("area_expected") == 0, 0.0).otherwise(F.col("_err") / F.col("area_expected")).alias("coverage_error"))


def histogram_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Rounded, not floored, position among the bins; clamped at both ends."""
    return F.least(F.greatest(F.round((x - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("int")


def _with_radius(at: DataFrame, features: DataFrame, keys: Sequence[str], rho: float | None) -> DataFrame:
    """at (keys, x, y, ...) with the radius _r by density. rho: the density everywhere, pixels or not; by default it is that of the
    pixel (x, y) lies on, and rows on no pixel go."""
    if rho is not None:
        return at.withColumn("_r", F.lit(1 / math.sqrt(math.pi * rho)))
    under = at.withColumns({"px": trunc(F.col("x")).cast("int"), "py": trunc(F.col("y")).cast("int")})
    under = under.join(features.where("rho > 0").select(*keys, "px", "py", "rho"), [*keys, "px", "py"])
    return under.drop("px", "py").withColumn("_r", 1 / F.sqrt(math.pi * F.col("rho"))).drop("rho")


def _nearest(clusters: DataFrame, features: DataFrame, metric: D.Metric, coverage: float, compact: float, width: int, height: int, names: Sequence[str], keys: Sequence[str], rho: float | None) -> DataFrame:
    """keys, px, py, label, names...: see `assign_generic`; of rows that share a pixel, the one that is nearest to a cluster."""
    at = _with_radius(clusters.select(*keys, "cluster_id", "x", "y", *(F.col(n).alias(f"_{n}") for n in names)), features, keys, rho)
    reach = F.col("_r") * coverage
    xs = F.sequence(F.greatest(trunc(F.col("x") - reach), F.lit(0)), F.least(trunc(F.col("x") + reach), F.lit(width - 1)))
    ys = F.sequence(F.greatest(trunc(F.col("y") - reach), F.lit(0)), F.least(trunc(F.col("y") + reach), F.lit(height - 1)))
    pairs = at.withColumn("py", F.explode(ys)).withColumn("px", F.explode(xs)).withColumns({"px": F.col("px").cast("int"), "py": F.col("py").cast("int")})
    pairs = pairs.join(features.where("rho > 0").select(*keys, "px", "py", *names), [*keys, "px", "py"])
    far = F.sqrt((F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y")))
    d = compact / F.col("_r") * far + metric({n: F.col(n) for n in names}, {n: F.col(f"_{n}") for n in names})
    best = pairs.groupBy(*keys, "px", "py").agg(F.min(F.struct(d.alias("d"), "cluster_id", *names)).alias("b"))
    return best.select(*keys, "px", "py", F.col("b.cluster_id").alias("label"), *(F.col(f"b.{n}").alias(n) for n in names))


def assign_generic(clusters: DataFrame, features: DataFrame, metric: D.Metric, coverage: float, compact: float, width: int, height: int, names: Sequence[str], keys: Sequence[str] = (), rho: float | None = None) -> DataFrame:
    """Feature clustering: clusters (cluster_id, x, y, names...), features (px, py, rho, names...); rho 0 is no pixel. The
    distance is compactness by radius times the pixel distance, plus the metric of features. rho: see `_with_radius`."""
    return _nearest(clusters, features, metric, coverage, compact, width, height, names, keys, rho).select(*keys, "px", "py", "label")


def means_generic(labels: DataFrame, features: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean pixel and features of the non-empty clusters, renumbered in order."""
    return _means(labels.join(features.select(*keys, "px", "py", *names), [*keys, "px", "py"]), names, keys)


def _means(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    got = rows.groupBy(*keys, "label").agg((F.sum("px") / F.count(F.lit(1))).alias("x"), (F.sum("py") / F.count(F.lit(1))).alias("y"), *(F.round(F.avg(n), PLACES).alias(n) for n in names))
    return _numbered(got, keys, "label")


def local_mean(seeds: DataFrame, features: DataFrame, names: Sequence[str], width: int, height: int, keys: Sequence[str] = (), factor: float = 0.25, rho: float | None = None) -> DataFrame:
    """Clusters from seeds (seed_id, x, y): features averaged over a quarter of the radius around each. rho: see `_with_radius`."""
    at = _with_radius(seeds.select(*keys, "seed_id", "x", "y"), features, keys, rho).withColumn("reach", factor * F.col("_r"))
    xs = F.sequence(F.greatest(trunc(F.col("x") - F.col("reach")), F.lit(0)), F.least(trunc(F.col("x") + F.col("reach")), F.lit(width - 1)))
    ys = F.sequence(F.greatest(trunc(F.col("y") - F.col("reach")), F.lit(0)), F.least(trunc(F.col("y") + F.col("reach")), F.lit(height - 1)))
    spread = at.drop("_r").withColumn("py", F.explode(ys)).withColumn("px", F.explode(xs)).withColumns({"px": F.col("px").cast("int"), "py": F.col("py").cast("int")})
    rows = spread.join(features.select(*keys, "px", "py", *names), [*keys, "px", "py"])
    got = rows.groupBy(*keys, "seed_id", "x", "y").agg(*(F.round(F.avg(n), PLACES).alias(n) for n in names))
    return _numbered(got, keys, "seed_id")


def euclid(names: Sequence[str]) -> D.Metric:
    return lambda p, q: F.sqrt(dot_diff([p[n] for n in names], [q[n] for n in names]))


def adaptive_clusters(features: DataFrame, seeds: DataFrame, names: Sequence[str], width: int, height: int, metric: D.Metric | None = None, iterations: int = 5, coverage: float = 3.0, compact: float = 1.0, keys: Sequence[str] = (), rho: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Seed, then assign and average a number of times. Returns labels (of the last clusters) and clusters. Rows that share a pixel
    count as one in the averages, the nearest. rho: see `_with_radius`."""
    metric = metric or euclid(names)
    features = cut(features, "features")
    clusters = cut(local_mean(seeds, features, names, width, height, keys, rho=rho), "clusters")
    labels = None
    for _ in range(iterations):
        labels = cut(_nearest(clusters, features, metric, coverage, compact, width, height, names, keys, rho), "labels")
        clusters = cut(_means(labels, names, keys), "clusters")
    number = _numbered(labels.select(*keys, "label", F.col("label").alias("old")).distinct(), keys, "label").select(*keys, F.col("old").alias("label"), "cluster_id")
    return labels.join(number, [*keys, "label"]).select(*keys, "px", "py", F.col("cluster_id").alias("label")), clusters


def enclaves(labels: DataFrame, points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of each label only its largest connected part keeps it (the one with the smallest first pixel on ties); every other part
    takes the label that most of its neighbouring pixels have (the smallest on ties)."""
    from tessella.operators.graph import connected

    rows = labels.where("label >= 0").withColumn("vertex", F.col("py").cast("long") * (1 << 20) + F.col("px"))
    right = rows.select(*keys, (F.col("px") - 1).alias("px"), "py", F.col("label").alias("l"), F.col("vertex").alias("dst"))
    below = rows.select(*keys, "px", (F.col("py") - 1).alias("py"), F.col("label").alias("l"), F.col("vertex").alias("dst"))
    pairs = rows.join(right.unionByName(below), [*keys, "px", "py"])
    part = connected(rows.select(*keys, "vertex"), pairs.where("label = l").select(*keys, F.col("vertex").alias("src"), "dst"), keys)
    rows = cut(rows.join(part, [*keys, "vertex"]), "parts")
    size = rows.groupBy(*keys, "label", "root").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "label").orderBy(F.desc("n"), "root"))
    small = size.withColumn("_r", rank).where("_r > 1").select(*keys, "root")
    packed = rows.select(*keys, "px", "py", F.struct("label", "root").alias("p"))
    near = shifted(packed, "p", NEAR4, keys, None)
    each = near.select(*keys, F.col("p.root").alias("root"), F.explode(F.array(*(F.col(f"p_{i}") for i in range(4)))).alias("q")).where("q IS NOT NULL AND q.root != root")
    votes = each.join(small, [*keys, "root"]).groupBy(*keys, "root", F.col("q.label").alias("_to")).agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(*keys, "root").agg(F.max(F.struct("_n", (-F.col("_to")).alias("_m"))).alias("b")).select(*keys, "root", (-F.col("b._m")).alias("_new"))
    moved = rows.join(best, [*keys, "root"], "left").select(*keys, "px", "py", F.coalesce("_new", "label").cast("int").alias("_l"))
    out = labels.join(moved, [*keys, "px", "py"], "left")
    return out.select(*keys, "px", "py", F.coalesce("_l", "label").cast("int").alias("label"))


def quadratic_fit(rows: DataFrame, by: Sequence[str], scale: float = 100.0) -> DataFrame:
    """by, s0..s5: least squares z = s0 + s1 x + s2 y + s3 xy + s4 xx + s5 yy of offsets dx, dy, dz times scale. The 21 + 6 moments are
    summed by Spark; the 6 x 6 systems, one row each, are solved in arrays."""
    import numpy as np
    import pyarrow as pa

    from tessella.shipping import map_arrow

    x, y, z = (F.col(c) * scale for c in ("dx", "dy", "dz"))
    terms = [F.lit(1.0), x, y, x * y, x * x, y * y]
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    sums = rows.groupBy(*by).agg(*(F.sum(terms[i] * terms[j]).alias(f"m{i}{j}") for i, j in pairs), *(F.sum(terms[i] * z).alias(f"r{i}") for i in range(6)))
    types = dict(sums.dtypes)
    keep = list(by)

    def solve(batches):
        for b in batches:
            a, r = np.zeros((b.num_rows, 6, 6)), np.stack([b.column(f"r{i}").to_numpy() for i in range(6)], 1)
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = b.column(f"m{i}{j}").to_numpy()
            s = np.stack([np.linalg.lstsq(m, v, rcond=None)[0] for m, v in zip(a, r, strict=True)]) if b.num_rows else np.zeros((0, 6))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(s[:, i]) for i in range(6))], [*keep, *(f"s{i}" for i in range(6))])

    return sums.transform(map_arrow, solve, ", ".join([*(f"{c} {types[c]}" for c in keep), *(f"s{i} double" for i in range(6))]))
