"""Seed points from densities (keys, px, py, v). Random choices come from a counter-based generator keyed by place, so results
don't depend on partitioning; order-dependent samplers run one frame at a time in pandas."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.rng import uniform
from tessella.operators.field import point_density, pyramid
from tessella.shipping import ship

JITTER = 0.38


def bernoulli(density: DataFrame, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Each pixel with the probability of its density."""
    u = uniform(seed, "keep", *(F.col(k) for k in keys), F.col("px"), F.col("py"))
    return density.where(u < F.col("v")).select(*keys, F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))


def rect_grid(density: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """Cell centres of a regular grid with about as many cells as the density sums to."""
    d = F.sqrt(F.lit(float(width * height)) / F.col("_sum"))
    n = density.groupBy(*keys).agg(F.sum("v").alias("_sum")).where("_sum > 0").select(*keys, F.ceil(width / d).alias("nx"), F.ceil(height / d).alias("ny"))
    rows = n.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1)))
    return rows.select(*keys, (width / F.col("nx") * (F.col("i") + 0.5)).alias("x"), (height / F.col("ny") * (F.col("j") + 0.5)).alias("y"))


def round_random(x: Column, u: Column) -> Column:
    """Up with the probability of the fraction; 0 for negative numbers."""
    return F.when(x <= 0, 0).otherwise(F.floor(x) + F.when(u < x - F.floor(x), 1).otherwise(0))


def cell_point(px: Column, py: Column, size: Column, ux: Column, uy: Column, gamma: float = JITTER) -> list[Column]:
    """A jittered point of a square cell."""
    return [size * (px + 0.5 + gamma * (2 * u - 1)) if n == 0 else size * (py + 0.5 + gamma * (2 * u - 1)) for n, u in enumerate((ux, uy))]


def best_in_cell(field: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """The largest pixel of every size x size cell, the first in reading order on ties."""
    cell = [F.floor(F.col(c) / size).cast("int").alias(f"c{c[1]}") for c in ("px", "py")]
    best = field.groupBy(*keys, *cell).agg(F.max(F.struct("v", (-F.col("py")).alias("ny"), (-F.col("px")).alias("nx"))).alias("b"))
    return best.select(*keys, "cx", "cy", (-F.col("b.nx")).alias("px"), (-F.col("b.ny")).alias("py"))


def _cumulated(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "v") -> DataFrame:
    return rows.withColumn("cum", F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def sample_weighted(weights: DataFrame, draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """weights: by, i, w; draws: by, draw, u in [0, 1). The first i whose running sum reaches u times the total."""
    runs = _cumulated(weights.withColumnRenamed("w", "v"), by, ["i"])
    total = weights.groupBy(*by).agg(F.sum("w").alias("_t"))
    joined = draws.join(total, list(by)) if by else draws.crossJoin(F.broadcast(total))  # one row
    joined = joined.join(runs, list(by)) if by else joined.join(F.broadcast(runs), F.lit(True))  # one weight list
    return joined.where(F.col("cum") >= F.col("u") * F.col("_t")).groupBy(*by, "draw").agg(F.min("i").alias("i"))


def point_in_cell(field: DataFrame, size: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """A pixel of every size x size cell, drawn by its share of the cell's sum."""
    cell = {f"c{c[1]}": F.floor(F.col(c) / size).cast("int") for c in ("px", "py")}
    rows = field.withColumns(cell)
    by = [*keys, "cx", "cy"]
    runs = _cumulated(rows, by, ["py", "px"])
    total = rows.groupBy(*by).agg(F.sum("v").alias("_t")).where("_t > 0").withColumn("_u", uniform(seed, "cell", F.col("cx"), F.col("cy")))
    hit = runs.join(total, by).where(F.col("cum") >= F.col("_u") * F.col("_t"))
    return hit.groupBy(*by).agg(F.min(F.struct("py", "px")).alias("p")).select(*by, F.col("p.px").alias("px"), F.col("p.py").alias("py"))


def _visited(pyr: DataFrame, keys: Sequence[str], levels: int, limit: float, floor: int) -> DataFrame:
    """Nodes where the descent from the top stops: those not above the limit, or on the lowest level allowed."""
    down = lambda c: F.floor(F.col(c) / 2).cast("int")
    open_, out = None, None
    for level in range(levels - 1, floor - 1, -1):
        at = pyr.where(F.col("level") == level).select(*keys, "level", "px", "py", "v")
        if open_ is not None:
            parent = open_.select(*keys, F.col("px").alias("_x"), F.col("py").alias("_y"))
            at = at.withColumns({"_x": down("px"), "_y": down("py")}).join(parent, [*keys, "_x", "_y"], "left_semi").select(*keys, "level", "px", "py", "v")
        go = (F.col("v") > limit) & F.lit(level > floor)
        stop = at.where(~go)
        out = stop if out is None else out.unionByName(stop)
        open_ = at.where(go)
    return out


def quadtree_sample(density: DataFrame, width: int, height: int, seed: int, keys: Sequence[str] = (), base: int = 2) -> DataFrame:
    """Descends the pyramid while a node holds more than four points and has grandchildren; there a random rounding of its
    value says how many points its children get by weight, each at a pixel of level 0 drawn by share."""
    levels = 6 if base == 5 else None
    pyr = pyramid(density, width, height, levels=levels, keys=keys, first=base)
    n = levels or (max(width, height) - 1).bit_length()
    stop = _visited(pyr, keys, n, 4.0, 1).withColumn("n", round_random(F.col("v"), uniform(seed, "round", F.col("level"), F.col("px"), F.col("py"))).cast("int")).where("n > 0")
    draws = stop.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    draws = draws.select(*keys, "level", F.col("px").alias("x"), F.col("py").alias("y"), "k", uniform(seed, "child", F.col("level"), F.col("px"), F.col("py"), F.col("k")).alias("u1"), uniform(seed, "pixel", F.col("level"), F.col("px"), F.col("py"), F.col("k")).alias("u2"))
    child = pyr.select(*keys, (F.col("level") + 1).alias("level"), F.floor(F.col("px") / 2).cast("int").alias("x"), F.floor(F.col("py") / 2).cast("int").alias("y"), ((F.col("px") % 2) * 2 + F.col("py") % 2).alias("i"), F.col("px").alias("cx"), F.col("py").alias("cy"), "v")
    node = [*keys, "level", "x", "y"]
    child = _cumulated(child, node, ["i"])
    total = child.groupBy(*node).agg(F.sum("v").alias("_t"))
    picked = draws.join(child.join(total, node), node).where(F.col("cum") >= F.col("u1") * F.col("_t"))
    picked = picked.groupBy(*node, "k", "u2").agg(F.min(F.struct("i", "cx", "cy", "v")).alias("c")).select(*node, "k", "u2", "c.cx", "c.cy", F.col("c.v").alias("w"))
    pixel = pyr.where("level = 0").select(*keys, "px", "py", "v").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(n - 1))))
    span = F.pow(F.lit(2.0), F.col("level") - 1)
    pixel = pixel.withColumns({"cx": F.floor(F.col("px") / span).cast("int"), "cy": F.floor(F.col("py") / span).cast("int")})
    pixel = _cumulated(pixel, [*keys, "level", "cx", "cy"], ["py", "px"])
    hit = picked.join(pixel, [*keys, "level", "cx", "cy"]).where(F.col("cum") >= F.col("u2") * F.col("w"))
    out = hit.groupBy(*node, "k").agg(F.min(F.struct("py", "px")).alias("p"))
    return out.select(*keys, (F.col("p.px") * float(base)).alias("x"), (F.col("p.py") * float(base)).alias("y"))


def quadtree_sample_old(density: DataFrame, width: int, height: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Descends while a node holds more than one point; accepts the node with its value's probability, at a jittered place."""
    n = (max(width, height) - 1).bit_length()
    stop = _visited(pyramid(density, width, height, keys=keys), keys, n, 1.0, 0)
    u = lambda tag: uniform(seed, tag, F.col("level"), F.col("px"), F.col("py"))
    x, y = cell_point(F.col("px"), F.col("py"), F.pow(F.lit(2.0), F.col("level")), u("x"), u("y"))
    return stop.where(u("accept") <= F.col("v")).select(*keys, (2 * x).alias("x"), (2 * y).alias("y"))


# -- one frame at a time ------------------------------------------------------------------------------------------------
def _dense(pdf: pd.DataFrame, width: int, height: int) -> np.ndarray:
    """[y, x]."""
    out = np.zeros((height, width))
    out[pdf["py"].to_numpy(), pdf["px"].to_numpy()] = pdf["v"]
    return out


def error_diffusion(d: np.ndarray) -> np.ndarray:
    """Floyd-Steinberg with threshold 1/2: 7, 3, 5 and 1 sixteenths to the right and the row below; the last row and the side
    columns emit nothing and what they hold is carried over the edge."""
    d, out = d.copy(), []
    h, w = d.shape
    for y in range(h - 1):
        row, below = d[y], d[y + 1]
        row[1] += row[0]
        for x in range(1, w - 1):
            e = row[x]
            if e >= 0.5:
                out.append((x + 0.5, y + 0.5))
                e -= 1.0
            row[x + 1] += e * 7 / 16
            below[x - 1] += e * 3 / 16
            below[x] += e * 5 / 16
            below[x + 1] += e / 16
        below[0] += row[-1]
    return np.array(out).reshape(-1, 2)


def error_diffusion_far(d: np.ndarray) -> np.ndarray:
    """Error diffusion over a radius of 1, 2, 4 or 8 pixels at densities from 7, 4 and 1 % down. The error of a run of pixels up
    to the next multiple of the radius goes to places aligned to it, to the right and `radius` rows down, kept for 8 rows in turn;
    a shift register picks one of two sets of shares."""
    out, bits = [], 0xFFFFFFFF
    h, w = d.shape
    kept = np.zeros((8, w + 16))
    for y in range(h):
        row, x = kept[y % 8], 0
        while x < w:
            v = abs(d[y, x])
            e = d[y, x] + row[x + 8]
            row[x + 8] = 0.0
            if e >= 0.5:
                e -= 1.0
                out.append((x + 0.5, y + 0.5))
            t = int(100 * v)
            shift = 0 if t >= 7 else (3, 2, 2, 2, 1, 1, 1)[t]
            r = 1 << shift
            ax, ay = x >> shift << shift, y >> shift << shift
            x += 1
            while x < min(w, ax + r):
                e += d[y, x] + row[x + 8]
                row[x + 8] = 0.0
                x += 1
            odd = (bits ^ r) & 1
            right, left, under, across = (7, 3, 5, 1) if odd else (2, 6, 2, 6)
            below = kept[(ay + r) % 8]
            kept[ay % 8, 8 + ax + r] += right / 16 * e
            below[8 + ax - r] += left / 16 * e
            below[8 + ax] += under / 16 * e
            below[8 + ax + r] += across / 16 * e
            bits = bits >> 1 ^ (0xEDB88320 if odd else 0)
    return np.array(out).reshape(-1, 2)


def halvings(d: np.ndarray, least: int = 1) -> list[np.ndarray]:
    """Sums over 2 x 2 cells of the image padded to a square of a power of two, again and again."""
    size = 1 << (max(d.shape) - 1).bit_length()
    level = np.zeros((size, size))
    level[: d.shape[0], : d.shape[1]] = d
    out = []
    while level.shape[0] > least:
        level = level.reshape(level.shape[0] // 2, 2, -1, 2).sum((1, 3))
        out.append(level)
    return out


def error_diffusion_layers(d: np.ndarray, seed: int = 42) -> np.ndarray:
    """Walks down the pyramid while a node holds more than 1.5 points. Where it stops, a node of 1/2 or more emits a point at a
    jittered place, and the rest is shared by its neighbours to the right and below that exist, there and on all finer layers."""
    base = 5 if d.shape == (480, 640) else 2
    if base == 5:
        layers = [d.reshape(96, 5, 128, 5).sum((1, 3))]
        for _ in range(5):
            layers.append(layers[-1].reshape(layers[-1].shape[0] // 2, 2, -1, 2).sum((1, 3)))
    else:
        layers = halvings(d)
    out = []

    def jitter(*key: object) -> float:
        return JITTER * (2 * int(hashlib.md5(":".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16) / 4294967296.0 - 1)

    def add(level: int, x: int, y: int, v: float) -> None:
        for k in range(level, -1, -1):
            s = 1 << level - k
            layers[k][y * s : (y + 1) * s, x * s : (x + 1) * s] += v / (s * s)

    def walk(level: int, x: int, y: int) -> None:
        v = layers[level][y, x]
        if level and v > 1.5:
            for i in (0, 1):
                for j in (0, 1):
                    walk(level - 1, 2 * x + i, 2 * y + j)
            return
        if v >= 0.5:
            size = base << level
            out.append((size * (x + 0.5 + jitter("x", level, x, y)), size * (y + 0.5 + jitter("y", level, x, y))))
            v -= 1.0
        h, w = layers[level].shape
        near = [(x + i, y + j, n) for i, j, n in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)) if 0 <= x + i < w and y + j < h]
        for i, j, n in near:
            add(level, i, j, v * n / sum(n for _, _, n in near))

    for y in range(layers[-1].shape[0]):
        for x in range(layers[-1].shape[1]):
            walk(len(layers) - 1, x, y)
    return np.array(out).reshape(-1, 2)


KERNEL_REACH = 1.482837414  # where the kernel has fallen to a thousandth


def kernel_sum(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """[y, x] sum of the points' (x, y, weight, scale) kernels over their windows."""
    out = np.zeros(shape)
    for x, y, weight, scale in points:
        r = KERNEL_REACH * scale
        x0, x1 = max(0, math.floor(x - r)), min(shape[1] - 1, math.ceil(x + r))
        y0, y1 = max(0, math.floor(y - r)), min(shape[0] - 1, math.ceil(y + r))
        if x0 <= x1 and y0 <= y1:
            gx, gy = np.arange(x0, x1 + 1) - x, np.arange(y0, y1 + 1) - y
            s2 = scale * scale
            out[y0 : y1 + 1, x0 : x1 + 1] += weight / s2 * np.exp(-math.pi * gy * gy / s2)[:, None] * np.exp(-math.pi * gx * gx / s2)[None, :]
    return out


def blue_noise(d: np.ndarray, seed: int, steps: int = 20, step: float = 0.3, temperature: float = 0.03) -> np.ndarray:
    """Kernels placed greedily on a coarse layer where they lower the approximation's error, moved by Langevin steps, then
    split in four and moved again on every finer layer."""
    rng = np.random.default_rng(seed)
    layers = [d, *halvings(d, 8)]
    top = len(layers) - 1
    scale_of = lambda rho, weight: np.sqrt(weight / rho)
    points = np.zeros((0, 4))
    for k in range(top, -1, -1):
        rho = layers[k]
        if k == top:
            approx, error = np.zeros(rho.shape), np.abs(rho).sum()
            for i in rng.permutation(rho.size):
                y, x = divmod(int(i), rho.shape[1])
                if rho[y, x] <= 0:
                    continue
                q = k - (0 if rho[y, x] < 1 else math.ceil(math.log2(rho[y, x]) / 2))
                weight = float(4 ** max(0, q))
                one = np.array([[x, y, weight, scale_of(rho[y, x], weight)]])
                tried = approx + kernel_sum(one, rho.shape)
                if np.abs(tried - rho).sum() <= error:
                    approx, error, points = tried, np.abs(tried - rho).sum(), np.vstack([points, one])
        else:
            grown = []
            for x, y, weight, scale in points:
                offsets = [(0.0, 0.0)] if weight <= 1 else [(a, b) for b in (-1, 1) for a in (-1, 1)]
                w = max(1.0, weight / 4)
                reach = 0.3 * math.sqrt(0.5) * scale
                grown += [(2 * x + reach * a, 2 * y + reach * b, w, 0.0) for a, b in offsets]
            points = np.array(grown).reshape(-1, 4)
            points = _rescaled(points, rho, scale_of)
        for _ in range(steps):
            if not len(points):
                break
            over = np.sign(kernel_sum(points, rho.shape) - rho)
            noise = rng.normal(size=(len(points), 2))
            moved = points.copy()
            for i, (x, y, _, scale) in enumerate(points):
                r = KERNEL_REACH * scale
                x0, x1 = max(0, math.floor(x - r)), min(rho.shape[1] - 1, math.ceil(x + r))
                y0, y1 = max(0, math.floor(y - r)), min(rho.shape[0] - 1, math.ceil(y + r))
                if x0 > x1 or y0 > y1:
                    continue
                gx, gy = np.arange(x0, x1 + 1) - x, np.arange(y0, y1 + 1) - y
                kern = np.exp(-math.pi * (gy[:, None] ** 2 + gx[None, :] ** 2) / scale**2) * over[y0 : y1 + 1, x0 : x1 + 1]
                slope = 2 * math.pi / scale**3 * np.array([(kern * gx[None, :]).sum(), (kern * gy[:, None]).sum()])
                moved[i, :2] += -step * scale / 2 * slope + math.sqrt(temperature * step * scale) * noise[i]
            kept = _rescaled(moved, rho, scale_of, points)
            points = kept
    return points[:, :2]


def _rescaled(points: np.ndarray, rho: np.ndarray, scale_of: Callable, before: np.ndarray | None = None) -> np.ndarray:
    """Scales from the density under each point; points without any go, or back to where they were."""
    if not len(points):
        return points
    x, y = np.floor(points[:, 0]).astype(int), np.floor(points[:, 1]).astype(int)
    inside = (x >= 0) & (y >= 0) & (x < rho.shape[1]) & (y < rho.shape[0])
    r = np.where(inside, rho[np.clip(y, 0, rho.shape[0] - 1), np.clip(x, 0, rho.shape[1] - 1)], 0.0)
    out = points.copy()
    out[:, 3] = np.where(r > 0, scale_of(np.maximum(r, 1e-12), points[:, 2]), points[:, 3])
    if before is not None:
        out[r <= 0] = before[r <= 0]
        return out
    return out[r > 0]


def per_frame(density: DataFrame, width: int, height: int, sample: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = ()) -> DataFrame:
    """keys, x, y from a sampler of one whole frame."""
    ship(density.sparkSession)
    k = list(keys)
    schema = ", ".join([*(f"{c} {dict(density.dtypes)[c]}" for c in k), "x double, y double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = sample(_dense(pdf, width, height))
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(got) for c in keys} | {"x": got[:, 0], "y": got[:, 1]})

    if not k:
        density, k = density.withColumn("_g", F.lit(0)), ["_g"]
    return density.groupBy(*k).applyInPandas(run, schema)


def kernel_field(kernels: DataFrame, pixels: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, px, py, v: sum of kernels (keys, x, y, weight, scale) over the pixels of their windows."""
    r = KERNEL_REACH * F.col("scale")
    at = kernels.withColumns({"_x0": F.greatest(F.floor(F.col("x") - r), F.lit(0)), "_x1": F.least(F.ceil(F.col("x") + r), F.lit(width - 1)), "_y0": F.greatest(F.floor(F.col("y") - r), F.lit(0)), "_y1": F.least(F.ceil(F.col("y") + r), F.lit(height - 1))}).where("_x0 <= _x1 AND _y0 <= _y1")
    spread = at.withColumn("py", F.explode(F.sequence("_y0", "_y1"))).withColumn("px", F.explode(F.sequence("_x0", "_x1")))
    s2 = F.col("scale") * F.col("scale")
    d2 = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    total = spread.groupBy(*keys, F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py")).agg(F.sum(F.col("weight") / s2 * F.exp(-math.pi * (d2 / s2))).alias("_v"))
    return pixels.select(*keys, "px", "py").join(total, [*keys, "px", "py"], "left").select(*keys, "px", "py", F.coalesce("_v", F.lit(0.0)).alias("v"))


def kernel_energy(kernels: DataFrame, density: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, energy: sum of the absolute differences of kernel field and density."""
    both = density.join(kernel_field(kernels, density, width, height, keys).withColumnRenamed("v", "_a"), [*keys, "px", "py"])
    return both.groupBy(*keys).agg(F.sum(F.abs(F.col("_a") - F.col("v"))).alias("energy"))


def delta_sample(density: DataFrame, old: DataFrame, width: int, height: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, x, y, origin: old points (keys, seed_id, x, y) carried over to a new density. Where they are too dense, sampled
    places each take out the nearest old point in turn; where too thin, sampled points join with origin -1."""
    have = point_density(old, density, width, height, keys).withColumnRenamed("v", "_h")
    delta = density.join(have, [*keys, "px", "py"]).select(*keys, "px", "py", (F.col("v") - F.col("_h")).alias("d"))
    more = quadtree_sample(delta.select(*keys, "px", "py", F.greatest("d", F.lit(0.0)).alias("v")), width, height, seed, keys)
    less = quadtree_sample(delta.select(*keys, "px", "py", F.greatest(-F.col("d"), F.lit(0.0)).alias("v")), width, height, seed + 1, keys)
    ship(density.sparkSession)
    k = list(keys)

    def thin_out(_key, points: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("seed_id").reset_index(drop=True)
        xy, alive = points[["x", "y"]].to_numpy(), np.ones(len(points), bool)
        for x, y in gone.sort_values(["y", "x"])[["x", "y"]].to_numpy():
            if not alive.any():
                break
            d2 = np.where(alive, ((xy - (x, y)) ** 2).sum(1), np.inf)
            alive[int(d2.argmin())] = False
        left = points[alive]
        return left[[*keys, "x", "y"]].assign(origin=left["seed_id"].astype("int64"))

    a, b = old.select(*keys, "seed_id", "x", "y"), less
    if not k:
        a, b, k = a.withColumn("_g", F.lit(0)), b.withColumn("_g", F.lit(0)), ["_g"]
    schema = ", ".join([*(f"{c} {dict(density.dtypes)[c]}" for c in keys), "x double, y double, origin long"])
    kept = a.groupBy(*k).cogroup(b.groupBy(*k)).applyInPandas(thin_out, schema)
    return kept.unionByName(more.withColumn("origin", F.lit(-1).cast("long")))


def sample(mode: str, density: DataFrame, width: int, height: int, seed: int = 42, keys: Sequence[str] = (), old: DataFrame | None = None) -> DataFrame:
    """Samplers by name: rnd, rect, spds, spds_old, fs, fs_expo, fs_layers, fattal, dds."""
    if mode == "rnd":
        return bernoulli(density, seed, keys)
    if mode == "rect":
        return rect_grid(density, width, height, keys)
    if mode == "spds":
        return quadtree_sample(density, width, height, seed, keys, 5 if (width, height) == (640, 480) else 2)
    if mode == "spds_old":
        return quadtree_sample_old(density, width, height, seed, keys)
    if mode == "dds":
        if old is None:
            raise ValueError("dds needs the old points")
        return delta_sample(density, old, width, height, seed, keys)
    one = {"fs": error_diffusion, "fs_expo": error_diffusion_far, "fs_layers": lambda d: error_diffusion_layers(d, seed), "fattal": lambda d: blue_noise(d, seed)}
    if mode not in one:
        raise ValueError(f"no sampler named {mode}")
    return per_frame(density, width, height, one[mode], keys)
