"""Region graphs: borders of label images, weighted edges (keys, src, dst, weight), labelling and spectra."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.mathx import dot_diff
from tessella.functions.metric import Metric
from tessella.operators.stencil import NEAR4, shifted
from tessella.scratch import cut
from tessella.shipping import ship

MOST_VERTICES = 3000  # of one graph whose spectrum is computed


def border_entries(labels: DataFrame, width: int, height: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, px, py, label, other: inner pixels once for every neighbour of another label; unassigned pixels don't count."""
    n = shifted(labels, "label", NEAR4, keys, None).where(F.col("px").between(1, width - 2) & F.col("py").between(1, height - 2) & (F.col("label") >= 0))
    each = n.select(*keys, "px", "py", "label", F.explode(F.array(*(F.col(f"label_{i}") for i in range(4)))).alias("other"))
    return each.where((F.col("other") >= 0) & (F.col("other") != F.col("label")))


def common_border(entries: DataFrame, keys: Sequence[str] = (), one_sided_twice: bool = False) -> DataFrame:
    """keys, src < dst, num_border_pixels: entries of both sides; with one_sided_twice those of the smaller label, doubled."""
    a, b = F.least("label", "other").alias("src"), F.greatest("label", "other").alias("dst")
    n = F.count_if(F.col("label") < F.col("other")) * 2 if one_sided_twice else F.count(F.lit(1))
    return entries.groupBy(*keys, a, b).agg(n.cast("long").alias("num_border_pixels")).where("num_border_pixels > 0")


def border_pixels(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return entries.select(*keys, "px", "py").distinct()


def neighbourhood(entries: DataFrame, centres: DataFrame, keys: Sequence[str] = (), most_distance: float | None = None, most_pixels: float | None = None, least: int = 1, least_share: float = 0.0) -> DataFrame:
    """Edges of touching segments whose centres (keys, label, px, py, x, y, z) are near enough in space or in pixels and whose
    common border is long enough, also relative to the shorter of the two. Starts from borders, never from all pairs."""
    edge = common_border(entries, keys)
    names = ("px", "py", "x", "y", "z")
    end = lambda side: centres.select(*keys, F.col("label").alias(side), *(F.col(n).alias(f"_{side}{n}") for n in names))
    edge = edge.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"])
    both = lambda cols: dot_diff([F.col(f"_src{c}") for c in cols], [F.col(f"_dst{c}") for c in cols])
    if most_distance is not None:
        edge = edge.where(both(("x", "y", "z")) <= most_distance * most_distance)
    if most_pixels is not None:
        edge = edge.where(both(("px", "py")) <= most_pixels * most_pixels)
    total = entries.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_len"))
    edge = edge.join(total.select(*keys, F.col("label").alias("src"), F.col("_len").alias("_ls")), [*keys, "src"], "left").join(total.select(*keys, F.col("label").alias("dst"), F.col("_len").alias("_ld")), [*keys, "dst"], "left")
    share = F.col("num_border_pixels") / F.least(F.coalesce("_ls", F.lit(1)), F.coalesce("_ld", F.lit(1)))
    return edge.where((F.col("num_border_pixels") >= least) & (share >= least_share)).select(*keys, "src", "dst", "num_border_pixels")


def weigh(edges: DataFrame, centres: DataFrame, metric: Metric, keys: Sequence[str] = (), by_border: bool = False) -> DataFrame:
    """keys, src, dst, weight from a metric of the centres; by_border multiplies 12 times the border's share of both sides'."""
    names = [c for c in centres.columns if c not in (*keys, "label")]
    end = lambda side: centres.select(*keys, F.col("label").alias(side), *(F.col(n).alias(f"_{side}_{n}") for n in names))
    both = edges.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"])
    w = metric({n: F.col(f"_src_{n}") for n in names}, {n: F.col(f"_dst_{n}") for n in names})
    if by_border:
        ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("v"), "num_border_pixels").groupBy(*keys, "v").agg(F.sum("num_border_pixels").alias("_l"))
        both = both.join(ends.select(*keys, F.col("v").alias("src"), F.col("_l").alias("_a")), [*keys, "src"]).join(ends.select(*keys, F.col("v").alias("dst"), F.col("_l").alias("_b")), [*keys, "dst"])
        w = 12 * (F.col("num_border_pixels") / (F.col("_a") + F.col("_b"))) * w
    return both.select(*keys, "src", "dst", w.alias("weight"))


def similarity(edges: DataFrame, sigma: float = 1.0) -> DataFrame:
    return edges.withColumn("weight", F.exp(-F.col("weight") / sigma))


def relabel(labels: DataFrame, keys: Sequence[str] = (), column: str = "label") -> DataFrame:
    """Consecutive numbers from 0 in the order of the old labels: ranked on the distinct labels, then joined."""
    w = Window.partitionBy(*keys).orderBy(column)
    number = labels.select(*keys, column).distinct().withColumn("_new", (F.row_number().over(w) - 1).cast("int"))
    return labels.join(number, [*keys, column]).drop(column).withColumnRenamed("_new", column)


def connected(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = (), most_rounds: int = 60) -> DataFrame:
    """keys, vertex, root (the component's smallest vertex): labels fall to the least of the neighbours' and then jump to their
    own label's label, until nothing changes."""
    both = edges.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(*keys, F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    both = cut(both, "edges")
    now = cut(vertices.select(*keys, "vertex", F.col("vertex").alias("root")).distinct(), "roots")
    for _ in range(most_rounds):
        near = both.join(now.withColumnsRenamed({"vertex": "b", "root": "_r"}), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("_r").alias("_n"))
        low = now.join(near.withColumnRenamed("a", "vertex"), [*keys, "vertex"], "left").withColumn("_new", F.least("root", F.coalesce("_n", "root")))
        low = cut(low.select(*keys, "vertex", "root", "_new"), "roots")
        jump = low.select(*keys, F.col("vertex").alias("_new"), F.col("_new").alias("_j"))
        nxt = cut(low.join(jump, [*keys, "_new"], "left").select(*keys, "vertex", F.least("_new", F.coalesce("_j", "_new")).alias("root"), (F.least("_new", F.coalesce("_j", "_new")) != F.col("root")).alias("_c")), "roots")
        changed = nxt.where("_c").limit(1).count()
        now = nxt.drop("_c")
        if not changed:
            return now
    raise RuntimeError("components did not settle")


def threshold_labels(vertices: DataFrame, edges: DataFrame, threshold: float, keys: Sequence[str] = (), strict: bool = False, weight: str = "weight", label: str = "label") -> DataFrame:
    """Components over edges up to the threshold (below it if strict), numbered by their smallest vertices. weight and label
    name the columns that are read and made."""
    keep = F.col(weight) < threshold if strict else F.col(weight) <= threshold
    roots = connected(vertices, edges.where(keep), keys)
    return relabel(roots.withColumnRenamed("root", "label"), keys).withColumnRenamed("label", label)


def segment_labels(strategy: str, vertices: DataFrame, edges: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Segments by strategy: threshold (edges up to it join) or ucm (edges below it)."""
    if strategy not in ("threshold", "ucm"):
        raise ValueError(f"no strategy named {strategy}")
    return threshold_labels(vertices, edges, threshold, keys, strict=strategy == "ucm")


def supervised_labels(edges: pd.DataFrame, labels: np.ndarray, threshold: float) -> np.ndarray:
    """Merges along ascending weights; labels from 0 on are given, negative ones free; two given labels never merge and the
    smaller label stays. Groups are lists that the shorter joins."""
    given = int(labels.max(initial=-1))
    out = labels.copy()
    free = np.flatnonzero(out < 0)
    out[free] = given + 1 + np.arange(len(free))
    groups = {k: list(np.flatnonzero(out == k)) for k in np.unique(out)}
    for a, b, _ in edges[edges.weight < threshold].sort_values(["weight", "src", "dst"], kind="stable")[["src", "dst", "weight"]].itertuples(index=False):
        low, high = sorted((int(out[int(a)]), int(out[int(b)])))
        if low == high or high <= given:
            continue
        out[groups[high]] = low
        groups[low] += groups.pop(high)
    return out


def dynamic_supervised_labels(edges: pd.DataFrame, labels: np.ndarray, always: float, unless_both: float, if_same: float) -> tuple[np.ndarray, np.ndarray]:
    """Three thresholds: merge below `always`; below `unless_both` unless both sides are given; below `if_same` keep links
    within one label. Each component then takes the label most of its given vertices have (the larger on ties); components
    without any get fresh ones. Returns segment and label per vertex."""
    n = len(labels)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    label = labels.copy()
    for a, b, w in edges.sort_values(["weight", "src", "dst"], kind="stable")[["src", "dst", "weight"]].itertuples(index=False):
        ra, rb = find(int(a)), find(int(b))
        la, lb = label[ra], label[rb]
        join = w < always or (w < unless_both and not (la >= 0 and lb >= 0)) or (w < if_same and la >= 0 and la == lb)
        if ra != rb and join:
            low, high = min(ra, rb), max(ra, rb)
            root[high] = low
            label[low] = max(la, lb) if min(la, lb) < 0 else min(la, lb)
    segment = np.array([find(i) for i in range(n)])
    out, fresh = np.empty(n, np.int64), int(labels.max(initial=-1))
    for s in np.unique(segment):
        mine = labels[segment == s]
        mine = mine[mine >= 0]
        if len(mine):
            values, count = np.unique(mine, return_counts=True)
            out[segment == s] = values[count == count.max()].max()
        else:
            fresh += 1
            out[segment == s] = fresh
    return segment, out


def per_graph(edges: DataFrame, vertices: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One graph at a time in pandas (keys name graphs; order-dependent and spectral methods need one whole)."""
    ship(edges.sparkSession)
    k = list(keys)

    def run(_key, e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return f(e, v)

    if not k:
        edges, vertices, k = edges.withColumn("_g", F.lit(0)), vertices.withColumn("_g", F.lit(0)), ["_g"]
    return edges.groupBy(*k).cogroup(vertices.groupBy(*k)).applyInPandas(run, schema)


def degrees(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, vertex, degree over edges whose weight is a number of 0 or more."""
    ok = edges.where(~F.isnan("weight") & (F.col("weight") >= 0))
    ends = ok.select(*keys, F.explode(F.array("src", "dst")).alias("vertex"), "weight").groupBy(*keys, "vertex").agg(F.sum("weight").alias("_d"))
    return vertices.join(ends, [*keys, "vertex"], "left").select(*keys, "vertex", F.coalesce("_d", F.lit(0.0)).alias("degree"))


def laplacian(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = (), isolated_below: float = 0.001) -> DataFrame:
    """keys, i, j, w of D - W (both triangles and the diagonal) and the degree of i. A vertex of smaller degree counts as 1 and is tied to all
    others of its graph by 1 / (n - 1)."""
    deg = degrees(vertices, edges, keys).withColumn("lone", F.col("degree") < isolated_below)
    ok = edges.where(~F.isnan("weight") & (F.col("weight") >= 0)).select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("w"))
    near = ok.unionByName(ok.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    n = deg.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lone = deg.where("lone").select(*keys, F.col("vertex").alias("_v"))
    every = deg.select(*keys, F.col("vertex").alias("_o"))
    tied = (lone.join(every, list(keys)) if keys else lone.join(every, F.lit(True))).where("_v != _o")
    tied = (tied.join(n, list(keys)) if keys else tied.crossJoin(F.broadcast(n))).withColumn("w", 1 / (F.col("_n") - 1))
    ties = tied.select(*keys, F.col("_v").alias("i"), F.col("_o").alias("j"), "w").unionByName(tied.select(*keys, F.col("_o").alias("i"), F.col("_v").alias("j"), "w")).distinct()
    off = near.join(ties.select(*keys, "i", "j"), [*keys, "i", "j"], "left_anti").unionByName(ties).select(*keys, "i", "j", (-F.col("w")).alias("w"))
    degree = F.when(F.col("lone"), 1.0).otherwise(F.col("degree"))
    diagonal = deg.select(*keys, F.col("vertex").alias("i"), F.col("vertex").alias("j"), degree.alias("w"))
    return off.unionByName(diagonal).join(deg.select(*keys, F.col("vertex").alias("i"), degree.alias("degree")), [*keys, "i"])


def normalised_laplacian(lap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """D^-1/2 L D^-1/2 in the same form."""
    other = lap.where("i = j").select(*keys, F.col("j"), F.col("degree").alias("_dj"))
    return lap.join(other, [*keys, "j"]).select(*keys, "i", "j", (F.col("w") / F.sqrt(F.col("degree") * F.col("_dj"))).alias("w"))


def lower_triangle(lap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The entries a sparse solver takes: j <= i, ordered by (j, i)."""
    return lap.where("j <= i").orderBy(*keys, "j", "i")


def eigen_weights(edges: DataFrame, eigen: DataFrame, keys: Sequence[str] = (), least: float = 1e-4) -> DataFrame:
    """keys, src, dst, weight: sum over components (keys, k, eigenvalue, vertex, value) above `least` of the difference of the
    vector, scaled to [0, 1], over the root of the eigenvalue."""
    used = eigen.where(F.col("eigenvalue") > least)
    span = used.groupBy(*keys, "k").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = used.join(span, [*keys, "k"]).select(*keys, "k", "eigenvalue", "vertex", ((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).alias("u"))
    a = scaled.select(*keys, "k", "eigenvalue", F.col("vertex").alias("src"), F.col("u").alias("_a"))
    b = scaled.select(*keys, "k", F.col("vertex").alias("dst"), F.col("u").alias("_b"))
    both = edges.select(*keys, "src", "dst").join(a, [*keys, "src"]).join(b, [*keys, "k", "dst"])
    return both.groupBy(*keys, "src", "dst").agg(F.sum(F.abs(F.col("_a") - F.col("_b")) / F.sqrt("eigenvalue")).alias("weight"))


def dense_solver(w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(w)
    return values[:k], vectors[:, :k]


def spectrum(lap: DataFrame, components: int, keys: Sequence[str] = (), solver: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]] = dense_solver) -> DataFrame:
    """keys, k, eigenvalue, vertex, value: the smallest components of L x = lambda D x, by the normalised matrix. One graph
    is one group; more than MOST_VERTICES vertices are refused."""
    ship(lap.sparkSession)
    k = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf["i"].unique())
        if len(ids) > MOST_VERTICES:
            raise ValueError(f"{len(ids)} vertices; split graphs of more than {MOST_VERTICES}")
        at = {v: n for n, v in enumerate(ids)}
        m, d = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
        m[i, j] = pdf["w"]
        d[i] = pdf["degree"]
        s = 1 / np.sqrt(d)
        values, vectors = solver(s[:, None] * m * s[None, :], components)
        vectors = s[:, None] * vectors
        n = len(values)
        out = {c: np.repeat(pdf[c].iloc[0], n * len(ids)) for c in k if c != "_g"}
        return pd.DataFrame(out | {"k": np.repeat(np.arange(n), len(ids)), "eigenvalue": np.repeat(values, len(ids)), "vertex": np.tile(ids, n), "value": vectors.T.ravel()})

    types = dict(lap.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in k), f"k long, eigenvalue double, vertex {types['i']}, value double"])
    if not k:
        lap, k = lap.withColumn("_g", F.lit(0)), ["_g"]
    return lap.groupBy(*k).applyInPandas(run, schema)


def spectral_segments(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = (), components: int = 24) -> DataFrame:
    """New edge weights from the graph's smallest eigenvectors."""
    return eigen_weights(edges, spectrum(laplacian(vertices, edges, keys), components, keys), keys)


def markov_clustering(edges: DataFrame, power: float, iterations: int, keys: Sequence[str] = (), least: float = 0.001) -> DataFrame:
    """keys, i, j, w: the matrix squared, raised and column-normalised again and again, entries above `least`. Products are
    joins on the inner index with partial sums."""
    w = edges.select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("w"))
    w = cut(w.unionByName(w.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "w")), "mcl")
    for _ in range(iterations):
        right = w.withColumnsRenamed({"i": "_k", "j": "_j", "w": "_w"})
        square = w.withColumnRenamed("j", "_k").join(right, [*keys, "_k"]).groupBy(*keys, "i", F.col("_j").alias("j")).agg(F.sum(F.col("w") * F.col("_w")).alias("w"))
        raised = square.withColumn("w", F.pow("w", F.lit(power)))
        total = raised.groupBy(*keys, "j").agg(F.sum("w").alias("_t"))
        w = cut(raised.join(total, [*keys, "j"]).select(*keys, "i", "j", F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).otherwise(F.col("w")).alias("w")), "mcl")
    return w.where(F.col("w") > least)


def segment_colors(clusters: DataFrame, segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, segment, r, g, b: plain means of the member centres' colours as bytes."""
    rows = clusters.join(segments, [*keys, "label"])
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(c))) * 255).cast("int")
    return rows.groupBy(*keys, "segment").agg(byte("c0").alias("r"), byte("c1").alias("g"), byte("c2").alias("b"))


def paint_borders(entries: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, px, py, value: each border pixel takes the largest weight among its edges."""
    rows = entries.withColumns({"src": F.least("label", "other"), "dst": F.greatest("label", "other")}).join(edges, [*keys, "src", "dst"])
    return rows.groupBy(*keys, "px", "py").agg(F.max("weight").alias("value"))


