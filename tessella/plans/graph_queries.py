"""Region graphs of the lattice's 8 x 8 blocks (48 vertices) and of one assignment step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import metric as D
from tessella.operators import graph as G
from tessella.plans.cluster_queries import ONE_SQL, labelled, one_step
from tessella.plans.fixtures import H, W, lattice, over_lattice
from tessella.scratch import cut
from tessella.plans.registry import query, r6, rounded


def blocks(spark, sf) -> DataFrame:
    px = lattice(spark, sf)
    return px.withColumn("label", (F.floor(F.col("px") / 8) + 8 * F.floor(F.col("py") / 8)).cast("int"))


def vertices(spark) -> DataFrame:
    return spark.range(48).select(F.col("id").cast("int").alias("vertex"))


def region_graph(spark, sf) -> DataFrame:
    """src < dst, nb, weight: blocks that touch to the right or below, with the squared distance of mean colours."""
    b = blocks(spark, sf).select("px", "py", "label")
    right, below = b.select((F.col("px") - 1).alias("px"), "py", F.col("label").alias("o")), b.select("px", (F.col("py") - 1).alias("py"), F.col("label").alias("o"))
    pair = b.join(right.unionByName(below), ["px", "py"]).where("label != o")
    edge = pair.groupBy(F.least("label", "o").alias("src"), F.greatest("label", "o").alias("dst")).agg(F.count(F.lit(1)).alias("nb"))
    mean = blocks(spark, sf).groupBy("label").agg(*(F.sum(c).alias(c) for c in "rgb"), F.count(F.lit(1)).alias("n"))
    end = lambda s: mean.select(F.col("label").alias(s), *((F.col(c) / (F.col("n") * 255.0)).alias(f"{s}_{c}") for c in "rgb"))
    both = edge.join(end("src"), "src").join(end("dst"), "dst")
    w = sum((F.col(f"src_{c}") - F.col(f"dst_{c}")) * (F.col(f"src_{c}") - F.col(f"dst_{c}")) for c in "rgb")
    return both.select("src", "dst", "nb", F.round(w, 6).alias("weight"))


GRAPH_SQL = """bk AS (SELECT *, CAST(px // 8 + 8*(py // 8) AS INT) AS label FROM pix),
mn AS (SELECT label, sum(r)/(count(*)*255.0e0) AS r, sum(g)/(count(*)*255.0e0) AS g, sum(b)/(count(*)*255.0e0) AS b FROM bk GROUP BY label),
pq AS (SELECT least(a.label, o.label) AS src, greatest(a.label, o.label) AS dst, count(*) AS nb FROM bk a JOIN bk o ON ((o.px = a.px+1 AND o.py = a.py) OR (o.px = a.px AND o.py = a.py+1)) AND a.label <> o.label GROUP BY 1, 2),
gg AS (SELECT src, dst, nb, round((s.r-d.r)*(s.r-d.r)+(s.g-d.g)*(s.g-d.g)+(s.b-d.b)*(s.b-d.b), 6) AS weight FROM pq JOIN mn s ON s.label = src JOIN mn d ON d.label = dst),
vx AS (SELECT CAST(i AS INT) AS vertex FROM range(48) t(i))"""
THRESHOLD = 0.004

BORDER_SQL = f"""{ONE_SQL},
be AS (SELECT a.px, a.py, a.label, o.label AS other FROM lab a JOIN lab o ON abs(a.px-o.px)+abs(a.py-o.py) = 1 WHERE a.label >= 0 AND o.label >= 0 AND a.label <> o.label AND a.px BETWEEN 1 AND {W - 2} AND a.py BETWEEN 1 AND {H - 2}),
cb AS (SELECT least(label, other) AS src, greatest(label, other) AS dst, count(*) AS num_border_pixels FROM be GROUP BY 1, 2),
cc AS (SELECT label, {", ".join(f"round(avg({c}), 9) AS {c}" for c in ("px", "py", "c0", "c1", "c2", "x", "y", "z"))} FROM lab JOIN pts USING (px, py) WHERE label >= 0 GROUP BY label)"""


def entries(spark, sf) -> DataFrame:
    return G.border_entries(one_step(spark, sf)[1], W, H)


def centres(spark, sf) -> DataFrame:
    return labelled(spark, sf).groupBy("label").agg(*(F.round(F.avg(c), 9).alias(c) for c in ("px", "py", "c0", "c1", "c2", "x", "y", "z")))


@query("N01", over_lattice("SELECT src, dst, num_border_pixels FROM cb JOIN cc a ON a.label = src JOIN cc b ON b.label = dst WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 1 AND (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py) <= 20*20 AND num_border_pixels >= 2", BORDER_SQL))
def n01(spark, sf):
    return G.neighbourhood(entries(spark, sf), centres(spark, sf), most_distance=1.0, most_pixels=20.0, least=2)


@query("N02", over_lattice("SELECT px, py, label, other, count(*) AS n FROM be GROUP BY ALL", BORDER_SQL))
def n02(spark, sf):
    return entries(spark, sf).groupBy("px", "py", "label", "other").agg(F.count(F.lit(1)).alias("n"))


@query("N03", over_lattice("SELECT src, dst, num_border_pixels, (SELECT 2*count(*) FROM be WHERE label = src AND other = dst) AS one_sided FROM cb", BORDER_SQL))
def n03(spark, sf):
    e = entries(spark, sf)
    one = G.common_border(e, one_sided_twice=True).withColumnRenamed("num_border_pixels", "one_sided")
    return G.common_border(e).join(one, ["src", "dst"], "left").na.fill({"one_sided": 0})


@query("N04", over_lattice("SELECT DISTINCT px, py FROM be", BORDER_SQL))
def n04(spark, sf):
    return G.border_pixels(entries(spark, sf))


_CD = "((a.c0-b.c0)*(a.c0-b.c0)+(a.c1-b.c1)*(a.c1-b.c1)+(a.c2-b.c2)*(a.c2-b.c2))"


@query("N05", over_lattice(f"SELECT src, dst, round({_CD}, 6) + 0.0e0 AS weight FROM cb JOIN cc a ON a.label = src JOIN cc b ON b.label = dst", BORDER_SQL))
def n05(spark, sf):
    return rounded(G.weigh(G.common_border(entries(spark, sf)), centres(spark, sf), D.color_distance))


@query("N06", over_lattice(f"SELECT src, dst, round(12*(num_border_pixels/CAST(s.l+d.l AS DOUBLE))*{_CD}, 6) + 0.0e0 AS weight FROM cb JOIN cc a ON a.label = src JOIN cc b ON b.label = dst JOIN ln s ON s.v = src JOIN ln d ON d.v = dst", f"{BORDER_SQL},\nln AS (SELECT v, sum(num_border_pixels) AS l FROM (SELECT src AS v, num_border_pixels FROM cb UNION ALL SELECT dst, num_border_pixels FROM cb) GROUP BY v)"))
def n06(spark, sf):
    return rounded(G.weigh(G.common_border(entries(spark, sf)), centres(spark, sf), D.color_distance, by_border=True))


@query("N07", over_lattice("SELECT src, dst, 1.0e0 AS weight, round(a.c0, 6) + 0.0e0 AS src_c0, round(b.c0, 6) + 0.0e0 AS dst_c0 FROM cb JOIN cc a ON a.label = src JOIN cc b ON b.label = dst", BORDER_SQL))
def n07(spark, sf):
    """Unit weights with the ends' payload attached."""
    c = centres(spark, sf)
    e = G.common_border(entries(spark, sf)).select("src", "dst", F.lit(1.0).alias("weight"))
    return rounded(e.join(c.select(F.col("label").alias("src"), F.col("c0").alias("src_c0")), "src").join(c.select(F.col("label").alias("dst"), F.col("c0").alias("dst_c0")), "dst").select("src", "dst", "weight", "src_c0", "dst_c0"))


@query("N08", over_lattice("SELECT src, dst, round(exp(-weight/0.01e0), 6) + 0.0e0 AS weight FROM gg", GRAPH_SQL))
def n08(spark, sf):
    return rounded(G.similarity(region_graph(spark, sf).select("src", "dst", "weight"), 0.01))


@query("N12", over_lattice(f"SELECT px, py, round(max(w), 6) + 0.0e0 AS value FROM be JOIN (SELECT src, dst, {_CD} AS w FROM cb JOIN cc a ON a.label = src JOIN cc b ON b.label = dst) q ON src = least(label, other) AND dst = greatest(label, other) GROUP BY 1, 2", BORDER_SQL))
def n12(spark, sf):
    e = entries(spark, sf)
    return rounded(G.paint_borders(e, G.weigh(G.common_border(e), centres(spark, sf), D.color_distance)))


@query("G01", over_lattice("SELECT px, py, CAST(dense_rank() OVER (ORDER BY (label*7) % 48) - 1 AS INT) AS label FROM bk", GRAPH_SQL))
def g01(spark, sf):
    return G.relabel(blocks(spark, sf).select("px", "py", ((F.col("label") * 7) % 48).alias("label"))).select("px", "py", "label")


def _component_sql(op: str) -> str:
    both = f"(SELECT src AS a, dst AS b FROM gg WHERE weight {op} {THRESHOLD}e0 UNION ALL SELECT dst, src FROM gg WHERE weight {op} {THRESHOLD}e0)"
    head = over_lattice("", GRAPH_SQL).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return f"{head},\nbo AS {both},\nreach AS (SELECT vertex, vertex AS r FROM vx UNION SELECT bo.b, r FROM reach JOIN bo ON a = vertex)\nSELECT vertex, CAST(dense_rank() OVER (ORDER BY r) - 1 AS INT) AS label FROM (SELECT vertex, min(r) AS r FROM reach GROUP BY vertex)"


@query("G02", _component_sql("<="))
def g02(spark, sf):
    return G.threshold_labels(vertices(spark), region_graph(spark, sf), THRESHOLD).select("vertex", "label")


@query("G03", _component_sql("<"))
def g03(spark, sf):
    return G.threshold_labels(vertices(spark), region_graph(spark, sf), THRESHOLD, strict=True).select("vertex", "label")


def _both_sql() -> str:
    """Components below the threshold and up to it."""
    rows = []
    for k, op in enumerate(("<", "<=")):
        both = f"(SELECT src AS a, dst AS b FROM gg WHERE weight {op} {THRESHOLD}e0 UNION ALL SELECT dst, src FROM gg WHERE weight {op} {THRESHOLD}e0)"
        rows.append(f"bo{k} AS {both},\nre{k} AS (SELECT vertex, vertex AS r FROM vx UNION SELECT b, r FROM re{k} JOIN bo{k} ON a = vertex)")
    head = over_lattice("", GRAPH_SQL).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    label = lambda k, n: f"SELECT '{n}' AS strategy, vertex, CAST(dense_rank() OVER (ORDER BY r) - 1 AS INT) AS label FROM (SELECT vertex, min(r) AS r FROM re{k} GROUP BY vertex)"
    return f"{head},\n{rows[0]},\n{rows[1]}\n{label(0, 'ucm')}\nUNION ALL {label(1, 'threshold')}"


@query("G04", _both_sql())
def g04(spark, sf):
    """Segments by the name of a strategy."""
    e = cut(region_graph(spark, sf), "graph")
    got = [G.segment_labels(n, vertices(spark), e, THRESHOLD).select(F.lit(n).alias("strategy"), "vertex", "label") for n in ("ucm", "threshold")]
    return got[0].unionByName(got[1])


@query("U07", _component_sql("<="))
def u07(spark, sf):
    """Weights and labels under names of the caller's."""
    e = region_graph(spark, sf).withColumnRenamed("weight", "cost")
    return G.threshold_labels(vertices(spark), e, THRESHOLD, weight="cost", label="segment").select("vertex", F.col("segment").alias("label"))


def given_labels(spark) -> DataFrame:
    """Every tenth vertex has a label, the others none."""
    return vertices(spark).withColumn("given", F.when(F.col("vertex") % 10 == 0, (F.col("vertex") / 10).cast("int")).otherwise(-1))


@query("G05")
def g05(spark, sf):
    """Supervised merging along ascending weights."""

    def run(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("vertex")
        return pd.DataFrame({"vertex": v["vertex"], "label": G.supervised_labels(e, v["given"].to_numpy(), 0.02)})

    return G.per_graph(region_graph(spark, sf), given_labels(spark), (), run, "vertex int, label long")


@query("G06")
def g06(spark, sf):
    """Supervised merging with three thresholds."""

    def run(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("vertex")
        segment, label = G.dynamic_supervised_labels(e, v["given"].to_numpy(), 0.002, 0.02, 0.05)
        return pd.DataFrame({"vertex": v["vertex"], "segment": segment, "label": label})

    return G.per_graph(region_graph(spark, sf), given_labels(spark), (), run, "vertex int, segment long, label long")


def similar(spark, sf) -> DataFrame:
    return G.similarity(region_graph(spark, sf).select("src", "dst", "weight"), 0.01).withColumn("weight", F.round("weight", 9))


SIM_SQL = f"{GRAPH_SQL},\nsm AS (SELECT src, dst, round(exp(-weight/0.01e0), 9) AS weight FROM gg),\nen AS (SELECT src AS i, dst AS j, weight AS w FROM sm UNION ALL SELECT dst, src, weight FROM sm),\ndg AS (SELECT vertex, coalesce(sum(w), 0) AS degree FROM vx LEFT JOIN en ON i = vertex GROUP BY vertex),\nlp AS (SELECT i, j, -w AS w FROM en WHERE i IN (SELECT vertex FROM dg WHERE degree >= 0.001) AND j IN (SELECT vertex FROM dg WHERE degree >= 0.001) UNION ALL SELECT vertex, vertex, CASE WHEN degree < 0.001 THEN 1.0e0 ELSE degree END FROM dg UNION ALL SELECT a.vertex, b.vertex, -1.0e0/47 FROM dg a, dg b WHERE a.vertex <> b.vertex AND (a.degree < 0.001 OR b.degree < 0.001)),\nnl AS (SELECT lp.i, lp.j, lp.w/sqrt(a.w*b.w) AS w FROM lp JOIN lp a ON a.i = lp.i AND a.j = lp.i JOIN lp b ON b.i = lp.j AND b.j = lp.j)"


@query("U05", over_lattice("SELECT k, round(a.w/a.w, 6) + 0.0e0 AS eigenvalue, a.i AS vertex, round(CASE WHEN a.i = k THEN 1/sqrt(a.w) ELSE 0 END, 6) + 0.0e0 AS value FROM lp a, range(4) t(k) WHERE a.i = a.j", SIM_SQL))
def u05(spark, sf):
    """A solver of the caller's: here one that takes the matrix for diagonal."""
    return rounded(G.spectrum(G.laplacian(vertices(spark), similar(spark, sf)), 4, solver=lambda m, k: (np.diag(m)[:k], np.eye(len(m))[:, :k])))


@query("G07")
def g07(spark, sf):
    """New weights from the 24 smallest eigenvectors of the similarity graph."""
    return rounded(G.spectral_segments(vertices(spark), similar(spark, sf)), 4)


@query("G08", over_lattice("SELECT i, j, round(w, 9) + 0.0e0 AS w FROM lp", SIM_SQL))
def g08(spark, sf):
    return G.laplacian(vertices(spark), similar(spark, sf)).select("i", "j", (F.round("w", 9) + F.lit(0.0)).alias("w"))  # sums of weights of nine places, so no sum lies between two


@query("G09", over_lattice("SELECT i, j, round(w, 8) + 0.0e0 AS w FROM nl", SIM_SQL))
def g09(spark, sf):
    return rounded(G.normalised_laplacian(G.laplacian(vertices(spark), similar(spark, sf))), 8)


@query("G10", over_lattice("SELECT i, j, round(w, 8) + 0.0e0 AS w FROM nl WHERE j <= i", SIM_SQL))
def g10(spark, sf):
    """The lower triangle, as sparse solvers take it."""
    return rounded(G.lower_triangle(G.normalised_laplacian(G.laplacian(vertices(spark), similar(spark, sf)))), 8)


@query("G11", over_lattice("SELECT src, dst, round(sum(abs(ua-ub)/sqrt(ew)), 6) + 0.0e0 AS weight FROM q GROUP BY 1, 2", f"{GRAPH_SQL},\nei AS (SELECT k, 0.1e0*k AS ew, vertex, CAST((vertex*(k+3)) % 17 AS DOUBLE) AS val FROM vx, range(5) t(k)),\nsc AS (SELECT k, ew, vertex, (val-min(val) OVER (PARTITION BY k))/(max(val) OVER (PARTITION BY k)-min(val) OVER (PARTITION BY k)) AS u FROM ei WHERE ew > 1e-4),\nq AS (SELECT src, dst, a.ew, a.u AS ua, b.u AS ub FROM gg JOIN sc a ON a.vertex = src JOIN sc b ON b.vertex = dst AND a.k = b.k)"))
def g11(spark, sf):
    """Edge weights from given eigenpairs (made up here, so that SQL can say the same)."""
    k = spark.range(5).select(F.col("id").alias("k"))
    eigen = vertices(spark).join(F.broadcast(k), F.lit(True)).select("k", (F.col("k") * 0.1).alias("eigenvalue"), "vertex", ((F.col("vertex") * (F.col("k") + 3)) % 17).cast("double").alias("value"))
    return rounded(G.eigen_weights(region_graph(spark, sf), eigen))


@query("G12")
def g12(spark, sf):
    """The ten smallest eigenvalues by the dense solver."""
    s = G.spectrum(G.laplacian(vertices(spark), similar(spark, sf)), 10)
    return s.groupBy("k").agg(r6(F.max("eigenvalue")).alias("eigenvalue"))


def _mcl_sql(n: int) -> str:
    out = ["w0 AS (SELECT i, j, w FROM en)"]
    for k in range(n):
        out.append(f"m{k} AS (SELECT a.i, b.j, pow(sum(a.w*b.w), 1.5e0) AS w FROM w{k} a JOIN w{k} b ON a.j = b.i GROUP BY 1, 2)")
        out.append(f"w{k + 1} AS (SELECT i, j, CASE WHEN sum(w) OVER (PARTITION BY j) > 0 THEN w/sum(w) OVER (PARTITION BY j) ELSE w END AS w FROM m{k})")
    return over_lattice(f"SELECT i, j, round(w, 6) + 0.0e0 AS w FROM w{n} WHERE w > 0.001", SIM_SQL + ",\n" + ",\n".join(out))


@query("G13", _mcl_sql(2))
def g13(spark, sf):
    return rounded(G.markov_clustering(similar(spark, sf), 1.5, 2))


@query("G14", over_lattice("SELECT a.px, a.py, (count(b.px) FILTER (WHERE a.label <> b.label) > 0) AS edge FROM bk a JOIN bk b ON abs(a.px-b.px) <= 1 AND abs(a.py-b.py) <= 1 GROUP BY 1, 2", GRAPH_SQL))
def g14(spark, sf):
    """The boundary image of a labelling."""
    from tessella.operators.evaluate import label_edges

    return label_edges(blocks(spark, sf).select("px", "py", "label"), size=0)


@query("G15", over_lattice("SELECT CAST(label % 6 AS INT) AS segment, CAST(floor(avg(c0)*255) AS INT) AS r, CAST(floor(avg(c1)*255) AS INT) AS g, CAST(floor(avg(c2)*255) AS INT) AS b FROM cc GROUP BY 1", BORDER_SQL))
def g15(spark, sf):
    c = centres(spark, sf)
    return G.segment_colors(c, c.select("label", (F.col("label") % 6).cast("int").alias("segment")))


@query("G16", over_lattice("SELECT px, py, CAST(label % 6 AS INT) AS segment FROM lab WHERE label >= 0", ONE_SQL))
def g16(spark, sf):
    """Segments of centres on pixels."""
    labels = one_step(spark, sf)[1].where("label >= 0")
    segments = labels.select("label").distinct().select("label", (F.col("label") % 6).cast("int").alias("segment"))
    return labels.join(segments, "label").select("px", "py", "segment")
