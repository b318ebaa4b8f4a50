"""Evaluation of one assignment step on the lattice against a truth of 16 x 16 blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import cluster as C
from tessella.operators import evaluate as E
from tessella.params import SMALL_CAMERA as CAM
from tessella.plans.cluster_queries import EIGEN_SQL, ONE_SQL, labelled, one_step
from tessella.plans.fixtures import H, W, grid, lattice, over_lattice
from tessella.plans.point_queries import RADIUS
from tessella.plans.registry import query, rounded

BORDER, TOLERANCE = 2, 2


def truth(spark) -> DataFrame:
    return grid(spark).select("px", "py", (F.floor(F.col("px") / 16) + 4 * F.floor(F.col("py") / 16)).cast("int").alias("label"))


def _bnd(src: str) -> str:
    return f"""(SELECT px, py, CASE WHEN px BETWEEN 1 AND {W - 2} AND py BETWEEN 1 AND {H - 2} AND label = l AND label = r AND label = u AND label = d THEN 0 ELSE 1 END AS boundary
FROM (SELECT px, py, label, lag(label) OVER h AS l, lead(label) OVER h AS r, lag(label) OVER v AS u, lead(label) OVER v AS d FROM {src} WINDOW h AS (PARTITION BY py ORDER BY px), v AS (PARTITION BY px ORDER BY py)))"""


TRUTH_SQL = f"""{ONE_SQL},
tr AS (SELECT px, py, CAST(px // 16 + 4*(py // 16) AS INT) AS label FROM grid),
bt AS {_bnd('tr')}, bl AS {_bnd('lab')}"""


def _near(a: str, b: str, d: int) -> str:
    return f"(SELECT a.px, a.py, min(CASE WHEN b.boundary <> 0 THEN (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py) END) AS d2 FROM {a} a JOIN {b} b ON abs(a.px-b.px) <= {d} AND abs(a.py-b.py) <= {d} WHERE a.boundary <> 0 GROUP BY 1, 2)"


def _ins(d: int) -> str:
    return f"px BETWEEN {BORDER + d} AND {W - 1 - BORDER - d} AND py BETWEEN {BORDER + d} AND {H - 1 - BORDER - d}"


def _both(spark, sf):
    return E.boundary(truth(spark), W, H), E.boundary(one_step(spark, sf)[1], W, H)


def centres(spark, sf) -> DataFrame:
    """Plain means of the labelled pixels, unit normals."""
    rows = labelled(spark, sf).groupBy("label").agg(*(F.round(F.avg(c), 9).alias(c) for c in ("c0", "c1", "c2", "x", "y", "z", "nx", "ny", "nz")))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return rows.withColumns({c: F.col(c) / size for c in ("nx", "ny", "nz")})


CENTRES_SQL = f"""{ONE_SQL},
lr AS (SELECT lab.label, pts.* FROM lab JOIN pts USING (px, py) WHERE label >= 0),
c0_ AS (SELECT label, {", ".join(f"round(avg({c}), 9) AS {c}" for c in ("c0", "c1", "c2", "x", "y", "z", "nx", "ny", "nz"))} FROM lr GROUP BY label),
ct AS (SELECT label, c0, c1, c2, x, y, z, {", ".join(f"{c}/sqrt(nx*nx+ny*ny+nz*nz) AS {c}" for c in ("nx", "ny", "nz"))} FROM c0_)"""


@query("E01", over_lattice("SELECT round(sum(CASE WHEN n/CAST(sz AS DOUBLE) > 0.05 THEN sz ELSE 0 END)/CAST(sum(n) AS DOUBLE)-1, 6) AS error FROM sz", TRUTH_SQL + ",\nit AS (SELECT tr.label AS t, lab.label, count(*) AS n FROM tr JOIN lab USING (px, py) GROUP BY 1, 2),\nsz AS (SELECT t, label, n, CASE WHEN label = -1 THEN n ELSE sum(n) OVER (PARTITION BY label) END AS sz FROM it)"))
def e01(spark, sf):
    return rounded(E.under_segmentation(one_step(spark, sf)[1], truth(spark)))


@query("E02", over_lattice(f"SELECT round(count(d2)/CAST(count(*) AS DOUBLE), 6) AS recall FROM nr WHERE {_ins(TOLERANCE)}", f"{TRUTH_SQL},\nnr AS {_near('bt', 'bl', TOLERANCE)}"))
def e02(spark, sf):
    return rounded(E.recall(*_both(spark, sf), TOLERANCE, W, H, border=BORDER))


@query(
    "E03",
    over_lattice(
        "SELECT nr AS n_relevant, nrm AS n_relevant_met, nt AS n_retrieved, ntm AS n_retrieved_met, round(ntm/CAST(nt AS DOUBLE), 6) AS precision, round(nrm/CAST(nr AS DOUBLE), 6) AS recall, round(2*(ntm/CAST(nt AS DOUBLE))*(nrm/CAST(nr AS DOUBLE))/((ntm/CAST(nt AS DOUBLE))+(nrm/CAST(nr AS DOUBLE))), 6) AS f1 FROM "
        f"(SELECT count(*) AS nr, count(d2) AS nrm FROM {_near('bt', 'bl', 2)} WHERE {_ins(2)}), (SELECT count(*) AS nt, count(d2) AS ntm FROM {_near('bl', 'bt', 2)} WHERE {_ins(2)})",
        TRUTH_SQL,
    ),
)
def e03(spark, sf):
    return rounded(E.precision_recall(*_both(spark, sf), TOLERANCE, W, H, border=BORDER))


@query("E04", over_lattice(f"SELECT round(avg(coalesce(exp(d2*(-0.5e0/(1.5e0*1.5e0))), 0)), 6) AS recall FROM {_near('bt', 'bl', 4)} WHERE {_ins(4)}", TRUTH_SQL))
def e04(spark, sf):
    return rounded(E.recall_gaussian(*_both(spark, sf), 1.5, W, H, border=BORDER))


@query(
    "E05",
    over_lattice(
        f"SELECT g.px, g.py, CASE WHEN a.d2 IS NOT NULL THEN 'met' WHEN b.d2 IS NOT NULL THEN 'echo' WHEN a.px IS NOT NULL THEN 'missed' WHEN b.px IS NOT NULL THEN 'extra' ELSE 'none' END AS kind FROM (SELECT * FROM grid WHERE {_ins(1)}) g "
        f"LEFT JOIN {_near('bt', 'bl', 1)} a ON a.px = g.px AND a.py = g.py LEFT JOIN {_near('bl', 'bt', 1)} b ON b.px = g.px AND b.py = g.py",
        TRUTH_SQL,
    ),
)
def e05(spark, sf):
    return E.recall_classes(*_both(spark, sf), 1, W, H, border=BORDER)


_AREA = "((z/54.0e0)*(z/54.0e0)/abs(nz))"


@query("E06", over_lattice("SELECT round(count(*)/CAST(count(DISTINCT label) AS DOUBLE), 6) AS area FROM lab WHERE label >= 0", ONE_SQL))
def e06(spark, sf):
    return rounded(E.mean_area(one_step(spark, sf)[1]))


@query("E07", over_lattice(f"SELECT round(sum({_AREA})/count(DISTINCT label), 6) AS area FROM lr", CENTRES_SQL))
def e07(spark, sf):
    pts, labels, _ = one_step(spark, sf)
    return rounded(E.mean_area_3d(labels, pts, CAM))


@query("E08", over_lattice("SELECT px, py, boundary FROM bl", TRUTH_SQL))
def e08(spark, sf):
    return E.boundary(one_step(spark, sf)[1], W, H)


@query("E09", over_lattice("SELECT round(sum(4*pi()*a/(l*l)*a)/sum(a), 6) AS quotient FROM (SELECT label, CAST(count(*) FILTER (WHERE boundary = 0) AS DOUBLE) AS a, CAST(sum(boundary) AS DOUBLE) AS l FROM lab JOIN bl USING (px, py) WHERE label >= 0 GROUP BY label)", TRUTH_SQL))
def e09(spark, sf):
    return rounded(E.isoperimetric(one_step(spark, sf)[1], W, H))


@query("E10", over_lattice(f"SELECT round(sum(4*pi()*a/(l*l)*a)/sum(a), 6) AS quotient FROM (SELECT label, sum({_AREA}) AS a, sum(CASE WHEN boundary = 1 THEN (1.571e0-0.571e0*abs(nz))*(z/54.0e0) ELSE 0 END) AS l FROM lab JOIN bl USING (px, py) JOIN pts USING (px, py) WHERE label >= 0 GROUP BY label)", TRUTH_SQL))
def e10(spark, sf):
    pts, labels, _ = one_step(spark, sf)
    return rounded(E.isoperimetric_3d(labels, pts, CAM, W, H))


def _d(kind: str, a: str, b: str) -> str:
    names = E.KINDS[kind]
    if kind == "normal":
        return "(1-(" + "+".join(f"{a}{n}*{b}{n}" for n in names) + "))"
    return "sqrt(" + "+".join(f"({a}{n}-{b}{n})*({a}{n}-{b}{n})" for n in names) + ")"


def _overall() -> str:
    return "ov AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in ("c0", "c1", "c2", "x", "y", "z")) + ", " + ", ".join(f"avg({c})/sqrt(avg(nx)*avg(nx)+avg(ny)*avg(ny)+avg(nz)*avg(nz)) AS {c}" for c in ("nx", "ny", "nz")) + " FROM pts WHERE is_valid)"


@query("E11", over_lattice("SELECT " + ", ".join(f"round(sum({_d(k, 'ct.', 'ov.')}*{_d(k, 'ct.', 'ov.')})/sum({_d(k, 'lr.', 'ov.')}*{_d(k, 'lr.', 'ov.')}), 6) AS {k}" for k in E.KINDS) + " FROM lr JOIN ct USING (label), ov", f"{CENTRES_SQL},\n{_overall()}"))
def e11(spark, sf):
    pts, labels, _ = one_step(spark, sf)
    mid, out = centres(spark, sf), None
    for k in E.KINDS:
        one = E.explained_variation(labels, pts, mid, k).withColumnRenamed("explained", k)
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return rounded(out)


@query("E12", over_lattice("SELECT " + ", ".join(f"round(sqrt(avg({_d(k, 'lr.', 'ct.')}*{_d(k, 'lr.', 'ct.')})), 6) AS {k}" for k in ("color", "depth", "position")) + ", round(sqrt(avg(pow(degrees(acos(greatest(0, least(1, lr.nx*ct.nx+lr.ny*ct.ny+lr.nz*ct.nz)))), 2))), 4) AS normal FROM lr JOIN ct USING (label)", CENTRES_SQL))
def e12(spark, sf):
    pts, labels, _ = one_step(spark, sf)
    mid, out = centres(spark, sf), None
    for k in E.KINDS:
        one = rounded(E.compression_error(labels, pts, mid, k), 4 if k == "normal" else 6).withColumnRenamed("error", k)
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


@query("E14", over_lattice("SELECT a.px, a.py, (count(b.px) FILTER (WHERE a.label <> b.label) > 1) AS edge FROM lab a JOIN lab b ON abs(a.px-b.px) <= 1 AND abs(a.py-b.py) <= 1 GROUP BY 1, 2", ONE_SQL))
def e14(spark, sf):
    return E.label_edges(one_step(spark, sf)[1])


@query("E15", over_lattice("SELECT round(avg(1.959964e0*sqrt(e0)*2), 5) AS thickness, round(avg(sqrt(1-e1/e2)), 5) AS eccentricity, round(avg(sqrt(1-e0/e2)), 5) AS flatness, round(avg(1.959964e0*1.959964e0*sqrt(e1*e2)*pi()), 5) AS area, round(avg(1.959964e0*1.959964e0*sqrt(e1*e2)/(0.2e0*0.2e0)), 5) AS area_quotient FROM ev", EIGEN_SQL))
def e15(spark, sf):
    cov = C.covariance(labelled(spark, sf), ["label"])
    e = C.eigenvalues([F.col(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")])
    cov = cov.withColumns({f"e{i}": v for i, v in enumerate(e)})
    shape = C.shape_descriptors([F.col(f"e{i}") for i in range(3)], RADIUS)
    return rounded(cov.agg(*(F.avg(v).alias(n) for n, v in shape.items())), 5)


@query("E16", over_lattice("SELECT round(avg(v), 6) AS v FROM (SELECT k, avg((depth+k) % 100) AS v FROM pix, range(5) t(k) GROUP BY k)"))
def e16(spark, sf):
    """A metric over repeated runs (a run_id column), averaged."""
    runs = lattice(spark, sf).withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    each = runs.groupBy("run_id").agg(F.avg((F.col("depth") + F.col("run_id")) % 100).alias("v"))
    return rounded(each.agg(F.avg("v").alias("v")))
