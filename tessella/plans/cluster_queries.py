"""Metrics and clustering on the pixel lattice (48 cell seeds) and on the feature points of the embeddings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import metric as D
from tessella.operators import cluster as C
from tessella.params import SMALL_CAMERA as CAM
from tessella.plans.field_queries import cell_seeds
from tessella.plans.fixtures import H, W, lattice, over_lattice, table
from tessella.plans.point_queries import RADIUS, points, points_sql
from tessella.plans.registry import query, r6, rounded
from tessella.scratch import cut

COVERAGE = 1.7
RAD = math.sqrt(W * H / (math.pi * 45))  # of the constant density of 45 clusters
RAD_SQL = "sqrt(3072.0e0/(pi()*45))"
FEATS = ("c0", "c1", "c2", "x", "y", "z")


def seeds(spark, pts: DataFrame) -> DataFrame:
    return C.seeds_at(pts, cell_seeds(spark)).withColumn("radius_px", F.lit(RAD))


# -- DuckDB -----------------------------------------------------------------------------------------------------------
def _mean_sql(src: str, by: str, mode: str, number: str) -> str:
    """Centres of src (by, px, py, features, radius)."""
    at = ("CAST(trunc(sx/n) AS INT)", "CAST(trunc(sy/n) AS INT)") if mode == "rgb" else ("CAST(trunc(x/z*54+32+0.5e0) AS INT)", "CAST(trunc(y/z*54+24+0.5e0) AS INT)")
    return f"""(SELECT CAST(row_number() OVER (ORDER BY {by}) - 1 AS INT) AS cluster_id, n, {", ".join(FEATS)}, radius_px, {at[0]} AS px, {at[1]} AS py
FROM (SELECT {by}, count(*) AS n, {", ".join(f"round(avg({c}), 9) AS {c}" for c in FEATS)}, any_value(radius) AS radius_px, sum(px) AS sx, sum(py) AS sy FROM {src} GROUP BY {by} HAVING count(*) > 3) q)"""


def create_sql(mode: str) -> str:
    return f"""sd AS (SELECT seed_id, pts.px, pts.py, {RAD_SQL} AS radius FROM (SELECT CAST(i AS BIGINT) AS seed_id, 4+8*(i % 8) AS x, 4+8*(i // 8) AS y FROM range(48) t(i)) s JOIN pts ON pts.px = s.x AND pts.py = s.y AND is_valid),
si AS (SELECT seed_id, p.px, p.py, radius, {", ".join(f"p.{c}" for c in FEATS)} FROM sd JOIN pts p ON is_valid AND abs(p.px-sd.px) <= least(2, ceil(radius*0.35e0)) AND abs(p.py-sd.py) <= least(2, ceil(radius*0.35e0))),
cl0 AS {_mean_sql("si", "seed_id", mode, "seed_id")}"""


_IMG = "((p.px-c.px)*(p.px-c.px)+(p.py-c.py)*(p.py-c.py))/(c.radius_px*c.radius_px)"
_COL = "((p.c0-c.c0)*(p.c0-c.c0)+(p.c1-c.c1)*(p.c1-c.c1)+(p.c2-c.c2)*(p.c2-c.c2))"
METRICS = {"rgb": f"(1.0e0*{_IMG}+2.0e0*{_COL})", "rgbd": f"(1.0e0*{_IMG}+2.0e0*{_COL}+3.0e0*abs(p.z-c.z))"}


def assign_sql(k: int, mode: str) -> str:
    reach = f"greatest(2, CAST(trunc(c.radius_px*{COVERAGE}e0+0.5e0) AS INT))"
    return f"""lb{k} AS (SELECT p.px, p.py, cluster_id AS label, {METRICS[mode]} AS distance, c.radius_px AS radius, {", ".join(f"p.{c}" for c in FEATS)}
FROM pts p JOIN cl{k} c ON is_valid AND abs(p.px-c.px) <= {reach} AND abs(p.py-c.py) <= {reach}
QUALIFY row_number() OVER (PARTITION BY p.px, p.py ORDER BY {METRICS[mode]}, cluster_id) = 1)"""


def loop_sql(n: int, mode: str) -> str:
    out = [points_sql(), create_sql(mode)]
    for k in range(n):
        out += [assign_sql(k, mode), f"cl{k + 1} AS {_mean_sql(f'lb{k}', 'label', mode, 'label')}"]
    return ",\n".join(out)


def last_labels_sql(n: int) -> str:
    """Labels of the last assignment, renumbered like the centres after it, -1 where there's none."""
    k = n - 1
    return f"nm AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS id FROM lb{k} GROUP BY label HAVING count(*) > 3),\nlab AS (SELECT pts.px, pts.py, coalesce(id, -1) AS label FROM pts LEFT JOIN (SELECT px, py, id FROM lb{k} JOIN nm USING (label)) q USING (px, py))"


ONE_SQL = f"{loop_sql(1, 'rgb')},\n{last_labels_sql(1)}"


def _loop(spark, sf, mode: str, n: int, conquer: bool = False):
    pts = cut(points(spark, sf))
    metric = D.rgb_metric() if mode == "rgb" else D.rgbd_metric()
    return pts, *C.segment(pts, seeds(spark, pts), metric, W, H, iterations=n, mode=mode, cam=CAM, conquer=conquer)


def one_step(spark, sf):
    """points, labels of all pixels, centres after one assignment by colour and pixel distance."""
    return _loop(spark, sf, "rgb", 1)


# -- metrics: every valid pixel against the pixel eight to the right ---------------------------------------------------
_PAIR = f"{points_sql()},\npr AS (SELECT p.px AS ax, p.py AS ay, {{e}} FROM pts p JOIN pts c ON c.px = p.px+8 AND c.py = p.py AND p.is_valid AND c.is_valid)"
_SPA = "((p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z))"
_NOR = "(1-(p.nx*c.nx+p.ny*c.ny+p.nz*c.nz))"


def _pairs(name: str, exprs: dict[str, str], columns):
    sql = ", ".join(f"round({e}, 6) + 0.0e0 AS {n}" for n, e in exprs.items())

    def run(spark, sf):
        p = points(spark, sf).where("is_valid")
        q = p.select(*(F.col(c).alias(f"b_{c}") for c in p.columns))
        both = p.join(q, (F.col("b_px") == F.col("px") + 8) & (F.col("b_py") == F.col("py")))
        return both.select(F.col("px").alias("ax"), F.col("py").alias("ay"), *(r6(v).alias(n) for n, v in columns(D.point(), D.point("b_")).items()))

    query(name, over_lattice("SELECT * FROM pr", _PAIR.format(e=sql)))(run)


_pairs("M01", {"d2": "(p.px-c.px)*(p.px-c.px)+(p.py-c.py)*(p.py-c.py)", "img": _IMG}, lambda p, q: {"d2": D.pixel_distance2(p, q).cast("double"), "img": D.image_distance(p, q)})
_pairs("M02", {"spatial": _SPA, "color": _COL}, lambda p, q: {"spatial": D.spatial_distance(p, q), "color": D.color_distance(p, q)})
_pairs("M03", {"nd": _NOR, "ndz": f"2*{_NOR}/(p.z+c.z)"}, lambda p, q: {"nd": D.normal_distance(p, q), "ndz": D.normal_distance_by_depth(p, q)})
_pairs("M04", {"d": f"1.0e0*{_IMG}+2.0e0*{_COL}"}, lambda p, q: {"d": D.rgb_metric()(p, q)})
_pairs("M05", {"d": f"1.0e0*{_IMG}+2.0e0*{_COL}+3.0e0*abs(p.z-c.z)"}, lambda p, q: {"d": D.rgbd_metric()(p, q)})
_pairs("M06", {"d": f"(1.0e0/(0.2e0*0.2e0))*{_SPA}+2.0e0*{_COL}+3.0e0*(2*{_NOR}/(p.z+c.z))"}, lambda p, q: {"d": D.depth_metric(RADIUS)(p, q)})
_TURN = "greatest(0.0e0, ((p.nx-c.nx)*(c.x-p.x)+(p.ny-c.ny)*(c.y-p.y)+(p.nz-c.nz)*(c.z-p.z))/sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z)))"
_NEARBY = f"greatest(0.0e0, {_SPA}/(4.0e0*0.2e0*0.2e0)-1.2e0)"
_pairs("N09", {"a": f"exp(-({_NEARBY}+2.0e0/(sqrt(48.0e0)*0.01e0)*{_COL}+3.0e0*{_TURN}))", "b": f"exp(-({_NEARBY}+2.0e0/(sqrt(48.0e0)*0.01e0)*{_COL}+3.0e0*{_NOR}))"}, lambda p, q: {"a": D.classic_affinity(48, 0.2, 1, 2, 3)(p, q), "b": D.classic_affinity(48, 0.2, 1, 2, 3, False)(p, q)})
_pairs("N10", {"a": f"exp(-(1.0e0/6*{_NEARBY}+2.0e0/6*3.2e0*{_COL}+3.0e0/6*{_TURN}))"}, lambda p, q: {"a": D.improved_affinity(0.2, 1, 2, 3)(p, q)})
_pairs("N11", {"a": f"exp(-(4.0e0*{_COL}/(sqrt(48.0e0)*0.01e0)))"}, lambda p, q: {"a": D.color_affinity(48)(p, q)})

# -- clustering ---------------------------------------------------------------------------------------------------------
_EDGE = f"""{points_sql()},
ed AS (SELECT p.px, p.py, CASE WHEN p.is_valid AND coalesce(l.is_valid AND r.is_valid AND u.is_valid AND d.is_valid, false) THEN {METRICS['rgb'].replace('p.', 'l.').replace('c.', 'r.').replace('r.radius_px', 'r.radius_px')}+{METRICS['rgb'].replace('p.', 'u.').replace('c.', 'd.')} ELSE 1e6 END AS edge
FROM pts p LEFT JOIN pts l ON l.px = p.px-1 AND l.py = p.py LEFT JOIN pts r ON r.px = p.px+1 AND r.py = p.py LEFT JOIN pts u ON u.px = p.px AND u.py = p.py-1 LEFT JOIN pts d ON d.px = p.px AND d.py = p.py+1)"""


@query("C01", over_lattice("SELECT px, py, round(edge, 6) + 0.0e0 AS edge FROM ed", _EDGE))
def c01(spark, sf):
    return rounded(C.edges(points(spark, sf), D.rgb_metric(), W, H))


@query(
    "P22",
    over_lattice(
        "SELECT seed_id, px, py FROM mv",
        _EDGE
        + """,
sd AS (SELECT seed_id, pts.px, pts.py FROM (SELECT CAST(i AS BIGINT) AS seed_id, 4+8*(i % 8) AS x, 4+8*(i // 8) AS y FROM range(48) t(i)) s JOIN pts ON pts.px = s.x AND pts.py = s.y AND is_valid),
n8 AS (SELECT * FROM (VALUES (0,0,0),(1,-1,0),(2,-1,-1),(3,0,-1),(4,1,-1),(5,1,0),(6,1,1),(7,0,1),(8,-1,1)) t(i, dx, dy)),
mv AS (SELECT seed_id, ed.px, ed.py FROM sd, n8 JOIN ed ON ed.px = sd.px+dx AND ed.py = sd.py+dy QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY round(edge, 9), i) = 1)""",
    ),
)
def p22(spark, sf):
    pts = cut(points(spark, sf))
    e = C.edges(pts, D.rgb_metric(), W, H).withColumn("edge", F.round("edge", 9))
    return C.improve_seeds(C.seeds_at(pts, cell_seeds(spark)), e)


_CENTRE = "cluster_id, CAST(n AS BIGINT) AS n, px, py, " + ", ".join(f"round({c}, 6) + 0.0e0 AS {c}" for c in FEATS)


def _centres(df: DataFrame) -> DataFrame:
    return df.select("cluster_id", "n", "px", "py", *(r6(F.col(c)).alias(c) for c in FEATS))


@query("C02", over_lattice(f"SELECT {_CENTRE} FROM cl0", f"{points_sql()},\n{create_sql('rgbd')}"))
def c02(spark, sf):
    pts = points(spark, sf)
    return _centres(C.create_clusters(seeds(spark, pts), pts, W, H, cam=CAM))


@query("C03", over_lattice("SELECT px, py, label, round(distance, 6) + 0.0e0 AS distance FROM lb0", loop_sql(1, "rgb")))
def c03(spark, sf):
    """The nearest centre of every pixel."""
    pts = points(spark, sf)
    cl = C.create_clusters(seeds(spark, pts), pts, W, H, mode="rgb")
    return C.assign(cl, pts, D.rgb_metric(), COVERAGE, W, H).select("px", "py", "label", r6(F.col("distance")).alias("distance"))


@query("C04", over_lattice(f"SELECT {_CENTRE} FROM cl1", loop_sql(1, "rgbd")))
def c04(spark, sf):
    pts = points(spark, sf)
    cl = C.create_clusters(seeds(spark, pts), pts, W, H, cam=CAM)
    return _centres(C.update(C.assign(cl, pts, D.rgbd_metric(), COVERAGE, W, H), pts, cl, cam=CAM))


@query("C05", over_lattice(f"SELECT {_CENTRE} FROM cl2", loop_sql(2, "rgbd")))
def c05(spark, sf):
    return _centres(_loop(spark, sf, "rgbd", 2)[2])


@query("C06", over_lattice("SELECT label, count(*) AS n, round(avg(c0), 6) AS c0, round(avg(z), 6) AS z FROM lab JOIN pts USING (px, py) GROUP BY label", f"{loop_sql(3, 'rgbd')},\n{last_labels_sql(3)}"))
def c06(spark, sf):
    """The whole loop, three times around, as segments with their means."""
    pts, labels, _ = _loop(spark, sf, "rgbd", 3)
    return labels.join(pts, ["px", "py"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c0")).alias("c0"), r6(F.avg("z")).alias("z"))


def _enclave_sql() -> str:
    near = [("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("d", 0, 1)]
    joins = " ".join(f"JOIN lp {n} ON {n}.px = p.px+({dx}) AND {n}.py = p.py+({dy})" for n, dx, dy in near)
    dist = ", ".join(f"{{'d': CASE WHEN {n}.label <> -1 THEN (p.x-{n}.x)*(p.x-{n}.x)+(p.y-{n}.y)*(p.y-{n}.y)+(p.z-{n}.z)*(p.z-{n}.z) ELSE 'infinity'::DOUBLE END, 'i': {i}, 'l': {n}.label}}" for i, (n, _, _) in enumerate(near))
    return f"""lp AS (SELECT lab.px, lab.py, label, x, y, z FROM lab JOIN pts USING (px, py)),
en AS (SELECT p.px, p.py, list_min([{dist}]).l AS best FROM lp p {joins} WHERE p.label <> -1 AND {" AND ".join(f"{n}.label <> p.label" for n, _, _ in near)} AND ({" OR ".join(f"{n}.label <> -1" for n, _, _ in near)}))"""


@query("C07", over_lattice("SELECT px, py, CAST(coalesce(best, label) AS INT) AS label FROM lab LEFT JOIN en USING (px, py)", f"{ONE_SQL},\n{_enclave_sql()}"))
def c07(spark, sf):
    pts, labels, _ = one_step(spark, sf)
    return C.mini_enclaves(labels, pts, W, H)


@query("C09", over_lattice("SELECT px, py, CAST(label AS INT) AS label FROM lab", ONE_SQL))
def c09(spark, sf):
    return one_step(spark, sf)[1]


COV_SQL = f"""{ONE_SQL},
cv AS (SELECT label, count(*) AS n, {", ".join(f"covar_pop({a}, {b}) AS s{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")))} FROM lab JOIN pts USING (px, py) WHERE label >= 0 GROUP BY label)"""
EIGEN_SQL = f"""{COV_SQL},
e1 AS (SELECT *, (sxx+syy+szz)/3 AS q FROM cv),
e2 AS (SELECT *, sqrt(((sxx-q)*(sxx-q)+(syy-q)*(syy-q)+(szz-q)*(szz-q)+2*(sxy*sxy+sxz*sxz+syz*syz))/6) AS p FROM e1),
e3 AS (SELECT *, acos(greatest(-1, least(1, ((sxx-q)*((syy-q)*(szz-q)-syz*syz)-sxy*(sxy*(szz-q)-syz*sxz)+sxz*(sxy*syz-(syy-q)*sxz))/(2*p*p*p))))/3 AS phi FROM e2),
e4 AS (SELECT *, q+2*p*cos(phi) AS hi, q+2*p*cos(phi+2*pi()/3) AS lo FROM e3),
ev AS (SELECT label, n, abs(lo) AS e0, abs(3*q-hi-lo) AS e1, abs(hi) AS e2 FROM e4)"""


def labelled(spark, sf) -> DataFrame:
    pts, labels, _ = one_step(spark, sf)
    return labels.where("label >= 0").join(pts, ["px", "py"])


@query("C10", over_lattice("SELECT label, round(1.959964e0*sqrt(e0)*2, 5) + 0.0e0 AS thickness, round(sqrt(1-e1/e2), 5) + 0.0e0 AS eccentricity, round(sqrt(1-e0/e2), 5) + 0.0e0 AS flatness, round(1.959964e0*1.959964e0*sqrt(e1*e2)*pi(), 5) + 0.0e0 AS area, round(1.959964e0*1.959964e0*sqrt(e1*e2)/(0.2e0*0.2e0), 5) + 0.0e0 AS area_quotient FROM ev", EIGEN_SQL))
def c10(spark, sf):
    cov = C.covariance(labelled(spark, sf), ["label"])
    e = C.eigenvalues([F.col(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")])
    cov = cov.withColumns({f"e{i}": v for i, v in enumerate(e)})
    return rounded(cov.select("label", *(v.alias(n) for n, v in C.shape_descriptors([F.col(f"e{i}") for i in range(3)], RADIUS).items())), 5)


@query("C12", over_lattice("SELECT label, CAST(n AS BIGINT) AS n, " + ", ".join(f"round({c}, 8) + 0.0e0 AS {c}" for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")) + " FROM cv", COV_SQL))
def c12(spark, sf):
    return rounded(C.covariance(labelled(spark, sf), ["label"]), 8)


@query("C13")
def c13(spark, sf):
    """Normals of planes through clusters, in closed form (numpy agrees in the tests)."""
    rows = labelled(spark, sf)
    centres = rows.groupBy("label").agg(*(F.avg(c).alias(c) for c in D.POSITION))
    return rounded(C.cluster_normals(C.covariance(rows, ["label"]), centres, ["label"]))


@query("C14")
def c14(spark, sf):
    """Thickness along the normal, areas and coverage error."""
    pts, labels, clusters = _loop(spark, sf, "rgbd", 2)
    rows = labels.where("label >= 0").join(pts, ["px", "py"])
    centres = rows.groupBy("label").agg(*(F.avg(c).alias(c) for c in D.POSITION))
    normal = C.cluster_normals(C.covariance(rows, ["label"]), centres, ["label"]).select(F.col("label").alias("cluster_id"), *D.NORMAL)
    return rounded(C.extended(labels, pts, clusters.join(normal, "cluster_id"), RADIUS, CAM, COVERAGE, W, H))


@query("C15", over_lattice("SELECT least(greatest(CAST(round((1.959964e0*sqrt(e0)*2-0)*20/(0.4e0-0)) AS INT), 0), 19) AS bin, count(*) AS n FROM ev GROUP BY 1", EIGEN_SQL))
def c15(spark, sf):
    """Histogram of thickness."""
    cov = C.covariance(labelled(spark, sf), ["label"])
    e = C.eigenvalues([F.col(c) for c in ("sxx", "sxy", "sxz", "syy", "syz", "szz")])
    t = C.shape_descriptors(e, RADIUS)["thickness"]
    return cov.select(C.histogram_bin(t, 0.0, 0.4, 20).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("C16", over_lattice("SELECT cluster_id AS seed_id, px, py, round(radius_px, 6) AS radius_px FROM cl1", loop_sql(1, "rgb")))
def c16(spark, sf):
    """Centres as seeds of another run."""
    return one_step(spark, sf)[2].select(F.col("cluster_id").alias("seed_id"), "px", "py", r6(F.col("radius_px")).alias("radius_px"))


@query("C17", over_lattice("SELECT CAST(cluster_id AS INT) AS cluster_id, CASE WHEN cluster_id % 4 = 0 THEN a.px ELSE b.px END AS px, CASE WHEN cluster_id % 4 = 0 THEN a.py ELSE b.py END AS py, round(CASE WHEN cluster_id % 4 = 0 THEN a.c0 ELSE b.c0 END, 6) + 0.0e0 AS c0 FROM cl0 a JOIN cl1 b USING (cluster_id)", loop_sql(1, "rgb")))
def c17(spark, sf):
    """Fixed clusters (every fourth) keep their place and colour when the others move."""
    pts = cut(points(spark, sf))
    before = C.create_clusters(seeds(spark, pts), pts, W, H, mode="rgb")
    after = C.update(C.assign(before, pts, D.rgb_metric(), COVERAGE, W, H), pts, before, mode="rgb")
    fixed = F.col("cluster_id") % 4 == 0
    both = before.select("cluster_id", *(F.col(c).alias(f"_{c}") for c in ("px", "py", "c0"))).join(after, "cluster_id")
    return both.select("cluster_id", *(F.when(fixed, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("px", "py")), r6(F.when(fixed, F.col("_c0")).otherwise(F.col("c0"))).alias("c0"))


# -- generic features: embeddings on a lattice 25 wide ----------------------------------------------------------------
NAMES = ("f0", "f1", "f2")
FW, RHO = 25, 0.04
FEATURE_SQL = f"""ft AS (SELECT CAST(vec_id % {FW} AS INT) AS px, CAST(vec_id // {FW} AS INT) AS py, round(CAST(embedding[1] AS DOUBLE), 9) AS f0, round(CAST(embedding[2] AS DOUBLE), 9) AS f1, round(CAST(embedding[3] AS DOUBLE), 9) AS f2, label AS truth FROM embeddings),
hh AS (SELECT max(vec_id) // {FW} + 1 AS h FROM embeddings)"""


def feature_points(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    at = [(F.col("vec_id") % FW).cast("int").alias("px"), F.floor(F.col("vec_id") / FW).cast("int").alias("py")]
    return e.select(*at, *(F.round(F.col("embedding")[i].cast("double"), 9).alias(n) for i, n in enumerate(NAMES)), F.lit(RHO).alias("rho"))


def feature_height(spark, sf) -> int:
    """Rows of the lattice that holds the whole table."""
    last = table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
    return 0 if last is None else last // FW + 1


def feature_seeds(spark, height: int) -> DataFrame:
    """One seed for every 5 x 5 pixels of the lattice, in its last row at most."""
    i = F.col("id")
    y = F.least(2.5 + 5 * F.floor(i / 5), F.lit(height - 0.5))
    return spark.range(5 * -(-height // 5)).select(i.alias("seed_id"), (2.5 + 5 * (i % 5)).alias("x"), y.alias("y"))


_FR = f"(1/sqrt(pi()*{RHO}e0))"


def generic_sql(n: int) -> str:
    out = [
        FEATURE_SQL,
        "fs AS (SELECT CAST(i AS BIGINT) AS seed_id, 2.5e0+5*(i % 5) AS x, least(2.5e0+5*(i // 5), h-0.5e0) AS y FROM (SELECT h, unnest(range(5*((h+4) // 5))) AS i FROM hh))",
        f"g0 AS (SELECT CAST(row_number() OVER (ORDER BY seed_id) - 1 AS INT) AS cluster_id, x, y, {', '.join(f'round(avg({f}), 9) AS {f}' for f in NAMES)} FROM fs JOIN ft ON px BETWEEN greatest(trunc(x-0.25e0*{_FR}), 0) AND trunc(x+0.25e0*{_FR}) AND py BETWEEN greatest(trunc(y-0.25e0*{_FR}), 0) AND trunc(y+0.25e0*{_FR}) GROUP BY seed_id, x, y)",
    ]
    for k in range(n):
        d = f"(1.0e0/{_FR}*sqrt((px-x)*(px-x)+(py-y)*(py-y))+sqrt({'+'.join(f'(ft.{f}-g.{f})*(ft.{f}-g.{f})' for f in NAMES)}))"
        out += [
            f"h{k} AS (SELECT px, py, {', '.join(f'ft.{f}' for f in NAMES)}, truth, cluster_id AS label FROM ft JOIN g{k} g ON px BETWEEN greatest(trunc(x-{_FR}*3.0e0), 0) AND trunc(x+{_FR}*3.0e0) AND py BETWEEN greatest(trunc(y-{_FR}*3.0e0), 0) AND trunc(y+{_FR}*3.0e0) QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY {d}, cluster_id) = 1)",
            f"g{k + 1} AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS cluster_id, sum(px)/count(*) AS x, sum(py)/count(*) AS y, {', '.join(f'round(avg({f}), 9) AS {f}' for f in NAMES)} FROM h{k} GROUP BY label)",
        ]
    return "WITH " + ",\n".join(out) + "\n"


@query("C18", generic_sql(1) + "SELECT px, py, label FROM h0")
def c18(spark, sf):
    f, h = feature_points(spark, sf), feature_height(spark, sf)
    return C.assign_generic(C.local_mean(feature_seeds(spark, h), f, NAMES, FW, h, rho=RHO), f, C.euclid(NAMES), 3.0, 1.0, FW, h, NAMES, rho=RHO)


@query("C19", generic_sql(3) + "SELECT cluster_id, round(x, 6) AS x, round(y, 6) AS y, " + ", ".join(f"round({f}, 6) + 0.0e0 AS {f}" for f in NAMES) + " FROM g3")
def c19(spark, sf):
    h = feature_height(spark, sf)
    return rounded(C.adaptive_clusters(feature_points(spark, sf), feature_seeds(spark, h), NAMES, FW, h, iterations=3, rho=RHO)[1].select("cluster_id", "x", "y", *NAMES))


@query("C20", generic_sql(5) + ", nm AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS id FROM h4 GROUP BY label) SELECT px, py, id AS label FROM h4 JOIN nm USING (label)")
def c20(spark, sf):
    """Five iterations with the Euclidean distance of three features."""
    return adaptive(spark, sf)


def adaptive(spark, sf) -> DataFrame:
    h = feature_height(spark, sf)
    return C.adaptive_clusters(feature_points(spark, sf), feature_seeds(spark, h), NAMES, FW, h, rho=RHO)[0]


@query("C21", generic_sql(0) + "SELECT cluster_id, x, y, " + ", ".join(f"round({f}, 6) + 0.0e0 AS {f}" for f in NAMES) + f", round({_FR}, 6) AS radius FROM g0")
def c21(spark, sf):
    """Radius from density, boxes and local means."""
    h = feature_height(spark, sf)
    got = C.local_mean(feature_seeds(spark, h), feature_points(spark, sf), NAMES, FW, h, rho=RHO).withColumn("radius", F.lit(1 / math.sqrt(math.pi * RHO)))
    return rounded(got.select("cluster_id", *(F.col(n) for n in ("x", "y", *NAMES, "radius"))))
