"""Fields and pyramids over the density of the pixel lattice, scaled to 45 points; seeds are centres of 8 x 8 cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.mathx import kernel, kernel_square
from tessella.operators import field as O
from tessella.plans.fixtures import H, W, grid, lattice, over_lattice
from tessella.plans.point_queries import RADIUS, points, points_sql
from tessella.plans.registry import query, rounded

COUNT = 45
DENSITY_SQL = f"""{points_sql()},
den0 AS (SELECT px, py, CASE WHEN is_valid THEN 1/(pi()*radius_px*radius_px)/greatest(0.174e0, abs(nz)) ELSE 0.0e0 END AS v FROM pts),
dens AS (SELECT px, py, round(v*({COUNT}.0e0/(SELECT sum(v) FROM den0)), 9) + 0.0e0 AS v FROM den0)"""
SEEDS_SQL = "seeds AS (SELECT CAST(i AS BIGINT) AS seed_id, 4.0e0+8*(i % 8) AS x, 4.0e0+8*(i // 8) AS y FROM range(48) t(i))"


def density(spark, sf):
    """px, py, v, rounded so that later steps start from the same numbers everywhere."""
    d = O.normalise(O.depth_density(points(spark, sf)), COUNT)
    return d.select("px", "py", (F.round("v", 9) + F.lit(0.0)).alias("v"))


def cell_seeds(spark):
    i = F.col("id")
    return spark.range(48).select(i.alias("seed_id"), (4.0 + 8 * (i % 8)).alias("x"), (4.0 + 8 * F.floor(i / 8)).alias("y"))


def _v(e: str = "v", places: int = 8) -> str:
    return f"round({e}, {places}) + 0.0e0 AS v"


@query("F01", over_lattice(f"SELECT px, py, {_v()} FROM den0", DENSITY_SQL))
def f01(spark, sf):
    return rounded(O.depth_density(points(spark, sf)), 8)


@query("F02", over_lattice("SELECT px, py, round(45/3072.0e0, 8) AS v, round(sqrt(3072.0e0/(pi()*45)), 8) AS radius_px, round(1/(9.6e0*9.6e0*pi()), 8) AS v_radius FROM pix"))
def f02(spark, sf):
    p = O.constant_density(lattice(spark, sf).select("px", "py"), W, H, COUNT)
    q = O.constant_density(lattice(spark, sf).select("px", "py"), W, H)
    return rounded(p.join(q.select("px", "py", F.col("v").alias("v_radius")), ["px", "py"]), 8)


@query("F03", over_lattice(f"SELECT px, py, {_v('v', 9)}, round(1/sqrt({COUNT}.0e0/(SELECT sum(v) FROM den0)), 8) AS scale_radius FROM dens", DENSITY_SQL))
def f03(spark, sf):
    d = O.normalise(O.depth_density(points(spark, sf)), COUNT)
    return d.select("px", "py", (F.round("v", 9) + F.lit(0.0)).alias("v"), F.round("scale_radius", 8).alias("scale_radius"))


POINT_DENSITY_SQL = f"""{SEEDS_SQL},
rho AS (SELECT seed_id, x, y, avg(v)*0.5e0 AS soft FROM seeds JOIN dens ON px BETWEEN x-3 AND x+3 AND py BETWEEN y-3 AND y+3 GROUP BY 1, 2, 3 HAVING avg(v) > 0),
spr AS (SELECT px, py, sum(soft*exp(-pi()*(soft*((px-x)*(px-x)+(py-y)*(py-y))))) AS d FROM rho JOIN dens ON abs(px-x) <= ceil(1.3886e0/sqrt(soft)) AND abs(py-y) <= ceil(1.3886e0/sqrt(soft)) GROUP BY 1, 2),
pd AS (SELECT px, py, dens.v AS t, CASE WHEN dens.v <> 0 THEN 1.001e0*coalesce(d, 0) ELSE 0.0e0 END AS v FROM dens LEFT JOIN spr USING (px, py))"""


@query("F04", over_lattice(f"SELECT px, py, {_v()} FROM pd", f"{DENSITY_SQL},\n{POINT_DENSITY_SQL}"))
def f04(spark, sf):
    return rounded(O.point_density(cell_seeds(spark), density(spark, sf), W, H), 8)


@query("F05", over_lattice(f"SELECT CAST(px // 4 AS INT) AS px, CAST(py // 4 AS INT) AS py, {_v('sum(v)', 9)} FROM dens GROUP BY 1, 2", DENSITY_SQL))
def f05(spark, sf):
    return rounded(O.halve_exact(density(spark, sf), W, H, 4), 9)


@query("F06", over_lattice(f"SELECT a.px, a.py, {_v('coalesce(s, 0)', 9)} FROM g32 a LEFT JOIN (SELECT CAST(px // 2 AS INT) AS px, CAST(py // 2 AS INT) AS py, sum(v) AS s FROM dens GROUP BY 1, 2) b USING (px, py)", DENSITY_SQL + ",\ng32 AS (SELECT CAST(i % 32 AS INT) AS px, CAST(i // 32 AS INT) AS py FROM range(1024) t(i))"))
def f06(spark, sf):
    """Padded with zeros to a square of a power of two."""
    full = grid(spark, 32, 32).join(O.halve(density(spark, sf)), ["px", "py"], "left")
    return rounded(full.select("px", "py", F.coalesce("v", F.lit(0.0)).alias("v")), 9)


PYRAMID_SQL = "pyr AS (" + " UNION ALL ".join(f"SELECT {i} AS level, CAST(px // {2 << i} AS INT) AS px, CAST(py // {2 << i} AS INT) AS py, sum(v) AS v FROM dens GROUP BY 2, 3" for i in range(6)) + ")"


@query("F07", over_lattice(f"SELECT level, px, py, {_v('v', 9)} FROM pyr", f"{DENSITY_SQL},\n{PYRAMID_SQL}"))
def f07(spark, sf):
    return rounded(O.pyramid(density(spark, sf), W, H), 9)


@query("F08", over_lattice("SELECT level, px, py, round(sum(e), 9) + 0.0e0 AS v, round(sum(abs(e)), 9) + 0.0e0 AS v_abs FROM lv GROUP BY 1, 2, 3", DENSITY_SQL + f",\nlv AS ({' UNION ALL '.join(f'SELECT {i} AS level, CAST(px // {2 << i} AS INT) AS px, CAST(py // {2 << i} AS INT) AS py, v-0.015e0 AS e FROM dens' for i in range(6))})"))
def f08(spark, sf):
    d = density(spark, sf)
    return rounded(O.pyramid_with_abs(d.withColumn("v", F.col("v") - 0.015), W, H), 9)


@query("F09", over_lattice(f"SELECT CAST(px*3+k % 3 AS INT) AS px, CAST(py*3+k // 3 AS INT) AS py, {_v('v', 9)} FROM dens, range(9) t(k)", DENSITY_SQL))
def f09(spark, sf):
    return rounded(O.scale_up(density(spark, sf), 3), 9)


@query("F10", over_lattice(f"SELECT px, py, {_v('coalesce(s, 0)')} FROM dens LEFT JOIN sm USING (px, py)", DENSITY_SQL + ",\nsm AS (SELECT a.px, a.py, sum(exp(-pi()*(a.v*((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))))*b.v)/sum(exp(-pi()*(a.v*((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))))) AS s FROM dens a JOIN dens b ON abs(a.px-b.px) <= ceil(2.5e0/sqrt(a.v)) AND abs(a.py-b.py) <= ceil(2.5e0/sqrt(a.v)) WHERE a.v > 0 GROUP BY 1, 2)"))
def f10(spark, sf):
    return rounded(O.smooth2d(density(spark, sf), W, H), 8)


def _pass(src: str, axis: str) -> str:
    other = "py" if axis == "px" else "px"
    k = f"exp(-pi()*(a.v*((a.{axis}-b.{axis})*(a.{axis}-b.{axis}))))"
    return f"(SELECT px, py, coalesce(s, 0) AS v FROM dens LEFT JOIN (SELECT a.px, a.py, sum({k}*b.v)/sum({k}) AS s FROM dens a JOIN {src} b ON a.{other} = b.{other} AND abs(a.{axis}-b.{axis}) <= ceil(2.5e0/sqrt(a.v)) WHERE a.v > 0 AND b.v > 0 GROUP BY 1, 2) q USING (px, py))"


@query("F11", over_lattice(f"SELECT px, py, {_v()} FROM s2", f"{DENSITY_SQL},\ns1 AS {_pass('dens', 'px')},\ns2 AS {_pass('s1', 'py')}"))
def f11(spark, sf):
    return rounded(O.smooth_separated(density(spark, sf), W, H), 8)


@query("F12", over_lattice("SELECT px, py, round(exp(-pi()*(px/10.0e0)*(px/10.0e0)), 8) AS k, round(exp(-pi()*(py/10.0e0)), 8) AS k2 FROM pix"))
def f12(spark, sf):
    return rounded(lattice(spark, sf).select("px", "py", kernel(F.col("px") / 10.0).alias("k"), kernel_square(F.col("py") / 10.0).alias("k2")), 8)


_W = f"(1/(1+((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))*(1/({RADIUS}e0*{RADIUS}e0))))"
SALIENCY_SQL = f"""{points_sql()},
sal AS (SELECT a.px, a.py, sqrt(sum({_W}*((a.c0-b.c0)*(a.c0-b.c0)+(a.c1-b.c1)*(a.c1-b.c1)+(a.c2-b.c2)*(a.c2-b.c2)))/sum({_W})) AS s
  FROM pts a JOIN pts b ON abs(a.px-b.px) <= floor(a.radius_px+0.5e0) AND abs(a.py-b.py) <= floor(a.radius_px+0.5e0) WHERE a.is_valid AND b.is_valid GROUP BY 1, 2),
sl AS (SELECT px, py, radius_px, coalesce(s, 0) AS s FROM pts LEFT JOIN sal USING (px, py)),
st AS (SELECT avg(s) AS m, min(s) AS lo, max(s) AS hi FROM sl),
sn AS (SELECT px, py, radius_px, (s-m)/greatest(m-lo, hi-m) AS v FROM sl, st)"""


@query("F13", over_lattice(f"SELECT px, py, {_v('v', 6)} FROM sn", SALIENCY_SQL))
def f13(spark, sf):
    return rounded(O.saliency(points(spark, sf), RADIUS, W, H))


@query("F14", over_lattice("SELECT px, py, round(radius_px*pow(0.5e0, -v), 6) + 0.0e0 AS radius_px FROM sn", SALIENCY_SQL))
def f14(spark, sf):
    p = points(spark, sf)
    both = p.select("px", "py", "radius_px").join(O.saliency(p, RADIUS, W, H), ["px", "py"])
    return rounded(both.select("px", "py", O.radius_by_saliency(F.col("radius_px"), F.col("v")).alias("radius_px")))


@query("F15", over_lattice("SELECT round(sum(abs(v-t))/sum(t), 6) AS error FROM pd", f"{DENSITY_SQL},\n{POINT_DENSITY_SQL}"))
def f15(spark, sf):
    d = density(spark, sf)
    return rounded(O.density_error(O.point_density(cell_seeds(spark), d, W, H), d))


@query("F16", over_lattice("SELECT px, py, round(greatest(v-0.015e0, 0), 9) + 0.0e0 AS pos, round(greatest(0.015e0-v, 0), 9) + 0.0e0 AS neg FROM dens", DENSITY_SQL))
def f16(spark, sf):
    pos, neg = O.parts(F.col("v") - 0.015)
    return rounded(density(spark, sf).select("px", "py", pos.alias("pos"), neg.alias("neg")), 9)
