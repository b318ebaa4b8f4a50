"""Samplers over the lattice's density of 45 points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.rng import uniform, uniform_sql
from tessella.operators import cluster as C
from tessella.operators import sampling as S
from tessella.plans.field_queries import DENSITY_SQL, PYRAMID_SQL, cell_seeds, density
from tessella.plans.fixtures import H, W, lattice, numbers, over_lattice, over_numbers
from tessella.plans.point_queries import points, points_sql
from tessella.plans.registry import query, r6, rounded
from tessella.scratch import cut

SEED = 42
_XY = "round(x, 6) + 0.0e0 AS x, round(y, 6) + 0.0e0 AS y"


@query("P01", over_lattice(f"SELECT CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y FROM dens WHERE {uniform_sql(SEED, chr(39) + 'keep' + chr(39), 'px', 'py')} < v", DENSITY_SQL))
def p01(spark, sf):
    return S.sample("rnd", density(spark, sf), W, H)


@query("P02", over_lattice("SELECT 64.0e0/nx*(i+0.5e0) AS x, 48.0e0/ny*(j+0.5e0) AS y FROM n, range(100) a(i), range(100) b(j) WHERE i < nx AND j < ny", DENSITY_SQL + ",\nn AS (SELECT ceil(64/sqrt(3072.0e0/sum(v))) AS nx, ceil(48/sqrt(3072.0e0/sum(v))) AS ny FROM dens)"))
def p02(spark, sf):
    return S.sample("rect", density(spark, sf), W, H)


def _u(tag: str, *key: str) -> str:
    return uniform_sql(SEED, f"'{tag}'", *key)


def _walk(limit: float, floor: int) -> str:
    return f"""vs AS (SELECT level, px, py, v FROM pyr WHERE level = 5
  UNION ALL SELECT p.level, p.px, p.py, p.v FROM vs JOIN pyr p ON p.level = vs.level-1 AND p.px // 2 = vs.px AND p.py // 2 = vs.py WHERE vs.v > {limit} AND vs.level > {floor}),
st AS (SELECT * FROM vs WHERE NOT (v > {limit} AND level > {floor}))"""


def _recursive(select: str, more: str) -> str:
    return over_lattice(select, f"{DENSITY_SQL},\n{PYRAMID_SQL},\n{more}").replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "P04",
    _recursive(
        "SELECT round(ox*2.0e0, 6) AS x, round(oy*2.0e0, 6) AS y FROM hit",
        _walk(4.0, 1)
        + f""",
dr AS (SELECT level, px AS x, py AS y, k, {_u('child', 'level', 'px', 'py', 'k')} AS u1, {_u('pixel', 'level', 'px', 'py', 'k')} AS u2 FROM st, range(50) t(k) WHERE k < CASE WHEN v <= 0 THEN 0 ELSE floor(v) + CASE WHEN {_u('round', 'level', 'px', 'py')} < v-floor(v) THEN 1 ELSE 0 END END),
ch AS (SELECT level+1 AS level, px // 2 AS x, py // 2 AS y, px AS cx, py AS cy, v, (px % 2)*2 + py % 2 AS i, sum(v) OVER (PARTITION BY level, px // 2, py // 2 ORDER BY (px % 2)*2 + py % 2) AS cum, sum(v) OVER (PARTITION BY level, px // 2, py // 2) AS tot FROM pyr),
pk AS (SELECT dr.level, dr.x, dr.y, k, u2, cx, cy, v AS w FROM dr JOIN ch ON ch.level = dr.level AND ch.x = dr.x AND ch.y = dr.y WHERE cum >= u1*tot QUALIFY row_number() OVER (PARTITION BY dr.level, dr.x, dr.y, k ORDER BY i) = 1),
px0 AS (SELECT l AS level, px // CAST(pow(2, l-1) AS INT) AS cx, py // CAST(pow(2, l-1) AS INT) AS cy, px AS ox, py AS oy, sum(v) OVER (PARTITION BY l, px // CAST(pow(2, l-1) AS INT), py // CAST(pow(2, l-1) AS INT) ORDER BY py, px) AS cum FROM pyr, range(1, 6) t(l) WHERE level = 0),
hit AS (SELECT ox, oy FROM pk JOIN px0 ON px0.level = pk.level AND px0.cx = pk.cx AND px0.cy = pk.cy WHERE cum >= u2*w QUALIFY row_number() OVER (PARTITION BY pk.level, pk.x, pk.y, k ORDER BY oy, ox) = 1)""",
    ),
)
def p04(spark, sf):
    return rounded(S.sample("spds", cut(density(spark, sf)), W, H))


@query("P05", _recursive(f"SELECT {_XY} FROM (SELECT 2*pow(2.0e0, level)*(px+0.5e0+0.38e0*(2*{_u('x', 'level', 'px', 'py')}-1)) AS x, 2*pow(2.0e0, level)*(py+0.5e0+0.38e0*(2*{_u('y', 'level', 'px', 'py')}-1)) AS y FROM st WHERE {_u('accept', 'level', 'px', 'py')} <= v)", _walk(1.0, 0)))
def p05(spark, sf):
    return rounded(S.sample("spds_old", cut(density(spark, sf)), W, H))


for _name, _mode in (("P06", "fs"), ("P07", "fs_expo"), ("P08", "fs_layers"), ("P09", "fattal")):
    query(_name)(lambda spark, sf, mode=_mode: rounded(S.sample(mode, density(spark, sf), W, H)))

_KERN = "ker AS (SELECT 4.0e0+8*(i % 8) AS x, 4.0e0+8*(i // 8) AS y, 1.0e0 AS weight, 8.0e0 AS scale FROM range(48) t(i))"


@query("P10", over_lattice("SELECT round(sum(abs(coalesce(s, 0)-v)), 6) AS energy FROM dens LEFT JOIN (SELECT px, py, sum(weight/(scale*scale)*exp(-pi()*(((px-x)*(px-x)+(py-y)*(py-y))/(scale*scale)))) AS s FROM ker JOIN dens ON px BETWEEN floor(x-1.482837414e0*scale) AND ceil(x+1.482837414e0*scale) AND py BETWEEN floor(y-1.482837414e0*scale) AND ceil(y+1.482837414e0*scale) GROUP BY 1, 2) USING (px, py)", f"{DENSITY_SQL},\n{_KERN}"))
def p10(spark, sf):
    k = cell_seeds(spark).select("x", "y", F.lit(1.0).alias("weight"), F.lit(8.0).alias("scale"))
    return rounded(S.kernel_energy(k, density(spark, sf), W, H))


@query("P11")
def p11(spark, sf):
    """The cell seeds carried over to the lattice's density."""
    return rounded(S.sample("dds", cut(density(spark, sf)), W, H, old=cell_seeds(spark)))


_N = "q, d, t"


@query("P14", over_numbers(f"SELECT {_N}, round(4.0e0*(q+0.5e0+0.38e0*(2*{uniform_sql(SEED, 'q', 'd')}-1)), 6) AS x, round(4.0e0*(d+0.5e0+0.38e0*(2*{uniform_sql(SEED, 'd', 't')}-1)), 6) AS y FROM v"))
def p14(spark, sf):
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    x, y = S.cell_point(q, d, F.lit(4.0), uniform(SEED, q, d), uniform(SEED, d, t))
    return numbers(spark, sf).select("q", "d", "t", r6(x).alias("x"), r6(y).alias("y"))


@query("P15", over_lattice("SELECT CAST(px // 8 AS INT) AS cx, CAST(py // 8 AS INT) AS cy, px, py FROM dens QUALIFY row_number() OVER (PARTITION BY px // 8, py // 8 ORDER BY v DESC, py, px) = 1", DENSITY_SQL))
def p15(spark, sf):
    return S.best_in_cell(density(spark, sf), 8)


@query("P16", over_lattice(f"SELECT CAST(px // 8 AS INT) AS cx, CAST(py // 8 AS INT) AS cy, px, py FROM (SELECT *, sum(v) OVER (PARTITION BY px // 8, py // 8 ORDER BY py, px) AS cum, sum(v) OVER (PARTITION BY px // 8, py // 8) AS tot FROM dens) WHERE tot > 0 AND cum >= {_u('cell', 'px // 8', 'py // 8')}*tot QUALIFY row_number() OVER (PARTITION BY px // 8, py // 8 ORDER BY py, px) = 1", DENSITY_SQL))
def p16(spark, sf):
    return S.point_in_cell(density(spark, sf), 8, SEED)


@query("P17", over_numbers(f"SELECT {_N}, CAST(CASE WHEN x <= 0 THEN 0 ELSE floor(x) + CASE WHEN {uniform_sql(SEED, 'q', 'd', 't')} < x-floor(x) THEN 1 ELSE 0 END END AS BIGINT) AS n FROM v"))
def p17(spark, sf):
    u = uniform(SEED, F.col("q"), F.col("d"), F.col("t"))
    return numbers(spark, sf).select("q", "d", "t", S.round_random(F.col("x"), u).cast("long").alias("n"))


@query("P18", over_numbers(f", ws AS (SELECT q AS i, CAST(count(*) AS DOUBLE) AS w FROM v GROUP BY q), cu AS (SELECT i, sum(w) OVER (ORDER BY i) AS cum, sum(w) OVER () AS tot FROM ws) SELECT CAST(draw AS BIGINT) AS draw, min(i) AS i FROM range(200) t(draw), cu WHERE cum >= {_u('draw', 'draw')}*tot GROUP BY draw"))
def p18(spark, sf):
    weights = numbers(spark, sf).groupBy(F.col("q").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    draws = spark.range(200).select(F.col("id").alias("draw"), uniform(SEED, "draw", F.col("id")).alias("u"))
    return S.sample_weighted(weights, draws, [])


@query("P19", over_lattice("SELECT CAST(px*5 AS INT) AS x, CAST(py*5 AS INT) AS y FROM pix"))
def p19(spark, sf):
    """Points scaled by a constant; the generator's seed is a parameter everywhere."""
    return lattice(spark, sf).select((F.col("px") * 5).alias("x"), (F.col("py") * 5).alias("y"))


@query("P20", over_lattice("SELECT seed_id, px, py, round(radius_px, 6) AS radius_px FROM (SELECT CAST(i AS BIGINT) AS seed_id, 3+9*(i % 8) AS sx, 3+9*(i // 8) AS sy FROM range(48) t(i)) JOIN pts ON px = sx AND py = sy WHERE is_valid", points_sql()))
def p20(spark, sf):
    """Points become seeds unless they fall outside or on an invalid pixel."""
    i = F.col("id")
    at = spark.range(48).select(i.alias("seed_id"), (3.2 + 9 * (i % 8)).alias("x"), (2.8 + 9 * F.floor(i / 8)).alias("y"))
    return C.seeds_at(points(spark, sf), at).select("seed_id", "px", "py", r6(F.col("radius_px")).alias("radius_px"))


_RND = f"SELECT CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y FROM dens WHERE {_u('keep', 'px', 'py')} < v"
_RECT = "SELECT 64.0e0/nx*(i+0.5e0) AS x, 48.0e0/ny*(j+0.5e0) AS y FROM n, range(100) a(i), range(100) b(j) WHERE i < nx AND j < ny"
_COUNTS = "n AS (SELECT ceil(64/sqrt(3072.0e0/sum(v))) AS nx, ceil(48/sqrt(3072.0e0/sum(v))) AS ny FROM dens)"


@query("P13", over_lattice(f"SELECT 'rnd' AS mode, * FROM ({_RND}) UNION ALL SELECT 'rect', * FROM ({_RECT})", f"{DENSITY_SQL},\n{_COUNTS}"))
def p13(spark, sf):
    """Samplers by name; any other name is refused."""
    d = cut(density(spark, sf))
    got = [S.sample(m, d, W, H).select(F.lit(m).alias("mode"), "x", "y") for m in ("rnd", "rect")]
    return got[0].unionByName(got[1])


@query("P21", over_lattice(f"SELECT mode, p.px, p.py, round(radius_px, 6) AS radius_px, CAST(-1 AS BIGINT) AS label FROM (SELECT 'rnd' AS mode, * FROM ({_RND}) UNION ALL SELECT 'rect', * FROM ({_RECT})) s JOIN pts p ON p.px = round(s.x) AND p.py = round(s.y) WHERE is_valid", f"{DENSITY_SQL},\n{_COUNTS}"))
def p21(spark, sf):
    """Seeds by name of the sampler, on valid pixels."""
    d, pts = cut(density(spark, sf)), cut(points(spark, sf))
    got = [C.find_seeds(m, d, pts, W, H).select(F.lit(m).alias("mode"), "px", "py", r6(F.col("radius_px")).alias("radius_px"), "label") for m in ("rnd", "rect")]
    return got[0].unionByName(got[1])
