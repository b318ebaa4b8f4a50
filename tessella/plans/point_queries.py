"""Point construction, depth repair and smoothing on the pixel lattice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import color as K
from tessella.functions import geometry as G
from tessella.operators import depth as R
from tessella.operators import points as P
from tessella.params import SMALL_CAMERA as CAM
from tessella.plans.fixtures import H, W, lattice, over_lattice
from tessella.plans.registry import query, r6, rounded

RADIUS = 0.2
px, py = "px", "py"

# Points in DuckDB: the same chain, neighbours by joins.


def _diff(v0, v1, v2, v3, v4, both):
    left, right = f"({v0} = 0 OR {v1} = 0)", f"({v3} = 0 OR {v4} = 0)"
    return f"(CASE WHEN {v0} = 0 AND {v4} = 0 AND {v1} <> 0 AND {v3} <> 0 THEN {v3}-{v1} WHEN {left} AND {right} THEN 0 WHEN {left} THEN {v4}-{v2} WHEN {right} THEN {v2}-{v0} ELSE {both} END)"


def _blend(v0, v1, v2, v3, v4):
    a, b = f"abs({v2}+{v0}-2*{v1})", f"abs({v4}+{v2}-2*{v3})"
    return _diff(v0, v1, v2, v3, v4, f"(CASE WHEN {a}+{b} = 0 THEN 0.5e0*({v4}-{v0}) ELSE ({b}*({v2}-{v0})+{a}*({v4}-{v2}))/CAST({a}+{b} AS DOUBLE) END)")


def points_sql(radius: float = RADIUS, extra: str = "true") -> str:
    """CTEs up to pts(px, py, c0..c2, x, y, z, nx, ny, nz, radius_px, is_valid), columns of invalid points zero."""
    joins = " ".join(
        f"LEFT JOIN pix AS a{i} ON a{i}.px = w0.px + ({dx}) AND a{i}.py = w0.py + ({dy})"
        for i, (dx, dy) in enumerate([("-w", "0"), ("-w//2", "0"), ("w//2", "0"), ("w", "0"), ("0", "-w"), ("0", "-w//2"), ("0", "w//2"), ("0", "w")])
    )
    g = [_blend("v0", "v1", "depth", "v2", "v3"), _blend("v4", "v5", "depth", "v6", "v7")]
    return f"""zf AS (SELECT *, depth*0.001e0/54.0e0 AS zf FROM pix),
w00 AS (SELECT *, CASE WHEN depth <> 0 THEN greatest(CAST(trunc({radius * 0.5}e0/zf+0.5e0) AS INT), 4) END AS w1 FROM zf),
w0 AS (SELECT *, w1 + w1 % 2 AS w FROM w00),
nb AS (SELECT w0.px, w0.py, w0.depth, w0.zf, w, {", ".join(f"coalesce(a{i}.depth, 0) AS v{i}" for i in range(8))} FROM w0 {joins}
       WHERE w0.depth <> 0 AND w0.px BETWEEN w AND {W - 1}-w AND w0.py BETWEEN w AND {H - 1}-w),
gr AS (SELECT px, py, 1/(w*zf)*({g[0]}*0.001e0) AS gx, 1/(w*zf)*({g[1]}*0.001e0) AS gy FROM nb),
gd AS (SELECT px, py, coalesce(gx, 0.0e0) AS gx, coalesce(gy, 0.0e0) AS gy FROM pix LEFT JOIN gr USING (px, py)),
p0 AS (SELECT zf.px, zf.py, r/255.0e0 AS c0, g/255.0e0 AS c1, b/255.0e0 AS c2, zf*(zf.px-32) AS x, zf*(zf.py-24) AS y, zf*54 AS z, zf, gx, gy,
       1/sqrt(gx*gx+gy*gy+1) AS sc, depth FROM zf JOIN gd USING (px, py)),
p1 AS (SELECT *, -(sc*gx*x+sc*gy*y-sc*z) AS qq, (depth <> 0 AND {extra}) AS is_valid FROM p0),
p2 AS (SELECT *, CASE WHEN qq < 0 THEN -sc*gx WHEN qq = 0 THEN 0.0e0 ELSE sc*gx END AS nx_, CASE WHEN qq < 0 THEN -sc*gy WHEN qq = 0 THEN 0.0e0 ELSE sc*gy END AS ny_,
       CASE WHEN qq < 0 THEN sc WHEN qq = 0 THEN -1.0e0 ELSE -sc END AS nz_ FROM p1),
pts AS (SELECT px, py, c0, c1, c2, {", ".join(f"CASE WHEN is_valid THEN {e} ELSE 0.0e0 END AS {n}" for n, e in (("x", "x"), ("y", "y"), ("z", "z"), ("nx", "nx_"), ("ny", "ny_"), ("nz", "nz_"), ("radius_px", f"{radius}e0/zf")))}, is_valid FROM p2)"""


def points(spark, sf, **more):
    return P.make_points(lattice(spark, sf), RADIUS, CAM, W, H, **more)


def _round(*items: str, places: int = 6) -> str:
    return ", ".join(f"round({e}, {places}) + 0.0e0 AS {n}" for n, e in (i.split(" := ") if " := " in i else (i, i) for i in items))


def _pix(name: str, sql: str, columns):
    query(name, over_lattice(f"SELECT px, py, {sql} FROM pix"))(lambda spark, sf: lattice(spark, sf).select("px", "py", *(c.alias(n) for n, c in columns().items())))


def c(name):
    return F.col(name)


_pix("T01", _round("c0 := r/255.0e0", "c1 := g/255.0e0", "c2 := b/255.0e0") + ", " + _round("s0 := CASE WHEN r+g+b > 0.05e0*255 THEN r/CAST(r+g+b AS DOUBLE) ELSE 0 END"), lambda: {f"c{i}": r6(v) for i, v in enumerate(K.from_rgb(K.unit([c("r"), c("g"), c("b")]), "RGB"))} | {"s0": r6(K.from_rgb(K.unit([c("r"), c("g"), c("b")]), "HN")[0])})
_pix("T02", "(depth <> 0 AND px BETWEEN 8 AND 40 AND py BETWEEN 4 AND 30) AS is_valid, (depth <> 0) AS no_roi", lambda: {"is_valid": (c("depth") != 0) & P.in_roi((8, 4, 40, 30)), "no_roi": (c("depth") != 0) & P.in_roi((5, 5, 5, 9))})


@query("T03", over_lattice("SELECT px, py, is_valid FROM pts", points_sql(extra="x BETWEEN -0.3e0 AND 0.3e0 AND y BETWEEN -0.2e0 AND 0.4e0 AND z BETWEEN 0.5e0 AND 1.1e0")))
def t03(spark, sf):
    return points(spark, sf, clip=(-0.3, -0.2, 0.5, 0.3, 0.4, 1.1)).select("px", "py", "is_valid")


_pix("T04", "(depth <> 0) AS is_valid", lambda: {"is_valid": c("depth") != 0})
_ZF = "(depth*0.001e0/54.0e0)"
_pix("T05", _round(f"x := {_ZF}*(px-32)", f"y := {_ZF}*(py-24)", f"z := {_ZF}*54"), lambda: {n: r6(v) for n, v in zip("xyz", G.unproject(c(px), c(py), G.z_over_f(c("depth"), CAM), CAM), strict=True)})
_pix("T06", _round("u := (0.1e0*px)/(1+depth*0.001e0)*54+32", "v := (0.1e0*py)/(1+depth*0.001e0)*54+24"), lambda: {n: r6(v) for n, v in zip("uv", G.project(0.1 * c(px), 0.1 * c(py), 1 + c("depth") * 0.001, CAM), strict=True)})
_pix("T07", _round("m := depth*0.001e0") + ", CAST(trunc((depth*0.0011e0)/0.001e0) AS INT) AS mm", lambda: {"m": r6(G.metres(c("depth"), CAM)), "mm": G.millimetres(c("depth") * 0.0011, CAM)})


@query("T08", "SELECT round(degrees(2*atan(64/108.0e0)), 6) AS fov_x, round(degrees(2*atan(48/108.0e0)), 6) AS fov_y")
def t08(spark, sf):
    x, y = G.field_of_view(CAM, W, H)
    return spark.range(1).select(r6(x).alias("fov_x"), r6(y).alias("fov_y"))


_pix("T09", _round(f"radius_px := CASE WHEN depth <> 0 THEN 0.2e0/{_ZF} ELSE 0 END"), lambda: {"radius_px": r6(F.when(c("depth") != 0, G.radius_px(RADIUS, G.z_over_f(c("depth"), CAM))).otherwise(0.0))})

_FIVE = "s AS (SELECT px, py, depth, " + ", ".join(f"coalesce({f}(depth, {n}) OVER (PARTITION BY py ORDER BY px), 0) AS {v}" for v, f, n in (("v0", "lag", 2), ("v1", "lag", 1), ("v3", "lead", 1), ("v4", "lead", 2))) + " FROM pix)"


def _five(spark, sf):
    line = Window.partitionBy("py").orderBy("px")
    z = lambda x: F.coalesce(x, F.lit(0))
    rows = lattice(spark, sf).select("px", "py", "depth", z(F.lag("depth", 2).over(line)).alias("v0"), z(F.lag("depth", 1).over(line)).alias("v1"), z(F.lead("depth", 1).over(line)).alias("v3"), z(F.lead("depth", 2).over(line)).alias("v4"))
    return rows, [F.col(n) for n in ("v0", "v1", "depth", "v3", "v4")]


@query("T10", over_lattice("SELECT px, py, " + _round(f"d := {_blend('v0', 'v1', 'depth', 'v3', 'v4')}") + " FROM s", _FIVE))
def t10(spark, sf):
    rows, v = _five(spark, sf)
    return rows.select("px", "py", r6(G.difference5(v)).alias("d"))


@query("T11", over_lattice("SELECT px, py, CAST(" + _diff("v0", "v1", "depth", "v3", "v4", "(CASE WHEN abs(depth+v0-2*v1) < abs(v4+depth-2*v3) THEN depth-v0 ELSE v4-depth END)") + " AS INT) AS d FROM s", _FIVE))
def t11(spark, sf):
    rows, v = _five(spark, sf)
    return rows.select("px", "py", G.difference5_simple(v).cast("int").alias("d"))


@query("T12", over_lattice("SELECT px, py, " + _round("gx", "gy") + " FROM gd", points_sql()))
def t12(spark, sf):
    return rounded(P.depth_gradient(lattice(spark, sf), 0.5 * RADIUS, CAM, W, H))


@query("T13", over_lattice("SELECT px, py, " + _round("nx", "ny", "nz") + " FROM pts", points_sql()))
def t13(spark, sf):
    return rounded(points(spark, sf).select("px", "py", "nx", "ny", "nz"))


@query("T14", over_lattice("SELECT px, py, " + _round("gx := nx/nz", "gy := ny/nz", "dx := CASE WHEN nx = 0 AND ny = 0 THEN 1.0e0 ELSE nx/sqrt(nx*nx+ny*ny) END", "dy := CASE WHEN nx = 0 AND ny = 0 THEN 0.0e0 ELSE ny/sqrt(nx*nx+ny*ny) END", "circ := abs(nz)") + " FROM pts WHERE is_valid", points_sql()))
def t14(spark, sf):
    n = [F.col(x) for x in ("nx", "ny", "nz")]
    p = points(spark, sf).where("is_valid")
    return p.select("px", "py", *(r6(v).alias(a) for a, v in zip(("gx", "gy", "dx", "dy", "circ"), [*G.gradient_of(n), *G.gradient_direction(n), G.circularity(n)], strict=True)))


@query("T15", over_lattice("SELECT px, py, " + ", ".join(f"round(CASE WHEN is_valid THEN {n} ELSE {d} END, 6) + 0.0e0 AS {n}" for n, d in (("nx", "0.0e0"), ("ny", "0.0e0"), ("nz", "-1.0e0"))) + " FROM pts", points_sql(0.25)))
def t15(spark, sf):
    return rounded(P.normals(lattice(spark, sf), CAM, W, H, radius=0.25))


@query("T16", over_lattice("SELECT px, py, (is_valid AND NOT (z*(sqrt(5/pi())/54.0e0) > 0.025e0*abs(nz))) AS is_valid FROM pts", points_sql(0.025)))
def t16(spark, sf):
    return P.make_points(lattice(spark, sf), 0.025, CAM, W, H, drop_badly_visible=True).select("px", "py", "is_valid")


@query("T17", over_lattice("SELECT px, py, " + _round("c0", "c1", "c2", "x", "y", "z", "nx", "ny", "nz", "radius_px") + ", is_valid FROM pts", points_sql()))
def t17(spark, sf):
    return rounded(points(spark, sf))


# -- depth ------------------------------------------------------------------------------------------------------------
def _depth(name: str, select: str, more: str, run):
    query(name, over_lattice(select, more))(lambda spark, sf: run(lattice(spark, sf).select("px", "py", "depth")))


_depth("R01", "SELECT px, py, CASE WHEN depth = 0 THEN 1000 ELSE depth END AS depth FROM pix", "", R.fill)


def _nine(centre: int) -> str:
    """Weighted sums over the 3 x 3 neighbourhood."""
    wt = f"CASE WHEN dx = 0 AND dy = 0 THEN {centre} WHEN dx = 0 OR dy = 0 THEN 2 ELSE 1 END"
    return f"""n9 AS (SELECT p.px, p.py, sum(CASE WHEN q.depth <> 0 THEN {wt} ELSE 0 END) AS sw, sum(q.depth * ({wt})) AS sv
FROM pix p, (SELECT CAST(a.i AS INT) AS dx, CAST(b.i AS INT) AS dy FROM range(-1, 2) a(i), range(-1, 2) b(i)) o, pix q WHERE q.px = p.px + o.dx AND q.py = p.py + o.dy GROUP BY 1, 2),
s AS (SELECT pix.px, pix.py, depth, CAST(CASE WHEN sw > 0 THEN sv // sw ELSE 0 END AS INT) AS m, (pix.px BETWEEN 1 AND {W - 2} AND pix.py BETWEEN 1 AND {H - 2}) AS inn FROM pix JOIN n9 USING (px, py))"""


_depth("R02", "SELECT px, py, CASE WHEN depth = 0 AND inn THEN m ELSE depth END AS depth FROM s", _nine(0), lambda d: R.grow(d, W, H))
_depth("R05", "SELECT px, py, CASE WHEN inn THEN m ELSE depth END AS depth FROM s", _nine(4), lambda d: R.smooth9(d, W, H))
_depth(
    "R03",
    "SELECT i.px, i.py, CAST(CASE WHEN NOT ok AND pl IS NOT NULL AND nf IS NOT NULL THEN CASE WHEN pl > nf THEN ps // pn ELSE ns // nn END ELSE depth END AS INT) AS depth FROM i JOIN g USING (py, run)",
    """e AS (SELECT *, CASE WHEN (depth <> 0) = lag(depth <> 0) OVER (PARTITION BY py ORDER BY px) THEN 0 ELSE 1 END AS fresh FROM pix),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY py ORDER BY px) AS run FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY py, run ORDER BY px) AS fl, row_number() OVER (PARTITION BY py, run ORDER BY px DESC) AS fr FROM i),
u AS (SELECT py, run, bool_or(depth <> 0) AS ok, arg_min(depth, px) AS f, arg_max(depth, px) AS l, sum(depth) FILTER (WHERE fl <= 4) AS sl, sum(depth) FILTER (WHERE fr <= 4) AS sr, least(count(*), 4) AS n FROM k GROUP BY 1, 2),
g AS (SELECT py, run, ok, lag(l) OVER b AS pl, lead(f) OVER b AS nf, lag(sr) OVER b AS ps, lag(n) OVER b AS pn, lead(sl) OVER b AS ns, lead(n) OVER b AS nn FROM u WINDOW b AS (PARTITION BY py ORDER BY run))""",
    R.repair,
)


@query(
    "R04",
    over_lattice(
        "SELECT py, CAST(floor(avg(depth)) AS BIGINT) AS constant, round(arg_min(depth, i)+(arg_min(depth, i)-arg_max(depth, i))/CAST(greatest(max(i)-min(i), 1) AS DOUBLE)*3, 6) + 0.0e0 AS two_point, "
        "round(coalesce(regr_intercept(CAST(depth AS DOUBLE), CAST(i AS DOUBLE))+regr_slope(CAST(depth AS DOUBLE), CAST(i AS DOUBLE))*-3, -1), 6) + 0.0e0 AS least_squares FROM s WHERE i < 4 GROUP BY py",
        "s AS (SELECT py, depth, CAST(row_number() OVER (PARTITION BY py ORDER BY px) - 1 AS INT) AS i FROM pix WHERE depth <> 0)",
    ),
)
def r04(spark, sf):
    """Each line's first four valid depths, carried on two pixels to their left."""
    rows = lattice(spark, sf).where("depth != 0").select("py", F.col("depth").alias("v"), (F.row_number().over(Window.partitionBy("py").orderBy("px")) - 1).alias("i"))
    out = R.extrapolate(rows.where("i < 4"), ["py"], F.lit(2))
    return out.select("py", "constant", r6(F.col("two_point")).alias("two_point"), r6(F.coalesce("least_squares", F.lit(-1.0))).alias("least_squares"))


def _tap(a: str, b: str, cc: str, d: str, e: str) -> str:
    left, right, minus, plus = f"({a} = 0 OR {b} = 0)", f"({d} = 0 OR {e} = 0)", f"(4*{cc}+3*{b}+{a}) // 8", f"(4*{cc}+3*{d}+{e}) // 8"
    return f"(CASE WHEN {left} AND {right} THEN 0 WHEN {left} THEN {plus} WHEN {right} THEN {minus} WHEN abs({e}-{cc}) < abs({a}-{cc}) THEN {plus} ELSE {minus} END)"


def _along(src: str, axis: str, size: int) -> str:
    w = f"OVER (PARTITION BY {'py' if axis == 'px' else 'px'} ORDER BY {axis})"
    v = [f"lag(depth, 2) {w}", f"lag(depth, 1) {w}", "depth", f"lead(depth, 1) {w}", f"lead(depth, 2) {w}"]
    return f"(SELECT px, py, CAST(CASE WHEN {axis} BETWEEN 4 AND {size - 5} THEN {_tap('v0', 'v1', 'v2', 'v3', 'v4')} ELSE v2 END AS INT) AS depth FROM (SELECT px, py, {', '.join(f'{e} AS v{i}' for i, e in enumerate(v))} FROM {src}))"


_depth("R06", "SELECT * FROM s", f"sy AS {_along('pix', 'py', H)}, s AS {_along('sy', 'px', W)}", lambda d: R.smooth(d, W, H))
