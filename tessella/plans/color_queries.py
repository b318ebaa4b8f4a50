"""Colour queries on the pixel lattice; a second colour, where one is needed, is the first with its channels turned."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessella.functions import color as K
from tessella.operators.stencil import shifted
from tessella.plans.fixtures import lattice, over_lattice
from tessella.plans.registry import query, r6


def _q(name: str, sql: str, columns, more: str = ""):
    def run(spark, sf):
        rgb = [F.col(c) for c in "rgb"]
        return lattice(spark, sf).select("px", "py", *(c.alias(n) for n, c in columns(rgb, [F.col(c) for c in "brg"]).items()))

    query(name, over_lattice(f"SELECT px, py, {sql} FROM {'s' if more else 'pix'}", more))(run)


def _names(prefix: str, cols) -> dict:
    return {f"{prefix}{i}": c for i, c in enumerate(cols)}


def _r6(cols: dict) -> dict:
    return {n: r6(c) for n, c in cols.items()}


def _round(**items) -> str:
    return ", ".join(f"round({e}, 6) + 0.0e0 AS {n}" for n, e in items.items())


# -- DuckDB texts -----------------------------------------------------------------------------------------------------
def _hue8(r, g, b):
    top, q6 = f"greatest({r},{g},{b})", f"(6*(greatest({r},{g},{b})-least({r},{g},{b})))"
    return (
        f"(CASE WHEN {q6} = 0 THEN 0 WHEN {top} = {r} THEN CASE WHEN {g} >= {b} THEN (({g}-{b})*256) // {q6} "
        f"WHEN 256 - (({b}-{g})*256) // {q6} = 256 THEN 255 ELSE 256 - (({b}-{g})*256) // {q6} END "
        f"WHEN {top} = {g} THEN CASE WHEN {b} >= {r} THEN 85 + (({b}-{r})*256) // {q6} ELSE 85 - (({r}-{b})*256) // {q6} END "
        f"ELSE CASE WHEN {r} >= {g} THEN 171 + (({r}-{g})*256) // {q6} ELSE 171 - (({g}-{r})*256) // {q6} END END)"
    )


def _hsv8(r, g, b):
    top, q = f"greatest({r},{g},{b})", f"(greatest({r},{g},{b})-least({r},{g},{b}))"
    return _hue8(r, g, b), f"(CASE WHEN {top} = 0 THEN 0 ELSE least(255, ({q}*256) // {top}) END)", top


def _hsl8(r, g, b):
    p, q = f"(greatest({r},{g},{b})+least({r},{g},{b}))", f"(greatest({r},{g},{b})-least({r},{g},{b}))"
    s = f"(CASE WHEN {q} = 0 THEN 0 WHEN {p} <= 255 THEN least(255, ({q}*256) // {p}) ELSE ({q}*256) // (512-{p}) END)"
    return _hue8(r, g, b), s, f"({p} // 2)"


def _xyz(r, g, b):
    return tuple(f"({m[0]:.7f}e0*{r}+{m[1]:.7f}e0*{g}+{m[2]:.7f}e0*{b})" for m in K.RGB_TO_XYZ)


_EPS, _KAPPA = "(216.0e0/24389.0e0)", "(24389.0e0/27.0e0)"
_WHITE = "1.0e0", "(0.312713e0/0.329016e0)", "((1.0e0-0.312713e0-0.329016e0)/0.329016e0)"


def _lab(x, y, z):
    f = [f"(CASE WHEN {v}/{w} <= {_EPS} THEN (841.0e0/108.0e0)*({v}/{w})+(4.0e0/29.0e0) ELSE pow({v}/{w}, 0.33333e0) END)" for v, w in zip((x, y, z), _WHITE, strict=True)]
    return f"(116*{f[1]}-16)", f"(500*({f[0]}-{f[1]}))", f"(200*({f[1]}-{f[2]}))"


_U = "(r/255.0e0)", "(g/255.0e0)", "(b/255.0e0)"

_HSV = "greatest(u,v,w) AS mx, greatest(u,v,w)-least(u,v,w) AS dl"
_q(
    "K01",
    _round(h="h", s="s", v="mx", r1="CASE i WHEN 0 THEN mx WHEN 1 THEN kq WHEN 2 THEN kp WHEN 3 THEN kp WHEN 4 THEN kt ELSE mx END", g1="CASE i WHEN 0 THEN kt WHEN 1 THEN mx WHEN 2 THEN mx WHEN 3 THEN kq ELSE kp END", b1="CASE i WHEN 0 THEN kp WHEN 1 THEN kp WHEN 2 THEN kt WHEN 3 THEN mx WHEN 4 THEN mx ELSE kq END"),
    lambda c, d: _r6(dict(zip("hsv", K.rgb_to_hsv(K.unit(c)), strict=True)) | dict(zip(("r1", "g1", "b1"), K.hsv_to_rgb(K.rgb_to_hsv(K.unit(c))), strict=True))),
    f"""u AS (SELECT px, py, r/255.0e0 AS u, g/255.0e0 AS v, b/255.0e0 AS w FROM pix), m AS (SELECT *, {_HSV} FROM u),
n AS (SELECT *, CASE WHEN dl = 0 THEN 0.0e0 WHEN u = mx THEN (v-w)/dl WHEN v = mx THEN 2+(w-u)/dl ELSE 4+(u-v)/dl END AS h6, CASE WHEN dl = 0 THEN 0.0e0 ELSE dl/mx END AS s FROM m),
o AS (SELECT *, (CASE WHEN h6 < 0 THEN h6+6 ELSE h6 END)/6 AS h FROM n),
p AS (SELECT *, trunc(h*6) AS wh, h*6-trunc(h*6) AS f FROM o),
s AS (SELECT *, CAST(wh AS INT) % 6 AS i, mx*(1-s) AS kp, mx*(1-s*f) AS kq, mx*(1-(1-f)*s) AS kt FROM p)""",
)
_q(
    "K02",
    "CAST(h AS INT) AS h, CAST(s AS INT) AS s, CAST(v AS INT) AS v, CAST(CASE i WHEN 0 THEN v WHEN 1 THEN kq WHEN 2 THEN kp WHEN 3 THEN kp WHEN 4 THEN kt ELSE v END AS INT) AS r1, "
    "CAST(CASE i WHEN 0 THEN kt WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN kq ELSE kp END AS INT) AS g1, CAST(CASE i WHEN 0 THEN kp WHEN 1 THEN kp WHEN 2 THEN kt WHEN 3 THEN v WHEN 4 THEN v ELSE kq END AS INT) AS b1",
    lambda c, d: dict(zip("hsv", K.rgb_to_hsv8(c), strict=True)) | dict(zip(("r1", "g1", "b1"), K.hsv_to_rgb8(K.rgb_to_hsv8(c)), strict=True)),
    f"""u AS (SELECT px, py, {", ".join(f"{e} AS {n}" for n, e in zip("hsv", _hsv8("r", "g", "b"), strict=True))} FROM pix),
w AS (SELECT *, CASE WHEN h < 43 THEN 0 WHEN h < 85 THEN 1 WHEN h < 128 THEN 2 WHEN h < 171 THEN 3 WHEN h < 213 THEN 4 ELSE 5 END AS i,
  CASE WHEN h < 43 THEN h*255//42 WHEN h < 85 THEN (h-43)*255//43 WHEN h < 128 THEN (h-85)*255//42 WHEN h < 171 THEN (h-128)*255//43 WHEN h < 213 THEN (h-171)*255//42 ELSE (h-213)*255//43 END AS f FROM u),
s AS (SELECT *, (v*(255-s)) // 256 AS kp, CAST(floor((v*(65025-s*f))/65536.0e0) AS INT) AS kq, CAST(floor((v*(65025-(255-f)*s))/65536.0e0) AS INT) AS kt FROM w)""",
)


def _hsl_back(t):
    return f"CASE WHEN {t} < 1 THEN kp+{t}*(kq-kp) WHEN {t} < 3 THEN kq WHEN {t} < 4 THEN kp+(4-{t})*(kq-kp) ELSE kp END"


_TURN = "(CASE WHEN h6+2 > 6 THEN h6-4 ELSE h6+2 END)", "h6", "(CASE WHEN h6-2 < 0 THEN h6+4 ELSE h6-2 END)"
_q(
    "K03",
    "CAST(h AS INT) AS h, CAST(s AS INT) AS s, CAST(l AS INT) AS l, " + ", ".join(f"CAST(trunc(({_hsl_back(t)})*255) AS INT) AS {n}" for n, t in zip(("r1", "g1", "b1"), _TURN, strict=True)),
    lambda c, d: dict(zip("hsl", K.rgb_to_hsl8(c), strict=True)) | dict(zip(("r1", "g1", "b1"), K.hsl_to_rgb8(K.rgb_to_hsl8(c)), strict=True)),
    f"""u AS (SELECT px, py, {", ".join(f"{e} AS {n}" for n, e in zip("hsl", _hsl8("r", "g", "b"), strict=True))} FROM pix),
w AS (SELECT *, CASE WHEN l/256.0e0 < 0.5 THEN l/256.0e0*(1+s/256.0e0) ELSE l/256.0e0*(1-s/256.0e0)+s/256.0e0 END AS kq, h/256.0e0*6 AS h6 FROM u),
s AS (SELECT *, 2*(l/256.0e0)-kq AS kp FROM w)""",
)
_BACK = [f"least(1.0e0, greatest(0.0e0, {m[0]:.7f}e0*x+{m[1]:.7f}e0*y+{m[2]:.7f}e0*z))" for m in K.XYZ_TO_RGB]
_q(
    "K04",
    _round(x="x", y="y", z="z", r1=_BACK[0], g1=_BACK[1], b1=_BACK[2], xc="CASE WHEN x+y+z > 0 THEN x/(x+y+z) END"),
    lambda c, d: _r6(dict(zip("xyz", K.rgb_to_xyz(K.unit(c)), strict=True)) | dict(zip(("r1", "g1", "b1"), K.xyz_to_rgb(K.rgb_to_xyz(K.unit(c))), strict=True)) | {"xc": F.when(sum(K.rgb_to_xyz(K.unit(c))) > 0, K.xyz_to_chromaticity(K.rgb_to_xyz(K.unit(c)))[0])}),
    f"s AS (SELECT px, py, {', '.join(f'{e} AS {n}' for n, e in zip('xyz', _xyz(*_U), strict=True))} FROM pix)",
)
_q(
    "K05",
    _round(
        l="l", a="a", b1="bb",
        x="(CASE WHEN fx*fx*fx > 216.0e0/24389.0e0 THEN fx*fx*fx ELSE 116.0e0/(24389.0e0/27.0e0)*fx-16.0e0/(24389.0e0/27.0e0) END)",
        y="(CASE WHEN l > (216.0e0/24389.0e0)*(24389.0e0/27.0e0) THEN fy*fy*fy ELSE l/(24389.0e0/27.0e0) END)*(0.312713e0/0.329016e0)",
        z="(CASE WHEN fz*fz*fz > 216.0e0/24389.0e0 THEN fz*fz*fz ELSE 116.0e0/(24389.0e0/27.0e0)*fz-16.0e0/(24389.0e0/27.0e0) END)*((1.0e0-0.312713e0-0.329016e0)/0.329016e0)",
    ),
    lambda c, d: _r6(dict(zip(("l", "a", "b1"), K.rgb_to_lab(K.unit(c)), strict=True)) | dict(zip("xyz", K.lab_to_xyz(K.rgb_to_lab(K.unit(c))), strict=True))),
    f"""u AS (SELECT px, py, {', '.join(f'{e} AS {n}' for n, e in zip('xyz', _xyz(*_U), strict=True))} FROM pix),
w AS (SELECT px, py, {', '.join(f'{e} AS {n}' for n, e in zip(('l', 'a', 'bb'), _lab('x', 'y', 'z'), strict=True))} FROM u),
s AS (SELECT *, (l+16)/116.0e0 AS fy, a/500.0e0+(l+16)/116.0e0 AS fx, (l+16)/116.0e0-bb/200.0e0 AS fz FROM w)""",
)
_q(
    "K06",
    _round(h0="h0", h1="h1", h2="h2", r1="CASE WHEN h2 > 0 THEN h0*(h2*10) ELSE 0 END", b1="CASE WHEN h2 > 0 THEN h2*10-h0*(h2*10)-h1*(h2*10) ELSE 0 END"),
    lambda c, d: _r6(_names("h", K.rgb_to_hn(K.unit(c))) | {"r1": K.hn_to_rgb(K.rgb_to_hn(K.unit(c)))[0], "b1": K.hn_to_rgb(K.rgb_to_hn(K.unit(c)))[2]}),
    """u AS (SELECT px, py, r/255.0e0 AS u, g/255.0e0 AS v, r/255.0e0+g/255.0e0+b/255.0e0 AS a FROM pix),
s AS (SELECT px, py, CASE WHEN a > 0.05 THEN u/a ELSE 0 END AS h0, CASE WHEN a > 0.05 THEN v/a ELSE 0 END AS h1, CASE WHEN a > 0.05 THEN a*0.1e0 ELSE 0 END AS h2 FROM u)""",
)


def _sq(*pairs):
    return "(" + "+".join(f"({a}-{b})*({a}-{b})" for a, b in pairs) + ")"


_q(
    "K07",
    _round(
        n1="(abs(r-b)+abs(g-r)+abs(b-g))/255.0e0",
        n2=_sq("rb", "gr", "bg") + "/255.0e0/255.0e0",
        hsv2=_sq(("h1", "h2"), ("s1", "s2"), ("v1", "v2")) + "/255.0e0/255.0e0",
        cone="(v1/255.0e0)*(v1/255.0e0)*((s1/255.0e0)*(s1/255.0e0)+1)+(v2/255.0e0)*(v2/255.0e0)*((s2/255.0e0)*(s2/255.0e0)+1)+2*(v1/255.0e0)*(v2/255.0e0)*((s1/255.0e0)*(s2/255.0e0)*cos((h1-h2)*(2*pi()))+1)",
        dbl=_sq(("x1", "x2"), ("y1", "y2"), ("z1", "z2")),
        scaled=f"4*{_sq(('x1', 'x2'), ('y1', 'y2'))}+0.0625e0*{_sq(('z1', 'z2'))}",
        lab=_sq(("a1", "a2"), ("b1", "b2"), ("c1", "c2")),
        art="pow(fl+(1-fl)*hi, 2)",
    ),
    lambda c, d: _r6({"n1": K.rgb_norm1(c, d), "n2": K.rgb_norm2(c, d), "hsv2": K.hsv_norm2(c, d), "cone": K.hsv_cone(c, d), "dbl": K.hsl_double_cone(c, d), "scaled": K.hsl_double_cone_scaled(c, d), "lab": K.lab_distance(c, d), "art": K.no_artefacts(c, d)}),
    "t1 AS (SELECT px, py, r, g, b, "
    + ", ".join(
        f"{e} AS {n}{k}"
        for k, c in ((1, ("r", "g", "b")), (2, ("b", "r", "g")))
        for n, e in [*zip("hsv", _hsv8(*c), strict=True), *zip(("lh", "ls", "ll"), _hsl8(*c), strict=True), *zip(("cx", "cy", "cz"), _xyz(*(f"({v}/255.0e0)" for v in c)), strict=True)]
    )
    + " FROM pix),\nt2 AS (SELECT *, "
    + ", ".join(f"least((CASE WHEN ll{k} < 128 THEN ll{k} ELSE 255-ll{k} END)*2/255.0e0, ls{k}/255.0e0) AS ra{k}, lh{k}/255.0e0*(2*pi()) AS an{k}, ll{k}/255.0e0 AS z{k}, " + ", ".join(f"{e} AS {n}{k}" for n, e in zip("abc", _lab(f"cx{k}", f"cy{k}", f"cz{k}"), strict=True)) for k in (1, 2))
    + " FROM (SELECT * RENAME (r AS r_, g AS g_, b AS b_) FROM t1)),\nt3 AS (SELECT *, ra1*cos(an1) AS x1, ra1*sin(an1) AS y1, ra2*cos(an2) AS x2, ra2*sin(an2) AS y2 FROM t2),\n"
    + "s AS (SELECT * RENAME (r_ AS r, g_ AS g, b_ AS b), 0.5e0*sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) AS fl, (0.5e0*(z1-z2))*(0.5e0*(z1-z2)) AS hi FROM t3)",
)


def _mix(name: str, x: str, low: str, high: str, k: int) -> str:
    """DuckDB text of one channel of a palette."""
    v = [K.NAMED[n][k] for n in K.PALETTES[name]]
    n, p = len(v), f"(({x}-{low})/({high}-{low}))"
    i = f"CAST(least(greatest(trunc({p}*{n - 1}), 0), {n - 2}) AS INT)"
    lst = "[" + ",".join(f"{a}e0" for a in v) + "]"
    return f"(CASE WHEN {p} < 0 THEN {v[0]}e0 WHEN {p} >= 1 THEN {v[-1]}e0 ELSE (1-({p}*{n - 1}-{i}))*{lst}[{i}+1]+({p}*{n - 1}-{i})*{lst}[{i}+2] END)"


_X = "(r/200.0e0-0.1e0)"
_q(
    "K08",
    _round(**{f"{p}_{k}": _mix(p, _X, "0.0e0", "1.0e0", k) for p in K.PALETTES for k in range(3)}),
    lambda c, d: _r6({f"{p}_{k}": v for p in K.PALETTES for k, v in enumerate(K.palette(c[0] / 200.0 - 0.1, p))}),
)
_q(
    "K09",
    _round(grey="least(1.0e0, greatest(0.0e0, (r-40)/160.0e0))", **{f"i{k}": _mix("black_blue_red_yellow_white", "(g/255.0e0)", "0.0e0", "1.0e0", k) for k in range(3)}, **{f"v{k}": _mix("black_blue_red_yellow_white", "(1-g/255.0e0)", "0.0e0", "1.0e0", k) for k in range(3)}, **{f"p{k}": _mix("minus_plus", "(b/128.0e0-1)", "(-1.0e0)", "1.0e0", k) for k in range(3)}, **{f"c{k}": _mix("black_blue_red_yellow_white", "(CASE WHEN r < 20 THEN 0.0e0 ELSE (r-20)/180.0e0 END)", "0.0e0", "1.0e0", k) for k in range(3)}, **{f"d{k}": _mix("blue_red_yellow_white", "((2-g/100.0e0)/2.0e0)", "0.0e0", "1.0e0", k) for k in range(3)}),
    lambda c, d: _r6({"grey": K.grey(c[0], 40, 200)[0]} | _names("i", K.intensity(c[1] / 255.0)) | _names("v", K.inverse_intensity(c[1] / 255.0)) | _names("p", K.plus_minus(c[2] / 128.0 - 1)) | _names("c", K.count_color(c[0], 20, 200)) | _names("d", K.distance_color(c[1] / 100.0))),
)
_PK = "(CAST(r AS BIGINT)+g*256+b*65536+CAST(255 AS BIGINT)*16777216)"
_q(
    "K10",
    f"{_PK} AS v, CAST({_PK} & 255 AS INT) AS r1, CAST(({_PK} >> 8) & 255 AS INT) AS g1, CAST(({_PK} >> 16) & 255 AS INT) AS b1, CAST({_PK} >> 24 AS INT) AS a1, CAST(r AS BIGINT)+g*256+b*65536+CAST(g AS BIGINT)*16777216 AS w, {_sq('rb', 'gr', 'bg')} AS dd",
    lambda c, d: {"v": K.pack(c), **dict(zip(("r1", "g1", "b1", "a1"), K.unpack(K.pack(c)), strict=True)), "w": K.set_alpha(K.pack(c), c[1]), "dd": K.squared_distance8(c, d)},
)


@query(
    "K11",
    over_lattice(
        "SELECT px, py, CAST(trunc(255*least(1.0e0, greatest(0.0e0, (depth-800)/400.0e0))) AS INT) AS g8, "
        "CASE WHEN px BETWEEN 1 AND 62 AND py BETWEEN 1 AND 46 THEN (4*depth+u+d+l+r_) // 8 ELSE depth END AS smooth FROM s",
        "s AS (SELECT px, py, depth, lag(depth) OVER (PARTITION BY px ORDER BY py) AS u, lead(depth) OVER (PARTITION BY px ORDER BY py) AS d, lag(depth) OVER (PARTITION BY py ORDER BY px) AS l, lead(depth) OVER (PARTITION BY py ORDER BY px) AS r_ FROM pix)",
    ),
)
def k11(spark, sf):
    """Colourised depth and the five-point smoothing (4, 1, 1, 1, 1) / 8."""
    n = shifted(lattice(spark, sf).select("px", "py", "depth"), "depth", [(0, -1), (0, 1), (-1, 0), (1, 0)])
    total = 4 * F.col("depth") + sum(F.col(f"depth_{i}") for i in range(4))
    inner = F.col("px").between(1, 62) & F.col("py").between(1, 46)
    return n.select("px", "py", K.to_pixel(K.grey(F.col("depth"), 800, 1200))[0].alias("g8"), F.when(inner, F.floor(total / 8).cast("int")).otherwise(F.col("depth")).alias("smooth"))


_GX, _GY = "least(1.0e0, greatest(0.0e0, 0.5e0+(r/255.0e0-0.5e0)))", "least(1.0e0, greatest(0.0e0, 0.5e0+(g/255.0e0-0.5e0)))"
_DM = "(depth*0.002e0)"
_q(
    "K14",
    _round(**{f"a{k}": _mix("black_white", "(b/128.0e0)", "0.0e0", "1.0e0", k) for k in range(3)}, **{f"m{k}": _mix("minus_plus", "((r-g)/100.0e0)", "(-1.0e0)", "1.0e0", k) for k in range(3)}, g0=f"0.5e0*(1-{_GX}+{_GY})", g1=f"0.5e0*(2-{_GX}-{_GY})", dr=f"CASE WHEN {_DM} = 0 THEN 0 WHEN {_DM} > 2.5 THEN 0 ELSE {_mix('blue_red_yellow_green', _DM, '0.75e0', '2.5e0', 0)} END"),
    lambda c, d: _r6(_names("a", K.palette(c[2] / 128.0, "black_white")) | _names("m", K.plus_minus((c[0] - c[1]) / 100.0)) | {"g0": K.gradient_color(c[0] / 255.0 - 0.5, c[1] / 255.0 - 0.5)[0], "g1": K.gradient_color(c[0] / 255.0 - 0.5, c[1] / 255.0 - 0.5)[1], "dr": K.depth_color(F.col("depth") * 0.002)[0]}),
)


@query("K15", over_lattice("SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(count(*) FILTER (WHERE sel) AS BIGINT) AS n_sel, CAST(count(*) FILTER (WHERE NOT sel) AS BIGINT) AS n_off FROM (SELECT (px % 3 = 0) AS sel FROM pix)"))
def k15(spark, sf):
    """A selection mask as a boolean column, with its counts; no mask selects all."""
    sel = lattice(spark, sf).select((F.col("px") % 3 == 0).alias("sel"))
    return sel.agg(F.count(F.lit(1)).alias("n_all"), F.count_if("sel").alias("n_sel"), F.count_if(~F.col("sel")).alias("n_off"))


