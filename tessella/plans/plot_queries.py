"""Colours by mode, colour tables and painting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import plotting as L
from tessella.functions.rng import uniform_sql
from tessella.plans.cluster_queries import ONE_SQL, one_step
from tessella.plans.color_queries import _mix
from tessella.plans.fixtures import H, W, over_lattice
from tessella.plans.point_queries import points, points_sql
from tessella.plans.registry import query, r6
from tessella.scratch import cut

HOT = "black_blue_red_yellow_white"
_GX, _GY = "least(1.0e0, greatest(0.0e0, 0.5e0+nx/nz))", "least(1.0e0, greatest(0.0e0, 0.5e0+ny/nz))"


def _valid(yes: str, no: str) -> str:
    return f"CASE WHEN is_valid THEN {yes} ELSE {no} END"


_FAR = ("0.0e0", "1/(1+(z-2.5e0)/0.5e0)", "0.0e0")
_GREY = "128/255.0e0"
POINT_SQL = {
    "uni_black": ["0.0e0"] * 3,
    "uni_white": ["1.0e0"] * 3,
    "valid": [_valid("0.0e0", "1.0e0"), _valid(_GREY, _GREY), _valid("0.0e0", _GREY)],
    "color": ["c0", "c1", "c2"],
    "depth": [f"CASE WHEN z = 0 THEN 0.0e0 WHEN z > 2.5e0 THEN {_FAR[k]} ELSE {_mix('blue_red_yellow_green', 'z', '0.75e0', '2.5e0', k)} END" for k in range(3)],
    "gradient": [_valid(f"0.5e0*({e})", "0.0e0") for e in (f"1-{_GX}+{_GY}", f"2-{_GX}-{_GY}", f"{_GX}+{_GY}")],
    "gradient_nz": [_valid("least(1.0e0, abs(nz))", "0.0e0")] * 3,
    "cluster_radius": [_valid(_mix(HOT, "radius_px", "4.0e0", "20.0e0", k), _GREY) for k in range(3)],
    "density": [_valid(_mix(HOT, "(1.0e0/(3.1415e0*radius_px*radius_px))", "0.0e0", "0.025e0", k), _GREY) for k in range(3)],
}
SHAPE_SQL = {  # a made-up value of every shape column, v, so that SQL can say the same
    m: [_mix(p, "v" if m != "area_quotient" else "abs(v-1.0e0)", low, high, k) for k in range(3)]
    for m, p, low, high in (
        ("thickness", HOT, "0.0e0", "0.05e0"), ("eccentricity", HOT, "0.0e0", "1.0e0"), ("shape_0", HOT, "0.5e0", "3.5e0"),
        ("shape_x", "minus_plus", "(-1.0e0)", "1.0e0"), ("shape_y", "minus_plus", "(-1.0e0)", "1.0e0"),
        *((f"shape_{a}", "minus_plus", "(-10.0e0)", "10.0e0") for a in ("xy", "xx", "yy")),
        ("area_quotient", HOT, "0.0e0", "1.0e0"), ("coverage_error", HOT, "0.0e0", "1.0e0"),
    )
}


def _union(modes: dict[str, list[str]], source: str) -> str:
    return "\nUNION ALL ".join(f"SELECT '{m}' AS mode, px, py, " + ", ".join(f"round({e}, 6) + 0.0e0 AS {n}" for n, e in zip("rgb", v, strict=True)) + f" FROM {source}" for m, v in modes.items())


@query("K12", over_lattice(_union(POINT_SQL, "pts") + "\nUNION ALL " + _union(SHAPE_SQL, "(SELECT *, c0*4-2 AS v FROM pts)"), points_sql()))
def k12(spark, sf):
    """All 19 modes: nine of points, ten of cluster shapes."""
    pts = cut(points(spark, sf).withColumns({m: F.col("c0") * 4 - 2 for m in SHAPE_SQL}), "points")
    each = [(m, L.point_color(m)) for m in POINT_SQL] + [(m, L.cluster_color(m)) for m in SHAPE_SQL]
    rows = [pts.select(F.lit(m).alias("mode"), "px", "py", *(r6(c).alias(n) for n, c in zip("rgb", v, strict=True))) for m, v in each]
    return reduce(DataFrame.unionByName, rows)


@query(
    "K13",
    f"""WITH i AS (SELECT i AS id, ((i - i % 3)*255) // 102 AS h, [255, 171, 85][i % 3 + 1] AS v, {uniform_sql(42, "'shuffle'", 'i')} AS u FROM range(102) t(i)),
w AS (SELECT *, CASE WHEN h < 43 THEN 0 WHEN h < 85 THEN 1 WHEN h < 128 THEN 2 WHEN h < 171 THEN 3 WHEN h < 213 THEN 4 ELSE 5 END AS i,
  CASE WHEN h < 43 THEN h*255//42 WHEN h < 85 THEN (h-43)*255//43 WHEN h < 128 THEN (h-85)*255//42 WHEN h < 171 THEN (h-128)*255//43 WHEN h < 213 THEN (h-171)*255//42 ELSE (h-213)*255//43 END AS f FROM i),
s AS (SELECT *, (v*0) // 256 AS kp, CAST(floor((v*(65025-255*f))/65536.0e0) AS INT) AS kq, CAST(floor((v*(65025-(255-f)*255))/65536.0e0) AS INT) AS kt FROM w)
SELECT row_number() OVER (ORDER BY u, id) - 1 AS color_id, CAST(CASE i WHEN 0 THEN v WHEN 1 THEN kq WHEN 2 THEN kp WHEN 3 THEN kp WHEN 4 THEN kt ELSE v END AS INT) AS r,
       CAST(CASE i WHEN 0 THEN kt WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN kq ELSE kp END AS INT) AS g, CAST(CASE i WHEN 0 THEN kp WHEN 1 THEN kp WHEN 2 THEN kt WHEN 3 THEN v WHEN 4 THEN v ELSE kq END AS INT) AS b FROM s""",
)
def k13(spark, sf):
    """100 colours; the order is drawn by the counter-based generator."""
    return L.random_colors(spark, 100)


_CENTRE = "SELECT cluster_id, px, py, c0, c1, c2 FROM cl1"


@query(
    "U06",
    over_lattice(
        "SELECT 'pixels' AS what, lab.px, lab.py, " + ", ".join(f"round(c{k}, 6) + 0.0e0 AS {n}" for k, n in enumerate("rgb")) + " FROM lab JOIN cl1 ON cluster_id = label "
        f"UNION ALL SELECT 'centres', x, y, " + ", ".join(f"round(c{k}, 6) + 0.0e0" for k in range(3)) + f" FROM (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, c0, c1, c2, row_number() OVER (PARTITION BY x, y ORDER BY cluster_id DESC) AS n "
        f"FROM ({_CENTRE}), range({W}) a(x), range({H}) b(y) WHERE abs(x-px) <= 1 AND abs(y-py) <= 1 AND px BETWEEN 0 AND {W - 1} AND py BETWEEN 0 AND {H - 1}) WHERE n = 1",
        ONE_SQL,
    ),
)
def u06(spark, sf):
    """A colour function of the caller on clusters: their pixels, and squares around their centres."""
    _, labels, centres = one_step(spark, sf)
    own = L.cluster_color("color")  # any list of three columns
    parts = {"pixels": L.paint_labels(labels, centres, own), "centres": L.paint_squares(centres, own, 1, W, H)}
    out = [p.select(F.lit(n).alias("what"), "px", "py", *(r6(F.col(c)).alias(c) for c in "rgb")) for n, p in parts.items()]
    return out[0].unionByName(out[1])
