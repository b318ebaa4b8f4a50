"""Scalar mathematics on small numbers of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import mathx as M
from tessella.plans.fixtures import numbers, over_numbers
from tessella.plans.registry import query, r6

KEY = ("q", "d", "t")


def _math(name: str, sql: str, columns):
    def run(spark, sf):
        return numbers(spark, sf).select(*KEY, *(c.alias(n) for n, c in columns(*map(F.col, "qdtxyz")).items()))

    query(name, over_numbers(f"SELECT q, d, t, {sql} FROM v"))(run)


def _r(*items: str) -> str:
    return ", ".join(f"round({e}, 6) + 0.0e0 AS {n}" for n, e in (i.split(" := ") for i in items))


_math("V01", _r("sq := x*x", "sd := (x-y)*(x-y)", "isq := 1/sqrt(q+0.5e0)"), lambda q, d, t, x, y, z: dict(sq=r6(M.square(x)), sd=r6(M.square_diff(x, y)), isq=r6(M.inverse_sqrt(q + 0.5))))
_math(
    "V02",
    "CAST(floor(q/4.0e0+0.5e0) AS BIGINT) AS up, CAST(ceil((q-25)/4.0e0-0.5e0) AS BIGINT) AS down, " + _r("digits := floor(x*100.0e0+0.5e0)/100.0e0"),
    lambda q, d, t, x, y, z: dict(up=M.round_half_up(q / 4.0),
    down=M.round_half_down((q - 25) / 4.0),
    digits=r6(M.round_digits(x, 2))),
)
_math(
    "V03",
    "CAST((q-25) % 7 AS INT) AS rest, CAST((q-25) // 7 AS BIGINT) AS whole, " + _r("mixed := (1-z)*x+z*y", "sn := sin(x)", "cs := cos(x)", "ac := CASE WHEN y >= 1 THEN 0.0e0 WHEN y <= -1 THEN pi() ELSE acos(y) END"),
    lambda q, d, t, x, y, z: dict(rest=M.split(q - 25, 7)[0],
    whole=M.split(q - 25, 7)[1],
    mixed=r6(M.interpolate(z, x, y)),
    sn=r6(M.sin_cos(x)[0]),
    cs=r6(M.sin_cos(x)[1]),
    ac=r6(M.protected_acos(y))),
)
_math("V04", ", ".join(f"CAST(t*{'*'.join(['t'] * (n - 1))} AS BIGINT) AS p{n}" for n in range(2, 10)), lambda q, d, t, x, y, z: dict(**{f"p{n}": M.power(t.cast("long"), n) for n in range(2, 10)}))
_math(
    "V05",
    _r("d2 := x*y+y*z", "d3 := x*x+y*y+z*z", "dd2 := (x-y)*(x-y)+(y-z)*(y-z)", "dd3 := (x-y)*(x-y)+(y-z)*(y-z)+(z-x)*(z-x)", "len := sqrt(x*x+y*y+z*z)"),
    lambda q, d, t, x, y, z: dict(d2=r6(M.dot([x, y], [y, z])),
    d3=r6(M.dot([x, y, z])),
    dd2=r6(M.dot_diff([x, y], [y, z])),
    dd3=r6(M.dot_diff([x, y, z], [y, z, x])),
    len=r6(M.length([x, y, z]))),
)
_math(
    "V06",
    "(x >= -1 AND x <= 1) AS inside, " + _r("clamped := CASE WHEN x < -1 THEN -1.0e0 WHEN x > 1 THEN 1.0e0 ELSE x END") + ", CAST((q-25) % 7 AS INT) AS fm, " + _r("wrapped := CASE WHEN fmod(x, 1.5e0) < 0 THEN fmod(x, 1.5e0) + 1.5e0 ELSE fmod(x, 1.5e0) END"),
    lambda q, d, t, x, y, z: dict(inside=M.in_interval(x, -1, 1),
    clamped=r6(M.clamp(x, -1.0, 1.0)),
    fm=(q - 25) % 7,
    wrapped=r6(M.wrap(x, 1.5))),
)
_math("V07", "(abs(x-y) < 1.11e-12) AS dbl, (abs(x-y) < 5.96e-5) AS flt", lambda q, d, t, x, y, z: dict(dbl=M.equal(x, y), flt=M.equal(x, y, 5.96e-5)))
_math("V08", _r("deg := degrees(x)", "rad := radians(q)"), lambda q, d, t, x, y, z: dict(deg=r6(F.degrees(x)), rad=r6(F.radians(q.cast("double")))))
_math(
    "V09",
    "least(q, d, t) AS mn, greatest(q, d, t) AS mx, list_sort([q, d, t])[1] AS a1, list_sort([q, d, t])[2] AS a2, list_sort([q, d, t])[3] AS a3, list_reverse_sort([q, d, t])[1] AS b1",
    lambda q, d, t, x, y, z: dict(mn=F.least(q, d, t),
    mx=F.greatest(q, d, t),
    a1=M.ordered(q, d, t)[0],
    a2=M.ordered(q, d, t)[1],
    a3=M.ordered(q, d, t)[2],
    b1=M.ordered(q, d, t, descending=True)[0]),
)
_P = "(q*q+d*d)", "((q-t)*(q-t)+(d-q)*(d-q))", "(t*t+q*q)"
_math(
    "V10",
    _r(f"angle := CASE WHEN {_P[0]} = 0 OR {_P[1]} = 0 THEN 0.0e0 ELSE acos(least(1, greatest(-1, ({_P[0]}+{_P[1]}-{_P[2]})/sqrt(4.0e0*{_P[0]}*{_P[1]})))) END") + ", ((0-q)*(q-0) < (0-d)*(t-0)) AS cw",
    lambda q, d, t, x, y, z: dict(angle=r6(M.triangle_angle([q, d], [F.lit(0), F.lit(0)], [t, q])),
    cw=M.clockwise([q, d], [F.lit(0), F.lit(0)], [t, q])),
)
_math(
    "V11",
    "CAST(pow(2.0e0, t) AS BIGINT) AS p2, "
    + _r("lg := ln(q)*(1.0e0/ln(2.0e0))")
    + ", CAST(pow(2.0e0, CASE WHEN q <= 1 THEN 0 ELSE length(bin(q-1)) END) AS BIGINT) AS up, CASE WHEN q <= 1 THEN 0 ELSE length(bin(q-1)) END AS ex, CAST(length(bin(q))-1 AS INT) AS lo, (q > 0 AND (q & (q-1)) = 0) AS is_p2",
    lambda q, d, t, x, y, z: dict(p2=M.power_of_two(t),
    lg=r6(M.log2(q)),
    up=M.power_of_two(M.power_of_two_exponent(q)),
    ex=M.power_of_two_exponent(q).cast("long"),
    lo=(F.length(F.bin(q.cast("long"))) - 1),
    is_p2=M.is_power_of_two(q)),
)
_math("V12", _r("e := exp(-z)", "h := exp(-z/2.0e0)", "k := exp(-pi()*z*z)"), lambda q, d, t, x, y, z: dict(e=r6(M.exp_neg(z)), h=r6(M.exp_neg(z / 2.0)), k=r6(M.kernel(z))))
