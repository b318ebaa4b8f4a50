"""Colour spaces, colour distances, palettes and pixel packing as column expressions.

A colour is a triple of columns: integers 0 to 255 in functions ending in 8, reals 0 to 1 elsewhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.mathx import clamp, dot_diff, idiv, trunc

Color = Sequence[Column]

# Tristimulus matrices of Adobe RGB (1998) with white D65, rows for x, y, z and r, g, b.
RGB_TO_XYZ = ((0.5767309, 0.1855540, 0.1881852), (0.2973769, 0.6273491, 0.0752741), (0.0270343, 0.0706872, 0.9911085))
XYZ_TO_RGB = ((2.0413690, -0.5649464, -0.3446944), (-0.9692660, 1.8760108, 0.0415560), (0.0134474, -0.1183897, 1.0154096))
# Chromaticity of the white point, the linear part of L*a*b* and its exponent.
WHITE_X, WHITE_Y = 0.312713, 0.329016
LAB_EPSILON, LAB_KAPPA, LAB_SLOPE, LAB_SHIFT, LAB_POWER = 216.0 / 24389.0, 24389.0 / 27.0, 841.0 / 108.0, 4.0 / 29.0, 0.33333
# The white point's tristimulus values, with x and y exchanged: results to match use them in this order.
WHITE = (1.0, WHITE_X / WHITE_Y, (1.0 - WHITE_X - WHITE_Y) / WHITE_Y)

# Named colours and palettes.
NAMED = {
    "black": (0.0, 0.0, 0.0),
    "white": (1.0, 1.0, 1.0),
    "grey": (0.5, 0.5, 0.5),
    "light_grey": (0.75, 0.75, 0.75),
    "red": (1.0, 0.0, 0.0),
    "dark_red": (0.5, 0.0, 0.0),
    "green": (0.0, 1.0, 0.0),
    "blue": (0.0, 0.0, 1.0),
    "dark_blue": (0.0, 0.0, 0.5),
    "yellow": (1.0, 1.0, 0.0),
    "cyan": (0.0, 1.0, 1.0),
    "magenta": (1.0, 0.0, 1.0),
}
PALETTES = {
    "black_white": ("black", "white"),
    "white_black": ("white", "black"),
    "blue_white_red": ("blue", "white", "red"),
    "dark_blue_blue_white_red_dark_red": ("dark_blue", "blue", "white", "red", "dark_red"),
    "blue_red_yellow": ("blue", "red", "yellow"),
    "blue_red_yellow_green": ("blue", "red", "yellow", "green"),
    "red_green": ("red", "green"),
    "blue_black_red": ("blue", "black", "red"),
    "light_blue_black_red": ("cyan", "black", "red"),
    "minus_plus_old": ("cyan", "light_grey", "red"),
    "minus_plus": ("blue", "grey", "red"),
    "blue_red_yellow_white": ("blue", "red", "yellow", "white"),
    "yellow_red_blue": ("yellow", "red", "blue"),
    "black_blue_red_yellow_white": ("black", "blue", "red", "yellow", "white"),
    "hue_white_to_red": ("white", "yellow", "green", "cyan", "blue", "magenta", "red"),
    "red_green_blue": ("red", "green", "blue"),
}


def unit(c: Color) -> list[Column]:
    return [v / 255.0 for v in c]


def _hue8(c: Color) -> Column:
    """The hue circle on 0 to 255: a sixth of 256 either way of 0, 85 and 171, whichever channel is largest."""
    r, g, b = c
    top = F.greatest(*c)
    six = 6 * (top - F.least(*c))
    part = lambda a, o: idiv((a - o) * 256, six)  # noqa: E731  truncates toward zero, so either sign is right
    around = F.when(g >= b, part(g, b)).otherwise(F.least(F.lit(255), 256 - part(b, g)))
    return F.when(six == 0, 0).when(top == r, around).when(top == g, 85 + part(b, r)).otherwise(171 + part(r, g)).cast("int")


def rgb_to_hsv8(c: Color) -> list[Column]:
    top = F.greatest(*c)
    s = F.when(top == 0, 0).otherwise(F.least(F.lit(255), idiv((top - F.least(*c)) * 256, top))).cast("int")
    return [_hue8(c), s, top.cast("int")]


def hsv_to_rgb8(c: Color) -> list[Column]:
    h, s, v = c
    starts = (0, 43, 85, 128, 171, 213)  # fixed values: where the sectors of the hue circle begin
    spans = (42, 43, 42, 43, 42, 43)
    sector, f = F.lit(0), idiv(h * 255, spans[0])
    for i in range(1, 6):
        sector = F.when(h >= starts[i], i).otherwise(sector)
        f = F.when(h >= starts[i], idiv((h - starts[i]) * 255, spans[i])).otherwise(f)
    p = F.floor(v * (255 - s) / 256)
    q = F.floor(v * (65025 - s * f) / 65536)
    t = F.floor(v * (65025 - (255 - f) * s) / 65536)
    return [F.element_at(F.array(*(x.cast("int") for x in row)), sector + 1) for row in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q))]


def rgb_to_hsv(c: Color) -> list[Column]:
    r, g, b = c
    top, delta = F.greatest(*c), F.greatest(*c) - F.least(*c)
    h = F.when(r == top, (g - b) / delta).when(g == top, 2 + (b - r) / delta).otherwise(4 + (r - g) / delta)
    flat = delta == 0
    return [F.when(flat, 0.0).otherwise(F.when(h < 0, h + 6).otherwise(h) / 6), F.when(flat, 0.0).otherwise(delta / top), top]


def hsv_to_rgb(c: Color) -> list[Column]:
    h, s, v = c
    whole = trunc(h * 6)
    f = h * 6 - whole
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - (1 - f) * s)
    at = (whole % 6 + 1).cast("int")
    return [F.element_at(F.array(*row), at) for row in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q))]


def rgb_to_hsl8(c: Color) -> list[Column]:
    total, q = F.greatest(*c) + F.least(*c), F.greatest(*c) - F.least(*c)
    s = F.when(q == 0, 0).when(total < 256, F.least(F.lit(255), idiv(q * 256, total))).otherwise(idiv(q * 256, 512 - total))
    return [_hue8(c), s.cast("int"), F.floor(total / 2).cast("int")]


def hsl_to_rgb(c: Color) -> list[Column]:
    h, s, l = c  # noqa: E741
    q = F.when(l < 0.5, l * (1 + s)).otherwise(l * (1 - s) + s)
    p = 2 * l - q

    def channel(t: Column) -> Column:
        return F.when(t < 1, p + t * (q - p)).when(t < 3, q).when(t < 4, p + (4 - t) * (q - p)).otherwise(p)

    six = h * 6
    return [channel(F.when(six + 2 > 6, six - 4).otherwise(six + 2)), channel(six), channel(F.when(six - 2 < 0, six + 4).otherwise(six - 2))]


def hsl_to_rgb8(c: Color) -> list[Column]:
    return [trunc(v * 255).cast("int") for v in hsl_to_rgb([x / 256.0 for x in c])]


def _matrix(m: Sequence[Sequence[float]], c: Color) -> list[Column]:
    return [row[0] * c[0] + row[1] * c[1] + row[2] * c[2] for row in m]


def rgb_to_xyz(c: Color) -> list[Column]:
    return _matrix(RGB_TO_XYZ, c)


def xyz_to_rgb(c: Color) -> list[Column]:
    return [clamp(v, 0.0, 1.0) for v in _matrix(XYZ_TO_RGB, c)]


def xyz_to_chromaticity(c: Color) -> list[Column]:
    total = c[0] + c[1] + c[2]
    return [c[0] / total, c[1] / total]


def chromaticity_to_xyz(xc: Column, yc: Column, y: Column) -> list[Column]:
    return [y / yc * xc, y, y / yc * (1 - xc - yc)]


def xyz_to_lab(c: Color, white: Sequence[float] = WHITE) -> list[Column]:
    f = [F.when(v / w <= LAB_EPSILON, LAB_SLOPE * (v / w) + LAB_SHIFT).otherwise(F.pow(v / w, F.lit(LAB_POWER))) for v, w in zip(c, white, strict=True)]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def lab_to_xyz(c: Color, white: Sequence[float] = WHITE) -> list[Column]:
    fy = (c[0] + 16) / 116.0
    fx, fz = c[1] / 500.0 + fy, fy - c[2] / 200.0

    def side(f: Column) -> Column:
        return F.when(f * f * f > LAB_EPSILON, f * f * f).otherwise(116.0 / LAB_KAPPA * f - 16.0 / LAB_KAPPA)

    middle = F.when(c[0] > LAB_EPSILON * LAB_KAPPA, fy * fy * fy).otherwise(c[0] / LAB_KAPPA)
    return [v * w for v, w in zip((side(fx), middle, side(fz)), white, strict=True)]


def rgb_to_lab(c: Color) -> list[Column]:
    return xyz_to_lab(rgb_to_xyz(c))


def lab_to_rgb(c: Color) -> list[Column]:
    return xyz_to_rgb(lab_to_xyz(c))


def rgb_to_hn(c: Color) -> list[Column]:
    """Shares of red and green, and a tenth of the brightness; zeros for dark colours."""
    a = c[0] + c[1] + c[2]
    return [F.when(a > 0.05, v).otherwise(0.0) for v in (c[0] / a, c[1] / a, a * 0.1)]


def hn_to_rgb(c: Color) -> list[Column]:
    """Inverse of rgb_to_hn. Undoes the tenth, which the results to match leave in."""
    a = c[2] * 10
    r, g = c[0] * a, c[1] * a
    return [F.when(c[2] > 0, v).otherwise(0.0) for v in (r, g, a - r - g)]


def from_rgb(c: Color, space: str) -> list[Column]:
    if space == "LAB":
        return [0.01 * v for v in rgb_to_lab(c)]
    return {"RGB": list, "HSV": rgb_to_hsv, "HN": rgb_to_hn}[space](c)


def to_rgb(c: Color, space: str) -> list[Column]:
    if space == "LAB":
        return lab_to_rgb([100 * v for v in c])
    return {"RGB": list, "HSV": hsv_to_rgb, "HN": hn_to_rgb}[space](c)


def rgb_norm1(a: Color, b: Color) -> Column:
    return (F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]) + F.abs(a[2] - b[2])) / 255.0


def rgb_norm2(a: Color, b: Color) -> Column:
    return dot_diff(a, b) / 255.0 / 255.0


def hsv_norm2(a: Color, b: Color) -> Column:
    return dot_diff(rgb_to_hsv8(a), rgb_to_hsv8(b)) / 255.0 / 255.0


def hsv_cone(a: Color, b: Color) -> Column:
    """Adds the mixed term and takes whole turns of hue, as the results to match do."""
    (h1, s1, v1), (h2, s2, v2) = rgb_to_hsv8(a), rgb_to_hsv8(b)
    s1, v1, s2, v2 = (x / 255.0 for x in (s1, v1, s2, v2))
    return v1 * v1 * (s1 * s1 + 1) + v2 * v2 * (s2 * s2 + 1) + 2 * v1 * v2 * (s1 * s2 * F.cos((h1 - h2) * (2 * math.pi)) + 1)


def hsl_point(c: Color) -> list[Column]:
    """A colour's place in the double cone of hue, saturation and lightness."""
    h, s, l = rgb_to_hsl8(c)  # noqa: E741
    radius = F.least(F.when(l < 128, l).otherwise(255 - l) * 2 / 255.0, s / 255.0)
    angle = h / 255.0 * (2 * math.pi)
    return [radius * F.cos(angle), radius * F.sin(angle), l / 255.0]


def hsl_double_cone(a: Color, b: Color, scale: Sequence[float] = (1.0, 1.0, 1.0)) -> Column:
    p, q = hsl_point(a), hsl_point(b)
    return dot_diff([k * v for k, v in zip(scale, p, strict=True)], [k * v for k, v in zip(scale, q, strict=True)])


def hsl_double_cone_scaled(a: Color, b: Color) -> Column:
    return hsl_double_cone(a, b, (2.0, 2.0, 0.25))


def lab_distance(a: Color, b: Color) -> Column:
    return dot_diff(rgb_to_lab(unit(a)), rgb_to_lab(unit(b)))


def no_artefacts(a: Color, b: Color) -> Column:
    p, q = hsl_point(a), hsl_point(b)
    flat = 0.5 * F.sqrt(dot_diff(p[:2], q[:2]))
    high = (0.5 * (p[2] - q[2])) * (0.5 * (p[2] - q[2]))
    return (flat + (1 - flat) * high) * (flat + (1 - flat) * high)


def palette(x: Column, name: str, low: float = 0.0, high: float = 1.0, under: str | None = None, over: str | None = None) -> list[Column]:
    """Linear mix of neighbouring palette colours; the first below the range and the last from its end on by default."""
    names = PALETTES[name]
    p = (x - low) / (high - low)
    at = p * (len(names) - 1)
    i = F.least(F.greatest(trunc(at), F.lit(0)), F.lit(len(names) - 2)).cast("int")
    out = []
    for k in range(3):
        a = F.array(*(F.lit(NAMED[n][k]) for n in names))
        mix = (1 - (at - i)) * F.element_at(a, i + 1) + (at - i) * F.element_at(a, i + 2)
        out.append(F.when(p < 0, NAMED[under or names[0]][k]).when(p >= 1, NAMED[over or names[-1]][k]).otherwise(mix))
    return out


def grey(x: Column, low, high) -> list[Column]:
    return [clamp((x - low) / (high - low), 0.0, 1.0)] * 3


def intensity(x: Column, low: float = 0.0, high: float = 1.0) -> list[Column]:
    return palette(x, "black_blue_red_yellow_white", low, high)


def inverse_intensity(x: Column, low: float = 0.0, high: float = 1.0) -> list[Column]:
    return intensity(low + high - x, low, high)


def plus_minus(x: Column, span: float = 1.0) -> list[Column]:
    return palette(x, "minus_plus", -span, span)


def count_color(n: Column, low, high) -> list[Column]:
    return intensity(F.when(n < low, 0.0).otherwise((n - low) / (high - low)))


def distance_color(x: Column, low: float = 0.0, high: float = 2.0) -> list[Column]:
    return palette((high - x) / (high - low), "blue_red_yellow_white")


def depth_color(metres: Column) -> list[Column]:
    """Blue over red and yellow to green between 0.75 and 2.5 m, darker green beyond, black where there is none."""
    near = palette(metres, "blue_red_yellow_green", 0.75, 2.5)
    far = [F.lit(0.0), 1 / (1 + (metres - 2.5) / 0.5), F.lit(0.0)]
    return [F.when(metres == 0, 0.0).when(metres > 2.5, f).otherwise(n) for n, f in zip(near, far, strict=True)]


def gradient_color(gx: Column, gy: Column) -> list[Column]:
    x, y = clamp(0.5 + gx, 0.0, 1.0), clamp(0.5 + gy, 0.0, 1.0)
    return [0.5 * (1 - x + y), 0.5 * (2 - x - y), 0.5 * (x + y)]


def to_pixel(c: Color) -> list[Column]:
    return [trunc(255.0 * clamp(v, 0.0, 1.0)).cast("int") for v in c]


def pack(c: Color, alpha=255) -> Column:
    """Red in the lowest byte, alpha in the highest, as an unsigned number."""
    a = alpha if isinstance(alpha, Column) else F.lit(alpha)
    r, g, b, a = (v.cast("long") for v in (*c, a))
    return r + F.shiftleft(g, 8) + F.shiftleft(b, 16) + F.shiftleft(a, 24)


def unpack(v: Column) -> list[Column]:
    """Red, green, blue, alpha."""
    return [F.shiftright(v, 8 * i).bitwiseAND(255).cast("int") for i in range(4)]


def set_alpha(v: Column, alpha: Column) -> Column:
    return v.bitwiseAND(0x00FFFFFF) + F.shiftleft(alpha.cast("long"), 24)


def squared_distance8(a: Color, b: Color) -> Column:
    return dot_diff(a, b)
