"""3 x 4 affine maps as column expressions; a map is an array of twelve doubles, row by row."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def literal(m) -> Column:
    return F.array(*[F.lit(float(x)) for x in m])


def from_columns(*cells: Column) -> Column:
    return F.array(*[c.cast("double") for c in cells])


def translation(x: Column, y: Column, z: Column) -> Column:
    one, nil = F.lit(1.0), F.lit(0.0)
    return from_columns(one, nil, nil, x, nil, one, nil, y, nil, nil, one, z)


def scaling(x: Column, y: Column, z: Column) -> Column:
    nil = F.lit(0.0)
    return from_columns(x, nil, nil, nil, nil, y, nil, nil, nil, nil, z, nil)


def apply(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Image of a point: three plain sums of products, which stay inside code generation."""
    return tuple(m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3))


def compose(a: Column, b: Column) -> Column:
    """The map that applies b, then a."""
    cells = []
    for r in range(3):
        for c in range(4):
            cell = a[4 * r] * b[c] + a[4 * r + 1] * b[4 + c] + a[4 * r + 2] * b[8 + c]
            cells.append(cell + a[4 * r + 3] if c == 3 else cell)
    return F.array(*cells)


def composed(a: Column, b: Column) -> Column:
    """As compose(), for maps that are long expressions."""
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda t: compose(t["a"], t["b"]))


def fold(transforms: Column, order: str = "ord", matrix: str = "m") -> Column:
    """Product of an array of structs in ascending order, the first being outermost; identity for an empty array."""
    return F.aggregate(F.array_sort(transforms, lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)), literal(IDENTITY), lambda acc, t: compose(acc, t[matrix]))


def determinant(m: Column) -> Column:
    return m[0] * (m[5] * m[10] - m[6] * m[9]) - m[1] * (m[4] * m[10] - m[6] * m[8]) + m[2] * (m[4] * m[9] - m[5] * m[8])


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, where body names it many times."""
    return F.transform(F.array(value), body)[0]


def inverse(m: Column) -> Column:
    """Inverse map by cofactors; null where the determinant is 0."""

    def cofactors(m: Column) -> Column:
        a, b, c, e, f, g, i, j, k = (m[n] for n in (0, 1, 2, 4, 5, 6, 8, 9, 10))
        return F.array(f * k - g * j, c * j - b * k, b * g - c * f, g * i - e * k, a * k - c * i, c * e - a * g, e * j - f * i, b * i - a * j, a * f - b * e, a * (f * k - g * j) - b * (e * k - g * i) + c * (e * j - f * i), m[3], m[7], m[11])

    def divided(q: Column) -> Column:
        d = F.when(q[9] != 0, q[9])
        t = [-(q[3 * r] * q[10] + q[3 * r + 1] * q[11] + q[3 * r + 2] * q[12]) / d for r in range(3)]
        return F.array(*[x for r in range(3) for x in (q[3 * r] / d, q[3 * r + 1] / d, q[3 * r + 2] / d, t[r])])

    return bind(bind(m, cofactors), divided)


def bounds(m: Column, low: list[Column], high: list[Column]) -> tuple[list[Column], list[Column]]:
    """Box around the image of a box: each coefficient takes the end that makes it smaller or larger, so no corner is listed."""
    lo, hi = [], []
    for r in range(3):
        least = [F.least(m[4 * r + c] * low[c], m[4 * r + c] * high[c]) for c in range(3)]
        most = [F.greatest(m[4 * r + c] * low[c], m[4 * r + c] * high[c]) for c in range(3)]
        lo.append(functools.reduce(lambda a, b: a + b, least) + m[4 * r + 3])
        hi.append(functools.reduce(lambda a, b: a + b, most) + m[4 * r + 3])
    return lo, hi


def axis_scale(m: Column) -> list[Column]:
    """Length of the image of each unit vector."""
    return [F.sqrt(m[c] * m[c] + m[4 + c] * m[4 + c] + m[8 + c] * m[8 + c]) for c in range(3)]


def rotation(axis: int, degrees: float) -> Column:
    """Rotation about axis 0, 1 or 2 by the right-hand rule."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    m = list(IDENTITY)
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m[4 * i + i], m[4 * i + j], m[4 * j + i], m[4 * j + j] = c, -s, s, c
    return literal(m)


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards, also below zero."""
    return F.floor(x + F.lit(0.5))


def parse(text: str) -> list[float]:
    """Twelve numbers of a map written with commas, blanks or brackets; anything else is an error."""
    import re

    numbers = [float(x) for x in re.split(r"[\s,;\[\](){}]+", text.strip()) if x]
    if len(numbers) != 12:
        raise ValueError(f"a map has 12 numbers, not {len(numbers)}")
    return numbers
