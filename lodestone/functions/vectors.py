"""Vector expressions over array columns; everything is computed in double precision.

Operands of different lengths raise; a null operand gives null; a vector of length zero has magnitude 0
and no cosine (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _zipped(a: Column, b: Column, f) -> Column:
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different lengths"))
    return F.when(same.isNull(), F.zip_with(doubles(a), doubles(b), f))


def rounded(x: Column, digits: int) -> Column:
    """``x`` as SQL's ``round`` gives it: halves of the double scaled by 10 ** digits go away from zero, and zero keeps its sign."""
    by = F.lit(10.0**digits)
    y = x.cast("double") * by
    return F.when(F.abs(y) < F.lit(float("inf")), F.signum(y) * F.round(F.abs(y)) / by).otherwise(x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def add(a: Column, b: Column) -> Column:
    return _zipped(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _zipped(a, b, lambda x, y: x - y)


def scale(a: Column, factor: Column | float) -> Column:
    by = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(doubles(a), lambda x: x * by)


def dot(a: Column, b: Column) -> Column:
    return total(_zipped(a, b, lambda x, y: x * y))


def magnitude(a: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(_zipped(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(magnitude(a) * magnitude(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def within_ellipse(p: Column, a: Column, b: Column, constant: float) -> Column:
    """Whether the distances of ``p`` to both foci add up to less than ``constant``."""
    return l2(p, a) + l2(p, b) < F.lit(float(constant))


def parse(line: Column) -> tuple[Column, Column]:
    """Label and vector of a text line ``label f f f``."""
    parts = F.split(F.trim(line), r"\s+")
    return parts[0], F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("float"))


def render(label: Column, vector: Column) -> Column:
    return F.concat_ws(" ", label, F.array_join(F.transform(vector, lambda x: x.cast("string")), " "))
