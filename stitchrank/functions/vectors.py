"""Vector columns: arrays of float in, arrays of double out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8  # norms below this are treated as this


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, eps: float = NORM_FLOOR) -> Column:
    """Unit-length vector, the norm floored at ``eps``."""
    # The length is an argument of zip_with, not part of its lambda: a lambda body is evaluated
    # anew for every element.
    length = F.array_repeat(F.greatest(norm(v), F.lit(eps)), F.size(v))
    return F.zip_with(as_double(v), length, lambda x, n: x / n)


def add(a: Column, b: Column, wa: float = 1.0, wb: float = 1.0) -> Column:
    """Element-wise ``wa * a + wb * b``."""
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x * F.lit(wa) + y * F.lit(wb))


def pair_features(
    q: Column,
    p: Column,
    abs_diff: bool = True,
    product: bool = True,
    sq_diff: bool = False,
    raw: bool = False,
    extra: Column | None = None,
) -> Column:
    """Feature vector of a (query, product) pair, similarity first."""
    q, p = as_double(q), as_double(p)
    parts = [F.array(dot(q, p))]
    if abs_diff:
        parts.append(F.zip_with(q, p, lambda x, y: F.abs(x - y)))
    if product:
        parts.append(F.zip_with(q, p, lambda x, y: x * y))
    if sq_diff:
        parts.append(F.zip_with(q, p, lambda x, y: (x - y) * (x - y)))
    if raw:
        parts += [q, p]
    if extra is not None:
        parts.append(as_double(extra))
    return F.concat(*parts)


def feature_dim(
    dim: int,
    abs_diff: bool = True,
    product: bool = True,
    sq_diff: bool = False,
    raw: bool = False,
    extra_dim: int = 0,
) -> int:
    """Width of :func:`pair_features` for ``dim``-dimensional vectors."""
    return 1 + dim * (abs_diff + product + sq_diff + 2 * raw) + extra_dim
