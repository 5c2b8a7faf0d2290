"""Vector and scalar functions as Column expressions; doubles throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-15


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x) -> Column:
    return F.transform(_col(x), lambda v: v.cast("double"))


def fsum(x) -> Column:
    """Sum of an array in order."""
    return F.aggregate(_col(x), F.lit(0.0), lambda a, v: a + v)


def safe_log(x) -> Column:
    """Natural logarithm; magnitudes below 1e-15 count as 1e-15."""
    return F.log(F.when(F.abs(_col(x)) < TINY, TINY).otherwise(_col(x)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def log_sum(a, b) -> Column:
    """log(e^a + e^b), stable."""
    return F.greatest(_col(a), _col(b)) + F.log1p(F.exp(-F.abs(_col(a) - _col(b))))


def logsumexp(x) -> Column:
    x = _col(x)
    return F.array_max(x) + F.log(fsum(F.transform(x, lambda v: F.exp(v - F.array_max(x)))))


def softmax(x) -> Column:
    """e^(v - logsumexp), at most 1. The exponentials are taken once for the whole array."""
    shifted = F.transform(_col(x), lambda v: F.exp(v - F.array_max(_col(x))))
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda v: F.least(v / fsum(e), F.lit(1.0))))[0]


def dot(a, b) -> Column:
    return fsum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def sparse_dot_dense(ids, vals, dense) -> Column:
    """Zero-based ids; ids past the dense vector count as zero."""
    pairs = F.zip_with(_col(ids), _col(vals), lambda i, v: v.cast("double") * F.coalesce(F.get(_col(dense), i).cast("double"), F.lit(0.0)))
    return fsum(pairs)


def axpy(alpha, x, y) -> Column:
    """y + alpha x"""
    return F.zip_with(doubles(y), doubles(x), lambda v, u: v + alpha * u)


def subtract(a, b) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def sq_norm(a) -> Column:
    return fsum(F.transform(doubles(a), lambda v: v * v))


def sq_distance(a, b) -> Column:
    """Squared distance as |a|^2 - 2ab + |b|^2."""
    return sq_norm(a) - 2 * dot(a, b) + sq_norm(b)


def l2_distance(a, b) -> Column:
    return F.sqrt(sq_norm(subtract(a, b)))


def soft_threshold(x, tau) -> Column:
    return F.signum(_col(x)) * F.greatest(F.abs(_col(x)) - tau, F.lit(0.0))


def l2_project(a, c: float = 1.0) -> Column:
    """The vector, scaled to squared norm ``c`` if it is longer."""
    a = doubles(a)
    factor = F.when(sq_norm(a) > c, F.sqrt(F.lit(c) / sq_norm(a))).otherwise(F.lit(1.0))
    return F.transform(F.array(factor), lambda f: F.transform(a, lambda v: v * f))[0]


def clamp(x, low: float = 0.0, high: float = 1e5) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def entropy(weights) -> Column:
    """Base-2 entropy of an array of weights; parts below 1e-5 count as 0."""
    w = doubles(weights)
    return -fsum(F.transform(F.array(fsum(w)), lambda t: fsum(F.transform(w, lambda v: F.when(v / t < 1e-5, 0.0).otherwise(v / t * F.log2(v / t))))))


def normalize(weights) -> Column:
    w = doubles(weights)
    return F.transform(F.array(fsum(w)), lambda t: F.transform(w, lambda v: v / t))[0]


def vector_to_string(x, digits: int | None = None) -> Column:
    """Space-joined."""
    return F.array_join(F.transform(_col(x), lambda v: (F.format_string(f"%.{digits}f", v) if digits is not None else v.cast("string"))), " ")


def densify(ids, vals, dim) -> Column:
    """Dense array<double> of ``dim`` places from zero-based ids and values; absent ones are 0."""
    m = F.map_from_arrays(_col(ids), _col(vals))
    return F.transform(F.sequence(F.lit(0), F.lit(dim) - 1), lambda i: F.coalesce(F.try_element_at(m, i).cast("double"), F.lit(0.0)))


def sparse_get(m, key) -> Column:
    """Value at ``key`` of map ``m``; 0 where absent."""
    return F.coalesce(F.try_element_at(_col(m), key), F.lit(0.0))


def sparse_set(m, key, value) -> Column:
    """``m`` with ``key`` set; 0 deletes it."""
    rest = F.map_filter(_col(m), lambda k, v: k != key)
    return F.when(value == 0, rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def sparse_to_string(m) -> Column:
    """``id:value`` in ascending id order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_col(m))), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " ")


def lr_power(t, base: float, offset: float, power: float) -> Column:
    """base * (t + offset)^-power"""
    return F.lit(base) * F.pow(_col(t) + offset, F.lit(-power))


def lr_decay(epoch, base: float, decay: float) -> Column:
    """base * decay^epoch"""
    return F.lit(base) * F.pow(F.lit(decay), _col(epoch))


def digamma(x) -> Column:
    """psi(x) for x > 0: recurrence up to x + 8, then the asymptotic series."""
    x = _col(x)
    up = reduce(lambda a, i: a - 1 / (x + i), range(8), F.lit(0.0))
    y = x + 8
    z = 1 / (y * y)
    return up + F.log(y) - 1 / (2 * y) - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240))))


def lgamma(x) -> Column:
    """log Gamma(x) for x > 0: recurrence up to x + 8, then Stirling's series."""
    x = _col(x)
    down = reduce(lambda a, i: a - F.log(x + i), range(8), F.lit(0.0))
    y = x + 8
    z = 1 / (y * y)
    return down + (y - 0.5) * F.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z / 1260)) / y


#: Exact forms stand in for fast approximate ones.
exact_exp, exact_log, exact_log2, exact_pow = F.exp, F.log, F.log2, F.pow
exact_sinh, exact_cosh, exact_tanh = F.sinh, F.cosh, F.tanh
