"""Array-shaping expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _n(x) -> Column:
    return F.lit(x) if isinstance(x, int) else _c(x)


def positions(n) -> Column:
    """``[0, 1, ..., n-1]``; empty for ``n <= 0`` (``sequence(0, -1)`` counts down)."""
    n = _n(n)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def pad_or_cut(arr, length, pad) -> Column:
    """Cut to ``length`` or pad on the right with ``pad`` up to ``length``."""
    a = _c(arr)
    L = _n(length)
    padv = pad if isinstance(pad, Column) else F.lit(pad)
    return F.concat(F.slice(a, 1, L), F.array_repeat(padv, F.greatest(L - F.size(a), F.lit(0))))


def shift_left(arr, k, fill) -> Column:
    """Drop the first ``k`` elements and append ``k`` fill values (same length)."""
    a = _c(arr)
    kk = _n(k)
    fillv = fill if isinstance(fill, Column) else F.lit(fill)
    n = F.size(a)
    kept = F.when(n > kk, F.slice(a, kk + 1, n)).otherwise(F.slice(a, 1, 0))
    return F.concat(kept, F.array_repeat(fillv, F.least(kk, n)))


def drop_first(arr) -> Column:
    a = _c(arr)
    return F.when(F.size(a) > 1, F.slice(a, 2, F.size(a))).otherwise(F.slice(a, 1, 0))


def drop_last(arr) -> Column:
    a = _c(arr)
    return F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(F.slice(a, 1, 0))


def join_ints(arr, sep: str = ",") -> Column:
    """Array of numbers/booleans as one string (for result comparison)."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), sep)


def argmax(arr) -> Column:
    """0-based index of the first maximum (input without NaN)."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def _lse_step(acc, x):
    """Online log-sum-exp: keep (running max, sum of exp(x - max))."""
    m = F.greatest(acc["m"], x)
    return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(x - m)).alias("s"))


def logsumexp(arr) -> Column:
    """``log(sum(exp(v)))`` in one pass (running maximum, rescaled sum), so
    no element is visited twice and ``exp`` never overflows."""
    a = F.transform(_c(arr), lambda x: x.cast("double"))
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))
    return F.aggregate(a, init, _lse_step, lambda acc: acc["m"] + F.log(acc["s"]))
