"""Distribution tails for p-values, as vectorised pandas UDFs over already aggregated rows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_two_sided(z):
    """P(|Z| > |z|)."""
    return _erfc(np.abs(z) / math.sqrt(2.0))


MOST_TERMS = 5_000_000


class Unconverged(ArithmeticError):
    """A series or fraction did not settle; no value is given out instead."""


def _stirling_error(n):
    """log(n!) less its Stirling approximation, for real n > 0."""
    n = np.asarray(n, float)
    big = np.maximum(n, 16.0)
    r = 1 / (big * big)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - r / 1188) * r) * r) * r) / big
    small = np.minimum(n, 16.0)
    exact = _lgamma(small + 1) - (small + 0.5) * np.log(small) + small - 0.5 * math.log(2 * math.pi)
    return np.where(n < 16, exact, series)


def _deviance(x, m):
    """x log(x / m) + m - x without cancellation near x = m."""
    d = (m - x) / x
    return np.where(np.abs(d) < 0.1, x * _minus_log1p(np.clip(d, -0.1, 0.1)), x * np.log(x / m) + m - x)


def _minus_log1p(d):
    """d - log(1 + d) for |d| <= 0.1, by its series."""
    out, power = np.zeros_like(d), d * d
    for k in range(2, 20):
        out = out + (power / k if k % 2 == 0 else -power / k)
        power = power * d
    return out


SETTLED = 1e-15  # a few units of rounding: below that, successive factors flip at random
TINY = 1e-300


def _lentz(step, first, c_, params, what: str):
    """Continued fractions by the modified Lentz method, each element run until it settles on its own.

    ``first`` is the first denominator of each element, ``c_`` the ratio of numerators that goes with it; ``step(m, *params)`` gives
    the (numerator, denominator) pairs of round m for the elements that are still open. Settled elements are frozen and leave, so a
    batch of any size ends with its slowest element.
    """
    d = 1.0 / np.where(np.abs(first) < TINY, TINY, first)
    h, c_, out, open_ = d.copy(), np.full(len(d), c_), np.empty(len(d)), np.arange(len(d))
    for m in range(1, MOST_TERMS):
        if not len(open_):
            return out
        for num, den in step(m, *params):
            d = den + num * d
            d = 1.0 / np.where(np.abs(d) < TINY, TINY, d)
            c_ = den + num / c_
            c_ = np.where(np.abs(c_) < TINY, TINY, c_)
            factor = d * c_
            h = h * factor
        done = np.abs(factor - 1.0) < SETTLED
        if done.any():
            out[open_[done]] = h[done]
            left = ~done
            d, h, c_, open_ = d[left], h[left], c_[left], open_[left]
            params = [v[left] for v in params]
    raise Unconverged(what)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function; its first coefficient belongs to the first denominator."""

    def step(m, p, q, y):
        yield m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), 1.0
        yield -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)), 1.0

    return _lentz(step, 1.0 - (a + b) * x / (a + 1.0), 1.0, [a, b, x], "incomplete beta")


def beta_inc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        aa, bb, xx = a[mid], b[mid], x[mid]
        n = aa + bb
        # x^a (1-x)^b / B(a, b) from Stirling errors and deviances, exact to rounding for any size
        front = np.sqrt(aa * bb / (2 * math.pi * n)) * np.exp(
            _stirling_error(n) - _stirling_error(aa) - _stirling_error(bb) - _deviance(aa, n * xx) - _deviance(bb, n * (1 - xx))
        )
        swap = xx > (aa + 1) / (aa + bb + 2)
        a1, b1, x1 = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
        val = front * _beta_fraction(a1, b1, x1) / a1
        out[mid] = np.where(swap, 1 - val, val)
    return out


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _gamma_series(a, x):
    """Sum of x^n / (a (a + 1) ... (a + n)), each element run until its terms no longer count."""
    term = 1.0 / a
    total, out, open_ = term.copy(), np.empty(len(a)), np.arange(len(a))
    for n in range(1, MOST_TERMS):
        term = term * x / (a + n)
        total = total + term
        done = np.abs(term) < np.abs(total) * 1e-17
        if done.any():
            out[open_[done]] = total[done]
            left = ~done
            if not left.any():
                return out
            term, total, open_, a, x = term[left], total[left], open_[left], a[left], x[left]
    raise Unconverged("incomplete gamma")


def chi2_upper(x, k):
    """Upper tail of chi-square: incomplete gamma by series or continued fraction."""
    x, a = np.broadcast_arrays(np.asarray(x, float) / 2, np.asarray(k, float) / 2)
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(x) & np.isfinite(a) & (a > 0)
    out[ok & (x <= 0)] = 1.0
    low = ok & (x > 0) & (x < a + 1)
    high = ok & (x >= a + 1)
    # x^a e^-x / Gamma(a)
    front = lambda aa, xx: np.sqrt(aa / (2 * math.pi)) * np.exp(-_stirling_error(aa) - _deviance(aa, xx))
    if low.any():
        out[low] = 1 - _gamma_series(a[low], x[low]) * front(a[low], x[low])
    if high.any():
        aa, xx = a[high], x[high]
        step = lambda i, p, y: [(-i * (i - p), y + (1 - p + 2 * i))]
        out[high] = _lentz(step, xx + 1 - aa, 1 / TINY, [aa, xx], "incomplete gamma") * front(aa, xx)
    return out


@lru_cache(maxsize=32)
def _partition_table(n1: int) -> tuple[int, list[list[int]]]:
    """(period, forward differences per residue) of the number of partitions with parts 1, 1, 2, 3, ..., n1.

    That number is, for each residue modulo lcm(1..n1), a polynomial of degree n1 in the quotient.
    """
    period = math.lcm(*range(1, n1 + 1))
    count = [1] * (period * (n1 + 1))
    for part in range(1, n1 + 1):
        for t in range(part, len(count)):
            count[t] += count[t - part]
    table = []
    for r in range(period):
        values, first = count[r::period], []
        while values:
            first.append(values[0])
            values = [b - a for a, b in zip(values, values[1:])]
        table.append(first)
    return period, table


def _u_at_most(u: int, n1: int, n2: int) -> float:
    """Exact P(U <= u) without ties, at a cost that depends on the smaller group only.

    Counts the partitions of 0..u into at most n1 parts of at most n2: the generating function's numerator is expanded, its
    denominator's coefficients come from ``_partition_table``.
    """
    n1, n2 = min(n1, n2), max(n1, n2)
    period, table = _partition_table(n1)
    total = 0
    for mask in range(1 << n1):
        t = u - sum(n2 + i + 1 for i in range(n1) if mask >> i & 1)
        if t >= 0:
            q, r = divmod(t, period)
            ways = sum(d * math.comb(q, k) for k, d in enumerate(table[r]))
            total += -ways if mask.bit_count() % 2 else ways
    return total / math.comb(n1 + n2, n1)


EXACT_MAX = 8  # fixed value: with method "auto", exact when the smaller group is at most this and nothing is tied


def mwu_method(n1: Column, n2: Column, tie_term: Column, method: str = "auto") -> Column:
    """Which distribution ``mwu_two_sided`` uses: exact or asymptotic."""
    if method != "auto":
        return F.lit(method)
    return F.when((tie_term == 0) & (F.least(n1, n2) <= EXACT_MAX), "exact").otherwise("asymptotic")


def mwu_two_sided(u1, n1, n2, tie_term, exact=None):
    """Two-sided Mann-Whitney p: exact where ``exact`` is 1 (tie-free), else normal with tie and continuity terms.

    ``tie_term`` is the sum of t^3 - t over tied values. Without ``exact`` the rule of method "auto" decides.
    """
    u1, n1, n2, tie_term = (np.asarray(v, float) for v in (u1, n1, n2, tie_term))
    exact = (tie_term == 0) & (np.minimum(n1, n2) <= EXACT_MAX) if exact is None else np.asarray(exact) == 1
    out = np.full(len(u1), np.nan)
    a, b, n = n1, n2, n1 + n2
    top = np.maximum(u1, a * b - u1)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = a * b / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0)))
        z = (top - a * b / 2.0 - 0.5) / np.sqrt(2.0 * var)
    some = (a > 0) & (b > 0)
    normal = some & (var > 0)
    out[some] = 1.0
    if normal.any():
        out[normal] = np.minimum(1.0, _erfc(z[normal]))
    for i in np.flatnonzero(some & exact):
        x, y = int(a[i]), int(b[i])
        out[i] = min(1.0, 2 * _u_at_most(x * y - int(round(top[i])), x, y))
    return out


def fisher_two_sided(a, b, c, d):
    """Two-sided Fisher exact p for 2x2 tables.

    Only counts within 40 standard deviations of the mode, or of the observed count, can add to a double: the work grows with
    the square root of a table's size.
    """
    out = np.full(len(a), np.nan)
    for i, (w, x, y, z) in enumerate(zip(a, b, c, d)):
        w, x, y, z = int(w), int(x), int(y), int(z)
        r1, c1, n = w + x, w + y, w + x + y + z
        lo, hi = max(0, r1 + c1 - n), min(r1, c1)
        mode = (r1 + 1) * (c1 + 1) // (n + 2)
        spread = math.sqrt(r1 * (c1 / max(n, 1)) * ((n - c1) / max(n, 1)) * ((n - r1) / max(n - 1, 1)))
        reach = int(40 * spread) + 50
        around = [np.arange(max(lo, at - reach), min(hi, at + reach) + 1) for at in (mode, w)]
        k = np.union1d(*around).astype(float)
        lp = (
            _lgamma(r1 + 1.0) - _lgamma(k + 1) - _lgamma(r1 - k + 1)
            + _lgamma(n - r1 + 1.0) - _lgamma(c1 - k + 1) - _lgamma(n - r1 - c1 + k + 1)
            - (_lgamma(n + 1.0) - _lgamma(c1 + 1.0) - _lgamma(n - c1 + 1.0))
        )
        p = np.exp(lp)
        out[i] = min(1.0, p[p <= p[np.searchsorted(k, w)] * (1 + 1e-7)].sum())
    return out


def _wrap(fn, name):
    """A double-valued pandas UDF over double columns."""

    def apply(*cols: pd.Series) -> pd.Series:
        arrays = [s.to_numpy(dtype=float, na_value=np.nan) for s in cols]
        ok = np.all([np.isfinite(v) for v in arrays], axis=0)
        out = np.full(len(arrays[0]), np.nan)
        if ok.any():
            out[ok] = fn(*[v[ok] for v in arrays])
        return pd.Series(out).astype("Float64").where(~np.isnan(out), pd.NA)

    apply.__name__ = name
    return apply


def _one(fn, name):
    base = _wrap(fn, name)

    def f(a: pd.Series) -> pd.Series:
        return base(a)

    return F.pandas_udf(f, "double")


def _two(fn, name):
    base = _wrap(fn, name)

    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return base(a, b)

    return F.pandas_udf(f, "double")


def _three(fn, name):
    base = _wrap(fn, name)

    def f(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return base(a, b, c)

    return F.pandas_udf(f, "double")


def _four(fn, name):
    base = _wrap(fn, name)

    def f(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return base(a, b, c, d)

    return F.pandas_udf(f, "double")


def _five(fn, name):
    base = _wrap(fn, name)

    def f(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        return base(a, b, c, d, e)

    return F.pandas_udf(f, "double")


def _udfs():
    return {
        "normal_p": _one(normal_two_sided, "normal_p"),
        "t_p": _two(t_two_sided, "t_p"),
        "f_p": _three(f_upper, "f_p"),
        "chi2_p": _two(chi2_upper, "chi2_p"),
        "mwu_p": _five(mwu_two_sided, "mwu_p"),
        "fisher_p": _four(fisher_two_sided, "fisher_p"),
    }


def call(name: str, *cols: Column) -> Column:
    """Tail probability column, e.g. ``call("t_p", t, df)``."""
    return _udfs()[name](*[col.cast("double") for col in cols])


def register(spark: SparkSession) -> None:
    """Make the tail functions callable from SQL."""
    for name, udf in _udfs().items():
        spark.udf.register(name, udf)
