"""Exact tests as column expressions.

Sums over a distribution run inside one expression, over the part of the support
within forty standard deviations of the mean: what lies outside is below any double,
and the length stays of the order of the square root of n however large n grows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = math.log1p(1e-7)


def ln_factorial(n: Column) -> Column:
    """ln n!, from a table to 15 and Stirling's series beyond (error below 1e-13)."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def ln_binomial(k: Column, n: Column, p: float) -> Column:
    return ln_choose(n, k) + k * math.log(p) + (n - k) * math.log1p(-p)


def _window(mean: Column, sd: Column, low: Column, high: Column, *keep: Column) -> Column:
    lo = F.greatest(low, F.floor(mean - 40 * sd - 40).cast("bigint"))
    hi = F.least(high, F.ceil(mean + 40 * sd + 40).cast("bigint"))
    for k in keep:
        lo, hi = F.least(lo, k), F.greatest(hi, k)
    return F.sequence(lo, hi)


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, i: a + f(i))


def binomial(k: Column, n: Column, p: float) -> Column:
    """Two-sided p: outcomes no more likely than the one observed, with a relative slack of 1e-7."""
    k, n = k.cast("bigint"), n.cast("bigint")
    seen = ln_binomial(k, n, p) + SLACK
    support = _window(n * p, F.sqrt(n * p * (1 - p)), F.lit(0).cast("bigint"), n, k)
    return F.least(F.lit(1.0), _sum(support, lambda i: F.when(ln_binomial(i, n, p) <= seen, F.exp(ln_binomial(i, n, p))).otherwise(0.0)))


def binomial_at_least(k: Column, n: Column, p: float) -> Column:
    k, n = k.cast("bigint"), n.cast("bigint")
    support = _window(n * p, F.sqrt(n * p * (1 - p)), F.lit(0).cast("bigint"), n, k)
    return F.least(F.lit(1.0), _sum(support, lambda i: F.when(i >= k, F.exp(ln_binomial(i, n, p))).otherwise(0.0)))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the 2x2 table [[a, b], [c, d]]."""
    a, b, c, d = (x.cast("bigint") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    ln = lambda i: ln_choose(row, i) + ln_choose(n - row, col - i) - ln_choose(n, col)
    mean = row * col / n
    sd = F.sqrt(F.greatest(mean * (n - row) / n * (n - col) / F.greatest(n - 1, F.lit(1)), F.lit(0.0)))
    support = _window(mean, sd, F.greatest(F.lit(0).cast("bigint"), col - (n - row)), F.least(row, col), a)
    return F.least(F.lit(1.0), _sum(support, lambda i: F.when(ln(i) <= ln(a) + SLACK, F.exp(ln(i))).otherwise(0.0)))


def chi2_even(x: Column, df: int) -> Column:
    """Upper tail of chi squared with an even number of degrees of freedom, in closed form."""
    h, term, total = x / 2, F.lit(1.0), F.lit(1.0)
    for i in range(1, df // 2):
        term = term * h / i
        total = total + term
    return F.exp(-h) * total


def t4_two_sided(t: Column) -> Column:
    """Two-sided p of Student's t with four degrees of freedom."""
    a = F.abs(t)
    s = 1 + a * a / 4
    return 2 * (0.5 - 0.375 * a / F.sqrt(s) * (1 - a * a / (12 * s)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, z2 = k / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def haldane(h: Column, hn: Column, f: Column, fn: Column) -> tuple[Column, Column]:
    """Log odds ratio with a half added to each cell, and its standard error."""
    a, b, c, d = h + 0.5, hn - h + 0.5, f + 0.5, fn - f + 0.5
    return F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def sql_fisher(a: str, b: str, c: str, d: str) -> str:
    """The DuckDB counterpart of ``fisher``."""
    lc = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    row, col, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    ln = lambda i: f"({lc(row, i)} + {lc(f'({n} - {row})', f'({col} - {i})')} - {lc(n, col)})"
    return f"least(1.0, list_sum(list_transform(list_filter(range(greatest(0, {col} - ({n} - {row})), least({row}, {col}) + 1), lambda i: {ln('i')} <= {ln(a)} + ln(1 + 1e-7)), lambda i: exp({ln('i')}))))"
