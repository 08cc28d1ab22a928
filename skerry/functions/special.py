"""Tails of the chi-square, Student and F distributions for any degrees of freedom, as column expressions.

They rest on the incomplete gamma and beta functions: a power series where it converges fast, a continued fraction
elsewhere, each as a fold over a fixed number of steps, so that they stay in the engine. Put them into a ``withColumn`` of
their own: within one ``select``, names in a fold also see the aliases that the select gives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 300
_SHIFT = 9
#: Of Stirling's series: Bernoulli numbers B(2 k) over 2 k (2 k - 1).
_STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]
_LEAST = 1e-300


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def log_gamma(x: Column) -> Column:
    """For x > 0: Stirling's series at x + 9, less the logarithms of the factors in between."""
    z = x + F.lit(float(_SHIFT))
    series = sum((F.lit(c) / F.pow(z, F.lit(2.0 * k + 1)) for k, c in enumerate(_STIRLING)), F.lit(0.0))
    product = F.lit(1.0)
    for k in range(_SHIFT):
        product = product * (x + F.lit(float(k)))
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series - F.log(product)


def _gamma_series(a: Column, x: Column) -> Column:
    """The sum of x^n / (a + 1) ... (a + n), from 1 on."""
    first = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, n: Column) -> Column:
        t = acc["t"] * x / (a + n)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.aggregate(_steps(STEPS), first, step, lambda acc: acc["s"])


def _lentz(first_d: Column, terms, steps: int = STEPS) -> Column:
    """A continued fraction 1 / (d + ...) by forward steps; ``terms(n)`` gives the nth pair of numbers (numerator, denominator)."""
    safe = lambda v: F.when(F.abs(v) < _LEAST, F.lit(_LEAST)).otherwise(v)
    d = 1 / safe(first_d)
    start = F.struct(F.lit(1 / _LEAST).alias("c"), d.alias("d"), d.alias("h"))

    def step(acc: Column, n: Column) -> Column:
        a, b = terms(n.cast("double"))
        d = 1 / safe(b + a * acc["d"])
        c = safe(b + a / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    return F.aggregate(_steps(steps), start, step, lambda acc: acc["h"])


def gamma_tail(a: Column, x: Column) -> Column:
    """The upper regularised incomplete gamma function, a > 0; 1 for x of 0 or less."""
    a, x = a.cast("double"), F.greatest(x.cast("double"), F.lit(_LEAST))
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    low = 1 - front * _gamma_series(a, x) / a
    high = front * _lentz(x + 1 - a, lambda n: (-n * (n - a), x + 1 - a + 2 * n))
    return F.when(x < a + 1, F.greatest(low, F.lit(0.0))).otherwise(high)


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for 0 <= x <= 1, a and b > 0."""
    a, b = a.cast("double"), b.cast("double")
    x = F.least(F.greatest(x.cast("double"), F.lit(_LEAST)), F.lit(1.0))
    rest = F.greatest(1 - x, F.lit(_LEAST))

    def part(p: Column, q: Column, y: Column) -> Column:
        def terms(n: Column):  # odd and even terms in turn
            m = F.floor(n / 2).cast("double")
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(n % 2 == 0, even).otherwise(odd), F.lit(1.0)

        return _lentz(F.lit(1.0), terms, 2 * STEPS) / p

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest))
    return F.when(x < (a + 1) / (a + b + 2), front * part(a, b, x)).otherwise(1 - front * part(b, a, rest))


def chi_square_tail(h: Column, df: Column) -> Column:
    """P(X >= h)."""
    return gamma_tail(df / 2, h / 2)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(abs(T) >= abs(t)); 0 for an infinite t."""
    return beta_share(df / (df + t * t), df / 2, F.lit(0.5))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F >= f)."""
    return beta_share(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)
