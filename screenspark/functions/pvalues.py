"""Tail probabilities for the drift tests, for tables with one row per feature."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to this many rows on either side the two-sample distribution is computed exactly.
EXACT_ROWS = 10_000
# Up to this size the law of one sample is computed exactly.
EXACT_SIZE = 80


def chi2_tail(stat: float, dof: int) -> float:
    """P(X >= stat) for a chi-square variable: the upper incomplete gamma ratio."""
    a, x = dof / 2.0, stat / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - scale * total)
    # Continued fraction of the upper part, evaluated by Lentz's method.
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in itertools.count(1):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def ks_tail_exact(stat: float, n: int, m: int) -> float:
    """P(D >= stat) for samples of n and m rows.

    All orders of the pooled sample are equally likely. Walking over the pooled
    positions, ``mass[i]`` is the probability that i of the values seen so far
    came from the first sample and the gap never reached ``stat``; what steps
    over the bound is added up.
    """
    bound = round(stat * n * m)
    mass = np.zeros(n + 1)
    mass[0] = 1.0
    lost = 0.0
    first = np.arange(n + 1)
    for seen in range(n + m):
        left = n + m - seen
        second = seen - first
        live = (second >= 0) & (second <= m)
        here = np.where(live, mass, 0.0)
        to_first = here * (n - first) / left
        to_second = here * (m - second) / left
        mass = to_second
        mass[1:] += to_first[:-1]
        gap = np.abs(first * m - (seen + 1 - first) * n)
        out = gap >= bound
        lost += float(mass[out].sum())
        mass[out] = 0.0
    return min(1.0, lost)


def ks_tail_one_sample(stat: float, size: int) -> float:
    """P(D >= stat) for one sample of ``size`` rows against a continuous law, exactly.

    The probability of staying below is ``size! / size**size`` times an entry of a
    matrix power; its rows are the places the empirical law can have inside the band.
    """
    if stat <= 0:
        return 1.0
    if stat >= 1:
        return 0.0
    k = math.ceil(size * stat)
    h, m = k - size * stat, 2 * k - 1
    steps = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    band = np.where(steps >= 0, 1.0, 0.0)
    corner = h ** np.arange(1, m + 1)
    band[:, 0] -= corner
    band[-1, :] -= corner[::-1]
    band[-1, 0] += max(0.0, 2 * h - 1) ** m
    factorials = np.array([math.factorial(max(0, s)) for s in range(m + 1)], float)
    band /= factorials[np.maximum(steps, 0)]
    below, power = np.eye(m), band
    for i in range(1, size + 1):  # size! / size**size is spread over the factors
        below = below @ power * (i / size)
    return min(1.0, max(0.0, 1.0 - float(below[k - 1, k - 1])))


def ks_tail_large(stat: float, n: int, m: int) -> float:
    """P(D >= stat) for large samples: the law of one sample of n m / (n + m) rows.

    Exact while that size is at most ``EXACT_SIZE``, else by the four-term
    expansion of Pelz and Good.
    """
    size = round(n * m / (n + m))
    if size <= EXACT_SIZE:
        return ks_tail_one_sample(stat, size)
    z = stat * math.sqrt(size)
    if z <= 0:
        return 1.0
    if z > 3:
        return min(1.0, 2 * math.exp(-2 * (z + 1 / (6 * math.sqrt(size))) ** 2))
    z2, z4, z6 = z**2, z**4, z**6
    k = np.arange(-60, 61)
    h, p2 = (k + 0.5) ** 2, math.pi**2
    e_half, e_full = np.exp(-p2 * h / (2 * z2)), np.exp(-p2 * k**2 / (2 * z2))
    root = math.sqrt(math.pi / 2)
    k0 = root / z * e_half.sum()
    k1 = root / (6 * z4) * ((p2 * h - z2) * e_half).sum()
    k2 = root / (72 * z**7) * (
        ((6 * z6 + 2 * z4) + p2 * (2 * z4 - 5 * z2) * h + p2**2 * (1 - 2 * z2) * h**2) * e_half
    ).sum() - root / (36 * z**3) * (p2 * k**2 * e_full).sum()
    k3 = root / (6480 * z**10) * (
        (
            p2**3 * h**3 * (5 - 30 * z2)
            + p2**2 * h**2 * (-60 * z2 + 212 * z4)
            + p2 * h * (135 * z4 - 96 * z6)
            - (30 * z6 + 90 * z**8)
        )
        * e_half
    ).sum() + root / (216 * z6) * ((3 * p2 * k**2 * z2 - p2**2 * k**4.0) * e_full).sum()
    below = k0 + k1 / math.sqrt(size) + k2 / size + k3 / size**1.5
    return min(1.0, max(0.0, 1.0 - below))


def ks_tail(stat: float, n: int, m: int) -> float:
    exact = max(n, m) <= EXACT_ROWS
    return ks_tail_exact(stat, n, m) if exact else ks_tail_large(stat, n, m)


@F.pandas_udf(T.DoubleType())
def drift_p_value(
    test: pd.Series, stat: pd.Series, dof: pd.Series, ref_n: pd.Series, prod_n: pd.Series
) -> pd.Series:
    def tail(kind: str, s: float, d: float, n: int, m: int) -> float | None:
        if s is None or math.isnan(s):
            return None
        return ks_tail(s, int(n), int(m)) if kind == "ks" else chi2_tail(s, int(d))

    return pd.Series([tail(*row) for row in zip(test, stat, dof, ref_n, prod_n, strict=True)], dtype="float64")
