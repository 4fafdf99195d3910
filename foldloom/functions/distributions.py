"""Tail probabilities and two tests' exact parts, in plain Python: their inputs are single numbers or one small group."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def _gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def _beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_i(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for coefficient in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + coefficient * d or tiny)
            c = 1 + coefficient / c or tiny
            step = c * d
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h / a


def chi2_sf(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    if math.isinf(x):
        return 0.0
    return _beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return _beta_i(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return 2 * _NORMAL.cdf(-abs(z))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p after Royston (1995), for 3 to 5,000 values, p being less exact above; constant values give W = 1, p = 1."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if x[-1] - x[0] < 1e-300:
        return 1.0, 1.0
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(mm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # fixed values: the published polynomial corrections of the outer weights
        last = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u))
        if n > 5:
            second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u))
            scale = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(scale)
            a[[-1, -2, 1, 0]] = last, second, -second, -last
        else:
            scale = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(scale)
            a[[-1, 0]] = last, -last
    d = x - x.mean()
    w = min(1.0, float((a @ x) ** 2 / (d @ d)))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    return w, shapiro_p(w, n)


def shapiro_p(w: float, n: int) -> float:
    """p of W for 4 values or more."""
    y, g = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return 1e-99
        y = -math.log(gamma - y)
        mu = float(np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n))
        sigma = math.exp(float(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)))
    else:
        mu = float(np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], g))
        sigma = math.exp(float(np.polyval([0.0030302, -0.082676, -0.4803], g)))
    return _NORMAL.cdf(-(y - mu) / sigma)


def normal_scores(first: int, last: int, n: int) -> tuple[float, float]:
    """Sums of the expected normal scores, and of their squares, of ranks ``first`` to ``last`` among ``n``."""
    m = [_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(first, last + 1)]
    return math.fsum(m), math.fsum(x * x for x in m)


def shapiro_from_sums(n: int, mm: float, mx: float, ends: tuple[float, float, float, float], squares: float) -> tuple[float, float]:
    """W and p of 6 values or more from sums, as :func:`shapiro_wilk`: ``mm`` of squared normal scores, ``mx`` of scores times
    values, ``squares`` of squared deviations; ``ends``: the two least and the two greatest values in order. Above 5,000 values,
    where Royston checked his approximation no further, its formulas are carried on, as SciPy does: W stands, p is approximate."""
    if ends[3] - ends[0] < 1e-300:
        return 1.0, 1.0
    u = 1 / math.sqrt(n)
    outer, inner = _NORMAL.inv_cdf((n - 0.375) / (n + 0.25)), _NORMAL.inv_cdf((n - 1.375) / (n + 0.25))
    # fixed values: the published polynomial corrections of the outer weights, as above
    last = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, outer / math.sqrt(mm)], u))
    second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, inner / math.sqrt(mm)], u))
    root = math.sqrt((mm - 2 * outer**2 - 2 * inner**2) / (1 - 2 * last**2 - 2 * second**2))
    wide, narrow = ends[3] - ends[0], ends[2] - ends[1]
    ax = (mx - outer * wide - inner * narrow) / root + last * wide + second * narrow
    w = min(1.0, ax * ax / squares)
    return w, shapiro_p(w, n)


def signed_rank_p(w: float, n: int, ties: float, zeros: bool) -> float:
    """Two-sided p of the signed-rank statistic ``w`` (the lesser sum) of ``n`` non-zero differences: exact for up to 50
    without ties or zeros, else normal; ``ties``: the sum of t^3 - t over tied groups. NaN for no differences."""
    if n == 0:
        return math.nan
    if n <= 50 and not ties and not zeros:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    sd = math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return normal_two_sided((w - n * (n + 1) / 4) / sd) if sd else math.nan
