"""Tail functions on math and numpy: normal, beta, chi-square, hypergeometric and Kolmogorov-Smirnov."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
#: Least chance relative to the likeliest that counts; greatest product of two sizes for the exact Kolmogorov-Smirnov test.
TINY, EXACT = 1e-300, 10_000_000


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def beta_ppf(p: float, a: float, b: float) -> float:
    """Quantile of the beta distribution by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if beta_cdf(mid, a, b) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of chi-square: regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    a, x = dof / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _outward(ratio: Callable[[np.ndarray], np.ndarray], start: int, stop: int, piece: int = 1 << 14) -> np.ndarray:
    """Weights of the places start, start + 1, ... before stop, from products of ratios; the place before has weight 1.

    Ratios fall with the distance, so once a weight is below ``TINY`` with a ratio below 1 what is left is below
    TINY / (1 - ratio): it is left out.
    """
    out, last = [], 1.0
    while start < stop and last > TINY:
        r = ratio(np.arange(start, min(start + piece, stop), dtype=np.float64))
        out.append(last * np.cumprod(r))
        last, start = float(out[-1][-1]), start + piece
    return np.concatenate(out) if out else np.zeros(0)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: tables as likely as it or less.

    Chances relative to the likeliest table come from the ratios of neighbours, outward from it. Tables below ``TINY`` of it are
    left out, so the work grows with the root of the counts; a table out there has p 0.
    """
    r1, r2, k = a + b, c + d, a + c
    lo, hi = max(0, k - r2), min(k, r1)
    mode = min(hi, max(lo, (r1 + 1) * (k + 1) // (r1 + r2 + 2)))
    right = _outward(lambda x: (r1 - x + 1) * (k - x + 1) / (x * (r2 - k + x)), mode + 1, hi + 1)
    left = _outward(lambda t: (mode - t + 1) * (r2 - k + mode - t + 1) / ((r1 - mode + t) * (k - mode + t)), 1, mode - lo + 1)
    at = 1.0 if a == mode else right[a - mode - 1] if mode < a <= mode + len(right) else left[mode - a - 1] if mode - len(left) <= a < mode else 0.0
    both = np.concatenate([left, [1.0], right])
    return float(min(1.0, np.sort(both[both <= at * (1 + 1e-7)]).sum() / np.sort(both).sum()))


def ks_p(d: float, n1: int, n2: int) -> float:
    """Two-sided p of a two-sample Kolmogorov-Smirnov distance: exact up to ``EXACT`` pairs of sizes, beyond that asymptotic."""
    if not n1 or not n2 or d <= 0:
        return 1.0
    return ks_exact(d, n1, n2) if n1 * n2 <= EXACT else ks_asymptotic(d, n1, n2)


def ks_exact(d: float, n1: int, n2: int) -> float:
    """Chance that a random order of n1 and n2 values has that distance or more.

    Orders are lattice paths. Chances of places within the distance go from diagonal to diagonal; what leaves is added up, so
    small p lose no digits.
    """
    reach = int(round(d * n1 * n2))  # distances are multiples of 1 / (n1 n2)
    i = np.arange(n1 + 1)
    chance, out = np.zeros(n1 + 1), 0.0
    chance[0] = 1.0
    for step in range(n1 + n2):
        left = n1 + n2 - step
        up = chance * np.clip(n1 - i, 0, None) / left  # the next value is one of the first sample
        chance = chance * np.clip(n2 - (step - i), 0, None) / left
        chance[1:] += up[:-1]
        outside = np.abs(i * n2 - (step + 1 - i) * n1) >= reach
        out += float(chance[outside].sum())
        chance[outside] = 0.0
    return min(1.0, out)


def ks_asymptotic(d: float, n1: int, n2: int) -> float:
    if not n1 or not n2 or d <= 0:
        return 1.0
    x = d * math.sqrt(n1 * n2 / (n1 + n2))
    if x < 0.3:
        return 1.0
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def clopper_pearson(successes: int, trials: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval; (0, 1) without trials."""
    if trials < 0 or not 0 <= successes <= max(trials, 0):
        raise ValueError("successes must lie between 0 and trials")
    if trials == 0:
        return 0.0, 1.0
    a = 1 - confidence
    return 0.0 if successes == 0 else beta_ppf(a / 2, successes, trials - successes + 1), 1.0 if successes == trials else beta_ppf(1 - a / 2, successes + 1, trials - successes)
