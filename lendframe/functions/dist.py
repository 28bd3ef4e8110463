"""Distribution functions: scalars for summaries on the driver, Column and SQL forms for plans."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_COEFS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def phi_inverse(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def phi_column(z: Column) -> Column:
    """Standard normal cdf, polynomial with an error below 7.5e-8; the same as ``phi_sql``."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (_COEFS[0] + t * (_COEFS[1] + t * (_COEFS[2] + t * (_COEFS[3] + t * _COEFS[4]))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def phi_sql(z: str) -> str:
    a = f"abs({z})"
    t = f"(1 / (1 + 0.2316419::double * {a}))"
    c = [f"({x})::double" for x in _COEFS]
    poly = f"{t} * ({c[0]} + {t} * ({c[1]} + {t} * ({c[2]} + {t} * ({c[3]} + {t} * {c[4]}))))"
    tail = f"(exp(-{a} * {a} / 2) / {math.sqrt(2 * math.pi)!r}::double * {poly})"
    return f"case when {z} >= 0 then 1 - {tail} else {tail} end"


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / (c if abs(c) > tiny else tiny)
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2) if x > 0 else 1.0


def chi2_ppf(p: float, df: float) -> float:
    low, high = 0.0, max(1.0, df)
    while chi2_sf(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    return 1.0 if k >= n else beta_cdf(1 - p, n - k, k + 1)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1 - beta_cdf(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 1.0


def wilcoxon_p(differences: list[float]) -> float:
    """Two-sided signed-rank p-value, zeros dropped: exact up to 50 pairs, or up to 13 with ties or zeros, else normal."""
    d = [x for x in differences if x]
    if not d:
        return 1.0
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    ranks, i, ties = [0.0] * len(d), 0, 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    n = len(d)
    plus = sum(r for r, x in zip(ranks, d) if x > 0)
    least = min(plus, n * (n + 1) / 2 - plus)
    if len(differences) <= 13 or n <= 50 and n == len(differences) and not ties:
        # ranks are halves where values tie: twice their sums are whole
        ways = [1] + [0] * (n * (n + 1))
        for r in ranks:
            for s in range(len(ways) - 1, round(2 * r) - 1, -1):
                ways[s] += ways[s - round(2 * r)]
        return min(1.0, 2 * sum(ways[: round(2 * least) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return two_sided((plus - n * (n + 1) / 4) / spread)
