"""Tail probabilities and quantiles from published expansions, in plain Python.

They are called on the handful of numbers that an aggregate leaves, never on rows.
"""

from __future__ import annotations

import math


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def f_tail(x: float, df1: float, df2: float) -> float:
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if x > 0 else 1.0


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse normal by bisection and Newton steps."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    low, high = -40.0, 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - normal_tail(mid) < p else (low, mid)
    z = (low + high) / 2
    for _ in range(2):
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        z -= (1 - normal_tail(z) - p) / density if density > 1e-300 else 0
    return z


def kolmogorov_tail(d: float, n: int) -> float:
    """Two-sided limit distribution with the usual small-sample correction."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def shapiro(values: list[float]) -> tuple[float, float]:
    """Royston's approximation of the Shapiro-Wilk W and its p-value, for 3 to 5000 values."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    norm = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    poly = lambda c: sum(k * u**i for i, k in enumerate(c))
    # Royston's polynomial coefficients, constant term first.
    last = m[-1] / math.sqrt(norm) + poly([0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056])
    before = m[-2] / math.sqrt(norm) + poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    elif n <= 5:
        phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = [-last, *[v / math.sqrt(phi) for v in m[1:-1]], last]
    else:
        phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a = [-last, -before, *[v / math.sqrt(phi) for v in m[2:-2]], before, last]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    y, ln = math.log(max(1 - w, 1e-300)), math.log(n)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mu = 0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sd = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, normal_tail((y - mu) / sd)
