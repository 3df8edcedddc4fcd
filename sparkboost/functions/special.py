"""Special functions that Spark and numpy lack, on numpy arrays."""

from __future__ import annotations

import math

import numpy as np

erf = np.vectorize(math.erf, otypes=[float])
lgamma = np.vectorize(math.lgamma, otypes=[float])


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: recurrence up to 8, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out - 1 / np.where(low, x, 1.0), out)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """For x > 0."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out = np.where(low, out + 1 / np.where(low, x * x, 1.0), out)
        x = np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(np.asarray(x, dtype=float) / math.sqrt(2)))


def normal_quantile(p: float) -> float:
    """By bisection on the distribution function."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_p(a: np.ndarray, x: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Lower regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.where(x > 0, 0.0, 0.0)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - lgamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        term = 1 / a[low]
        total, n = term.copy(), a[low].copy()
        for _ in range(steps):
            n += 1
            term = term * x[low] / n
            total += term
            if (np.abs(term) <= 1e-16 * np.abs(total)).all():
                break
        out[low] = front[low] * total
    high = x >= a + 1
    if high.any():
        b = x[high] + 1 - a[high]
        c, d = np.full(b.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, steps):
            n = -i * (i - a[high])
            b = b + 2
            d = 1 / _apart(n * d + b)
            c = _apart(b + n / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - front[high] * h
    return np.where(np.isposinf(x), 1.0, out)


def _apart(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    front = np.where((y > 0) & (y < 1), front, 0.0)
    c, d = np.ones_like(y), 1 / _apart(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, steps):
        n = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d = 1 / _apart(1 + n * d)
        c = _apart(1 + n / c)
        h = h * d * c
        n = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 / _apart(1 + n * d)
        c = _apart(1 + n / c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    value = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(turn, 1 - value, value)
