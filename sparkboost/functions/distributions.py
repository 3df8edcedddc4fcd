"""Distributions of the dist:* objectives, on numpy arrays of margins.

A family turns margins (logarithms of positive parameters, held within 30) into parameters, and
gives what training and evaluation need: gradients and curvatures of the negative log-likelihood,
log densities, distribution functions, quantiles, scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .special import beta_inc, digamma, gamma_p, lgamma, normal_cdf, trigamma

BOUND = 30.0
#: Terms of a sum over counts at most, and the mass that may be left out.
TERMS, LEFT_OUT = 1 << 16, 1e-12
PARAMETERS = {"normal": ("mean", "sigma"), "lognormal": ("mu", "sigma"), "gamma": ("mean", "shape"), "poisson": ("rate",), "negbinomial": ("mean", "size"), "student_t": ("loc", "scale", "df")}


def _exp(x: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(x, -BOUND, BOUND))


@dataclass
class Dist:
    """Distributions of one family, a row each."""

    family: str
    p: list[np.ndarray]

    @classmethod
    def of_margins(cls, family: str, m: list[np.ndarray]) -> Dist:
        m = [np.asarray(x, dtype=float) for x in m]
        if family in ("normal", "lognormal"):
            return cls(family, [m[0], _exp(m[1])])
        if family == "student_t":  # the scale is that of a Laplace-like width, so that it hardly depends on df
            df = 1 + _exp(m[2])
            return cls(family, [m[0], _exp(m[1]) * df / (df + 1), df])
        return cls(family, [_exp(x) for x in m])

    @property
    def counts(self) -> bool:
        return self.family in ("poisson", "negbinomial")

    def mean(self) -> np.ndarray:
        a, *b = self.p
        if self.family == "lognormal":
            return np.exp(a + b[0] ** 2 / 2)
        return np.where(b[1] > 1, a, np.nan) if self.family == "student_t" else a

    def variance(self) -> np.ndarray:
        a, *b = self.p
        with np.errstate(divide="ignore", invalid="ignore"):
            return {
                "normal": lambda: b[0] ** 2,
                "lognormal": lambda: np.expm1(b[0] ** 2) * np.exp(2 * a + b[0] ** 2),
                "gamma": lambda: a * a / b[0],
                "poisson": lambda: a,
                "negbinomial": lambda: a + a * a / b[0],
                "student_t": lambda: np.where(b[1] > 2, b[0] ** 2 * b[1] / (b[1] - 2), np.inf),
            }[self.family]()

    def log_prob(self, y: np.ndarray) -> np.ndarray:
        a, *b = self.p
        y = np.asarray(y, dtype=float)
        half = 0.5 * math.log(2 * math.pi)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.family == "normal":
                return -np.log(b[0]) - half - ((y - a) / b[0]) ** 2 / 2
            if self.family == "lognormal":
                return np.where(y > 0, -np.log(y) - np.log(b[0]) - half - ((np.log(y) - a) / b[0]) ** 2 / 2, -np.inf)
            if self.family == "gamma":
                rate = b[0] / a
                return np.where(y > 0, b[0] * np.log(rate) + (b[0] - 1) * np.log(y) - rate * y - lgamma(b[0]), -np.inf)
            if self.family == "poisson":
                return np.where(y >= 0, np.where(y > 0, y * np.log(a), 0.0) - a - lgamma(np.maximum(y, 0) + 1), -np.inf)
            if self.family == "negbinomial":
                z = np.maximum(y, 0)
                return np.where(y >= 0, lgamma(z + b[0]) - lgamma(b[0]) - lgamma(z + 1) - b[0] * np.log1p(a / b[0]) + np.where(z > 0, z * (np.log(a) - np.log(a + b[0])), 0.0), -np.inf)
            z2 = ((y - a) / b[0]) ** 2
            return lgamma((b[1] + 1) / 2) - lgamma(b[1] / 2) - 0.5 * np.log(b[1] * math.pi) - np.log(b[0]) - (b[1] + 1) / 2 * np.log1p(z2 / b[1])

    def cdf(self, y: np.ndarray) -> np.ndarray:
        a, *b = self.p
        y = np.asarray(y, dtype=float)
        if self.family == "normal":
            return normal_cdf((y - a) / b[0])
        if self.family == "lognormal":
            return np.where(y > 0, normal_cdf((np.log(np.where(y > 0, y, 1.0)) - a) / b[0]), 0.0)
        if self.family == "gamma":
            return gamma_p(b[0], np.maximum(y, 0) * b[0] / a)
        if self.family == "poisson":
            return np.where(y >= 0, 1 - gamma_p(np.floor(np.maximum(y, 0)) + 1, a), 0.0)
        if self.family == "negbinomial":
            return np.where(y >= 0, beta_inc(b[0], np.floor(np.maximum(y, 0)) + 1, b[0] / (a + b[0])), 0.0)
        z = (y - a) / b[0]
        tail = 0.5 * beta_inc(b[1] / 2, 0.5, b[1] / (b[1] + z * z))
        return np.where(z < 0, tail, 1 - tail)

    def quantile(self, p: float) -> np.ndarray:
        """By bisection between bounds that are doubled until they hold it; of counts the least with that mass."""
        n = np.broadcast(*self.p).shape
        low, high = np.full(n, 0.0 if self.counts or self.family in ("gamma", "lognormal") else -1.0), np.ones(n)
        middle = self.p[0] if self.family in ("normal", "student_t") else 0.0
        scale = self.p[1] if self.family in ("normal", "student_t") else np.maximum(self.mean(), 1e-300)
        at = lambda x: middle + scale * x
        for _ in range(1100):
            more = self.cdf(at(high)) < p
            if not more.any():
                break
            high = np.where(more, high * 2, high)
        for _ in range(1100 if self.family in ("normal", "student_t") else 0):
            less = self.cdf(at(low)) > p
            if not less.any():
                break
            low = np.where(less, low * 2, low)
        for _ in range(200):
            mid = (low + high) / 2
            below = self.cdf(at(mid)) < p
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        return np.floor(at(high) + 1e-9) if self.counts else at(high)

    def crps(self, y: np.ndarray) -> np.ndarray:
        """Continuous ranked probability score."""
        a, *b = self.p
        y = np.asarray(y, dtype=float)
        if self.family == "normal":
            z = (y - a) / b[0]
            return b[0] * (z * (2 * normal_cdf(z) - 1) + 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
        if self.family == "lognormal":
            m, w = np.exp(a + b[0] ** 2 / 2), (np.log(np.where(y > 0, y, 1.0)) - a) / b[0]
            spread = 2 * m * normal_cdf(-b[0] / math.sqrt(2))
            return np.where(y > 0, y * (2 * normal_cdf(w) - 1) + spread - 2 * m * normal_cdf(w - b[0]), spread - y)
        if self.family == "gamma":
            shape, rate, x = b[0], b[0] / a, np.maximum(y, 0)
            beta = np.exp(lgamma(shape + 0.5) - lgamma(shape)) / math.sqrt(math.pi)
            return y * (2 * gamma_p(shape, rate * x) - 1) - a * (2 * gamma_p(shape + 1, rate * x) - 1) - beta / rate
        if self.family == "student_t":
            z, v = (y - a) / b[0], b[1]
            density = np.exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * np.log(v * math.pi) - (v + 1) / 2 * np.log1p(z * z / v))
            below = Dist("student_t", [np.zeros_like(z), np.ones_like(z), v]).cdf(z)
            spread = 2 * np.sqrt(v) / (v - 1) * np.exp(_lbeta(0.5, v - 0.5) - 2 * _lbeta(0.5, v / 2))
            return b[0] * (z * (2 * below - 1) + 2 * density * (v + z * z) / (v - 1) - spread)
        # sum of (F(k) - [k >= y])^2 over counts, and the distance below 0
        total, run, k = np.where(y < 0, -y, 0.0), np.zeros_like(y), 0
        mass = np.exp(self.log_prob(np.zeros_like(y)))
        while k < TERMS:
            run = run + mass
            width = np.clip(y - k, 0, 1)  # the part of [k, k + 1) below y
            total = total + width * run**2 + (1 - width) * (1 - run) ** 2
            mass = mass * (a / (k + 1) if self.family == "poisson" else (k + b[0]) / (k + 1) * a / (a + b[0]))
            k += 1
            if k > y.max(initial=0) and (mass * np.maximum(k, 1) < LEFT_OUT).all() and (k > a).all():
                break
        return total

    def gradients(self, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(gradient, curvature) of the negative log-likelihood in each margin.

        Curvatures are the Fisher information; of a negative binomial's size and of Student's df, for
        which it has no closed form or vanishes, the observed one or the gradient's size where larger.
        """
        a, *b = self.p
        y = np.asarray(y, dtype=float)
        if self.family in ("normal", "lognormal"):
            z = ((np.log(y) if self.family == "lognormal" else y) - a) / b[0]
            return [(-z / b[0], 1 / b[0] ** 2), (1 - z * z, np.full_like(z, 2.0))]
        if self.family == "gamma":
            s, t = b[0], y / a
            return [(s * (1 - t), s), (s * (digamma(s) - np.log(s) - np.log(t) + t - 1), s * s * (trigamma(s) - 1 / s))]
        if self.family == "poisson":
            return [(a - y, a)]
        if self.family == "negbinomial":
            r, s = b[0], a + b[0]
            score = digamma(y + r) - digamma(r) - np.log1p(a / r) + (a - y) / s
            slope = trigamma(y + r) - trigamma(r) + a / (r * s) - (a - y) / (s * s)
            return [(r * (a - y) / s, a * r / s), (-r * score, np.maximum(np.abs(r * score + r * r * slope), 1e-6))]
        z, v = (y - a) / b[0], b[1]
        w, q = (v + 1) / (v + z * z), z * z / v
        g1 = 1 - w * z * z
        score = 0.5 * (digamma(v / 2) - digamma((v + 1) / 2) + 1 / v + np.log1p(q) - (v + 1) / v * q / (1 + q))
        g2 = (v - 1) * (score + g1 / (v * (v + 1)))
        info = 0.25 * (trigamma(v / 2) - trigamma((v + 1) / 2)) - (v + 5) / (2 * v * (v + 1) * (v + 3)) - 2 / (v * (v + 1) ** 2 * (v + 3))
        return [(-w * z / b[0], (v + 1) / ((v + 3) * b[0] ** 2)), (g1, 2 * v / (v + 3)), (g2, np.maximum(np.maximum((v - 1) ** 2 * info, np.abs(g2)), 1e-6))]


def _lbeta(a, b) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def family_of(objective: str) -> str:
    return objective.partition(":")[2]
