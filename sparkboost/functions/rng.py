"""Uniform and normal draws as pure functions of integer keys.

A draw depends on its keys alone, so that it is the same on any number of partitions and when
a lost partition is computed again.  A row's 64-bit key goes through a chain of affine and quadratic
maps modulo different primes; the seed, the round and the slot pick their factors, so that draws
of different rounds or slots are independent.  All products stay within 62 bits: numpy and SQL
repeat the arithmetic, and no key overflows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest primes below 2**31.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_MASK = (1 << 31) - 1


def _maps(seed: int, iteration: int, slot: int) -> list[int]:
    """Multipliers of the key's three parts and a shift, then a multiplier and a shift for each further prime."""
    return [1 + int(draw(seed, iteration, slot, k, 11) * (PRIMES[-1] - 1)) for k in range(4 + 2 * (len(PRIMES) - 1))]


def uniform(row: Column, seed: int, iteration: int = 0, slot: int = 0) -> Column:
    """A number in (0, 1) for each whole row key."""
    m, key = _maps(seed, iteration, slot), row.cast("long")
    parts = (key.bitwiseAND(_MASK), F.shiftright(key, 31).bitwiseAND(_MASK), F.shiftright(key, 62).bitwiseAND(3))
    x = sum(((p * F.lit(a)) % F.lit(PRIMES[0]) for p, a in zip(parts, m, strict=False)), F.lit(m[3]))
    x = x % F.lit(PRIMES[0])
    for k, prime in enumerate(PRIMES[1:]):
        factor = F.lit(m[4 + 2 * k]) if prime == PRIMES[-1] else (x + F.lit(m[4 + 2 * k])) % F.lit(prime)
        x = (x * factor + F.lit(m[5 + 2 * k])) % F.lit(prime)
    return (x + 0.5) / float(PRIMES[-1])


def uniform_sql(row: str, seed: int, iteration: int = 0, slot: int = 0) -> str:
    """The same draw in SQL."""
    m, key = _maps(seed, iteration, slot), f"CAST({row} AS BIGINT)"
    parts = (f"({key} & {_MASK})", f"(({key} >> 31) & {_MASK})", f"(({key} >> 62) & 3)")
    x = " + ".join([*(f"{p} * {a} % {PRIMES[0]}" for p, a in zip(parts, m, strict=False)), str(m[3])])
    x = f"(({x}) % {PRIMES[0]})"
    for k, prime in enumerate(PRIMES[1:]):
        factor = m[4 + 2 * k] if prime == PRIMES[-1] else f"(({x} + {m[4 + 2 * k]}) % {prime})"
        x = f"(({x} * {factor} + {m[5 + 2 * k]}) % {prime})"
    return f"(({x} + 0.5) / {float(PRIMES[-1])!r})"


def uniforms(row: np.ndarray, seed: int, iteration: int = 0, slot: int = 0) -> np.ndarray:
    """The same draw of an array of keys."""
    m, key = _maps(seed, iteration, slot), row.astype(np.int64)
    x = (sum((p * a) % PRIMES[0] for p, a in zip((key & _MASK, (key >> 31) & _MASK, (key >> 62) & 3), m, strict=False)) + m[3]) % PRIMES[0]
    for k, prime in enumerate(PRIMES[1:]):
        factor = m[4 + 2 * k] if prime == PRIMES[-1] else (x + m[4 + 2 * k]) % prime
        x = (x * factor + m[5 + 2 * k]) % prime
    return (x + 0.5) / PRIMES[-1]


def normal(row: Column, seed: int, iteration: int = 0, slot: int = 0) -> Column:
    """A standard normal number by the Box-Muller formula."""
    u, v = (uniform(row, seed, iteration, (2 * slot + k + 1) << 20) for k in (0, 1))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def draw(seed: int, *keys: int) -> float:
    """A driver-side number in [0, 1) of integer keys."""
    x = seed & (1 << 64) - 1
    for k in (0x5EED, *keys, 0):  # the seed is mixed by itself first
        x = (x ^ (k & (1 << 64) - 1)) + 0x9E3779B97F4A7C15 & (1 << 64) - 1
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        x ^= x >> 31
    return x / 2.0**64
