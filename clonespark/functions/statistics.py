"""Tail probabilities and model weights.

Closed forms are native columns. The two incomplete integrals have no built-in
counterpart, so they run as vectorised Arrow UDFs over numpy (SciPy is not a
dependency): a whole batch advances one series term at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lanczos coefficients (g = 7, nine terms).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Γ(x) for x > 0."""
    x = np.asarray(x, dtype=float)
    z = np.where(x < 0.5, 1 - x, x) - 1
    series = np.full_like(z, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + c / (z + i)
    t = z + 7.5
    value = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(series)
    with np.errstate(divide="ignore", invalid="ignore"):
        reflected = math.log(math.pi) - np.log(np.abs(np.sin(math.pi * x))) - value
    return np.where(x < 0.5, reflected, value)


def gamma_p(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(shape, x)."""
    a, x = np.broadcast_arrays(np.asarray(shape, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    live = x > 0
    if not live.any():
        return out
    a, x = a[live], x[live]
    scale = np.exp(-x + a * np.log(x) - log_gamma(a))
    low = x < a + 1
    result = np.empty_like(x)
    if low.any():
        al, xl = a[low], x[low]
        term = 1 / al
        total, denominator = term.copy(), al.copy()
        for _ in range(10_000):
            denominator += 1
            term = term * xl / denominator
            total += term
            if np.all(np.abs(term) < np.abs(total) * 1e-14):
                break
        else:
            raise ArithmeticError("The series of the incomplete gamma function has not converged.")
        result[low] = total * scale[low]
    if (~low).any():
        ah, xh = a[~low], x[~low]
        tiny = 1e-300
        b = xh + 1 - ah
        c = np.full_like(xh, 1 / tiny)
        d = 1 / np.maximum(b, tiny)
        fraction = d.copy()
        for i in range(1, 10_000):
            numerator = -i * (i - ah)
            b = b + 2
            d = numerator * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = d * c
            fraction = fraction * delta
            if np.all(np.abs(delta - 1) < 1e-14):
                break
        else:
            raise ArithmeticError("The fraction of the incomplete gamma function has not converged.")
        result[~low] = 1 - scale[~low] * fraction
    out[live] = np.clip(result, 0, 1)
    return out


def poisson_tail(observed: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """P(Poisson(rate) > observed)."""
    observed, rate = np.broadcast_arrays(np.asarray(observed, float), np.asarray(rate, float))
    shape = np.maximum(np.floor(observed) + 1, 1)
    tail = gamma_p(shape, np.where(rate > 0, rate, 0))
    return np.where(~(rate > 0), 0.0, np.where(observed < 0, 1.0, tail))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        d = 1 / guard(1 + even * d)
        c = guard(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        d = 1 / guard(1 + odd * d)
        c = guard(1 + odd / c)
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1) < 3e-12):
            return h
    raise ArithmeticError("The fraction of the incomplete beta function has not converged.")


def regularized_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    out = np.where(x >= 1, 1.0, 0.0)
    live = (x > 0) & (x < 1)
    if not live.any():
        return out
    xs, as_, bs = x[live], a[live], b[live]
    front = np.exp(log_gamma(as_ + bs) - log_gamma(as_) - log_gamma(bs) + as_ * np.log(xs) + bs * np.log1p(-xs))
    swap = xs >= (as_ + 1) / (as_ + bs + 2)
    p, q, y = np.where(swap, bs, as_), np.where(swap, as_, bs), np.where(swap, 1 - xs, xs)
    part = front * _beta_fraction(p, q, y) / p
    out[live] = np.where(swap, 1 - part, part)
    return out


def binomial_tail(successes: np.ndarray, trials: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """P(Binomial(trials, p) >= successes)."""
    s, n, p = (np.asarray(v, float) for v in np.broadcast_arrays(successes, trials, probability))
    p = np.clip(p, 1e-12, 1 - 1e-12)
    ok = (s > 0) & (s <= n)
    tail = regularized_beta(p, np.where(ok, s, 1), np.where(ok, n - s + 1, 1))
    return np.where(s <= 0, 1.0, np.where(s > n, 0.0, np.clip(tail, 0, 1)))


@F.pandas_udf(T.DoubleType())
def poisson_upper_tail(observed: pd.Series, rate: pd.Series) -> pd.Series:
    """P(Poisson(rate) > observed), per row."""
    return pd.Series(poisson_tail(observed.to_numpy(), rate.to_numpy()))


@F.pandas_udf(T.DoubleType())
def binomial_survival(successes: pd.Series, trials: pd.Series, probability: pd.Series) -> pd.Series:
    """P(Binomial(trials, probability) >= successes), per row."""
    return pd.Series(binomial_tail(successes.to_numpy(), trials.to_numpy(), probability.to_numpy()))


def digamma(value: Column) -> Column:
    """Digamma of a positive column: shift above eight, then the asymptotic series."""
    shift: Column = F.lit(0.0)
    for i in range(8):
        shift = shift + F.when(value + i < 8, 1.0 / (value + i)).otherwise(0.0)
    x = F.when(value < 8, value + F.ceil(F.lit(8.0) - value)).otherwise(value)
    inverse = 1.0 / x
    square = inverse * inverse
    return F.log(x) - 0.5 * inverse - square * (1 / 12 - square * (F.lit(1 / 120) - square / 252)) - shift


def alternative_count(length: Column, distance: Column, maximum: int) -> Column:
    """C(length, d)·3^d, at least one: the number of d-substitution neighbours."""
    product: Column = F.lit(1.0)
    for i in range(1, maximum + 1):
        product = product * F.when(F.lit(i) <= distance, (length - distance + i) / F.lit(float(i))).otherwise(1.0)
    return F.when(distance <= 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0), product * F.pow(F.lit(3.0), distance.cast("double")))
    )


def exact_error_rate(count: Column, length: Column, distance: Column, error_rate: float) -> Column:
    """Expected copies of one specific d-substitution error of a parent."""
    hit = F.pow(F.lit(error_rate / 3), distance.cast("double"))
    miss = F.pow(F.lit(1 - error_rate), F.greatest(F.lit(0), length - distance).cast("double"))
    return count * hit * miss


def mutation_null_probability(rate: Column, is_hotspot: Column) -> Column:
    base = F.greatest(F.lit(1e-5), rate / 3) * F.when(is_hotspot, 5).otherwise(1)
    return F.least(F.lit(0.25), base)


def neighbour_odds(
    shm: Column, baseline: float, sensitivity: float, maximum_shm: float, maximum_odds: float
) -> Column:
    """Per-SNP odds of a reported call hiding an unreported neighbour."""
    base = min(0.999999, max(0.0, baseline))
    mu = F.greatest(F.lit(0.0), F.least(F.lit(min(0.95, max(0.0, maximum_shm))), F.coalesce(shm, F.lit(0.0))))
    somatic = F.when(mu > 0, F.lit(max(0.0, sensitivity)) * mu / (3 * (1 - mu))).otherwise(0.0)
    return F.least(F.lit(min(0.999999, max(0.0, maximum_odds))), F.lit(base) + somatic)
