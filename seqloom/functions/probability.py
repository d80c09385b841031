"""Distributions as Column expressions. What is random takes its numbers from a seed and a key, so a task that runs again draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PSEUDO_COUNT = 1
HALF_LOG_2_PI = 0.5 * math.log(2 * math.pi)


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) with 32 bits from the digest of a seed and a key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def log_logistic(u: Column, scale: Column, shape: Column) -> Column:
    """The value below which a share u of a log-logistic distribution lies."""
    return scale * F.pow(u / (1 - u), 1 / shape)


def log_logistic_density(x: Column, scale: Column, shape: Column) -> Column:
    """A density in which the shape also multiplies the scaled value, unlike in textbooks."""
    z = x / scale
    return F.pow(shape * z, -shape - 1) / F.pow(1 + F.pow(z, -shape), 2)


def stirling_error(n: Column) -> Column:
    """ln n! less Stirling's approximation, for whole n: exact below 16, a series of five terms above."""
    low = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - HALF_LOG_2_PI if i else 0.0) for i in range(16)])
    z = n.cast("double")
    w = 1 / (z * z)
    series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z
    return F.when(n < 16, F.get(low, n.cast("int"))).otherwise(series)


def deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, written so that values near the mean lose no digits; the mean itself where x is 0."""
    r = (x - mean) / mean
    return F.when(x == 0, mean).otherwise(mean * ((1 + r) * F.log1p(r) - r))


def log_binomial(x: Column, n: Column, p: Column) -> Column:
    """Logarithm of the chance of x successes in n trials, by saddle points; all or none need no expansion."""
    inner = stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    return F.when(x == 0, n * F.log1p(-p)).when(x == n, n * F.ln(p)).otherwise(inner - 0.5 * F.ln(2 * math.pi * x * (n - x) / n))


def beta_ratio(count_r: Column, total_r: Column, count_s: Column, total_s: Column) -> Column:
    """Struct (mean, sd) of S / R for independent Beta posteriors with a pseudo count: the exact moments that samples tend to.

    Null where R's posterior has no such moment: the mean needs count_r > 0, the deviation count_r > 1.
    """
    a, b = count_r + PSEUDO_COUNT, total_r - count_r + PSEUDO_COUNT
    c, d = count_s + PSEUDO_COUNT, total_s - count_s + PSEUDO_COUNT
    first = F.when(a > 1, c / (c + d) * (a + b - 1) / (a - 1))
    second = F.when(a > 2, c * (c + 1) / ((c + d) * (c + d + 1)) * (a + b - 1) * (a + b - 2) / ((a - 1) * (a - 2)))
    return F.struct(first.alias("mean"), F.sqrt(second - first * first).alias("sd"))


def weighted_choice(u: Column, weights: Column) -> Column:
    """Place, from 0, of the weight in which u falls when they are laid end to end; 0 where u is beyond all of them."""
    walk = F.aggregate(
        weights,
        F.struct(u.alias("rest"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("got")),
        lambda s, w: F.struct((s["rest"] - w).alias("rest"), (s["i"] + 1).alias("i"), F.coalesce(s["got"], F.when(s["rest"] <= w, s["i"])).alias("got")),
    )
    return F.coalesce(walk["got"], F.lit(0))


def random_sequence(seed: int, key: Column, length: Column, letters: str = "ACGT") -> Column:
    """A sequence of length letters, each as likely as the others; empty for a length below 1."""
    at = F.when(length > 0, F.sequence(F.lit(1), length.cast("int"))).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.substring(F.lit(letters), F.floor(uniform(seed, key, i) * len(letters)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(at, one), "")
