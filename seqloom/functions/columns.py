"""Scalar functions as Column expressions: tolerance and coverage statistics, sequences, CIGAR and vector algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R_TOL, A_TOL, KMER, READ_LENGTH = 0.25, 300, 127, 300


def approx_compare(x: Column, y: Column, tol: float = R_TOL) -> Column:
    """0 if both are 0 or differ by at most tol of the larger size, else the sign of the difference."""
    top = F.greatest(F.abs(x), F.abs(y))
    return F.when((top == 0) | (F.abs(x - y) / top <= tol), F.lit(0)).when(x > y, F.lit(1)).otherwise(F.lit(-1))


def poisson_distance(a: Column, b: Column) -> Column:
    """Symmetric divergence of two Poisson means."""
    return 0.5 * (a - b) * (F.ln(a) - F.ln(b))


def read_coverage(count: Column, length: Column, k: int = KMER, read: int = READ_LENGTH) -> Column:
    """From a k-mer count to read coverage."""
    return count / (length - k) * read / (read - k + 1)


def a_statistic(length: Column, cov: Column, mean: Column, read: int = READ_LENGTH) -> Column:
    return (length * mean / read - math.log(2) * cov * length / read) * math.log10(math.e)


def useful_margin(rs: Column, re: Column, rl: Column, ts: Column, te: Column, tl: Column, q: Column, prime: Column | None = None, min_q: int = 10) -> Column:
    """Whether a hit reaches an end of the read or the contig on both sides, close to a contig end, and is primary and of enough quality.

    One tolerance holds for all four distances: A_TOL or a quarter of the contig's length, whichever is less, in whole bases.
    """
    tol = F.least(F.lit(A_TOL), F.floor(R_TOL * tl))
    low, high = F.least(rs, re), F.greatest(rs, re)
    read_left, read_right = F.when(rs <= re, low - 1).otherwise(rl - high), F.when(rs <= re, rl - high).otherwise(low - 1)
    t_left, t_right = ts - 1, tl - te
    good = ((read_left < tol) | (t_left < tol)) & ((read_right < tol) | (t_right < tol)) & (F.least(t_left, t_right) < tol)
    return good & (F.lit(True) if prime is None else prime) & (q >= min_q)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def reverse_vector(m: Column, d: Column) -> tuple[Column, Column]:
    return F.when(d > 0, -m).otherwise(m), d


def compose(m1: Column, d1: Column, m2: Column, d2: Column) -> tuple[Column, Column]:
    """The second vector first, then the first."""
    return m2 + d2 * m1, d1 * d2


def tip_distance(m: Column, d: Column, to_length: Column, from_length: Column) -> Column:
    """Distance between the near ends of two contigs; negative for an overlap."""
    start, end = F.when(d > 0, m).otherwise(m - from_length), F.when(d > 0, m + from_length).otherwise(m)
    return F.greatest(start - to_length, -end)


def canonical_edge(a: Column, a_out: Column, b: Column, b_out: Column) -> Column:
    """Text of an edge, independent of the order of its ends: text order of the names decides."""
    sign = lambda out, flip: F.when(out != F.lit(flip), F.lit("+")).otherwise(F.lit("-"))
    one = F.concat(a, sign(a_out, False), F.lit(","), b, sign(b_out, True))
    other = F.concat(b, sign(b_out, False), F.lit(","), a, sign(a_out, True))
    loop = F.when(a_out != b_out, F.concat(a, F.lit("+,"), a, F.lit("+"))).when(a_out, F.concat(a, F.lit("+,"), a, F.lit("-"))).otherwise(F.concat(a, F.lit("-,"), a, F.lit("+")))
    return F.when(a == b, loop).when(a < b, one).otherwise(other)
