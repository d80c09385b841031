"""Signals as arrays of doubles: normalising, normalised square difference by FFT, low-pass, peaks and template scans.

A signal is one row and one task handles it alone, in numpy on Arrow batches: an FFT needs it whole. Memory is a few times its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.functions.scalars import signal_codes  # noqa: F401

MIN_MONOMER, CUTOFF, THRESHOLD, ERROR = 50, 50, 0.5, 0.2


def normalised(x: np.ndarray) -> np.ndarray:
    """To mean 0 and sample deviation 1; a constant signal is all 0."""
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return (x - x.mean()) / sd if sd else np.zeros(len(x))


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """r(t), the sum of x(j) x(j + t), by an FFT of twice the length."""
    n = len(x)
    f = np.fft.rfft(x, 2 * n)
    return np.fft.irfft(f * np.conj(f), 2 * n)[:n]


def lag_square_sum(x: np.ndarray) -> np.ndarray:
    """m(t), the sum of the squares that r(t) is made of, each side: whole sums less what a lag leaves out."""
    q = x * x
    m = np.full(len(x), 2 * q.sum())
    m[1:] -= np.cumsum(q[:-1]) + np.cumsum(q[:0:-1])
    return m


def square_difference(x: np.ndarray) -> np.ndarray:
    """n(t) = 2 r(t) / m(t), 0 where m is 0."""
    m = lag_square_sum(x)
    return np.divide(2 * autocorrelation(x), m, out=np.zeros(len(x)), where=np.abs(m) > 1e-12)


def cross_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of x(j) y(j + t) for t from 0 on."""
    n = max(len(x), len(y))
    return np.fft.irfft(np.conj(np.fft.rfft(x, 2 * n)) * np.fft.rfft(y, 2 * n), 2 * n)[:n]


def blackman_sinc(n: int, cutoff: float = CUTOFF) -> np.ndarray:
    """Taps of a low-pass filter of n points under a Blackman window."""
    i = np.arange(n)
    ft = cutoff / n
    window = 0.42 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) + 0.08 * np.cos(4 * np.pi * i / (n - 1))
    return window * 2 * ft * np.sinc(2 * ft * (i - (n - 1) / 2))


def low_pass(x: np.ndarray, cutoff: float = CUTOFF) -> np.ndarray:
    """Circular convolution with the filter, turned back by the half window that it delays, for even lengths too."""
    n = len(x)
    if n < 2:
        return x
    y = np.fft.ifft(np.fft.fft(x) * np.fft.fft(blackman_sinc(n, cutoff))).real
    return np.roll(y, -((n - 1) // 2))


def prominent(x: np.ndarray, least: int = MIN_MONOMER, cutoff: float = CUTOFF, threshold: float = THRESHOLD) -> np.ndarray:
    """Places of the highest value between upward zero crossings, of those over threshold of the highest of all; the last stretch, that no crossing ends, has none."""
    stop = int(np.ceil(len(x) * (1 - 1 / cutoff)))
    if stop <= least:
        return np.zeros(0, np.int64)
    up = least + np.flatnonzero((x[least - 1 : stop - 1] <= 0) & (x[least:stop] > 0))
    tops = np.array([a + int(np.argmax(x[a:b])) for a, b in zip(up[:-1], up[1:], strict=True)], np.int64)
    return tops[x[tops] > threshold * x[tops].max()] if len(tops) else tops


def chopping_points(x: np.ndarray, error: float = ERROR, threshold: float = THRESHOLD, **how) -> list[int]:
    """Ends of the units of a concatemer: the first chain of peaks a period apart that holds over half of the peaks' height and fills the signal; else the last chain tried."""
    tops = prominent(x, threshold=threshold, **how)
    total, found = x[tops].sum(), []
    for i, first in enumerate(tops.tolist()):
        period, found, before = first, [first], first
        best, j = -1, i + 1
        while j < len(tops):
            at = int(tops[j])
            if abs(at - before - period) < period * error:
                best = at if best < 0 or x[at] > x[best] else best
            elif at - before > period:
                if best < 0:
                    break
                found.append(best)  # this peak lies beyond the window: look at it again from the next unit's end
                period, before, best = best - before, best, -1
                continue
            j += 1
        found += [best] if best >= 0 else []
        if x[found].sum() > total * (1 - threshold) and len(found) == len(x) // found[0]:
            break
    return found


def match_scan(template: str, query: str) -> np.ndarray:
    """For each shift of the template along the query, the share of equal letters in the overlap (its length less one, 0 for one letter)."""
    t, q = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (template, query))
    shifts = np.arange(len(t) + len(q) - 1)
    equal = np.zeros(len(shifts))
    for letter in np.intersect1d(t, q):  # a correlation for each letter in place of each pair of places
        n = len(shifts)
        equal += np.fft.irfft(np.fft.rfft(q == letter, n) * np.fft.rfft((t == letter)[::-1], n), n)
    over = np.minimum(shifts, len(q) - 1) - np.maximum(shifts - len(t) + 1, 0)
    return np.divide(np.rint(equal), over, out=np.zeros(len(shifts)), where=over > 0)


def best_near(scores: np.ndarray, at: int, window: int) -> int:
    """Place of the highest score within window of at, the nearest of equals, the first of equally near; -1 if none is above 0."""
    low, high = max(at - window, 0), min(at + window + 1, len(scores))
    part = scores[low:high]
    if not len(part) or part.max() <= 0:
        return -1
    tops = low + np.flatnonzero(part == part.max())
    return int(tops[np.argmin(np.abs(tops - at))])


def transformed(signals: DataFrame, how, least: int = 1) -> DataFrame:
    """(id, values) of signals (id, signal) of least points or more by a function of numpy arrays."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):  # signals may be long: few at once
                ids, cells = b.column(0).slice(i, 64), b.column(1).slice(i, 64)
                rows = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) if x.is_valid else np.zeros(0) for x in cells]
                kept = [j for j, x in enumerate(rows) if len(x) >= least]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array([how(rows[j]) for j in kept], pa.list_(pa.float64()))], ["id", "values"])

    return signals.select("id", "signal").mapInArrow(run, "id long, values array<double>")


def chopped(reads: DataFrame, **how) -> DataFrame:
    """(id, unit, first, last) of reads (id, seq): the units between chopping points of the filtered square difference of their base signal, 1-based. A read without points is one unit."""

    def points(x: np.ndarray) -> list[float]:
        return [float(p) for p in chopping_points(low_pass(square_difference(normalised(x)), how.get("cutoff", CUTOFF)), **how)]

    from pyspark.sql import functions as F

    coded = reads.select("id", signal_codes(F.col("seq")).alias("signal"))
    at = transformed(coded, points, 2).select("id", F.transform("values", lambda v: v.cast("long")).alias("at"))
    size = reads.select("id", F.length("seq").cast("long").alias("n"))
    cut = size.join(at, "id", "left").select("id", F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.coalesce("at", F.array().cast("array<bigint>")), F.array("n"))).alias("c"))
    pieces = cut.select("id", "c", F.posexplode(F.slice("c", 1, F.size("c") - 1)).alias("unit", "a"))
    return pieces.select("id", "unit", (F.col("a") + 1).alias("first"), F.get("c", F.col("unit") + 1).alias("last"))
