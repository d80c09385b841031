"""Scalar functions as Column expressions: coverage, likelihood and scale; sequences and their text forms; vectors of hits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.columns import A_TOL, KMER, R_TOL, READ_LENGTH, approx_compare, reverse_complement

ALPHA, MIN_SUPPORT, GOOD_SUPPORT, GOOD_QUALITY, SCORE_CAP = 0.5, 3, 20, 60, 6000
MARGIN, MIN_CONTIG, MAX_REPEAT = 1000, 300, 7500

# The standard genetic code, codons in the order T C A G of each place.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def normalised_coverage(cov: Column, mean: Column) -> Column:
    return cov * 100 / mean


def real_coverage(cov: Column, mean: Column) -> Column:
    return cov * mean / 100


def output_kmer_count(cov: Column, k: int = KMER, read: int = READ_LENGTH) -> Column:
    """The whole count written for a coverage; not the inverse of read_coverage."""
    return F.floor(cov * (read - k) / read).cast("long")


def node_log_odds(cov: Column, path_cov: Column, length: Column, phred: Column, visits: Column | None = None, read: int = READ_LENGTH) -> Column:
    """Evidence that a node is one copy of a path rather than ALPHA of one; each earlier visit takes the path's coverage off the node's."""
    left = cov if visits is None else cov - visits * path_cov
    return phred / 10 * (-math.log(ALPHA) * left * length / read + (ALPHA - 1) * length * path_cov / read)


def support_class(score: Column) -> Column:
    return F.when(score < MIN_SUPPORT * GOOD_QUALITY, 0).when(score < GOOD_SUPPORT * GOOD_QUALITY, 1).otherwise(2)


def error_probability(phred: Column) -> Column:
    return F.pow(F.lit(10.0), -phred / 10)


def phred(probability: Column) -> Column:
    return -10 * F.log10(probability)


def digits(n: Column) -> Column:
    """Decimal digits of a whole number, without its sign."""
    return F.length(F.abs(n).cast("string"))


def scaled(value: Column, window: Window, low: float = 0.0, high: float = 1.0) -> Column:
    """From the range within the window to low..high; unchanged where the range is a point."""
    a, b = F.min(value).over(window), F.max(value).over(window)
    return F.when(a == b, value).otherwise(low + (value - a) * (high - low) / (b - a))


def flanked(seq: Column, start: Column, end: Column, flank: int) -> Column:
    """Bases start to end (1-based) and flank more on both sides, N where the sequence has none."""
    n = F.length(seq)
    left, right = F.greatest(flank - (start - 1), F.lit(0)), F.greatest(end + flank - n, F.lit(0))
    inner = F.substring(seq, F.greatest(start - flank, F.lit(1)).cast("int"), (F.least(end + flank, n) - F.greatest(start - flank, F.lit(1)) + 1).cast("int"))
    return F.concat(F.repeat(F.lit("N"), left.cast("int")), inner, F.repeat(F.lit("N"), right.cast("int")))


def n_run(n: Column) -> Column:
    return F.repeat(F.lit("N"), n.cast("int"))


def first_mismatch(a: Column, b: Column, wildcard: str = "N") -> Column:
    """0 if equal, -1 if the lengths differ, else the first place (1-based) where b's letter is neither a's nor, in a, the wildcard."""
    x, y = F.split(a, ""), F.split(b, "")
    bad = F.array_position(F.zip_with(x, y, lambda p, q: (p != q) & (p != wildcard)), True)
    return F.when(F.length(a) != F.length(b), F.lit(-1)).when(F.length(a) == 0, F.lit(0)).otherwise(bad).cast("int")


def suffix_prefix(a: Column, b: Column, k: int) -> Column:
    """Length of the longest end of a, k at most, that b begins with."""
    top = F.least(F.lit(k), F.length(a), F.length(b))
    met = F.filter(F.sequence(F.lit(0), top), lambda n: F.right(a, n) == F.left(b, n))
    return F.array_max(met).cast("int")


def translated(seq: Column) -> Column:
    """Amino acids of the whole codons from the first base on; X where a base is none of ACGT."""
    at = lambda i: F.instr(F.lit("TCAG"), F.substring(seq, i, F.lit(1)))
    three = F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3))

    def one(i):
        a, b, c = at(i), at(i + 1), at(i + 2)
        known = (a > 0) & (b > 0) & (c > 0)
        return F.when(known, F.substring(F.lit(AMINO_ACIDS), 16 * (a - 1) + 4 * (b - 1) + c, F.lit(1))).otherwise("X")

    return F.when(F.length(seq) >= 3, F.array_join(F.transform(three, one), "")).otherwise("")


def signal_codes(seq: Column) -> Column:
    """Each base as a number: A -2, C -1, G 1, T 2, any other 0."""
    code = F.create_map(*[F.lit(x) for p in (("A", -2), ("C", -1), ("G", 1), ("T", 2)) for x in p])
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(code, c), F.lit(0)))


def oriented_read(seq: Column, flag: Column) -> Column:
    """The read as it was sequenced: SAM turns it where bit 16 of the flag is set."""
    return F.when(flag.bitwiseAND(F.lit(16)) != 0, reverse_complement(seq)).otherwise(seq)


def fastq_slice(name: Column, seq: Column, qual: Column, start: Column, end: Column) -> Column:
    """Bases start (0-based) to end of a read with their qualities; the name tells where."""
    cut = lambda x: F.substring(x, (start + 1).cast("int"), (end - start).cast("int"))
    return F.struct(F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")).alias("name"), cut(seq).alias("seq"), cut(qual).alias("qual"))


def edge_ends(edge: Column) -> Column:
    """The parts of an edge text `a+,b-`: names and whether it leaves each outward."""
    part = lambda i: F.regexp_extract(edge, r"^(.+)([+-]),(.+)([+-])$", i)
    return F.struct(part(1).alias("a"), (part(2) == "+").alias("a_out"), part(3).alias("b"), (part(4) == "-").alias("b_out"))


def bridge_keys(edge: Column) -> Column:
    """Anchor keys of a bridge text: each name with o where the bridge leaves it outward, else i."""
    x = edge_ends(edge)
    key = lambda n, out: F.concat(n, F.when(out, "o").otherwise("i"))
    return F.array(key(x["a"], x["a_out"]), key(x["b"], x["b_out"]))


def feature_text(kind: Column, start: Column, end: Column, name: Column, strand: Column, parent: Column, score: Column) -> Column:
    """The header line of an annotated feature."""
    return F.concat(F.lit(">>"), F.concat_ws(":", kind, start.cast("string"), end.cast("string"), name, strand, parent, score.cast("string")))


def useful_scaffold_hit(rs: Column, re: Column, rl: Column, ts: Column, te: Column, tl: Column, margin: int = MARGIN, least: int = MIN_CONTIG) -> Column:
    """A hit long enough that reaches, within margin, an end of the read or of the contig on both sides; read positions count along the contig's strand."""
    return ((rs - 1 < margin) | (ts - 1 < margin)) & ((rl - re < margin) | (tl - te < margin)) & (te + 1 - ts > least)


def consistent(m1: Column, d1: Column, m2: Column, d2: Column) -> Column:
    """Vectors of one direction whose magnitudes agree in proportion or within A_TOL."""
    return (d1 == d2) & ((approx_compare(m1.cast("double"), m2.cast("double"), R_TOL) == 0) | (F.abs(m1 - m2) < A_TOL))


def consistent_link(m1: Column, d1: Column, m2: Column, d2: Column, itself: Column) -> Column:
    """The scaffolder's rule: the second is three to five quarters of the first, or near it (nearer for a contig with itself)."""
    rate = m2 / F.nullif(m1, F.lit(0))
    return (d1 == d2) & (F.coalesce((rate > 0.75) & (rate < 1.25), F.lit(False)) | (F.abs(m2 - m1) < F.when(itself, 100).otherwise(250)))


def hit_vector(ars: Column, are: Column, ats: Column, ate: Column, a_fwd: Column, brs: Column, bre: Column, bts: Column, bte: Column, b_fwd: Column) -> Column:
    """(mag, dir): where the second contig lies to the first, by two hits of one read. Read positions run with the read, contig positions upward."""
    rate = (F.abs(ate - ats) + F.abs(bte - bts)) / (F.abs(are - ars) + F.abs(bre - brs))
    raw = (brs - ars) * rate
    along = F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw)).cast("long")
    g = along + F.when(a_fwd, ats).otherwise(-ats) - F.when(b_fwd, bts).otherwise(-bts)
    return F.struct(F.when(a_fwd, g).otherwise(-g).cast("long").alias("mag"), F.when(a_fwd == b_fwd, 1).otherwise(-1).alias("dir"))


def leftmost(m: Column, d: Column, length: Column) -> Column:
    return F.when(d > 0, m).otherwise(m - length)


def rightmost(m: Column, d: Column, length: Column) -> Column:
    return F.when(d > 0, m + length).otherwise(m)


def rotated(m: Column, size: Column) -> Column:
    """A position on a circle of a size, from 0 on."""
    return F.pmod(m, size)


def merged_vector(m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    """(mag, score) of two equal steps: magnitudes weighted by score, each share in whole bases as it is added; the score has a cap."""
    mag = F.when(m1 == 0, F.lit(0)).otherwise(F.floor(m1 * s1 / (s1 + s2) + m2 * s2 / (s1 + s2)))
    return F.struct(mag.cast("long").alias("mag"), F.least(s1 + s2, F.lit(SCORE_CAP)).cast("long").alias("score"))


def connection_score(a: Column, b: Column) -> Column:
    """Half the harmonic mean of two aligned lengths, in whole bases."""
    return F.floor(a * b / F.nullif(a + b, F.lit(0))).cast("long")


def link_key(a: Column, b: Column, order: Column) -> Column:
    return F.concat_ws("#", a.cast("string"), b.cast("string"), order.cast("string"))


def colour_scale(length: Column) -> Column:
    """Size of a node in a drawing: one to two, by the logarithm of its length."""
    return F.least(F.lit(2.0), F.greatest(F.lit(1.0), 1 + (F.log10(length.cast("double")) - 2) / 3.5))
