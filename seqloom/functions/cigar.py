"""CIGAR strings and read coordinates as Column expressions. A string is split once into (length, operation) pairs; all else folds over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """Array of (n, op); one pass over the text: cut after each operation letter."""
    parts = F.filter(F.split(cigar, "(?<=[A-Z=])"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.rtrim(p, F.lit("HSPIMDNX=")).cast("long").alias("n"), F.right(p, F.lit(1)).alias("op")))


def _fold(ops: Column, start: dict[str, Column], step: Callable) -> Column:
    return F.aggregate(ops, F.struct(*[c.cast("long").alias(k) for k, c in start.items()]), lambda s, e: F.struct(*[c.cast("long").alias(k) for k, c in step(s, e).items()]))


def cigar_span(cigar: Column, forward: Column) -> Column:
    """start, end and length of the read of an alignment, 1-based; swapped and counted from the far end on the other strand.

    All clips before the first base count, hard and soft ones and pads alike; the end is where the last clip begins.
    """
    zero = F.lit(0)

    def step(s, e):
        clip = e["op"].isin("H", "S", "P")
        return {
            "length": s["length"] + F.when(clip | e["op"].isin("I", "M", "=", "X"), e["n"]).otherwise(0),
            "start": F.when(clip | (s["start"] > 0), s["start"]).otherwise(s["length"] + 1),
            "end": F.when(clip & (s["start"] > 0), s["length"]).otherwise(s["end"]),
        }

    x = _fold(operations(cigar), {"length": zero, "start": zero, "end": zero}, step)
    return F.aggregate(
        F.array(x),
        F.struct(zero.cast("long").alias("start"), zero.cast("long").alias("end"), zero.cast("long").alias("length")),
        lambda _, v: F.struct(
            F.when(forward, v["start"]).otherwise(v["length"] - v["start"] + 1).alias("start"),
            F.when(forward, F.when(v["end"] > 0, v["end"]).otherwise(v["length"])).otherwise(v["length"] - F.when(v["end"] > 0, v["end"]).otherwise(v["length"]) + 1).alias("end"),
            v["length"].alias("length"),
        ),
    )


def _clamped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def reference_position(at: Column, rs: Column, re: Column, rl: Column, ts: Column, te: Column, forward: Column, cigar: Column | None = None) -> Column:
    """Position on the contig of a read position: by the CIGAR, or in proportion without one; beyond the hit it goes on one to one; kept within the hit."""
    look, begin, end = (F.when(forward, x).otherwise(rl + 1 - x) for x in (at, rs, re))
    if cigar is None:
        inside = F.floor(ts + (look - begin) * F.abs((te - ts) / (re - rs)))
    else:

        def step(s, e):
            both, ins, skip = e["op"].isin("M", "=", "X"), e["op"] == "I", e["op"].isin("D", "N")
            open_ = s["found"] == 0
            here = open_ & (both | ins) & (s["read"] + e["n"] >= look)
            return {
                "found": F.when(here, 1).otherwise(s["found"]),
                "at": F.when(here, F.when(ins, s["ref"]).otherwise(s["ref"] + look - s["read"])).otherwise(s["at"]),
                "read": s["read"] + F.when(open_ & ~here & (both | ins), e["n"]).otherwise(0),
                "ref": s["ref"] + F.when(open_ & ((both & ~here) | skip), e["n"]).otherwise(0),
            }

        x = _fold(operations(cigar), {"found": F.lit(0), "at": F.lit(-1), "read": begin, "ref": ts}, step)
        inside = x["at"]
    out = F.when(look < begin, ts + look - begin).when(look > end, te + look - end).otherwise(inside)
    return _clamped(out, ts, te).cast("long")


def read_position(at: Column, rs: Column, re: Column, rl: Column, ts: Column, te: Column, forward: Column, cigar: Column | None = None) -> Column:
    """Position on the read of a contig position, the inverse of reference_position; kept within the read."""
    begin = F.when(forward, rs).otherwise(rl - rs + 1)
    if cigar is None:
        inside = F.floor(begin + (at - ts) * F.abs((re - rs) / (te - ts)))
    else:

        def step(s, e):
            both, ins, skip = e["op"].isin("M", "=", "X"), e["op"] == "I", e["op"].isin("D", "N")
            open_ = s["found"] == 0
            here = open_ & (both | skip) & (s["ref"] + e["n"] >= at)
            return {
                "found": F.when(here, 1).otherwise(s["found"]),
                "at": F.when(here, F.when(skip, s["read"]).otherwise(s["read"] + at - s["ref"])).otherwise(s["at"]),
                "read": s["read"] + F.when(open_ & ((both & ~here) | ins), e["n"]).otherwise(0),
                "ref": s["ref"] + F.when(open_ & ~here & (both | skip), e["n"]).otherwise(0),
            }

        x = _fold(operations(cigar), {"found": F.lit(0), "at": F.lit(-1), "read": begin, "ref": ts}, step)
        inside = x["at"]
    there = F.when(forward, inside).otherwise(rl - inside + 1)
    out = F.when(at < ts, F.when(forward, rs + at - ts).otherwise(rs - at + ts)).when(at > te, F.when(forward, re + at - te).otherwise(re - at + te)).otherwise(there)
    return _clamped(out, F.lit(1), rl).cast("long")


def read_positions(sites: Column, rs: Column, re: Column, rl: Column, ts: Column, te: Column, forward: Column) -> Column:
    """read_position of each of an array of contig positions, in proportion."""
    return F.transform(sites, lambda x: read_position(x, rs, re, rl, ts, te, forward))


def read_slice(seq: Column, first: Column, last: Column, rs: Column, re: Column, ts: Column, te: Column, forward: Column) -> Column:
    """The part of a read that lies on contig positions first to last, in the read's direction; null where the hit does not reach over them."""
    n = F.length(seq)
    a, b = (read_position(x, rs, re, n, ts, te, forward) for x in (first, last))
    return F.when((first >= ts) & (last <= te), F.substring(seq, F.least(a, b).cast("int"), (F.abs(b - a) + 1).cast("int")))


def spanning_slice(rs: Column, re: Column, rl: Column, flank: int = 50, share: float = 0.05) -> Column:
    """(start, end) of a hit on its read with a margin on both sides: a share of its length and a fixed flank, kept within the read."""
    low, high = F.least(rs, re), F.greatest(rs, re)
    margin = F.floor(share * (high - low + 1)) + flank
    return F.struct(F.greatest(low - margin, F.lit(1)).cast("long").alias("start"), F.least(high + margin, rl).cast("long").alias("end"))


def reversed_read(rs: Column, re: Column, rl: Column, forward: Column) -> Column:
    """The same hit on the reverse complement of its read."""
    return F.struct((rl - rs + 1).alias("start"), (rl - re + 1).alias("end"), (~forward).alias("forward"))


def identity_profile(cigar: Column) -> Column:
    """Bases and events of an alignment whose matches are told apart (= and X); M counts as aligned, by neither."""

    def step(s, e):
        n, op = e["n"], e["op"]
        add = lambda name, *ops: s[name] + F.when(op.isin(*ops), n).otherwise(0)
        one = lambda name, o: s[name] + F.when(op == o, 1).otherwise(0)
        return {
            "match": add("match", "="), "mismatch": add("mismatch", "X"), "aligned": add("aligned", "M", "=", "X"), "base_ins": add("base_ins", "I"), "base_del": add("base_del", "D"),
            "num_ins": one("num_ins", "I"), "num_del": one("num_del", "D"), "clipped": add("clipped", "H", "S", "P"), "read_base": add("read_base", "M", "=", "X", "I"), "ref_base": add("ref_base", "M", "=", "X", "D"),
        }

    names = ("match", "mismatch", "aligned", "base_ins", "base_del", "num_ins", "num_del", "clipped", "read_base", "ref_base")
    return _fold(operations(cigar), {k: F.lit(0) for k in names}, step)


def lifted_feature(start: Column, end: Column, strand: Column, score: Column, a: Column, b: Column, length: Column, least: float = 0.9) -> Column:
    """A feature clipped to the contig segment from a to b (a > b: read backwards, so it is mirrored and its strand turned); null if not over least of it is left.

    Score goes with the share that is left.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    s, e = F.greatest(start, low), F.least(end, high)
    rate = (e - s + 1) / (end - start + 1)
    back = a > b
    out = F.struct(
        F.when(back, length - e + 1).otherwise(s).cast("long").alias("start"), F.when(back, length - s + 1).otherwise(e).cast("long").alias("end"), F.when(back, F.when(strand == "+", "-").otherwise("+")).otherwise(strand).alias("strand"), (score * rate).alias("score")
    )
    return F.when((e >= s) & (rate > least), out)
