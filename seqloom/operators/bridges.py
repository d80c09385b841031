"""Bridges between two unique contigs: their steps (bridge, dest, mag, dir, score), segments and candidate paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import scalars as S
from seqloom.functions.columns import A_TOL, compose, reverse_vector

CONSENSUS_READS, FORCED_READS = 20, 3


def completion_level(anchors: Column, segments: Column, connected: Column, single: Column) -> Column:
    """0 to 2: anchors known; 3: all segments connected; 4: each by one path. segments, connected and single are counts."""
    both = (anchors == 2) & (segments > 0)
    return F.when(both & (single == segments), 4).when(both & (connected == segments), 3).otherwise(anchors)


def steps_of_reads(pairs: DataFrame, unique: Column) -> DataFrame:
    """(bridge, dest, mag, dir, score) seen from the unique first hit of each pair (a_*, b_*), steps of one node and direction added up: the mean vector, and the summed score with its cap."""
    seen = pairs.where(unique).select(F.concat(F.col("a_node_id").cast("string"), F.when(F.col("a_strand"), "o").otherwise("i")).alias("bridge"), F.col("b_node_id").alias("dest"), "mag", "dir")
    return seen.groupBy("bridge", "dest", "dir").agg(F.floor(F.avg("mag")).cast("long").alias("mag"), F.least(F.sum(F.lit(S.GOOD_QUALITY)), F.lit(S.SCORE_CAP)).alias("score"))


def reversed_bridge(steps: DataFrame, span: str = "span_mag", span_dir: str = "span_dir") -> DataFrame:
    """Steps seen from the other anchor: each vector composed with the bridge's own vector (span) turned round."""
    rm, rd = reverse_vector(F.col(span), F.col(span_dir))
    m, d = compose(F.col("mag"), F.col("dir"), rm, rd)
    return steps.withColumns({"mag": m, "dir": d})


def end_anchor(steps: DataFrame, unique: Column) -> DataFrame:
    """(bridge, dest): the farthest unique step of each bridge, the least node among equals."""
    return steps.where(unique).groupBy("bridge").agg(F.max(F.struct(F.abs("mag").alias("far"), (-F.col("dest")).alias("n"))).alias("x")).select("bridge", (-F.col("x.n")).alias("dest"))


def best_midpoint(steps: DataFrame, low: Column, high: Column) -> DataFrame:
    """(bridge, dest): of the steps strictly between two distances, that of the highest score; nearer, then lesser, among equals."""
    inside = steps.where((F.abs("mag") > low) & (F.abs("mag") < high))
    return inside.groupBy("bridge").agg(F.max(F.struct("score", (-F.abs("mag")).alias("d"), (-F.col("dest")).alias("n"))).alias("x")).select("bridge", (-F.col("x.n")).alias("dest"))


def greedy_order(steps: DataFrame) -> DataFrame:
    """(bridge, dest, rank): the order in which steps are tried as midpoints."""
    return steps.select("bridge", "dest", F.row_number().over(Window.partitionBy("bridge").orderBy(F.desc("score"), F.abs("mag"), "dest")).alias("rank"))


def merged_steps(steps: DataFrame) -> DataFrame:
    """Steps of one bridge whose distances chain within tolerance, as one: the vector weighted by score, the score summed up to the cap."""
    w = Window.partitionBy("bridge", "dest", "dir").orderBy("mag", "score")
    new = steps.withColumn("_n", F.when(F.abs(F.col("mag") - F.lag("mag").over(w)) < A_TOL, 0).otherwise(1))
    cluster = new.withColumn("cluster", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cluster.groupBy("bridge", "dest", "dir", "cluster").agg(F.floor(F.sum(F.col("mag") * F.col("score")) / F.sum("score")).cast("long").alias("mag"), F.least(F.sum("score"), F.lit(S.SCORE_CAP)).cast("long").alias("score"))


def connectable(steps: DataFrame, other: DataFrame) -> DataFrame:
    """Steps with support, or that the bridge from the other anchor names as well."""
    back = other.select(F.col("bridge").alias("anchor"), F.lit(True).alias("back")).distinct()
    key = F.concat(F.col("dest").cast("string"), F.when(F.col("dir") > 0, "i").otherwise("o"))
    met = steps.withColumn("anchor", key).join(back, "anchor", "left")
    return met.where((S.support_class(F.col("score")) > 0) | F.col("back")).select("bridge", "dest", "mag", "dir", "score")


def voted(paths: DataFrame, votes: DataFrame) -> DataFrame:
    """Paths (segment, path, deviation, likelihood) with the deviations of new votes (path, deviation) added; a path that a vote misses gets A_TOL."""
    sums = votes.groupBy("path").agg(F.sum(F.coalesce("deviation", F.lit(A_TOL))).alias("more"))
    return paths.join(sums, "path", "left").select("segment", "path", (F.col("deviation") + F.coalesce("more", F.lit(0))).cast("long").alias("deviation"), "likelihood")


def likely_paths(paths: DataFrame, well_supported: Column) -> DataFrame:
    """Paths left of each segment: with good support those of least deviation and then of highest likelihood, else all within A_TOL of the least."""
    w = Window.partitionBy("segment")
    near = paths.withColumn("_b", F.min(F.abs("deviation")).over(w)).withColumn("_s", well_supported)
    kept = near.where(F.abs("deviation") <= F.col("_b") + F.when(F.col("_s"), 0).otherwise(A_TOL))
    top = kept.withColumn("_l", F.max("likelihood").over(w))
    return top.where(~F.col("_s") | (F.col("likelihood") >= F.col("_l"))).drop("_b", "_s", "_l")


def best_paths(paths: DataFrame) -> DataFrame:
    """(bridge, likelihood, log_paths): the best combination of one path a segment is the best of each, so no product is made; log_paths is the natural logarithm of the number of combinations, which itself soon passes what a double holds."""
    per = paths.groupBy("bridge", "segment").agg(F.max("likelihood").alias("l"), F.count(F.lit(1)).alias("n"))
    alike = per.groupBy("bridge", "n").agg(F.sum("l").alias("l"), F.count(F.lit(1)).alias("k"))
    return alike.groupBy("bridge").agg(F.sum("l").alias("likelihood"), F.sum(F.col("k") * F.ln("n")).alias("log_paths"))


def consensus_gate(reads: DataFrame, forced: bool = False) -> DataFrame:
    """Bridges with enough reads for a consensus: 20, or 3 at the end."""
    return reads.groupBy("bridge").agg(F.count_distinct("read_id").alias("reads")).where(F.col("reads") >= (FORCED_READS if forced else CONSENSUS_READS))


def conflicting(bridges: DataFrame) -> DataFrame:
    """Bridges (bridge, n0, n1, level) that meet, at an end, another one that is connected."""
    ends = lambda d: d.select("bridge", "level", F.explode(F.array("n0", "n1")).alias("end"))
    strong = ends(bridges.where("level >= 3")).groupBy("end").agg(F.min("bridge").alias("x"), F.max("bridge").alias("y"))
    met = ends(bridges).join(strong, "end").where((F.col("x") != F.col("bridge")) | (F.col("y") != F.col("bridge")))
    return met.select("bridge").distinct()


def trimmed(scaffolds: DataFrame, repeat: Column) -> DataFrame:
    """Contigs of scaffolds (scaffold, pos, ...) without the repeats at either end; one of repeats only is gone."""
    w = Window.partitionBy("scaffold")
    at = scaffolds.withColumns({"_a": F.min(F.when(~repeat, F.col("pos"))).over(w), "_z": F.max(F.when(~repeat, F.col("pos"))).over(w)})
    return at.where((F.col("pos") >= F.col("_a")) & (F.col("pos") <= F.col("_z"))).drop("_a", "_z")


def scaffold_lengths(contigs: DataFrame) -> DataFrame:
    """(scaffold, length) of contigs (scaffold, pos, mag, dir, len, circle): from the first contig's left end to the last one's right end; the size of the circle where there is one."""
    left, right = S.leftmost(F.col("mag"), F.col("dir"), F.col("len")), S.rightmost(F.col("mag"), F.col("dir"), F.col("len"))
    ends = contigs.groupBy("scaffold").agg(F.min(F.struct("pos", left.alias("x")))["x"].alias("a"), F.max(F.struct("pos", right.alias("x")))["x"].alias("z"), F.max(F.abs("circle")).alias("c"))
    return ends.select("scaffold", F.coalesce("c", F.col("z") - F.col("a")).cast("long").alias("length"))
