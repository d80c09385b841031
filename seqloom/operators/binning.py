"""What a unique path of known bin takes out of the graph: edges at its anchors, a copy of its bin and a share of coverage on its way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.graph import incidence


def accepted_paths(paths: DataFrame, close: Column) -> DataFrame:
    """Paths (bin, start_bin, end_bin, ...) whose three bins are known, where close holds; other, the bin of the end that differs from the whole's, is added."""
    known = F.col("bin").isNotNull() & F.col("start_bin").isNotNull() & F.col("end_bin").isNotNull()
    other = F.when(F.col("bin") == F.col("start_bin"), F.col("end_bin")).otherwise(F.col("start_bin"))
    return paths.where(known & close).withColumn("other", other)


def spent_edges(steps: DataFrame, edges: DataFrame, unique: Column) -> DataFrame:
    """Distinct edges (n0, d0, n1, d1) on the sides where paths (path, pos, node, forward) leave or enter a unique node."""
    w = Window.partitionBy("path").orderBy("pos")
    at = steps.withColumns({"_first": F.row_number().over(w) == 1, "_last": F.lead("pos").over(w).isNull()}).where(unique)
    sides = at.select("node", F.explode(F.array_compact(F.array(F.when(~F.col("_last"), F.col("forward")), F.when(~F.col("_first"), ~F.col("forward"))))).alias("dir")).distinct()
    hit = incidence(edges).join(sides, ["node", "dir"], "left_semi")
    first = (F.col("node") < F.col("other")) | ((F.col("node") == F.col("other")) & (F.col("dir") | ~F.col("other_dir")))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return hit.select(pick("node", "other").alias("n0"), pick("dir", "other_dir").alias("d0"), pick("other", "node").alias("n1"), pick("other_dir", "dir").alias("d1")).distinct()


def copies_left(counts: DataFrame, visits: DataFrame) -> DataFrame:
    """(item, bin, n) after visits (item, path, pos, bin, other): each takes a copy of its bin, or, once none is left, one of other.

    Visits come in order of path and place; bins without copies are left out; an item that has no counts stays without.
    """
    turn = F.row_number().over(Window.partitionBy("item", "bin").orderBy("path", "pos"))
    served = visits.withColumn("_t", turn).join(counts, ["item", "bin"], "left").withColumn("_own", F.coalesce(F.col("_t") <= F.col("n"), F.lit(False)))
    own = served.where("_own").groupBy("item", "bin").agg(F.count(F.lit(1)).alias("_a"))
    rest = served.where("not _own").groupBy("item", F.col("other").alias("bin")).agg(F.count(F.lit(1)).alias("_b"))
    left = counts.join(own, ["item", "bin"], "left").join(rest, ["item", "bin"], "left")
    n = F.col("n") - F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return left.select("item", "bin", F.greatest(n, F.lit(0)).alias("n")).where("n > 0")


def coverage_left(items: DataFrame, visits: DataFrame) -> DataFrame:
    """(item, cov) less the coverage that each visit (item, cov) takes, not below 0."""
    taken = visits.groupBy("item").agg(F.sum("cov").alias("_c"))
    return items.join(taken, "item", "left").select("item", F.greatest(F.col("cov") - F.coalesce("_c", F.lit(0.0)), F.lit(0.0)).alias("cov"))
