"""Filters, joins, aggregates and ordered operators over hits, contigs and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.columns import KMER, poisson_distance
from seqloom.operators.settle import settled


def descending_sums(sums: DataFrame) -> DataFrame:
    """Rows (len, s), one a length, with cum, the sum of s down to each length. Lengths are dealt out in ranges and only the ranges' totals are put in order, so no task sees all."""
    n = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(sums.repartitionByRange(n, F.desc("len")).withColumn("run", F.spark_partition_id()))
    totals = dealt.groupBy("run").agg(F.sum("s").alias("t"))  # a row a partition
    before = totals.select("run", (F.sum("t").over(Window.orderBy("run")) - F.col("t")).alias("before"))
    inside = F.sum("s").over(Window.partitionBy("run").orderBy(F.desc("len")))
    return dealt.join(F.broadcast(before), "run").select("len", "s", (F.col("before") + inside).alias("cum"))


def nxx(lengths: DataFrame, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """For each share the smallest length in the descending prefix that reaches it. Equal lengths are summed first, so the ordered pass sees one row a length."""
    by = by or []
    sums = lengths.groupBy(*by, "len").agg(F.sum("len").alias("s"))
    if by:
        run = sums.withColumn("cum", F.sum("s").over(Window.partitionBy(*by).orderBy(F.desc("len")))).withColumn("total", F.sum("s").over(Window.partitionBy(*by)))
    else:
        run = descending_sums(sums)
        run = run.join(F.broadcast(run.agg(F.sum("s").alias("total"))))
    return run.groupBy(*by).agg(*[F.max(F.when(F.col("cum") >= x * F.col("total"), F.col("len"))).alias(name) for name, x in shares.items()])


def range_groups(hits: DataFrame, key: str, left: str, right: str, k: int = KMER) -> DataFrame:
    """Overlap-range grouping of a read's hits: a hit joins the running group if it overlaps it by more than 2k or lies within it."""
    order = Window.partitionBy(key).orderBy(left, F.desc(right), "hit_seq")
    so_far = F.max(right).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when((so_far - F.col(left) > 2 * k) | (F.col(right) <= so_far), 0).otherwise(1)
    return hits.withColumn("_new", new).withColumn("group_id", F.sum("_new").over(order)).drop("_new")


def pair_links(hits: DataFrame) -> DataFrame:
    """Links between contigs from hits of one read: score and number of pairs. The read's hits are an array, not a self join."""
    reads = hits.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("hit_seq", "node_id", "score"))).alias("v"))
    first = reads.select("read_id", F.posexplode("v").alias("i", "a"), "v")
    pairs = first.select("a", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("b")).where(F.col("a.node_id") != F.col("b.node_id"))
    low, high = F.least("a.node_id", "b.node_id"), F.greatest("a.node_id", "b.node_id")
    return pairs.groupBy(low.alias("a"), high.alias("b")).agg(F.sum(F.least("a.score", "b.score")).alias("score"), F.count(F.lit(1)).alias("n"))


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str, name: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(name))


def histogram(rows: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Count of each fixed bin; what lies below goes to the first one, what lies above to the last."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((value - low) / ((high - low) / bins)))).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, n: str) -> DataFrame:
    """Bits of the distribution of counts."""
    s = counts.agg(F.sum(n).alias("t"), F.sum(F.when(F.col(n) > 0, F.col(n) * F.log2(F.col(n).cast("double"))).otherwise(0.0)).alias("w"))
    return s.select((F.log2(F.col("t").cast("double")) - F.col("w") / F.col("t")).alias("entropy_bits"))


def overlap_join(mine: DataFrame, model: DataFrame, key: str, gap: int, bin_size: int = 5000) -> DataFrame:
    """Pairs (id, model_id) of features of one key that overlap by gap or more both ways: a range join by bins, each pair at the bin where the later one starts."""
    cut = lambda d: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))))
    a = cut(mine)
    b = cut(model.select(F.col(key), F.col("id").alias("model_id"), "start", "end")).select(key, "_bin", "model_id", F.col("start").alias("ms"), F.col("end").alias("me"))
    met = a.join(b, [key, "_bin"]).where((F.col("end") - F.col("ms") >= gap) & (F.col("me") - F.col("start") >= gap))
    return met.where(F.col("_bin") == F.floor(F.greatest("start", "ms") / bin_size)).select("id", "model_id")


def line_clusters(points: DataFrame, by: list[str], value: str, eps: float = 3.0) -> DataFrame:
    """Chain clusters on a line: a new one begins where the distance to the previous value exceeds eps."""
    w = Window.partitionBy(*by).orderBy(value, "id")
    gap = poisson_distance(F.lag(value).over(w), F.col(value))
    return points.withColumn("_new", F.when(gap <= eps, 0).otherwise(1)).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def bag_subtract(left: DataFrame, right: DataFrame, key: str, item: str, n: str) -> DataFrame:
    """Bag difference for each key; a key is left out if any count would be negative, and items of count zero go."""
    d = left.select(key, item, n).unionByName(right.select(key, item, (-F.col(n)).alias(n))).groupBy(key, item).agg(F.sum(n).alias(n))
    bad = d.where(F.col(n) < 0).select(key).distinct()
    return d.where(F.col(n) > 0).join(bad, key, "left_anti")


def previous_unique(hits: DataFrame, unique: Column) -> DataFrame:
    """The last unique contig before each hit of its read."""
    w = Window.partitionBy("read_id").orderBy("hit_seq").rowsBetween(Window.unboundedPreceding, -1)
    return hits.withColumn("previous_unique", F.last(F.when(unique, F.col("node_id")), ignorenulls=True).over(w))


def base_confusion(mine: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Bases in both, in mine only and in the model only, for each key: a sweep over interval ends, not a row a base."""
    ends = lambda d, a, b: d.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(a).alias("x"), F.lit(b).alias("y")), F.struct((F.col("end") + 1).alias("at"), F.lit(-a).alias("x"), F.lit(-b).alias("y")))).alias("e")).select(key, "e.*")
    w = Window.partitionBy(key).orderBy("at")
    steps = ends(mine, 1, 0).unionByName(ends(model, 0, 1)).groupBy(key, "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    run = steps.select(key, F.sum("x").over(w).alias("x"), F.sum("y").over(w).alias("y"), (F.lead("at").over(w) - F.col("at")).alias("n"))
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    x, y = F.col("x") > 0, F.col("y") > 0
    return run.groupBy(key).agg(part(x & y).alias("tp"), part(x & ~y).alias("fp"), part(~x & y).alias("fn"))


def ng50(lengths: DataFrame, genome: int) -> DataFrame:
    """As N50, against half of a given genome size in whole bases; null where the contigs don't reach it."""
    run = descending_sums(lengths.groupBy("len").agg(F.sum("len").alias("s")))
    return run.agg(F.max(F.when(F.col("cum") >= genome // 2, F.col("len"))).alias("ng50"))


def dominant(rows: DataFrame, key: str, item: str, weight: str) -> DataFrame:
    """The item of most weight for each key, and that weight; the least item among equals."""
    sums = rows.groupBy(key, item).agg(F.sum(weight).alias("w"))
    return sums.groupBy(key).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(item).alias("item"))).alias("m")).select(key, F.col("m.item").alias(item), (-F.col("m.w")).alias("weight"))


def feature_match(mine: DataFrame, model: DataFrame, key: str, gap: int) -> DataFrame:
    """Features of mine that meet some of the model, features of the model that some of mine meets, and both totals."""
    met = overlap_join(mine, model, key, gap)
    parts = met.select("id").distinct().select(F.lit("tp").alias("of"))
    for name, rows in (("recalled", met.select("model_id").distinct()), ("n_mine", mine), ("n_model", model)):
        parts = parts.unionByName(rows.select(F.lit(name).alias("of")))
    return parts.agg(*[F.count_if(F.col("of") == x).alias(x) for x in ("tp", "recalled", "n_mine", "n_model")])


def spelling_offsets(steps: DataFrame, key: str, length: str, k: int = KMER) -> DataFrame:
    """Where each step of a path begins in its spelled sequence: neighbours share k bases."""
    w = Window.partitionBy(key).orderBy("hit_seq").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("offset", F.coalesce(F.sum(F.col(length) - k).over(w), F.lit(0)).cast("long"))


def nearest_markers(hits: DataFrame, marker: Column) -> DataFrame:
    """The nearest marker before and after each hit of its read."""
    w = Window.partitionBy("read_id").orderBy("hit_seq")
    node = F.when(marker, F.col("node_id"))
    before = F.last(node, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return hits.withColumn("before", before).withColumn("after", F.first(node, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def anchor_pairs(hits: DataFrame, anchor: Column) -> DataFrame:
    """Consecutive anchors of a read as (read_id, a, b)."""
    w = Window.partitionBy("read_id").orderBy("hit_seq")
    return hits.where(anchor).select("read_id", F.col("node_id").alias("a"), F.lead("node_id").over(w).alias("b")).where("b is not null")


def gap_statistics(hits: DataFrame) -> DataFrame:
    """Number and size of the largest of the gaps between a read's hits and all before them."""
    w = Window.partitionBy("read_id").orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)
    gaps = hits.select((F.col("left") - F.max("right").over(w)).alias("gap")).where("gap > 0")
    return gaps.agg(F.count(F.lit(1)).alias("gaps"), F.max("gap").alias("max_gap"))


def copies_histogram(hits: DataFrame) -> DataFrame:
    """k, the reads with k units, and the units in them."""
    reads = hits.groupBy("read_id").agg(F.count(F.lit(1)).alias("k"))
    return reads.groupBy("k").agg(F.count(F.lit(1)).alias("reads")).withColumn("units", F.col("k") * F.col("reads"))


def reciprocal_links(links: DataFrame) -> DataFrame:
    """Distinct links (a, b) that also exist the other way round: a count by unordered pair, no self join."""
    once = links.where("a <> b").select("a", "b").distinct()
    pairs = once.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.where("n = 2").select("a", "b")


def column_consensus(rows: DataFrame, key: str, text: str, letters: str = "ACGTN-") -> DataFrame:
    """The most frequent letter of each column of a key's aligned texts, the first in letters among equals; any other letter counts as N; gap columns are dropped."""
    at = rows.select(key, F.posexplode(F.split(text, "")).alias("pos", "letter")).where("letter <> ''")
    place = F.instr(F.lit(letters), F.col("letter"))
    votes = at.groupBy(key, "pos", F.when(place > 0, place).otherwise(letters.index("N") + 1).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(key, "pos").agg(F.min(F.struct((-F.col("n")).alias("n"), "i"))["i"].alias("i"))
    kept = F.array_sort(F.collect_list(F.when(F.col("i") < len(letters), F.struct("pos", F.substring(F.lit(letters), F.col("i"), F.lit(1)).alias("c")))))
    return best.groupBy(key).agg(F.array_join(F.transform(kept, lambda x: x["c"]), "").alias("consensus"))
