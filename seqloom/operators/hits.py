"""Hits of long reads on contigs: filters, links, votes and cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import scalars as S
from seqloom.functions.columns import tip_distance
from seqloom.operators.settle import settled

MIN_QUALITY, ANCHOR_LENGTH, TRANSFORMED_LENGTH = 10, 1000, 2000


def contig_id(name: Column) -> Column:
    """The id within a contig's name: what stands between the first two underscores, else all of it."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(name)


def good_hits(hits: DataFrame, nodes: DataFrame, least: int = MIN_QUALITY) -> DataFrame:
    """Hits of enough quality on contigs that are still in the graph, with the contig's length and coverage."""
    return hits.where(F.col("mapq") >= least).join(nodes.select("node_id", "len", "cov"), "node_id")


def reads_of(hits: DataFrame) -> DataFrame:
    """(read_id, hits): a read's hits in order of where they begin on it."""
    return hits.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("lft", "hit_seq", "rgt", "node_id"))).alias("hits"))


def segments(groups: DataFrame, unique_bin: Column) -> DataFrame:
    """(read_id, segment, flag, n_hits) of grouped hits (read_id, group_id, node_id, ...).

    A group of one hit on a unique contig closes a segment, if its bin is the one before it or there is none, and opens the
    next with itself; a unique contig of another bin is passed over. flag: 1 if it opens with a unique contig, plus 2 if it
    closes with one of the same bin. What follows the last unique contig is a segment of flag 1 if it holds more hits.
    """
    w = Window.partitionBy("read_id", "group_id")
    one = groups.select("read_id", "group_id", F.count(F.lit(1)).over(w).alias("n"), unique_bin.alias("b"))
    per = one.groupBy("read_id", "group_id").agg(F.max("n").alias("n"), F.when(F.max("n") == 1, F.max("b")).alias("bin"))
    steps = per.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "n", "bin"))).alias("v")).where(F.size("v") >= 2)
    kind = "struct<flag:int,size:bigint,bin:bigint,out:array<struct<flag:int,n_hits:bigint>>>"
    begin = F.struct(F.when(F.col("v")[0]["bin"].isNotNull(), 1).otherwise(0).alias("flag"), F.col("v")[0]["n"].alias("size"), F.col("v")[0]["bin"].cast("long").alias("bin"), F.array().cast("array<struct<flag:int,n_hits:bigint>>").alias("out"))

    def step(s, x):
        size = s["size"] + x["n"]
        close = x["bin"].isNotNull() & (s["bin"].isNull() | (s["bin"] == x["bin"]))
        same = s["bin"].isNotNull() & (s["bin"] == x["bin"])
        closed = F.concat(s["out"], F.array(F.struct((s["flag"] + F.when(same, 2).otherwise(0)).alias("flag"), size.alias("n_hits"))))
        return F.struct(F.when(close, 1).otherwise(s["flag"]).alias("flag"), F.when(close, F.lit(1)).otherwise(size).cast("long").alias("size"), F.when(close, x["bin"]).otherwise(s["bin"]).cast("long").alias("bin"), F.when(close, closed).otherwise(s["out"]).alias("out")).cast(kind)

    done = F.aggregate(F.slice("v", 2, F.size("v")), begin.cast(kind), step)
    each = "array<struct<flag:int,n_hits:bigint>>"
    tail = F.when(F.col("d.size") > 1, F.array(F.struct(F.lit(1).alias("flag"), F.col("d.size").alias("n_hits")))).otherwise(F.array().cast(each))
    return steps.select("read_id", done.alias("d")).select("read_id", F.posexplode(F.concat("d.out", tail)).alias("segment", "x")).select("read_id", "segment", "x.flag", "x.n_hits")


def hit_pairs(hits: DataFrame) -> DataFrame:
    """Neighbouring hits of a read side by side, columns a_* and b_*."""
    w = Window.partitionBy("read_id").orderBy("hit_seq")
    cols = ["hit_seq", "node_id", "lft", "rgt", "ref_start", "ref_end", "strand"]
    return hits.select("read_id", "read_len", *[F.col(c).alias(f"a_{c}") for c in cols], *[F.lead(c).over(w).alias(f"b_{c}") for c in cols]).where("b_node_id is not null")


def pair_vectors(pairs: DataFrame) -> DataFrame:
    v = S.hit_vector(*[F.col(f"a_{c}") for c in ("lft", "rgt", "ref_start", "ref_end", "strand")], *[F.col(f"b_{c}") for c in ("lft", "rgt", "ref_start", "ref_end", "strand")])
    return pairs.withColumn("v", v).withColumns({"mag": F.col("v.mag"), "dir": F.col("v.dir")}).drop("v")


def link_votes(pairs: DataFrame, cover: DataFrame, min_cov: float, least: int = S.MIN_CONTIG) -> DataFrame:
    """Links (a, b, dir, score, n, mag, gap): pairs whose hits do not overlap too much on the read, on contigs deep enough; the vector of a link is that of its least gap."""
    near = pair_vectors(pairs).where("a_node_id <> b_node_id")
    side = lambda c: cover.where(F.col("cov") >= min_cov).select(F.col("node_id").alias(f"{c}_node_id"))
    overlap = F.least(F.col("a_rgt") - F.col("b_lft"), F.col("b_rgt") - F.col("a_lft"))
    half = 0.5 * F.least(F.col("a_rgt") - F.col("a_lft"), F.col("b_rgt") - F.col("b_lft"))
    kept = near.where(overlap <= F.least(half, F.lit(float(least)))).join(side("a"), "a_node_id", "left_semi").join(side("b"), "b_node_id", "left_semi")
    score = S.connection_score(F.col("a_ref_end") - F.col("a_ref_start"), F.col("b_ref_end") - F.col("b_ref_start"))
    first = F.min(F.struct(F.abs(overlap).alias("gap"), "read_id", "a_hit_seq", "mag"))
    return kept.groupBy(F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), "dir").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("n"), first.alias("f")).select("a", "b", "dir", "score", "n", F.col("f.mag").alias("mag"), F.col("f.gap").alias("gap"))


def circular_votes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, votes, circular): from -1, one more for each read that meets a contig's two ends as a circle would, one less for each other pair a contig is in; circular above 1."""
    v = pair_vectors(pairs).join(nodes.select(F.col("node_id").alias("a_node_id"), "len"), "a_node_id")
    rate = F.abs(F.col("mag")) / F.col("len")
    circle = (F.col("a_node_id") == F.col("b_node_id")) & (F.col("dir") > 0) & (rate < 1.1) & (rate > 0.9) & (F.col("read_len") < 1.1 * F.col("len"))
    spans = F.col("a_rgt") - F.col("a_lft") + F.col("b_rgt") - F.col("b_lft")
    up = F.struct(F.col("a_node_id").alias("node_id"), F.when(spans / F.col("read_len") > 0.8, 1).otherwise(0).alias("x"))
    down = lambda c: F.struct(F.col(c).alias("node_id"), F.lit(-1).alias("x"))
    each = F.when(circle, F.array(up)).otherwise(F.array(down("a_node_id"), down("b_node_id")))
    votes = v.select(F.inline(each)).groupBy("node_id").agg((F.lit(-1) + F.sum("x")).alias("votes"))
    return votes.select("node_id", "votes", (F.col("votes") > 1).alias("circular"))


def repeat_contigs(nodes: DataFrame, links: DataFrame, mean: float) -> DataFrame:
    """(node_id, repeat) by length and coverage; between 1.3 and 1.5 times the mean, by an overlapping link (a, b, mag, dir) with a long or shallow contig."""
    n, c = F.col("len"), F.col("cov")
    ends = F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("other")))
    size = lambda i, x: nodes.select(F.col("node_id").alias(i), F.col("len").alias(x))
    gap = links.where("a <> b").join(size("a", "la"), "a").join(size("b", "lb"), "b").withColumn("gap", tip_distance(F.col("mag"), F.col("dir"), F.col("la"), F.col("lb")))
    firm = nodes.where((n > S.MAX_REPEAT) | (c < 1.3 * mean)).select(F.col("node_id").alias("other"))
    crowded = gap.where("gap < 0").select(F.explode(ends).alias("e"), "gap").select("e.*", "gap").join(firm, "other", "left_semi").groupBy("node_id").agg(F.max("gap").alias("gap"))
    rule = (
        F.when((n < S.MIN_CONTIG) | (c < 0.3 * mean), True)
        .when((n > S.MAX_REPEAT) | (c < 1.3 * mean), False)
        .when(c > 1.5 * mean, True)
        .when(F.col("gap") > -0.25 * n, True)
        .otherwise(n < 2 * S.MIN_CONTIG)
    )
    return nodes.join(crowded, "node_id", "left").select("node_id", rule.alias("repeat"))


def covered(hits: DataFrame) -> DataFrame:
    """(node_id, covered): bases of each contig under any hit. Hits become islands by a running maximum, so no row a base."""
    w = Window.partitionBy("node_id").orderBy("ref_start", "ref_end")
    so_far = F.max("ref_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = F.greatest(F.lit(0), F.col("ref_end") - F.greatest(F.col("ref_start") - 1, F.coalesce(so_far, F.lit(0))))
    return hits.select("node_id", own.alias("n")).groupBy("node_id").agg(F.sum("n").cast("long").alias("covered"))


def unaligned(hits: DataFrame, size: Column) -> DataFrame:
    """(read_id, first, last): the stretches of each read that no hit covers."""
    w = Window.partitionBy("read_id").orderBy("lft", "rgt")
    reach = F.max("rgt").over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = hits.select("read_id", size.alias("size"), "lft", "rgt", reach.alias("reach"), F.lead("lft").over(w).alias("next"), F.row_number().over(w).alias("i"))
    gaps = F.array(F.when(F.col("i") == 1, F.struct(F.lit(1).cast("long").alias("first"), (F.col("lft") - 1).alias("last"))), F.struct((F.col("reach") + 1).alias("first"), (F.coalesce(F.col("next"), F.col("size") + 1) - 1).alias("last")))
    return at.select("read_id", F.explode(F.array_compact(gaps)).alias("g")).select("read_id", "g.first", "g.last").where("last >= first")


def dense_ids(rows: DataFrame, column: str, first: Column) -> DataFrame:
    """(column, dense_id): each value numbered from 1 by where it is first seen. Values are numbered within runs of that order, and the runs' sizes added up, so that no task orders all of them."""
    runs = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = rows.groupBy(column).agg(F.min(first).alias("_at")).repartitionByRange(runs, "_at", column).withColumn("_run", F.spark_partition_id())
    seen = settled(seen)
    sizes = seen.groupBy("_run").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    base = sizes.select("_run", (F.sum("n").over(Window.orderBy("_run")) - F.col("n")).alias("_base"))
    at = F.row_number().over(Window.partitionBy("_run").orderBy("_at", column))
    return seen.withColumn("_i", at).join(F.broadcast(base), "_run").select(column, (F.col("_base") + F.col("_i")).cast("long").alias("dense_id"))


def ranked(rows: DataFrame, key: str, score: Column, ties: list[str], top: int) -> DataFrame:
    """The first `top` rows of each key by descending score."""
    w = Window.partitionBy(key).orderBy(score.desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def kept_paths(paths: DataFrame, remaining: Column, k: int, tol: float = 0.25, most: int = 100) -> DataFrame:
    """Paths (start, path, deviation) in order of absolute deviation, kept while within the best plus a tolerance of what remains, most of them at the most."""
    w = Window.partitionBy("start").orderBy(F.abs("deviation"), "path")
    best = F.first(F.abs("deviation")).over(w)
    return paths.withColumns({"rank": F.row_number().over(w), "_b": best}).where((F.abs("deviation") <= F.col("_b") + F.abs(remaining + k) * tol) & (F.col("rank") <= most)).drop("_b")
