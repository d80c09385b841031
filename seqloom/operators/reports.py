"""Graph files with dense ids, reports of a growing assembly, and samples of genes that can be drawn again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.probability import uniform
from seqloom.operators.hits import dense_ids
from seqloom.operators.relational import nxx

#: Titles of a report's columns, in order (fixed values).
TITLES = ["Time", "Step", "Read count", "Base count", "Number of scaffolds", "Circular scaffolds", "N50", "Breaks (maxlen)"]


def reindexed(segments: DataFrame, links: DataFrame, paths: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables of a graph and its bins with ids from 1, in the order (at) in which segments and positive bins come first.

    segments (at, name), links (a, b), paths (path, steps: names with a sign, joined by commas), bins (at, name, bin). A name
    without a segment becomes empty; bins that are not positive mean no bin and stay as they are.
    """
    ids = dense_ids(segments, "name", F.col("at")).select("name", F.col("dense_id").cast("string").alias("id"))
    side = lambda c: ids.select(F.col("name").alias(c), F.col("id").alias(f"_{c}"))
    new_segments = segments.join(ids, "name").select("at", F.col("id").alias("name"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    new_links = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(empty("_a").alias("a"), empty("_b").alias("b"))
    step = paths.select("path", F.posexplode(F.split("steps", ",")).alias("i", "x")).select("path", "i", F.expr("substr(x, 1, length(x) - 1)").alias("name"), F.expr("right(x, 1)").alias("sign"))
    named = step.join(ids, "name", "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(empty("id"), "sign").alias("x")))).alias("v"))
    new_paths = named.select("path", F.array_join(F.transform("v", lambda s: s["x"]), ",").alias("steps"))
    bin_ids = dense_ids(bins.where("bin > 0"), "bin", F.col("at"))
    new_bins = bins.join(ids, "name", "left").join(bin_ids, "bin", "left").select("at", empty("id").alias("name"), F.coalesce("dense_id", "bin").cast("long").alias("bin"))
    return new_segments, new_links, new_paths, new_bins


def progress(reads: DataFrame, scaffolds: DataFrame, gaps: DataFrame) -> DataFrame:
    """A row and a line for each step: reads and bases so far, the step's scaffolds, circular ones and N50, its gaps and the longest.

    reads (step, bases), scaffolds (step, len, circular), gaps (step, gap). A step without scaffolds or gaps has none; the
    ordered pass sees one row a step.
    """
    so_far = reads.groupBy("step").agg(F.count(F.lit(1)).alias("reads"), F.sum("bases").alias("bases"))
    w = Window.orderBy("step")
    so_far = so_far.select("step", F.sum("reads").over(w).alias("reads"), F.sum("bases").over(w).alias("bases"))
    counts = scaffolds.groupBy("step").agg(F.count(F.lit(1)).alias("scaffolds"), F.count_if("circular").alias("circular"))
    n50 = nxx(scaffolds.select("step", "len"), {"n50": 0.5}, ["step"])
    open_ = gaps.groupBy("step").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap").alias("max_gap"))
    out = so_far.join(counts, "step", "left").join(n50, "step", "left").join(open_, "step", "left").na.fill(0)
    parts = [F.col(c).cast("string") for c in ("step", "reads", "bases", "scaffolds", "circular", "n50")]
    breaks = F.concat(F.col("gaps").cast("string"), F.lit("("), F.col("max_gap").cast("string"), F.lit(")"))
    return out.withColumn("line", F.concat_ws(" |\t", *parts, breaks))


def sampled(rows: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """n draws (draw, column) with replacement from the distinct values of a column, each as likely as the others."""
    values = dense_ids(rows.select(column), column, F.col(column))
    size = values.agg(F.max("dense_id")).first()[0]
    draws = rows.sparkSession.range(n if size else 0).select(F.col("id").alias("draw"), (F.floor(uniform(seed, F.col("id")) * (size or 0)) + 1).alias("dense_id"))
    return draws.join(values, "dense_id").select("draw", column)


def gene_list(spark, first: int, last: int, seed: int, drawn: bool = False, longest: int = 200) -> DataFrame:
    """(i, line): a made-up gene list, each line a gene, a start of 0 and a drawn length; drawn: genes with replacement from the same range."""
    i = F.col("id")
    gene = first + F.floor(uniform(seed, F.lit("gene"), i) * (last - first)) if drawn else i
    size = F.floor(uniform(seed, F.lit("length"), i) * longest)
    return spark.range(first, last).select(i.alias("i"), F.concat(F.lit("gene"), gene.cast("string"), F.lit("\t0\t"), size.cast("string")).alias("line"))


def replicon_report(contigs: DataFrame, features: DataFrame, bases: int) -> DataFrame:
    """(contig, text) for each contig with a replicon: its scaffold's contigs, the bases read in millions, and the scaffold's replicons, genes and resistance genes.

    contigs (contig, scaffold, pos), features (contig, at, sort: replicon, gene or resistance, text). A scaffold's contigs and
    features meet in one row, as the report is one text. It is made once, and copied to the scaffold's contigs as the last step:
    the copies, whose size grows with the square of a scaffold, are never sorted, joined or sent, and stand next to each other.
    A task has few scaffolds, so that a writer's dictionary holds their texts.
    """
    tasks = 4 * int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, sort = F.struct("pos", "at", "text"), F.col("sort")
    placed = features.join(contigs, "contig").select("scaffold", "contig", "sort", one.alias("x"))
    rows = placed.unionByName(contigs.select("scaffold", "contig", F.lit("").alias("sort"), F.struct("pos").alias("x")), allowMissingColumns=True)
    rows = rows.where("scaffold is not null").repartition(tasks, "scaffold")
    of = lambda kind, x: F.array_sort(F.collect_list(F.when(sort == kind, x)))
    lists = rows.groupBy("scaffold").agg(of("", F.struct("x.pos", "contig")).alias("m"), *[of(k, F.col("x")).alias(k) for k in ("replicon", "gene", "resistance")], F.collect_set(F.when(sort == "replicon", F.col("contig"))).alias("named"))
    texts = lambda name, before: F.array_join(F.transform(name, lambda x: F.concat(F.lit(before), x["text"])), "")
    head = F.concat(F.lit(">"), F.array_join(F.transform("m", lambda x: F.concat(x["contig"].cast("string"), F.lit("\t"))), ""), F.lit(f"\n>{bases // 1_000_000:.2f}Mpb\t"))
    body = F.concat(F.size("gene").cast("string"), F.lit(" genes\t"), texts("replicon", "+"), texts("gene", " \n\t"), F.lit("\n"), texts("resistance", " \n\t"), F.lit("\n"))
    reports = lists.where(F.size("named") > 0).select("named", F.concat(head, body).alias("text"))
    return reports.select(F.explode("named").alias("contig"), "text")
