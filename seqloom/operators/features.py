"""Features of sequences: comparison with a model, neighbours, lifting, and gene statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.relational import base_confusion, feature_match


def ratios(tp: Column, fp: Column, fn: Column, tn: Column | None = None) -> dict[str, Column]:
    """Precision, recall and F, and with true negatives specificity and accuracy; null where a ratio has nothing below."""
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    out = {"precision": p, "recall": r, "f_score": over(2.0 * p * r, p + r)}
    return out if tn is None else out | {"specificity": over(tn, tn + fp), "accuracy": over(tp + tn, tp + fp + fn + tn)}


def base_scores(mine: DataFrame, model: DataFrame, key: str, length: int) -> DataFrame:
    """base_confusion with the bases in neither, of sequences of one length, and all ratios."""
    c = base_confusion(mine, model, key).withColumn("tn", F.lit(length) - F.col("tp") - F.col("fp") - F.col("fn"))
    return c.withColumns(ratios(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def match_scores(mine: DataFrame, model: DataFrame, key: str, gap: int) -> DataFrame:
    """feature_match with precision (of mine), recall (of the model) and F."""
    m = feature_match(mine, model, key, gap)
    p, r = F.col("tp") / F.nullif("n_mine", F.lit(0)), F.col("recalled") / F.nullif("n_model", F.lit(0))
    return m.withColumns({"precision": p, "recall": r, "f_score": 2.0 * p * r / F.nullif(p + r, F.lit(0.0))})


def combined(*parts: DataFrame) -> DataFrame:
    """Annotations put together, in the order of features: by start, the longer first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("k").orderBy("fstart", F.desc("fend"), "id")
    return out.withColumn("rank", F.row_number().over(w))


def neighbours(features: DataFrame) -> DataFrame:
    """Each feature with the next one on its sequence."""
    w = Window.partitionBy("k").orderBy("fstart", F.desc("fend"), "id")
    return features.select("k", "id", F.lead("id").over(w).alias("next_id"), (F.lead("fstart").over(w) - F.col("fend")).alias("distance"))


def gene_likelihood(genes: DataFrame, read: int = 300, least: int = 100) -> DataFrame:
    """(species, gene, likelihood): the chance of a read of `read` bases, `least` of them on the gene, among all genes of the species. genes has species, gene, len."""
    g = genes.groupBy("species", "gene").agg(F.sum("len").alias("len"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("species")
    return g.select("species", "gene", ((F.col("len") + read - least) / (F.sum("len").over(w) + F.sum("n").over(w) * (read - least))).alias("likelihood"))


def merged_tables(canonical: DataFrame, annotation: DataFrame, key: str) -> DataFrame:
    """Canonical entries with their annotation, where the coding bases are whole codons."""
    both = canonical.join(annotation, key)
    return both.where(F.col("bases") % 3 == 0)


def feature_sequences(features: DataFrame, seqs: DataFrame) -> DataFrame:
    """(id, seq): the bases of each feature of its sequence."""
    return features.join(seqs, "k").select("id", F.substring(F.col("seq"), F.col("fstart").cast("int"), (F.col("fend") - F.col("fstart") + 1).cast("int")).alias("seq"))
