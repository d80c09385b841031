"""The bidirected graph as edge rows (n0, d0, n1, d1): a true direction leaves its node outward. All is joins and aggregates by node;
iterations settle between rounds and stop when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.columns import A_TOL, KMER, R_TOL, approx_compare, poisson_distance
from seqloom.operators.settle import settled

EPSILON = 0.01


def edges_of_reads(hits: DataFrame) -> DataFrame:
    """Distinct edges between neighbouring hits of a read; pairs of one node are left out."""
    w = Window.partitionBy("read_id").orderBy("hit_seq")
    l = hits.select(F.col("node_id").alias("a"), F.col("strand").alias("da"), F.lead("node_id").over(w).alias("b"), (~F.lead("strand").over(w)).alias("db")).where("b is not null and a <> b")
    first = F.col("a") < F.col("b")
    return l.select(F.least("a", "b").alias("n0"), F.when(first, F.col("da")).otherwise(F.col("db")).alias("d0"), F.greatest("a", "b").alias("n1"), F.when(first, F.col("db")).otherwise(F.col("da")).alias("d1")).distinct()


def incidence(edges: DataFrame, *more: str) -> DataFrame:
    """Two rows an edge, (node, dir, other, other_dir), from one scan; the second end of a loop that leaves where it enters is the same end."""
    end = lambda a, b: F.struct(F.col(f"n{a}").alias("node"), F.col(f"d{a}").alias("dir"), F.col(f"n{b}").alias("other"), F.col(f"d{b}").alias("other_dir"))
    return edges.select(F.inline(F.array(end(0, 1), end(1, 0))), *more) if not more else edges.select(F.explode(F.array(end(0, 1), end(1, 0))).alias("e"), *more).select("e.*", *more)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of every node with an edge; a loop counts at both its ends."""
    return incidence(edges).groupBy("node").agg(F.count_if("dir").alias("n_out"), F.count_if(~F.col("dir")).alias("n_in"))


def edge_direction(node: Column) -> Column:
    """Direction of an edge at a node; null where a loop leaves and enters it."""
    return F.when((F.col("n0") == F.col("n1")) & (F.col("d0") != F.col("d1")), F.lit(None).cast("boolean")).when(F.col("n0") == node, F.col("d0")).otherwise(F.col("d1"))


def edge_length(path_length: Column | None = None, first: Column | None = None, last: Column | None = None, k: int = KMER) -> Column:
    """Minus the overlap; of an edge that stands for a path, the path without its end nodes."""
    plain = F.lit(-k)
    return plain if path_length is None else F.coalesce(path_length - first - last, plain)


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the length and coverage of both end nodes."""
    side = lambda i: nodes.select(F.col("node_id").alias(f"n{i}"), F.col("len").alias(f"len{i}"), F.col("cov").alias(f"cov{i}"))
    return edges.join(side(0), "n0").join(side(1), "n1")


def expanded(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """One step of each state (node, dir, ...) along the edges that leave in its direction."""
    steps = incidence(edges).select(F.col("node"), F.col("dir"), F.col("other").alias("_o"), (~F.col("other_dir")).alias("_d"))
    rest = [c for c in frontier.columns if c not in ("node", "dir")]
    return frontier.join(steps, ["node", "dir"]).select(F.col("_o").alias("node"), F.col("_d").alias("dir"), *rest)


def bounded_distances(roots: DataFrame, edges: DataFrame, nodes: DataFrame, bound: int, k: int = KMER) -> DataFrame:
    """(root, root_dir, node, dir, d): least distance from each root's end to every state within bound, from all roots at once.

    The root itself is at minus its length; a step adds the edge (minus k) and the node left behind. A state is out of bound
    when it lies over A_TOL beyond and over the tolerance in proportion. Only states that a round improves go on.
    """
    lens = nodes.select(F.col("node_id").alias("node"), "len")
    best = settled(roots.join(lens, "node").select(F.col("node").alias("root"), F.col("dir").alias("root_dir"), "node", "dir", (-F.col("len")).cast("long").alias("d")))
    fresh = best
    key = ["root", "root_dir", "node", "dir"]
    beyond = (F.col("d") - bound > A_TOL) & (approx_compare(F.col("d").cast("double"), F.lit(float(bound)), R_TOL) > 0)
    while not fresh.isEmpty():
        moved = expanded(fresh.join(lens, "node").withColumn("d", F.col("d") + F.col("len") - k).drop("len"), edges).where(~beyond)
        offer = moved.groupBy(*key).agg(F.min("d").alias("new"))
        fresh = settled(offer.join(best, key, "left").where("d is null or new < d").select(*key, F.col("new").alias("d")))
        best = settled(best.unionByName(fresh).groupBy(*key).agg(F.min("d").alias("d")))
    return best


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node connected with each. Rounds point every node's larger neighbours to its least one, then its smaller ones, so they grow with the logarithm of a component."""
    star = settled(edges.select(F.greatest("n0", "n1").alias("u"), F.least("n0", "n1").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        mark = star.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == last:
            break
        last = mark
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = settled(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
    found = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select(F.col("node_id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def uncut_edges(edges: DataFrame) -> DataFrame:
    """Edges that remain when a node of two or more entering edges loses those, and likewise of leaving ones."""
    ends = incidence(edges).groupBy("node", "dir").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("node", "dir")
    side = lambda i: ends.select(F.col("node").alias(f"n{i}"), F.col("dir").alias(f"d{i}"))
    return edges.join(side(0), ["n0", "d0"], "left_anti").join(side(1), ["n1", "d1"], "left_anti").select("n0", "d0", "n1", "d1")


def chains(nodes: DataFrame, edges: DataFrame, k: int = KMER) -> DataFrame:
    """Unbranched chains: component, n_nodes, n_edges, circular (as many edges as nodes) and length of what each spells."""
    left = settled(uncut_edges(edges))
    of = components(nodes, left)
    sizes = nodes.join(of, nodes["node_id"] == of["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("len").alias("bases"))
    inner = left.join(of, left["n0"] == of["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    n = F.coalesce("n_edges", F.lit(0))
    return sizes.join(inner, "component", "left").select("component", "n_nodes", n.alias("n_edges"), (n >= F.col("n_nodes")).alias("circular"), (F.col("bases") - n * k).cast("long").alias("length"))


def contracted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links (a, b, n) between the chains that the cut edges join: the output graph."""
    left = settled(uncut_edges(edges))
    of = settled(components(nodes, left))
    cut = edges.join(left, ["n0", "d0", "n1", "d1"], "left_anti")
    side = lambda c, x: of.select(F.col("node").alias(c), F.col("component").alias(x))
    both = cut.join(side("n0", "x"), "n0").join(side("n1", "y"), "n1")
    return both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def relaxed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round of edge coverage: each edge gives back half of its ends' excess, weighted by their lengths and over their squared degree, unless nothing would be left. edges has cov (null counts 1)."""
    e = edges.withColumn("c", F.coalesce("cov", F.lit(1.0)))
    sums = incidence(e, "c").groupBy("node", "dir").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("deg"))
    info = sums.join(nodes.select(F.col("node_id").alias("node"), "len", "cov"), "node")
    part = F.col("len") * (F.col("s") - F.col("cov")) / (F.col("deg") * F.col("deg"))
    side = lambda i: info.select(F.col("node").alias(f"n{i}"), F.col("dir").alias(f"d{i}"), part.alias(f"g{i}"), F.col("len").alias(f"l{i}"))
    step = e.join(side(0), ["n0", "d0"]).join(side(1), ["n1", "d1"]).withColumn("delta", 0.5 * (F.col("g0") + F.col("g1")) / (F.col("l0") + F.col("l1")))
    return step.select("n0", "d0", "n1", "d1", F.when(F.col("c") <= F.col("delta"), F.col("c")).otherwise(F.col("c") - F.col("delta")).alias("cov"), F.abs(F.col("delta") / F.col("c")).alias("change"))


def node_coverage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cov): the coverage of a node's two sides, each weighted by the length of the nodes there."""
    lens = nodes.select(F.col("node_id").alias("other"), "len")
    side = incidence(edges, "cov").join(lens, "other").groupBy("node", "dir").agg(F.sum("cov").alias("c"), F.sum("len").alias("w"))
    return side.groupBy("node").agg((F.sum(F.col("c") * F.col("w")) / F.sum("w")).alias("cov"))


def relaxed(edges: DataFrame, nodes: DataFrame, rounds: int = 21) -> tuple[DataFrame, DataFrame]:
    """Edge and node coverage after alternating rounds until both change by EPSILON at most, or rounds of each are done."""
    for _ in range(rounds):
        for _ in range(rounds):
            step = settled(relaxed_edges(edges, nodes))
            edges = step.drop("change")
            if not step.agg(F.max("change")).first()[0] or step.where(F.col("change") > EPSILON).isEmpty():
                break
        new = node_coverage(edges, nodes).withColumnRenamed("cov", "new")
        both = settled(nodes.join(new, nodes["node_id"] == new["node"], "left"))
        done = both.where(F.abs(F.col("new") - F.col("cov")) / F.col("cov") > EPSILON).isEmpty()
        nodes = both.select(*[F.coalesce("new", "cov").alias("cov") if c == "cov" else F.col(c) for c in nodes.columns])
        if done:
            break
    return edges, nodes


def nearest_bin(nodes: DataFrame, bins: DataFrame, eps: float = 3.0) -> DataFrame:
    """(node_id, bin_id): the bin of nearest coverage, null where that is over eps away and the node over half as deep again as the least bin. bins are few and broadcast: one row a population."""
    least = bins.agg(F.min("est_cov").alias("least"))
    met = nodes.crossJoin(F.broadcast(bins.agg(F.collect_list(F.struct("est_cov", "bin_id")).alias("v")))).crossJoin(F.broadcast(least))
    far = F.transform("v", lambda b: F.struct(poisson_distance(F.col("cov"), b["est_cov"]).alias("d"), b["bin_id"].alias("bin_id")))
    best = F.array_min(far)
    return met.select("node_id", F.when(~((F.col("cov") > 1.5 * F.col("least")) & (best["d"] > eps)), best["bin_id"]).alias("bin_id"))


def significant(nodes: DataFrame, of: DataFrame, edges: DataFrame, threshold: float, keep: bool = False, anchor: int = 1000, k: int = KMER) -> DataFrame:
    """(component, significant): a unique node, or enough coverage, length still present, and edges. nodes has cov0 (first coverage) and is_unique."""
    n = nodes.join(of, nodes["node_id"] == of["node"])
    size = F.col("len") - k
    here = F.col("cov") > F.col("cov0") / 3
    total = n.groupBy("component").agg(F.bool_or("is_unique").alias("u"), F.sum(size).alias("tlen"), (F.lit(1) + F.sum(F.when(here, size).otherwise(0))).alias("clen"), F.sum(F.when(here, F.col("cov") * size).otherwise(0.0)).alias("ccov"))
    e = edges.join(of, edges["n0"] == of["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    low = approx_compare(F.col("ccov") / F.nullif(F.col("tlen"), F.lit(0)), F.lit(0.0 if keep else threshold)) < 0
    short = F.col("clen") < F.greatest(F.lit(float(anchor)), 0.5 * F.col("tlen"))
    alone = F.lit(not keep) & (F.coalesce("n_edges", F.lit(0)) < 1)
    return total.join(e, "component", "left").select("component", (F.col("u") | ~F.coalesce(low | short | alone, F.lit(True))).alias("significant"))


def spelled(steps: DataFrame, nodes: DataFrame, k: int = KMER) -> DataFrame:
    """(path, seq) of paths (path, pos, node_id, forward, gap): each node turned as it is walked and without the overlap with the one before; gap > 0 puts so many N in place of an overlap."""
    turned = F.when(F.col("forward"), F.col("seq")).otherwise(F.reverse(F.translate("seq", "ACGT", "TGCA")))
    first = F.row_number().over(Window.partitionBy("path").orderBy("pos")) == 1
    part = F.when(first, turned).when(F.col("gap") > 0, F.concat(F.repeat(F.lit("N"), F.col("gap").cast("int")), turned)).otherwise(F.substring(turned, F.lit(k + 1), F.length("seq")))
    placed = steps.join(nodes.select("node_id", "seq"), "node_id").select("path", "pos", part.alias("s"))
    return placed.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("seq"))


def reversed_path(steps: Column) -> Column:
    """An array of (node, forward) walked the other way."""
    return F.transform(F.reverse(steps), lambda x: F.struct(x["node"].alias("node"), (~x["forward"]).alias("forward")))


def ending_id(steps: Column) -> Column:
    """Canonical text of a path's two ends."""
    from seqloom.functions.columns import canonical_edge

    a, b = F.element_at(steps, 1), F.element_at(steps, -1)
    return canonical_edge(a["node"], a["forward"], b["node"], ~b["forward"])


def closest_distance(path: DataFrame, target: Column, distance: Column, k: int = KMER) -> DataFrame:
    """(path, deviation) of rows (path, pos, node_id, len): of the target's places beyond the root within tolerance of distance, the least difference, sign kept; null where none is."""
    before = F.sum("len").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)) - F.first("len").over(Window.partitionBy("path").orderBy("pos"))
    at = path.withColumn("at", before - k * F.row_number().over(Window.partitionBy("path").orderBy("pos")) + k)
    dev = F.col("at") - distance
    near = (F.col("node_id") == target) & ((F.abs(dev) < A_TOL) | (approx_compare(F.col("at").cast("double"), distance.cast("double")) == 0))
    return at.groupBy("path").agg(F.min(F.when(near, F.struct(F.abs(dev).alias("a"), dev.alias("dev"))))["dev"].alias("deviation"))


def split_at_anchors(steps: DataFrame, anchor: Column) -> DataFrame:
    """(path, part, pos, node_id): the stretches between neighbouring anchors of a path, both included; what lies outside goes."""
    w = Window.partitionBy("path").orderBy("pos")
    n = F.sum(F.when(anchor, 1).otherwise(0)).over(w)
    total = F.sum(F.when(anchor, 1).otherwise(0)).over(Window.partitionBy("path"))
    at = steps.withColumns({"_n": n, "_t": total, "_a": anchor})
    parts = F.when(F.col("_a"), F.filter(F.array(F.col("_n") - 1, F.col("_n")), lambda x: (x >= 1) & (x < F.col("_t")))).otherwise(F.filter(F.array(F.col("_n")), lambda x: (x >= 1) & (x < F.col("_t"))))
    return at.select("path", F.explode(parts).alias("part"), "pos", "node_id")


def reduced(edges: DataFrame, spent: DataFrame, added: DataFrame) -> DataFrame:
    """Edges without those that a unique path uses up, and with the composite edges that stand for it."""
    key = ["n0", "d0", "n1", "d1"]
    return edges.join(spent.select(*key), key, "left_anti").select(*key).unionByName(added.select(*key)).distinct()


def successor_votes(steps: DataFrame, least: int = 20, weight: int = 2) -> DataFrame:
    """Nodes that long reads show to be unique: (node_id, dir, anchor, votes) evidence of at least `least` in sum, with one anchor at most of weight votes on each side."""
    votes = steps.groupBy("node_id", "dir", "anchor").agg(F.count(F.lit(1)).alias("votes"))
    sides = votes.groupBy("node_id").agg(F.sum("votes").alias("total"), F.count_if(F.col("dir") & (F.col("votes") >= weight)).alias("after"), F.count_if(~F.col("dir") & (F.col("votes") >= weight)).alias("before"))
    return sides.where((F.col("total") >= least) & (F.col("after") <= 1) & (F.col("before") <= 1))
