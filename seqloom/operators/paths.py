"""Paths through the bidirected graph: all paths of about a length between two ends, and the order of nodes in unbranched chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.columns import A_TOL, KMER, R_TOL, approx_compare
from seqloom.operators.graph import bounded_distances, components, incidence, uncut_edges
from seqloom.operators.settle import settled

#: Partial paths that a request carries to the next round, those nearest to their remaining distance first.
WIDTH = 10_000


def all_paths(requests: DataFrame, edges: DataFrame, nodes: DataFrame, unique: Column, k: int = KMER, width: int = WIDTH) -> DataFrame:
    """(req, path, deviation) of every path that answers a request (req, src, src_dir, dst, dst_dir, distance).

    A path leaves src at src_dir and enters dst at dst_dir, with a length between them within A_TOL of distance; its text lists
    the nodes after src with the side they are entered by. It goes only through states from which dst can still be reached in
    what remains, and unique nodes only end it. All requests go on together, a join with the edges and one with the distances
    a round; a request of more than width open paths keeps the nearest ones, a fixed count in place of a clock.
    """
    furthest = requests.agg(F.max("distance")).first()[0]
    ends = requests.select(F.col("dst").alias("node"), F.col("dst_dir").alias("dir")).distinct()
    if furthest is None:
        return requests.select("req", F.lit("").alias("path"), F.col("distance").alias("deviation"))
    reach = bounded_distances(ends, edges, nodes, int(furthest), k).select(F.col("root").alias("dst"), F.col("root_dir").alias("dst_dir"), F.col("node").alias("other"), F.col("dir").alias("other_dir"), "d")
    reach = settled(reach)
    known = nodes.select(F.col("node_id").alias("other"), F.col("len").alias("step"), unique.alias("anchor"))
    steps = settled(incidence(edges).join(known, "other"))
    start = requests.join(reach.select("dst", "dst_dir", F.col("other").alias("src"), (~F.col("other_dir")).alias("src_dir"), "d"), ["dst", "dst_dir", "src", "src_dir"])
    start = start.where(~((F.col("d") - F.col("distance") > A_TOL) & (approx_compare(F.col("d").cast("double"), F.col("distance").cast("double"), R_TOL) > 0)))
    open_ = start.select("req", "dst", "dst_dir", F.col("src").alias("node"), F.col("src_dir").alias("dir"), F.col("distance").alias("left"), (F.col("distance") + A_TOL).alias("limit"), F.lit("").alias("path"))
    found = None
    while found is None or not open_.isEmpty():
        at_end = F.col("other") == F.col("dst")
        moved = open_.join(steps, ["node", "dir"]).where(~F.col("anchor") | at_end).join(reach, ["dst", "dst_dir", "other", "other_dir"]).where(F.col("d") < F.col("limit"))
        text = F.concat(F.col("path"), F.when(F.col("path") == "", "").otherwise(","), F.col("other").cast("string"), F.when(F.col("other_dir"), "o").otherwise("i"))
        moved = settled(moved.select("req", "dst", "dst_dir", F.col("other").alias("node"), F.col("other_dir").alias("side"), F.col("left").alias("before"), "step", "d", text.alias("path")))
        met = moved.where((F.col("node") == F.col("dst")) & (F.col("side") == F.col("dst_dir")) & (F.abs(F.col("before") + k) < A_TOL))
        met = met.select("req", "path", (F.col("before") + k).alias("deviation"))
        found = met if found is None else found.unionByName(met)
        nearest = Window.partitionBy("req").orderBy(F.abs(F.col("before") - F.col("d")), "path")
        kept = moved.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= width)
        open_ = kept.select("req", "dst", "dst_dir", "node", (~F.col("side")).alias("dir"), (F.col("before") - F.col("step") + k).alias("left"), (F.col("before") + A_TOL).alias("limit"), "path")
    return found


def ordered_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain, node, forward, pos, circular) of every node of the graph's unbranched chains.

    A chain is named by the lesser of its two end nodes, where it starts; a circle starts at its least node, leaving outward.
    Every node has a state for each way through it; each state points to the next, and rounds double the pointers, so that
    their number grows with the logarithm of the longest chain. No chain is gathered in a task.
    """
    left = settled(uncut_edges(edges))
    of = components(nodes, left)
    inner = left.select(F.col("n0").alias("node")).join(of, "node").groupBy("component").agg(F.count(F.lit(1)).alias("e"))
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(inner, "component", "left")
    rings = settled(sizes.where("e >= n").select(F.col("component").alias("ring")))
    states = nodes.select(F.col("node_id").alias("node"), F.explode(F.array(F.lit(True), F.lit(False))).alias("dir"))
    out = incidence(left).select("node", "dir", "other", (~F.col("other_dir")).alias("odir"))
    # a ring is cut where it comes back to the outward state of its least node, and its twin where that leaves inward
    back = rings.select(F.col("ring").alias("other"), F.lit(True).alias("odir"))
    away = rings.select(F.col("ring").alias("node"), F.lit(False).alias("dir"))
    out = out.join(back, ["other", "odir"], "left_anti").join(away, ["node", "dir"], "left_anti")
    at = settled(states.join(out, ["node", "dir"], "left").select("node", "dir", F.coalesce("other", "node").alias("to"), F.coalesce("odir", "dir").alias("to_dir"), F.col("other").isNotNull().cast("long").alias("d")))
    mark = None
    while True:
        total = at.agg(F.sum("d")).first()[0]
        if total == mark:
            break
        mark = total
        ahead = at.select(F.col("node").alias("to"), F.col("dir").alias("to_dir"), F.col("to").alias("to2"), F.col("to_dir").alias("dir2"), F.col("d").alias("d2"))
        at = settled(at.join(ahead, ["to", "to_dir"]).select("node", "dir", F.col("to2").alias("to"), F.col("dir2").alias("to_dir"), (F.col("d") + F.col("d2")).alias("d")))
    # the way back from a state ends where the way through it starts
    seen = at.select("node", (~F.col("dir")).alias("forward"), F.col("to").alias("chain"), F.col("d").alias("pos"))
    best = seen.groupBy("node").agg(F.min(F.struct("chain", (~F.col("forward")).alias("b"), "pos")).alias("x"))
    best = best.select("node", F.col("x.chain").alias("chain"), (~F.col("x.b")).alias("forward"), F.col("x.pos").alias("pos"))
    return best.join(rings, F.col("chain") == F.col("ring"), "left").select("chain", "node", "forward", "pos", F.col("ring").isNotNull().alias("circular"))
