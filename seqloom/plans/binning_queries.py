"""Unique paths taken out of the graph, and the report of contigs with replicons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators import binning as B
from seqloom.operators import reports as R
from seqloom.plans.adapters import EDGES_SQL, HITS, HITS_SQL, INCID_SQL, NODES_SQL, edges, hits, nodes, read

c = F.col


def _steps(s, d):
    return hits(s, d).select(c("read_id").alias("path"), c("hit_seq").alias("pos"), c("node_id").alias("node"), c("strand").alias("forward"))


def _visits(s, d):
    w = Window.partitionBy("path")
    inner = _steps(s, d).withColumns({"_a": F.min("pos").over(w), "_z": F.max("pos").over(w)}).where("pos > _a and pos < _z")
    bins = inner.select(c("node").alias("item"), "path", "pos", F.when(c("path") % 5 != 0, c("path") % 3).alias("bin"), (c("path") % 3).alias("start_bin"), ((c("path") + c("path") % 2) % 3).alias("end_bin"))
    return B.accepted_paths(bins, c("path") % 7 != 0)


VISITS_SQL = f"x as (select *, min(hit_seq) over (partition by read_id) as a, max(hit_seq) over (partition by read_id) as z from {HITS_SQL}), v as (select node_id as item, read_id as path, hit_seq as pos, read_id % 3 as bin, (read_id + read_id % 2) % 3 as other from x where hit_seq > a and hit_seq < z and read_id % 5 <> 0 and read_id % 7 <> 0)"


def _copies(s, d):
    counts = nodes(s, d).select(c("node_id").alias("item"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("bin"), "size").select("item", "bin", ((c("item") + c("bin") * 5 + c("size")) % 9).alias("n"))
    return B.copies_left(counts.where("n > 0"), _visits(s, d))


def _replicons(s, d):
    n = nodes(s, d)
    contigs = n.select(c("node_id").alias("contig"), (c("node_id") % 300).alias("scaffold"), ((c("node_id") * 37) % 5000 * 100_000 + c("node_id")).alias("pos"))
    sort = F.when(c("hit_seq") % 5 == 0, "replicon").when(c("hit_seq") % 2 == 0, "gene").otherwise("resistance")
    eighth = read(s, d, "lineitem").where("l_orderkey % 8 = 0").selectExpr(*HITS)  # before the ranks of hits, which go by read
    found = eighth.select(c("node_id").alias("contig"), (c("read_id") * 100 + c("hit_seq")).alias("at"), sort.alias("sort"), F.concat(F.lit("f"), c("read_id").cast("string"), F.lit("_"), c("hit_seq").cast("string")).alias("text"))
    return R.replicon_report(contigs, found, 12_345_678)


REPLICONS_SQL = f"""with k as (select node_id as contig, node_id % 300 as scaffold, node_id * 37 % 5000 * 100000 + node_id as pos from {NODES_SQL}),
f as (select k.*, read_id * 100 + hit_seq as place, case when hit_seq % 5 = 0 then 'replicon' when hit_seq % 2 = 0 then 'gene' else 'resistance' end as sort, 'f' || read_id || '_' || hit_seq as text from {HITS_SQL} h join k on k.contig = h.node_id where read_id % 8 = 0),
m as (select scaffold, string_agg(contig || chr(9), '' order by pos) as names from k group by 1),
t as (select scaffold, count(*) filter (where sort = 'gene') || ' genes' || chr(9) || coalesce(string_agg('+' || text, '' order by pos, place) filter (where sort = 'replicon'), '')
  || coalesce(string_agg(' ' || chr(10) || chr(9) || text, '' order by pos, place) filter (where sort = 'gene'), '') || chr(10)
  || coalesce(string_agg(' ' || chr(10) || chr(9) || text, '' order by pos, place) filter (where sort = 'resistance'), '') || chr(10) as body from f group by 1)
select distinct contig, '>' || names || chr(10) || '>12.00Mpb' || chr(9) || body as text from f join m using (scaffold) join t using (scaffold) where sort = 'replicon'"""

QUERIES = {
    "spent_edges": (lambda s, d: B.spent_edges(_steps(s, d), edges(s, d), c("node") % 6 == 0), f"with x as (select *, row_number() over (partition by read_id order by hit_seq) as i, count(*) over (partition by read_id) as k from {HITS_SQL}), side as (select node_id as node, strand as dir from x where node_id % 6 = 0 and i < k union select node_id, not strand from x where node_id % 6 = 0 and i > 1) select * from {EDGES_SQL} e where (n0, d0) in (select (node, dir) from side) or (n1, d1) in (select (node, dir) from side)"),
    "copies_left": (_copies, f"with {VISITS_SQL}, k as (select node_id as item, bin, (node_id + bin * 5 + size) % 9 as n from {NODES_SQL}, (values (0), (1), (2)) b(bin)), t as (select v.*, row_number() over (partition by item, v.bin order by path, pos) as t, coalesce(k.n, 0) as n from v left join k using (item, bin)), a as (select item, bin, count(*) as a from t where t <= n group by 1, 2), b as (select item, other as bin, count(*) as b from t where t > n group by 1, 2) select item, bin::bigint as bin, greatest(n - coalesce(a, 0) - coalesce(b, 0), 0)::bigint as n from k left join a using (item, bin) left join b using (item, bin) where n - coalesce(a, 0) - coalesce(b, 0) > 0"),
    "coverage_left": (lambda s, d: B.coverage_left(nodes(s, d).select(c("node_id").alias("item"), "cov"), _visits(s, d).select("item", (1 + c("bin") / 2).alias("cov"))), f"with {VISITS_SQL}, t as (select item, sum(1 + bin / 2.0::double) as c from v group by 1) select node_id as item, greatest(cov - coalesce(c, 0), 0) as cov from {NODES_SQL} left join t on item = node_id"),
    "replicon_report": (_replicons, REPLICONS_SQL),
}
