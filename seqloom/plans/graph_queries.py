"""The bidirected graph of reads: degrees, distances, components, chains, coverage, bins and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions.columns import canonical_edge
from seqloom.operators import graph as P
from seqloom.operators.relational import nxx
from seqloom.plans.adapters import EDGES_SQL, FEATURES_SQL, HITS_SQL, INCID_SQL, NODES_SQL, edges, features, hits, nodes, read, seqs  # noqa: F401
from seqloom.plans.adapters import SEQS_SQL

c = F.col
BOUND = 30_000


def _roots(s, d):
    return nodes(s, d).where("node_id % 40 = 0").select(c("node_id").alias("node"), F.explode(F.array(F.lit(True), F.lit(False))).alias("dir"))


def _with_cov(s, d):
    return edges(s, d).withColumn("cov", F.when((c("n0") + c("n1")) % 5 != 0, ((c("n0") * 7 + c("n1")) % 100).cast("double") + 1))


EDGE_COV_SQL = f"(select *, case when (n0 + n1) % 5 <> 0 then ((n0 * 7 + n1) % 100)::double + 1 end as cov from {EDGES_SQL})"


def _relaxed(s, d):
    x = P.relaxed_edges(_with_cov(s, d), nodes(s, d))
    return x.select("n0", "d0", "n1", "d1", F.round("cov", 6).alias("cov"))


def _bins(s, d):
    a = read(s, d, "supplier").groupBy(c("s_nationkey").alias("bin_id")).agg(F.avg(1 + F.abs(F.floor("s_acctbal")) % 300).alias("est_cov"))
    return a.where("bin_id % 6 = 0")


BINS_SQL = "(select s_nationkey as bin_id, avg(1 + abs(floor(s_acctbal)) % 300) as est_cov from supplier where s_nationkey % 6 = 0 group by 1)"


def _significant(s, d):
    n = nodes(s, d).withColumns({"cov0": c("cov") * (1 + c("size") % 4), "is_unique": c("node_id") % 20 == 0})
    e = edges(s, d)
    return P.significant(n, P.components(n, e), e, 60.0)


COMPONENTS_SQL = f"e as materialized {EDGES_SQL}, both_ways as (select n0 as a, n1 as b from e union select n1, n0 from e), reach(node, label) as (select node_id, node_id from {NODES_SQL} union select b, label from reach join both_ways on node = a), comp as (select node, min(label) as component from reach group by 1)"
UNCUT_SQL = "ends as (select node, dir from (select n0 as node, d0 as dir from e union all select n1, d1 from e) group by 1, 2 having count(*) >= 2), u as (select e.* from e where (n0, d0) not in (select (node, dir) from ends) and (n1, d1) not in (select (node, dir) from ends))"
CHAIN_SQL = f"e as materialized {EDGES_SQL}, {UNCUT_SQL}, both_ways as (select n0 as a, n1 as b from u union select n1, n0 from u), reach(node, label) as (select node_id, node_id from {NODES_SQL} union select b, label from reach join both_ways on node = a), comp as (select node, min(label) as component from reach group by 1)"


def _steps_of_orders(s, d):
    h = hits(s, d)
    return h.select(c("read_id").alias("path"), c("hit_seq").alias("pos"), "node_id", c("rgt").alias("len"), "strand")


def _spelled(s, d):
    n = seqs(s, d).select((c("id") % 997).alias("node_id"), "seq").groupBy("node_id").agg(F.max("seq").alias("seq")).where("length(seq) >= 10 and length(seq) < 2000")
    st = hits(s, d).where("read_id % 20 = 0").select(c("read_id").alias("path"), c("hit_seq").alias("pos"), (c("node_id") % 997).alias("node_id"), c("strand").alias("forward"), (c("supp") % 4 - 1).alias("gap"))
    x = P.spelled(st, n, 5)
    return x.select("path", F.length("seq").cast("long").alias("n"), F.md5(c("seq").cast("binary")).alias("digest"))


def _flow(s, d):
    """The chain of the assembler's report: links of good hits, components, their lengths, N50 and N75 over them."""
    n, e = nodes(s, d), edges(s, d)
    of = P.components(n, e)
    sizes = n.join(of, n["node_id"] == of["node"]).groupBy("component").agg(F.sum("len").alias("len"))
    x = nxx(sizes, {"n50": 0.5, "n75": 0.75})
    return x.crossJoin(sizes.agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest")))


def _merged_gfa(s, d):
    """Two graphs put together: the second one's ids go on after the first one's, segments before links."""
    n = nodes(s, d)
    top = n.agg(F.max("node_id").alias("m"))
    second = n.where("node_id % 2 = 0").crossJoin(top).select((c("node_id") + c("m") + 1).alias("id"), F.lit(2).alias("part"))
    return n.select(c("node_id").alias("id"), F.lit(1).alias("part")).unionByName(second)


QUERIES = {
    "graph_edges": (lambda s, d: edges(s, d).select("n0", "d0", "n1", "d1", canonical_edge(c("n0").cast("string"), c("d0"), c("n1").cast("string"), c("d1")).alias("edge"), P.edge_direction(c("n1")).alias("at_n1"), P.edge_length().alias("length")), f"select *, case when cast(n0 as varchar) < cast(n1 as varchar) then cast(n0 as varchar) || case when d0 then '+' else '-' end || ',' || cast(n1 as varchar) || case when d1 then '-' else '+' end else cast(n1 as varchar) || case when d1 then '+' else '-' end || ',' || cast(n0 as varchar) || case when d0 then '-' else '+' end end as edge, d1 as at_n1, -127 as length from {EDGES_SQL}"),
    "graph_degrees": (lambda s, d: P.degrees(edges(s, d)), f"select node, count(*) filter (where dir) as n_out, count(*) filter (where not dir) as n_in from {INCID_SQL} group by 1"),
    "edge_endpoints": (lambda s, d: P.with_endpoints(edges(s, d), nodes(s, d)), f"select e.*, a.len as len0, a.cov as cov0, b.len as len1, b.cov as cov1 from {EDGES_SQL} e join {NODES_SQL} a on n0 = a.node_id join {NODES_SQL} b on n1 = b.node_id"),
    "neighbours": (lambda s, d: P.expanded(_roots(s, d).withColumn("root", c("node")), edges(s, d)), f"select other as node, not other_dir as dir, node as root from {INCID_SQL} where node % 40 = 0"),
    "bounded_distances": (lambda s, d: P.bounded_distances(_roots(s, d), edges(s, d), nodes(s, d), BOUND), f"with recursive e as materialized {INCID_SQL}, n as materialized {NODES_SQL}, walk(root, root_dir, node, dir, d) as (select node_id, x, node_id, x, -len from n, (values (true), (false)) v(x) where node_id % 40 = 0 union select root, root_dir, other, not other_dir, d + len - 127 from walk join n on walk.node = n.node_id join e on e.node = walk.node and e.dir = walk.dir where not (d + len - 127 - {BOUND} > 300 and (d + len - 127 - {BOUND})::double / greatest(abs(d + len - 127), {BOUND}) > 0.25)) select root, root_dir, node, dir, min(d) as d from walk group by 1, 2, 3, 4"),
    "components": (lambda s, d: P.components(nodes(s, d), edges(s, d)), f"with recursive {COMPONENTS_SQL} select node, component from comp"),
    "uncut_edges": (lambda s, d: P.uncut_edges(edges(s, d)), f"with e as {EDGES_SQL}, {UNCUT_SQL} select n0, d0, n1, d1 from u"),
    "unbranched_chains": (lambda s, d: P.chains(nodes(s, d), edges(s, d)), f"with recursive {CHAIN_SQL}, sizes as (select component, count(*) as n_nodes, sum(len) as bases from comp join {NODES_SQL} n on node = node_id group by 1), inner_ as (select component, count(*) as k from u join comp on n0 = node group by 1) select component, n_nodes, coalesce(k, 0) as n_edges, coalesce(k, 0) >= n_nodes as circular, cast(bases - coalesce(k, 0) * 127 as bigint) as length from sizes left join inner_ using (component)"),
    "contracted_graph": (lambda s, d: P.contracted(nodes(s, d), edges(s, d)), f"with recursive {CHAIN_SQL} select least(x.component, y.component) as a, greatest(x.component, y.component) as b, count(*) as n from (select * from e except select * from u) k join comp x on n0 = x.node join comp y on n1 = y.node group by 1, 2"),
    "edge_relaxation": (_relaxed, f"with e as (select *, coalesce(cov, 1.0::double) as c from {EDGE_COV_SQL}), i as (select n0 as node, d0 as dir, c from e union all select n1, d1, c from e), t as (select node, dir, n.len as l, n.len * (sum(c) - n.cov) / (count(*) * count(*)) as g from i join {NODES_SQL} n on node = node_id group by node, dir, n.len, n.cov), x as (select e.*, 0.5 * (a.g + b.g) / (a.l + b.l) as delta from e join t a on n0 = a.node and d0 = a.dir join t b on n1 = b.node and d1 = b.dir) select n0, d0, n1, d1, round(case when c <= delta then c else c - delta end, 6) as cov from x"),
    "node_coverage": (lambda s, d: P.node_coverage(_with_cov(s, d).na.fill(1.0, ["cov"]), nodes(s, d)).select("node", F.round("cov", 6).alias("cov")), f"with e as (select * replace (coalesce(cov, 1.0::double) as cov) from {EDGE_COV_SQL}), i as (select n0 as node, d0 as dir, n1 as other, cov from e union all select n1, d1, n0, cov from e), t as (select node, dir, sum(i.cov) as c, sum(len) as w from i join {NODES_SQL} n on other = node_id group by 1, 2) select node, round(sum(c * w) / sum(w), 6) as cov from t group by 1"),
    "nearest_bins": (lambda s, d: P.nearest_bin(nodes(s, d), _bins(s, d)), f"with b as {BINS_SQL}, x as (select node_id, cov, bin_id, 0.5 * (cov - est_cov) * (ln(cov) - ln(est_cov)) as d, (select min(est_cov) from b) as low from {NODES_SQL}, b), k as (select * from x qualify row_number() over (partition by node_id order by d, bin_id) = 1) select node_id, case when not (cov > 1.5 * low and d > 3) then bin_id end as bin_id from k"),
    "significant_components": (_significant, f"with recursive {COMPONENTS_SQL}, n as (select *, cov * (1 + size % 4) as cov0, node_id % 20 = 0 as u, len - 127 as z from {NODES_SQL}), t as (select component, bool_or(u) as u, sum(z) as tlen, 1 + sum(case when cov > cov0 / 3 then z else 0 end) as clen, sum(case when cov > cov0 / 3 then cov * z else 0 end) as ccov from n join comp on node = node_id group by 1), k as (select component, count(*) as m from e join comp on n0 = node group by 1) select component, u or not coalesce((abs(ccov / tlen - 60) / greatest(abs(ccov / tlen), 60) > 0.25 and ccov / tlen < 60) or clen < greatest(1000, 0.5 * tlen) or coalesce(m, 0) < 1, true) as significant from t left join k using (component)"),
    "spelled_paths": (_spelled, f"with n as (select id % 997 as node_id, max(seq) as seq from {SEQS_SQL} group by 1 having length(max(seq)) >= 10 and length(max(seq)) < 2000), s as (select read_id as path, hit_seq as pos, strand as f, supp % 4 - 1 as gap, seq, row_number() over (partition by read_id order by hit_seq) as i0 from {HITS_SQL} h join n on h.node_id % 997 = n.node_id where read_id % 20 = 0), t as (select path, pos, gap, i0, case when f then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end as x from s), p as (select path, pos, case when i0 = 1 then x when gap > 0 then repeat('N', gap) || x else substr(x, 6) end as y from t where x is not null) select path, cast(length(string_agg(y, '' order by pos)) as bigint) as n, md5(string_agg(y, '' order by pos)) as digest from p group by 1"),
    "closest_distances": (lambda s, d: P.closest_distance(_steps_of_orders(s, d), c("path") % 200, c("pos") * 2500), f"with x as (select read_id as path, hit_seq as pos, node_id, sum(rgt) over (partition by read_id order by hit_seq rows between unbounded preceding and 1 preceding) - first_value(rgt) over (partition by read_id order by hit_seq) - 127 * row_number() over (partition by read_id order by hit_seq) + 127 as p from {HITS_SQL}), y as (select *, p - pos * 2500 as dev, node_id = path % 200 and (abs(p - pos * 2500) < 300 or (p = 0 and pos * 2500 = 0) or abs(p - pos * 2500)::double / greatest(abs(p), pos * 2500) <= 0.25) as near from x) select path, cast(min_by(dev, abs(dev) * 2 + case when dev > 0 then 1 else 0 end) filter (where near) as bigint) as deviation from y group by 1"),
    "split_paths": (lambda s, d: P.split_at_anchors(_steps_of_orders(s, d), c("node_id") % 3 == 0).select("path", c("part").cast("long").alias("part"), "pos", "node_id"), f"with x as (select read_id as path, hit_seq as pos, node_id, node_id % 3 = 0 as a, sum(case when node_id % 3 = 0 then 1 else 0 end) over (partition by read_id order by hit_seq) as n, sum(case when node_id % 3 = 0 then 1 else 0 end) over (partition by read_id) as t from {HITS_SQL}) select path, cast(n as bigint) as part, pos, node_id from x where n >= 1 and n < t union all select path, cast(n - 1 as bigint), pos, node_id from x where a and n >= 2"),
    "reduced_edges": (lambda s, d: P.reduced(edges(s, d), edges(s, d).where("n0 % 3 = 0"), edges(s, d).where("n0 % 7 = 0").select("n0", "d0", (c("n1") + 1).alias("n1"), "d1")), f"with e as {EDGES_SQL} select * from e where n0 % 3 <> 0 union select n0, d0, n1 + 1, d1 from e where n0 % 7 = 0"),
    "successor_votes": (lambda s, d: P.successor_votes(hits(s, d).select("node_id", c("strand").alias("dir"), (c("read_id") % 9).alias("anchor")), 20, 8), f"with v as (select node_id, strand as dir, read_id % 9 as anchor, count(*) as n from {HITS_SQL} group by 1, 2, 3) select node_id, cast(sum(n) as bigint) as total, count(*) filter (where dir and n >= 8) as after, count(*) filter (where not dir and n >= 8) as before from v group by 1 having sum(n) >= 20 and count(*) filter (where dir and n >= 8) <= 1 and count(*) filter (where not dir and n >= 8) <= 1"),
    "assembly_report": (_flow, f"with recursive {COMPONENTS_SQL}, z as (select component, sum(len) as len from comp join {NODES_SQL} n on node = node_id group by 1), r as (select len, sum(len) over (order by len desc) as cum, sum(len) over () as total from z) select max(case when cum >= 0.5 * total then len end)::bigint as n50, max(case when cum >= 0.75 * total then len end)::bigint as n75, count(*) as n, max(len)::bigint as longest from r"),
    "merged_graphs": (_merged_gfa, f"with n as {NODES_SQL} select node_id as id, 1 as part from n union all select node_id + (select max(node_id) from n) + 1, 2 from n where node_id % 2 = 0"),
}
