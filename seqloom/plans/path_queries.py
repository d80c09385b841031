"""Path search, ordered chains, graph files with dense ids, reports, distributions and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import probability as D
from seqloom.operators import graph as G
from seqloom.operators import paths as P
from seqloom.operators import reports as R
from seqloom.plans.adapters import EDGES_SQL, HITS_SQL, INCID_SQL, NODES_SQL, edges, hits, nodes, read
from seqloom.plans.graph_queries import CHAIN_SQL

c = F.col
BOUND = 40_000


def _paths(s, d):
    n, e = nodes(s, d), edges(s, d)
    ends = n.where("node_id % 8 = 0").select(c("node_id").alias("node"), F.explode(F.array(F.lit(True), F.lit(False))).alias("dir"))
    reach = G.bounded_distances(ends, e, n, BOUND).where(f"node % 3 <> 1 and d between 1 and {BOUND}")
    asked = reach.select(F.concat_ws(":", "root", "root_dir", "node", "dir").alias("req"), c("node").alias("src"), (~c("dir")).alias("src_dir"), c("root").alias("dst"), c("root_dir").alias("dst_dir"), (c("d") + c("node") % 400).alias("distance"))
    return P.all_paths(asked, e, n, c("node_id") % 20 == 3)


WALK_SQL = f"e as materialized {INCID_SQL}, n as materialized {NODES_SQL}, walk(root, root_dir, node, dir, d) as (select node_id, x, node_id, x, -len from n, (values (true), (false)) v(x) where node_id % 8 = 0 union select root, root_dir, other, not other_dir, d + len - 127 from walk join n on walk.node = n.node_id join e on e.node = walk.node and e.dir = walk.dir where d + len - 127 <= {BOUND} + 400), reach as materialized (select root, root_dir, node, dir, min(d) as d from walk group by 1, 2, 3, 4)"
PATHS_SQL = f"""with recursive {WALK_SQL},
asked as materialized (select concat_ws(':', root, root_dir, node, dir) as req, node as src, not dir as src_dir, root as dst, root_dir as dst_dir, d + node % 400 as distance from reach where node % 3 <> 1 and d between 1 and {BOUND}),
go(req, dst, dst_dir, node, dir, rest, lim, path, entered, before) as (
  select req, dst, dst_dir, src, src_dir, distance, distance + 300, '', null::boolean, null::bigint from asked
  union all
  select req, go.dst, go.dst_dir, e.other, not e.other_dir, rest - len + 127, rest + 300, path || case when path = '' then '' else ',' end || e.other || case when e.other_dir then 'o' else 'i' end, e.other_dir, rest
  from go join e on e.node = go.node and e.dir = go.dir join n on n.node_id = e.other join reach r on r.root = go.dst and r.root_dir = go.dst_dir and r.node = e.other and r.dir = e.other_dir
  where (e.other % 20 <> 3 or e.other = go.dst) and r.d < lim)
select req, path, before + 127 as deviation from go where node = dst and entered = dst_dir and abs(before + 127) < 300"""

ORDER_SQL = f"""with recursive {CHAIN_SQL}, i as (select n0 as node, d0 as dir, n1 as other, not d1 as odir from u union all select n1, d1, n0, not d0 from u),
rings as (select component as ring from comp group by 1 having count(*) <= (select count(*) from u join comp k on u.n0 = k.node where k.component = comp.component)),
heads as (select node_id as node, x as dir from {NODES_SQL}, (values (true), (false)) v(x) where not exists (select 1 from i where i.node = node_id and i.dir = not x) union select ring, true from rings),
step(chain, cdir, node, forward, pos) as (select node, dir, node, dir, 0::bigint from heads union all select chain, cdir, other, odir, pos + 1 from step join i on i.node = step.node and i.dir = step.forward where other <> chain)
select chain, node, forward, pos, chain in (select ring from rings) as circular from step qualify row_number() over (partition by node order by chain, not forward) = 1"""


def _reindexed(s, d):
    n = nodes(s, d).where("node_id % 4 <> 0")
    place = (c("node_id") * 7919) % 10007 * 1_000_000 + c("node_id")
    seg = n.select(place.alias("at"), c("node_id").cast("string").alias("name"))
    links = edges(s, d).select(c("n0").cast("string").alias("a"), c("n1").cast("string").alias("b"))
    step = F.struct("hit_seq", F.concat(c("node_id").cast("string"), F.when(c("strand"), "+").otherwise("-")).alias("x"))
    paths = hits(s, d).groupBy(c("read_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(step)).alias("v")).select("path", F.array_join(F.transform("v", lambda x: x["x"]), ",").alias("steps"))
    bins = n.select(place.alias("at"), c("node_id").cast("string").alias("name"), (c("node_id") * 31 % 7 - 1).alias("bin"))
    a, b, p, q = R.reindexed(seg, links, paths, bins)
    none = F.lit("")
    return a.select(F.lit("S").alias("kind"), c("name").alias("a"), none.alias("b")).unionByName(b.select(F.lit("L").alias("kind"), "a", "b")).unionByName(p.select(F.lit("P").alias("kind"), c("path").alias("a"), c("steps").alias("b"))).unionByName(q.select(F.lit("B").alias("kind"), c("name").alias("a"), c("bin").cast("string").alias("b")))


REINDEXED_SQL = f"""with n as (select *, node_id * 7919 % 10007 * 1000000 + node_id as place, node_id * 31 % 7 - 1 as bin from {NODES_SQL} where node_id % 4 <> 0),
ids as (select node_id, cast(row_number() over (order by place) as varchar) as id from n),
bids as (select bin, row_number() over (order by min(place)) as id from n where bin > 0 group by 1)
select 'S' as kind, id as a, '' as b from ids
union all select 'L', coalesce(x.id, ''), coalesce(y.id, '') from {EDGES_SQL} e left join ids x on n0 = x.node_id left join ids y on n1 = y.node_id
union all select 'P', read_id::varchar, string_agg(coalesce(id, '') || case when strand then '+' else '-' end, ',' order by hit_seq) from {HITS_SQL} h left join ids on h.node_id = ids.node_id group by read_id
union all select 'B', ids.id, coalesce(bids.id, n.bin)::varchar from n join ids on n.node_id = ids.node_id left join bids on n.bin = bids.bin"""


def _progress(s, d):
    reads = read(s, d, "orders").select((c("o_orderkey") % 12).alias("step"), (c("o_orderkey") % 900 + 100).alias("bases"))
    n = nodes(s, d)
    scaffolds = n.where("node_id % 12 <> 7").select((c("node_id") % 12).alias("step"), "len", (c("node_id") % 5 == 0).alias("circular"))
    return R.progress(reads, scaffolds, n.where("node_id % 3 = 0").select((c("node_id") % 12).alias("step"), (c("size") * 10).alias("gap")))


PROGRESS_SQL = f"""with r as (select o_orderkey % 12 as step, count(*) as k, sum(o_orderkey % 900 + 100) as b from orders group by 1),
t as (select step, sum(k) over (order by step)::bigint as reads, sum(b) over (order by step)::bigint as bases from r),
s as (select node_id % 12 as step, len, node_id % 5 = 0 as circular, sum(len) over (partition by node_id % 12 order by len desc) as cum, sum(len) over (partition by node_id % 12) as total from {NODES_SQL} where node_id % 12 <> 7),
k as (select step, count(*) as scaffolds, count(*) filter (where circular) as circular, max(case when cum >= 0.5 * total then len end)::bigint as n50 from s group by 1),
g as (select node_id % 12 as step, count(*) as gaps, max(size * 10)::bigint as max_gap from {NODES_SQL} where node_id % 3 = 0 group by 1),
z as (select step, reads, bases, coalesce(scaffolds, 0) as scaffolds, coalesce(circular, 0) as circular, coalesce(n50, 0) as n50, coalesce(gaps, 0) as gaps, coalesce(max_gap, 0) as max_gap from t left join k using (step) left join g using (step))
select *, concat_ws(' |' || chr(9), step, reads, bases, scaffolds, circular, n50, gaps || '(' || max_gap || ')') as line from z"""

U_SQL = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint / 4294967296.0::double)"


def _log_logistic(s, d):
    x, scale, shape = ((c("node_id") % 997) + 0.5) / 997, c("size").cast("double"), 1 + c("cov") / 100
    n = nodes(s, d)
    return n.select("node_id", F.round(D.log_logistic(x, scale, shape), 6).alias("value"), F.round(D.log_logistic_density(x * 3 * scale + scale, scale, shape), 9).alias("density"))


def _log_binomial(s, d):
    n, x, p = c("len"), c("node_id") * 7919 % (c("len") + 1), (c("size") % 50 + 0.5) / 51
    few, some = c("size") % 40, F.least(c("size") % 40, c("node_id") % 7)
    return nodes(s, d).select("node_id", F.round(D.log_binomial(x, n, p), 5).alias("many"), F.round(D.log_binomial(some, few, p), 8).alias("few"))


def _beta_ratio(s, d):
    r = D.beta_ratio(c("size") % 9, c("size") % 9 + c("node_id") % 50, c("node_id") % 13, c("node_id") % 13 + c("size"))
    return nodes(s, d).select("node_id", F.round(r["mean"].cast("double"), 7).alias("mean"), F.round(r["sd"], 7).alias("sd"))


def _choices(s, d):
    weights = F.array(F.lit(0.125), F.lit(0.25), F.lit(0.0), F.lit(0.5))
    return nodes(s, d).select("node_id", D.weighted_choice((c("node_id") % 64) / F.lit(64.0), weights).alias("choice"), F.round(D.uniform(5, c("node_id")), 9).alias("u"), D.random_sequence(7, c("node_id"), c("size") - 1).alias("seq"))


BETA_SQL = f"""with p as (select node_id, (size % 9 + 1)::double as a, (node_id % 50 + 1)::double as b, (node_id % 13 + 1)::double as c, (size + 1)::double as d from {NODES_SQL}),
m as (select node_id, case when a > 1 then c / (c + d) * exp(lgamma(a - 1) - lgamma(a) + lgamma(a + b) - lgamma(a + b - 1)) end as m1,
  case when a > 2 then c * (c + 1) / (c + d) / (c + d + 1) * exp(lgamma(a - 2) - lgamma(a) + lgamma(a + b) - lgamma(a + b - 2)) end as m2 from p)
select node_id, round(m1, 7) as mean, round(sqrt(m2 - m1 * m1), 7) as sd from m"""
CHOICE_SQL = f"""select node_id, case when node_id % 64 <= 8 then 0 when node_id % 64 <= 24 then 1 when node_id % 64 <= 56 then 3 else 0 end as choice, round({U_SQL.format(seed=5, key='node_id')}, 9) as u,
  coalesce((select string_agg(substr('ACGT', floor({U_SQL.format(seed=7, key="node_id || ':' || i")} * 4)::int + 1, 1), '' order by i) from generate_series(1, size - 1) g(i)), '') as seq from {NODES_SQL}"""
LOG_BINOMIAL_SQL = f"""with x as (select node_id, len as n, node_id * 7919 % (len + 1) as x, size % 40 as m, least(size % 40, node_id % 7) as y, (size % 50 + 0.5::double) / 51 as p from {NODES_SQL}),
l as (select *, lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) as a, lgamma(m + 1) - lgamma(y + 1) - lgamma(m - y + 1) as b from x)
select node_id, round(a + x * ln(p) + (n - x) * ln(1 - p), 5) as many, round(b + y * ln(p) + (m - y) * ln(1 - p), 8) as few from l"""
LOG_LOGISTIC_SQL = f"""with x as (select node_id, (node_id % 997 + 0.5::double) / 997 as u, size::double as a, 1 + cov / 100 as b from {NODES_SQL})
select node_id, round(a * exp(ln(u / (1 - u)) / b), 6) as value, round(pow(b * (3 * u + 1), -b - 1) / pow(1 + pow(3 * u + 1, -b), 2), 9) as density from x"""
GENES_SQL = "select i, 'gene' || (100 + floor({g} * 400))::bigint || chr(9) || '0' || chr(9) || floor({n} * 200)::bigint as line from generate_series(100, 499) t(i)".format(g=U_SQL.format(seed=3, key="'gene:' || i"), n=U_SQL.format(seed=3, key="'length:' || i"))
DRAWS_SQL = f"with v as (select name, row_number() over (order by name) as k, count(*) over () as n from (select distinct p_name as name from part)), d as (select i as draw, {U_SQL.format(seed=11, key='i')} as u from generate_series(0, 999) t(i)) select draw, name from d join v on k = floor(u * n)::bigint + 1"

QUERIES = {
    "all_paths": (_paths, PATHS_SQL),
    "ordered_chains": (lambda s, d: P.ordered_chains(nodes(s, d), edges(s, d)), ORDER_SQL),
    "reindexed_graph": (_reindexed, REINDEXED_SQL),
    "progress_report": (_progress, PROGRESS_SQL),
    "log_logistic": (_log_logistic, LOG_LOGISTIC_SQL),
    "log_binomial": (_log_binomial, LOG_BINOMIAL_SQL),
    "beta_ratio": (_beta_ratio, BETA_SQL),
    "weighted_choices": (_choices, CHOICE_SQL),
    "made_up_genes": (lambda s, d: R.gene_list(s, 100, 500, 3, True), GENES_SQL),
    "sampled_names": (lambda s, d: R.sampled(read(s, d, "part").select(c("p_name").alias("name")), "name", 1000, 11), DRAWS_SQL),
}
