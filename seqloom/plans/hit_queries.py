"""Hits, links, features and bridges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import cigar as G
from seqloom.functions import scalars as S
from seqloom.operators import bridges as B
from seqloom.operators import features as E
from seqloom.operators import hits as H
from seqloom.operators import relational as R
from seqloom.plans.adapters import FEATURES_SQL, HITS_SQL, NODES_SQL, features, hits, nodes, read
from seqloom.plans.scalar_queries import PAIRS_SQL, VECTORS_SQL

c = F.col
r6 = lambda x: F.round(x, 6)
UNIQUE = "(case when node_id % 3 = 0 then node_id % 2 end)"


def _reads(s, d):
    x = H.reads_of(hits(s, d))
    return x.select("read_id", F.size("hits").cast("long").alias("n"), c("hits")[0]["node_id"].alias("first_node"), F.array_max(F.transform("hits", lambda h: h["rgt"])).alias("reach"))


def _segments(s, d):
    g = R.range_groups(hits(s, d), "read_id", "lft", "rgt")
    return H.segments(g, F.expr(UNIQUE)).withColumn("segment", c("segment").cast("long"))


def _model(s, d, mine):
    f = features(s, d).where(c("mine") == mine)
    return f.select("id", (c("k") % 50).alias("k"), c("fstart").alias("start"), c("fend").alias("end"))


def _base_scores(s, d):
    x = E.base_scores(_model(s, d, True), _model(s, d, False), "k", 101_000)
    return x.select("k", "tp", "fp", "fn", "tn", *[r6(c(k)).alias(k) for k in ("precision", "recall", "f_score", "specificity", "accuracy")])


def _match_scores(s, d):
    x = E.match_scores(_model(s, d, True), _model(s, d, False), "k", 20)
    return x.select("tp", "recalled", "n_mine", "n_model", *[r6(c(k)).alias(k) for k in ("precision", "recall", "f_score")])


def _lifted(s, d):
    f = features(s, d)
    a, b = F.lit(20_000), F.lit(70_000)
    back = c("k") % 2 == 0
    x = G.lifted_feature(c("fstart"), c("fend"), F.lit("+"), c("score"), F.when(back, b).otherwise(a), F.when(back, a).otherwise(b), F.lit(101_000).cast("long"))
    return f.select("id", x.alias("x")).where("x is not null").select("id", "x.start", "x.end", "x.strand", r6(c("x.score")).alias("score"))


def _genes(s, d):
    g = features(s, d).select(c("kind").alias("species"), (c("k") % 40).alias("gene"), (c("fend") - c("fstart")).alias("len"))
    return E.gene_likelihood(g).select("species", "gene", F.round("likelihood", 9).alias("likelihood"))


def _canonical(s, d):
    f = features(s, d)
    a = f.where("mine").groupBy((c("k") % 97).alias("gene")).agg(F.sum(c("fend") - c("fstart") + 1).alias("bases"))
    b = f.where("not mine").groupBy((c("k") % 97).alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    return E.merged_tables(a, b, "gene")


def _unaligned(s, d):
    return H.unaligned(hits(s, d), c("read_len"))


def _multiplicity(s, d):
    h = hits(s, d).select("read_id", (c("node_id") % 5).alias("bin"))
    x = h.groupBy("read_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("read_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("bins"), F.sum(c("n") * (c("bin") + 1) * 10).alias("coverage"))


def _steps(s, d):
    p = H.pair_vectors(H.hit_pairs(hits(s, d)))
    return B.steps_of_reads(p, c("a_node_id") % 3 == 0)


STEPS_SQL = f"(select cast(a_node_id as varchar) || case when a_strand then 'o' else 'i' end as bridge, b_node_id as dest, dir, cast(floor(avg(mag)) as bigint) as mag, least(cast(count(*) * 60 as bigint), 6000) as score from {VECTORS_SQL} where a_node_id % 3 = 0 group by 1, 2, 3)"


def _levels(s, d):
    x = nodes(s, d).select("node_id", (c("size") % 3).alias("anchors"), (c("len") % 4).alias("segments"))
    lv = B.completion_level(c("anchors"), c("segments"), F.least("segments", c("node_id") % 5), F.least("segments", c("node_id") % 3))
    return x.select("node_id", lv.cast("long").alias("level"))


def _paths(s, d):
    """Candidate paths: a line of an order is a path of the order's segment."""
    return read(s, d, "lineitem").select(c("l_orderkey").alias("segment"), (c("l_partkey") * 1000 + c("l_suppkey")).alias("path"), ((c("l_quantity") * 20).cast("long") - 500).alias("deviation"), (c("l_extendedprice") / 100).alias("likelihood"), (c("l_orderkey") % 100).alias("bridge"))


PATHS_SQL = "(select l_orderkey as segment, l_partkey * 1000 + l_suppkey as path, cast(l_quantity * 20 as bigint) - 500 as deviation, l_extendedprice / 100 as likelihood, l_orderkey % 100 as bridge from lineitem)"


def _likely(s, d):
    return B.likely_paths(_paths(s, d), c("segment") % 2 == 0).select("segment", "path", "deviation")


def _voted(s, d):
    p = _paths(s, d).groupBy("path").agg(F.min("segment").alias("segment"), F.min("deviation").alias("deviation"), F.max("likelihood").alias("likelihood"))
    v = _paths(s, d).select("path", F.when(c("deviation") > -400, c("deviation")).alias("deviation"))
    return B.voted(p, v).select("segment", "path", "deviation")


def _scaffolds(s, d):
    h = hits(s, d)
    return h.select(c("read_id").alias("scaffold"), c("hit_seq").alias("pos"), "node_id", c("lft").alias("mag"), F.when(c("strand"), 1).otherwise(-1).alias("dir"), c("rgt").alias("len"), F.when(c("read_id") % 7 == 0, -c("read_len")).alias("circle"))


SCAFFOLDS_SQL = f"(select read_id as scaffold, hit_seq as pos, node_id, lft as mag, case when strand then 1 else -1 end as dir, rgt as len, case when read_id % 7 = 0 then -read_len end as circle from {HITS_SQL})"

KIND_LEN = "case when count(*) over (partition by k) > 0 then 1 end"

QUERIES = {
    "good_hits": (lambda s, d: H.good_hits(hits(s, d), nodes(s, d).where("size <= 40")).select("read_id", "hit_seq", "node_id", "len", "cov"), f"select read_id, hit_seq, h.node_id, n.len, n.cov from {HITS_SQL} h join {NODES_SQL} n using (node_id) where mapq >= 10 and n.size <= 40"),
    "contig_ids": (lambda s, d: read(s, d, "part").select("p_partkey", H.contig_id(F.concat(c("p_type"), F.when(c("p_partkey") % 2 == 0, "_").otherwise("-"), c("p_partkey").cast("string"), F.lit("_x"))).alias("id")), "select p_partkey, case when p_partkey % 2 = 0 then split_part(p_type || '_' || cast(p_partkey as varchar) || '_x', '_', 2) else split_part(p_type || '-' || cast(p_partkey as varchar) || '_x', '_', 2) end as id from part"),
    "reads_in_order": (_reads, f"select read_id, count(*) as n, min_by(node_id, lft * 1000 + hit_seq) as first_node, max(rgt) as reach from {HITS_SQL} group by read_id"),
    "read_segments": (_segments, f"""with o as (select *, max(rgt) over (partition by read_id order by lft, rgt desc, hit_seq rows between unbounded preceding and 1 preceding) as so_far from {HITS_SQL}), f as (select *, sum(case when so_far - lft > 254 or rgt <= so_far then 0 else 1 end) over (partition by read_id order by lft, rgt desc, hit_seq) as g from o), p as (select read_id, g, count(*) as n, case when count(*) = 1 then max({UNIQUE}) end as bin from f group by 1, 2), q as (select read_id, n, bin, row_number() over (partition by read_id order by g) as i, count(*) over (partition by read_id) as total from p),
t as (select * from q where total >= 2),
run(read_id, i, flag, size, bin, seg, out_flag, out_n) as (select read_id, i, case when bin is null then 0 else 1 end, n, bin, 0, null::int, null::bigint from t where i = 1 union all select t.read_id, t.i, case when t.bin is not null and (run.bin is null or run.bin = t.bin) then 1 else run.flag end, case when t.bin is not null and (run.bin is null or run.bin = t.bin) then 1 else run.size + t.n end, case when t.bin is not null and (run.bin is null or run.bin = t.bin) then t.bin else run.bin end, run.seg + case when run.out_n is not null then 1 else 0 end, case when t.bin is not null and (run.bin is null or run.bin = t.bin) then run.flag + case when run.bin = t.bin then 2 else 0 end end, case when t.bin is not null and (run.bin is null or run.bin = t.bin) then run.size + t.n end from run join t on t.read_id = run.read_id and t.i = run.i + 1)
select read_id, cast(seg as bigint) as segment, out_flag as flag, out_n as n_hits from run where out_n is not null union all select read_id, cast(seg + case when out_n is not null then 1 else 0 end as bigint), 1, size from run r where size > 1 and i = (select max(i) from t where t.read_id = r.read_id)""".replace("with o as", "with recursive o as")),
    "link_votes": (lambda s, d: H.link_votes(H.hit_pairs(hits(s, d)), nodes(s, d), 20.0), f"with v as (select *, least(a_rgt - b_lft, b_rgt - a_lft) as ov, least(0.5 * least(a_rgt - a_lft, b_rgt - b_lft), 300) as most from {VECTORS_SQL} where a_node_id <> b_node_id and a_node_id in (select node_id from {NODES_SQL} where cov >= 20) and b_node_id in (select node_id from {NODES_SQL} where cov >= 20)), k as (select *, ((a_ref_end - a_ref_start) * (b_ref_end - b_ref_start)) // ((a_ref_end - a_ref_start) + (b_ref_end - b_ref_start)) as sc, row_number() over (partition by a_node_id, b_node_id, dir order by abs(ov), read_id, a_hit_seq) as i from v where ov <= most) select a_node_id as a, b_node_id as b, dir, cast(sum(sc) as bigint) as score, count(*) as n, max(case when i = 1 then mag end) as mag, max(case when i = 1 then abs(ov) end) as gap from k group by 1, 2, 3"),
    "circular_votes": (lambda s, d: H.circular_votes(H.hit_pairs(hits(s, d).withColumn("node_id", c("node_id") % 5)), nodes(s, d)), f"with h as (select read_id, read_len, hit_seq, node_id % 5 as node_id, lft, rgt, ref_start, ref_end, strand from {HITS_SQL}), v as (select *, case when a_strand then g else -g end as mag, case when a_strand = b_strand then 1 else -1 end as dir from (select *, cast(trunc((b_lft - a_lft) * ((abs(a_ref_end - a_ref_start) + abs(b_ref_end - b_ref_start))::double / (abs(a_rgt - a_lft) + abs(b_rgt - b_lft)))) as bigint) + (case when a_strand then a_ref_start else -a_ref_start end) - (case when b_strand then b_ref_start else -b_ref_start end) as g from {PAIRS_SQL.replace(HITS_SQL, 'h')})), x as (select v.*, n.len, a_node_id = b_node_id and dir > 0 and abs(mag)::double / n.len < 1.1 and abs(mag)::double / n.len > 0.9 and read_len < 1.1 * n.len as circle from v join {NODES_SQL} n on a_node_id = n.node_id), e as (select a_node_id as node_id, case when (a_rgt - a_lft + b_rgt - b_lft)::double / read_len > 0.8 then 1 else 0 end as x from x where circle union all select a_node_id, -1 from x where not circle union all select b_node_id, -1 from x where not circle) select node_id, cast(sum(x) - 1 as bigint) as votes, sum(x) - 1 > 1 as circular from e group by 1"),
    "repeat_contigs": (lambda s, d: H.repeat_contigs(nodes(s, d), read(s, d, "lineitem").select(c("l_partkey").alias("a"), (c("l_partkey") + c("l_suppkey") % 7).alias("b"), (c("l_quantity") * 100).cast("long").alias("mag"), F.when(c("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("dir")), 70.0), f"with l as (select l_partkey as a, l_partkey + l_suppkey % 7 as b, cast(l_quantity * 100 as bigint) as mag, case when l_linenumber % 2 = 0 then 1 else -1 end as dir from lineitem), g as (select l.a, l.b, greatest((case when dir > 0 then mag else mag - y.len end) - x.len, -(case when dir > 0 then mag + y.len else mag end)) as gap from l join {NODES_SQL} x on l.a = x.node_id join {NODES_SQL} y on l.b = y.node_id where a <> b), e as (select a as node_id, b as other, gap from g where gap < 0 union all select b, a, gap from g where gap < 0), k as (select e.node_id, max(gap) as gap from e join {NODES_SQL} o on e.other = o.node_id where o.len > 7500 or o.cov < 1.3 * 70 group by 1) select n.node_id, case when len < 300 or cov < 0.3 * 70 then true when len > 7500 or cov < 1.3 * 70 then false when cov > 1.5 * 70 then true when gap > -0.25 * len then true else len < 600 end as repeat from {NODES_SQL} n left join k using (node_id)"),
    "covered_bases": (lambda s, d: H.covered(hits(s, d)), f"with p as (select distinct node_id, unnest(generate_series(ref_start, ref_end)) as p from {HITS_SQL}) select node_id, count(*) as covered from p group by 1"),
    "unaligned_stretches": (_unaligned, f"with r as (select read_id, lft, rgt, read_len, max(rgt) over (partition by read_id order by lft, rgt) as reach, lead(lft) over (partition by read_id order by lft, rgt) as nxt, row_number() over (partition by read_id order by lft, rgt) as i from {HITS_SQL}), g as (select read_id, cast(1 as bigint) as first, lft - 1 as last from r where i = 1 union all select read_id, reach + 1, coalesce(nxt, read_len + 1) - 1 from r) select read_id, first, last from g where last >= first"),
    "dense_ids": (lambda s, d: H.dense_ids(hits(s, d), "node_id", c("read_id") * 100 + c("hit_seq")), f"select node_id, cast(row_number() over (order by min(read_id * 100 + hit_seq), node_id) as bigint) as dense_id from {HITS_SQL} group by node_id"),
    "longest_hits": (lambda s, d: H.ranked(hits(s, d).withColumn("size", c("rgt") - c("lft")), "node_id", c("size"), ["read_id", "hit_seq"], 3).select("node_id", "read_id", "hit_seq", c("rank").cast("long").alias("rank")), f"select node_id, read_id, hit_seq, rank from (select *, row_number() over (partition by node_id order by rgt - lft desc, read_id, hit_seq) as rank from {HITS_SQL}) where rank <= 3"),
    "kept_paths": (lambda s, d: H.kept_paths(_paths(s, d).withColumnRenamed("segment", "start"), c("start") % 1000, 127).select("start", "path", c("rank").cast("long").alias("rank")), f"select start, path, rank from (select segment as start, path, deviation, row_number() over w as rank, first_value(abs(deviation)) over w as b from {PATHS_SQL} window w as (partition by segment order by abs(deviation), path)) where abs(deviation) <= b + abs(start % 1000 + 127) * 0.25 and rank <= 100"),
    "read_counters": (lambda s, d: hits(s, d).groupBy("read_id").agg(F.max("read_len").alias("len")).agg(F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases")), f"select count(*) as reads, cast(sum(len) as bigint) as bases from (select read_id, max(read_len) as len from {HITS_SQL} group by 1)"),
    "multiplicity_sums": (_multiplicity, f"with x as (select read_id, node_id % 5 as bin, count(*) as n from {HITS_SQL} group by 1, 2) select read_id, cast(sum(n) as bigint) as total, count(*) as bins, cast(sum(n * (bin + 1) * 10) as bigint) as coverage from x group by 1"),
    "occurrences": (lambda s, d: hits(s, d).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("read_id").alias("reads")), f"select node_id, count(*) as n, count(distinct read_id) as reads from {HITS_SQL} group by 1"),
    "base_scores": (_base_scores, f"with f as (select k % 50 as k, fstart, fend, mine from {FEATURES_SQL}), m as (select distinct k, unnest(generate_series(fstart, fend)) as p from f where mine), o as (select distinct k, unnest(generate_series(fstart, fend)) as p from f where not mine), b as (select coalesce(m.k, o.k) as k, count(*) filter (where m.k is not null and o.k is not null) as tp, count(*) filter (where o.k is null) as fp, count(*) filter (where m.k is null) as fn from m full join o on m.k = o.k and m.p = o.p group by 1), t as (select *, 101000 - tp - fp - fn as tn, tp::double / nullif(tp + fp, 0) as p, tp::double / nullif(tp + fn, 0) as r from b) select k, tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f_score, round(tn::double / nullif(tn + fp, 0), 6) as specificity, round((tp + tn)::double / (tp + tn + fp + fn), 6) as accuracy from t"),
    "match_scores": (_match_scores, f"with f as (select id, k % 50 as k, fstart, fend, mine from {FEATURES_SQL}), m as (select a.id, b.id as other from f a join f b on a.k = b.k and a.mine and not b.mine and a.fend - b.fstart >= 20 and b.fend - a.fstart >= 20), t as (select (select count(distinct id) from m) as tp, (select count(distinct other) from m) as recalled, (select count(*) from f where mine) as n_mine, (select count(*) from f where not mine) as n_model) select tp, recalled, n_mine, n_model, round(tp::double / n_mine, 6) as precision, round(recalled::double / n_model, 6) as recall, round(2 * (tp::double / n_mine) * (recalled::double / n_model) / nullif(tp::double / n_mine + recalled::double / n_model, 0), 6) as f_score from t"),
    "features_combined": (lambda s, d: E.combined(features(s, d).where("mine"), features(s, d).where("not mine")).select("k", "id", c("rank").cast("long").alias("rank")), f"select k, id, row_number() over (partition by k order by fstart, fend desc, id) as rank from {FEATURES_SQL}"),
    "feature_neighbours": (lambda s, d: E.neighbours(features(s, d)), f"select k, id, lead(id) over w as next_id, lead(fstart) over w - fend as distance from {FEATURES_SQL} window w as (partition by k order by fstart, fend desc, id)"),
    "lifted_features": (_lifted, f"""with x as (select id, fstart, fend, k % 2 = 0 as back, score, greatest(fstart, 20000) as s, least(fend, 70000) as e from {FEATURES_SQL}) select id, case when back then 101000 - e + 1 else s end as "start", case when back then 101000 - s + 1 else e end as "end", case when back then '-' else '+' end as strand, round(score * ((e - s + 1)::double / (fend - fstart + 1)), 6) as score from x where e >= s and (e - s + 1)::double / (fend - fstart + 1) > 0.9"""),
    "gene_likelihood": (_genes, f"with g as (select kind as species, k % 40 as gene, sum(fend - fstart) as len, count(*) as n from {FEATURES_SQL} group by 1, 2) select species, gene, round((len + 200)::double / (sum(len) over (partition by species) + sum(n) over (partition by species) * 200), 9) as likelihood from g"),
    "canonical_genes": (_canonical, f"with a as (select k % 97 as gene, cast(sum(fend - fstart + 1) as bigint) as bases from {FEATURES_SQL} where mine group by 1), b as (select k % 97 as gene, count(*) as n from {FEATURES_SQL} where not mine group by 1) select gene, bases, n from a join b using (gene) where bases % 3 = 0"),
    "bridge_steps": (_steps, f"select bridge, dest, dir, mag, score from {STEPS_SQL}"),
    "bridge_reversed": (lambda s, d: B.reversed_bridge(_steps(s, d).withColumns({"span_mag": c("dest") % 5000, "span_dir": F.when(c("dest") % 2 == 0, 1).otherwise(-1)})).select("bridge", "dest", "mag", c("dir").cast("long").alias("dir"), "score"), f"with x as (select *, dest % 5000 as sm, case when dest % 2 = 0 then 1 else -1 end as sd from {STEPS_SQL}) select bridge, dest, case when sd > 0 then -sm else sm end + sd * mag as mag, cast(dir * sd as bigint) as dir, score from x"),
    "end_anchors": (lambda s, d: B.end_anchor(_steps(s, d), c("dest") % 2 == 0), f"select bridge, dest from {STEPS_SQL} where dest % 2 = 0 qualify row_number() over (partition by bridge order by abs(mag) desc, dest) = 1"),
    "best_midpoints": (lambda s, d: B.best_midpoint(_steps(s, d), F.lit(200), F.lit(2500)), f"select bridge, dest from {STEPS_SQL} where abs(mag) > 200 and abs(mag) < 2500 qualify row_number() over (partition by bridge order by score desc, abs(mag), dest) = 1"),
    "connectable_steps": (lambda s, d: B.connectable(_steps(s, d), _steps(s, d)), f"with t as {STEPS_SQL} select bridge, dest, mag, dir, score from t where score >= 180 or cast(dest as varchar) || case when dir > 0 then 'i' else 'o' end in (select bridge from t)"),
    "completion_levels": (_levels, f"with x as (select node_id, size % 3 as anchors, len % 4 as segments, least(len % 4, node_id % 5) as conn, least(len % 4, node_id % 3) as single from {NODES_SQL}) select node_id, cast(case when anchors = 2 and segments > 0 and single = segments then 4 when anchors = 2 and segments > 0 and conn = segments then 3 else anchors end as bigint) as level from x"),
    "likely_paths": (_likely, f"with b as (select *, min(abs(deviation)) over (partition by segment) as m from {PATHS_SQL}), k as (select *, max(likelihood) over (partition by segment) as l from b where abs(deviation) <= m + case when segment % 2 = 0 then 0 else 300 end) select segment, path, deviation from k where segment % 2 <> 0 or likelihood >= l"),
    "voted_paths": (_voted, f"with p as (select path, min(segment) as segment, min(deviation) as deviation from {PATHS_SQL} group by 1), v as (select path, sum(case when deviation > -400 then deviation else 300 end) as more from {PATHS_SQL} group by 1) select segment, path, cast(deviation + more as bigint) as deviation from p join v using (path)"),
    "best_path_combinations": (lambda s, d: B.best_paths(_paths(s, d).where("path % 3 = 0")).select("bridge", F.round("likelihood", 4).alias("likelihood"), F.round("log_paths", 6).alias("log_paths")), f"with p as (select bridge, segment, max(likelihood) as l, count(*) as n from {PATHS_SQL} where path % 3 = 0 group by 1, 2) select bridge, round(sum(l), 4) as likelihood, round(sum(ln(n)), 6) as log_paths from p group by 1"),
    "consensus_gate": (lambda s, d: B.consensus_gate(hits(s, d).select((c("node_id") % 300).alias("bridge"), "read_id")), f"select node_id % 300 as bridge, count(distinct read_id) as reads from {HITS_SQL} group by 1 having count(distinct read_id) >= 20"),
    "bridge_conflicts": (lambda s, d: B.conflicting(nodes(s, d).select(c("node_id").alias("bridge"), (c("node_id") % 50).alias("n0"), (c("len") % 60 + 50).alias("n1"), (c("size") % 5).alias("level"))), f"with b as (select node_id as bridge, node_id % 50 as n0, len % 60 + 50 as n1, size % 5 as level from {NODES_SQL}) select distinct x.bridge from b x join b y on x.bridge <> y.bridge and y.level >= 3 and (x.n0 in (y.n0, y.n1) or x.n1 in (y.n0, y.n1))"),
    "trimmed_scaffolds": (lambda s, d: B.trimmed(_scaffolds(s, d), c("node_id") % 3 == 0).select("scaffold", "pos"), f"select scaffold, pos from (select *, min(case when node_id % 3 <> 0 then pos end) over (partition by scaffold) as a, max(case when node_id % 3 <> 0 then pos end) over (partition by scaffold) as z from {SCAFFOLDS_SQL}) where pos between a and z"),
    "scaffold_lengths": (lambda s, d: B.scaffold_lengths(_scaffolds(s, d)), f"select scaffold, cast(coalesce(max(abs(circle)), max_by(case when dir > 0 then mag + len else mag end, pos) - min_by(case when dir > 0 then mag else mag - len end, pos)) as bigint) as length from {SCAFFOLDS_SQL} group by 1"),
}
