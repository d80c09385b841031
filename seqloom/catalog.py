"""All queries by name, each with the SQL that states the same rows. TESTDATA tables stand for contigs (part) and hits (lineitem)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import cigar
from seqloom.functions import columns as C
from seqloom.operators import relational as R
from seqloom.plans import binning_queries, format_queries, graph_queries, hit_queries, path_queries, scalar_queries

FLAGSHIP = "assembly_report"


def contigs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 1000 + F.col("p_partkey") % 997).cast("long").alias("len"), F.col("p_retailprice").alias("cov"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))


def hits(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    start = c("l_linenumber") * 300 + c("l_partkey") % 500
    return s.read.parquet(f"{d}/lineitem.parquet").select(c("l_orderkey").alias("read_id"), c("l_linenumber").cast("long").alias("hit_seq"), c("l_partkey").alias("node_id"), start.cast("long").alias("left"), (start + (c("l_quantity") * 30).cast("long")).cast("long").alias("right"), (c("l_suppkey") % 61).cast("long").alias("mapq"), (c("l_quantity") * 30).cast("long").alias("score"))


def in_order(h: DataFrame) -> DataFrame:
    """Hits in a total order: the table has several hits of one line number in a read."""
    return h.withColumn("hit_seq", F.col("hit_seq") * 10_000_000_000 + F.col("node_id") * 10_000 + F.col("score"))


CONTIGS = "(select p_partkey as id, cast(p_size * 1000 + p_partkey % 997 as bigint) as len, p_retailprice as cov, p_brand as brand, p_name as name from part)"
HITS = '(select l_orderkey as read_id, cast(l_linenumber as bigint) as hit_seq, l_partkey as node_id, cast(l_linenumber * 300 + l_partkey % 500 as bigint) as "left", cast(l_linenumber * 300 + l_partkey % 500 + cast(l_quantity * 30 as bigint) as bigint) as "right", cast(l_suppkey % 61 as bigint) as mapq, cast(l_quantity * 30 as bigint) as score from lineitem)'
ORDERED = f"(select read_id, hit_seq * 10000000000 + node_id * 10000 + score as hit_seq, node_id, score from {HITS})"
#: All rows of the table, split into mine (even l_orderkey) and the model (odd).
EVERY_FEATURE = '(select (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey as id, l_suppkey as k, cast((l_partkey * 37) % 50000 + 1 as bigint) as "start", cast((l_partkey * 37) % 50000 + l_quantity * 20 as bigint) as "end" from lineitem where l_orderkey % 2 = {n})'


def every_feature(s: SparkSession, d: str, n: int) -> DataFrame:
    c = F.col
    return s.read.parquet(f"{d}/lineitem.parquet").where(c("l_orderkey") % 2 == n).select(((c("l_orderkey") * 8 + c("l_linenumber")) * 100_000_000 + c("l_partkey")).alias("id"), c("l_suppkey").alias("k"), ((c("l_partkey") * 37) % 50000 + 1).cast("long").alias("start"), ((c("l_partkey") * 37) % 50000 + c("l_quantity") * 20).cast("long").alias("end"))


def _stats(s, d):
    p = contigs(s, d)
    kc, n = (F.col("cov") * 100).cast("long"), F.col("len")
    r = lambda x: F.round(x, 6)
    return p.select("id", C.approx_compare(F.col("cov"), F.lit(1200.0)).alias("cmp"), r(C.poisson_distance(F.col("cov"), F.lit(1000.0))).alias("kl"), r(C.read_coverage(kc, n)).alias("read_cov"), r(C.a_statistic(n, F.col("cov"), F.lit(900.0))).alias("astat"))


def _vectors(s, d):
    h = hits(s, d)
    m, e = F.col("score"), F.when(F.col("hit_seq") % 2 == 0, 1).otherwise(-1).cast("long")
    m2, e2 = F.col("mapq") * 10, F.when(F.col("node_id") % 3 == 0, -1).otherwise(1).cast("long")
    cm, ce = C.compose(m, e, m2, e2)
    return h.select("read_id", "hit_seq", C.reverse_vector(m, e)[0].alias("rev"), cm.alias("mag"), ce.alias("dir"), C.tip_distance(m, e, F.lit(1000), F.lit(500)).cast("long").alias("tip"))


def _cigar(s, d):
    h = hits(s, d)
    text = F.concat((F.col("mapq") + 1).cast("string"), F.lit("S"), F.col("score").cast("string"), F.lit("M2I3D"), F.col("hit_seq").cast("string"), F.lit("M4H"))
    x = cigar.cigar_span(text, F.col("node_id") % 2 == 0)
    return h.select("read_id", "hit_seq", x["start"].alias("s"), x["end"].alias("e"), x["length"].alias("n"))


def _margin(s, d):
    c = F.col
    read_len, contig_len = 2500 + c("score"), 600 + (c("node_id") % 5) * 800
    return hits(s, d).select("read_id", "hit_seq", C.useful_margin(c("left"), c("right"), read_len, c("left") % 900 + 1, c("left") % 900 + c("score") % 500 + 1, contig_len, c("mapq"), c("hit_seq") % 6 != 0).alias("useful"))


def _nodes(s, d):
    a, b = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    return s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", C.canonical_edge(a, F.col("l_linenumber") % 2 == 0, b, F.col("l_orderkey") % 2 == 0).alias("edge"))


def _bag(s, d):
    h = hits(s, d)
    one = lambda n: h.where(F.col("hit_seq") <= n).groupBy("read_id", (F.col("node_id") % 3).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return R.bag_subtract(one(4), h.where("hit_seq = 2").groupBy("read_id", (F.col("node_id") % 3).alias("bin")).agg(F.count(F.lit(1)).alias("n")), "read_id", "bin", "n")


def _aligned(s, d):
    digits = F.lpad((F.col("p_partkey") * 7919 % 100_000_000).cast("string"), 8, "0")
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("brand"), F.translate(digits, "0123456789", "ACGTR-ACGT").alias("row"))


def _every_link(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("a"), F.col("l_orderkey").alias("b"))


def _planned() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return scalar_queries.QUERIES | hit_queries.QUERIES | graph_queries.QUERIES | format_queries.QUERIES | path_queries.QUERIES | binning_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _own() | {name: query for name, (query, _) in _planned().items()}


def oracle_sql() -> dict[str, str]:
    return _own_sql() | {name: sql for name, (_, sql) in _planned().items() if sql}


def _own() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    shares = {"n50": 0.5, "n75": 0.75}
    return {
        "range_groups": lambda s, d: R.range_groups(hits(s, d), "read_id", "left", "right").select("read_id", "hit_seq", "group_id"),
        "nxx": lambda s, d: R.nxx(contigs(s, d), shares),
        "nxx_by_bin": lambda s, d: R.nxx(contigs(s, d), shares, ["brand"]),
        "coverage_statistics": _stats,
        "vector_algebra": _vectors,
        "cigar_span": _cigar,
        "useful_margin": _margin,
        "canonical_edges": _nodes,
        "reverse_complement": lambda s, d: contigs(s, d).select("id", C.reverse_complement(F.upper("name")).alias("rc")),
        "pair_links": lambda s, d: R.pair_links(in_order(hits(s, d))),
        "bin_coverage": lambda s, d: R.weighted_mean(contigs(s, d), ["brand"], "cov", "len", "est").select("brand", F.round("est", 6).alias("est_cov")),
        "coverage_histogram": lambda s, d: R.histogram(contigs(s, d), F.col("cov"), 900.0, 1900.0, 20),
        "entropy": lambda s, d: R.entropy(contigs(s, d).groupBy("brand").agg(F.count(F.lit(1)).alias("n")), "n").select(F.round("entropy_bits", 9).alias("entropy_bits")),
        "coverage_clusters": lambda s, d: R.line_clusters(contigs(s, d), ["brand"], "cov").select("id", "cluster"),
        "bag_subtract": _bag,
        "previous_unique": lambda s, d: R.previous_unique(in_order(hits(s, d)), F.col("node_id") % 3 == 0).select("read_id", "hit_seq", "previous_unique"),
        "ng50": lambda s, d: R.ng50(contigs(s, d), 2_000_001),
        "contig_counts": lambda s, d: contigs(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 7 == 0).alias("circular"), F.max("len").alias("max_len")),
        "coverage_moments": lambda s, d: contigs(s, d).groupBy("brand").agg(F.round(F.avg("cov"), 4).alias("mean"), F.round(F.stddev_pop("cov"), 4).alias("sd")),
        "dominant_bin": lambda s, d: R.dominant(hits(s, d).withColumn("bin", F.col("node_id") % 5), "read_id", "bin", "score"),
        "spelling_offsets": lambda s, d: R.spelling_offsets(in_order(hits(s, d)), "read_id", "score").select("read_id", "hit_seq", "offset"),
        "nearest_markers": lambda s, d: R.nearest_markers(in_order(hits(s, d)), F.col("node_id") % 3 == 0).select("read_id", "hit_seq", "before", "after"),
        "anchor_pairs": lambda s, d: R.anchor_pairs(in_order(hits(s, d)), F.col("node_id") % 2 == 0),
        "gap_statistics": lambda s, d: R.gap_statistics(hits(s, d)),
        "copies_histogram": lambda s, d: R.copies_histogram(hits(s, d)),
        "feature_overlaps": lambda s, d: R.overlap_join(every_feature(s, d, 0), every_feature(s, d, 1), "k", 100),
        "feature_match": lambda s, d: R.feature_match(every_feature(s, d, 0), every_feature(s, d, 1), "k", 100),
        "base_confusion": lambda s, d: R.base_confusion(every_feature(s, d, 0), every_feature(s, d, 1), "k"),
        "reciprocal_links": lambda s, d: R.reciprocal_links(_every_link(s, d)),
        "column_consensus": lambda s, d: R.column_consensus(_aligned(s, d), "brand", "row"),
    }


def _own_sql() -> dict[str, str]:
    nxx = "with r as (select {by} len, sum(len) over ({part} order by len desc) as cum, sum(len) over ({part}) as total from " + CONTIGS + ") select {by} max(case when cum >= 0.5 * total then len end) as n50, max(case when cum >= 0.75 * total then len end) as n75 from r {group}"
    e, e2 = "(case when hit_seq % 2 = 0 then 1 else -1 end)", "(case when node_id % 3 = 0 then -1 else 1 end)"
    return {
        "range_groups": f"""with o as (select *, max("right") over (partition by read_id order by "left", "right" desc, hit_seq rows between unbounded preceding and 1 preceding) as so_far from {HITS}), f as (select *, case when so_far - "left" > 254 or "right" <= so_far then 0 else 1 end as n from o) select read_id, hit_seq, cast(sum(n) over (partition by read_id order by "left", "right" desc, hit_seq) as bigint) as group_id from f""",
        "nxx": nxx.format(by="", part="", group=""),
        "nxx_by_bin": nxx.format(by="brand,", part="partition by brand", group="group by brand"),
        "coverage_statistics": f"select id, cast(case when abs(cov - 1200.0) / greatest(abs(cov), 1200.0) <= 0.25 then 0 when cov > 1200 then 1 else -1 end as int) as cmp, round(0.5 * (cov - 1000.0) * (ln(cov) - ln(1000.0)), 6) as kl, round(cast(trunc(cov * 100) as double) / (len - 127) * 300 / 174, 6) as read_cov, round((len * 900.0::double / 300 - ln(2) * cov * len / 300) * log10(exp(1)), 6) as astat from {CONTIGS}",
        "vector_algebra": f"select read_id, hit_seq, case when {e} > 0 then -score else score end as rev, mapq * 10 + {e2} * score as mag, cast({e} * {e2} as bigint) as dir, greatest((case when {e} > 0 then score else score - 500 end) - 1000, -(case when {e} > 0 then score + 500 else score end)) as tip from {HITS}",
        "cigar_span": f"with x as (select read_id, hit_seq, node_id, mapq + 1 as head, score + 2 + hit_seq as used, mapq + 1 + score + 2 + hit_seq + 4 as n from {HITS}) select read_id, hit_seq, case when node_id % 2 = 0 then head + 1 else n - head end as s, case when node_id % 2 = 0 then head + used else n - head - used + 1 end as e, n from x",
        "useful_margin": f"""with x as (select read_id, hit_seq, "left" - 1 as rl, 2500 + score - "right" as rr, "left" % 900 as tl, 600 + (node_id % 5) * 800 - ("left" % 900 + score % 500 + 1) as tr, mapq, cast(trunc(least(300, 0.25 * (600 + (node_id % 5) * 800))) as bigint) as t from {HITS}) select read_id, hit_seq, (rl < t or tl < t) and (rr < t or tr < t) and least(tl, tr) < t and hit_seq % 6 <> 0 and mapq >= 10 as useful from x""",
        "canonical_edges": "with x as (select l_orderkey, l_linenumber, cast(l_partkey as varchar) as a, l_linenumber % 2 = 0 as ao, cast(l_suppkey as varchar) as b, l_orderkey % 2 = 0 as bo from lineitem) select l_orderkey, l_linenumber, case when a = b then (case when ao <> bo then a || '+,' || a || '+' when ao then a || '+,' || a || '-' else a || '-,' || a || '+' end) when a < b then a || (case when ao then '+' else '-' end) || ',' || b || (case when bo then '-' else '+' end) else b || (case when bo then '+' else '-' end) || ',' || a || (case when ao then '-' else '+' end) end as edge from x",
        "reverse_complement": f"select id, reverse(translate(upper(name), 'ACGT', 'TGCA')) as rc from {CONTIGS}",
        "pair_links": f"select least(x.node_id, y.node_id) as a, greatest(x.node_id, y.node_id) as b, cast(sum(least(x.score, y.score)) as bigint) as score, count(*) as n from {ORDERED} x join {ORDERED} y on x.read_id = y.read_id and x.hit_seq < y.hit_seq and x.node_id <> y.node_id group by 1, 2",
        "bin_coverage": f"select brand, round(sum(cov * len) / sum(len), 6) as est_cov from {CONTIGS} group by brand",
        "coverage_histogram": f"select cast(least(19, greatest(0, floor((cov - 900) / 50))) as int) as bin, count(*) as n from {CONTIGS} group by 1",
        "entropy": f"with c as (select brand, count(*) as n from {CONTIGS} group by brand), t as (select sum(n) as t from c) select round(sum(-(n / t.t) * log2(n / t.t)), 9) as entropy_bits from c, t",
        "coverage_clusters": f"with g as (select id, brand, cov, lag(cov) over (partition by brand order by cov, id) as p from {CONTIGS}) select id, cast(sum(case when 0.5 * (p - cov) * (ln(p) - ln(cov)) <= 3 then 0 else 1 end) over (partition by brand order by cov, id) as bigint) as cluster from g",
        "bag_subtract": f"with l as (select read_id, node_id % 3 as bin, count(*) as n from {HITS} where hit_seq <= 4 group by 1, 2), r as (select read_id, node_id % 3 as bin, count(*) as n from {HITS} where hit_seq = 2 group by 1, 2), d as (select read_id, bin, cast(sum(n) as bigint) as n from (select * from l union all select read_id, bin, -n from r) group by 1, 2) select * from d where n > 0 and read_id not in (select read_id from d where n < 0)",
        "previous_unique": f"select read_id, hit_seq, last_value(case when node_id % 3 = 0 then node_id end ignore nulls) over (partition by read_id order by hit_seq rows between unbounded preceding and 1 preceding) as previous_unique from {ORDERED}",
        "ng50": f"with r as (select len, sum(len) over (order by len desc) as cum from {CONTIGS}) select max(case when cum >= 1000000 then len end) as ng50 from r",
        "contig_counts": f"select count(*) as n, count(*) filter (where id % 7 = 0) as circular, max(len) as max_len from {CONTIGS}",
        "coverage_moments": f"select brand, round(avg(cov), 4) as mean, round(stddev_pop(cov), 4) as sd from {CONTIGS} group by brand",
        "dominant_bin": f"with t as (select read_id, node_id % 5 as bin, cast(sum(score) as bigint) as weight from {HITS} group by 1, 2) select read_id, bin, weight from t qualify row_number() over (partition by read_id order by weight desc, bin) = 1",
        "spelling_offsets": f'select read_id, hit_seq, cast(coalesce(sum(score - 127) over (partition by read_id order by hit_seq rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from {ORDERED}',
        "nearest_markers": f'select read_id, hit_seq, last_value(case when node_id % 3 = 0 then node_id end ignore nulls) over (partition by read_id order by hit_seq rows between unbounded preceding and 1 preceding) as "before", first_value(case when node_id % 3 = 0 then node_id end ignore nulls) over (partition by read_id order by hit_seq rows between 1 following and unbounded following) as "after" from {ORDERED}',
        "anchor_pairs": f"with x as (select read_id, node_id as a, lead(node_id) over (partition by read_id order by hit_seq) as b from {ORDERED} where node_id % 2 = 0) select read_id, a, b from x where b is not null",
        "gap_statistics": f"""with x as (select "left" - max("right") over (partition by read_id order by "left", "right" rows between unbounded preceding and 1 preceding) as gap from {HITS}) select count(*) as gaps, max(gap) as max_gap from x where gap > 0""",
        "copies_histogram": f"with r as (select read_id, count(*) as k from {HITS} group by 1) select k, count(*) as reads, k * count(*) as units from r group by k",
        "feature_overlaps": f"""select a.id, b.id as model_id from {EVERY_FEATURE.format(n=0)} a join {EVERY_FEATURE.format(n=1)} b on a.k = b.k and a."end" - b."start" >= 100 and b."end" - a."start" >= 100""",
        "feature_match": f"""with a as {EVERY_FEATURE.format(n=0)}, b as {EVERY_FEATURE.format(n=1)}, m as (select a.id, b.id as model_id from a join b on a.k = b.k and a."end" - b."start" >= 100 and b."end" - a."start" >= 100) select (select count(distinct id) from m) as tp, (select count(distinct model_id) from m) as recalled, (select count(*) from a) as n_mine, (select count(*) from b) as n_model""",
        "base_confusion": f"""with m as (select distinct k, unnest(generate_series("start", "end")) as p from {EVERY_FEATURE.format(n=0)}), o as (select distinct k, unnest(generate_series("start", "end")) as p from {EVERY_FEATURE.format(n=1)}) select coalesce(m.k, o.k) as k, count(*) filter (where m.k is not null and o.k is not null) as tp, count(*) filter (where o.k is null) as fp, count(*) filter (where m.k is null) as fn from m full join o on m.k = o.k and m.p = o.p group by 1""",
        "reciprocal_links": "with l as (select distinct l_partkey as a, l_orderkey as b from lineitem) select x.a, x.b from l x join l y on x.a = y.b and x.b = y.a where x.a < x.b",
        "column_consensus": "with t as (select p_brand as brand, translate(translate(lpad(cast(p_partkey * 7919 % 100000000 as varchar), 8, '0'), '0123456789', 'ACGTR-ACGT'), 'R', 'N') as x from part), c as (select brand, g.pos, substr(x, cast(g.pos as int), 1) as letter from t, generate_series(1, 8) as g(pos)), v as (select brand, pos, letter from c group by 1, 2, 3 qualify row_number() over (partition by brand, pos order by count(*) desc, instr('ACGTN-', letter)) = 1) select brand, coalesce(string_agg(letter, '' order by pos) filter (where letter <> '-'), '') as consensus from v group by brand",
    }
