"""Scalar functions, sequences and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import cigar as G
from seqloom.functions import columns as C
from seqloom.functions import scalars as S
from seqloom.plans.adapters import HITS_SQL, NODES_SQL, SEQS_SQL, hits, nodes, read, seqs

c = F.col
r6 = lambda x: F.round(x, 6)
#: CIGAR texts of hits: no, one or two clips in front, and none, one or two behind.
CIGAR = "concat(case when hit_seq % 3 = 0 then '' when hit_seq % 3 = 1 then concat(cast(mapq as string), 'S') else concat('3H', cast(mapq as string), 'S') end, cast(300 + supp as string), 'M2I3D', cast(hit_seq as string), case when supp % 2 = 0 then '=4X' else '=7N4M' end, case when node_id % 4 = 0 then '' when node_id % 4 = 1 then '6S' else '6S5H' end)"
CIGAR_SQL = CIGAR.replace("as string", "as varchar")
CLIP = "(case when hit_seq % 3 = 0 then 0 when hit_seq % 3 = 1 then mapq else mapq + 3 end)"
BODY = "(300 + supp + 2 + hit_seq + 4)"
TAIL = "(case when node_id % 4 = 0 then 0 when node_id % 4 = 1 then 6 else 11 end)"
#: Where the last clip begins: after the body, or after the first of two clips.
LAST = f"({CLIP} + {BODY} + case when node_id % 4 in (2, 3) then 6 else 0 end)"


def _math(s, d):
    n = nodes(s, d)
    m, v = F.lit(80.0), c("size") % 3
    return n.select("node_id", r6(S.normalised_coverage(c("cov"), m)).alias("norm"), r6(S.real_coverage(c("cov"), m)).alias("real"), S.output_kmer_count(c("cov")).alias("kc"), r6(S.node_log_odds(c("cov"), F.lit(60.0), c("len"), F.lit(10), v)).alias("odds"), S.support_class(c("len")).cast("int").alias("qc"), r6(S.error_probability(c("size"))).alias("p"), r6(S.phred(c("cov") / 1000)).alias("phred"), S.digits(c("len")).cast("int").alias("digits"), r6(F.log2("cov")).alias("log2"), r6(F.pow(F.lit(2.0), c("size") / 10)).alias("exp2"), r6(S.colour_scale(c("len"))).alias("node_size"))


def _scaled(s, d):
    return nodes(s, d).select("node_id", r6(S.scaled(c("cov"), Window.partitionBy("brand"), 0.0, 10.0)).alias("scaled"))


def _product(s, d):
    a = read(s, d, "lineitem").groupBy((c("l_suppkey") % 7).alias("i"), (c("l_partkey") % 5).alias("j")).agg(F.sum(c("l_quantity").cast("long")).alias("x"))
    b = read(s, d, "lineitem").groupBy((c("l_partkey") % 5).alias("j"), (c("l_orderkey") % 4).alias("k")).agg(F.count(F.lit(1)).alias("y"))
    return a.join(b, "j").groupBy("i", "k").agg(F.sum(c("x") * c("y")).alias("v"))


def _sequences(s, d):
    q = seqs(s, d)
    nxt = F.reverse("seq")
    return q.select("id", S.flanked(F.left("seq", F.lit(40)), F.lit(3), F.lit(9), 5).alias("flank"), S.first_mismatch(F.left("seq", F.lit(50)), F.left(nxt, F.lit(50))).alias("mismatch"), S.suffix_prefix(c("seq"), F.concat(F.right("seq", F.lit(7)), F.lit("A")), 20).alias("overlap"), S.oriented_read(F.left("seq", F.lit(30)), (c("id") % 32).cast("int")).alias("oriented"), F.concat(F.left("seq", F.lit(5)), S.n_run(c("id") % 4), F.right("seq", F.lit(5))).alias("joined"))


def _translated(s, d):
    return seqs(s, d).select("id", S.translated(c("seq")).alias("protein"))


def _signal(s, d):
    return seqs(s, d).select("id", F.aggregate(S.signal_codes(c("seq")), F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.size(S.signal_codes(c("seq"))).cast("long").alias("n"))


def _edge_text(s, d):
    edge = F.concat(c("node_id").cast("string"), F.when(c("strand"), "+").otherwise("-"), F.lit(","), c("read_id").cast("string"), F.when(c("hit_seq") % 2 == 0, "+").otherwise("-"))
    x = hits(s, d).select("read_id", "hit_seq", edge.alias("edge"))
    return x.select("read_id", "hit_seq", S.edge_ends(c("edge"))["a"].alias("a"), S.edge_ends(c("edge"))["b_out"].alias("b_out"), F.array_join(S.bridge_keys(c("edge")), "|").alias("bridge_keys"), S.link_key(c("read_id"), c("hit_seq"), F.lit(0)).alias("link"), S.feature_text(F.lit("hit"), F.lit(1), c("hit_seq"), c("edge"), F.lit("+"), F.lit("p"), F.lit(0)).alias("feature"))


def _useful(s, d):
    h = hits(s, d).join(nodes(s, d).select("node_id", "len"), "node_id")
    rs, re = F.when(c("strand"), c("lft")).otherwise(c("rgt")), F.when(c("strand"), c("rgt")).otherwise(c("lft"))
    tl, te = c("len"), F.least(c("ref_end"), c("len"))
    return h.select("read_id", "hit_seq", C.useful_margin(rs, re, c("read_len") - 5000 + c("supp"), c("ref_start"), te, tl, c("mapq"), c("hit_seq") % 5 != 0).alias("useful"), S.useful_scaffold_hit(c("lft"), c("rgt"), c("read_len"), c("ref_start"), te, tl).alias("scaffold_useful"))


def _spans(s, d):
    x = G.cigar_span(F.expr(CIGAR), c("strand"))
    return hits(s, d).select("read_id", "hit_seq", x["start"].alias("s"), x["end"].alias("e"), x["length"].alias("n"))


def _identity(s, d):
    x = G.identity_profile(F.expr(CIGAR))
    return hits(s, d).select("read_id", "hit_seq", *[x[k].alias(k) for k in ("match", "mismatch", "aligned", "base_ins", "base_del", "num_ins", "num_del", "clipped", "read_base", "ref_base")])


def _positions(s, d):
    a = (F.when(c("strand"), c("lft")).otherwise(c("rgt")), F.when(c("strand"), c("rgt")).otherwise(c("lft")), c("read_len"), c("ref_start"), c("ref_end") + 200, c("strand"))
    at, site = c("lft") + c("supp") * 7 - 100, c("ref_start") + c("supp") * 7 - 100
    back = G.reversed_read(a[0], a[1], a[2], a[5])
    span = G.spanning_slice(a[0], a[1], a[2])
    sites = G.read_positions(F.array(site, c("ref_start")), *a)
    return hits(s, d).select("read_id", "hit_seq", G.reference_position(at, *a).alias("ref_at"), G.read_position(site, *a).alias("read_at"), sites[1].alias("begins_at"), back["start"].alias("back_start"), back["end"].alias("back_end"), span["start"].alias("span_start"), span["end"].alias("span_end"))


def _by_cigar(s, d):
    """Positions through the CIGAR 100M5I200M4D50M, whose answers SQL can state in pieces."""
    cig = F.lit("7S100M5I200M4D50M3S")
    a = (F.lit(8), F.lit(362), F.lit(365), F.lit(1001), F.lit(1354), F.lit(True), cig)
    return hits(s, d).select("read_id", "hit_seq", G.reference_position(c("supp") % 380 - 5, *a).alias("ref_at"), G.read_position(F.lit(995) + c("supp") % 380, *a).alias("read_at"))


def _vectors(s, d):
    from seqloom.operators.hits import hit_pairs, pair_vectors

    p = pair_vectors(hit_pairs(hits(s, d)))
    m = S.merged_vector(c("mag"), c("a_hit_seq") * 60, c("mag") + 100, F.lit(120).cast("long"))
    ok = S.consistent(c("mag"), c("dir"), c("mag") + c("a_node_id") % 900, F.lit(1))
    link = S.consistent_link(c("mag"), c("dir"), c("mag") + c("a_node_id") % 900, F.lit(1), c("a_node_id") % 2 == 0)
    return p.select("read_id", "a_hit_seq", "mag", "dir", S.leftmost(c("mag"), c("dir"), F.lit(500)).alias("left_end"), S.rightmost(c("mag"), c("dir"), F.lit(500)).alias("right_end"), S.rotated(c("mag"), F.lit(5000)).alias("on_circle"), m["mag"].alias("merged"), m["score"].alias("merged_score"), ok.alias("consistent"), link.alias("consistent_link"), S.connection_score(c("a_ref_end"), c("b_ref_end")).alias("connection"))


PAIRS_SQL = f"(select read_id, read_len, hit_seq as a_hit_seq, node_id as a_node_id, lft as a_lft, rgt as a_rgt, ref_start as a_ref_start, ref_end as a_ref_end, strand as a_strand, lead(hit_seq) over w as b_hit_seq, lead(node_id) over w as b_node_id, lead(lft) over w as b_lft, lead(rgt) over w as b_rgt, lead(ref_start) over w as b_ref_start, lead(ref_end) over w as b_ref_end, lead(strand) over w as b_strand from {HITS_SQL} window w as (partition by read_id order by hit_seq) qualify lead(hit_seq) over w is not null)"
VECTORS_SQL = f"(select *, case when a_strand then g else -g end as mag, case when a_strand = b_strand then 1 else -1 end as dir from (select *, cast(trunc((b_lft - a_lft) * ((abs(a_ref_end - a_ref_start) + abs(b_ref_end - b_ref_start))::double / (abs(a_rgt - a_lft) + abs(b_rgt - b_lft)))) as bigint) + (case when a_strand then a_ref_start else -a_ref_start end) - (case when b_strand then b_ref_start else -b_ref_start end) as g from {PAIRS_SQL}))"
POS = f"(select *, case when strand then lft else rgt end as rs, case when strand then rgt else lft end as re, ref_end + 200 as te, lft + supp * 7 - 100 as want, ref_start + supp * 7 - 100 as site from {HITS_SQL})"


def _read_at(site: str) -> str:
    return f"least(greatest(case when {site} < ref_start then (case when strand then rs + {site} - ref_start else rs - {site} + ref_start end) when {site} > te then (case when strand then re + {site} - te else re - {site} + te end) else (case when strand then cast(floor(rs + ({site} - ref_start) * abs((re - rs)::double / (te - ref_start))) as bigint) else read_len - cast(floor(read_len - rs + 1 + ({site} - ref_start) * abs((re - rs)::double / (te - ref_start))) as bigint) + 1 end) end, 1), read_len)"


CODONS = "list_aggregate(list_transform(generate_series(1, length(seq) - 2, 3), lambda i: substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', cast(16 * (instr('TCAG', substr(seq, i, 1)) - 1) + 4 * (instr('TCAG', substr(seq, i + 1, 1)) - 1) + instr('TCAG', substr(seq, i + 2, 1)) as int), 1)), 'string_agg', '')"

QUERIES = {
    "scalar_math": (_math, f"select node_id, round(cov * 100 / 80.0::double, 6) as norm, round(cov * 80.0::double / 100, 6) as real, cast(trunc(cov * (300 - 127) / 300) as bigint) as kc, round(10.0::double / 10 * (ln(2) * (cov - (size % 3) * 60.0::double) * len / 300 - 0.5::double * len * 60 / 300), 6) as odds, case when len < 180 then 0 when len < 1200 then 1 else 2 end as qc, round(pow(10.0::double, -size::double / 10), 6) as p, round(-10 * log10(cov / 1000), 6) as phred, cast(length(cast(len as varchar)) as int) as digits, round(log2(cov), 6) as log2, round(pow(2.0::double, size::double / 10), 6) as exp2, round(least(2.0::double, greatest(1.0::double, 1 + (log10(len::double) - 2) / 3.5)), 6) as node_size from {NODES_SQL}"),
    "minmax_scale": (_scaled, f"select node_id, round(case when min(cov) over w = max(cov) over w then cov else (cov - min(cov) over w) * 10.0::double / (max(cov) over w - min(cov) over w) end, 6) as scaled from {NODES_SQL} window w as (partition by brand)"),
    "matrix_product": (_product, "with a as (select l_suppkey % 7 as i, l_partkey % 5 as j, sum(cast(l_quantity as bigint)) as x from lineitem group by 1, 2), b as (select l_partkey % 5 as j, l_orderkey % 4 as k, count(*) as y from lineitem group by 1, 2) select i, k, cast(sum(x * y) as bigint) as v from a join b using (j) group by 1, 2"),
    "sequence_functions": (_sequences, f"with q as (select id, seq, left(seq, 40) as f, left(seq, 50) as a, left(reverse(seq), 50) as b from {SEQS_SQL}) select id, repeat('N', greatest(5 - 2, 0)) || substr(f, 1, least(14, length(f))) || repeat('N', greatest(14 - length(f), 0)) as flank, case when length(a) = 0 then 0 else coalesce((select min(i) from generate_series(1, length(a)) as g(i) where substr(a, cast(i as int), 1) <> substr(b, cast(i as int), 1)), 0) end::int as mismatch, (select max(n) from generate_series(0, least(20, length(seq))) as g(n) where right(seq, cast(n as int)) = left(right(seq, 7) || 'A', cast(n as int)) and n <= length(right(seq, 7) || 'A'))::int as overlap, case when (id % 32) & 16 <> 0 then reverse(translate(left(seq, 30), 'ACGT', 'TGCA')) else left(seq, 30) end as oriented, left(seq, 5) || repeat('N', id % 4) || right(seq, 5) as joined from q"),
    "codon_translate": (_translated, f"select id, case when length(seq) < 3 then '' else {CODONS} end as protein from {SEQS_SQL}"),
    "base_signal": (_signal, f"select id, cast(2 * (length(seq) - length(replace(seq, 'T', ''))) - 2 * (length(seq) - length(replace(seq, 'A', ''))) + (length(seq) - length(replace(seq, 'G', ''))) - (length(seq) - length(replace(seq, 'C', ''))) as bigint) as total, cast(length(seq) as bigint) as n from {SEQS_SQL}"),
    "edge_text": (_edge_text, f"with x as (select read_id, hit_seq, cast(node_id as varchar) as a, strand as ap, cast(read_id as varchar) as b, hit_seq % 2 = 0 as bp from {HITS_SQL}) select read_id, hit_seq, a, not bp as b_out, a || case when ap then 'o' else 'i' end || '|' || b || case when bp then 'i' else 'o' end as bridge_keys, cast(read_id as varchar) || '#' || cast(hit_seq as varchar) || '#0' as link, '>>hit:1:' || cast(hit_seq as varchar) || ':' || a || case when ap then '+' else '-' end || ',' || b || case when bp then '+' else '-' end || ':+:p:0' as feature from x"),
    "useful_hits": (_useful, f"with h as (select h.*, n.len as tl, least(ref_end, n.len) as te, read_len - 5000 + supp as rl, least(cast(300 as bigint), cast(trunc(0.25 * n.len) as bigint)) as t from {HITS_SQL} h join {NODES_SQL} n using (node_id)), x as (select *, case when strand then lft - 1 else rl - rgt end as r1, case when strand then rl - rgt else lft - 1 end as r2 from h) select read_id, hit_seq, (r1 < t or ref_start - 1 < t) and (r2 < t or tl - te < t) and least(ref_start - 1, tl - te) < t and hit_seq % 5 <> 0 and mapq >= 10 as useful, (lft - 1 < 1000 or ref_start - 1 < 1000) and (read_len - rgt < 1000 or tl - te < 1000) and te + 1 - ref_start > 300 as scaffold_useful from x"),
    "cigar_spans": (_spans, f"with x as (select *, {CLIP} + 1 as s0, case when node_id % 4 = 0 then {CLIP} + {BODY} else {LAST} end as e0, {CLIP} + {BODY} + {TAIL} as n from {HITS_SQL}) select read_id, hit_seq, case when strand then s0 else n - s0 + 1 end as s, case when strand then e0 else n - e0 + 1 end as e, n from x"),
    "identity_profile": (_identity, f"""select read_id, hit_seq, cast(hit_seq as bigint) as "match", case when supp % 2 = 0 then 4::bigint else 0::bigint end as mismatch, 300 + supp + hit_seq + 4 as aligned, 2::bigint as base_ins, 3::bigint as base_del, 1::bigint as num_ins, 1::bigint as num_del, cast({CLIP} + {TAIL} as bigint) as clipped, 300 + supp + hit_seq + 6 as read_base, 300 + supp + hit_seq + 7 as ref_base from {HITS_SQL}"""),
    "positions": (_positions, f"""with x as (select *, case when strand then want else read_len + 1 - want end as look, case when strand then rs else read_len + 1 - rs end as b, case when strand then re else read_len + 1 - re end as e from {POS}) select read_id, hit_seq, least(greatest(case when look < b then ref_start + look - b when look > e then te + look - e else cast(floor(ref_start + (look - b) * abs((te - ref_start)::double / (re - rs))) as bigint) end, ref_start), te) as ref_at, {_read_at("site")} as read_at, {_read_at("ref_start")} as begins_at, read_len - rs + 1 as back_start, read_len - re + 1 as back_end, greatest(lft - (cast(floor(0.05::double * (rgt - lft + 1)) as bigint) + 50), 1) as span_start, least(rgt + (cast(floor(0.05::double * (rgt - lft + 1)) as bigint) + 50), read_len) as span_end from x"""),
    "cigar_positions": (_by_cigar, f"with x as (select read_id, hit_seq, supp % 380 - 5 as p, 995 + supp % 380 as t from {HITS_SQL}) select read_id, hit_seq, least(greatest(case when p < 8 then 1001 + p - 8 when p > 362 then 1354 + p - 362 when p <= 108 then 1001 + p - 8 when p <= 113 then 1101 when p <= 313 then 1101 + p - 113 else 1305 + p - 313 end, 1001), 1354) as ref_at, least(greatest(case when t < 1001 then 8 + t - 1001 when t > 1354 then 362 + t - 1354 when t <= 1101 then 8 + t - 1001 when t <= 1301 then 113 + t - 1101 when t <= 1305 then 313 else 313 + t - 1305 end, 1), 365) as read_at from x"),
    "pair_vectors": (_vectors, f"select read_id, a_hit_seq, mag, dir, case when dir > 0 then mag else mag - 500 end as left_end, case when dir > 0 then mag + 500 else mag end as right_end, ((mag % 5000) + 5000) % 5000 as on_circle, case when mag = 0 then 0 else cast(floor(mag * (a_hit_seq * 60)::double / (a_hit_seq * 60 + 120) + (mag + 100) * 120::double / (a_hit_seq * 60 + 120)) as bigint) end as merged, least(a_hit_seq * 60 + 120, 6000)::bigint as merged_score, dir = 1 and ((mag = 0 and a_node_id % 900 = 0) or abs(a_node_id % 900)::double / nullif(greatest(abs(mag), abs(mag + a_node_id % 900)), 0) <= 0.25 or a_node_id % 900 < 300) as consistent, dir = 1 and (coalesce((mag + a_node_id % 900)::double / nullif(mag, 0) > 0.75 and (mag + a_node_id % 900)::double / nullif(mag, 0) < 1.25, false) or a_node_id % 900 < case when a_node_id % 2 = 0 then 100 else 250 end) as consistent_link, (a_ref_end * b_ref_end) // (a_ref_end + b_ref_end) as connection from {VECTORS_SQL}"),
}
