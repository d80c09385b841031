"""Formats as round trips: tables become lines, and lines tables again; signals and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import signal as N
from seqloom.operators.features import feature_sequences
from seqloom.plans.adapters import EDGES_SQL, FEATURES_SQL, HITS_SQL, NODES_SQL, SEQS_SQL, edges, features, hits, nodes, read, seqs
from seqloom.sources import formats as T
from seqloom.streaming import reads as L

c = F.col
text = lambda x: F.col(x).cast("string")
BASES = "substr(repeat('ACGTTGCA', 20), cast(1 + node_id % 8 as int), cast(20 + node_id % 60 as int))"


def _segments(s, d):
    return nodes(s, d).select(text("node_id").alias("node_id"), F.expr(BASES).alias("seq"), (c("size") * 10).alias("kc"), (c("size") % 4).alias("bin"), c("node_id").alias("n"))


def _gfa(s, d):
    e = edges(s, d).select(text("n0").alias("n0"), "d0", text("n1").alias("n1"), "d1")
    return T.parse_gfa(T.format_gfa(_segments(s, d), e, 77))


def _gfa_edges(s, d):
    return _gfa(s, d)[1]


def _paths(s, d):
    h = hits(s, d)
    step = F.struct("hit_seq", text("node_id").alias("node"), c("strand").alias("forward"))
    p = h.groupBy("read_id").agg(F.array_sort(F.collect_list(step)).alias("v")).select("read_id", F.transform("v", lambda x: F.struct(x["node"].alias("node"), x["forward"].alias("forward"))).alias("steps"))
    return p


def _path_lines(s, d):
    lines = _paths(s, d).select(F.concat(F.lit("P\t"), text("read_id"), F.lit("\t"), T.format_steps(c("steps")), F.lit("\t*")).alias("value"))
    got = T.parse_gfa(lines)[2]
    return got.select(c("name").cast("long").alias("read_id"), F.size("steps").cast("long").alias("n"), T.format_steps(c("steps")).alias("text"))


def _known(s, d):
    p = _paths(s, d).select(c("read_id").alias("path"), "steps")
    return T.known_steps(p, edges(s, d)).select("path", c("pos").cast("long").alias("pos"), c("node").cast("long").alias("node"), "forward")


def _fastg(s, d):
    n = nodes(s, d)
    name = lambda i: F.concat(F.lit("EDGE_"), i.cast("string"), F.lit("_length_9_cov_2.5"))
    head = F.concat(name(c("node_id")), F.when(c("node_id") % 3 == 0, "'").otherwise(""), F.lit(":"), name(c("node_id") + 1), F.when(c("size") % 2 == 0, "'").otherwise(""), F.lit(","), name(c("node_id") + 2), F.lit(";"))
    return T.parse_fastg(n.select(head.alias("name"), F.lit("ACGT").alias("seq")))[1].select(c("n0").cast("long").alias("n0"), "d0", c("n1").cast("long").alias("n1"), "d1")


def _dot(s, d):
    e = edges(s, d)
    sign = lambda x: F.when(x, "+").otherwise("-")
    lines = e.select(F.concat(F.lit(' "'), text("n0"), sign(c("d0")), F.lit('" -> "'), text("n1"), sign(~c("d1")), F.lit('"'), F.when(c("n0") % 2 == 0, F.concat(F.lit(" [d="), text("n1"), F.lit("]"))).otherwise("")).alias("value"))
    lines = lines.unionByName(s.createDataFrame([("digraph g {",), ("edge [d=-31]",), ("}",)], "value string"))
    got, _ = T.parse_dot(lines)
    return got.select(c("src").cast("long").alias("src"), "src_forward", c("dst").cast("long").alias("dst"), "dst_forward", c("dist").cast("long").alias("dist"))


def _path_blocks(s, d):
    p = _paths(s, d).select("read_id", T.format_steps(F.slice("steps", 1, 2)).alias("a"), T.format_steps(F.slice("steps", F.lit(3), F.size("steps"))).alias("b"))
    block = F.concat(F.lit("_"), text("read_id"), F.when(c("read_id") % 5 == 0, "'").otherwise(""), F.lit("\n"), c("a"), F.lit(";\n"), c("b"), F.lit("\n"))
    got = T.parse_path_blocks(p.select(block.alias("value")))
    return got.select("name", c("part").cast("long").alias("part"), F.size("steps").cast("long").alias("n"))


def _paf(s, d):
    h = hits(s, d)
    lines = h.select(F.concat_ws("\t", text("read_id"), text("read_len"), (c("lft") - 1).cast("string"), text("rgt"), F.when(c("strand"), "+").otherwise("-"), text("node_id"), F.lit("5000"), (c("ref_start") - 1).cast("string"), text("ref_end"), text("supp"), F.lit("100"), text("mapq"), F.concat(F.lit("cg:Z:"), text("supp"), F.lit("M"))).alias("value"))
    g = T.parse_paf(lines)
    long = lambda *x: [c(i).cast("long").alias(i) for i in x]
    return g.select(*long("read_id", "read_len", "read_start", "read_end", "node_id", "ref_start", "ref_end", "mapq"), "strand", "cigar")


def _sam(s, d):
    h = hits(s, d)
    flag = F.when(c("strand"), 0).otherwise(16) + F.when(c("hit_seq") % 5 == 0, 256).otherwise(0) + F.when(c("mapq") < 5, 4).otherwise(0)
    lines = h.select(F.concat_ws("\t", text("read_id"), flag.cast("string"), text("node_id"), text("ref_start"), text("mapq"), F.concat(F.lit("4S"), text("supp"), F.lit("M2I3D5=")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGT"), F.lit("IIII"), F.when(c("hit_seq") % 2 == 0, F.concat(F.lit("AS:i:"), text("supp")))).alias("value"))
    g = T.parse_sam(lines.unionByName(s.createDataFrame([("@SQ\tSN:1",)], "value string")))
    return g.select(c("read_id").cast("long").alias("read_id"), c("node_id").cast("long").alias("node_id"), c("ref_start").cast("long").alias("ref_start"), c("ref_end").cast("long").alias("ref_end"), "strand", "prime", c("score").cast("long").alias("score"))


def _fastq(s, d):
    q = seqs(s, d).where("length(seq) > 0")
    rec = F.concat(F.lit("@r"), text("id"), F.lit(" x\n"), c("seq"), F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq")))
    return T.parse_fastq(q.select(rec.alias("value"))).select("name", "seq", F.length("qual").cast("long").alias("n"))


def _jsa(s, d):
    f = F.array(F.struct(F.lit("gene").alias("type"), F.lit(2).alias("start"), F.lit(9).alias("end"), text("id").alias("id"), F.lit("+").alias("strand"), F.lit("p").alias("parent"), F.lit(1.5).alias("score")))
    g = T.parse_jsa(T.format_jsa(seqs(s, d).select(text("id").alias("id"), F.lit("DNA").alias("alphabet"), "seq", f.alias("features"))))
    return g.select(c("id").cast("long").alias("id"), c("length").cast("long").alias("length"), "seq", F.size("features").cast("long").alias("n"), c("features")[0]["end"].cast("long").alias("f_end"))


def _gff(s, d):
    f = features(s, d)
    lines = f.select(F.concat_ws("\t", text("k"), F.lit("src"), "kind", text("fstart"), text("fend"), F.lit("."), F.when(c("id") % 2 == 0, "+").otherwise("-"), F.lit("."), F.concat(F.lit("ID="), text("id"), F.lit(";x=1"))).alias("value"))
    g = T.parse_gff(lines, upstream=50, downstream=30)
    return g.select(c("seqid").cast("long").alias("k"), c("id").cast("long").alias("id"), F.when(c("type").isin("upstream", "downstream"), c("type")).otherwise("own").alias("part"), c("start").cast("long").alias("fstart"), c("end").cast("long").alias("fend"), "strand")


def _blast(s, d):
    h = hits(s, d)
    lines = h.select(F.concat_ws("\t", text("read_id"), F.lit("50"), F.lit("1"), F.lit("50"), text("node_id"), F.lit("9"), text("ref_end"), text("ref_start"), text("mapq"), (c("supp") % 101).cast("string"), F.lit("minus")).alias("value"))
    g = T.parse_blast(lines, 0.8, 0.9)
    return g.select(c("qseqid").cast("long").alias("read_id"), c("sseqid").cast("long").alias("node_id"), c("sstart").cast("long").alias("a"), c("send").cast("long").alias("z"), "strand")


def _coverage(s, d):
    n = nodes(s, d)
    name = F.when(c("node_id") % 3 == 0, F.concat(F.lit("NODE_"), text("node_id"), F.lit("_cov_2.5_x"))).otherwise(text("node_id"))
    desc = F.when(c("node_id") % 3 == 1, F.concat(F.lit("80 "), text("len"))).otherwise("")
    return T.contig_coverage(n.select("node_id", name.alias("name"), desc.alias("desc"), F.expr(BASES).alias("seq"))).select("node_id", F.round("cov", 6).alias("cov"))


def _xaf(s, d):
    n = nodes(s, d).withColumn("n", c("node_id") * 3 + 1)
    rows = n.select("n", F.concat_ws("\t", text("len"), text("size")).alias("value"))
    heads = n.where("node_id % 50 = 0").select((c("n") - 1).alias("n"), F.when(c("node_id") % 100 == 0, F.lit("#H:a\tb")).otherwise(F.lit("#H:b\ta")).alias("value"))
    g = T.parse_xaf(rows.unionByName(heads))
    return g.select(c("record_no").alias("n"), c("fields")["a"].cast("long").alias("a"), c("fields")["b"].cast("long").alias("b"))


def _signals(s, d):
    return read(s, d, "embeddings").select(c("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("signal"))


def _nsdf(s, d):
    x = N.transformed(_signals(s, d), lambda v: N.square_difference(N.normalised(v)), 2)
    return x.select("id", F.posexplode("values").alias("lag", "v")).select("id", c("lag").cast("long").alias("lag"), F.round("v", 5).alias("v"))


def _peaks(s, d):
    how = {"least": 4, "cutoff": 16.0}
    x = N.transformed(_signals(s, d), lambda v: np.array(N.chopping_points(N.low_pass(N.square_difference(N.normalised(v)), 16.0), **how), np.float64), 2)
    return x.select("id", F.size("values").cast("long").alias("n"))


def _scan(s, d):
    def scan(b):
        import pyarrow as pa

        for part in b:
            for i in range(0, part.num_rows, 64):
                ids, cells = part.column(0).slice(i, 64), part.column(1).slice(i, 64).to_pylist()
                at = [int(np.argmax(N.match_scan("ACGTACCTGA", x))) if x else -1 for x in cells]
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int64())], ["id", "best"])

    return seqs(s, d).mapInArrow(scan, "id long, best long")


CHUNK_EXPR = ["user_id as read_id", "event_id as chunk", "1000 + event_id as read_len", "event_id % 4 as node_id", "event_id % 3 <> 0 as is_unique", "cast(300 + (event_id * 7) % 2000 as bigint) as node_len", "event_id % 5 < 3 as strand", "event_id % 700 as read_start", "event_id % 700 + 250 as read_end", "1 + event_id % 90 as ref_start", "250 + event_id % 90 as ref_end", "(event_id * 13) % 900 as tail"]
ENOUGH = 2500


def _until(s, d):
    base = (s.conf.get("spark.checkpoint.dir", None) or "file:///tmp/seqloom-stream").rstrip("/") + f"/stream-{uuid.uuid4().hex[:8]}"
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/event[s].parquet").selectExpr(*CHUNK_EXPR)
    return L.run_available(L.read_until(stream, ENOUGH), f"{base}/out", f"{base}/checkpoint")


UNTIL_SQL = f"""with recursive x as (select *, row_number() over (partition by read_id order by chunk) as i from (select {', '.join(CHUNK_EXPR)} from events)),
z(read_id, i, chunk, prev, l_node, l_rs, l_re, l_ts, l_te, l_fwd, counted, go, new) as (
select read_id, cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as boolean), cast(0 as bigint), true, cast(0 as bigint) from x where i = 1
union all
select read_id, i, chunk, l_node, case when kind in (2, 3) then node_id else l_node end, case when kind in (2, 3) then read_start else l_rs end, case when kind in (2, 3) then read_end else l_re end, case when kind in (2, 3) then ref_start else l_ts end, case when kind in (2, 3) then ref_end else l_te end, case when kind in (2, 3) then strand else l_fwd end, case when kind in (2, 3) then read_len else counted end, case kind when 2 then false when 3 then greatest(read_start, read_end) + (case when strand then node_len - ref_end else ref_start end) + tail < {ENOUGH} else true end, case when kind in (2, 3) then read_len - counted else 0 end
from (select *, case when not is_unique then 0 when l_node is null or l_node <> node_id then 3 when abs(apart - node_len)::double / greatest(apart, node_len) <= 0.25 then 2 else 1 end as kind from (select x.*, z.l_node, z.l_rs, z.l_re, z.l_ts, z.l_te, z.l_fwd, z.counted, abs(cast(trunc((l_rs - read_start) * ((abs(ref_end - ref_start) + abs(l_te - l_ts))::double / (abs(read_end - read_start) + abs(l_re - l_rs)))) as bigint) + (case when strand then ref_start else -ref_start end) - (case when l_fwd then l_ts else -l_ts end)) as apart from z join x on x.read_id = z.read_id and x.i = z.i + 1)))
select read_id, chunk, prev as previous, go as proceed, new as new_bases from z where i > 0"""

ALIGNED = "(select vec_id as id, cast(embedding[i] as double) as v, i from embeddings, generate_series(1, 64) g(i))"

QUERIES = {
    "gfa_segments": (lambda s, d: _gfa(s, d)[0].select(c("node_id").cast("long").alias("node_id"), "seq", "kc"), f"select node_id, {BASES} as seq, size * 10 as kc from {NODES_SQL}"),
    "gfa_links": (lambda s, d: _gfa_edges(s, d).select(c("n0").cast("long").alias("n0"), "d0", c("n1").cast("long").alias("n1"), "d1", "overlap"), f"select *, 77 as overlap from {EDGES_SQL}"),
    "gfa_paths": (_path_lines, f"select read_id, count(*) as n, string_agg(cast(node_id as varchar) || case when strand then '+' else '-' end, ',' order by hit_seq) as text from {HITS_SQL} group by 1"),
    "known_steps": (_known, f"with e as {EDGES_SQL}, h as (select read_id, hit_seq, node_id, strand, lag(node_id) over w as pn, lag(strand) over w as ps from {HITS_SQL} window w as (partition by read_id order by hit_seq)), k as (select h.*, hit_seq = 1 or exists (select 1 from e where (n0 = pn and d0 = ps and n1 = node_id and d1 = (not strand)) or (n1 = pn and d1 = ps and n0 = node_id and d0 = (not strand))) as ok from h), f as (select *, bool_and(ok) over (partition by read_id order by hit_seq) as good from k) select read_id as path, hit_seq - 1 as pos, node_id as node, strand as forward from f where good"),
    "fastg_edges": (_fastg, f"with e as (select node_id as n0, node_id % 3 <> 0 as d0, node_id + 1 as n1, size % 2 = 0 as d1 from {NODES_SQL} union all select node_id, node_id % 3 <> 0, node_id + 2, false from {NODES_SQL}) select n0, d0, n1, d1 from e"),
    "dot_edges": (_dot, f"select n0 as src, d0 as src_forward, n1 as dst, not d1 as dst_forward, case when n0 % 2 = 0 then n1 else -31 end as dist from {EDGES_SQL}"),
    "path_blocks": (_path_blocks, f"with n as (select read_id, count(*) as n from {HITS_SQL} group by 1) select 'NODE_' || cast(read_id as varchar) as name, cast(p as bigint) as part, case when p = 0 then least(n, 2) else n - 2 end as n from n, generate_series(0, 1) g(p) where read_id % 5 <> 0 and (p = 0 or n > 2)"),
    "paf_hits": (_paf, f"select read_id, read_len, lft as read_start, rgt as read_end, node_id, ref_start, ref_end, mapq, strand, cast(supp as varchar) || 'M' as cigar from {HITS_SQL}"),
    "sam_hits": (_sam, f"select read_id, node_id, ref_start, ref_start + supp + 3 + 5 - 1 as ref_end, strand, hit_seq % 5 <> 0 as prime, case when hit_seq % 2 = 0 then supp else supp + 8 end as score from {HITS_SQL} where mapq >= 5"),
    "fastq_records": (_fastq, f"select 'r' || cast(id as varchar) as name, seq, cast(length(seq) as bigint) as n from {SEQS_SQL} where length(seq) > 0"),
    "jsa_records": (_jsa, f"select id, cast(length(seq) as bigint) as length, seq, cast(1 as bigint) as n, cast(9 as bigint) as f_end from {SEQS_SQL}"),
    "gff_features": (_gff, f"with f as (select k, id, fstart, fend, id % 2 = 0 as fwd from {FEATURES_SQL}), a as (select k, id, 'own' as part, fstart, fend, fwd from f union all select k, id, 'upstream', case when fwd then greatest(fstart - 50, 1) else fend + 1 end, case when fwd then fstart - 1 else fend + 50 end, fwd from f union all select k, id, 'downstream', case when fwd then fend + 1 else greatest(fstart - 30, 1) end, case when fwd then fend + 30 else fstart - 1 end, fwd from f) select k, id, part, fstart, fend, case when fwd then '+' else '-' end as strand from a where fend >= fstart"),
    "blast_hits": (_blast, f"select read_id, node_id, ref_start as a, ref_end as z, '-' as strand from {HITS_SQL} where mapq / 50.0::double >= 0.8 and (supp % 101) / 100.0::double >= 0.9"),
    "contig_coverage": (_coverage, f"select node_id, round(case when node_id % 3 = 0 then 2.5 when node_id % 3 = 1 then len::double / (20 + node_id % 60) else 1 end, 6)::double as cov from {NODES_SQL}"),
    "xaf_rows": (_xaf, f"select node_id * 3 + 1 as n, case when (node_id // 50) % 2 = 0 then len else size end as a, case when (node_id // 50) % 2 = 0 then size else len end as b from {NODES_SQL}"),
    "feature_sequences": (lambda s, d: feature_sequences(features(s, d).select("id", (c("k") % 100).alias("k"), (c("fstart") % 60 + 1).alias("fstart"), (c("fstart") % 60 + 9).alias("fend")), seqs(s, d).select(c("id").alias("k"), "seq").where("k < 100")), f"select f.id, substr(s.seq, cast(fstart % 60 + 1 as int), 9) as seq from {FEATURES_SQL} f join {SEQS_SQL} s on s.id = f.k % 100 where s.id < 100"),
    "square_difference": (_nsdf, f"with e as {ALIGNED}, z as (select id, i, (v - avg(v) over w) / stddev_samp(v) over w as x from e window w as (partition by id)), r as (select a.id, b.i - a.i as lag, sum(a.x * b.x) as r, sum(a.x * a.x + b.x * b.x) as m from z a join z b on a.id = b.id and b.i >= a.i group by 1, 2) select id, cast(lag as bigint) as lag, round(2 * r / m, 5) as v from r"),
    "chopping_points": (_peaks, None),
    "template_scan": (_scan, None),
    "read_until": (_until, UNTIL_SQL),
}
