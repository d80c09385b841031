"""The given tables as contigs, hits, links, sequences, features and signals: lists of expressions that Spark and SQL read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = ["p_partkey as node_id", "cast(500 + (p_partkey * 7919) % 20000 as bigint) as len", "cast(1 + (p_partkey * 31 + p_size) % 200 as double) as cov", "p_brand as brand", "cast(p_size as bigint) as size"]
HITS = [
    "l_orderkey as read_id", "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as hit_seq", "l_partkey as node_id",
    "cast(l_linenumber * 900 + l_quantity * 10 as bigint) as lft", "cast(l_linenumber * 900 + l_quantity * 10 + 299 + (l_suppkey * 131 + l_partkey * 17) % 1500 as bigint) as rgt", "cast(9000 + l_orderkey % 700 as bigint) as read_len",
    "cast(1 + (l_partkey * 13 + l_linenumber * 71) % 400 as bigint) as ref_start", "cast((l_partkey * 13 + l_linenumber * 71) % 400 + 300 + (l_suppkey * 131 + l_partkey * 17) % 1500 as bigint) as ref_end",
    "l_returnflag <> 'R' as strand", "cast(l_quantity as bigint) + case when l_linestatus = 'F' then 10 else 0 end as mapq", "cast(l_suppkey as bigint) as supp",
]
#: Even events are features of mine, odd ones of the model; a user is a sequence.
FEATURES = ["event_id as id", "user_id as k", "cast((event_id * 37) % 100000 + 1 as bigint) as fstart", "cast((event_id * 37) % 100000 + 1 + abs(floor(value)) * 5 % 400 as bigint) as fend", "event_type as kind", "value as score", "event_id % 2 = 0 as mine"]
SEQS = ["doc_id as id", "upper(regexp_replace(coalesce(text, ''), '[^acgtACGT]', ''{g})) as seq"]

NODES_SQL = f"(select {', '.join(NODES)} from part)"
HITS_SQL = f"(select {', '.join(HITS)} from lineitem)"
FEATURES_SQL = f"(select {', '.join(FEATURES)} from events)"
SEQS_SQL = f"(select {', '.join(SEQS).format(g=', ' + repr('g'))} from documents)"
LINK_Q = 53
EDGES_SQL = f"""(select distinct least(a, b) as n0, case when a < b then da else db end as d0, greatest(a, b) as n1, case when a < b then db else da end as d1 from (select node_id as a, strand as da, lead(node_id) over (partition by read_id order by hit_seq) as b, not lead(strand) over (partition by read_id order by hit_seq) as db from {HITS_SQL} where mapq >= {LINK_Q}) where b is not null and a <> b)"""
INCID_SQL = f"(select n0 as node, d0 as dir, n1 as other, d1 as other_dir from {EDGES_SQL} union all select n1, d1, n0, d0 from {EDGES_SQL})"


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def nodes(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").selectExpr(*NODES)


def hits(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").selectExpr(*HITS)


def features(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").selectExpr(*FEATURES)


def seqs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").selectExpr(*[x.format(g="") for x in SEQS])


def edges(s: SparkSession, d: str) -> DataFrame:
    from seqloom.operators.graph import edges_of_reads

    return edges_of_reads(hits(s, d).where(F.col("mapq") >= LINK_Q))
