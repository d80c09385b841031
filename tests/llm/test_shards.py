"""Balance, adjacency and order of shards, and rows that are moved whole."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm import shards


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("abc dé") for _ in range(r.randint(0, 400))) for _ in range(900)]
    rows = [(i, t, "k", i, "r", 7) for i, t in enumerate(texts)] + [(10_000 + i, texts[5], "k", i, "r", 7) for i in range(700)] + [(None, None, "k", 0, "r", 7), (None, texts[7], "k", 0, "r", 7), (3, texts[3], "k", 0, "r", 7), (5000, "x" * 2000, "k", 0, "r", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, id long, run string, shard int").repartition(7)


def test_balance_adjacency_and_slots(docs):
    got = shards.assign(docs).collect()
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    bytes_of, slots, where = Counter(), defaultdict(list), defaultdict(Counter)
    for r in got:
        bytes_of[r.shard] += r.size
        slots[r.shard].append((r.slot, r.text_crc32))
        where[r.text_crc32][r.shard] += 1
    assert set(bytes_of) == set(range(8)) and all(abs(b - total / 8) <= shards.TOLERANCE * total / 8 * 2 + largest for b in bytes_of.values())
    for v in slots.values():
        v.sort()
        assert [s for s, _ in v] == list(range(len(v)))
        crcs = [c for _, c in v]
        assert sum(a != b for a, b in zip(crcs, crcs[1:])) == len(set(crcs)) - 1  # equal texts lie side by side
    assert all(max(v) - min(v) == len(v) - 1 for v in where.values())  # a group spans neighbouring shards only
    assert sum(len(v) > 1 for v in where.values()) <= 7


def test_a_group_of_equal_texts_is_no_one_run(docs):
    rows = shards.skinny(docs)
    _, runs = shards.splitters(rows, 8, n_runs=64)
    hot = rows.groupBy(shards._count_below(runs).alias("run")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.n for r in hot) < 150


def test_exchange_moves_rows_whole(spark, docs):
    moved = shards.exchange(docs)
    assert moved.columns == [*docs.columns, "_shard"]
    assert sorted(map(str, moved.drop("_shard").collect())) == sorted(map(str, docs.collect()))
    at = moved.select(F.spark_partition_id().alias("p"), "_shard", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).collect()
    of = defaultdict(set)
    for r in at:
        of[r.p].add(r._shard)
    assert all(len(s) == 1 for s in of.values())  # a partition holds one shard's rows
    order = [min(of[p]) for p in sorted(of)]
    assert order == sorted(order)
    want = {r.shard: r.n for r in shards.assign(docs).groupBy("shard").agg(F.sum(F.col("size") - 1).alias("n")).collect()}
    got = Counter()
    for r in at:
        got[r._shard] += r.n
    assert dict(got) == want
    plain = shards.exchange(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert shards.assign(spark.createDataFrame([], schema)).count() == 0 and shards.exchange(spark.createDataFrame([], schema)).count() == 0
    assert [(r.size, r.slot) for r in shards.assign(spark.createDataFrame([(None, None)], schema)).collect()] == [(1, 0)]
