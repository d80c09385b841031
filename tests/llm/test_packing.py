"""Shares of each mixing window, whole documents in one window, and any number of sources."""

import random
from collections import Counter, defaultdict

import pytest

from seqloom.llm import packing


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    size = {"web": 900, "books": 60, "code": 300, None: 40}
    rows = [(i, " ".join(r.choice(["alpha", "beta", "x1", "gamma"]) for _ in range(r.randint(1, 60) if s != "books" else r.randint(100, 400))), s) for i, s in enumerate([s for s, n in size.items() for _ in range(n)])]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


def served(ids, window, weights=None, rest=1.0):
    _, cells, _ = packing.cells(ids, 64, window, weights, rest)
    out = defaultdict(Counter)
    for c in cells.collect():
        out[c.queue][c.window] = c.size
    longest = {r.queue: r.m for r in ids.groupBy("queue").agg({"n": "max"}).withColumnRenamed("max(n)", "m").collect()}
    return out, longest


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_natural_shares_in_every_window(docs, broadcast, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(packing, "BLOCK", 3)
    ids = packing.encode(docs)
    out, longest = served(ids, 32)
    total = sum(sum(v.values()) for v in out.values())
    for q, v in out.items():
        share, run = sum(v.values()) / total, 0
        for w in range(max(max(x) for x in out.values()) + 1):
            run += v[w]
            assert abs(run - min((w + 1) * 64 * 32 * share, sum(v.values()))) <= longest[q] + 1  # the debt is under one document
    pieces = packing.lay_out(ids, 64, 32).collect()
    places, seen = Counter(), defaultdict(set)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == places[p.sequence_id]
        places[p.sequence_id] += p.length
        seen[p.doc_id].add(p.sequence_id)
    assert sum(places.values()) == total and sorted(places.values())[1:] == [64] * (len(places) - 1)
    assert all(max(s) - min(s) == len(s) - 1 for s in seen.values())  # a document is served whole: its pieces follow each other


def test_weights_and_dry_queues(docs):
    weights = {"web": 1.0, "books": 3.0}
    out, longest = served(packing.encode(docs, weights=weights), 16, weights, 1.0)
    assert set(out) == {"=web", "=books", ""}
    size, share, left = 64 * 16, {"=web": 0.2, "=books": 0.6, "": 0.2}, {q: sum(v.values()) for q, v in out.items()}
    run = Counter()
    for w in range(3):  # none is dry yet
        for q in out:
            run[q] += out[q][w]
            assert abs(run[q] - (w + 1) * size * share[q]) <= longest[q] + 1
    dry = max(out["=books"])
    assert dry < max(out["=web"]) and left["=books"] == sum(out["=books"].values())
    after = [w for w in out["=web"] if w > dry + 1]
    assert all(abs(sum(out[q][w] for w in after) / len(after) - size / 2) < size for q in ("=web", ""))


def test_many_sources(spark):
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(1500)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, length=64, window=4).collect()
    assert len({p.doc_id for p in pieces}) == 1500 and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_weights_must_be_positive(docs):
    with pytest.raises(ValueError):
        packing.lay_out(packing.encode(docs.limit(1), weights={"web": 0.0}), weights={"web": 0.0})
