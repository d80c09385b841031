"""The Jaccard join where blocks grow with the corpus: chance elements in common, and many near copies of one text."""

from collections import Counter

import numpy as np
import pytest

from seqloom.llm import jaccard


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(texts):
    """Least id reached by links, of each text."""
    sets, low = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    return low


def found(spark, texts):
    rows = jaccard.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.component_id for r in sorted(rows)]


def counted(monkeypatch, name):
    """Rows that the calls of a function of the module get as first argument."""
    calls, f = [], getattr(jaccard, name)
    monkeypatch.setattr(jaccard, name, lambda rows, *a: calls.append(rows.count()) or f(rows, *a))
    return calls


def test_chance_elements_tie_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 2)
    monkeypatch.setattr(jaccard, "rarity", lambda counts: np.zeros(len(counts), np.uint8))  # order by hash alone
    calls = counted(monkeypatch, "_crossing")
    texts = []
    for i in range(40):  # pairs of near copies; each pair has one shingle in common with the next
        own = [f"p{i}w{j}" for j in range(60)]
        t = [f"c{i}{x}" for x in "abcde"] + own + [f"c{i + 1}{x}" for x in "abcde"]
        texts += [" ".join(t), " ".join([*t, "tail"])]
    assert found(spark, texts) == [i // 2 * 2 for i in range(80)]
    assert calls == []


def test_near_copies_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    monkeypatch.setattr(jaccard, "OUTSIDE", 8)
    calls = counted(monkeypatch, "_rounds")
    base, texts = [f"w{i}" for i in range(200)], []
    for i in range(60):  # copies that share much, and few of which are linked
        t = list(base)
        t[3 * i : 3 * i + 18 + i % 3] = [f"x{i}y{j}" for j in range(18 + i % 3)]
        texts.append(" ".join(t))
    assert found(spark, texts) == brute(texts)
    assert 0 < sum(calls) <= 60 * 2 * 8  # each set to 8 chunks, and 8 chunks to each


@pytest.mark.parametrize("table", [1, 1 << 25])
def test_link(table, monkeypatch):
    monkeypatch.setattr(jaccard, "TABLE", table)
    rng = np.random.default_rng(5)
    bases = [np.arange(400) + 1000 * i for i in range(4)]
    sets = []
    for i in range(150):
        v = bases[i % 4].copy()
        k = int(rng.integers(0, 90))
        v[rng.choice(400, k, replace=False)] = 10_000 + 400 * i + np.arange(k)
        sets.append(np.sort(v[: 400 - int(rng.integers(0, 60))].astype(np.uint64)))
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
    probing = (rng.random(150) < 0.3).tolist()
    for own in (None, probing):
        pairs = [(i, j) for i in range(150) for j in range(i) if (own is None or own[i] or own[j]) and linked(i, j)]
        got = jaccard.link(list(range(150)), sets, None, own)
        assert all(linked(i, j) for i, j in got) and parts(got) == parts(pairs)
        assert 1 < len(Counter(parts(pairs))) < 150


def parts(pairs):
    low = list(range(150))
    for i, j in pairs:
        low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    return low
