"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window is WINDOW consecutive words of an item (all words of a shorter one). Its elements are shingles of SHINGLE words;
they are ordered by how often they occur in all documents, and since containment must be whole, the rarest one is the
prefix: only places where it occurs are joined. Its position in the window fixes where the window would lie in the
document (positional bound), the document's length must hold it (length bound), and then all words are compared.

The index of the windows is broadcast while it is under INDEX_BYTES; a larger benchmark is split into parts of that
size, the documents are read once for each part, and the hit words of the parts are united.

Defined cases: a null text has no words; an empty benchmark hits nothing; a null item_id never counts as an item but its
words are hit; equal item_ids count once; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, lean, row_name, with_free_name, written
from .kernels import chunks, forget_powers, PUNCT, shingles, string_buffers, U64, Words

WINDOW, SHINGLE, INDEX_BYTES = 10, 3, 64 << 20


def item_windows(items: list[tuple[int, str]], window: int = WINDOW) -> list[tuple[tuple[bytes, ...], set]]:
    """Each distinct window as its words, with the items that have it."""
    out: dict[tuple[bytes, ...], set] = {}
    for item_id, text in items:
        raw = (text or "").encode("utf-8", "surrogatepass")
        w = Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), 0, 1, PUNCT, True)
        words = [w.word(i, i) for i in range(len(w.start))]
        for i in range(max(len(words) - window, 0) + 1 if words else 0):
            out.setdefault(tuple(words[i : i + window]), set()).add(item_id)
    return list(out.items())


class Index:
    """Windows by their prefix shingle; sizes of shingles differ only for items shorter than one shingle."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], set]], k: int = SHINGLE):
        self.windows = windows
        self.k = k
        self.words = []
        self.parts = []
        for words, _ in windows:
            raw = b" ".join(words)
            h = Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), 0, 1, PUNCT, False).hashes()
            self.words.append(h)
            self.parts.append(shingles(h, min(k, len(h))))

    def elements(self) -> dict[int, np.ndarray]:
        """All shingles of the windows, by length in words."""
        out: dict[int, set] = {}
        for h, p in zip(self.words, self.parts, strict=True):
            out.setdefault(min(self.k, len(h)), set()).update(p.tolist())
        return {n: np.array(sorted(v), U64) for n, v in out.items()}

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Keep of each window its rarest shingle (ties: the smallest hash) and that one's place."""
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for w, (h, p) in enumerate(zip(self.words, self.parts, strict=True)):
            n = min(self.k, len(h))
            place = min(range(len(p)), key=lambda i: (frequency.get((n, int(p[i])), 0), int(p[i]), i))
            self.prefix.setdefault(n, {}).setdefault(int(p[place]), []).append((w, place))
        self.keys = {n: np.array(sorted(v), U64) for n, v in self.prefix.items()}


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the values that are among the sorted keys: a small bitmap first, then a search."""
    if not len(keys) or not len(values):
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[(keys >> U64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values >> U64(48)).astype(np.int64)])
    at = np.searchsorted(keys, values[maybe])
    at[at == len(keys)] = 0
    return maybe[keys[at] == values[maybe]]


def _frequencies(docs: DataFrame, index: Index) -> dict[tuple[int, int], int]:
    """How often each shingle of the windows occurs in all documents: a row for each shingle and task, summed."""
    elements = docs.sparkSession.sparkContext.broadcast(index.elements())

    def count(batches):
        sums = {n: np.zeros(len(v), np.int64) for n, v in elements.value.items()}
        for b in batches:
            offsets, data = string_buffers(b.column(0))
            for a, z in chunks(offsets):
                w = Words(offsets, data, a, z, PUNCT, True)
                h = w.hashes()
                row = w.row_of()
                for n, keys in elements.value.items():
                    s = shingles(h, n)
                    hit = member(s, keys)
                    hit = hit[row[hit] == row[hit + n - 1]]
                    np.add.at(sums[n], np.searchsorted(keys, s[hit]), 1)
        for n, s in sums.items():
            nz = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * len(nz), pa.int32()), "h": pa.array(elements.value[n][nz].view(np.int64), pa.int64()), "c": pa.array(s[nz], pa.int64())})

    rows = docs.select("text").mapInArrow(lean(count, forget_powers), "n int, h long, c long").groupBy("n", "h").agg(F.sum("c").alias("c")).collect()  # a row for each shingle of the index part
    return {(r.n, r.h & 0xFFFFFFFFFFFFFFFF): r.c for r in rows}


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words, the hit words as runs (start, end, start, end ...) and the items found, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches):
        ix = shared.value
        for b in batches:
            offsets, data = string_buffers(b.column(1))
            n_words, runs, items = [], [], []
            for a, z in chunks(offsets):
                w = Words(offsets, data, a, z, PUNCT, True)
                h = w.hashes()
                row = w.row_of()
                found: dict[int, list[tuple[int, int, set]]] = {}
                for n, keys in ix.keys.items():
                    s = shingles(h, n)
                    for p in member(s, keys).tolist():
                        r = int(row[p])
                        for win, place in ix.prefix[n][int(s[p])]:
                            at, size = p - place, len(ix.words[win])
                            if at < w.first[r] or at + size > w.first[r + 1] or not np.array_equal(h[at : at + size], ix.words[win]):
                                continue
                            words, owners = ix.windows[win]
                            if all(w.word(at + j, at + j) == x for j, x in enumerate(words)):
                                found.setdefault(r, []).append((at - int(w.first[r]), at - int(w.first[r]) + size, owners))
                n_words += np.diff(w.first).tolist()
                for r in range(w.n):
                    flat: list[int] = []
                    for s0, e0, _ in sorted(found.get(r, ()), key=lambda f: f[:2]):
                        if flat and s0 <= flat[-1]:
                            flat[-1] = max(flat[-1], e0)
                        else:
                            flat += [s0, e0]
                    runs.append(flat)
                    items.append(sorted({i for f in found.get(r, ()) for i in f[2] if i is not None}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "n_words", "runs", "items"])

    return docs.select("doc_id", "text").mapInArrow(lean(scan, forget_powers), "doc_id long, n_words long, runs array<long>, items array<long>")


def _united(batch: DataFrame) -> DataFrame:
    """From runs and items of a row to its counts and digest."""
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.size("runs") / 2, F.lit(1)).cast("int") - 1), lambda i: F.coalesce(F.get("runs", 2 * i + 1) - F.get("runs", 2 * i), F.lit(0)))
    hit = F.aggregate(at, F.lit(0).cast("long"), lambda x, y: x + y)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return batch.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def _merge(runs: list[list[int]]) -> list[int]:
    flat: list[int] = []
    for s, e in sorted((r[i], r[i + 1]) for r in runs for i in range(0, len(r), 2)):
        if flat and s <= flat[-1]:
            flat[-1] = max(flat[-1], e)
        else:
            flat += [s, e]
    return flat


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_words, runs and items of each row of docs."""
    d = with_free_name(docs, "doc_id", "text")
    items = with_free_name(benchmark, "item_id", "text").dropDuplicates()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size * 40 // index_bytes))  # an index takes up to 40 bytes for a byte of items
    if parts == 1:
        return _scan(d, _index(d, items, window))
    keyed = written(d.withColumn("row", F.monotonically_increasing_id()), "docs")
    every = None
    for p in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        found = _scan(keyed.select(F.col("row").alias("doc_id"), "text"), _index(d, part, window))
        every = found if every is None else every.unionByName(found)
    merge = F.udf(_merge, "array<long>")
    summed = every.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.collect_list("runs").alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return keyed.select("doc_id", "row").join(summed, "row").select("doc_id", "n_words", merge("all").alias("runs"), F.array_sort("items").alias("items"))


def _index(docs: DataFrame, items: DataFrame, window: int) -> Index:
    index = Index(item_windows([(r.item_id, r.text) for r in items.collect()], window))  # within index_bytes, as counted above
    index.order(_frequencies(docs, index) if index.windows else {})
    return index


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return _united(hits(docs, benchmark))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without any benchmark window."""
    row, mark = free_names(docs, "_row", "_bad")
    named = docs.withColumn(row, row_name())
    bad = hits(named.select(F.col(row).alias("doc_id"), "text"), benchmark).where(F.size("runs") > 0).select(F.col("doc_id").alias(mark)).distinct()
    return named.join(bad, F.col(row) == F.col(mark), "left_anti").drop(row)
