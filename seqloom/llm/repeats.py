"""Substring dedup by repeated-phrase automata: every word in a run of WINDOW words that occurs more than once goes.

1. Of each WINDOW consecutive words the phrase (PHRASE words) of least hash is noted; equal windows note equal phrases. A
   phrase noted twice anywhere recurs, and a window can recur only if its phrase does.
2. Distinct texts with recurring phrases meet those phrases: for each shard of documents an Aho-Corasick automaton
   (pyahocorasick) of its recurring phrases is compiled and all its documents are streamed through it, which locates every
   occurrence, compared byte by byte. Windows whose least phrase is a located one are candidates.
3. Candidates are grouped by a 96-bit hash of their words over the whole table; those that occur twice, or lie in a text
   with copies, recur. Their places return to their documents, where the covered words are removed.

A shard is a run of documents of at most kernels.CHUNK bytes (or one document), so an automaton's size is bounded whatever
the number of recurring phrases. What a batch itself shows to recur is confirmed there and sends one row for others to be
confirmed by, so a very frequent phrase or window makes no large group.

Defined cases: a null text has no words and the digest of the empty string; texts under WINDOW words keep all; equal texts
are copies of each other, so all words of WINDOW or more go; repeated rows likewise; other columns are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shuffle_partitions, with_free_name, written
from .kernels import chunks, forget_powers, mix, shingles, SPACES, string_buffers, U64, Words

WINDOW, PHRASE = 35, 8
MOST = U64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, k: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) of each k consecutive values."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x = pick(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


class Phrases:
    """Phrase hashes of some rows, the least one of each window, and which places are least in a window."""

    def __init__(self, w: Words, window: int, phrase: int):
        self.h = w.hashes()
        row = w.row_of()
        self.span = window - phrase + 1
        self.s = shingles(self.h, phrase)
        n = max(len(self.h) - window + 1, 0)
        self.whole = row[:n] == row[window - 1 : window - 1 + n]  # windows that lie in one row
        self.least = _sliding(self.s, self.span, np.minimum)[:n]

    def noted(self) -> np.ndarray:
        """Places of phrases that are least in some window."""
        m = np.where(self.whole, self.least, U64(0))
        pad = np.zeros(self.span - 1, U64)
        over = _sliding(np.concatenate([pad, m, pad]), self.span, np.maximum)
        return np.flatnonzero(over[: len(self.s)] == self.s) if len(m) else np.zeros(0, np.int64)

    def candidates(self, located: np.ndarray) -> np.ndarray:
        """Windows whose least phrase stands at a located place."""
        at = np.zeros(len(self.s), bool)
        at[located] = True
        m = _sliding(np.where(at, self.s, MOST), self.span, np.minimum)[: len(self.least)]
        return np.flatnonzero(self.whole & (m == self.least))


def _names(docs: DataFrame) -> DataFrame:
    """doc_id and names of each row: of the row (rk), and of its text (t1, t2)."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(17), "text").alias("t2"))


def _noted(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """A row (h, t1, t2) for each noted phrase; a task sends a text's at most twice."""

    def run(batches):
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            t1, t2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh = []
            for k in zip(t1.tolist(), t2.tolist(), strict=True):
                seen[k] = seen.get(k, 0) + 1
                fresh.append(seen[k] <= 2)
            b = b.filter(pa.array(fresh, pa.bool_()))
            t1, t2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            offsets, data = string_buffers(b.column(2))
            hs, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for a, z in chunks(offsets):
                w = Words(offsets, data, a, z, SPACES, False)
                p = Phrases(w, window, phrase)
                at = p.noted()
                hs.append(p.s[at])
                rows.append(np.searchsorted(w.first, at, "right") - 1 + a)
            h, row = np.concatenate(hs), np.concatenate(rows)
            key, sure = _sure(h, h ^ mix(np.arange(len(h), dtype=U64) + U64(t1[0] & 0x7FFFFFFF if len(t1) else 0)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.zeros(len(h), np.int32)), pa.array(sure), pa.array(h.view(np.int64)), pa.array(t1[row]), pa.array(t2[row])], ["key", "check", "sure", "h", "t1", "t2"])

    return docs.where("text is not null").select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(17), "text").alias("t2"), "text").mapInArrow(lean(run, forget_powers), "key long, check int, sure boolean, h long, t1 long, t2 long")


def _sure(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values of a batch: the key to be grouped by, and whether the batch itself shows that the value recurs.

    Of a value that recurs here the first keeps its own key, to show it to other tasks; the rest need no group and go
    anywhere, so a value of very many rows makes no large group.
    """
    _, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    sure = n[back] > 1
    own = np.zeros(len(h), bool)
    own[first] = True
    return np.where(sure & ~own, other, h), sure


def _confirmed(rows: DataFrame, columns: str) -> DataFrame:
    """Of rows (key, check, sure, ...) the ... of those that are sure or whose key and check occur more than once."""

    def run(batches):
        last, met = None, False  # the last row, which waits, and whether it is confirmed already
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if last is None else pa.concat_tables([last, pa.Table.from_batches([b])])
            key = t.column(0).to_numpy()
            check = t.column(1).to_numpy()
            keep = t.column(2).to_numpy().astype(bool)
            keep[0] |= met
            same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
            keep[1:] |= same
            keep[:-1] |= same
            met = bool(keep[-1])
            last = t.slice(len(key) - 1)
            keep[-1] = False
            yield from t.filter(pa.array(keep)).select(range(3, t.num_columns)).to_batches()
        if met:
            yield from last.select(range(3, last.num_columns)).to_batches()

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "check").mapInArrow(lean(run, forget_powers), columns)


def _locate(w: Words, phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of every occurrence of the phrases (words joined by one space) in the rows of w."""
    sep = SPACES[w.buf]
    keep = ~sep
    keep[1:] |= ~sep[:-1]  # of the separators between two words, one
    keep[w.row_start[:-1] - 1] = True
    text = np.where(sep, 0x20, w.buf).astype(np.uint8)
    text[w.row_start - 1] = 0x0A  # no phrase reaches across rows
    place = np.cumsum(keep) - 1
    text = text[keep]
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(p.decode("latin-1"), len(p))
    automaton.make_automaton()
    found = [(e - n + 1, e + 1) for e, n in automaton.iter(text.tobytes().decode("latin-1"))]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, e = np.array(found).T
    first, last = np.full(len(text) + 1, -1), np.full(len(text) + 1, -1)
    first[place[w.start]] = np.arange(len(w.start))
    last[place[w.end - 1] + 1] = np.arange(len(w.end))
    ok = (first[s] >= 0) & (last[e] >= 0)  # whole words
    return first[s[ok]], last[e[ok]]


def _windows(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """A row (key, check, sure, rk, place) for each candidate window of texts (text, rk, copied, hs); key and check are 96 bits of its words' hash."""

    def run(batches):
        for b in batches:
            offsets, data = string_buffers(b.column(0))
            out = []
            rk, copied, hs = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3)
            for a, z in chunks(offsets):
                w = Words(offsets, data, a, z, SPACES, False)
                p = Phrases(w, window, phrase)
                wanted = np.unique(hs.slice(a, z - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
                at = p.noted()
                at = at[np.isin(p.s[at], wanted)]
                _, once = np.unique(p.s[at], return_index=True)
                first, last = _locate(w, list({b" ".join(w.word(i, i) for i in range(x, x + phrase)) for x in at[once].tolist()}))
                found = p.candidates(first[last - first == phrase - 1])
                row = np.searchsorted(w.first, found, "right") - 1
                out.append((shingles(p.h, window)[found], shingles(mix(p.h + U64(0xA0761D6478BD642F)), window)[found], row + a, found - w.first[row]))
            w1, w2, row, place = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 2)
            key, sure = _sure(w1, w1 ^ mix(np.arange(len(w1), dtype=U64) + U64(rk[0] & 0x7FFFFFFF if len(rk) else 0)))
            # a window of a copied text shows itself to others once more: two rows of its key
            sure |= copied[row].astype(bool)
            twin = np.flatnonzero(copied[row].astype(bool) & (key == w1))
            pick = np.concatenate([np.arange(len(w1)), twin])
            yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), pa.array((w2[pick] >> U64(32)).astype(np.uint32).view(np.int32)), pa.array(sure[pick]), pa.array(rk[row[pick]]), pa.array(place[pick].astype(np.int32))], ["key", "check", "sure", "rk", "place"])

    return texts.select("text", "rk", "copied", "hs").mapInArrow(lean(run, forget_powers), "key long, check int, sure boolean, rk long, place int")


def marks(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(rk, t1, copied, places) of the rows with recurring windows: all windows of a copied text, else those at places."""
    names = written(_names(docs.where("text is not null")), "names")
    texts = names.groupBy("t1", "t2").agg(F.min("rk").alias("rk"), (F.count(F.lit(1)) > 1).alias("copied"))
    phrases = written(_confirmed(_noted(docs, window, phrase), "h long, t1 long, t2 long"), "phrases").groupBy("t1", "t2").agg(F.collect_set("h").alias("hs"))
    work = written(texts.join(phrases, ["t1", "t2"]).select("rk", "t1", "copied", "hs"), "work")
    keyed = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("rk"), F.xxhash64("text").alias("t1"))
    windows = written(_windows(keyed.join(work, ["rk", "t1"]), window, phrase), "windows")
    places = _confirmed(windows, "rk long, place int").groupBy("rk").agg(F.collect_set("place").alias("places"))
    own = work.where("not copied").select("rk", "t1").join(places, "rk").select("rk", "t1", F.lit(False).alias("copied"), "places")
    copies = names.join(texts.where("copied").select("t1", "t2"), ["t1", "t2"]).select("rk", "t1").distinct()
    return own.unionByName(copies.select("rk", "t1", F.lit(True).alias("copied"), F.array().cast("array<int>").alias("places")))


def _cut(rows: DataFrame, window: int, schema: str, finish) -> DataFrame:
    """finish(batch, kept words of each row, words, removed) over rows whose last three columns are text, copied and places."""

    def run(batches):
        for b in batches:
            m = b.num_columns
            offsets, data = string_buffers(b.column(m - 3))
            copied, places = b.column(m - 2).to_pylist(), b.column(m - 1)
            kept, words, removed = [], [], []
            for a, z in chunks(offsets):
                w = Words(offsets, data, a, z, SPACES, False)
                n = np.diff(w.first)
                for i in range(z - a):
                    f, k = int(w.first[i]), int(n[i])
                    gone = np.zeros(k + 1, np.int64)
                    if copied[a + i] and k >= window:
                        gone[0] = 1
                    elif copied[a + i] is False and (p := places[a + i].values) is not None and len(p):
                        at = p.to_numpy(zero_copy_only=False)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(gone[:k]) == 0)
                    kept.append(b" ".join([w.word(f + j, f + j) for j in stay.tolist()]))
                    words.append(k)
                    removed.append(k - len(stay))
            yield finish(b, kept, words, removed)

    return rows.mapInArrow(lean(run, forget_powers), schema)


def digest(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    d = with_free_name(docs, "doc_id", "text")
    found = written(marks(d, window, phrase), "marks")
    keyed = d.withColumns({"rk": F.xxhash64("doc_id", "text"), "t1": F.xxhash64("text")})
    rows = keyed.join(found, ["rk", "t1"], "left").select("doc_id", "text", "copied", "places")

    def finish(b, kept, words, removed):
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _cut(rows, window, "doc_id long, n_words long, n_removed long, kept_sha256 string", finish)


def without_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id and the text that is left, its words joined by one space, of every row."""
    d = with_free_name(docs, "doc_id", "text")
    found = written(marks(d, window, phrase), "marks")
    keyed = d.withColumns({"rk": F.xxhash64("doc_id", "text"), "t1": F.xxhash64("text")})
    rows = keyed.join(found, ["rk", "t1"], "left").select("doc_id", "text", "copied", "places")
    return _cut(rows, window, "doc_id long, text string", lambda b, kept, *_: pa.RecordBatch.from_arrays([b.column(0), pa.array([k.decode("utf-8", "surrogatepass") for k in kept])], ["doc_id", "text"]))
