"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams in a bounded sample of labelled rows (SAMPLE rows of each language, those of smallest hash); the
log-probability matrix is broadcast, and each Arrow batch is scored sparsely in numpy, whole texts always.

Defined cases: null text or a text without a letter gives `und` with score 0; with nothing to learn from every row is
`und`; ties go to the first language in sorted order; repeated rows get equal results; other columns are not inputs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, with_free_name

U64 = np.uint64
#: Buckets of the hash, lengths of n-grams, labelled rows of each language to learn from, smoothing.
BUCKETS, ORDERS, SAMPLE, ALPHA = 1 << 16, (1, 2, 3), 3000, 0.5
#: A posterior counts at most so many n-grams as independent, so that the score says how clear the mean evidence is.
EVIDENCE = 40
#: Code points handled at once.
CHUNK = 1 << 19


@cache
def folding() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    out = np.full(0x110000, 0x20, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of texts by order then place (BUCKETS: none), the first place of each text, and its count of letters."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 3, out=starts[1:])  # three spaces after each text: no n-gram reaches the next one
    cp = np.frombuffer("".join([t + "   " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = folding()[cp].astype(U64)
    letter = x != U64(0x20)
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    out = []
    h = np.zeros(len(x), U64)
    some = np.zeros(len(x), bool)
    for n in range(1, max(ORDERS) + 1):
        shift = n - 1
        h = h * U64(0x100000001B3)
        h[: len(x) - shift] += x[shift:] + U64(1)
        some[: len(x) - shift] |= letter[shift:]
        if n in ORDERS:
            k = ((h + U64(n)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - 16)
            k = k.astype(np.int32)
            k[~some] = BUCKETS
            out.append(k)
    return np.stack(out), starts, total[starts[1:]] - total[starts[:-1]]


def _pieces(col: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch in runs of bounded length; a null is empty."""
    texts = col.to_pylist()
    run: list[str] = []
    size = at = 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > CHUNK:
            yield at, run
            run, size, at = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in sorted order and their log-probabilities, (BUCKETS + 1) x languages; labelled has text, lang and pick, a hash that decides who is in the sample."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    names = sorted(counts)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in counts.items()])
    taken = labelled.where(F.pmod("pick", F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for at, texts in _pieces(b.column(0)):
                g, starts, _ = grams(texts)
                for lang in set(langs[at : at + len(texts)]):
                    s = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    for i, t in enumerate(texts):
                        if langs[at + i] == lang:
                            s += np.bincount(g[:, starts[i] : starts[i] + len(t)].ravel(), minlength=BUCKETS + 1)
        for lang, s in sums.items():
            nz = np.flatnonzero(s[:BUCKETS])
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(nz), pa.string()), "bucket": pa.array(nz, pa.int32()), "n": pa.array(s[nz], pa.int64())})

    summed = taken.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS + 1, len(names)), ALPHA)
    got = summed.toPandas()  # at most BUCKETS rows a language
    table[got.bucket.to_numpy(), got.lang.map({k: i for i, k in enumerate(names)}).to_numpy()] += got.n.to_numpy()
    logp = np.log(table / table[:BUCKETS].sum(axis=0))
    logp -= logp.mean(axis=1, keepdims=True)  # only differences between languages count
    logp[BUCKETS] = 0
    return names, logp.astype(np.float32)


def scorer(names: list[str], lp: np.ndarray):
    """A function from a column of texts to their languages and scores."""

    def score(col: pa.Array) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        for _, texts in _pieces(col):
            g, starts, letters = grams(texts)
            if not names:
                langs += ["und"] * len(texts)
                scores += [0.0] * len(texts)
                continue
            ll = np.zeros((len(texts), len(names)))
            n = np.zeros(len(texts))
            for row in g:
                ll += np.add.reduceat(lp[row], starts[:-1], axis=0)
                n += np.add.reduceat((row < BUCKETS).astype(np.float64), starts[:-1])
            z = ll / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            best = ll.argmax(axis=1)
            for i, w in enumerate(best):
                langs.append(names[w] if letters[i] else "und")
                scores.append(float(z[i, w]) if letters[i] else 0.0)
        return langs, scores

    return score


def predict(docs: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """docs has doc_id, text and held_out; the matrix travels as a broadcast variable of (BUCKETS + 1) x languages x 4 bytes."""
    matrix = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches):
        score = scorer(names, matrix.value)
        for b in batches:
            langs, scores = score(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: not held out, with a language and a text."""
    d = with_free_name(docs, "doc_id", "text", "lang")
    return d.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("pick"))


def digest(docs: DataFrame) -> DataFrame:
    names, logp = fit(labelled_rows(docs))
    return predict(with_free_name(docs, "doc_id", "text").withColumn("held_out", held_out()), names, logp)


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, in a learned language with a score of least or more."""
    names, logp = fit(labelled_rows(docs))
    matrix = docs.sparkSession.sparkContext.broadcast(logp)
    at = docs.columns.index("text")

    def run(batches):
        score = scorer(names, matrix.value)
        for b in batches:
            langs, scores = score(b.column(at))
            yield b.filter(pa.array([k != "und" and x >= least for k, x in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
