"""Mixture-controlled packing: deficit round-robin over source queues fills every mixing window to the target proportions.

Each source is a queue of its documents, in the order of the written id table (its part, then its row). A mixing window is
WINDOW sequences of tokens; in each, a queue's credit grows by its target share of the window, whole documents are served while
there is credit, and what the last one takes beyond it is owed in the windows after. A document is thus served in the window in which
the queue's running target reaches its first token, which any task can compute for any document: credit and debt cross
windows and partitions without a pass in order. Within a window queues follow each other by name; windows follow each other
without gaps and are cut into sequences of LENGTH tokens, so documents are cut at the ends of sequences only, and only the
last sequence of all is padded.

Targets are the sources' own shares of all tokens, or weights by source; sources without a weight are one queue together, of
weight rest. A queue that runs dry leaves its share to the others, in their proportions. Any number of sources is a table of
totals, joined; only weights given by the caller become literals.

Defined cases: a null text is empty (one id, the end); a null source is the source ""; an empty table gives no rows; repeated
rows are packed each; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, with_free_name, written
from .kernels import forget_powers
from .tokens import encoder, forget_pretokens

LENGTH, WINDOW, END = 1024, 64, 0
#: Rows of a table of queue parts or of cells up to which it is broadcast (10 MB); beyond that it is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Windows whose cells are put in order by one task.
BLOCK = 4096
#: Characters encoded at once.
CHUNK = 1 << 20
PATH = public_tokenizers.path("byte_bpe_50k.json")


def _queue(weights: dict[str, float] | None) -> Column:
    name = F.coalesce(F.col("source"), F.lit(""))
    return name if weights is None else F.when(name.isin(list(weights)), F.concat(F.lit("="), name)).otherwise("")


def encode(docs: DataFrame, path: str = PATH, weights: dict[str, float] | None = None) -> DataFrame:
    """Written table of doc_id, queue, part, first (ids of the queue before it in its part), n and ids (little-endian, 2 bytes each where the vocabulary allows)."""
    d = with_free_name(docs, "doc_id", "text", "source")

    def run(batches):
        enc = encoder(path)
        wide = enc.tokenizer.get_vocab_size() > 1 << 16
        part = TaskContext.get().partitionId()
        served: dict[str, int] = {}
        for b in batches:
            texts, queues, ids = b.column(1), b.column(2).to_pylist(), b.column(0)
            sizes = [len(t) if (t := x.as_py()) else 0 for x in texts]
            i = 0
            while i < len(sizes):
                j, size = i, 0
                while j < len(sizes) and (j == i or size + sizes[j] <= CHUNK):
                    size += sizes[j]
                    j += 1
                out, first, n = [], [], []
                for q, x in zip(queues[i:j], enc.encode([t or "" for t in texts.slice(i, j - i).to_pylist()]), strict=True):
                    out.append(np.append(x, np.uint32(END)).astype("<u4" if wide else "<u2").tobytes())
                    n.append(len(x) + 1)
                    first.append(served.get(q, 0))
                    served[q] = first[-1] + n[-1]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(queues[i:j], pa.string()), pa.array([part] * (j - i), pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "queue", "part", "first", "n", "ids"])
                i = j

    coded = d.select("doc_id", "text", _queue(weights).alias("queue"))
    return written(coded.mapInArrow(lean(run, lambda: forget_pretokens(path), forget_powers), "doc_id long, queue string, part long, first long, n long, ids binary"), "ids")


def _window(totals: DataFrame, size: int, weights: dict[str, float] | None, rest: float) -> Column:
    """The window in which the queue's running target reaches its token number a; its total is total."""
    if weights is None:
        every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        return F.floor(F.col("a") / F.col("total") * F.lit(every / size))
    share = {"": float(rest)} | {f"={k}": float(v) for k, v in weights.items()}
    if min(share.values()) <= 0:
        raise ValueError("weights must be above 0")
    known = {r.queue: r.total for r in totals.collect()}  # a row for each weight, and one
    own = F.element_at(F.create_map(*[F.lit(x) for p in share.items() for x in p]), F.col("queue"))
    # at the time a queue of weight w has served a tokens, every other has served a / w times its own weight, or all it has
    return F.floor(sum((F.least(F.lit(float(n)), F.col("a") / own * share[q]) for q, n in known.items()), F.lit(0.0)) / size)


def cells(ids: DataFrame, length: int = LENGTH, window: int = WINDOW, weights: dict[str, float] | None = None, rest: float = 1.0) -> tuple[DataFrame, DataFrame, Column]:
    """Parts (queue, part, base, total), cells (queue, window, low, size, start): what each queue serves in each window, its first token there, and where the cell lies in the whole; and the window of a row with a and total."""
    parts = ids.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("queue")
    parts = written(parts.select("queue", "part", (F.sum("n").over(by.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(by).alias("total")), "queue-parts")
    at = _window(parts.select("queue", "total").distinct(), length * window, weights, rest)
    placed = ids.select("queue", "part", "first", "n").join(_small(parts), ["queue", "part"]).withColumn("a", F.col("base") + F.col("first"))
    found = placed.groupBy("queue", at.alias("window")).agg(F.min("a").alias("low"), F.sum("n").alias("size"))
    found = written(found.withColumn("block", F.floor(F.col("window") / BLOCK)), "cells")
    blocks = found.groupBy("block").agg(F.sum("size").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row for BLOCK windows
    inside = F.sum("size").over(Window.partitionBy("block").orderBy("window", "queue")) - F.col("size")
    return parts, written(found.join(F.broadcast(blocks), "block").select("queue", "window", "low", "size", (F.col("before") + inside).alias("start")), "placed-cells"), at


def _small(rows: DataFrame) -> DataFrame:
    """rows, broadcast where their count is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def lay_out(ids: DataFrame, length: int = LENGTH, window: int = WINDOW, weights: dict[str, float] | None = None, rest: float = 1.0) -> DataFrame:
    """The pieces of an id table."""
    parts, placed, at = cells(ids, length, window, weights, rest)
    rows = ids.join(_small(parts), ["queue", "part"]).withColumn("a", F.col("base") + F.col("first")).withColumn("window", at)
    rows = rows.join(_small(placed.select("queue", "window", "low", "start")), ["queue", "window"]).select("doc_id", (F.col("start") + F.col("a") - F.col("low")).alias("g"), "n", "ids")

    def run(batches):
        for b in batches:
            row, out = [], []
            for i, (g, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                x = b.column(3)[i].as_buffer()
                x = np.frombuffer(x, f"<u{x.size // n}").astype("<u4")
                first = 0
                while first < n:
                    size = min(n - first, length - (g + first) % length)
                    row.append(i)
                    out.append((first, size, zlib.crc32(x[first : first + size]), n, (g + first) // length, (g + first) % length))
                    first += size
            cols = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 6)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str = PATH, length: int = LENGTH, window: int = WINDOW, weights: dict[str, float] | None = None, rest: float = 1.0) -> DataFrame:
    """Pieces of every document. weights: target shares by source, as any positive numbers."""
    return lay_out(encode(docs, path, weights), length, window, weights, rest)
