"""Growing reads as a stream: for each chunk of a read whether it is worth sequencing on, and the bases that are new.

State is kept by read (its last unique hit and the bases already counted), so any number of reads is dealt over the executors;
a read's chunks of one micro-batch are put in order before they are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.functions.columns import R_TOL

#: Columns of a chunk's last hit; tail: what the solved bridges beyond the contig add, in the read's direction.
CHUNK = ["read_id", "chunk", "read_len", "node_id", "is_unique", "node_len", "strand", "read_start", "read_end", "ref_start", "ref_end", "tail"]
DECISION = "read_id long, chunk long, previous long, proceed boolean, new_bases long"
STATE = "node_id long, read_start long, read_end long, ref_start long, ref_end long, strand boolean, counted long"


def hit_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """An unbounded stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _same(x: float, y: float, tol: float = R_TOL) -> bool:
    top = max(abs(x), abs(y))
    return top == 0 or abs(x - y) / top <= tol


def step(last: tuple | None, counted: int, r, enough: int) -> tuple[tuple | None, int, bool, int]:
    """One chunk: (last unique hit, counted bases, whether to go on, new bases).

    A hit on a contig that is not unique changes nothing. On the same contig as before, the read goes on, unless the two hits lie
    as far apart as the contig is long: then it runs round a circle, and ends. On a new one it goes on while what lies
    ahead (the rest of the contig and the tail) is shorter than enough.
    """
    if not r.is_unique:
        return last, counted, True, 0
    hit = (r.node_id, r.read_start, r.read_end, r.ref_start, r.ref_end, r.strand)
    go = True
    if last is not None and last[0] == r.node_id:
        _, bs, be, bts, bte, b_fwd = last
        on_read = abs(r.read_end - r.read_start) + abs(be - bs)
        along = int((bs - r.read_start) * ((abs(r.ref_end - r.ref_start) + abs(bte - bts)) / on_read)) if on_read else 0
        apart = abs(along + (r.ref_start if r.strand else -r.ref_start) - (bts if b_fwd else -bts))
        if not _same(apart, r.node_len):
            return last, counted, True, 0
        go = False
    else:
        ahead = max(r.read_start, r.read_end) + (r.node_len - r.ref_end if r.strand else r.ref_start) + r.tail
        go = ahead < enough
    return hit, r.read_len, go, r.read_len - counted


def read_until(chunks: DataFrame, enough: int) -> DataFrame:
    """A decision for each chunk of a stream (or of a table, as one batch)."""

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState):
        rows = pd.concat(list(frames)).sort_values("chunk", kind="stable")
        last, counted = None, 0
        if state.exists:
            *hit, counted = state.get
            last = None if hit[0] is None else tuple(hit)
        out = []
        for r in rows.itertuples(index=False):
            before = last
            last, counted, go, new = step(last, counted, r, enough)
            out.append((r.read_id, r.chunk, None if before is None else before[0], go, new))
        state.update((*(last or (None,) * 6), counted))
        yield pd.DataFrame(out, columns=["read_id", "chunk", "previous", "proceed", "new_bases"]).astype({"previous": "Int64"})

    return chunks.select(*CHUNK).groupBy("read_id").applyInPandasWithState(decide, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that is there, to a Parquet folder, and the stream ends: the last flush as well as a test. Files are committed exactly once."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


class ReportTrigger:
    """Whether a report is due: both enough seconds and enough reads since the last one; the last report of all always is."""

    def __init__(self, seconds: float = 10, reads: int = 50):
        self.seconds, self.reads = seconds, reads
        self.at: float | None = None
        self.seen = self.reported = 0

    def due(self, now: float, new_reads: int, final: bool = False) -> bool:
        self.at = now if self.at is None else self.at
        self.seen += new_reads
        if not final and (now - self.at < self.seconds or self.seen - self.reported < self.reads):
            return False
        self.at, self.reported = now, self.seen
        return True


def reporting(trigger: ReportTrigger, clock: Callable[[], float], key: str, report: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that counts the reads of each batch and reports on those batches where one is due."""

    def batch(rows: DataFrame, number: int) -> None:
        if trigger.due(clock(), rows.select(key).distinct().count()):
            report(rows, number)

    return batch


class VersionedTable:
    """A table that each micro-batch replaces, a folder a version in shared storage: a batch that is run again writes its own version again."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        """The rows of a version; before the first one none."""
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={version}")

    def update(self, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: the new version from the one before it and the batch."""
        return lambda rows, number: self.write(change(self.read(number - 1), rows), number)


def batched_reads(hits: DataFrame) -> DataFrame:
    """(read_id, first, hits) of a batch that holds whole reads: a read is complete when another one's hits follow."""
    return hits.groupBy("read_id").agg(F.min("hit_seq").alias("first"), F.count(F.lit(1)).alias("hits"))
