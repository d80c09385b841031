"""Shared folder, written tables and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RUN = uuid.uuid4().hex[:12]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: tables between stages need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom-{_RUN}/{label}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # what this write shuffled is of no more use after it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    if path.rsplit("/", 1)[0] not in _written:
        _written.add(path.rsplit("/", 1)[0])
        atexit.register(_remove, spark, path.rsplit("/", 1)[0])
    return spark.read.schema(df.schema).parquet(path)


_written: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """At the driver's end the tables of this run go, if the session still stands."""
    try:
        if spark.sparkContext._jsc is not None:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended first; its folder is the cluster's to clean
        pass


def lean(run: Callable, *forget: Callable[[], None]) -> Callable:
    """run, a function over Arrow batches, whose task gives its memory back at its end: Python workers outlive their tasks,
    and what they keep counts against the executor while other tasks run. forget: calls that drop what run remembers."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            for drop in forget:
                drop()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own rules
                pass

    return task


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        while s.lower() in taken:
            s = "_" + s
        taken.add(s.lower())
        out.append(s)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def row_name() -> Column:
    """A row's name by id and text, so that null and repeated ids are told apart; equal rows share it."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def with_free_name(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns a digest needs, so that extra columns of any name can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below or equal to value: a binary search as one expression."""
    if not bounds:
        return F.lit(0)
    n = len(bounds)
    steps = n.bit_length()
    arr = F.expr(f"from_json('[{','.join(str(int(b)) for b in bounds)}]', 'array<bigint>')")  # folded to a literal
    # lo = count of bounds known to be <= value; halving steps from the top bit down
    return F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]),
        F.lit(0),
        lambda lo, s: F.when((lo + s <= n) & (F.get(arr, F.least(lo + s - 1, F.lit(n - 1))) <= value), lo + s).otherwise(lo),
    )
