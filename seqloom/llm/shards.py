"""Sharding by histogram sort: exact byte counts below probe keys, refined until the splitters hold, then one exchange.

A row's key is (hash of its text, doc_id), so equal texts lie side by side and share a shard unless their group alone is
too large for the tolerance; such a group is cut between doc_ids. Law "bytes": shard sizes are near equal.

The same rounds of probes that place the splitters of the shards also cut each shard into runs of about RUN_BYTES (more runs than
partitions in any case), a group of equal texts that is larger than a run between its doc_ids. Rows then go once to the
partition of their run, by its number, and are put in order there: runs in order are the sorted whole.

Defined cases: a null text counts 0 bytes plus 1; a null doc_id sorts first; rows that are equal in text and doc_id stay
together; an empty table gives no rows; columns other than doc_id and text are not read by assign and carried along by
exchange, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_of, free_names, shuffle_partitions, with_free_name, written

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Probes counted for each open splitter and round; a splitter is good once its bytes are within TOLERANCE of a shard's.
PROBES, TOLERANCE = 64, 0.002
#: Bytes of texts in a run, and the most runs (their bounds are an array in the plan: half a megabyte).
RUN_BYTES, RUNS = 64 << 20, 1 << 15


def skinny(docs: DataFrame) -> DataFrame:
    """key, id, size and crc of each row, without the text: all that splitters need."""
    d = with_free_name(docs, "doc_id", "text")
    return d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text")).alias("key"),
        F.coalesce(F.col("doc_id"), F.lit(LOW)).alias("id"),
    )


def _counts(rows: DataFrame, column: str, bounds: list[int]) -> list[int]:
    """Bytes in each gap between sorted bounds: a row for each gap and task, summed."""
    out = [0] * (len(bounds) + 1)
    for r in rows.groupBy(bucket_of(F.col(column), bounds).alias("g")).agg(F.sum("size").alias("b")).collect():  # a row for each gap
        out[r.g] = r.b
    return out


def refine(rows: DataFrame, column: str, targets: dict[int, float]) -> dict[int, tuple[int, int, int, int]]:
    """For each target (bytes below) and its tolerance, the bracketing boundaries (key, bytes below, next key, bytes below it).

    A boundary k means: rows with column < k lie below. Rounds end when a boundary is within tolerance or the bracket holds one key only.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not total.n:
        return {}
    known: dict[int, int] = {total.lo: 0, total.hi + 1: total.b}
    while True:
        points = sorted(known)
        below = [known[p] for p in points]
        open_, out = [], {}
        for t, tolerance in targets.items():
            i = min(max(bisect_right(below, t) - 1, 0), len(points) - 2)
            a, b = points[i], points[i + 1]
            out[t] = (a, known[a], b, known[b])
            if min(t - known[a], known[b] - t) > tolerance and b - a > 1:
                open_.append((a, b))
        brackets = set(open_)
        if not brackets:
            return out
        probes: set[int] = set()
        for a, b in brackets:  # targets of one bracket share its probes
            step = max(1, (b - a) // (max(PROBES, 2 * open_.count((a, b))) + 1))
            probes.update(range(a + step, b, step))
        new = sorted(probes)
        sums = _counts(rows, column, new)
        at = 0
        for p, g in zip(new, sums, strict=False):
            at += g
            known[p] = at


def splitters(rows: DataFrame, n_shards: int, tolerance: float = TOLERANCE, n_runs: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """n_shards - 1 boundaries (key, id), and all boundaries of the runs, those of the shards among them."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return [(HIGH, HIGH)] * (n_shards - 1), [(HIGH, HIGH)] * (n_shards - 1)
    n_runs = n_runs or min(RUNS, max(2 * n_shards, 2 * shuffle_partitions(rows.sparkSession), -(-total // RUN_BYTES)))
    shards = [total * i // n_shards for i in range(1, n_shards)]
    targets = {total * i // n_runs: 0.25 * total / n_runs for i in range(1, n_runs)} | {t: tolerance * total / n_shards for t in shards}
    cuts, hot = {}, {}
    for t, (a, ba, b, bb) in refine(rows, "key", targets).items():
        if min(t - ba, bb - t) <= targets[t]:
            cuts[t] = (a, LOW) if t - ba <= bb - t else (b, LOW)
        else:  # one key holds more bytes than the tolerance: cut it between ids
            hot.setdefault(a, []).append((t, ba))
    for key, wanted in hot.items():
        inside = refine(rows.where(F.col("key") == key), "id", {t - base: 0 if t in shards else targets[t] for t, base in wanted})
        for t, base in wanted:
            a, ba, b, bb = inside[t - base]
            cuts[t] = (key, a) if (t - base) - ba <= bb - (t - base) else (key, b)
    return [cuts[t] for t in shards], sorted(set(cuts.values()))


def _count_below(pairs: list[tuple[int, int]], key: str = "key", ident: str = "id") -> Column:
    """How many of the sorted (key, id) boundaries are at or below a row."""
    keys = [k for k, _ in pairs if k <= HIGH]
    at_key = bucket_of(F.col(key), keys)
    ties: dict[int, list[int]] = {}
    for k, i in pairs:
        if k <= HIGH:
            ties.setdefault(k, []).append(i)
    inside = []
    for k, ids in ties.items():
        if any(i > LOW for i in ids):  # inside this key only the boundaries up to the row's id count
            own = sum((F.when(F.col(ident) >= F.lit(i), 1).otherwise(0) for i in ids if i <= HIGH), F.lit(0)) if len(ids) <= 16 else bucket_of(F.col(ident), [i for i in ids if i <= HIGH])
            inside.append(F.when(F.col(key) == k, at_key - len(ids) + own))
    return F.coalesce(*inside, at_key)


def _dealt(rows: DataFrame, cuts: list[tuple[int, int]], runs: list[tuple[int, int]], shard: str, run: str) -> DataFrame:
    """rows (with key and id) with their shard and run, each run in its own partition: the one exchange."""
    placed = rows.withColumns({shard: _count_below(cuts).cast("int"), run: _count_below(runs).cast("int")})
    return placed.repartitionById(len(runs) + 1, run)


def assign(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the row's place in its shard, gapless from 0) of every row."""
    rows = written(skinny(docs), "shard-keys")
    cuts, runs = splitters(rows, n_shards, tolerance)
    place = F.row_number().over(Window.partitionBy("run").orderBy("key", "id", "size", "text_crc32"))
    placed = written(_dealt(rows, cuts, runs, "shard", "run").withColumn("place", place).drop("key", "id"), "shard-runs")
    sizes = placed.groupBy("run").agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("n"))  # a row for each run
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")
    return placed.join(F.broadcast(sizes.select("run", first.alias("first"))), "run").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def exchange(docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """docs, all columns, moved once: a partition holds one run of one shard in key order, runs follow each other; the shard is in the column `shard` (`_shard` where docs has one)."""
    rows = written(skinny(docs), "shard-keys")
    cuts, runs = splitters(rows, n_shards, tolerance)
    key, ident, run, shard = free_names(docs, "_key", "_id", "_run", "shard")
    keyed = docs.withColumns({key: F.xxhash64(F.col("text")), ident: F.coalesce(F.col("doc_id"), F.lit(LOW))})
    placed = keyed.withColumns({shard: _count_below(cuts, key, ident).cast("int"), run: _count_below(runs, key, ident).cast("int")})
    return placed.repartitionById(len(runs) + 1, run).sortWithinPartitions(key, ident).drop(key, ident, run)
