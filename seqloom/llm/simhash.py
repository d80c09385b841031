"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are the runs of SHINGLE space-separated words of a text (all words of a shorter one), weighted by how often they
occur; each term's 128-bit hash votes on the signed bits. The votes are kept as counts of ones, four counters in a long, and
summed by a hash aggregate whose first half runs where the text is read; no text is grouped.

`near_counts` finds all fingerprints within RADIUS bits. Texts with a Jaccard index of 0.75 have a cosine of 0.857 and differ in
22 bits on average (standard deviation 4.3), so RADIUS = 30 holds 97 % of such pairs and nearly all above. No table of equal
blocks is exact and selective at that radius, so every asked fingerprint meets every distinct one, in one compiled loop: the
corpus in chunks of CHUNK neighbours by value, the asked ones broadcast in parts of ASKED. Only chunks with a near
fingerprint make rows. The work grows with the square of the table (a twentieth of all pairs), the rows do not.

Defined cases: a null text is empty; a null doc_id comes first in order; rows of one doc_id are ordered by their text's
hash; a single row is its own next document; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_of, shuffle_partitions, with_free_name, written

SHINGLE, BITS, RADIUS = 5, 128, 30
#: Rows in a run of consecutive doc_ids, and the most runs.
RUN, RUNS = 2048, 8192
#: Fingerprints of the corpus that are compared in one row, and asked ones in a broadcast.
CHUNK, ASKED = 16, 1 << 18
LOW, HIGH = -(1 << 63), (1 << 63) - 1
SPAN, LANES = 1 << 15, 0x0001000100010001


def words_of(text: Column) -> Column:
    """Hashes of what stands between spaces; a pattern of one character needs no regular expression."""
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))


def votes(rows: DataFrame, hashes: str, keys: list[str], kept: list[str]) -> DataFrame:
    """Fingerprint (f1, f2) for each of keys of rows with an array of word hashes; kept: long columns to carry along.

    Ones are counted four bits to a long, in counters of 16 bits, over at most SPAN terms; the few texts of more terms than
    that have a row for each span, whose counters are then added apart.
    """
    at = rows.select(*keys, *kept, F.size(hashes).alias("_n"), F.col(hashes).alias("_h"), F.posexplode(hashes).alias("_i", "_w")).where(F.col("_i") <= F.greatest(F.col("_n") - SHINGLE, F.lit(0)))
    run = [F.get("_h", F.col("_i") + j) for j in range(SHINGLE)]
    at = at.select(*keys, *kept, "_n", F.floor(F.col("_i") / SPAN).alias("_span"), F.xxhash64(*run).alias("_a"), F.xxhash64(F.lit(7), *run).alias("_b"))
    sums = [F.sum(F.shiftrightunsigned(x, j).bitwiseAND(F.lit(LANES))).alias(f"{x}{j}") for x in ("_a", "_b") for j in range(16)]
    spans = at.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_total"), F.max("_n").alias("_n"), *[F.max(k).alias(k) for k in kept], *sums)
    counter = {(x, j): F.shiftrightunsigned(f"{x}{j % 16}", j - j % 16).bitwiseAND(F.lit(0xFFFF)) for x in ("_a", "_b") for j in range(64)}
    long_ones = spans.where(F.col("_n") > SPAN).groupBy(*keys).agg(F.sum("_total").alias("_total"), *[F.max(k).alias(k) for k in kept], *[F.sum(c).alias(f"{x}_{j}") for (x, j), c in counter.items()])

    def bits(of) -> list[Column]:
        out = []
        for x in ("_a", "_b"):
            ones = [F.when(2 * of(x, j) > F.col("_total"), F.lit(1 << j if j < 63 else LOW)).otherwise(F.lit(0)).cast("long") for j in range(64)]
            out.append(reduce(lambda p, q: p.bitwiseOR(q), ones))
        return [out[0].alias("f1"), out[1].alias("f2")]

    short = spans.where(F.col("_n") <= SPAN).select(*keys, *kept, *bits(lambda x, j: counter[x, j]))
    return short.unionByName(long_ones.select(*keys, *kept, *bits(lambda x, j: F.col(f"{x}_{j}"))))


def hex_of(a: str, b: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.col(a)), 16, "0"), F.lpad(F.hex(F.col(b)), 16, "0")))


def distance(a1, a2, b1, b2) -> Column:
    return F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) + F.bit_count(F.col(a2).bitwiseXOR(F.col(b2)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f1 and f2 of every row (equal rows once)."""
    rows = with_free_name(docs, "doc_id", "text").select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", words_of(F.coalesce("text", F.lit(""))).alias("h"))
    return votes(rows, "h", ["rk"], ["doc_id"]).select("doc_id", "f1", "f2")


def near_counts(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """(f1, f2, n_near) for each distinct query fingerprint: how many rows of prints lie within RADIUS bits."""
    n = shuffle_partitions(prints.sparkSession)
    distinct = prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(n, "f1", "f2").sortWithinPartitions("f1", "f2")
    placed = distinct.withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK)).repartition(n, "chunk")
    chunks = written(placed.groupBy("chunk").agg(*[F.collect_list(c).alias(c) for c in ("f1", "f2", "n")]), "chunks").repartition(n)
    asked = written(queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct(), "asked")
    parts = max(1, -(-asked.count() // ASKED))
    away = lambda i: F.bit_count(F.get("f1", i).bitwiseXOR(F.col("q1"))) + F.bit_count(F.get("f2", i).bitwiseXOR(F.col("q2")))
    nearest = F.least(*[away(F.lit(i)) for i in range(CHUNK)])  # places beyond the last are null, which least() skips
    near = F.aggregate(F.sequence(F.lit(0), F.size("f1") - 1), F.lit(0).cast("long"), lambda s, i: s + F.when(away(i) <= RADIUS, F.get("n", i)).otherwise(0))
    met = None
    for p in range(parts):
        part = chunks.join(F.broadcast(asked.where(F.pmod(F.xxhash64("q1", "q2"), F.lit(parts)) == p)), nearest <= RADIUS).select("q1", "q2", near.alias("n"))
        met = part if met is None else met.unionByName(part)
    return met.groupBy(F.col("q1").alias("f1"), F.col("q2").alias("f2")).agg(F.sum("n").alias("n_near"))


def in_order(docs: DataFrame) -> DataFrame:
    """rid (a row's name by place), next_rid, doc_id, text and next_text; the next of the last row is the first."""
    d = with_free_name(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(LOW)).alias("id"))
    seen = d.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).first()
    runs = max(1, min(RUNS, seen.n // RUN))
    bounds: list[int] = []
    if runs > 1:
        got = d.agg(F.percentile_approx("id", F.array(*[F.lit(i / runs) for i in range(1, runs)]), max(10_000, 20 * runs))).first()[0]
        bounds = sorted({b for b in got if b > seen.low})  # each is some row's id, so no run is empty
    k = len(bounds) + 1
    run = bucket_of(F.col("id"), bounds).cast("long")
    order = F.struct("id", F.xxhash64("text").alias("x"))
    keyed = d.withColumns({"run": run, "last": F.lit(False)})
    first = keyed.groupBy("run").agg(F.min_by("text", order).alias("text"))
    # each run ends with the first row of the next one, which only lends its text
    lent = first.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(HIGH).alias("id"), F.pmod(F.col("run") - 1, F.lit(k)).alias("run"), F.lit(True).alias("last"))
    w = Window.partitionBy("run").orderBy("last", "id", F.xxhash64("text"))
    rid = F.shiftleft(F.col("run"), 32) + F.row_number().over(w)
    placed = keyed.unionByName(lent).select("doc_id", "text", "last", "run", rid.alias("rid"), F.lead("text").over(w).alias("next_text"), F.lead("last").over(w).alias("at_end"))
    after = F.when(F.col("at_end"), F.shiftleft(F.pmod(F.col("run") + 1, F.lit(k)), 32) + 1).otherwise(F.col("rid") + 1)
    return placed.where(~F.col("last")).select("rid", after.alias("next_rid"), "doc_id", "text", "next_text")


def digest(docs: DataFrame) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = in_order(docs).select("rid", "next_rid", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    parts = {f"s{i}": F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)}
    rows = rows.withColumn("sha", sha).select("rid", "next_rid", "doc_id", "n_chars", *[c.alias(k) for k, c in parts.items()], F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("v"))
    rows = rows.select("rid", "next_rid", "doc_id", "n_chars", *parts, F.col("v.kind").alias("kind"), words_of(F.col("v.t")).alias("h"))
    both = written(votes(rows, "h", ["rid", "kind"], ["next_rid", "doc_id", "n_chars", *parts]), "fingerprints")
    own = both.where("kind = 0").drop("kind")
    edit = both.where("kind = 1").select("rid", F.col("f1").alias("e1"), F.col("f2").alias("e2"))
    after = own.select(F.col("rid").alias("next_rid"), F.col("f1").alias("x1"), F.col("f2").alias("x2"))
    asked = own.where("doc_id % 20 = 0")
    near = near_counts(own, asked).withColumn("asked", F.lit(True))
    like = lambda *c: 1 - distance(*c) / F.lit(float(BITS))
    sha_hex = F.lower(F.concat(*[F.lpad(F.hex(F.col(k)), 16, "0") for k in parts]))
    return (
        own.join(edit, "rid")
        .join(after, "next_rid")
        .withColumn("asked", F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False)))
        .join(near, ["f1", "f2", "asked"], "left")
        .select("doc_id", "n_chars", sha_hex.alias("edited_sha256"), hex_of("f1", "f2").alias("fingerprint"), hex_of("e1", "e2").alias("edited_fingerprint"), like("f1", "f2", "e1", "e2").alias("near_edited"), like("f1", "f2", "x1", "x2").alias("near_next"), "n_near")
    )
