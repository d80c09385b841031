"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of four fixed forms that pass their checks. Instances are all seed spans, whatever they hold (spaces as
well), and candidates: words with a digit or an @, with the number groups that follow, that no seed overlaps. A lexical pattern
is the word to the left of an instance (also one it is glued to: `key=...`), or that word and the one to its right together.
Over the graph of patterns and instances each round scores a pattern by the accepted instances it meets against all its
occurrences in the corpus (an instance not accepted yet counts UNKNOWN, a word that is no instance or one of another kind nothing),
and accepts the instances of good patterns: SUPPORT distinct accepted instances of a kind, score CONFIDENCE.
Rounds end when one accepts nothing new; sets only grow, so they do. Candidates that stand in a good pattern become spans of
its kind, and so do all others of the same text if CONFIDENCE of its occurrences stand in good ones; seed spans always stay.

Defined cases: a null text is empty; rows without spans have zero counts and empty strings; equal rows get equal results;
an empty table gives no rows; other columns are not read, whatever their names; of kinds that score the same the first listed
counts. Each pattern below matches in time linear in the text: repeats are possessive where nothing they could give back
would match, and a run of one class is tried once, from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, with_free_name, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [(]?[0-9][0-9().-]*+(?!\S))*+"
SUPPORT, CONFIDENCE, UNKNOWN = 3, 0.6, 0.5
MARKS = ".,;!?()[]{}<>\"'`*-_/|\\"
#: Marks that may open a value, after a word or alone, and white space.
MARKS_ONLY = "\"'`<([{"
OPENING = MARKS_ONLY + " \t\n\r\x0b\x0c"
#: Hashes by which words that may be patterns are told from others before they are counted: at least, for each pattern, at most.
WORD_BITS, BITS_EACH, MOST_BITS = 1 << 16, 8, 1 << 20


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a run of digits is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int")))
    return F.aggregate(F.filter(each, lambda v: v.isNotNull()), F.lit(0), lambda s, v: s + v) % 10 == 0


def holds(kind: Column, token: Column) -> Column:
    """The check of a match beyond its form."""
    number = lambda p: F.regexp_replace(p, "^0+", "")
    n = F.length(_digits(token))
    return (
        F.when(kind == 1, F.forall(F.split(token, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.lpad(number(p), 3, "0") <= "255")))
        .when(kind == 2, (n >= 14) & (n <= 19) & luhn(_digits(F.when(n <= 19, token))))
        .when(kind == 3, (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two names of the row."""
    d = with_free_name(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return d.withColumns({"rk": F.xxhash64("doc_id", "text"), "tk": F.xxhash64(F.lit(17), "text")})


def _last_word(text: Column) -> Column:
    """The word that text ends with, before white space and opening marks; where it has no letter, the word before it as well."""
    end = F.rtrim(F.regexp_replace(F.rtrim(text, F.lit(OPENING)), r"\s+", " "))
    one, two = F.substring_index(end, " ", -1), F.substring_index(end, " ", -2)
    return F.when(one.rlike(r"\p{L}"), one).otherwise(two)


def _left(gap: Column) -> Column:
    """The left context word of what follows gap; only where it fills the last 200 characters is the whole gap looked at."""
    near = F.right(gap, F.lit(200))
    return F.when((F.length(gap) <= 200) | (F.length(_last_word(near)) <= 100), _last_word(near)).otherwise(_last_word(gap))


def _right(gap: Column) -> Column:
    """The first whole word of what comes after an instance's own token."""
    return F.regexp_extract(gap, r"^\S*+\s++(\S++)", 1)


def matches(rows: DataFrame) -> DataFrame:
    """(rk, tk, kind, i, gap, token, left, right, glued, start, stop) of all matches; kind 4 is a candidate. glued: nothing but opening marks stands between the left word and the match."""
    none = F.array().cast("array<string>")
    found = rows.where(F.col("text").rlike("[0-9@]"))
    found = found.withColumns(
        {
            "m0": F.when(F.contains("text", F.lit("@")), F.regexp_extract_all("text", F.lit(PATTERNS["email"]), F.lit(0))).otherwise(none),
            "m1": F.regexp_extract_all("text", F.lit(PATTERNS["ip"]), F.lit(0)),
            "m2": F.regexp_extract_all("text", F.lit(PATTERNS["card"]), F.lit(0)),
            "m3": F.when(F.contains("text", F.lit("+")), F.regexp_extract_all("text", F.lit(PATTERNS["phone"]), F.lit(0))).otherwise(none),
            "m4": F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)),
        }
    )
    shape = "array<struct<kind:int,i:int,gap:int,token:string,left:string,right:string,glued:boolean>>"

    def listed(k: int, pattern: str) -> Column:
        m, gaps = F.col(f"m{k}"), F.split("text", pattern, -1)
        sound = (lambda t: F.lit(True)) if k == 4 else (lambda t: holds(F.lit(k), t))

        def one(x, i):
            there = sound(x["t"])  # the context of a match that fails is of no use
            glued = ~F.rtrim(x["g"], F.lit(MARKS_ONLY)).rlike(r"(^|\s)\z")
            return F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), x["t"].alias("token"), F.when(there, _left(x["g"])).alias("left"), F.when(there, _right(x["n"])).alias("right"), F.when(there, glued).alias("glued"))

        zipped = F.arrays_zip(gaps.alias("g"), m.alias("t"), F.slice(gaps, F.lit(2), F.size(m)).alias("n"))
        return F.when(F.size(m) > 0, F.transform(F.slice(zipped, F.lit(1), F.size(m)), one)).otherwise(F.array().cast(shape))

    every = F.concat(*[listed(k, p) for k, p in enumerate([*PATTERNS.values(), CANDIDATE])])
    flat = found.select("rk", "tk", F.explode(every).alias("x")).select("rk", "tk", "x.*").dropDuplicates(["rk", "tk", "kind", "i"])
    run = Window.partitionBy("rk", "tk", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("token")
    stop = F.sum(F.col("gap").cast("long") + size).over(run)
    placed = flat.withColumn("stop", stop).withColumn("start", F.col("stop") - size)
    return placed.where(F.col("glued").isNotNull())


def _clean(word: Column) -> Column:
    """A word as a context: lower case, without the marks around it but for those that end a label (: = #)."""
    return F.btrim(F.lower(word), F.lit(MARKS))


def _letters(word: Column) -> Column:
    """A cleaned word, or null where it has no letter."""
    return F.when(word.rlike(r"\p{L}"), _clean(word))


def _patterns(left: Column, right: Column) -> Column:
    """The patterns of an instance: its left context, and left and right together."""
    some = F.length(left) > 0
    return F.array_compact(F.array(F.when(some, F.concat(F.lit("l "), left)), F.when(some & right.isNotNull(), F.concat(F.lit("b "), left, F.lit("|"), right))))


def instances(found: DataFrame) -> DataFrame:
    """(rk, tk, start, stop, value, seed, glued, patterns): all seed spans, and candidates that no seed span overlaps (seed is null)."""
    by = Window.partitionBy("rk", "tk").orderBy("start", "kind")
    seed = F.when(F.col("kind") < 4, F.struct(F.col("stop").alias("at")))
    ahead = F.when(F.col("kind") < 4, F.struct(F.col("start").alias("at")))
    met = found.withColumns({"p": F.max(seed).over(by.rowsBetween(Window.unboundedPreceding, 0)), "f": F.min(ahead).over(by.rowsBetween(0, Window.unboundedFollowing))})
    label = F.regexp_extract("token", r"^[^0-9@]*[=:]", 0)
    rest = F.substring(F.col("token"), F.length(label) + 1, F.length("token"))
    lead = F.regexp_extract(rest, r"^[^\p{L}0-9+@]*", 0)
    bare = F.regexp_replace(F.substring(rest, F.length(lead) + 1, F.length(rest)), r"(?<![^\p{L}0-9])[^\p{L}0-9]+$", "")
    own = _clean(F.regexp_replace(label, r"^[^\p{L}]*(?=\p{L})", ""))
    cands = met.where("kind = 4").where(~F.coalesce(F.col("p.at") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("f.at") < F.col("stop"), F.lit(False)))
    cands = cands.select("rk", "tk", (F.col("start") + F.length(label) + F.length(lead)).alias("start"), bare.alias("value"), F.lit(None).cast("int").alias("seed"), (F.length(own) > 0).alias("glued"), F.when(F.length(own) > 0, own).otherwise(_clean(F.col("left"))).alias("l"), _letters(F.col("right")).alias("r"))
    seeds = met.where("kind < 4").select("rk", "tk", "start", F.col("token").alias("value"), F.col("kind").alias("seed"), "glued", _clean(F.col("left")).alias("l"), _letters(F.col("right")).alias("r"))
    both = seeds.unionByName(cands.where(F.col("value") != "")).withColumn("stop", F.col("start") + F.length("value"))
    return both.select("rk", "tk", "start", "stop", "value", "seed", "glued", _patterns(F.col("l"), F.col("r")).alias("patterns"))


def _bit(pattern: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(pattern), F.lit(bits))


def _marked(patterns: DataFrame) -> bytes:
    """A byte for each of WORD_BITS to MOST_BITS hashes, BITS_EACH or more a pattern up to there, 1 where a pattern has it."""
    bits = WORD_BITS
    for _ in range(max(0, (patterns.count() * BITS_EACH - 1).bit_length() - (bits - 1).bit_length())):
        bits = min(2 * bits, MOST_BITS)
    bit = _bit(F.col("pattern"), bits)
    words = patterns.groupBy(F.floor(bit / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("b")).collect()  # MOST_BITS / 64 rows at most
    out = bytearray(bits)
    for r in words:
        for j in range(64):
            out[64 * r.i + j] = r.b >> j & 1
    return bytes(out)


def _totals(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each pattern stand anywhere in the corpus, with whatever word after them (with no
    identifier-like word, for those of two contexts: such words are instances and are counted there). A table of hashes drops most others
    early, first words by themselves: where a pattern of two contexts has support, so has its left one. Words are rows at once, for
    expressions over rows are compiled and those over arrays' elements are not; the table's test names its word once, as it is put in its place."""
    marked = _marked(patterns)
    if not any(marked):
        return patterns.select("pattern", F.lit(0).cast("long").alias("total"))
    may = lambda p: F.substring(F.lit(marked), (_bit(p, len(marked)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
    words = rows.select(F.split(F.lower("text"), r"\s+").alias("w"))
    later = lambda n: F.slice("w", F.lit(n + 1), F.size("w"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("w"))
    each = words.select(F.explode(F.arrays_zip(F.col("w"), before.alias("p"), later(1).alias("n"), later(2).alias("a"))).alias("x")).select("x.*").where("w is not null")
    context = F.btrim(F.when(F.col("w").rlike(r"\p{L}"), F.col("w")).otherwise(F.concat_ws(" ", "p", "w")), F.lit(MARKS))
    some = each.select(context.alias("l"), "n", "a").where(may(F.concat(F.lit("l "), F.col("l"))))
    right = F.when(~F.col("n").rlike("[0-9@]"), _letters(F.col("a")))
    at = some.select(F.explode(_patterns(F.col("l"), right)).alias("pattern"))
    return at.where(may(F.col("pattern"))).groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))


def bootstrapped(rows: DataFrame, occ: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, score) of the good patterns and (value, kind) of the accepted instances, once a round adds none."""
    edges = occ.select("value", "seed", "glued", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("glued") | F.startswith("pattern", F.lit("b "))).alias("apart"), F.min("seed").alias("seed"))
    edges = written(edges, "edges")
    # a pattern of fewer instances of any sort can't be good in any round; SUPPORT of accepted ones is asked for in each
    support = written(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("k"), F.sum("apart").alias("apart"), F.sum("n").alias("n")).where(F.col("k") >= SUPPORT).select("pattern", "apart", "n"), "support")
    totals = support.join(_totals(rows, support.select("pattern")), "pattern", "left").select("pattern", F.greatest(F.col("apart") + F.coalesce("total", F.lit(0)), "n").alias("total"))  # a context may be no word of the text by itself
    edges = written(edges.drop("apart").join(totals, "pattern"), "edges")
    sure = written(occ.where("seed is not null").groupBy("value").agg(F.min("seed").alias("kind")), "sure")
    size, good = sure.count(), None
    while True:
        met = edges.join(sure, "value", "left").groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.count(F.lit(1)).alias("k"))
        unknown = F.coalesce(F.max(F.when(F.col("kind").isNull(), F.col("n"))).over(Window.partitionBy("pattern")), F.lit(0))  # at most five rows a pattern
        scored = met.withColumn("score", (F.col("n") + UNKNOWN * unknown) / F.col("total")).where("kind is not null")
        fine = scored.where((F.col("k") >= SUPPORT) & (F.col("score") >= CONFIDENCE))
        good = written(fine.groupBy("pattern").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m")).select("pattern", (-F.col("m.k")).alias("kind"), F.col("m.score").alias("score")), "good")
        new = edges.join(good, "pattern").join(sure.select("value"), "value", "left_anti").groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m")).select("value", (-F.col("m.k")).cast("int").alias("kind"))
        sure = written(sure.unionByName(new), "sure")
        if (more := sure.count()) == size:
            return good, sure
        size = more


def discovered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(rk, tk, kind, start, stop) of candidates in good patterns, and of all others of the same value where CONFIDENCE of its occurrences are in good ones."""
    occ = written(instances(found), "instances")
    good, _ = bootstrapped(rows, occ)
    left = occ.where("seed is null").select("rk", "tk", "start", "stop", "value", "patterns")
    best = F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m")
    met = left.withColumn("pattern", F.explode("patterns")).join(good, "pattern").groupBy("rk", "tk", "start", "stop", "value").agg(best).select("rk", "tk", "start", "stop", "value", (-F.col("m.k")).cast("int").alias("kind"), F.lit(True).alias("inside"))
    met = written(met, "met")
    of = met.groupBy("value").agg(F.count(F.lit(1)).alias("k"), F.mode("kind", deterministic=True).alias("most"))
    every = left.join(of.select("value"), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    whole = of.join(every, "value").where(F.col("k") >= CONFIDENCE * F.col("n")).select("value", F.col("most").alias("kind"))
    rest = left.drop("patterns").join(whole, "value").select("rk", "tk", "start", "stop", "value", "kind", F.lit(False).alias("inside"))
    both = met.unionByName(rest).groupBy("rk", "tk", "start", "stop").agg(F.max_by("kind", F.struct("inside", (-F.col("kind")).alias("k"))).alias("kind"))
    return both.select("rk", "tk", "kind", "start", "stop")


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with their names, and (rk, tk, kind, start, stop, base) of all spans; code points, stop exclusive."""
    rows = named(docs)
    found = matches(rows)
    found = written(found, "matches")
    base = found.where("kind < 4").select("rk", "tk", "kind", "start", "stop", F.lit(True).alias("base"))
    return rows, base.unionByName(discovered(rows, found).withColumn("base", F.lit(False)))


def digest(docs: DataFrame) -> DataFrame:
    rows, found = spans(docs)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    one = F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("stop").cast("string")).alias("s"), "base")
    per = found.groupBy("rk", "tk").agg(F.array_sort(F.collect_list(one)).alias("v"), *[F.count_if((F.col("kind") == i) & F.col("base")).alias(f"n_{k}") for i, k in enumerate(KINDS)])
    joined = lambda v: F.array_join(F.transform(v, lambda x: x["s"]), ",")
    per = per.select("rk", "tk", *[f"n_{k}" for k in KINDS], joined(F.filter("v", lambda x: x["base"])).alias("b"), joined(F.col("v")).alias("spans"))
    out = rows.select("doc_id", "rk", "tk").join(per, ["rk", "tk"], "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce("b", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each span of the text replaced by <KIND>; of overlapping spans the first, and what goes beyond it."""
    _, found = spans(docs)
    by = Window.partitionBy("rk", "tk").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    tag = F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), F.col("kind") + 1)
    free = found.withColumn("seen", F.coalesce(F.max("stop").over(by), F.lit(0))).where("stop > seen").withColumn("from", F.greatest("start", "seen"))
    rk, tk, v, a, b = free_names(docs, "_rk", "_tk", "_v", "_a", "_b")
    per = free.groupBy(F.col("rk").alias(rk), F.col("tk").alias(tk)).agg(F.array_sort(F.collect_list(F.struct(F.col("from").alias("a"), F.col("seen").alias("p"), F.col("stop").alias("z"), tag.alias("tag")))).alias(v))
    text = F.col("text")
    part = lambda x: F.concat(F.substring(text, (x["p"] + 1).cast("int"), (x["a"] - x["p"]).cast("int")), x["tag"])
    last = F.element_at(v, -1)["z"]
    done = F.concat(F.array_join(F.transform(v, part), ""), F.substring(text, (last + 1).cast("int"), F.length(text)))
    keyed = docs.withColumns({a: F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), b: F.xxhash64(F.lit(17), F.coalesce("text", F.lit("")))})
    out = keyed.join(per, (F.col(a) == F.col(rk)) & (F.col(b) == F.col(tk)), "left")
    return out.select(*[F.when(F.col(v).isNotNull(), done).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
