"""Text formats as DataFrames. parse_* turn lines (value, or a record a row) into tables and format_* turn tables into lines; read_* and
write_* are these over files. Coordinates become 1-based inclusive. A record, like any string, is bounded by what one row of Spark holds (2 GB).
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.columns import KMER, canonical_edge

SYMBOLS = "ACGTUNRYKMSWBDHV"


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def _int(i: int) -> Column:
    return F.expr(f"try_cast(get(f, {i}) as int)")


def _fields(lines: DataFrame, separator: str = "\t") -> DataFrame:
    return lines.select("value", F.split("value", separator).alias("f"))


def _tag(name: str) -> Column:
    """The value of an optional tag NAME:type:value of a line, else null."""
    return F.nullif(F.regexp_extract("value", rf"\t{name}:[a-zA-Z]:([^\t]+)", 1), F.lit(""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, desc and seq of each record; records are split where a line begins with >."""
    raw = spark.read.option("lineSep", "\n>").text(path).where("length(trim(value)) > 0")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return raw.select(F.substring_index(head, " ", 1).alias("name"), F.regexp_replace(head, r"^\S+\s*", "").alias("desc"), body.alias("seq"))


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    name = F.concat(F.lit(">"), F.col("name"), F.when(F.length("desc") > 0, F.concat(F.lit(" "), F.replace("desc", F.lit("\n"), F.lit(";")))).otherwise(F.lit("")))
    rows.select(F.concat(name, F.lit("\n"), F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))).alias("value")).write.text(path)


def parse_gfa(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node_id, seq, kc, cov), edges (n0, d0, n1, d1, overlap) and paths (name, steps); headers, containments and comments are skipped."""
    f = _fields(lines)
    nodes = f.where("f[0] = 'S'").select(_at(1).alias("node_id"), _at(2).alias("seq"), _tag("KC").cast("long").alias("kc"), F.coalesce(_tag("df"), _tag("dp")).cast("double").alias("cov"))
    edges = f.where("f[0] = 'L'").select(_at(1).alias("n0"), (_at(2) == "+").alias("d0"), _at(3).alias("n1"), (_at(4) != "+").alias("d1"), F.nullif(F.regexp_extract(_at(5), "^([0-9]+)", 1), F.lit("")).cast("int").alias("overlap"))
    paths = f.where("f[0] = 'P'").select(_at(1).alias("name"), parse_steps(_at(2)).alias("steps"))
    return nodes, edges, paths


def overlap_of(edges: DataFrame) -> int | None:
    """K of a graph: its least overlap; null without links."""
    return edges.agg(F.min("overlap")).first()[0]


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges, _ = parse_gfa(spark.read.text(path))
    return nodes, edges


def read_gfa_paths(spark: SparkSession, path: str) -> DataFrame:
    return parse_gfa(spark.read.text(path))[2]


def format_gfa(nodes: DataFrame, edges: DataFrame, k: int = KMER) -> DataFrame:
    """Lines of a graph: segments with count and bin, then links."""
    s = nodes.select(F.concat(F.lit("S\t"), "node_id", F.lit("\t"), "seq", F.lit("\tKC:i:"), F.coalesce("kc", F.lit(0)).cast("string"), F.lit("\tBI:i:"), F.coalesce("bin", F.lit(0)).cast("string")).alias("value"))
    sign = lambda c, plus: F.when(c, plus).otherwise("-" if plus == "+" else "+")
    l = edges.select(F.concat_ws("\t", F.lit("L"), "n0", sign(F.col("d0"), "+"), "n1", sign(F.col("d1"), "-"), F.lit(f"{k}M")).alias("value"))
    return s.unionByName(l)


def parse_steps(text: Column) -> Column:
    """Path text 1+,2-,3+ as an array of (node, forward)."""
    return F.transform(F.filter(F.split(text, ","), lambda x: x.rlike("[+-]$")), lambda x: F.struct(F.rtrim(x, F.lit("+-")).alias("node"), F.endswith(x, F.lit("+")).alias("forward")))


def format_steps(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda x: F.concat(x["node"], F.when(x["forward"], "+").otherwise("-"))), ",")


def known_steps(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, pos, node, forward) of paths (path, steps) up to the first step that no edge of the graph leads to."""
    at = paths.select("path", "steps", F.posexplode("steps").alias("pos", "x")).withColumn("prev", F.get("steps", F.col("pos") - 1))
    text = lambda a, ao, b, bo: canonical_edge(a, ao, b, bo)
    here = edges.select(text(F.col("n0").cast("string"), F.col("d0"), F.col("n1").cast("string"), F.col("d1")).alias("edge")).distinct().withColumn("known", F.lit(True))
    keyed = at.withColumn("edge", text(F.col("prev.node"), F.col("prev.forward"), F.col("x.node"), ~F.col("x.forward"))).join(here, "edge", "left")
    ok = F.min(F.when((F.col("pos") == 0) | F.col("known"), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("pos"))
    return keyed.withColumn("ok", ok).where("ok = 1").select("path", "pos", F.col("x.node").alias("node"), F.col("x.forward").alias("forward"))


def parse_fastg(records: DataFrame, opposite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, name, seq, cov) and distinct edges of FASTA records (name, seq) whose names are EDGE_1_length_L_cov_C['][:neighbours;].

    A quote marks the reverse strand. opposite: the scaffolder's convention, in which a neighbour without a quote is entered outward.
    """
    clean = lambda x: F.regexp_replace(x, "[^a-zA-Z0-9_.]", "")
    r = records.select(F.split("name", ":").alias("p"), "seq").select(F.col("p")[0].alias("head"), F.get("p", F.lit(1)).alias("rest"), "seq")
    r = r.select(clean(F.col("head")).alias("name"), (~F.contains("head", F.lit("'"))).alias("d0"), "rest", "seq").withColumn("node_id", F.split("name", "_")[1])
    nodes = r.where("d0").select("node_id", "name", "seq", F.expr("try_cast(get(split(name, '_'), 5) as double)").alias("cov"))
    e = r.where("rest is not null").select("node_id", "d0", F.explode(F.split("rest", ",")).alias("nb")).where("nb rlike '[a-zA-Z0-9]'")
    quoted = F.contains("nb", F.lit("'"))
    edges = e.select(F.col("node_id").alias("n0"), "d0", F.split(clean(F.col("nb")), "_")[1].alias("n1"), (~quoted if opposite else quoted).alias("d1"))
    return nodes, edges.withColumn("edge", canonical_edge(F.col("n0"), F.col("d0"), F.col("n1"), F.col("d1"))).dropDuplicates(["edge"])


def read_fastg(spark: SparkSession, path: str, opposite: bool = False) -> tuple[DataFrame, DataFrame]:
    rows = read_fasta(spark, path)
    return parse_fastg(rows.select(F.concat_ws("", "name", "desc").alias("name"), "seq"), opposite)


def parse_dot(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, src_forward, dst, dst_forward, dist) of a DOT graph of contigs, and a row with its K (null without one): dist is minus K where not given."""
    k = lines.select(F.nullif(F.regexp_extract("value", r"^\s*edge\s*\[d=-([0-9]+)\]", 1), F.lit("")).cast("int").alias("k")).agg(F.max("k").alias("k"))
    rule = r'"([^"]+)([+-])"\s*->\s*"([^"]+)([+-])"(?:\s*\[d=(-?[0-9]+)[^\]]*\])?'
    part = lambda i: F.regexp_extract("value", rule, i)
    e = lines.where(F.col("value").rlike(rule)).select(part(1).alias("src"), (part(2) == "+").alias("src_forward"), part(3).alias("dst"), (part(4) == "+").alias("dst_forward"), F.nullif(part(5), F.lit("")).cast("int").alias("d"))
    return e.crossJoin(F.broadcast(k)).select("src", "src_forward", "dst", "dst_forward", F.coalesce("d", -F.col("k")).alias("dist")), k


def parse_path_blocks(blocks: DataFrame) -> DataFrame:
    """(name, part, steps) of blocks of a paths file, each a NODE... header and the lines below it; blocks of reverse strands (a quote) are left out; a semicolon ends a part."""
    head = F.trim(F.substring_index("value", "\n", 1))
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    b = blocks.select(F.when(F.startswith(head, F.lit("NODE")), head).otherwise(F.concat(F.lit("NODE"), head)).alias("name"), body.alias("body")).where("length(body) > 0")
    parts = b.where(~F.contains("name", F.lit("'"))).select("name", F.posexplode(F.filter(F.split("body", ";"), lambda x: x != "")).alias("part", "x"))
    return parts.select("name", "part", parse_steps(F.col("x")).alias("steps"))


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return parse_path_blocks(spark.read.option("lineSep", "NODE").text(path))


def parse_paf(lines: DataFrame) -> DataFrame:
    """Hits of lines with twelve columns or more; 0-based half-open coordinates become 1-based inclusive."""
    f = _fields(lines).where("size(f) >= 12")
    return f.select(_at(0).alias("read_id"), _int(1).alias("read_len"), (_int(2) + 1).alias("read_start"), _int(3).alias("read_end"), (_at(4) == "+").alias("strand"), _at(5).alias("node_id"), _int(6).alias("ref_len"), (_int(7) + 1).alias("ref_start"), _int(8).alias("ref_end"), _int(9).alias("matches"), _int(11).alias("mapq"), F.coalesce(_tag("cg"), F.lit("")).alias("cigar"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return parse_paf(spark.read.text(path))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Mapped records: read_id, flag, node_id, ref_start, ref_end, mapq, cigar, seq, qual, strand, prime, score (AS, else the aligned bases of the contig); header lines and unmapped ones go."""
    f = _fields(lines.where("value not like '@%'")).where("size(f) >= 11")
    flag = _int(1)
    r = f.select(_at(0).alias("read_id"), flag.alias("flag"), _at(2).alias("node_id"), _int(3).alias("ref_start"), _int(4).alias("mapq"), _at(5).alias("cigar"), _at(9).alias("seq"), _at(10).alias("qual"), (flag.bitwiseAND(F.lit(16)) == 0).alias("strand"), (flag.bitwiseAND(F.lit(256)) == 0).alias("prime"), _tag("AS").cast("int").alias("as_score"))
    r = r.where((F.col("flag").bitwiseAND(F.lit(4)) == 0) & (F.col("node_id") != "*"))
    on_ref = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
    return r.withColumn("ref_end", F.col("ref_start") + on_ref - 1).withColumn("score", F.coalesce("as_score", F.col("ref_end") - F.col("ref_start") + 1)).drop("as_score")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def parse_fastq(records: DataFrame) -> DataFrame:
    """(name, seq, qual) of texts of four lines each."""
    f = records.select(F.split("value", "\r?\n").alias("f"))
    return f.where("size(f) >= 4 and f[0] like '@%' and f[2] like '+%'").select(F.substring_index(F.expr("substring(f[0], 2)"), " ", 1).alias("name"), _at(1).alias("seq"), _at(3).alias("qual"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(file, n, value) of spark.read.text: each line's number in its file, from 0. A block's lines follow each other in one task, so only the blocks' counts are put in order."""
    at = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    blocks = at.groupBy("file", "block").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    base = blocks.select("file", "block", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("base"))
    return at.join(base, ["file", "block"]).select("file", (F.col("base") + F.col("i") - F.col("first")).alias("n"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines: quality lines may begin with any mark, so lines are numbered, not recognised."""
    at = numbered_lines(spark.read.text(path))
    line = F.struct((F.col("n") % 4).alias("i"), "value")
    return parse_fastq(at.groupBy("file", F.floor(F.col("n") / 4).alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["value"]), "\n").alias("value")))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one read named READ."""
    return spark.read.text(path, wholetext=True).select(F.lit("READ").alias("name"), F.upper(F.regexp_replace("value", r"\s", "")).alias("seq"))


def sniff(path: str) -> str:
    """Format of a local file by its first bytes: fasta, fastq, sam, jsa, gfa or raw; gzip is looked through."""
    with open(path, "rb") as f:
        head = f.read(2)
    with (gzip.open if head == b"\x1f\x8b" else open)(path, "rb") as f:
        head = f.read(64)
    if head.startswith(b"#JSA"):
        return "jsa"
    if head[:1] == b"@":
        return "sam" if head[1:4] in (b"HD\t", b"SQ\t", b"RG\t", b"PG\t", b"CO\t") else "fastq"
    if head[:1] == b">":
        return "fasta"
    return "gfa" if head[:2] in (b"H\t", b"S\t") else "raw"


def valid_symbols(seq: Column, symbols: str = SYMBOLS) -> Column:
    """Whether all letters of a sequence belong to the alphabet, in either case."""
    return ~seq.rlike(f"[^{symbols}{symbols.lower()}]")


def parse_jsa(records: DataFrame) -> DataFrame:
    """(id, length, alphabet, seq, features) of records that begin with #JSA:id:length:alphabet: >> lines are features (type:start:end:id:strand:parent:score), > lines their descriptions, # lines comments, all other lines sequence with position numbers."""
    lines = F.filter(F.split(F.regexp_replace("value", "^#JSA", ""), "\n"), lambda x: F.length(F.trim(x)) > 0)
    head = F.split(lines[0], ":")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    cut = lambda x: F.split(F.regexp_replace(x, "^>>", ""), ":")
    field = lambda x, i: F.get(cut(x), F.lit(i))
    found = F.transform(F.filter(rest, lambda x: F.startswith(x, F.lit(">>"))), lambda x: F.struct(field(x, 0).alias("type"), field(x, 1).cast("int").alias("start"), field(x, 2).cast("int").alias("end"), field(x, 3).alias("id"), field(x, 4).alias("strand"), field(x, 5).alias("parent"), field(x, 6).cast("double").alias("score")))
    seq = F.regexp_replace(F.array_join(F.filter(rest, lambda x: ~x.rlike("^[>#]")), ""), r"[0-9\s]", "")
    return records.where("length(trim(value)) > 0").select(F.get(head, F.lit(1)).alias("id"), F.get(head, F.lit(2)).cast("int").alias("length"), F.get(head, F.lit(3)).alias("alphabet"), seq.alias("seq"), found.alias("features"))


def read_jsa(spark: SparkSession, path: str) -> DataFrame:
    return parse_jsa(spark.read.option("lineSep", "\n#JSA").text(path))


def format_jsa(seqs: DataFrame, width: int = 50, block: int = 10) -> DataFrame:
    """Records of (id, alphabet, seq, features): header, features, then the sequence in numbered lines of blocks."""
    n = F.length("seq")
    digits = F.length(n.cast("string"))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(width))).otherwise(F.array().cast("array<int>"))

    def line(a):
        inner = F.substring(F.col("seq"), a, F.lit(width))
        spaced = F.rtrim(F.regexp_replace(inner, f"(.{{{block}}})", "$1 "))
        return F.concat(F.lpad(a.cast("string"), digits, " "), F.lit("  "), spaced)

    marks = F.transform("features", lambda x: F.concat(F.lit(">>"), F.concat_ws(":", x["type"], x["start"].cast("string"), x["end"].cast("string"), x["id"], x["strand"], x["parent"], x["score"].cast("string"))))
    return seqs.select(F.concat(F.lit("#JSA:"), F.concat_ws(":", "id", n.cast("string"), "alphabet"), F.lit("\n"), F.array_join(marks, "\n"), F.when(F.size(marks) > 0, "\n").otherwise(""), F.array_join(F.transform(starts, line), "\n"), F.lit("\n")).alias("value"))


def parse_xaf(lines: DataFrame) -> DataFrame:
    """(record_no, fields) of a self-describing table in one file: #H: lines name the tab-separated columns of the rows below, until the next one. lines has n, a line's number."""
    w = Window.orderBy("n")  # a header holds for all rows after it: only headers are put in order
    heads = lines.where("value like '#H:%'").select("n", F.split(F.expr("substring(value, 4)"), "\t").alias("h"), (F.lead("n").over(w)).alias("until"))
    rows = lines.where("value not like '#%' and length(value) > 0")
    met = rows.join(F.broadcast(heads.select(F.col("n").alias("from"), "until", "h")), (F.col("n") > F.col("from")) & (F.col("until").isNull() | (F.col("n") < F.col("until"))))
    pairs = F.arrays_zip(F.col("h").alias("k"), F.slice(F.split("value", "\t"), F.lit(1), F.size("h")).alias("v"))
    return met.select(F.col("n").alias("record_no"), F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))).alias("fields"))


def read_xaf(spark: SparkSession, path: str) -> DataFrame:
    return parse_xaf(numbered_lines(spark.read.text(path)).select("n", "value"))


def parse_gff(lines: DataFrame, types: list[str] | None = None, upstream: int = 0, downstream: int = 0) -> DataFrame:
    """Features (seqid, type, start, end, score, strand, id) of the nine-column rows, of the given types; with flanks of so many bases before and after each, as the strand reads."""
    f = _fields(lines.where("value not like '#%' and value not like '>%'")).where("size(f) >= 9")
    name = F.coalesce(F.nullif(F.regexp_extract(_at(8), r"(?:^|;)ID=([^;]+)", 1), F.lit("")), F.nullif(F.regexp_extract(_at(8), r"(?:^|;)Name=([^;]+)", 1), F.lit("")), F.lit(""))
    rows = f.select(_at(0).alias("seqid"), _at(2).alias("type"), _int(3).alias("start"), _int(4).alias("end"), F.expr("try_cast(get(f, 5) as double)").alias("score"), _at(6).alias("strand"), name.alias("id"))
    rows = rows if types is None else rows.where(F.col("type").isin(types))
    out = rows
    back = F.col("strand") == "-"
    for kind, size, low_side in (("upstream", upstream, ~back), ("downstream", downstream, back)):
        if size:
            a = F.when(low_side, F.greatest(F.col("start") - size, F.lit(1))).otherwise(F.col("end") + 1)
            z = F.when(low_side, F.col("start") - 1).otherwise(F.col("end") + size)
            out = out.unionByName(rows.withColumns({"type": F.lit(kind), "start": a, "end": z}).where("end >= start"))
    return out


def read_gff(spark: SparkSession, path: str, **how) -> DataFrame:
    """Features of a GFF3 file, up to its sequences."""
    at = numbered_lines(spark.read.text(path))
    stop = at.where("value like '##FASTA%' or value like '>%'").groupBy("file").agg(F.min("n").alias("stop"))
    return parse_gff(at.join(F.broadcast(stop), "file", "left").where("stop is null or n < stop").select("value"), **how)


def parse_blast(lines: DataFrame, min_cover: float = 0.9, min_identity: float = 1.0) -> DataFrame:
    """Hits (qseqid, sseqid, sstart, send, strand, cover, identity) of tabular lines qseqid qlen qstart qend sseqid slen sstart send length pident ... sstrand that cover enough of the query with enough identity."""
    f = _fields(lines.where("value not like '#%'")).where("size(f) >= 11")
    cover = _int(8) / _int(1)
    same = F.expr("try_cast(get(f, 9) as double)") / 100
    rows = f.select(_at(0).alias("qseqid"), _at(4).alias("sseqid"), F.least(_int(6), _int(7)).alias("sstart"), F.greatest(_int(6), _int(7)).alias("send"), F.when(F.element_at("f", -1) == "minus", "-").otherwise("+").alias("strand"), cover.alias("cover"), same.alias("identity"))
    return rows.where((F.col("cover") >= min_cover) & (F.col("identity") >= min_identity))


def contig_coverage(contigs: DataFrame) -> DataFrame:
    """Contigs (name, desc, seq) with cov: what follows _cov_ in the name, else a k-mer sum over the length, else 1."""
    n = F.length("seq")
    by_name = F.nullif(F.regexp_extract("name", r"_cov_([0-9.]+)", 1), F.lit("")).cast("double")
    by_sum = F.nullif(F.regexp_extract("desc", r"^[0-9]+ ([0-9]+)", 1), F.lit("")).cast("double") / n
    return contigs.withColumn("cov", F.coalesce(by_name, by_sum, F.lit(1.0)))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def parse_bed(lines: DataFrame) -> DataFrame:
    """Features of lines of three to six columns; starts become 1-based."""
    f = lines.where("value not like '#%'").select(F.split("value", "\t").alias("f")).where("size(f) >= 3")
    at = lambda i: F.get("f", F.lit(i))
    return f.select(at(0).alias("parent"), (at(1).cast("int") + 1).alias("start"), at(2).cast("int").alias("end"), at(3).alias("id"), at(4).cast("double").alias("score"), at(5).alias("strand"))


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """contig and bin_id of each line; bin 0 means none."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) >= 2")
    return f.select(F.col("f")[0].alias("contig"), F.expr("try_cast(f[1] as int)").alias("bin_id")).where("bin_id <> 0")


def write_bed(rows: DataFrame, path: str) -> None:
    """Tab-separated lines with 0-based starts; a null field is a dot."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    rows.select(F.concat_ws("\t", "parent", (F.col("start") - 1).cast("string"), at("end"), at("id"), at("score"), at("strand")).alias("value")).write.text(path)


def write_fastq(rows: DataFrame, path: str) -> None:
    """Four lines a record."""
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value")).write.text(path)
