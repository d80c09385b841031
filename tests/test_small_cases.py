"""Operators on rows small enough to work out by hand, and files that are read back."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import cigar, columns, scalars
from seqloom.operators import bridges, graph, hits, relational, signal
from seqloom.sources import formats
from seqloom.streaming import reads


@pytest.fixture(scope="module")
def value(spark):
    """The value of a Column expression without rows."""
    return lambda *cols: tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_scalars(value):
    i = F.lit
    got = value(scalars.node_log_odds(i(100.0), i(100.0), i(3000), i(10)), scalars.node_log_odds(i(50.0), i(100.0), i(3000), i(10)), columns.read_coverage(i(100000), i(10127)), columns.a_statistic(i(10000), i(20.0), i(20.0)))
    assert got == pytest.approx((193.147181, -153.426410, 17.241379, 88.842991), abs=1e-5)
    assert value(*[scalars.support_class(i(x)) for x in (179, 180, 1199, 1200)]) == (0, 1, 1, 2)
    assert value(scalars.suffix_prefix(i("TTACGTA"), i("CGTAGG"), 5), scalars.first_mismatch(i("ACGT"), i("ACCT")), scalars.first_mismatch(i("NAC"), i("GAC")), scalars.first_mismatch(i("A"), i("AC")), scalars.first_mismatch(i(""), i(""))) == (4, 3, 0, -1, 0)
    assert value(scalars.translated(i("ATGGCCTAAN")), scalars.translated(i("ANG")), scalars.translated(i("AC"))) == ("MA*", "X", "")
    assert value(scalars.flanked(i("ACGT"), i(1), i(4), 2), scalars.flanked(i("ACGTACGT"), i(4), i(5), 2), scalars.signal_codes(i("ACGTN"))) == ("NNACGTNN", "CGTACG", [-2, -1, 1, 2, 0])
    assert value(scalars.bridge_keys(i("7+,12-")), scalars.digits(i(-120))) == (["7o", "12o"], 3)
    hit = lambda *x: scalars.hit_vector(*[i(v) for v in x])
    assert tuple(value(hit(1, 1001, 9000, 10000, True, 1501, 3501, 1, 2001, True))[0]) == (10499, 1)
    assert tuple(value(hit(1, 1001, 9000, 10000, True, 3501, 1501, 1, 2001, False))[0]) == (12501, -1)


def test_margin_and_clips(value):
    i = F.lit
    m = lambda *x: columns.useful_margin(*[i(v) for v in x])
    assert value(m(1, 2000, 8000, 8001, 10000, 10000, 60), m(3000, 4000, 8000, 3000, 4000, 10000, 60), m(3000, 4000, 8000, 1, 1000, 10000, 60), m(1, 2000, 8000, 8001, 10000, 10000, 9)) == (True, False, False, False)
    # the read's distances are held against the contig's tolerance as well, and distances begin at 0
    assert value(m(201, 600, 600, 4601, 5000, 5000, 60), m(300, 700, 8000, 4600, 5000, 5000, 60), m(1, 2000, 8000, 8001, 10000, 10000, 60, False)) == (True, True, False)
    span = lambda c, f: tuple(value(cigar.cigar_span(i(c), i(f)))[0])
    assert span("5S10M2I3D8M4H", True) == (6, 25, 29) and span("5S10M2I3D8M4H", False) == (24, 5, 29)
    assert span("3H5S10M", True) == (9, 18, 18) and span("10M", True) == (1, 10, 10)


def test_cigar_walk(value):
    """Both maps against a walk base by base."""
    i, r = F.lit, random.Random(4)
    for _ in range(6):
        ops = [(r.randint(1, 9), r.choice("MID=X")) for _ in range(6)]
        ops = [(4, "M"), *ops, (4, "M")]
        text = "3S" + "".join(f"{n}{o}" for n, o in ops) + "2S"
        read, ref, pairs = 4, 100, []
        for n, o in ops:
            for _ in range(n):
                if o in "M=X":
                    pairs.append((read, ref))
                read += o in "MI=X"
                ref += o in "MD=X"
        a = [i(x) for x in (4, read - 1, read + 1, 100, ref - 1)]
        got = value(*[cigar.reference_position(i(x), *a, i(True), i(text)) for x, _ in pairs], *[cigar.read_position(i(y), *a, i(True), i(text)) for _, y in pairs])
        aligned = set(pairs)
        # a place between two operations may be told as the end of an insertion or deletion next to it
        assert sum((x, got[k]) in aligned for k, (x, _) in enumerate(pairs)) >= len(pairs) - 6
        assert sum((got[len(pairs) + k], y) in aligned for k, (_, y) in enumerate(pairs)) >= len(pairs) - 6


def test_consensus_counts_other_letters_as_n(spark):
    rows = spark.createDataFrame([("x", "AR"), ("x", "AR")], "k string, row string")
    assert [tuple(r) for r in relational.column_consensus(rows, "k", "row").collect()] == [("x", "AN")]


def test_graph(spark):
    nodes = spark.createDataFrame([("A", 100, 1.0), ("B", 50, 1.0), ("C", 80, 1.0), ("D", 70, 1.0)], "node_id string, len int, cov double")
    edges = spark.createDataFrame([("C", True, "B", False), ("B", True, "A", False), ("C", True, "A", False)], "n0 string, d0 boolean, n1 string, d1 boolean")
    root = spark.createDataFrame([("C", True)], "node string, dir boolean")
    got = {(r.node, r.dir): r.d for r in graph.bounded_distances(root, edges, nodes, 1000, 10).collect()}
    assert got == {("C", True): -80, ("B", True): -10, ("A", True): -10}
    assert {r.node: r.component for r in graph.components(nodes, edges).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}
    assert {tuple(r) for r in graph.uncut_edges(edges).collect()} == {("C", True, "B", False)} - {("C", True, "B", False)}
    circle = spark.createDataFrame([("A", True, "B", False), ("B", True, "A", False)], "n0 string, d0 boolean, n1 string, d1 boolean")
    assert {r.component: (r.n_nodes, r.circular, r.length) for r in graph.chains(nodes, circle, 10).collect()} == {"A": (2, True, 130), "C": (1, False, 80), "D": (1, False, 70)}
    loop = spark.createDataFrame([("A", True, "A", True)], "n0 string, d0 boolean, n1 string, d1 boolean")
    assert [tuple(r) for r in graph.degrees(loop).collect()] == [("A", 2, 0)]
    steps = spark.createDataFrame([("p", 0, "A", True, 0), ("p", 1, "B", False, 0), ("p", 2, "A", True, 3)], "path string, pos int, node_id string, forward boolean, gap int")
    seqs = spark.createDataFrame([("A", "AACC"), ("B", "TTGG")], "node_id string, seq string")
    assert graph.spelled(steps, seqs, 2).first().seq == "AACC" + "AA" + "NNN" + "AACC"
    assert value_of(spark, graph.reversed_path(F.array(F.struct(F.lit("a").alias("node"), F.lit(True).alias("forward"))))) == [("a", False)]


def value_of(spark, col):
    return [tuple(x) for x in spark.range(1).select(col.alias("x")).first().x]


def test_relaxation_ends(spark):
    nodes = spark.createDataFrame([("A", 500, 10.0), ("B", 600, 10.0), ("C", 700, 10.0)], "node_id string, len int, cov double")
    edges = spark.createDataFrame([("A", True, "B", False, None), ("B", True, "C", False, None)], "n0 string, d0 boolean, n1 string, d1 boolean, cov double")
    e, n = graph.relaxed(edges, nodes, 3)
    cov = {r.n0: r.cov for r in e.collect()}
    assert all(1 < v <= 10.5 for v in cov.values()) and n.count() == 3


def test_paths_and_bridges(spark):
    paths = spark.createDataFrame([(1, 1, 0, 1.0), (1, 2, 0, 2.0), (1, 3, 200, 9.0), (2, 4, -100, 1.0), (2, 5, 350, 1.0), (2, 6, 401, 1.0)], "segment int, path int, deviation long, likelihood double")
    assert {r.path for r in bridges.likely_paths(paths, F.col("segment") == 1).collect()} == {2, 4, 5}
    steps = spark.createDataFrame([("b", 7, 1, 100, 120), ("b", 7, 1, 300, 60), ("b", 7, 1, 900, 60)], "bridge string, dest int, dir int, mag long, score long")
    assert sorted((r.mag, r.score) for r in bridges.merged_steps(steps).collect()) == [(166, 180), (900, 60)]
    few = spark.createDataFrame([("b", i) for i in range(4)] + [("c", i) for i in range(25)], "bridge string, read_id int")
    assert {r.bridge for r in bridges.consensus_gate(few).collect()} == {"c"} and bridges.consensus_gate(few, True).count() == 2


def test_dense_ids(spark):
    rows = spark.createDataFrame([("z", 1), ("a", 2), ("z", 3), ("m", 3)], "v string, n int")
    assert {r.v: r.dense_id for r in hits.dense_ids(rows, "v", F.col("n")).collect()} == {"z": 1, "a": 2, "m": 3}


def test_signals():
    x = np.array([1.0, -1, 1, -1])
    assert signal.autocorrelation(x) == pytest.approx([4, -3, 2, -1]) and signal.lag_square_sum(x) == pytest.approx([8, 6, 4, 2]) and signal.square_difference(x) == pytest.approx([1, -1, 1, -1])
    assert not signal.square_difference(np.zeros(5)).any() and not signal.normalised(np.full(4, 2.0)).any()
    r = np.random.default_rng(3)
    y = r.normal(size=101)
    taps = signal.blackman_sinc(101)
    slow = np.array([sum(y[(i - j) % 101] * taps[j] for j in range(101)) for i in range(101)])
    assert signal.low_pass(y) == pytest.approx(np.roll(slow, -50))
    wave = np.cos(np.arange(990) * 2 * np.pi / 200)  # nearly five units of 200
    assert signal.chopping_points(signal.square_difference(signal.normalised(wave))) == pytest.approx([200, 400, 600, 800], abs=2)
    t, q = "ACGTA", "GGACGTACC"
    scan = signal.match_scan(t, q)
    assert scan[6] == pytest.approx(5 / 4) and len(scan) == 13  # the whole template, over its length less one
    assert signal.best_near(np.array([0, 1, 3, 0, 3.0]), 3, 2) == 2 and signal.best_near(np.zeros(4), 1, 2) == -1


def test_chopped(spark):
    r = random.Random(1)
    unit = "".join(r.choice("ACGT") for _ in range(120))
    rows = spark.createDataFrame([(1, unit * 5), (2, ""), (3, "ACGT")], "id long, seq string")
    got = {}
    for x in signal.chopped(rows).collect():
        got.setdefault(x.id, []).append((x.first, x.last))
    assert got[3] == [(1, 4)] and 2 not in got
    assert [a for a, _ in got[1]] == [1, *(z + 1 for _, z in got[1][:-1])] and got[1][-1][1] == 600  # units tile the read


def test_report_trigger():
    t = reads.ReportTrigger(10, 50)
    assert [t.due(now, n) for now, n in ((0, 60), (9, 0), (10, 0), (15, 49), (30, 0), (31, 1))] == [False, False, True, False, False, True]
    assert t.due(32, 0, final=True)


def test_versioned_table(spark, tmp_path):
    v = reads.VersionedTable(spark, str(tmp_path / "t"), "k long, n long")
    add = v.update(lambda old, new: old.unionByName(new.groupBy("k").agg(F.count(F.lit(1)).alias("n"))).groupBy("k").agg(F.sum("n").alias("n")))
    for number in (0, 1, 1):  # a batch that is run again changes nothing
        add(spark.createDataFrame([(1,), (2,), (1,)], "k long"), number)
    assert {r.k: r.n for r in v.read(1).collect()} == {1: 4, 2: 2}


def test_files(spark, tmp_path):
    fq = "".join(f"@r{i} d\nACGT\n+\n@+II\n" for i in range(50))
    (tmp_path / "a.fq").write_text(fq)
    (tmp_path / "b.fq").write_text("@x\nAC\n+\n++\n")
    got = formats.read_fastq(spark, str(tmp_path / "*.fq"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(f"r{i}", "ACGT", "@+II") for i in range(50)] + [("x", "AC", "++")])
    (tmp_path / "g.gff").write_text("##gff-version 3\ns\t.\tgene\t5\t9\t.\t-\t.\tID=a;Name=b\ns\t.\tCDS\t5\t9\t1.5\t+\t0\tName=b\n##FASTA\n>s\tx\tgene\t1\t2\t.\t+\t.\tID=no\n")
    assert sorted((r.type, r.start, r.end, r.id) for r in formats.read_gff(spark, str(tmp_path / "g.gff"), types=["gene"], upstream=3).collect()) == [("gene", 5, 9, "a"), ("upstream", 10, 12, "a")]
    (tmp_path / "p.paths").write_text("NODE_1_length_5\n1+,2-;\n3+\nNODE_1_length_5'\n3-\nNODE_2_length_9\n7+\n")
    assert sorted((r.name, r.part, len(r.steps)) for r in formats.read_paths(spark, str(tmp_path / "p.paths")).collect()) == [("NODE_1_length_5", 0, 2), ("NODE_1_length_5", 1, 1), ("NODE_2_length_9", 0, 1)]
    (tmp_path / "j.jsa").write_text("#JSA:s1:12:DNA\n>>gene:2:5:g:+:s1:1.5\n>a note\n 1  ACGTACGTAC GT\n\n#JSA:s2:2:DNA\n1  AC\n")
    assert sorted((r.id, r.length, r.seq, len(r.features)) for r in formats.read_jsa(spark, str(tmp_path / "j.jsa")).collect()) == [("s1", 12, "ACGTACGTACGT", 1), ("s2", 2, "AC", 0)]
    (tmp_path / "x.xaf").write_text("#H:a\tb\n1\t2\n#H:b\tc\n3\t4\n")
    assert sorted((r.record_no, tuple(sorted(r.fields.items()))) for r in formats.read_xaf(spark, str(tmp_path / "x.xaf")).collect()) == [(1, (("a", "1"), ("b", "2"))), (3, (("b", "3"), ("c", "4")))]
    (tmp_path / "f.fastg").write_text(">EDGE_1_length_4_cov_2.5:EDGE_2_length_3_cov_1.0';\nACGT\n>EDGE_1_length_4_cov_2.5';\nACGT\n>EDGE_2_length_3_cov_1.0;\nACG\n")
    nodes, edges = formats.read_fastg(spark, str(tmp_path / "f.fastg"))
    assert sorted((r.node_id, r.cov) for r in nodes.collect()) == [("1", 2.5), ("2", 1.0)] and [(r.n0, r.d0, r.n1, r.d1) for r in edges.collect()] == [("1", True, "2", True)]
    (tmp_path / "r.txt").write_text("acg\ntt\n")
    assert formats.read_raw(spark, str(tmp_path / "r.txt")).first().seq == "ACGTT"
    with gzip.open(tmp_path / "z.gz", "wb") as f:
        f.write(b"@SQ\tSN:1\n")
    assert [formats.sniff(str(tmp_path / n)) for n in ("a.fq", "g.gff", "j.jsa", "z.gz", "f.fastg")] == ["fastq", "raw", "jsa", "sam", "fasta"]
    text = spark.createDataFrame([("P\tp\t1+,2-\t*",), ("S\t1\tACGT\tdp:f:2.0",), ("L\t1\t+\t2\t-\t31M",), ("L\t1\t+\t3\t-\t29M",)], "value string")
    nodes, edges, paths = formats.parse_gfa(text)
    assert paths.first().name == "p" and nodes.first().cov == 2.0 and formats.overlap_of(edges) == 29
    assert math.isclose(formats.contig_coverage(spark.createDataFrame([("NODE_1_cov_3.5_x", "", "A")], "name string, desc string, seq string")).first().cov, 3.5)


def test_all_paths_and_chains(spark):
    from seqloom.operators import paths

    nodes = spark.createDataFrame([(i, 1000, i == 4) for i in range(1, 7)], "node_id long, len long, far boolean")
    # 1 -> 2 -> 5, 1 -> 3 -> 5, 1 -> 4 -> 5 (4 is an anchor), 5 -> 6
    edges = spark.createDataFrame([(1, True, 2, False), (1, True, 3, False), (1, True, 4, False), (2, True, 5, False), (3, True, 5, False), (4, True, 5, False), (5, True, 6, False)], "n0 long, d0 boolean, n1 long, d1 boolean")
    asked = spark.createDataFrame([("a", 1, True, 5, False, 746), ("b", 1, True, 6, False, 1619), ("c", 1, False, 5, False, 746), ("d", 1, True, 5, False, 3000)], "req string, src long, src_dir boolean, dst long, dst_dir boolean, distance long")
    got = sorted(tuple(r) for r in paths.all_paths(asked, edges, nodes, nodes["far"]).collect())
    assert got == [("a", "2i,5i", 0), ("a", "3i,5i", 0), ("b", "2i,5i,6i", 0), ("b", "3i,5i,6i", 0)]
    assert paths.all_paths(asked.limit(0), edges, nodes, nodes["far"]).count() == 0
    ring = spark.createDataFrame([(1, True, 2, False), (2, True, 3, True), (1, False, 3, False), (4, False, 5, True)], "n0 long, d0 boolean, n1 long, d1 boolean")
    order = sorted(tuple(r) for r in paths.ordered_chains(nodes, ring).collect())
    assert order == [(1, 1, True, 0, True), (1, 2, True, 1, True), (1, 3, False, 2, True), (4, 4, False, 0, False), (4, 5, False, 1, False), (6, 6, True, 0, False)]


def test_distributions(spark):
    import math

    from seqloom.functions import probability as D

    f = F.col
    rows = spark.createDataFrame([(0, 0, 0.2), (0, 9, 0.2), (9, 9, 0.2), (3, 9, 0.2), (40, 400, 0.1), (123, 400, 0.9)], "x long, n long, p double")
    for r in rows.select("*", D.log_binomial(f("x"), f("n"), f("p")).alias("got")).collect():
        assert math.isclose(r.got, math.log(math.comb(r.n, r.x) * r.p**r.x * (1 - r.p) ** (r.n - r.x)), rel_tol=1e-9, abs_tol=1e-12)
    one = spark.range(3).select(D.weighted_choice(F.lit(0.99), F.array(F.lit(0.1))).alias("c"), D.random_sequence(1, f("id"), F.lit(0)).alias("s"), D.beta_ratio(F.lit(0), F.lit(4), F.lit(1), F.lit(2)).alias("b")).first()
    assert (one.c, one.s, one.b.mean, one.b.sd) == (0, "", None, None)
    u = spark.range(20000).agg(F.avg(D.uniform(1, f("id"))).alias("m"), F.count_distinct(D.uniform(1, f("id"))).alias("n")).first()
    assert abs(u.m - 0.5) < 0.01 and u.n > 19_990


def test_unique_path_takes_copies_and_edges(spark):
    from seqloom.operators import binning

    counts = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1)], "item long, bin long, n long")
    visits = spark.createDataFrame([(1, 1, 1, 0, 1), (1, 2, 1, 0, 1), (1, 2, 5, 0, 1), (2, 1, 2, 0, 0), (2, 2, 2, 0, 1), (3, 1, 3, 0, 1)], "item long, path long, pos long, bin long, other long")
    assert binning.copies_left(counts, visits).collect() == []
    assert sorted(tuple(r) for r in binning.copies_left(counts, visits.where("path = 1")).collect()) == [(1, 1, 2)]
    assert sorted(tuple(r) for r in binning.copies_left(counts, visits.limit(0)).collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]
    edges = spark.createDataFrame([(1, True, 2, False), (1, True, 3, False), (2, True, 3, True), (1, False, 4, True)], "n0 long, d0 boolean, n1 long, d1 boolean")
    steps = spark.createDataFrame([("p", 0, 1, True), ("p", 1, 2, True), ("p", 2, 3, False)], "path string, pos long, node long, forward boolean")
    got = sorted(tuple(r) for r in binning.spent_edges(steps, edges, F.col("node") == 1).collect())
    assert got == [(1, True, 2, False), (1, True, 3, False)]
    close = F.col("bin") != 9
    paths = spark.createDataFrame([(1, 1, 2), (None, 1, 1), (2, 1, 2), (9, 9, 9), (1, None, 1)], "bin long, start_bin long, end_bin long")
    assert sorted(tuple(r) for r in binning.accepted_paths(paths, close).collect()) == [(1, 1, 2, 2), (2, 1, 2, 1)]


def test_reports(spark):
    from seqloom.operators import reports

    seg = spark.createDataFrame([(5, "b"), (2, "a9"), (7, "b")], "at long, name string")
    links = spark.createDataFrame([("b", "a9"), ("a9", "zz")], "a string, b string")
    paths = spark.createDataFrame([("p", "b+,zz-,a9-")], "path string, steps string")
    bins = spark.createDataFrame([(1, "b", 8), (2, "a9", 3), (3, "b", -1)], "at long, name string, bin long")
    _, new_links, new_paths, new_bins = reports.reindexed(seg, links, paths, bins)
    assert sorted(tuple(r) for r in new_links.collect()) == [("1", ""), ("2", "1")]
    assert new_paths.first().steps == "2+,-,1-"
    assert sorted(tuple(r) for r in new_bins.collect()) == [(1, "2", 1), (2, "1", 2), (3, "2", -1)]
    reads = spark.createDataFrame([(1, 100), (1, 50), (2, 10)], "step long, bases long")
    some = spark.createDataFrame([(2, 30, True), (2, 10, False)], "step long, len long, circular boolean")
    rows = reports.progress(reads, some, spark.createDataFrame([(1, 7)], "step long, gap long")).orderBy("step").collect()
    assert [r.line for r in rows] == ["1 |\t2 |\t150 |\t0 |\t0 |\t0 |\t1(7)", "2 |\t3 |\t160 |\t2 |\t1 |\t30 |\t0(0)"]
    contigs = spark.createDataFrame([("x", 1, 2), ("y", 1, 1), ("z", 2, 1)], "contig string, scaffold long, pos long")
    found = spark.createDataFrame([("x", 1, "replicon", "o"), ("y", 1, "gene", "g"), ("z", 1, "gene", "h")], "contig string, at long, sort string, text string")
    assert [tuple(r) for r in reports.replicon_report(contigs, found, 2_500_000).collect()] == [("x", ">y\tx\t\n>2.00Mpb\t1 genes\t+o \n\tg\n\n")]
    assert reports.sampled(seg.limit(0), "name", 5, 1).count() == 0


def test_combinations_beyond_a_double(spark):
    from math import log

    from seqloom.operators import bridges

    paths = spark.range(2400).selectExpr("1 as bridge", "id div 2 as segment", "cast(id % 2 as double) as likelihood").unionByName(spark.sql("select 2 as bridge, 0L as segment, 5d as likelihood"))
    rows = {r.bridge: (r.likelihood, r.log_paths) for r in bridges.best_paths(paths).collect()}
    assert rows[2] == (5.0, 0.0)
    assert rows[1][0] == 1200.0 and abs(rows[1][1] - 1200 * log(2)) < 1e-9


def test_replicon_texts_are_copied_last(spark):
    """The copies of a scaffold's text pass no join, sort or exchange, and only the reads asked for are ranked."""
    from seqloom import catalog

    plan = catalog.queries()["replicon_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan.index("Generate explode")
    assert all(below < plan.index(x) for x in ("Exchange", "Join", "Window", "Aggregate"))
    assert "% 8) = 0" in plan[plan.index("Window [row_number") :] and "% 8) = 0" not in plan[: plan.index("Window [row_number")]
