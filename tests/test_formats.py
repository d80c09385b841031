from seqloom.sources import formats


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one two\nACGT\nAC\n>y\nTT\n")
    rows = formats.read_fasta(spark, str(tmp_path / "a.fa"))
    want = [("x", "one two", "ACGTAC"), ("y", "", "TT")]
    assert sorted(tuple(r) for r in rows.collect()) == want
    formats.write_fasta(rows.coalesce(1), str(tmp_path / "out"), 4)
    assert sorted(tuple(r) for r in formats.read_fasta(spark, str(tmp_path / "out")).collect()) == want


def test_gfa_paf_bed(spark, tmp_path):
    (tmp_path / "g").write_text("H\tVN:Z:1.0\nS\t1\tACGT\tKC:i:40\nS\t2\tAC\tdp:f:2.5\nL\t1\t+\t2\t-\t3M\n")
    nodes, edges = formats.read_gfa(spark, str(tmp_path / "g"))
    assert sorted((r.node_id, r.kc, r.cov) for r in nodes.collect()) == [("1", 40, None), ("2", None, 2.5)]
    assert [tuple(r) for r in edges.collect()] == [("1", True, "2", True, 3)]
    (tmp_path / "p").write_text("r\t500\t0\t100\t+\tc\t900\t10\t110\t90\t100\t60\tcg:Z:100M\n")
    r = formats.read_paf(spark, str(tmp_path / "p")).first()
    assert (r.read_start, r.read_end, r.ref_start, r.cigar) == (1, 100, 11, "100M")
    (tmp_path / "b").write_text("c\t0\t10\nc\t5\t9\tid\t1.5\t-\n")
    assert sorted((r.start, r.end, r.id) for r in formats.read_bed(spark, str(tmp_path / "b")).collect() if r.id) == [(6, 9, "id")]


def test_bins_bed_and_fastq(spark, tmp_path):
    (tmp_path / "bins").write_text("c1 3\nc2\t0\n\nc3   4\n")
    assert sorted(tuple(r) for r in formats.read_bins(spark, str(tmp_path / "bins")).collect()) == [("c1", 3), ("c3", 4)]
    rows = [("p", 5, 9, "f", 1.5, "-"), ("q", 1, 2, "g", 0.0, "+")]
    formats.write_bed(spark.createDataFrame(rows, "parent string, start int, end int, id string, score double, strand string"), str(tmp_path / "bed"))
    assert sorted(tuple(r) for r in formats.read_bed(spark, str(tmp_path / "bed")).collect()) == rows
    formats.write_fastq(spark.createDataFrame([("r", "ACGT", "IIII")], "name string, seq string, qual string"), str(tmp_path / "fq"))
    assert [r.value for r in spark.read.text(str(tmp_path / "fq")).collect()] == ["@r", "ACGT", "+", "IIII"]
