"""Every query of the catalog against its SQL in DuckDB."""

import duckdb
import pytest

from seqloom import catalog
from seqloom.operators import relational

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    if name not in catalog.oracle_sql():
        assert catalog.queries()[name](spark, SF).count() > 0
        return
    for t in ("part", "lineitem", "events", "documents", "embeddings", "supplier", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    want = sorted(cur.fetchall(), key=key)
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == want


def test_consensus_drops_gap_columns(spark):
    rows = spark.createDataFrame([("x", "AC-GT"), ("x", "ACAGT"), ("x", "AC-TT")], "k string, row string")
    assert [tuple(r) for r in relational.column_consensus(rows, "k", "row").collect()] == [("x", "ACGT")]


def test_feature_match(spark):
    make = lambda v: spark.createDataFrame([(i, 1, a, b) for i, (a, b) in enumerate(v)], "id long, k long, start long, end long")
    got = relational.feature_match(make([(1, 10), (21, 30)]), make([(6, 15), (21, 25), (35, 38)]), "k", 3).collect()
    assert [tuple(r) for r in got] == [(2, 2, 2, 3)]


def test_whole_queries_read_every_row(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    match = catalog.queries()["feature_match"](spark, SF).first()
    assert match.n_mine + match.n_model == lines.count()
    assert catalog._every_link(spark, SF).distinct().count() == lines.select("l_partkey", "l_orderkey").distinct().count()
