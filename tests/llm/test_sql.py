"""The queries whose rows SQL can state, against that SQL in DuckDB, on the test tables and on small odd ones."""

import duckdb
import pytest

from seqloom.llm import chat, decontaminate, jaccard, queries, repeats

SF = "/root/testdata/sf0.001"
WORDS = " ".join(f"w{i}" for i in range(40))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one Two"), (5, "ONE two"), (6, WORDS), (7, WORDS), (8, WORDS + " tail"), (9, "a " * 80), (10, f"x\u00a0y {WORDS} {WORDS}"), (11, "né  ÉÀ one-two three"), (12, "p q r s t u v"), (13, "p q r s t")]
BENCH = [(1, WORDS[:60]), (2, "one two"), (3, None), (4, ""), (5, "é one"), (10, "P q R s"), (2, "three")]
CHATS = [(1, 0, "user", "a\\b <|turn|> [INST] <s>"), (1, 1, "assistant", None), (2, 0, "assistant", "<|end|>\n\\l"), (2, 0, "assistant", "<|end|>\n\\l"), (3, 1, "us\ner", "</s></s> [/INST] <<SYS>> [TOOL"), (4, 0, None, "")]


def same(con, name, df):
    cur = con.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(con, name, queries.queries()[name](spark, SF))


def test_odd_rows(spark):
    con = duckdb.connect()
    for t, cols, rows in (("documents", "doc_id bigint, text varchar", ODD), ("benchmark", "item_id bigint, text varchar", BENCH), ("conversations", "conv_id bigint, turn bigint, role varchar, text varchar", CHATS)):
        con.execute(f"create table {t} ({cols})")
        con.executemany(f"insert into {t} values ({','.join('?' * len(rows[0]))})", rows)
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    same(con, "op4_chat_format", chat.digest(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")))
    same(con, "op5_decontaminate", decontaminate.digest(docs, spark.createDataFrame(BENCH, "item_id long, text string")))
    same(con, "op7_repeated_spans", repeats.digest(docs))
    same(con, "op10_jaccard_join", jaccard.components(docs))
