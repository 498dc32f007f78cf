"""The queries that SQL can express against their SQL: given tables, and small ones with nulls, ties and odd texts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat, quality, warc
from brindle.llm.registry import oracle_sql, queries

pytest.importorskip("public_tokenizers")
TABLE = {"op6_quality": "documents", "op7_chat": "conversations", "op9_warc": "pages"}
OP = {"op6_quality": quality.op6, "op7_chat": chat.op7, "op9_warc": warc.op9}
ODD = ["", None, " \n\t ", "one", "a\\b <|x|> [INST] </s>", "日本語 é 🙂\n\nline\nline\n line", "The of and the. " * 30, "a b c d " * 40, "#$% & <p>|</p> " * 30]
SMALL = {
    "op6_quality": ("doc_id long, text string, lang string", [(i, t, ["en", None][i % 2]) for i, t in enumerate(ODD)] + [(None, ODD[6], "fr"), (3, "one", "en")] + [(100 + i, f"the of and {i} zu mit " * (9 + i), "de") for i in range(25)]),
    "op7_chat": ("conv_id long, turn long, role string, text string", [(i // 3, i % 3, ["user", "assistant", None][i % 3], t) for i, t in enumerate(ODD)] + [(7, None, "assistant", "x"), (7, 1, "assistant", "y"), (7, 1, "assistant", "y"), (7, 1, "assistant", "a<s>")]),
    "op9_warc": ("page_id long, url string, html string", [(i, f"http://h/{i}", t) for i, t in enumerate(ODD)] + [(50, None, ODD[5]), (50, "u", ODD[5]), (None, "u", ODD[5]), (60, "u", ""), (60, "u", ""), (61, "HTTPS://me@WWW2.a.B:8080?b=2&a=1#x", "q"), (59, "//a.b:8080/?a=1&b=2", "r"), (1 << 60, "u", "far"), (-5, "u\\r\\n", "early"), (62, "http://h:80", "s"), (63, "http://h/", "t")]),
}


def same(df, con, sql):
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    return len(got)


@pytest.mark.parametrize("name", list(TABLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, name, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {TABLE[name]} AS SELECT * FROM '/root/testdata/{sf}/{TABLE[name]}.parquet'")
    assert same(queries()[name](spark, f"/root/testdata/{sf}"), con, oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", list(TABLE))
@pytest.mark.parametrize("some", [True, False])
def test_small_tables(spark, name, some, tmp_path):
    ddl, rows = SMALL[name]
    df = spark.createDataFrame(rows if some else [], ddl).withColumn("sha", F.lit("clash"))
    df.write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {TABLE[name]} AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    same(OP[name](df), con, oracle_sql()[name])
