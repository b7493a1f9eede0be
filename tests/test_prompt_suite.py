import duckdb
import pytest

import __spark_entry__ as entry
from tessera.operators import chat


def test_documents_without_text_keep_their_row(spark, tmp_path):
    """Blank and null texts were errors of the whole query; white space is taken off as the SQL does."""
    texts = ["a text", "", None, " \n ", "\tx\r\n", " y ", None, "", "\t", "　", "z\n\n"]
    spark.createDataFrame(list(enumerate(texts)) + [(10_000_000_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["id", "bucket", "messages", "digest"]
    got = entry.queries()["prompt_suite"](spark, str(tmp_path)).select(columns).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()['prompt_suite']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) == 2 * len(texts)


def test_blank_prompts_are_errors_where_asked_for(spark):
    df = spark.createDataFrame([(0, " \t")], "pos long, text string")
    with pytest.raises(Exception, match="invalid prompt"):
        chat.prompt_suite(df).collect()
    assert [m.content for m in chat.prompt_suite(df, strict=False).first().messages] == [""]
