"""Years of a text in Spark and in the query's SQL."""

import duckdb

import __spark_entry__ as entry


def test_years_have_one_rule_in_both_engines(spark, tmp_path):
    texts = ["in 2077, 2029 and 1066 1066", "44 BC, 1200 b.c.e and 9 BCE", "ñ1999 or 1999ñ", "٣" + "1500", "x1500 1500_", "1999— 2000", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {r[0]: r[1] for r in entry.queries()["year_extract"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(entry.oracle_sql()["year_extract"]).fetchall())
    assert got[0] == "2029,1066" and 2 not in got and got[5] == "1999,2000"
