"""Whole texts are escaped, with every character that needs it, as in the SQL."""

import duckdb

from levelforge import catalog


def test_whole_texts(spark, tmp_path):
    texts = [None, "", "x" * 50 + "<a href=\"b\">'q' & r</a>", "it's > that", "&amp;"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.html, r.beginning, r.ending) for r in catalog.queries()["report_text_whole"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, html, beginning, ending FROM ({catalog.oracle_sql()['report_text_whole']})").fetchall()}
    assert got[2][0] == "x" * 50 + "&lt;a href=&quot;b&quot;&gt;&#x27;q&#x27; &amp; r&lt;/a&gt;" and len(got) == len(texts)
