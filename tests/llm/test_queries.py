"""Registered queries, their SQL, and the stages of the pipeline over the smallest tables."""

import sys

import duckdb
import pytest

from levelforge.llm import queries
from levelforge.llm.common import table


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, duck, name):
    got, expected = queries.queries()[name](spark, sf_dir), duck.sql(queries.oracle_sql()[name])
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, expected.select(", ".join(columns)).fetchall()))


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    kept = docs.collect()
    assert 0 < len(kept) <= len(before) and {r.doc_id for r in kept} <= set(before)
    assert all(len(r.text) == r.n_chars <= before[r.doc_id].n_chars for r in kept)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept}
    assert corpus_pipeline.run(spark, sf_dir).count() == len(out)
    assert "corpus_pipeline" in sys.modules
