"""Suffix dedup over tables without repeats, with one line in every document, and with columns of all kinds."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F
from test_operators import key, removed

from levelforge.llm import suffix_dedup

LINE = "this one line of text stands in each and every document of the table, in new surroundings always"


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def tables():
    rnd = random.Random(8)
    unique = [(i, words(rnd, 290), "s") for i in range(20)]
    line = [(i, f"{words(rnd, rnd.randint(0, 60))} {LINE} {words(rnd, rnd.randint(0, 60))}", "s") for i in range(400)]
    far = [(2**62, LINE * 2, "s"), (-(2**62), LINE, "s"), (5, LINE + words(rnd, 20), "s"), (None, LINE, "s")]
    return {"unique": unique, "short": [(1, "a", "s"), (2, "bc", "s"), (3, "", "s"), (4, None, "s")], "line": line, "far": far}


@pytest.mark.parametrize("name", ["unique", "short", "line", "far"])
def test_same_as_brute_force(spark, monkeypatch, name):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4096)
    rows = tables()[name]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = [tuple(r) for r in suffix_dedup.drop_repeats(docs).collect()]
    assert sorted(out, key=key) == sorted(removed(rows), key=key)
    assert suffix_dedup.without_repeats(docs).count() == len(rows)


def test_one_line_of_all_documents_is_dealt_out(spark, monkeypatch):
    """No bucket gets many times what the median one gets, and the result is that without the dealing."""
    sent = []
    answer = suffix_dedup._answer
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 8192)
    monkeypatch.setattr(suffix_dedup, "_answer", lambda rows, *rest: sent.append(rows.groupBy(F.pmod("bucket", F.lit(rest[0])).alias("b")).agg(F.sum(F.length("payload")).alias("n")).toPandas()["n"]) or answer(rows, *rest))
    rnd = random.Random(2)
    rows = [(i, f"{words(rnd, 6)} {LINE} {words(rnd, 6)}", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    out = [tuple(r) for r in suffix_dedup.drop_repeats(docs).collect()]
    assert sorted(out, key=key) == sorted(removed(rows), key=key)
    assert len(sent[0]) > 20 and sent[0].max() < 3 * sent[0].median()


def test_other_columns_stay(spark):
    rnd = random.Random(1)
    when = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(i, LINE + words(rnd, 20), when, b"\x00\xff", decimal.Decimal("1.23"), {"a": [1, None]}, "run", (1, "x")) for i in range(5)] + [(9, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `when it was` timestamp, raw binary, block decimal(9,2), ids map<string,array<int>>, run string, carry struct<`a b`:int,c:string>")
    before, after = docs.orderBy("doc_id").collect(), suffix_dedup.without_repeats(docs).orderBy("doc_id")
    assert after.schema == docs.schema
    drop_text = lambda r: {k: v for k, v in r.asDict(True).items() if k != "text"}
    assert list(map(drop_text, after.collect())) == list(map(drop_text, before))


def test_session_is_left_as_it_was(spark):
    before = [t.name for t in spark.catalog.listTables()]
    option = "spark.sql.requireAllClusterKeysForCoPartition"
    assert suffix_dedup.drop_repeats(spark.createDataFrame([(1, LINE), (2, LINE)], "doc_id long, text string")).count() == 2
    assert [t.name for t in spark.catalog.listTables()] == before and spark.conf.get(option) == "true"
