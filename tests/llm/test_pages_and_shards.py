"""Archives, shards and language ID: dictionaries, record ids, written shards, hostile pages, and the posterior by hand."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelforge.llm import language, quality, sharding, warc
from levelforge.llm.common import read_file

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("rows", [[(1, "u", "x")], [(i, f"http://h/{i}", f"<p>{'word ' * (i % 7)}{i}</p>") for i in range(40)], [(1, "u", "y" * 3_000_000), (2, None, None)]])
def test_every_archive_has_a_dictionary(spark, rows):
    files = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1))
    assert all(r.dictionary_bytes >= 8 for r in files.collect())
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(files).collect()} == {i: len((h or "").encode()) for i, _, h in rows}


def test_record_ids_are_unique(spark):
    long = "<p>" + "text " * 40
    rows = [(1, "a", long), (1, "a", long), (1, "b", "other"), (1, "b", "other"), (2, "c", long), (None, "d", long), (None, "d", long), (3, "e", "")]
    files = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3))
    heads = [warc.parse_record(r)[0] for f in files.collect() for r in warc.read_archive(read_file(f.folder, f.name))]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(rows) and {h["WARC-Refers-To"] for h in heads if "WARC-Refers-To" in h} <= set(ids)
    out = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(files).collect())
    assert out == {(1, "response", None): 4, (2, "revisit", 1): 1, (None, "revisit", 1): 2, (3, "response", None): 1}
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def test_written_shards(spark):
    rows = [(i, "x" * (i % 90), i, None) for i in range(400)] + [(7, "y" * 150, k, "d") for k in range(30)] + [(None, None, 0, None), (5000, "z" * 3000, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, depth string")
    folder, column = sharding.write_shards(docs, byte_limit=1000)
    out = sharding.read_shards(spark, folder, column)
    assert column == "shard_" and sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    got, size = Counter(), Counter()
    for r in out.select("text", "shard_").collect():
        size[tuple(r.shard_)] += len(r.text or "")
        got[tuple(r.shard_)] += 1
    assert all(n <= 1000 or got[k] == 1 for k, n in size.items())
    same = Counter((r.depth, r.prefix) for r in sharding.shards(docs, byte_limit=1000).collect())
    assert same == Counter((r.depth, r.prefix) for r in out.select("shard_.*").collect())
    folder, column = sharding.write_shards(docs.limit(0), byte_limit=1000)
    assert spark.read.schema(docs.schema).parquet(folder).count() == 0


@pytest.mark.parametrize(("large", "most"), [((), 21), ((900,), 23), ((1100,), 23), ((501, 499, 600, 2000), 47)])
def test_one_large_row_makes_no_small_pages(spark, large, most):
    docs = spark.createDataFrame([(7, "x" * n) for n in (*large, *[10] * 2000)], "doc_id long, text string").repartition(3)
    pages = Counter()
    for r in sharding.shards(docs, byte_limit=1000).collect():
        pages[r.page] += r.n_bytes
    assert len(pages) <= most and sum(pages.values()) == 20_000 + sum(large)
    assert sorted(n for n in pages.values() if n > 1000) == [n for n in sorted(large) if n > 1000]


def test_many_small_records_are_read_in_linear_time():
    records = [b"record %d " % i + b"text " * (i % 50) for i in range(20_000)]
    data = warc.archive_bytes(records, warc.train_dictionary(records))
    began = time.process_time()
    assert list(warc.read_archive(data)) == records
    assert time.process_time() - began < 1.0
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_archive(data[:-3]))


def test_visible_text():
    page = b"<html><script>var a;</script >x<STYLE>b</style><!-- c -->y<b>z</b> &eacute;&#228;&lt;"
    assert language.visible_text(page).decode().split() == ["x", "y", "z", "éä<"]
    for part in (b"<script", b"<!--", b"<", b"<style>", b"</script", b"<script></script"):
        start = time.time()
        language.visible_text(part * (1_000_000 // len(part)))
        assert time.time() - start < 5


def test_domains(spark):
    hosts = {"a.b.co.uk": "b.co.uk", "www.example.de": "example.de", "x.com": "x.com", "10.1.2.3": "10.1.2.3", "localhost": "localhost", "": "", "co.uk": "co.uk", "a.org.example": "org.example"}
    out = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", language.domain_of(F.col("host")).alias("d")).collect()
    assert {r.host: r.d for r in out} == hosts


def posterior(pages, names, scores):
    """The fused posterior of every page by hand: a page's own vote is taken out of each count."""
    n, out = len(names), {}
    vote = {i: max(range(n), key=lambda k: (s[k], -k)) if any(s) else None for i, s in scores.items()}
    total = [sum(v == k for v in vote.values()) for k in range(n)]
    whole = sum(total)
    for i, p in pages.items():
        own = [float(vote[i] == k) for k in range(n)]
        count = lambda key: [sum(vote[j] == k and q[key] == p[key] for j, q in pages.items()) - own[k] for k in range(n)]  # noqa: B023, E731
        prior = [(c + 1) / (whole + n) for c in total]
        for key in ("domain", "host"):
            c = count(key)
            prior = [(c[k] + language.SMOOTHING * prior[k]) / (sum(c) + language.SMOOTHING) for k in range(n)]
        fused = [math.log(prior[k]) + scores[i][k] for k in range(n)]
        for key in ("declared", "suffix"):
            c = count(key)
            share = (sum(c) + 1) / (whole + 1)
            fused = [f + math.log((c[k] + language.SMOOTHING * share) / (total[k] - own[k] + language.SMOOTHING)) for k, f in enumerate(fused)]
        top = max(fused)
        out[i] = names[fused.index(top)], 1 / sum(math.exp(f - top) for f in fused)
    return out


def test_posterior_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, model = language.train(docs)
    texts = [r.text for r in docs.where("n_chars BETWEEN 20 AND 400").orderBy("doc_id").limit(36).collect()]
    hosts = ["a.example.de", "b.example.de", "x.co.uk", "y.co.uk", "z.fr", ""]
    rows = [(i, f"http://{hosts[i % 6]}/{i}" if i % 6 < 5 else None, f'<html lang="{["de", "en", "fr"][i % 3]}"><p>{t[: 30 + i]}</p>' if i % 7 else None) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, PAGES)
    out = {r.page_id: r for r in language.identify(pages, names, model).collect()}
    scores = {r.id: list(r.scores) for r in language.text_scores(pages.select(F.col("page_id").alias("id"), "html"), model).collect()}
    known = {i: {"host": out[i].host, "declared": out[i].declared, "suffix": out[i].suffix, "domain": {"a.example.de": "example.de", "b.example.de": "example.de"}.get(out[i].host, out[i].host)} for i in out}
    expected = posterior(known, names, scores)
    assert {i: r.lang for i, r in out.items()} == {i: e[0] for i, e in expected.items()}
    assert np.allclose([out[i].posterior for i in expected], [e[1] for e in expected.values()], atol=2e-6)
    assert {r.lang for r in language.identify(pages, [], np.zeros((language.FEATURES, 0))).collect()} == {None}


def test_quality_leaves_columns_and_finds_lines_of_large_hosts(spark):
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    words = lambda k: " ".join(f"{c}z{name(k)}" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, f"{words(i)}" + ("\nsign up for our news" if i < 40 else ""), "h", 5, 6) for i in range(900)] + [(None, None, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, text_hash long, gone__ long")
    kept = quality.apply_quality(docs).collect()
    assert len(kept) == 900 and {(r.text_hash, r.gone__) for r in kept} == {(5, 6)} and sum("\n" in r.text for r in kept) == 40
    measured = quality._measured(docs)
    assert quality.frequent_lines(measured).count() == 0 and quality.frequent_lines(measured, max_docs=40).count() == 1
