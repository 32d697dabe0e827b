"""Language of web pages by fusing evidence as Bayes has it.

* Text: byte-trigram likelihoods of a naive Bayes model, counted over all
  labelled documents, tempered so that a long page isn't certain by length alone.
* The declared markup language and the address suffix: their likelihoods given
  the language, from grouped counts over all pages.
* The host: a prior smoothed through its registered domain to all pages. The
  domain is the last two labels, or three where the last but one is one of
  ``SECOND_LEVEL`` under a country (co.uk); a numeric address is its own domain.

A page's own vote is taken out of each count that it is judged by.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, materialise, task, utf8_arrays

FEATURES = 1 << 14
#: Weight of the smoothing counts, and of the text: a page of n trigrams counts as TEMPER * ln(1 + n / TEMPER) of them.
SMOOTHING, TEMPER = 2.0, 10.0
#: Labels that countries give out names under.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch"]

_OPENS = re.compile(rb"<(?:(script|style)\b|(!--))?", re.I)
_CLOSERS = {b"script": re.compile(rb"</script\s*>", re.I), b"style": re.compile(rb"</style\s*>", re.I), b"!--": re.compile(rb"-->"), b"": re.compile(rb">")}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every byte trigram inside a text; A-Z lower-cased, digits and ASCII marks left out."""
    low = _LOWER[raw].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    three = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    letter = (low >= 97) & (low != 127) & ~((low > 122) & (low < 127)) | (low == 32)
    own = np.searchsorted(offsets, np.arange(len(three)), side="right") - 1
    keep = letter[:-2] & letter[1:-1] & letter[2:] & (np.arange(2, len(low)) < offsets[own + 1])
    return ((three[keep] * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64), own[keep]


def train(docs: DataFrame, most_bytes: int = 1 << 20, most_languages: int = 200) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [feature, language]) from all rows of ``docs`` (text, lang) that have a language.

    The table of probabilities is held by the driver and every worker, so more
    than ``most_languages`` languages are an error. Without labelled rows there
    are no languages.
    """
    schema = pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            label = np.asarray(coded.indices)
            raw, offsets = utf8_arrays(batch.column(0))
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                for i in np.flatnonzero(label == k):
                    for a in range(int(offsets[i]), int(offsets[i + 1]), most_bytes):
                        part = raw[a : min(a + most_bytes + 2, int(offsets[i + 1]))]
                        f, _ = features(part, np.array([0, len(part)]))
                        np.add.at(total.setdefault(lang, np.zeros(FEATURES, np.int64)), f, 1)
        for lang, counts in total.items():
            yield batch_of(schema, [lang], [counts])

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    partial = rows.mapInArrow(task(run), "lang string, counts array<long>")
    summed = materialise(partial.select("lang", F.posexplode("counts").alias("feature", "n")).where("n > 0").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    languages = [r["lang"] for r in summed.select("lang").distinct().orderBy("lang").limit(most_languages + 1).collect()]
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts = np.full((FEATURES, len(languages)), 0.5)
    found = summed.toPandas()
    counts[found["feature"], found["lang"].map({x: i for i, x in enumerate(languages)})] += found["n"]
    return languages, np.log(counts / counts.sum(axis=0))


def visible_text(page: bytes) -> bytes:
    """What is left of a page without scripts, styles, comments and tags, entities decoded.

    One pass: a closing mark that is missing once is never looked for again, so
    a page of unclosed tags takes no longer than another. An unclosed script is
    a tag like any other; an unclosed tag is text.
    """
    out, at, missing = [], 0, set()
    for opened in iter(lambda: _OPENS.search(page, at), None):
        out.append(page[at : opened.start()])
        kind = (opened[1] or opened[2] or b"").lower()
        for closer in dict.fromkeys([kind, b""]):
            end = None if closer in missing else _CLOSERS[closer].search(page, opened.end())
            if end:
                out.append(b" ")
                at = end.end()
                break
            missing.add(closer)
        else:
            out.append(opened[0])
            at = opened.end()
    out.append(page[at:])
    text = b"".join(out)
    return entities.unescape(text.decode(errors="replace")).encode(errors="replace") if b"&" in text else text


def text_scores(rows: DataFrame, model: np.ndarray, is_html: bool = True) -> DataFrame:
    """(id, scores): tempered log-likelihoods of each language; all zero without letters. ``rows``: (id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    n_languages = model.shape[1]
    schema = pa.schema([("id", pa.int64()), ("scores", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, n_languages))
            for i, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                raw = np.frombuffer(visible_text(text) if is_html else text, np.uint8) if text else np.zeros(0, np.uint8)
                f, _ = features(raw, np.array([0, len(raw)]))
                if len(f):
                    out[i] = shared.value[f].mean(axis=0, dtype=np.float64) * TEMPER * np.log1p(len(f) / TEMPER)
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * n_languages
            yield batch_of(schema, batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(out.reshape(-1))))

    return rows.mapInArrow(task(run), "id long, scores array<double>")


def domain_of(host: Column) -> Column:
    """The registered domain of a host; the host itself where it is an address in numbers or one label."""
    labels = F.split(host, r"\.")
    last = lambda k: F.try_element_at(labels, F.lit(-k))
    n = F.when(last(1).rlike("^[0-9]+$"), F.size(labels)).when((F.length(last(1)) == 2) & last(2).isin(SECOND_LEVEL), 3).otherwise(2)
    return F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n))


def identify(pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, host, declared, suffix, text_lang, lang, posterior) of each row of ``pages`` (page_id, url, html).

    Evidence that is missing (null url or html, no declaration) is a value of
    its own. Without letters text_lang is null and the page casts no vote. Ties
    go to the first language by name. An empty table gives an empty result;
    without languages, language and posterior are null.
    """
    n = len(languages)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,8})", 1))
    rows = materialise(pages.select(F.monotonically_increasing_id().alias("id"), F.col("page_id").cast("long"), host.alias("host"), declared.alias("declared"), F.col("html").cast("string")))
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", "declared", F.element_at(F.split("host", r"\."), -1).alias("suffix"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    scored = text_scores(rows.select("id", "html"), model)
    seen = rows.drop("html").join(scored, "id").withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))
    has_text = F.exists("scores", lambda x: x != 0)
    seen = materialise(seen.withColumn("vote", F.when(has_text, F.array_position("scores", F.array_max("scores")).cast("int") - 1)))
    votes = F.array(*(F.count_if(F.col("vote") == i).cast("double") for i in range(n)))
    total = seen.agg(votes.alias("v")).first()["v"]
    whole = sum(total)
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.col("vote") == i, 1.0).otherwise(0.0))
    out = seen.withColumn("own", own)
    for key in ("declared", "suffix", "domain", "host"):
        counts = seen.groupBy(F.col(key).alias("k")).agg(votes.alias(f"{key}_votes"))
        out = out.join(counts, F.col(key) == F.col("k")).drop("k")
    everywhere = F.array(*(F.lit((c + 1.0) / (whole + n)) for c in total))
    of_language = F.array(*(F.lit(c) for c in total))

    def less_own(key):
        return F.zip_with(f"{key}_votes", "own", lambda c, o: c - o)

    def size(key):
        return F.aggregate(less_own(key), F.lit(0.0), lambda s, x: s + x)

    def smoothed(key, parent):
        return F.zip_with(less_own(key), parent, lambda c, p: (c + SMOOTHING * p) / (size(key) + SMOOTHING))

    def likelihood(key):
        share = (size(key) + 1.0) / (whole + 1.0)
        rest = F.zip_with(of_language, F.col("own"), lambda t, o: t - o)
        return F.zip_with(less_own(key), rest, lambda c, t: F.ln((c + SMOOTHING * share) / (t + SMOOTHING)))

    out = out.withColumn("domain_prior", smoothed("domain", everywhere)).withColumn("prior", smoothed("host", F.col("domain_prior")))
    out = out.withColumn("from_declared", likelihood("declared")).withColumn("from_suffix", likelihood("suffix"))
    parts = ["scores", "from_declared", "from_suffix"]
    fused = F.transform("prior", lambda p: F.ln(p))
    for part in parts:
        fused = F.zip_with(fused, part, lambda a, b: a + b)
    out = out.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    names = F.array(*(F.lit(x) for x in languages))
    best = F.element_at(names, F.array_position("fused", F.col("top")).cast("int"))
    evidence = F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return out.select("page_id", "host", "declared", "suffix", F.when(F.col("vote").isNotNull(), F.get(names, F.col("vote"))).alias("text_lang"), best.alias("lang"), F.round(1.0 / evidence, 6).alias("posterior"))
