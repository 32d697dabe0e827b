"""Every stage of the pipeline against plain Python over what the stage before it kept, other columns and all."""

import datetime
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_near_links import least_reached
from test_operators import fingerprint, key
from test_windows_that_say_something import brute_force

from levelforge.llm.common import materialise
from levelforge.llm.queries import WORD_TOKENIZER, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash long, key__ int, id__ string, hash__ long, gone__ array<int>, run timestamp, block binary"
WHEN = datetime.datetime(2024, 5, 6, 7, 8, 9, 123457)


def fixture():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(3000)] + ["é", "naïve"]
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    item = "a train leaves the old station at 9 and travels 120 miles to the town before it stops for 9 minutes near the river where people wait for their friends"
    passage = " ".join(f"p{i}q" for i in range(60))
    texts = [say(rnd.randint(60, 160)) for _ in range(40)]
    texts += [f"{say(40)}\nSubscribe to our   News {i % 10}\n{say(30)}" for i in range(24)]
    texts += [say(12), "", None, " \n ", "go on " * 60, f"read on\n{say(10)}"]
    near = [texts[k].split() for k in (0, 1, 2)]
    texts += [" ".join([*w[:-1], "other"]) for w in near] + [texts[3], texts[3].upper(), texts[4].replace(" ", "  ")]
    texts += [f"{say(50)} {passage} {say(40)}", f"{passage} {say(60)}", f"{say(60)}é{passage}"]
    texts += [f"{say(60)} {item} {say(20)}", f"{say(60)} {item.replace('9', '11').replace('120', '340')} {say(20)}", f"{say(60)} {item[:60]} {say(30)}"]
    texts += [say(2600)]
    rnd.shuffle(texts)
    rows = [(k, t, "h" if k % 3 else None) for k, t in enumerate(texts)]
    rows += [(None, say(50), "h"), (5, texts[5], "h" if 5 % 3 else None), (7, say(70), "x")]
    docs = [(i, t, "de", s, None if t is None else len(t), 7, n, "x", -n, [n], WHEN, b"\xff\x00") for n, (i, t, s) in enumerate(rows)]
    return docs, [(1, item), (2, "42"), (3, None)]


def brute_quality(rows):
    normal = lambda line: " ".join(WORD.findall(re.sub("[0-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))))
    texts = defaultdict(set)
    for r in rows:
        texts[r.source].add(r.text)
    seen = Counter((s, line) for s, ts in texts.items() for t in ts for line in {normal(x) for x in (t or "").split("\n")} if line)
    over = {k for k, n in seen.items() if n >= 10 and (100 * n > 5 * len(texts[k[0]]) or n >= 1000)}
    out = []
    for r in rows:
        words = WORD.findall(r.text or "")
        windows = [tuple(words[a : a + 8]) for a in range(len(words) - 7)]
        twice = Counter(windows)
        again = {a + k for a, w in enumerate(windows) if twice[w] > 1 for k in range(8)}
        lines = (r.text or "").split("\n")
        gone = [(r.source, normal(x)) in over for x in lines]
        removed = sum(len(WORD.findall(x)) for x, g in zip(lines, gone, strict=True) if g)
        left = len(words) - removed
        if len(words) < 20 or 100 * len(again) > 30 * len(words) or (removed and (left < 20 or 100 * left < 30 * len(words))):
            continue
        out.append((r.doc_id, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), r.gone__))
    return out


def brute_near(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    fp, sets = [fingerprint(lower(r.text)) for r in rows], []
    for r in rows:
        w = WORD.findall(lower(r.text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: (n := len(a & b)) and n >= 0.8 * (len(a) + len(b) - n)
    root = least_reached(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2 or near(sets[i], sets[j])])
    best = {}
    for r, k in zip(rows, root, strict=True):
        order = (r.doc_id is None, r.doc_id or 0)
        best[k] = min(best.get(k, (order, r.text)), (order, r.text), key=lambda x: x[0])
    return sorted([(o[1] if not o[0] else None, t) for o, t in best.values()], key=key)


def brute_repeats(rows, length=50):
    data = [(r.doc_id if r.doc_id is not None else 2**63, r.text.encode()) for r in rows]
    first = {}
    for k, b in data:
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], 2**64), k)
    out = []
    for (k, b), r in zip(data, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < k:
                gone[s : s + length] = True
        kept, at = "", 0
        for c in r.text:
            n = len(c.encode())
            kept += "" if gone[at : at + n].all() else c
            at += n
        out.append((r.doc_id, kept, r.gone__))
    return out


def test_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, items = fixture()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    sf_dir, docs = f"file://{tmp_path}", materialise(spark.createDataFrame(rows, SCHEMA).repartition(5))
    known = {r[9][0]: r[2:4] + r[5:] for r in rows}

    def run(name):
        nonlocal docs
        before = docs.collect()
        docs = materialise(stages[name](spark, docs, sf_dir))
        after = docs.collect()
        assert docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes, name
        assert all(tuple(r)[2:4] + (r.text_hash, r.key__, r.id__, r.hash__, r.gone__, r.run, bytes(r.block)) == known[r.gone__[0]] for r in after), name
        assert all(r.n_chars == len(r.text) for r in after), name
        return before, after

    before, after = run("quality_rules")
    assert sorted([(r.doc_id, r.text, r.gone__) for r in after], key=key) == sorted(brute_quality(before), key=key) and len(after) < len(before)
    assert sum("Subscribe" in r.text for r in after) < 10
    before, after = run("simhash_near_dedup")
    assert sorted([(r.doc_id, r.text) for r in after], key=key) == sorted(brute_near(before), key=key) and len(after) <= len(before) - 6
    before, after = run("suffix_dedup")
    assert sorted([(r.doc_id, r.text, r.gone__) for r in after], key=key) == sorted(brute_repeats(before), key=key)
    assert sum(len(r.text) for r in after) < sum(len(r.text) for r in before)
    before, after = run("benchmark_decontamination")
    bad = {d for d, *_ in brute_force([(k, r.text) for k, r in enumerate(before)], items)}
    assert sorted([(r.doc_id, r.text) for r in after], key=key) == sorted([(r.doc_id, r.text) for k, r in enumerate(before) if k not in bad], key=key) and bad
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    pieces = []
    for r in after:
        n = len(whole.encode(r.text, add_special_tokens=False).ids) + 1
        pieces += [(r.doc_id, k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048))]
    out = stages["best_fit_packing"](spark, docs, sf_dir).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length) for r in out], key=key) == sorted(pieces, key=key) and any(r.piece for r in out)
    bins, left = defaultdict(list), []
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for n in sorted((p[3] for p in pieces), reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(2048 - n)
    assert len(bins) == len(left)


def test_stages_of_empty_tables(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
