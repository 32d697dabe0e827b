"""The near-dedup stage against brute force, over texts that share a long passage."""

import random
from functools import partial

import numpy as np
import pytest

from levelforge.llm import simhash

PASSAGE = 390


def passage_texts(pairs=520, words=500, seed=11):
    """Pairs of texts at a similarity of about 0.75 to 0.95; all texts share a passage, others are at about 0.64."""
    rnd = random.Random(seed)
    number = iter(range(10**9))
    new = lambda n: [f"w{next(number)}" for _ in range(n)]
    passage = new(PASSAGE)
    rows = []
    for _ in range(pairs):
        both = passage + new(rnd.randint(40, 100))
        rows += [both + new(words - len(both)) for _ in range(2)]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(i, " ".join(rows[k])) for i, k in enumerate(order)]


def brute_force(rows, similarity=0.8):
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if (n := len(a & b)) >= similarity * (len(a) + len(b) - n)]


def least_reached(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("most_shared", [4_000_000, 0])
def test_links_beside_a_shared_passage(spark, monkeypatch, most_shared):
    monkeypatch.setattr(simhash, "similar_links", partial(simhash.similar_links, most_shared=most_shared))
    rows = passage_texts()
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in out}
    links = brute_force(rows)
    assert len(links) > 200
    links += [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(least_reached(len(rows), links)))


def test_links_of_short_and_nested_texts(spark):
    rnd = random.Random(4)
    base = [f"x{i}" for i in range(120)]
    texts = [" ".join(base[rnd.randint(0, 20) : rnd.randint(90, 120)]) for _ in range(60)] + ["a b", "a  b", "a c", "", " ", "a b c d e f", "a b c d e f g"]
    rows = list(enumerate(texts))
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in out}
    links = [(i, j) for i, j in brute_force(rows) if texts[i].strip() and texts[j].strip()]
    links += [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(least_reached(len(rows), links)))


def test_parity_bits_never_show_more_than_the_difference():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 5, 63, 64, 300, 5000):
        for m in (0, 3, 80, 4000):
            both, a, b = (np.unique(rnd.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m, m // 2))
            x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            least = simhash.least_difference(simhash.parity_bits(x), simhash.parity_bits(y))
            assert least <= len(np.setxor1d(x, y)) and (n or least == 0 or m) and least == simhash.least_difference(simhash.parity_bits(y), simhash.parity_bits(x))
    x = np.unique(rnd.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert simhash.least_difference(simhash.parity_bits(x), simhash.parity_bits(x)) == 0 and simhash.least_difference(simhash.parity_bits(x[:600]), simhash.parity_bits(x)) > 250
