"""The manifest against plain Python: heights, last runs of one, null and repeated ids, languages, tampering."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from levelforge.llm.merkle import manifest, tampered_text

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, at long"


def sha(s):
    return sha256(s.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)))


def climb(nodes, fanout=8):
    """(top, siblings of each node on its way up, as (left, right))."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            f = i - i % fanout
            paths[k].append(("".join(level[f:i]), "".join(level[i + 1 : f + fanout])))
        at = [i // fanout for i in at]
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows):
    def claim(r):
        low = r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
        return leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if low else r[4])

    order = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (order(r[0]), leaf(r, r[4]))) for x in langs}
    tops = {x: climb([leaf(r, r[4]) for r in trees[x]]) for x in langs}
    root, over = climb([tops[x][0] for x in langs])
    out = []
    for x, above in zip(langs, over, strict=True):
        for r, path in zip(trees[x], tops[x][1], strict=True):
            h = claim(r)
            for a, b in path + above:
                h = sha(a + h + b)
            out.append((r[0], leaf(r, r[4]), tops[x][0], root, sha("".join(a + b for a, b in path + above)), h, h == root))
    return out


def table(n, langs, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["s", None, ""]), rnd.choice(langs), rnd.choice([i, None]), rnd.choice([None, "", "Ünd SO", "ABC", "abc", "x" * 1000]), "clash", 1) for i in rnd.sample(range(n), n)]


CASES = {
    "levels": table(700, ["en", "en", "en", "de", "fr"]),
    "run of one": table(65, ["en"]),
    "lone leaf": table(1, [None]),
    "languages": table(40, ["en", None, "", "é", "z", "Z", "de", "fr", "es", "pt", "it", "nl"]),
    "nulls and repeats": [*table(9, ["en"]), *table(9, ["en"]), (None, None, None, None, None, None, None), (None, "s", "en", 1, "T", "", 0), (None, "s", "en", 1, "T", "", 0), (-5, "s", "en", 1, "T", "", 0)],
}


@pytest.mark.parametrize(("case", "levels"), [("levels", 1), ("levels", 3), ("run of one", 3), ("lone leaf", 3), ("languages", 1), ("nulls and repeats", 3)])
def test_same_as_plain_python(spark, case, levels):
    rows = CASES[case]
    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), tampered_text(), levels=levels).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_untampered_and_empty(spark):
    rows = table(30, ["en", "de"])
    assert all(r.verified for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
