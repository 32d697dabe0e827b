"""The trie against plain Python: shards of any size, copies, hot first turns, long and turnless conversations, nulls, repeats."""

import random
import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
import xxhash

from levelforge.llm.tries import Louds, Trie, hash_ids, join_ids, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, c int"


def tie(role, text):
    h = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))
    return role, h - (1 << 64) if h >> 63 else h


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (*t[:2], *tie(*t[2:])))] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[x] for x in children[p])
    out = []
    for p, c in nodes.items():
        ends = ",".join(map(str, sorted(x for x in c if paths[x] == p)))
        out.append((min(c), len(p), min(nodes[p[:-1]]) if p else None, len(c), len(children[p]), leaves[p], saved[p], sha256(ends.encode()).hexdigest()))
    return out


def chats(n, seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-n // 3, n), n):
        if c % 20 == 0 and c % 3 == 0:
            continue
        first = rnd.choice(["hot", "hot", "hot", "a b", None])
        for t in range(rnd.choice([1, 1, 2, 3, 4, 5, 6])):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", None, "", "x"]) if t else "user", first if t == 0 else rnd.choice(["yes", "no  so", "", None, "a\tb\nc"]), None, 1))
    rnd.shuffle(rows)
    return rows


LONG = [(7, t, "user", f"word {t % 3}", None, None) for t in range(300)] + [(8, t, "user", f"word {t % 3}", None, None) for t in range(299)]
CASES = {"hot first turn": chats(300, 1), "null ids": chats(60, 2) + [(None, 1, "user", "lost", None, None)], "long": LONG, "copies": [(c, 0, "u", "same text", None, None) for c in range(100)], "repeats": [(21, 0, "user", "x", "", 0)] * 3}


@pytest.mark.parametrize(("case", "limit"), [*((c, 3) for c in CASES), ("hot first turn", 1 << 13)])
def test_same_as_plain_python(spark, case, limit):
    rows = CASES[case]
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), limit).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_shards_are_whole_tries(spark):
    rows = chats(300, 3)
    trie = Trie(spark.createDataFrame(rows, SCHEMA), 20)
    shards = trie.shards().collect()
    assert len(shards) > 1 and sum(r.n_nodes for r in shards) + trie.heavy.count() == len(brute(rows)) == trie.nodes.count()
    for r in shards:
        t = Louds.unpacked(r.n_nodes, bytes(r.louds), bytes(r.labels))
        assert [x for k in range(r.n_nodes + 1) for x in t.children(k)] == list(range(1, r.n_nodes + 1))
        assert all(t.parents()[x - 1] == k for k in range(r.n_nodes + 1) for x in t.children(k))
        assert t.rolled_up(np.ones(r.n_nodes + 1, np.int64))[[x for x in t.children(0)]].sum() == r.n_nodes


def test_ids_in_runs(monkeypatch, spark):
    import pyarrow as pa

    from levelforge.llm import tries

    monkeypatch.setattr(tries, "RUN", 4)
    batch = pa.RecordBatch.from_pydict({"depth": [1] * 9 + [2], "p1": [5] * 10, "p2": [6] * 10, "c": [-3, *range(8), 4]})
    runs = list(join_ids([batch.slice(0, 6), batch.slice(6)]))
    assert [r.num_rows for r in runs] == [2, 2]
    out = pa.Table.from_batches(hash_ids(runs)).to_pylist()
    assert [r["ends_sha256"] for r in out] == [sha256(b"-3,0,1,2,3,4,5,6,7").hexdigest(), sha256(b"4").hexdigest()]


def test_empty(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
