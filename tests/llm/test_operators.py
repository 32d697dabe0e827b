"""The numbered operators against brute force, round trips and odd rows."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from levelforge.llm import chat, decontaminate, language, packing, quality, sharding, simhash, suffix_dedup, token_files, warc
from levelforge.llm.common import connected_components
from levelforge.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, tokenizer_path

SCHEMA = "doc_id long, text string, source string"


def texts(n=60, seed=3):
    rnd = random.Random(seed)
    words = ["the", "and", "of", "éà", "Zz", "aaaa", "12", "x%y", "go\n", "Paris"]
    base = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(5)]
    rows = [(i, "".join(rnd.choice(base)[rnd.randint(0, 60) : rnd.randint(61, 250)] for _ in range(rnd.randint(0, 5))), f"s{i % 3}") for i in range(n)]
    odd = [None, "", " ", "a", "a b", "ab" * 300, "a" * 49, "a" * 50, "-" * 900 + base[2], base[0], base[0], "word " * 30_000]
    rows += [(n + i, t, "s0") for i, t in enumerate(odd)]
    return [*rows, (None, base[0] * 2, None), (None, None, None), (3, base[1], "s1"), (3, base[1], "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).withColumn("row", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    out = packing.pack(packing.token_pieces(docs, tokenizer_path(WORD_TOKENIZER))).collect()
    t = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    expected = []
    for i, text, _ in texts():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[a : a + 2048], "<u4")
            expected.append((i, p, a, len(own), zlib.crc32(own.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(expected, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 2048
    assert packing.pack(packing.token_pieces(empty, tokenizer_path(WORD_TOKENIZER))).count() == 0


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(60):
        capacity = rnd.choice([10, 64, 100])
        items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 300))]
        left = []
        for n in sorted(items, reverse=True):
            fits = [(c, i) for i, c in enumerate(left) if c >= n]
            if fits:
                left[min(fits)[1]] -= n
            else:
                left.append(capacity - n)
        plan = packing.best_fit_plan(Counter(items), capacity)
        used = Counter()
        for n, count in Counter(items).items():
            own = plan[plan[:, 0] == n]
            for rank in range(count):
                _, first, b, each, _ = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                used[b + (rank - first) // each] += n
        assert sorted(used.values()) == sorted(capacity - c for c in left)


def test_language(spark, sf_dir, empty):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 300")
    names, model = language.train(d.where("doc_id % 2 = 0"))
    held = d.where("doc_id % 2 = 1").select("doc_id", "text", "lang").collect()
    scores = {r.id: r.scores for r in language.text_scores(d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), "text"), model, False).collect()}
    right = [names[int(np.argmax(scores[r.doc_id]))] == r.lang for r in held]
    assert np.mean(right) > 0.9
    rows = [(1, "http://a.example.de/x", '<html lang="de"><p>der die und</p>'), (2, None, None), (None, "http://a.example.de", ""), (1, "junk", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert language.identify(pages, names, model).count() == 4
    assert language.identify(pages.limit(0), names, model).count() == 0
    assert all(0 < r.posterior <= 1 for r in language.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), names, model).collect())


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    if not shingles:
        return 0
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(int).sum(0)
    return int("".join("1" if 2 * b > len(shingles) else "0" for b in bits), 2)


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash(docs, empty):
    rows = texts()
    fp = [fingerprint(t) for _, t, _ in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {}
    for (i, _, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = [(i, f"{f:016x}", least.get(r)) for (i, _, _), f, r in zip(rows, fp, root, strict=True)]
    out = simhash.simhash_components(docs).collect()
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in out], key=key) == sorted(expected, key=key)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one(empty.select("doc_id", "text")).count() == 0


def test_links_of_a_dense_ball():
    rnd = np.random.default_rng(5)
    near = np.uint64(12345) ^ (np.uint64(1) << rnd.integers(0, 63, 4000).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 63, 4000).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 63, 4000).astype(np.uint64))
    x = np.unique(np.concatenate([near, rnd.integers(0, 1 << 62, 500).astype(np.uint64)]))
    forest = simhash.Forest(len(x))
    for i in range(0, len(x), 500):
        a, b = np.nonzero(np.bitwise_count(x[i : i + 500, None] ^ x[None]) <= 2)
        forest.link(a + i, b)
    assert np.array_equal(simhash.link_within(x, 2), forest.parent)


def test_near_copies_go(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [[rnd.choice(words) for _ in range(400)] for _ in range(20)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:10]):
        c = list(b)
        c[100], c[300] = "other", "words"
        rows.append((100 + i, " ".join(c)))
    rows += [(200, " ".join(base[19])), (5, rows[5][1])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def removed(rows, length=50):
    first = {}
    data = [(i if i is not None else 2**63 - 1, i, (t or "").encode()) for i, t, _ in rows]
    for k, _, b in data:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, 2**63), k)
    out = []
    for k, i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < k:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(docs, empty):
    out = [tuple(r) for r in suffix_dedup.drop_repeats(docs).collect()]
    assert sorted(out, key=key) == sorted(removed(texts()), key=key)
    assert suffix_dedup.drop_repeats(empty).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_sharding(docs, empty):
    out = sharding.shards(docs, byte_limit=2000).collect()
    assert len(out) == docs.count()
    size, rows = Counter(), Counter()
    for r in out:
        size[r.depth, r.prefix, r.page] += r.n_bytes
        rows[r.depth, r.prefix, r.page] += 1
    assert all(n <= 2000 or rows[k] == 1 for k, n in size.items())
    same = docs.sparkSession.createDataFrame([(7, "x" * 100, "s")] * 200, SCHEMA)
    pages = Counter(r.page for r in sharding.shards(same, byte_limit=1000).collect())
    assert sum(pages.values()) == 200 and max(pages.values()) <= 10
    assert sharding.shards(empty).count() == 0


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER))
    out = token_files.read_token_files(token_files.write_token_files(docs, tokenizer_path(BYTE_TOKENIZER), tokens_per_file=3000)).orderBy("start").collect()
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for _, x, _ in texts()]
    expected = [(i, len(x), zlib.crc32(x.tobytes())) for (i, _, _), x in zip(texts(), ids, strict=True)]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in out), key=key) == sorted(expected, key=key)
    assert [r.start for r in out] == list(np.cumsum([0] + [r.n_tokens for r in out])[:-1])
    order = [r.doc_id if r.doc_id is not None else 1 << 62 for r in out]
    assert order == sorted(order)
    assert token_files.write_token_files(empty, tokenizer_path(BYTE_TOKENIZER)).count() == 0


@pytest.mark.parametrize("name", [BYTE_TOKENIZER, WORD_TOKENIZER])
@pytest.mark.parametrize("most_pieces", [1, 40, 400])
def test_encoder_that_forgets(name, most_pieces):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from levelforge.llm.tokens import PieceEncoder

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", " a  b\n\nc ", "x" * 3000]
    whole = Tokenizer.from_file(tokenizer_path(name))
    enc = PieceEncoder(tokenizer_path(name), most_pieces)
    got = [ids[a:b].tolist() for _, ids, at in enc.encode(pa.array(texts), 7, most_bytes=900) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]


@pytest.mark.parametrize("percentile", [0.05, 0.5, 0.9, 1.0])
def test_blocks(percentile):
    rnd = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        assert np.array_equal(token_files.unpack_blocks(*token_files.pack_blocks(ids, percentile), n), ids)


def test_warc(spark):
    rnd = random.Random(4)
    pages = [f"<html><p>{' '.join(rnd.choice(['der', 'die', 'und', 'é']) for _ in range(300))}</p></html>" for _ in range(40)]
    rows = [(i, f"http://h/{i}", pages[i % 40]) for i in range(60)] + [(90, None, None), (91, "u", "short"), (92, "u", "short"), (None, "u", pages[0]), (3, "u", pages[3])]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    assert any(r.dictionary_bytes for r in files.collect()) or files.count()
    out = warc.read_archives(files).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h in rows:
        h = h or ""
        again = len(h.encode()) >= 100 and (i is None or i > first[h])
        expected.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted((tuple(r) for r in out), key=key) == sorted(expected, key=key)


def test_dictionary_helps():
    rnd = random.Random(6)
    records = [warc.record_bytes(i, "http://x", f"<html><head><title>{rnd.random()}</title></head><nav>same for all</nav>{rnd.random()}</html>".encode() * 3, "0", None, "2024-01-01T00:00:00Z") for i in range(2000)]
    dictionary = warc.train_dictionary(records)
    data = warc.archive_bytes(records, dictionary)
    assert dictionary and len(data) < len(warc.archive_bytes(records, b"")) and list(warc.read_archive(data)) == records


def test_chat(spark):
    tool = json.dumps({"tool_calls": [{"id": "b", "name": "f", "arguments": '{"n": 1.0, "a": "x"}', "depends_on": ["c"]}, {"id": "c", "name": "f", "arguments": "{bad", "depends_on": []}]})
    loop = json.dumps({"tool_calls": [{"id": "p", "name": "g", "arguments": "{}", "depends_on": ["q"]}, {"id": "q", "name": "g", "arguments": "{}", "depends_on": ["p"]}]})
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", tool), (1, 4, "tool", json.dumps({"tool_call_id": "b", "content": "r"})), (2, 0, "assistant", loop), (2, 5, "assistant", "alone"), (None, 0, "user", "x"), (3, None, None, None)]
    calls, results = chat.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    schemas = {"ask": chat.ASK_SCHEMA, "f": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n", "z"]}}
    out = {(r.conv_id, r.call_id): r for r in chat.link(calls, results, schemas).collect()}
    assert (out[1, "ask-0"].status, out[1, "ask-0"].errors) == ("linked", [])
    assert out[1, "ask-2"].status == "missing_result" and out[1, "ask-2"].errors == ["$.prompt: minLength"]
    assert (out[1, "b"].status, out[1, "b"].level, out[1, "b"].errors) == ("linked", 1, ["$.z: required"])
    assert out[1, "b"].message == '{"arguments":{"a":"x","n":1},"id":"b","name":"f","result":"r"}'
    assert (out[1, "c"].level, out[1, "c"].errors) == (0, ["$: not JSON"])
    assert {out[2, k].status for k in "pq"} == {"cyclic"} and out[2, "ask-4"].status == "orphan_result"
    assert out[None, "ask-0"].status == "missing_result"
    assert chat.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_decontamination(spark):
    item = "A train leaves Boston at 9 and travels 120 miles to Albany before it stops for 9 minutes near the river where Boston people wait for their friends"
    other = item.replace("Boston", "Madrid").replace("9", "11").replace("120", "340").replace("Albany", "Toledo")
    mixed = item.replace("Boston people", "London people").replace("at 9 ", "at 4 ")
    filler = "plain words that say nothing at all about the thing in question and go on for a while "
    rows = [(1, filler + item + filler), (2, filler + other), (3, filler * 5), (4, None), (5, ""), (None, item), (6, filler + mixed + filler)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    for most in (4_000_000, 0):
        out = {r.doc_id: r for r in decontaminate.contaminated(docs, bench, most_broadcast_windows=most).collect()}
        assert {k: v.kind for k, v in out.items()} == {1: "verbatim", 2: "reparameterised", None: "verbatim"}
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_quality(spark, docs, empty):
    assert quality.quality(docs).count() == docs.count() and quality.quality(empty).count() == 0
    letter = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    body = [" ".join(letter(i) + letter(j) for j in range(40)) for i in range(30)]
    rows = [(i, f"Read   More at page {i % 10}\n{b}", "h") for i, b in enumerate(body)] + [(99, "read more at page 7\n" * 9 + " ".join(f"v{letter(j)}" for j in range(8)), "h")]
    d = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in quality.quality(d).collect()}
    assert out[0].removed_words == 5 and out[0].kept and not out[99].kept
    assert {r.doc_id: r.text for r in quality.apply_quality(d).collect()} == dict(enumerate(body))
