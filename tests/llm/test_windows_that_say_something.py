"""Decontamination against brute force: short items, items and documents of numbers, repeats, and clean text with digits."""

import random
import re
import time

import pytest

from levelforge.llm import decontaminate as D

UNITS = set(D.UNITS)
EDGE = "!\"#$&'()*,-./:;<=>?@[\\]^_`{|}~"


def tokens(text):
    """(template, value) of every token: plain Python over ASCII words."""
    out, opens, number = [], True, False
    for line in (text or "").split("\n"):
        opens = True
        for word in re.findall(r"[^\x20\x09-\x0D]+", line):
            bare = word.strip(EDGE)
            if bare:
                is_number = bool(re.fullmatch(r"[0-9.,%+\-/:]*[0-9][0-9.,%+\-/:]*", bare))
                unit = number and not opens and bare.lower() in UNITS
                name = bare[0].isupper() and not opens and not is_number and not unit
                out.append(("<n>" if is_number else "<u>" if unit else "<w>" if name else bare.lower(), bare.lower()))
                number, opens = is_number, False
            opens = opens or word[-1] in ".!?:"
    return out


def brute_force(docs, items, window=D.WINDOW):
    found = set()
    for item, text in items:
        t = tokens(text)
        n = min(window, len(t))
        spans = [t[a : a + n] for a in range(len(t) - n + 1)] if n else []
        words = lambda s: len({v for k, v in s if k not in ("<n>", "<u>", "<w>")})
        real = [a for a, s in enumerate(spans) if words(s) >= 3 or (n == window and len({v for _, v in s}) >= 3)]
        for doc, body in docs:
            d = tokens(body)
            matched, diagonals = {}, {}
            for a in real:
                for b in range(len(d) - n + 1):
                    s, u = spans[a], d[b : b + n]
                    if [k for k, _ in s] != [k for k, _ in u]:
                        continue
                    if s == u:
                        matched[a] = True
                    elif n == window and words(s) >= 3:
                        diagonals.setdefault(b - a, []).append((a, [(x[1], y[1]) for x, y in zip(s, u, strict=True) if x[0] in ("<n>", "<u>", "<w>")]))
            for hits in diagonals.values():
                pairs = {p for _, ps in hits for p in ps}
                if len(pairs) == len({x for x, _ in pairs}):
                    for a, _ in hits:
                        matched.setdefault(a, False)
            if matched and 100 * len(matched) >= 50 * len(real):
                found.add((doc, item, len(real), len(matched), "verbatim" if all(matched.values()) else "reparameterised"))
    return found


def tables():
    rnd = random.Random(5)
    vocabulary = "red blue walks runs cat dog house tree seven eight over under between".split()
    say = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ",", "."]) for _ in range(n))
    ask = lambda: f"Once {say(4)} {rnd.randint(1, 9)} km and {rnd.choice(['Anna', 'Ben', 'Carl'])} {say(3)} {rnd.randint(1, 9)} apples, then {rnd.choice(['Anna', 'Ben'])} {say(3)} {rnd.randint(10, 99)} mm?"
    items = [(i, ask()) for i in range(6)]
    change = lambda t: re.sub(r"\d+", lambda m: str(int(m[0]) + 1), t).replace("Anna", "Dora")
    partly = lambda t: t.replace("Anna", rnd.choice(["Anna", "Eve"]), 1)
    docs = [(10 * i + k, f"{say(20)}\n{f(t)}\n{say(20)}") for i, t in items for k, f in enumerate((str, change, partly, lambda t: t[: len(t) // 2]))]
    items += [(50, "42"), (51, "Paris"), (52, "too short"), (53, "what is this thing"), (54, "1 2 3 4 5 6 7 8 9 10"), (55, "0 " * 12), (56, ""), (57, None), (58, "12 km in Rome")]
    docs += [(900, "there were 7 people in the room, 42 of them from Paris"), (901, "too short. " * 3), (902, "Say: what is this thing?"), (903, " ".join(map(str, range(1, 40)))), (904, "0 " * 50), (905, None), (906, " ".join(map(str, range(41, 80)))), (907, "12 km in Oslo"), (908, say(60))]
    return docs, items


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_same_as_brute_force(spark, most):
    docs, items = tables()
    out = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_broadcast_windows=most)
    got, expected = {tuple(r) for r in out.collect()}, brute_force(docs, items)
    assert got == expected and len(expected) > 12
    assert {(900, 50), (907, 58), (904, 55), (906, 54)}.isdisjoint({x[:2] for x in got}) and {(902, 53), (903, 54)} <= {x[:2] for x in got}


def test_numbers_make_no_pairs(spark):
    rnd = random.Random(3)
    many = lambda n: " ".join(str(rnd.randint(0, 9)) for _ in range(n))
    docs = spark.createDataFrame([(i, many(3000)) for i in range(20)], "doc_id long, text string")
    start = time.time()
    assert D.contaminated(docs, spark.createDataFrame([(1, many(300))], "item_id long, text string")).count() == 0
    assert time.time() - start < 30


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "what is this thing called here in the text", 5)], "doc_id long, text string, key__ long")
    bench = spark.createDataFrame([(1, "what is this thing called here in the text")], "item_id long, text string")
    assert D.without_contaminated(docs, bench).count() == 0
    assert D.without_contaminated(docs, bench.limit(0)).count() == 1
    assert D.without_contaminated(docs.limit(0), bench).count() == 0


def test_one_template_in_many_items_and_lines(spark):
    """Lines of a template do not multiply with the items that have it."""

    def run(items, lines):
        text = "\n".join(f"train to town {7000 + i} leaves at {9000 + i} daily" for i in range(lines))
        docs = spark.createDataFrame([(1, text), (2, "train to town 5 leaves at 5 daily")], "doc_id long, text string")
        bench = spark.createDataFrame([(i, f"train to town {i} leaves at {i + 500} daily") for i in range(items)] + [(-1, "train to town 1 leaves at 1 daily")], "item_id long, text string")
        began = time.time()
        out = D.contaminated(docs, bench).collect()
        took = time.time() - began
        assert {(r.doc_id, r.item_id) for r in out} == {(d, i) for d in (1, 2) for i in range(items)} | {(2, -1)}
        return took

    run(10, 10)
    small = run(100, 1000)
    assert run(400, 4000) < 2 * small + 3
