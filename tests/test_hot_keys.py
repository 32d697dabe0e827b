"""A job with very many events is folded in pieces; its state is that of one event after the other."""

import random

from levelforge.streaming import queue


def test_replay_in_pieces(spark):
    rnd = random.Random(8)
    kinds = ["start", "finish", "review", "fail", "cancel", "submit", None]
    rows = [(k if k < 40 else None, i, rnd.choice(kinds)) for i, k in enumerate(rnd.choice([7, 7, 7, rnd.randint(0, 40)]) for _ in range(20_000))]
    before = {}
    for key, _, kind in rows:
        n, s = before.get(key, (0, "WAITING"))
        before[key] = (n + 1, queue.TRANSITIONS.get((s, kind), s))
    events = spark.createDataFrame(rows, "job long, at long, kind string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        assert {r.job: (r.n, r.status) for r in queue.replay(events, "job", "at").collect()} == before
        pieces = queue.folded(events, "job", "at").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(len(r.maps) for r in pieces) > 1 and all(len(r.maps) < 40 for r in pieces)
    assert queue.replay(events.limit(0), "job", "at").count() == 0
