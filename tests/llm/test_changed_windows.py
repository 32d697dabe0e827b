"""One changed place of a benchmark item hides no windows that are there word for word."""

from levelforge.llm import decontaminate

ITEM = "A train leaves Boston at 9 and travels 120 miles to Albany before it stops for 9 minutes near the river where Boston people wait for their friends"


def test_one_changed_place(spark):
    filler = "plain words that say nothing at all about the thing in question and go on for a while "
    fruit = "someone has 3 apples in a basket and 5 pears in a bowl on the table"
    rows = [(1, filler + ITEM.replace("Boston people", "London people")), (2, filler + fruit.replace("3", "4").replace("5", "4")), (3, filler * 3)]
    rows.append((4, filler + ITEM.replace("at 9 ", "at 4 ").replace("Boston people", "London people")))
    bench = spark.createDataFrame([(7, ITEM), (8, fruit)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r.doc_id, r.item_id): (r.n_matched >= 15 if r.item_id == 7 else r.n_matched == r.n_windows, r.kind) for r in decontaminate.contaminated(docs, bench).collect()}
    assert out == {(1, 7): (True, "reparameterised"), (2, 8): (True, "reparameterised")}
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()) == [3, 4]
