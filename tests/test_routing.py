"""Nulls, ties and empty tables of the routing operators."""

from pyspark.sql import functions as F

from levelforge.operators import routing as N

SCHEMA = "mode string, decision string, found array<string>, steps int, tool boolean, medium array<string>, light array<string>"


def test_routing_of_nulls(spark):
    rows = [
        ("off", None, None, None, None, None, None), (None, None, None, None, None, None, None), ("auto", "MEDIUM_REPAIR", ["HISS"], 1, True, [], None), ("AUTO", "MEDIUM_REPAIR", ["HISS"], 1, True, None, []),
        ("medium", "CLEAN", [], 0, True, [], []), ("light", "CLEAN", ["HUM"], 2, True, None, None), ("LIGHT", None, ["HUM"], 2, None, [], []), ("Medium", "CLEAN", ["HUM"], 2, True, ["level"], ["level"]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    c = F.col
    got = [tuple(r["r"]) for r in df.select(N.route_repair(c("mode"), c("decision"), c("found"), c("steps"), c("tool"), c("medium"), c("light")).alias("r")).collect()]
    review = ("OFF", "NEEDS_REVIEW")
    assert got == [("OFF", "CLEAN"), review, ("MEDIUM", "REPAIRED_MEDIUM"), ("LIGHT", "REPAIRED_LIGHT"), ("OFF", "CLEAN"), review, review, review]


def test_chain_of_nulls(spark):
    df = spark.createDataFrame([(None, ["afftdn"]), (["STATIC", "HUM"], None), (["STATIC", "HISS"], ["afftdn"])], "found array<string>, filters array<string>")
    got = [r["c"] for r in df.select(N.repair_chain(F.col("found"), F.lit("LIGHT"), F.lit(None).cast("double"), F.lit(1.0), F.col("filters")).alias("c")).collect()]
    assert [(list(c["chain"]), len(c["warnings"])) for c in got] == [([], 0), ([], 2), (["afftdn=nr=3.5:nf=-50:tn=1:gs=5"], 0)]


def test_ladder_of_nulls_and_repeats(spark):
    rows = [("a", 100, None), ("a", 75, []), ("a", 75, []), ("b", 100, ["x"]), ("b", 25, ["y", "z"]), ("b", 0, []), (None, 50, []), ("c", None, [])]
    df = spark.createDataFrame(rows, "k string, strength int, issues array<string>")
    got = {r["k"]: (r["strength"], r["retries"], r["reasons"]) for r in N.strength_ladder(df, "k").collect()}
    assert got == {"a": (75, 1, ""), "b": (0, 2, "y / z"), None: (50, 0, ""), "c": (0, 0, None)}
    assert N.strength_ladder(df.limit(0), "k").count() == 0


def test_settings_and_verdict_of_nulls(spark):
    one = spark.range(1)
    null_map, new = F.lit(None).cast("map<string,string>"), F.create_map(F.lit("a"), F.lit("1"))
    row = one.select(N.merge_settings(null_map, new).alias("m"), N.merge_settings(null_map, null_map).alias("e"), N.intro_seconds(F.lit(None)).alias("s"), N.intro_seconds(F.lit(99)).alias("t"), N.repair_mode(F.lit(None).cast("string")).alias("o")).first()
    assert (row["m"], row["e"], row["s"], row["t"], row["o"]) == ({"a": "1"}, {}, 15.0, 30.0, "AUTO")
    tracks = spark.createDataFrame([("x", None, None, None), ("x", "READY", True, True), (None, "PASS", None, True)], "b string, status string, fixed boolean, codec_safe boolean")
    got = {r["b"]: (r["ready"], r["text"].split("\n")[-1]) for r in N.batch_verdict(tracks, "b").collect()}
    assert got == {"x": (False, "Codec safe: 1/2"), None: (True, "Codec safe: 1/1")}
    assert one.select(N.attempted_steps(one).alias("s")).first()["s"] == [N.NO_STEPS]
