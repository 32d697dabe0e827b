"""Golden points of the decision tables."""

import pytest
from pyspark.sql import functions as F

from levelforge.functions.levels import db
from levelforge.operators import rules as R


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_silence_is_minus_infinity(value):
    assert value(db(F.lit(0.0))) == float("-inf")
    assert value(db(F.lit(float("nan")))) == float("-inf")
    assert value(db(F.lit(1.0))) == 0


@pytest.mark.parametrize(("reduction", "final", "crest", "risky"), [(1.07, 4.43, -1.26, False), (1.10, 2.80, 0.10, True), (0.95, 4.20, 1.10, True), (float("nan"), 1.0, 1.0, False)])
def test_dynamics_risk(value, reduction, final, crest, risky):
    assert value(R.dynamics_risk(*lit(reduction, final, crest))) is risky


def test_delay_class(value):
    assert [value(R.delay_class(*lit(s, True, 0.97))) for s in (1, -4, 20, 240)] == ["PASS", "INFO", "WARN", "FAIL"]
    assert value(R.delay_class(*lit(240, False, 0.97))) == "UNCERTAIN"


@pytest.mark.parametrize(("difference", "hard", "energetic", "last", "end", "kind"), [(28.5, False, False, float("-inf"), None, "INFO"), (100.0, False, False, -90.0, None, "WARN"), (28.5, True, False, -90.0, None, "WARN"), (67.1, False, False, -90.0, -145.0, "INFO"), (67.1, False, True, -90.0, -145.0, "WARN")])
def test_tail_class(value, difference, hard, energetic, last, end, kind):
    assert value(R.tail_class(F.lit(difference), F.lit(0.0), F.lit(hard), F.lit(energetic), F.lit(last), F.lit(end).cast("double"))) == kind


def test_preflight(value):
    p = value(R.preflight(*lit(-15.57, 0.55, 5.68, 9)))
    assert (p["reduction"], p["adaptive"], p["effective"]) == (3.32, -16.0, -17.37)
    p = value(R.preflight(*lit(-15.50, -2.67, 3.75, 0)))
    assert (p["mode"], p["scale"], p["margin"], p["gain_only"], p["effective"]) == ("TRANSPARENT", 0.0, 0.25, True, -14.08)
    p = value(R.preflight(*lit(-15.0, 3.5, 5.0, 1)))
    assert p["review"] and p["effective"] == -18.0
    assert value(R.preflight(*lit(-15.50, -4.0, 5.0, 0)))["mode"] == "PROFILE"


def test_small_tables(value):
    assert round(value(R.gain_only(*lit(-15.5, -2.67))), 2) == 1.42
    assert value(R.peak_trim(F.lit(-1.10))) == -0.15
    assert round(value(R.codec_step(F.lit(-1.12))), 2) == 0.48
    strengths = {"DYNAMICS RISK: LRA reduced": 60, "crest loss": 50, "codec preview unsafe": 100}
    assert {k: value(R.retry_strength(F.array(F.lit(k)))) for k in strengths} == strengths
    assert [value(R.performance_level(F.lit(s))) for s in (119.9, 120.1, 240.1)] == ["", "warning", "error"]
    safe, bad = F.array(F.lit("silent trailing-silence difference 60 ms")), F.array(F.lit("ENERGETIC TAIL END"))
    none = F.array().cast("array<string>")
    assert [value(R.disposition(none, w, F.lit(True))) for w in (safe, bad, none)] == ["READY_WITH_WARNING", "NEEDS_REVIEW", "READY"]
    assert value(R.disposition(none, none, F.lit(None).cast("boolean"))) == "NEEDS_REVIEW"
