"""Level and guard expressions: decibels, safe correlation, clamps, finite tests.

Silence is minus infinity, a legal value; NaN and plus infinity are invalid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def db(x: Column, power: float = 20.0) -> Column:
    """Decibels; zero, negative and NaN give minus infinity, null stays null."""
    return F.when((x <= 0) | F.isnan(x), F.lit(-INF)).when(x.isNotNull(), power * F.log10(x))


def db_floored(x: Column, floor: float = -120.0) -> Column:
    return F.greatest(F.lit(floor), 20.0 * F.log10(F.greatest(x, F.lit(1e-6))))


def amplitude(gain_db: Column) -> Column:
    return F.pow(F.lit(10.0), gain_db / 20.0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def finite_or(x: Column, default) -> Column:
    return F.when(finite(x), x).otherwise(lit(default))


def valid_metric(x: Column) -> Column:
    """Finite or minus infinity."""
    return x.isNotNull() & ~F.isnan(x) & (x != INF)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(lit(low), F.least(lit(high), x))


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson from sums; 1 where either side does not vary."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx <= 1e-12) | (vy <= 1e-12), F.lit(1.0)).otherwise((sxy - sx * sy / n) / F.sqrt(F.greatest(vx * vy, F.lit(1e-300))))


def texts(*when_then: tuple[Column, Column | str]) -> Column:
    """Array of the texts whose conditions hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*(F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in when_then)))


def joined(reasons: Column) -> Column:
    return F.lower(F.array_join(reasons, " / "))


def half_even(x: Column, digits: int = 3) -> Column:
    return F.bround(x, digits)


def fixed(x: Column, digits: int, sign: bool = False) -> Column:
    """``x`` in ``digits`` decimals, the exact binary value rounded half to even, as printf does; ``sign`` shows a plus too.

    Spark's format_string rounds the shortest decimal form half up, and is slow;
    a pattern of format_number rounds the exact value, but for a single 5 one
    place beyond the last, which Java takes for a tie.
    """
    half = float(f"5e-{digits + 1}")
    text = F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits if digits else "0"))
    text = F.when(x == half, f"{half:.{digits}f}").when(x == -half, f"{-half:.{digits}f}").otherwise(text)
    if sign:
        text = F.concat(F.when(text.startswith("-"), "").otherwise("+"), text)
    odd = F.when(F.isnan(x), "nan").when(x == INF, "+inf" if sign else "inf").when(x == -INF, "-inf")
    return F.when(x.isNotNull(), F.coalesce(odd, text))


def metric_text(x: Column) -> Column:
    """Two decimals; whatever is not finite is ``-inf``."""
    return F.when(finite(x), fixed(x, 2)).otherwise("-inf")


def to_float(text: Column, default: float | None = None) -> Column:
    """A text's finite number, else ``default``."""
    x = text.cast("string").try_cast("double")
    return F.when(finite(x), x).otherwise(F.lit(default).cast("double"))


def to_int(text: Column, default: int = 0) -> Column:
    """A trimmed text that is a whole number, else ``default``."""
    clean = F.trim(text.cast("string"))
    return F.coalesce(F.when(clean.rlike("^[+-]?[0-9]+$"), clean.try_cast("int")), F.lit(default))


def html_escape(x: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    return x


def json_number(x: Column) -> Column:
    """Null for what JSON cannot hold."""
    return F.when(finite(x), x)
