"""Order within a key without a window over the key: two-level scans.

Rows are range-partitioned and sorted by (key, order), so a key with a third of
all rows lies in many tasks. Each part counts its rows of each key; the counts
of the parts (one row for each part and key) give where each part begins. Frames
of bounded width are computed in blocks of consecutive rows, each with the rows
beside it that the frame needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh, written


def _same(left: DataFrame, right: DataFrame, names: list[str], renamed: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[renamed[n]]) for n in names])


def numbered(df: DataFrame, keys: list[str], order: list, position: str, total: str | None = None) -> DataFrame:
    """``df`` with the place of each row within its key, from 1 (long), and the key's rows (``total``).

    ``order`` (names or columns, nulls first unless they say otherwise) should
    be total; rows that tie come in any order. Null keys are one key. The rows
    are written once, since range boundaries differ from job to job.
    """
    part, at, first, n = fresh("part"), fresh("at"), fresh("first"), fresh("n")
    by = [*keys, *order]
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}))
    other = {k: fresh("k") for k in [*keys, part]}
    runs = placed.groupBy(*keys, part).agg(F.min(at).alias(first), F.count("*").alias(n))
    mine = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(n).over(mine.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(*(F.col(k).alias(other[k]) for k in [*keys, part]), (before - F.col(first) + 1).alias(first), F.sum(n).over(mine).alias(n))
    out = placed.join(starts, _same(placed, starts, [part, *keys], other))
    return out.select(*df.columns, (F.col(at) + F.col(first)).alias(position), *([F.col(n).alias(total)] if total else []))


def placed(df: DataFrame, keys: list[str], order: list, position: str, total: str | None = None, most: int = 1 << 20) -> DataFrame:
    """As ``numbered``, by a window for each key where no key has over ``most`` rows (they are counted first), so small keys cost no written table."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        return numbered(df, keys, order, position, total)
    w = Window.partitionBy(*keys)
    out = {position: F.row_number().over(w.orderBy(*order)).cast("long")} | ({total: F.count("*").over(w)} if total else {})
    return df.withColumns(out)


def framed(df: DataFrame, keys: list[str], position: str, before: int, after: int, compute: dict, size: int = 1 << 14) -> DataFrame:
    """``df`` with window columns whose frames reach at most ``before`` rows back and ``after`` rows on.

    ``compute`` maps names to functions of a window specification. Each block
    of ``size`` places is a window partition of its own and borrows the rows
    beside it, so no task holds a whole key.
    """
    block, own = fresh("block"), fresh("own")
    here, low, high = (F.floor((F.col(position) + d - 1) / size).cast("long") for d in (0, -after, before))
    spread = df.withColumn(own, here).withColumn(block, F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    w = Window.partitionBy(*keys, block).orderBy(position)
    return spread.withColumns({name: f(w) for name, f in compute.items()}).where(F.col(own) == F.col(block)).drop(own, block)


def running(df: DataFrame, keys: list[str], position: str, sums: dict, merge=F.sum, size: int = 1 << 14) -> DataFrame:
    """``df`` with running totals over ``position`` within its key, the own row included.

    ``sums`` maps new names to columns; ``merge`` is the aggregate (its totals
    must be combined by itself: a sum, a bitwise or, a maximum). Totals of
    blocks of ``size`` places are added up first, then the rows of a block.
    """
    block, renamed = fresh("block"), {}
    values = {name: fresh("v") for name in sums}
    d = df.withColumns({values[n]: c for n, c in sums.items()} | {block: F.floor((F.col(position) - 1) / size).cast("long")})
    blocks = d.groupBy(*keys, block).agg(*(merge(v).alias(v) for v in values.values()))
    past = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    renamed = {k: fresh("k") for k in [*keys, block]}
    base = {n: fresh("base") for n in sums}
    blocks = blocks.select(*(F.col(k).alias(renamed[k]) for k in renamed), *(merge(values[n]).over(past).alias(base[n]) for n in sums))
    out = d.join(blocks, _same(d, blocks, [block, *keys], renamed))
    w = Window.partitionBy(*keys, block).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    both = out.withColumns({values[n]: merge(values[n]).over(w) for n in sums})
    return both.select(*df.columns, *(_merged(merge, base[n], values[n]).alias(n) for n in sums))


def _merged(merge, base: str, value: str) -> Column:
    if merge is F.bit_xor:
        return F.coalesce(F.col(base), F.lit(0)).bitwiseXOR(F.col(value))
    if merge is F.sum:
        return F.coalesce(F.col(base), F.lit(0)) + F.col(value)
    if merge is F.max:
        return F.greatest(base, value)
    raise ValueError("merge is F.sum, F.max or F.bit_xor")
