"""Profile inheritance and composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


class ProfileError(ValueError):
    """A profile that inherits in a circle or from a name that isn't there."""


def ancestors(profiles: DataFrame) -> DataFrame:
    """(name, at, depth): each profile with itself (depth 0) and everything it inherits from, nearest first.

    Distances double each round, so a chain of n profiles takes log2(n) rounds,
    each one join. Raises ``ProfileError`` for unknown parents and circles:
    after as many steps as there are profiles nothing may be left above any.
    """
    names = written(profiles.select("name", "inherits").distinct())
    lost = names.where("inherits IS NOT NULL").join(names.select(F.col("name").alias("inherits")).distinct(), "inherits", "left_anti").head(1)
    if lost:
        raise ProfileError(f"unknown parent {lost[0]['inherits']} of {lost[0]['name']}")
    n, far = names.count(), 1
    jumps = [names.where("inherits IS NOT NULL")]
    while jumps[-1].head(1):
        if far >= n:
            raise ProfileError(f"profiles inherit in a circle: {jumps[-1].head(1)[0]['name']}")
        up = jumps[-1].select(F.col("name").alias("inherits"), F.col("inherits").alias("next"))
        jumps.append(written(jumps[-1].join(up, "inherits").select("name", F.col("next").alias("inherits"))))
        far *= 2
    known = names.select("name", F.col("name").alias("at"), F.lit(0).cast("long").alias("depth"))
    for k, jump in enumerate(jumps[:-1]):
        onward = known.select(F.col("name").alias("inherits"), "at", (F.col("depth") + (1 << k)).alias("depth"))
        known = written(known.union(jump.join(onward, "inherits").select("name", "at", "depth")))
    return known


def resolve(profiles: DataFrame) -> DataFrame:
    """(name, key, value): every setting of each profile after a deep merge along its chain.

    ``profiles`` is (name, inherits, key, value) in long form, keys dotted
    paths. Maps merge; anything else replaces: an inherited leaf goes if a
    nearer profile has a leaf at its path, above it (a value in place of the
    map) or below it (a map in place of the value).
    """
    own = profiles.where("key IS NOT NULL").select(F.col("name").alias("at"), "key", "value")
    near = ancestors(profiles).join(own, "at").groupBy("name", "key").agg(F.min("depth").alias("depth"), F.min_by("value", "depth").alias("value"))
    leaves = written(near)
    steps = F.split("key", r"\.")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ".")))
    paths = leaves.where(F.size(steps) > 1).select("name", "key", "depth", above.alias("path"))
    nearest = leaves.select("name", F.col("key").alias("path"), F.col("depth").alias("at_path"))
    under_value = paths.join(nearest, ["name", "path"]).where("at_path < depth").select("name", "key").distinct()
    maps = paths.groupBy("name", F.col("path").alias("key")).agg(F.min("depth").alias("map_depth"))
    kept = leaves.join(under_value, ["name", "key"], "left_anti").join(maps, ["name", "key"], "left")
    return kept.where("map_depth IS NULL OR map_depth >= depth").select("name", "key", "value")


def compose(channels: DataFrame, genres: DataFrame, most_genres: int = 1000) -> DataFrame:
    """Every channel with every genre: both are catalogues of some dozen rows, so each pair is a profile by design.

    The genres are read as one array (more than ``most_genres`` are an error)
    and taken through by each channel: no cross join. Limits are the smaller of
    both; the compressor's ratio is drawn towards 1 by the channel's scale.
    """
    rows = genres.limit(most_genres + 1).collect()
    if len(rows) > most_genres:
        raise ProfileError(f"more than {most_genres} genres")
    array = F.array(*(F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(r, genres.schema, strict=True))) for r in rows))
    both = channels.select(F.struct("*").alias("c"), F.explode(array).alias("g")) if rows else channels.limit(0).select(F.struct("*").alias("c"), F.lit(None).cast(genres.schema).alias("g"))
    least = lambda n: F.least(f"c.{n}", f"g.{n}").alias(n)
    return both.select(
        F.concat(F.lit("CG_"), "c.key", F.lit("__"), "g.key").alias("key"), F.concat("c.label", F.lit(" + "), "g.label").alias("label"), F.col("c.target").alias("target"), (F.col("c.target") - F.col("c.concession")).alias("min_target"),
        F.round(0.55 * F.col("c.lra") + 0.45 * F.col("g.lra"), 1).alias("target_lra"), least("max_wet"), least("max_dense"), least("max_lra_reduction"), F.bround(1.0 + (F.col("g.ratio") - 1.0) * F.col("c.scale"), 3).alias("ratio"),
    )
