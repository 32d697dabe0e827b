"""Sharding by extendible hashing: a directory indexed by hash-prefix bits.

Every row has a 60-bit hash of its key. A bucket is a prefix of it; only buckets
over the byte limit split on another bit, until each fits or holds one hash
value alone. Bytes are summed by prefix: first at about the depth that the
total calls for, then, round by round, only for the rows of buckets that are
still too large. What one key alone has beyond the limit is cut into overflow
pages by running byte counts, so that every shard of more than one row fits.
``write_shards`` writes the rows, a folder to a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, shared_dir

BITS = 60
#: Bits a round adds below the buckets that are still too large.
STEP = 6


def key_hash(key: str = "doc_id") -> Column:
    """The top 60 bits of the MD5 of the key as text; null keys are the text ``null``."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _prefix(h, depth) -> Column:
    return F.shiftright(h, F.lit(BITS) - depth) if isinstance(depth, Column) else F.shiftright(h, BITS - depth)


def _sums(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(depth, prefix, bytes, least, most) of the prefixes of depths low..high; rows (h, bytes, least, most)."""
    finest = rows.groupBy(_prefix(F.col("h"), high).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
    each = finest.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "*")
    return each.groupBy("depth", F.expr(f"shiftright(fine, {high} - depth)").alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"), F.min("least").alias("least"), F.max("most").alias("most"))


def directory(sized: DataFrame, byte_limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes): the buckets, from rows (h, n_bytes). Empty without rows."""
    rows = sized.select("h", "n_bytes", F.col("h").alias("least"), F.col("h").alias("most"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / byte_limit)))) + 2)
    found = None
    while True:
        sums = materialise(_sums(rows, low, high))
        fits = (F.col("n_bytes") <= byte_limit) | (F.col("least") == F.col("most"))
        parents = sums.where(~fits).select((F.col("depth") + 1).alias("d"), F.col("prefix").alias("p"))
        under = sums.where(F.col("depth") > low).join(parents, (F.col("depth") == F.col("d")) & (F.expr("shiftright(prefix, 1)") == F.col("p"))).drop("d", "p")
        leaves = under.unionByName(sums.where(F.col("depth") == low)).where(fits).select("depth", "prefix", F.col("n_bytes").alias("shard_bytes"))
        found = leaves if found is None else found.unionByName(leaves)
        over = sums.where(~fits & (F.col("depth") == high)).select(F.col("prefix").alias("open"))
        if high == BITS or not over.head(1):
            return materialise(found)
        rows = materialise(rows.join(over, _prefix(F.col("h"), high) == F.col("open"), "left_semi"))
        low, high = high + 1, min(BITS, high + STEP)


def _sized(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), key_hash(key).alias("h"))


def _entries(buckets: DataFrame) -> tuple[int, DataFrame]:
    """(bits, (entry, depth, prefix, shard_bytes)): the directory, an entry for each prefix of so many bits; shallower buckets have several entries, deeper ones share one."""
    at = buckets.agg(F.percentile_approx("depth", 0.5)).first()[0] or 0
    entry = F.when(F.col("depth") <= at, F.sequence(F.expr(f"shiftleft(prefix, greatest(0, {at} - depth))"), F.expr(f"shiftleft(prefix + 1, greatest(0, {at} - depth)) - 1"))).otherwise(F.array(F.expr(f"shiftright(prefix, greatest(0, depth - {at}))")))
    return at, buckets.select(F.explode(entry).alias("entry"), "depth", "prefix", "shard_bytes")


def _pages(over: DataFrame, byte_limit: int) -> DataFrame:
    """``over`` (depth, prefix, row, n_bytes and others; rows of buckets beyond the limit) with the overflow page of each.

    Rows of more than half the limit have a page each, after the pages of the
    others: those are cut where the limit less the largest of them is reached,
    which is at least half the limit, so one large row makes no small pages.
    """
    bucket, small = ["depth", "prefix"], F.col("n_bytes") * 2 <= byte_limit
    over = over.withColumns({"part": F.shiftright("row", 16), "few": F.when(small, F.col("n_bytes")).otherwise(F.lit(0)), "big": (~small).cast("long")})
    parts = over.groupBy(*bucket, "part").agg(F.sum("few").alias("s"), F.sum("big").alias("b"), F.max("few").alias("m"))
    upto, all_ = Window.partitionBy(*bucket).orderBy("part"), Window.partitionBy(*bucket)
    room = F.lit(byte_limit) - F.max("m").over(all_)
    ahead = parts.select(*bucket, "part", (F.sum("s").over(upto) - F.col("s")).alias("ahead"), (F.sum("b").over(upto) - F.col("b")).alias("ahead_big"), room.alias("room"), F.sum("s").over(all_).alias("all_few"))
    within = Window.partitionBy(*bucket, "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = over.withColumns({k: F.coalesce(F.sum(k).over(within), F.lit(0)).alias(k) for k in ("few", "big")} | {"alone": ~small}).join(ahead, [*bucket, "part"])
    page = F.when(F.col("alone"), F.expr("all_few div room + 1 + ahead_big + big")).otherwise(F.expr("(ahead + few) div room"))
    return placed.withColumn("page", page.cast("long")).drop("part", "few", "big", "alone", "ahead", "ahead_big", "room", "all_few")


def shards(docs: DataFrame, byte_limit: int = 256 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, page, shard_bytes) of every row: its bucket and overflow page.

    A null text has no bytes; null keys are one key. Rows of one key stay in
    one bucket; shard_bytes is the bucket's. Only a row that is over the limit
    by itself makes a page over the limit. An empty table has no shard.
    """
    sized = materialise(_sized(docs, key, text).withColumn("row", F.monotonically_increasing_id()))
    at, entries = _entries(directory(sized, byte_limit))
    found = sized.withColumn("mine", _prefix(F.col("h"), at)).join(entries, F.expr(f"mine = entry AND shiftright(h, {BITS} - depth) = prefix"))
    columns = ["doc_id", "n_bytes", "depth", "prefix", "page", "shard_bytes"]
    fit = found.where(F.col("shard_bytes") <= byte_limit).withColumn("page", F.lit(0).cast("long")).select(columns)
    return fit.unionByName(_pages(found.where(F.col("shard_bytes") > byte_limit), byte_limit).select(columns))


def write_shards(docs: DataFrame, byte_limit: int = 256 << 20, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[str, str]:
    """Write ``docs`` as Parquet, a folder to a shard; returns the folder and the name of the partition column.

    Rows and limits are those of ``shards``. The column is called shard, with
    underscores after it where ``docs`` has that name; its values are
    depth-prefix-page. Only the rows of buckets that one key fills beyond the
    limit are written twice.
    """
    folder = folder or shared_dir(docs.sparkSession)
    column = "shard"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    at, entries = _entries(directory(materialise(_sized(docs, key, text)), byte_limit))
    own = {c: fresh(c) for c in ("h", "entry", "depth", "prefix", "shard_bytes")}
    entries = entries.withColumnsRenamed(own)
    h, depth, prefix, size = (F.col(own[c]) for c in ("h", "depth", "prefix", "shard_bytes"))
    deep = F.expr(f"shiftright({own['h']}, {BITS} - {own['depth']})") == prefix
    found = docs.withColumn(own["h"], key_hash(key)).join(entries, (_prefix(h, at) == F.col(own["entry"])) & deep)
    user = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("user")
    name = lambda page: F.concat_ws("-", "depth", "prefix", page).alias("shard")
    rows = found.where(size <= byte_limit).select(depth.alias("depth"), prefix.alias("prefix"), user).select(name(F.lit(0)), "user")
    over = entries.where(size > byte_limit)
    if over.head(1):
        n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes")
        large = materialise(found.where(size > byte_limit).select(depth.alias("depth"), prefix.alias("prefix"), n_bytes, F.monotonically_increasing_id().alias("row"), user))
        rows = rows.unionByName(_pages(large, byte_limit).select(name(F.col("page")), "user"))
    rows.select("user.*", F.col("shard").alias(column)).repartition(column).write.partitionBy(column).parquet(folder)
    return folder, column


def read_shards(spark, folder: str, column: str) -> DataFrame:
    """The rows of all shards with depth, prefix and page as a struct (``column``) in place of the shard's name."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(folder)
    part = lambda i: F.split_part(F.col(column).cast("string"), F.lit("-"), F.lit(i))
    return rows.withColumn(column, F.struct(part(1).cast("int").alias("depth"), part(2).cast("long").alias("prefix"), part(3).cast("long").alias("page")))
