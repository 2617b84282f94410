"""Operators over ordered heights and keys.

Running sums have two levels: sums of spans of keys, whose order alone is global (a row for each
``SPAN`` heights), and a scan inside each span. So no task holds all blocks, let alone facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a span.
SPAN = 10_000


def running_sum(rows: DataFrame, key: str, value: Column, name: str = "upto") -> DataFrame:
    """``rows`` (a row for each whole-number ``key``) with the sum of ``value`` over all keys up to their own."""
    span, part = F.floor(F.col(key) / SPAN), F.col("_part")
    own = rows.withColumns({"_span": span, "_part": value})
    spans = own.groupBy("_span").agg(F.sum(part).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(part).over(Window.partitionBy("_span").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return own.join(spans.select("_span", before.alias("_before")), "_span").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_span", "_part", "_before")


def equal_work_buckets(counts: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """Least key of each bucket of about ``size`` rows; ``counts`` has a row per key."""
    bucket = F.floor(F.col("upto") / size).cast("long")
    return running_sum(counts.select(key, n), key, F.col(n)).select(key, bucket.alias("bucket")).groupBy("bucket").agg(F.min(key).alias("first_key"))


def sync_frontier(heights: DataFrame, base: int) -> DataFrame:
    """The highest height up to which all heights above ``base`` are there; ``base`` if the next is missing."""
    own = heights.where(F.col("block_height") > base).select("block_height").distinct()
    run = running_sum(own, "block_height", F.lit(1)).withColumn("gap", F.col("block_height") - F.col("upto"))
    return run.agg(F.coalesce(F.max(F.when(F.col("gap") == base, F.col("block_height"))), F.lit(base)).cast("long").alias("frontier"))


def chain_violations(blocks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Blocks that don't follow the one before: a height is left out, or the previous hash differs.

    The first block of a batch is compared with the block of ``stored`` just below it, if given and there.
    """
    if stored is not None:
        first = blocks.agg(F.min("block_height").alias("first"))  # one row
        below = stored.select("block_height", "block_hash").join(F.broadcast(first), F.col("block_height") == F.col("first") - 1)
        blocks = blocks.select("block_height", "block_hash", "previous_hash").unionByName(below.select("block_height", "block_hash", F.lit(None).cast("string").alias("previous_hash")))
    own = blocks.select("block_height", "previous_hash").join(F.broadcast(blocks.agg(F.min("block_height").alias("lowest"))), F.col("block_height") > F.col("lowest"))  # one row
    below = blocks.select((F.col("block_height") + 1).alias("block_height"), F.col("block_hash").alias("hash_before"), F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "gap").when(~F.col("previous_hash").eqNullSafe(F.col("hash_before")), "previous hash")
    return own.join(below, "block_height", "left").select("block_height", reason.alias("reason")).where("reason is not null")


def contiguous_range(blocks: DataFrame) -> DataFrame:
    lo, hi, n = F.min("block_height"), F.max("block_height"), F.count_distinct("block_height")
    return blocks.agg(lo.alias("first"), hi.alias("last"), n.alias("blocks"), F.coalesce(hi - lo + 1 == n, F.lit(False)).alias("contiguous"))


def checked_page(limit: int, offset: int) -> None:
    """An error unless the limit is 1 to 500 and the offset 0 to 100000."""
    if not 1 <= limit <= 500 or not 0 <= offset <= 100_000:
        raise ValueError(f"page of {limit} rows from {offset}: at most 500 rows, and offsets up to 100000")


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """An offset page in a total order; limits are 1 to 500, offsets 0 to 100000."""
    checked_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def key_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int = 50) -> DataFrame:
    """The rows after a key, in key order; ``next_key`` on every row is where the next page starts, null if this one isn't full."""
    if after is not None:
        more = F.lit(False)
        for i in range(len(keys)):
            same = F.lit(True)
            for k, v in zip(keys[:i], after[:i], strict=True):
                same = same & (F.col(k) == F.lit(v))
            more = more | (same & (F.col(keys[i]) > F.lit(after[i])))
        df = df.where(more)
    rows = df.orderBy(*keys).limit(limit)
    whole = Window.partitionBy()
    return rows.withColumn("next_key", F.when(F.count("*").over(whole) == limit, F.max(F.concat_ws(":", *keys)).over(whole)))
