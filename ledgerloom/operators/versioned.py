"""Reads of append-only tables in which the row with the highest version of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order (version first). Null keys are a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def as_of(df: DataFrame, version: str, limit: int, keys: list[str], order: list[Column]) -> DataFrame:
    """:func:`latest_by` of the rows up to a version."""
    return latest_by(df.where(F.col(version) <= limit), keys, order)


def newest_values(df: DataFrame, keys: list[str], version: Column, columns: list[str]) -> DataFrame:
    """Each column's value at the highest version; a column at a time."""
    return df.groupBy(*keys).agg(*[F.max_by(c, version).alias(c) for c in columns])


def filled(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All primary rows, and the fallback rows of keys that have none."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))


def missing(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows without a target row of the same keys."""
    return source.join(target.select(*keys).distinct(), keys, "left_anti")


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is in a list of keys; repeated keys count once."""
    return df.join(keys.select(*on), on, "left_semi")


#: Bits of the map of :func:`maybe_among` (32 MB), and of one of its rows.
MAP_BITS, MAP_ROW = 1 << 28, 1 << 15


def maybe_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among ``keys``, by a map of hashed keys of fixed size that is sent to all tasks; none that is gets lost."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    spots = keys.select(spot(key).alias("_spot")).withColumn("_row", F.floor(F.col("_spot") / MAP_ROW).cast("int"))
    # 32 rows to a task: more than 128 are sorted (and spilled) by Spark
    bits = spots.repartition(MAP_BITS // MAP_ROW // 32, "_row").groupBy("_row").agg(F.bitmap_construct_agg(F.col("_spot") % MAP_ROW).alias("_bits"))
    at = (spot(key) % MAP_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    joined = df.join(F.broadcast(bits), F.floor(spot(key) / MAP_ROW).cast("int") == F.col("_row"))
    return joined.where(F.call_function("getbit", byte, at % 8) == 1).drop("_row", "_bits")
