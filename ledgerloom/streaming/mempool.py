"""Mempool streams: samples, first sight of transactions, matches of watches.

The batch forms are in ``operators.mempool``; the functions here give streaming DataFrames. Event
times bound the state: what is later than the watermark is left out. Sessions of watches and other
folds by key are in :mod:`stateful`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mempool
from ..sources.files import mempool_entries


def samples(snapshots: DataFrame) -> DataFrame:
    """Sample rows of a stream of snapshots (fetched_at, entries); the same rows as in batch."""
    return mempool.sampled(mempool_entries(snapshots))


def first_seen(transactions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Transactions (txid, seen_at, outputs) without repeats within the watermark's delay."""
    return transactions.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["txid"])


def feeds(caught_up: DataFrame, live: DataFrame) -> DataFrame:
    """Transactions of the current mempool and of the live stream, with where they come from."""
    return caught_up.withColumn("source", F.lit("catchup")).unionByName(live.withColumn("source", F.lit("live")))


def matches(transactions: DataFrame, watches: DataFrame) -> DataFrame:
    """(watch_id, txid, seen_at, paid) of transactions whose outputs pay a watch at least its minimum.

    outputs: array<struct<vout, address, value_base>>; all outputs of a transaction are in its row, so
    the sum needs no state. ``watches`` is static.
    """
    paid_to = transactions.withColumn("address", F.explode(F.array_distinct(F.transform("outputs", lambda o: o["address"]))))
    own = F.filter("outputs", lambda o: o["address"] == F.col("address"))
    paid = F.aggregate(own, F.lit(0).cast("decimal(38,0)"), lambda s, o: (s + o["value_base"]).cast("decimal(38,0)"))
    hit = paid_to.withColumn("paid", paid).join(watches.select("watch_id", "address", "min_value"), "address")
    return hit.where(F.col("paid") >= F.coalesce("min_value", F.lit(0))).select("watch_id", "txid", "seen_at", "paid")
