"""State transitions of the ledger: windows of blocks, rewinds, reorganizations, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger


def pending_blocks(batch: DataFrame, applied: DataFrame) -> DataFrame:
    """Blocks of the batch that aren't applied with the same hash."""
    return batch.join(applied.select("block_height", "block_hash"), ["block_height", "block_hash"], "left_anti")


def reorg_height(batch: DataFrame, applied: DataFrame) -> DataFrame:
    """The least height at which the batch has another hash; null if there is none."""
    a = applied.select("block_height", F.col("block_hash").alias("applied_hash"))
    return batch.join(a, "block_height").where("block_hash <> applied_hash").agg(F.min("block_height").alias("reorg_height"))


def canonical(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """References whose block is the stored one at its height."""
    return refs.join(blocks.select("block_height", "block_hash").distinct(), ["block_height", "block_hash"], "left_semi")


def missing_prevouts(spends: DataFrame, known: DataFrame) -> DataFrame:
    return spends.join(known.select(F.col("output_key").alias("spent_output_key")), "spent_output_key", "left_anti")


def double_spends(spends: DataFrame, state: DataFrame) -> DataFrame:
    """Spends of outputs that another transaction, block or input has taken already."""
    old = state.where("spent_by_txid is not null").select(F.col("output_key").alias("spent_output_key"), F.col("spent_by_txid").alias("by"), F.col("spent_in_block").alias("at"), F.col("input_index").alias("nth"))
    return spends.join(old, "spent_output_key").where("by <> spent_by_txid or at <> spent_in_block or nth <> input_index")


def apply_window(state: DataFrame, creates: DataFrame, spends: DataFrame) -> DataFrame:
    """The state (outputs with their spend) after a window; its creates come before its spends.

    Applying a window again changes nothing: keys that the state has are not created twice, and a
    spend that is recorded stays.
    """
    fresh = creates.join(state.select("output_key"), "output_key", "left_anti")
    columns = ["output_key", "txid", "block_height", "address", "value_base", "is_spendable"]
    now = state.select(*columns, "spent_by_txid", "spent_in_block", "input_index").unionByName(
        fresh.select(*columns, F.lit(None).cast("string").alias("spent_by_txid"), F.lit(None).cast("long").alias("spent_in_block"), F.lit(None).cast("long").alias("input_index"))
    )
    new = spends.select(F.col("spent_output_key").alias("output_key"), F.col("spent_by_txid").alias("by"), F.col("spent_in_block").alias("at"), F.col("input_index").alias("nth"))
    joined = now.join(new, "output_key", "left")
    return joined.select(*columns, F.coalesce("spent_by_txid", "by").alias("spent_by_txid"), F.coalesce("spent_in_block", "at").alias("spent_in_block"), F.coalesce("input_index", "nth").alias("input_index"))


def require_prevouts(state: DataFrame, creates: DataFrame, spends: DataFrame) -> None:
    """An error if a window spends an output that neither the state nor the window has, or one that is taken already."""
    known = state.select("output_key").unionByName(creates.select("output_key"))
    if (lacking := missing_prevouts(spends, known).select("spent_output_key", "spent_by_txid").first()) is not None:
        raise ValueError(f"{lacking['spent_by_txid']} spends {lacking['spent_output_key']}, which isn't there")
    if (twice := double_spends(spends, state).select("spent_output_key", "spent_by_txid", "by").first()) is not None:
        raise ValueError(f"{twice['spent_by_txid']} spends {twice['spent_output_key']}, which {twice['by']} has spent")


def apply_window_strictly(state: DataFrame, creates: DataFrame, spends: DataFrame) -> DataFrame:
    """:func:`apply_window`, after :func:`require_prevouts`."""
    require_prevouts(state, creates, spends)
    return apply_window(state, creates, spends)


def materialize(creates: DataFrame, spends: DataFrame, processed: DataFrame, height: int) -> dict[str, DataFrame]:
    """The tables of the current state as of a height, from the facts up to it: utxo, balances, applied_blocks."""
    made, taken = creates.where(F.col("block_height") <= height), spends.where(F.col("spent_in_block") <= height)
    return _state(ledger.current_utxo(made, taken), processed, height)


def materialize_outputs(outputs: DataFrame, processed: DataFrame, height: int) -> dict[str, DataFrame]:
    """:func:`materialize` of outputs that carry the block of their spend (spent_in_block)."""
    return _state(ledger.unspent(outputs.where(F.col("block_height") <= height), height), processed, height)


def _state(utxo: DataFrame, processed: DataFrame, height: int) -> dict[str, DataFrame]:
    blocks = processed.where(F.col("block_height") <= height).select("block_height", "block_hash", "previous_hash")
    return {"utxo": utxo.withColumn("version", F.lit(height).cast("long")), "balances": ledger.balances(utxo), "applied_blocks": blocks}


def backfill_facts(facts: DataFrame, creates: DataFrame, spends: DataFrame, through: int) -> DataFrame:
    """Transaction facts made anew up to a height; the stored ones above it stay."""
    fresh = ledger.transactions(creates.where(F.col("block_height") <= through), spends.where(F.col("spent_in_block") <= through))
    return fresh.select(*facts.columns).unionByName(facts.where(F.col("block_height") > through))


def backfill_in_place(spark: SparkSession, path: str, creates: DataFrame, spends: DataFrame, low: int, high: int, name: str = "transactions") -> list[str]:
    """Make a stored table of transaction facts anew for the heights from ``low`` to ``high``; only their buckets are written (:mod:`..sources.heights`).

    ``spends`` and ``creates`` hold all that these transactions refer to: outputs that they spend may be
    older. Spends that carry the value of what they take need no join with ``creates``.
    """
    from ..sources import heights

    taken = spends.where(F.col("spent_in_block").between(low, high))
    made = creates.where(F.col("block_height").between(low, high))
    return heights.replace(spark, path, {name: ledger.transactions_of(made, ledger.valued(taken, creates))}, {name: "block_height"}, low, high)


def rewind(state: DataFrame, height: int) -> DataFrame:
    """The state before a height: later outputs vanish, outputs spent from there on are unspent."""
    undo = lambda c: F.when(F.col("spent_in_block") < height, F.col(c)).alias(c)
    own = state.where(F.col("block_height") < height)
    return own.select("output_key", "txid", "block_height", "address", "value_base", "is_spendable", undo("spent_by_txid"), undo("spent_in_block"), undo("input_index"))


def state_balances(state: DataFrame) -> DataFrame:
    return ledger.balances(state.where("spent_by_txid is null"))


def state_of(creates: DataFrame, spends: DataFrame) -> DataFrame:
    """The state in one go."""
    return ledger.utxo_history(creates, spends).select("output_key", "txid", "block_height", "address", "value_base", "is_spendable", "spent_by_txid", "spent_in_block", "input_index")


def repaired(spends: DataFrame, current: DataFrame, history: DataFrame, before: int) -> DataFrame:
    """Outputs that a window spends and the current state lacks, from history as of the height before it; unspent ones only."""
    lacking = missing_prevouts(spends, current).select(F.col("spent_output_key").alias("output_key")).distinct()
    old = history.where(F.col("block_height") <= before).where(F.col("spent_in_block").isNull() | (F.col("spent_in_block") > before))
    return old.join(lacking, "output_key", "left_semi")


def reorganized(creates: DataFrame, spends: DataFrame, new_creates: DataFrame, new_spends: DataFrame, height: int) -> DataFrame:
    """The state after the blocks from ``height`` on were replaced: rewind, then apply the new ones."""
    return apply_window(rewind(state_of(creates, spends), height), new_creates, new_spends)


def online_heights(tails: DataFrame, depth: int, most: int) -> DataFrame:
    """Heights to read again: from ``depth`` blocks before the tail to the target, ``most`` new ones at most."""
    low = F.greatest(F.lit(0), F.least(F.col("tail") + 1, F.least("tail", "target") - depth + 1))
    high = F.least(F.col("target"), F.col("tail") + most)
    return tails.select(F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))).alias("block_height"))


def balance_invariant(utxo: DataFrame, moves: DataFrame) -> DataFrame:
    """Addresses whose balance by unspent outputs differs from credits less debits; none in a sound ledger."""
    held = ledger.balances(utxo).select("address", "balance")
    both = held.join(ledger.movement_balances(moves).withColumnRenamed("balance", "moved"), "address", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")
    return both.select("address", zero("balance").alias("balance"), zero("moved").alias("moved")).where("balance <> moved")
