"""Unspent outputs, movements, balances and transaction facts.

``creates``: output_key, txid, tx_index, vout, block_height, block_hash, block_time, address,
value_base, is_spendable; ``spends``: spent_output_key, spent_by_txid, spent_in_block,
spent_tx_index, input_index. Both hold one row per key (read them with ``latest_by``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import AMOUNT, fee, total, total_if
from .versioned import latest_by

MOVEMENT = ["movement_id", "block_height", "txid", "tx_index", "entry_index", "address", "asset_address", "direction", "amount_base", "output_key"]


def current_utxo(creates: DataFrame, spends: DataFrame) -> DataFrame:
    return creates.join(spends.select(F.col("spent_output_key").alias("output_key")), "output_key", "left_anti")


def unspent(outputs: DataFrame, height: int | None = None) -> DataFrame:
    """:func:`current_utxo` of outputs that carry the block of their spend (spent_in_block), as of a height; no join."""
    later = F.lit(False) if height is None else F.col("spent_in_block") > height
    return outputs.where(F.col("spent_in_block").isNull() | later).drop("spent_in_block")


def utxo_history(creates: DataFrame, spends: DataFrame) -> DataFrame:
    """Outputs with the spend that took them, null if there is none."""
    return creates.join(spends.withColumnRenamed("spent_output_key", "output_key"), "output_key", "left")


def history_as_of(creates: DataFrame, spends: DataFrame, keys: DataFrame, height: int) -> DataFrame:
    """Outputs of a list of keys (output_key) as of a height, with the spend that had taken them by then.

    Both inputs may hold several versions of a key; rows above the height are left out before the
    latest one is taken, so that a later version doesn't hide the one that counted then.
    """
    made = creates.where(F.col("block_height") <= height).join(keys.select("output_key").distinct(), "output_key", "left_semi")
    taken = spends.where(F.col("spent_in_block") <= height).withColumnRenamed("spent_output_key", "output_key").join(keys.select("output_key").distinct(), "output_key", "left_semi")
    made = latest_by(made, ["output_key"], [F.desc("block_height"), F.asc("txid"), F.asc("value_base"), F.asc("address")])
    taken = latest_by(taken, ["output_key"], [F.desc("spent_in_block"), F.asc("spent_by_txid"), F.asc("input_index")])
    return made.join(taken, "output_key", "left")


def utxo_versions(state: DataFrame) -> DataFrame:
    """The state's rows with their version: the block that spent the output, else the one that made it."""
    return state.withColumn("version", F.coalesce("spent_in_block", "block_height"))


def credit_movements(creates: DataFrame) -> DataFrame:
    own = creates.where("is_spendable and address <> ''")
    return own.select(F.concat(F.lit("core-credit:"), "output_key").alias("movement_id"), "block_height", "txid", "tx_index", F.col("vout").alias("entry_index"), "address", F.lit("").alias("asset_address"), F.lit("credit").alias("direction"), F.col("value_base").alias("amount_base"), "output_key")


def debit_movements(spends: DataFrame, creates: DataFrame) -> DataFrame:
    """Spends of addressed outputs, at the spending transaction's place."""
    return debits_of(resolved(spends, creates))


def resolved(spends: DataFrame, creates: DataFrame) -> DataFrame:
    """Spends with the address, value and spendability of what they take."""
    return spends.join(creates.select(F.col("output_key").alias("spent_output_key"), "address", "value_base", "is_spendable"), "spent_output_key")


def debits_of(taken: DataFrame) -> DataFrame:
    """:func:`debit_movements` of :func:`resolved` spends."""
    return taken.where("is_spendable and address <> ''").withColumnRenamed("spent_output_key", "output_key").select(
        F.concat_ws(":", F.lit("core-debit"), "output_key", "spent_by_txid", F.col("input_index").cast("string")).alias("movement_id"), F.col("spent_in_block").alias("block_height"), F.col("spent_by_txid").alias("txid"),
        F.col("spent_tx_index").alias("tx_index"), F.col("input_index").alias("entry_index"), "address", F.lit("").alias("asset_address"), F.lit("debit").alias("direction"), F.col("value_base").alias("amount_base"), "output_key",
    )


def movements(creates: DataFrame, spends: DataFrame) -> DataFrame:
    return credit_movements(creates).unionByName(debit_movements(spends, creates))


def balances(utxo: DataFrame) -> DataFrame:
    own = utxo.where("is_spendable and address <> ''")
    return own.groupBy("address").agg(total(F.col("value_base")).alias("balance")).select("address", F.lit("").alias("asset_address"), "balance")


def movement_balances(moves: DataFrame) -> DataFrame:
    signed = F.when(F.col("direction") == "credit", F.col("amount_base")).otherwise(-F.col("amount_base"))
    return moves.groupBy("address").agg(total(signed).alias("balance"))


def input_totals(spends: DataFrame, creates: DataFrame) -> DataFrame:
    s = spends.join(creates.select("output_key", "value_base"), spends["spent_output_key"] == F.col("output_key"))
    return s.groupBy(F.col("spent_by_txid").alias("txid")).agg(F.count("*").alias("resolved_inputs"), total(F.col("value_base")).alias("input_total"))


def transactions(creates: DataFrame, spends: DataFrame) -> DataFrame:
    """A row of facts for each transaction; coinbase: it spends nothing."""
    return transactions_of(creates, valued(spends, creates))


def valued(spends: DataFrame, creates: DataFrame) -> DataFrame:
    """Spends with the value of what they take, null where it isn't known; those that have it stay."""
    if "value_base" in spends.columns:
        return spends
    return spends.join(creates.select(F.col("output_key").alias("spent_output_key"), "value_base"), "spent_output_key", "left")


def transactions_of(creates: DataFrame, taken: DataFrame) -> DataFrame:
    """:func:`transactions` of :func:`valued` spends."""
    outs = creates.groupBy("txid").agg(F.min("block_height").alias("block_height"), F.min("block_time").alias("block_time"), F.min("tx_index").alias("tx_index"), F.count("*").alias("output_count"), total(F.col("value_base")).alias("output_total"))
    ins = taken.groupBy(F.col("spent_by_txid").alias("txid")).agg(F.count("*").alias("input_count"), total(F.col("value_base")).alias("input_total"))
    all_ = outs.join(ins, "txid", "left")
    all_ = all_.select("txid", "block_height", "block_time", "tx_index", F.coalesce("input_count", F.lit(0)).cast("long").alias("input_count"), "output_count", F.coalesce("input_total", F.lit(0)).cast(AMOUNT).alias("input_total"), "output_total")
    coinbase = F.col("input_count") == 0
    return all_.withColumn("is_coinbase", coinbase).withColumn("fee_base", fee(coinbase, F.col("input_total"), F.col("output_total")))


def address_activity(moves: DataFrame) -> DataFrame:
    credit = F.col("direction") == "credit"
    return moves.groupBy("address").agg(total_if(credit, F.col("amount_base")).alias("received"), total_if(~credit, F.col("amount_base")).alias("sent"), F.count_distinct("txid").alias("tx_count"))


def address_holdings(utxo: DataFrame) -> DataFrame:
    own = utxo.where("is_spendable and address <> ''")
    return own.groupBy("address").agg(total(F.col("value_base")).alias("balance"), F.count("*").alias("utxo_count"))


def address_summary(moves: DataFrame, utxo: DataFrame) -> DataFrame:
    """Current holdings and history of each address; zeros where one of them is missing."""
    both = address_activity(moves).join(address_holdings(utxo), "address", "full_outer")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return both.select("address", zero("balance", AMOUNT), zero("received", AMOUNT), zero("sent", AMOUNT), zero("tx_count", "long"), zero("utxo_count", "long"))


def address_tx_amounts(moves: DataFrame) -> DataFrame:
    credit = F.col("direction") == "credit"
    return moves.groupBy("address", "block_height", "txid").agg(F.max("tx_index").alias("tx_index"), total_if(credit, F.col("amount_base")).alias("received"), total_if(~credit, F.col("amount_base")).alias("sent"))


def balance_deltas(creates: DataFrame, spends: DataFrame, known: DataFrame) -> DataFrame:
    """Net change of each address by a batch; ``known``: outputs that its spends may refer to."""
    moves = credit_movements(creates).unionByName(debit_movements(spends, known))
    return movement_balances(moves).withColumnRenamed("balance", "delta")


def next_balances(now: DataFrame, deltas: DataFrame) -> DataFrame:
    """Balances after a batch, with a flag where one would be negative."""
    both = now.select("address", "balance").join(deltas, "address", "full_outer")
    after = (F.coalesce("balance", F.lit(0)).cast(AMOUNT) + F.coalesce("delta", F.lit(0)).cast(AMOUNT)).cast(AMOUNT)
    return both.select("address", after.alias("balance")).withColumn("negative", F.col("balance") < 0)


def external_spends(creates: DataFrame, spends: DataFrame) -> DataFrame:
    """Spent keys that the batch itself doesn't create."""
    return spends.select(F.col("spent_output_key").alias("output_key")).distinct().join(creates.select("output_key"), "output_key", "left_anti")


def touched_outputs(creates: DataFrame, spends: DataFrame) -> DataFrame:
    return creates.select("output_key").union(spends.select("spent_output_key")).distinct()


def pro_rata(inputs: DataFrame, target: str) -> DataFrame:
    """Each group's target dealt out by weight: rounded down, the rest to the last address.

    inputs: group, address, weight and the target column.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("group")
    whole, weight, to = F.sum(F.col("weight").cast("decimal(20,0)")).over(w), F.col("weight").cast("decimal(20,0)"), F.col(target).cast("decimal(18,0)")
    # whole numbers: a quotient of decimals is rounded to six places before it is rounded down
    share = F.call_function("div", to * weight, whole).cast(AMOUNT)
    dealt = inputs.select("group", "address", F.col(target), share.alias("share"), F.row_number().over(w.orderBy(F.desc("address"))).alias("back"))
    return dealt.select("group", "address", F.when(F.col("back") == 1, (F.col("share") + F.col(target).cast(AMOUNT) - F.sum("share").over(w)).cast(AMOUNT)).otherwise(F.col("share")).alias("allocated"))
