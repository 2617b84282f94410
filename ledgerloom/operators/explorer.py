"""Explorer reads with arguments.

Arguments come as a table, so that one plan answers one or many: ``texts`` (text), ``txids`` (txid),
``addresses`` (address), ``refs`` (ref). A single argument is a table of one row (:func:`one`). The
arguments are joined first, so only what they ask for goes on, and pages are cut for each argument
before facts are joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ledger
from .sequence import checked_page
from .versioned import latest_by

#: Stored blocks above the processed ones in which a raw transaction is looked for.
RAW_BLOCKS = 1000
DIGITS = r"^[0-9]+$"


def one(spark: SparkSession, name: str, value) -> DataFrame:
    """A table of one argument."""
    return spark.range(1).select(F.lit(value).alias(name))


def _paged(rows: DataFrame, key: str, order: list[Column], limit: int, offset: int) -> DataFrame:
    """The rows of a page for each value of ``key``."""
    checked_page(limit, offset)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("nth", nth).where((F.col("nth") > offset) & (F.col("nth") <= offset + limit)).drop("nth")


def search(texts: DataFrame, refs: DataFrame, blocks: DataFrame, addresses: DataFrame) -> DataFrame:
    """(text, priority, kind, found, block_height): what each text finds, blanks around it aside.

    A text of figures only finds a block by its height and nothing else; any other finds a
    transaction (refs: txid, block_height), a block by its hash and an address, in this order.
    """
    asked = texts.select("text", F.trim("text").alias("q")).where("q <> ''").distinct()
    figures, words = asked.where(F.col("q").rlike(DIGITS)).withColumn("h", F.col("q").try_cast("long")), asked.where(~F.col("q").rlike(DIGITS))
    found = lambda df, priority, kind, height: df.select("text", F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), F.col("q").alias("found"), height.cast("long").alias("block_height"))
    height = blocks.select(F.col("block_height").alias("h"))
    by_height = found(figures.join(height, "h"), 0, "block", F.col("h"))
    by_txid = found(words.join(refs.select(F.col("txid").alias("q"), "block_height"), "q"), 1, "transaction", F.col("block_height"))
    by_hash = found(words.join(blocks.select(F.col("block_hash").alias("q"), "block_height"), "q"), 2, "block", F.col("block_height"))
    by_address = found(words.join(addresses.select(F.col("address").alias("q")), "q", "left_semi"), 3, "address", F.lit(None))
    return by_height.unionByName(by_txid).unionByName(by_hash).unionByName(by_address)


def list_blocks(blocks: DataFrame, sync_tail: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """Blocks of the heights from ``sync_tail - offset`` downwards, ``limit`` heights; heights without a block are left out.

    Without a sync tail (below 0) they are the newest applied blocks.
    """
    checked_page(limit, offset)
    if sync_tail < 0:
        return blocks.orderBy(F.desc("block_height")).offset(offset).limit(limit)
    return blocks.where((F.col("block_height") <= sync_tail - offset) & (F.col("block_height") > sync_tail - offset - limit)).orderBy(F.desc("block_height"))


def block_by_hash(hashes: DataFrame, applied: DataFrame, stored: DataFrame) -> DataFrame:
    """(block_hash, block_height) of each hash, from the applied blocks, else from the stored ones."""
    asked = hashes.select("block_hash").distinct()
    both = applied.select("block_hash", "block_height", F.lit(0).alias("rank")).unionByName(stored.select("block_hash", "block_height", F.lit(1).alias("rank")))
    return latest_by(both.join(asked, "block_hash", "left_semi"), ["block_hash"], [F.asc("rank"), F.desc("block_height")]).drop("rank")


def get_block(refs: DataFrame, applied: DataFrame, stored: DataFrame, transactions: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the transactions of each block (ref: its height or hash): the block, its count of transactions, their global index."""
    checked_page(limit, offset)
    asked = refs.select("ref").distinct()
    by_height = asked.where(F.col("ref").rlike(DIGITS)).select("ref", F.col("ref").try_cast("long").alias("block_height"))
    by_hash = block_by_hash(asked.select(F.col("ref").alias("block_hash")), applied, stored).select(F.col("block_hash").alias("ref"), "block_height")
    # of a height the stored block counts where none is applied
    known = applied.select("block_height", "block_hash", "tx_count").unionByName(stored.join(applied, "block_height", "left_anti").select("block_height", "block_hash", "tx_count"))
    block = by_height.unionByName(by_hash).join(known, "block_height")
    page = transactions.where((F.col("tx_index") >= offset) & (F.col("tx_index") < offset + limit))
    return block.join(page.select("block_height", "tx_index", "txid", "input_count", "output_count", "output_total", "fee_base"), "block_height").withColumnRenamed("tx_count", "total_count")


def transaction_inputs(txids: DataFrame, spends: DataFrame, creates: DataFrame) -> DataFrame:
    """The inputs of the transactions with the address and value that they take."""
    own = spends.join(txids.select(F.col("txid").alias("spent_by_txid")).distinct(), "spent_by_txid", "left_semi")
    made = creates.select(F.col("output_key").alias("spent_output_key"), "address", "value_base")
    return own.join(made, "spent_output_key", "left").select(F.col("spent_by_txid").alias("txid"), "input_index", F.col("spent_output_key").alias("output_key"), "address", "value_base")


def transaction_outputs(txids: DataFrame, creates: DataFrame, spends: DataFrame) -> DataFrame:
    """The outputs of the transactions with what has spent them."""
    own = creates.join(txids.select("txid").distinct(), "txid", "left_semi")
    return ledger.utxo_history(own, spends).select("txid", "vout", "output_key", "address", "value_base", F.col("spent_by_txid").isNotNull().alias("spent"), "spent_by_txid", "spent_in_block")


def transaction_summary(txids: DataFrame, creates: DataFrame, spends: DataFrame) -> DataFrame:
    """The facts of the transactions, from their own outputs and inputs only."""
    asked = txids.select("txid").distinct()
    own = spends.join(asked.withColumnRenamed("txid", "spent_by_txid"), "spent_by_txid", "left_semi")
    taken = creates.join(own.select(F.col("spent_output_key").alias("output_key")), "output_key", "left_semi")
    made = creates.join(asked, "txid", "left_semi")
    ins = own.groupBy(F.col("spent_by_txid").alias("txid")).agg(F.count("*").alias("n"))
    totals = ledger.input_totals(own, taken)
    facts = made.groupBy("txid").agg(F.min("block_height").alias("block_height"), F.min("tx_index").alias("tx_index"), F.count("*").alias("output_count"), ledger.total(F.col("value_base")).alias("output_total"))
    both = facts.join(ins, "txid", "left").join(totals, "txid", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return both.select("txid", "block_height", "tx_index", F.greatest(F.lit(1).cast("long"), n).alias("vin_size"), "output_count", "output_total", ledger.fee(n == 0, F.coalesce("input_total", F.lit(0)).cast(ledger.AMOUNT), F.col("output_total")).alias("fee_base"))


def get_address(addresses: DataFrame, movements: DataFrame, utxo: DataFrame) -> DataFrame:
    """Balance, received, sent, transactions and unspent outputs of each address that is known."""
    asked = addresses.select("address").distinct()
    return ledger.address_summary(movements.join(asked, "address", "left_semi"), utxo.join(asked, "address", "left_semi"))


def address_transactions(addresses: DataFrame, movements: DataFrame, transactions: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each address's transactions, newest first, with the facts of those on the page only."""
    asked = addresses.select("address").distinct()
    own = ledger.address_tx_amounts(movements.join(asked, "address", "left_semi"))
    page = _paged(own, "address", [F.desc("block_height"), F.desc("tx_index"), F.asc("txid")], limit, offset)
    facts = transactions.select("block_height", "txid", "block_time", "input_count", "output_count", "fee_base").join(page.select("block_height", "txid").distinct(), ["block_height", "txid"], "left_semi")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return page.join(facts, ["block_height", "txid"], "left").select("address", "txid", "block_height", "block_time", "tx_index", "received", "sent", zero("input_count"), zero("output_count"), "fee_base")


def address_utxos(addresses: DataFrame, utxo: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of each address's unspent outputs, newest first."""
    own = utxo.where("is_spendable").join(addresses.select("address").distinct(), "address", "left_semi")
    page = _paged(own, "address", [F.desc("block_height"), F.desc("tx_index"), F.asc("vout"), F.asc("output_key")], limit, offset)
    return page.select("address", "output_key", "block_height", "tx_index", "vout", "value_base")


def raw_transactions(txids: DataFrame, snapshots: DataFrame, sync_tail: int, process_tail: int) -> DataFrame:
    """Where transactions stand in stored blocks that aren't processed yet: the newest ``RAW_BLOCKS`` at most; the newest block counts."""
    low = max(0, process_tail + 1, sync_tail - RAW_BLOCKS + 1)
    own = snapshots.where((F.col("height") >= low) & (F.col("height") <= sync_tail))
    tx = own.select(F.col("height").alias("block_height"), F.col("hash").alias("block_hash"), F.posexplode("tx").alias("tx_index", "t")).select("block_height", "block_hash", F.col("tx_index").cast("long").alias("tx_index"), F.col("t.txid").alias("txid"))
    return latest_by(tx.join(txids.select("txid").distinct(), "txid", "left_semi"), ["txid"], [F.desc("block_height"), F.asc("tx_index")])


def transaction_refs(txids: DataFrame, refs: DataFrame, creates: DataFrame, utxo: DataFrame) -> DataFrame:
    """Where transactions stand: by their reference, else by an output that they made, else by one that is unspent.

    ``creates`` and ``utxo`` need not hold other transactions' rows.
    """
    asked = txids.select("txid").distinct()
    place = lambda df, rank: df.withColumn("rank", F.lit(rank)).select("txid", "block_height", "tx_index", "rank").join(asked, "txid", "left_semi")
    # a version of a reference, so that the newest counts
    own = place(refs, 0).unionByName(place(creates, 1)).unionByName(place(utxo, 2))
    return latest_by(own, ["txid"], [F.asc("rank"), F.desc("block_height"), F.asc("tx_index")]).withColumnRenamed("rank", "source")
