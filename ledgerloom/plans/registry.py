"""Every registered query of the ledger, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts
from ..operators import audit, derive, explorer, ledger, maintain, mempool, sequence, versioned
from ..sources import heights, raw_blocks
from ..sources.files import fact_folder, publish_state, read_published
from ..streaming import blocks
from ..streaming.mempool import feeds
from .analytics import curated, guarded_query, view
from .oracle import ORACLE_SQL
from .tables import Ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Blocks before the tail that may still change, and the height parts that queries cut the chain at.
DEPTH, HALF, TENTH = 20, 2, 10


def query(fn: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Ledger(spark, sf_dir))
    return fn


# --- scans and versioned reads ---


@query
def latest_creates(x):
    return x.latest.select("output_key", "version", "address", "value_base")


@query
def argmax_facts(x):
    return versioned.newest_values(x.creates_log, ["output_key"], F.struct("version", -F.col("l_partkey"), -F.col("l_suppkey"), -F.col("l_extendedprice")), ["address", "value_base"])


@query
def utxo_as_of(x):
    h = x.edge(HALF)
    return ledger.current_utxo(x.creates.where(F.col("block_height") <= h), x.spends.where(F.col("spent_in_block") <= h)).select("output_key", "block_height", "value_base")


@query
def latest_as_of(x):
    # versions are ship days; rows beyond the day are left out before the latest is taken
    order = [F.desc("version"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    return versioned.as_of(x.creates_log, "version", 9500, ["output_key"], order).select("output_key", "version", "value_base")


@query
def utxo_history_as_of(x):
    # each output has a later version, which must not hide the one of the height
    later = x.creates.withColumns({"block_height": F.col("block_height") + x.tail + 1, "value_base": F.col("value_base") + 1})
    keys = x.spends.where(F.col("spent_in_block") > x.edge(TENTH)).select(F.col("spent_output_key").alias("output_key"))
    return ledger.history_as_of(x.creates.unionByName(later), x.spends, keys, x.edge(HALF)).select("output_key", "block_height", "value_base", "spent_by_txid", "spent_in_block")


@query
def utxo_versions(x):
    return ledger.utxo_versions(x.history).select("output_key", "version")


@query
def core_blocks_latest(x):
    log = x.blocks.select("block_height", "block_hash", F.lit(1).cast("long").alias("fetched_at")).unionByName(x.forked(TENTH).select("block_height", "block_hash", F.lit(2).cast("long").alias("fetched_at")))
    return versioned.latest_by(log, ["block_height"], [F.desc("fetched_at"), F.asc("block_hash")]).select("block_height", "block_hash", "fetched_at")


def _refs(x):
    return derive.derive_tx_refs(x.nested, "raw_sync", "core_process")


@query
def tx_refs_latest(x):
    return versioned.latest_by(_refs(x), ["txid"], [F.desc("version"), F.desc("block_height"), F.desc("tx_index")])


@query
def export_utxo_state(x):
    return x.history.select("output_key", "block_height", "address", "value_base", "spent_by_txid", "spent_in_block")


@query
def export_balance_state(x):
    return x.balances


# --- derivation from nested blocks ---


@query
def snapshot_violations(x):
    # blocks at the tail lose their hash, time or transactions, so that each rule has something to find
    h, e = F.col("height"), x.edge(TENTH)
    broken = x.nested.select(
        F.when((h >= e) & (h % 3 == 0), None).otherwise(F.col("hash")).alias("hash"), "height", F.when((h >= e) & (h % 5 == 0), None).otherwise(F.col("time")).alias("time"), "previousblockhash",
        F.when((h >= e) & (h % 7 == 0), F.expr("slice(tx, 1, 0)")).otherwise(F.col("tx")).alias("tx"),
    )
    return derive.violations(broken)


@query
def decoded_blocks(x):
    decoded = raw_blocks.decode_blocks(x.wire, strict=True)
    return decoded.select(F.col("height").alias("block_height"), F.col("block.time").alias("block_time"), F.col("block.nTx").cast("long").alias("tx_count"), (F.length("block.hash") == 64).alias("hashed"))


@query
def decoded_outputs(x):
    nested = raw_blocks.nested_blocks(raw_blocks.decode_blocks(x.wire))
    return derive.derive_creates(nested).select("block_height", "tx_index", "vout", "value_base", "is_spendable", "is_coinbase")


@query
def decoded_hashes(x):
    return raw_blocks.decode_blocks(x.wire, strict=True).select(F.col("height").alias("block_height"), F.col("block.hash").alias("block_hash"), F.col("block.previousblockhash").alias("previous_hash"))


@query
def decoded_transactions(x):
    decoded = raw_blocks.decode_blocks(x.wire, strict=True).select("height", F.posexplode("block.tx").alias("tx_index", "t"))
    return decoded.select(F.col("height").alias("block_height"), F.col("tx_index").cast("long").alias("tx_index"), F.col("t.txid").alias("txid"), "t.size")


@query
def decoded_addresses(x):
    nested = raw_blocks.nested_blocks(raw_blocks.decode_blocks(x.wire))
    return derive.derive_creates(nested).select("output_key", "block_height", "tx_index", "address")


@query
def creates(x):
    return derive.derive_creates(x.nested)


@query
def spends(x):
    return derive.derive_spends(x.nested)


@query
def processed_blocks(x):
    return derive.derive_processed_blocks(x.nested)


@query
def tx_refs(x):
    return derive.derive_tx_refs(x.nested, "core_process")


@query
def block_weights(x):
    return derive.flat_weights(x.creates, x.spends, x.tx)


@query
def nested_block_weights(x):
    return derive.block_weights(x.nested)


@query
def output_addresses(x):
    return derive.derive_creates(x.nested).where("address <> ''").groupBy("address").agg(F.count("*").alias("outputs"))


@query
def duplicate_outputs(x):
    return derive.repeated(x.creates_log, "output_key")


@query
def duplicate_spends(x):
    log = x.creates_log.where("l_returnflag = 'R' and next_key is not null")
    return derive.repeated(log.withColumnRenamed("output_key", "spent_output_key"), "spent_output_key")


@query
def credit_movements(x):
    return ledger.credit_movements(x.creates)


@query
def debit_movements(x):
    return ledger.debit_movements(x.spends, x.creates)


@query
def movements(x):
    return x.movements


@query
def movements_unique(x):
    # a replayed half of the chain repeats its movements
    again = x.movements.unionByName(x.movements.where(F.col("block_height") <= x.edge(HALF)))
    return again.dropDuplicates(["movement_id"]).select("movement_id", "direction", "amount_base")


def _window(x):
    """Creates and spends of the last tenth of the chain, as a batch."""
    e = x.edge(TENTH)
    return x.creates.where(F.col("block_height") > e), x.spends.where(F.col("spent_in_block") > e), e


@query
def external_spends(x):
    c, s, _ = _window(x)
    return ledger.external_spends(c, s)


@query
def touched_outputs(x):
    c, s, _ = _window(x)
    return ledger.touched_outputs(c, s)


@query
def transactions(x):
    return x.transactions


@query
def format_amount(x):
    return x.creates.select("output_key", amounts.format_amount(F.col("value_base")).alias("amount"))


# --- joins ---


@query
def utxo_current(x):
    return x.utxo.select("output_key", "address", "value_base", "block_height")


@query
def utxo_history(x):
    return x.history.select("output_key", "value_base", "spent_by_txid", "spent_in_block", "input_index")


@query
def input_totals(x):
    return ledger.input_totals(x.spends, x.creates)


@query
def utxo_lookup(x):
    keys = x.spends.select(F.col("spent_output_key").alias("output_key"))
    return versioned.lookup(x.creates, keys, ["output_key"]).select("output_key", "address", "value_base")


@query
def created_lookup(x):
    keys = x.blocks.where("tx_count >= 8").select("block_height")
    return versioned.lookup(x.creates, keys, ["block_height"]).select("output_key", "block_height")


@query
def balance_lookup(x):
    keys = x.movements.where("direction = 'debit'").select("address", "asset_address")
    return versioned.lookup(x.balances, keys, ["address", "asset_address"])


@query
def read_model_missing(x):
    return versioned.missing(x.creates.select("output_key", "address"), x.utxo, ["output_key"])


@query
def canonical_tx_refs(x):
    return maintain.canonical(derive.derive_tx_refs(x.nested, "core_process"), x.forked(TENTH)).select("txid", "block_height", "tx_index")


@query
def pending_blocks(x):
    return maintain.pending_blocks(x.forked(TENTH), x.blocks).select("block_height", "block_hash", "tx_count")


@query
def reorg_height(x):
    return maintain.reorg_height(x.forked(TENTH), x.blocks)


@query
def fallback_fill(x):
    old = x.creates.select("output_key", "value_base", F.lit("history").alias("origin"))
    return versioned.filled(x.utxo.select("output_key", "value_base", F.lit("current").alias("origin")), old, ["output_key"])


@query
def combined_summary(x):
    return ledger.address_summary(x.movements, x.utxo)


@query
def resolved_inputs(x):
    own = x.creates.select(F.col("output_key").alias("spent_output_key"), "address", "value_base")
    return x.spends.join(own, "spent_output_key", "left").select("spent_by_txid", "input_index", "address", "value_base")


@query
def tx_ref_resolve(x):
    # references know the older half, created outputs the first nine tenths, current outputs the rest
    half, e = x.edge(HALF), x.edge(TENTH)
    place = lambda df, p: df.select("txid", "block_height", "tx_index", F.lit(p).alias("priority"))
    all_ = place(derive.derive_tx_refs(x.nested, "core_process").where(F.col("block_height") <= half), 0)
    all_ = all_.unionByName(place(x.creates.where(F.col("block_height") <= e), 1)).unionByName(place(x.utxo, 2))
    # by transaction already, so that the repeated rows and the latest ones are found in one shuffle
    all_ = all_.repartition("txid").distinct()
    return versioned.latest_by(all_, ["txid"], [F.asc("priority"), F.desc("block_height"), F.asc("tx_index")])


@query
def address_transactions(x):
    page = sequence.page(ledger.address_tx_amounts(x.movements), [F.desc("block_height"), F.desc("tx_index"), F.asc("txid"), F.asc("address")], 500)
    facts = x.transactions.select("txid", "input_count", "output_count", "fee_base")
    # the page has 500 rows at most
    found = facts.join(F.broadcast(page), "txid", "right")
    return found.select("txid", "address", "block_height", "tx_index", "received", "sent", F.coalesce("input_count", F.lit(0)).alias("input_count"), F.coalesce("output_count", F.lit(0)).alias("output_count"), "fee_base")


# --- aggregations ---


@query
def balances(x):
    return x.balances


@query
def address_summary(x):
    return ledger.address_summary(x.movements, x.utxo)


@query
def address_utxo_count(x):
    return ledger.address_holdings(x.utxo).select("address", "utxo_count")


@query
def address_tx_amounts(x):
    return ledger.address_tx_amounts(x.movements)


@query
def avg_fee(x):
    return x.transactions.agg(F.round(F.avg(F.col("fee_base").cast("double")), 4).alias("average_fee"))


@query
def processed_tail(x):
    return x.blocks.agg(F.max("block_height").alias("tail"))


@query
def balance_deltas(x):
    c, s, _ = _window(x)
    return ledger.balance_deltas(c, s, x.creates)


@query
def next_balances(x):
    c, s, e = _window(x)
    before = ledger.balances(ledger.current_utxo(x.creates.where(F.col("block_height") <= e), x.spends.where(F.col("spent_in_block") <= e)))
    return ledger.next_balances(before, ledger.balance_deltas(c, s, x.creates))


@query
def movement_balances(x):
    return ledger.movement_balances(x.movements)


@query
def pro_rata(x):
    # what a transaction pays out is dealt to the addresses that it takes from
    taken = x.spends.join(x.creates.select(F.col("output_key").alias("spent_output_key"), "address", "value_base"), "spent_output_key").where("address <> ''")
    weights = taken.groupBy(F.col("spent_by_txid").alias("group"), "address").agg(F.sum("value_base").alias("weight"))
    paid = x.transactions.select(F.col("txid").alias("group"), F.col("output_total").alias("target"))
    return ledger.pro_rata(weights.where("weight > 0").join(paid, "group"), "target")


@query
def applied_exists(x):
    return x.forked(TENTH).join(x.blocks.select("block_height", "block_hash", F.lit(True).alias("applied")), ["block_height", "block_hash"], "left").select("block_height", F.coalesce("applied", F.lit(False)).alias("applied"))


# --- sequences, pages, search ---


@query
def equal_work_buckets(x):
    counts = x.creates.groupBy("block_height").agg(F.count("*").alias("n"))
    return sequence.equal_work_buckets(counts, "block_height", "n", 1000)


@query
def sync_frontier(x):
    gap = x.edge(HALF)
    return sequence.sync_frontier(x.blocks.where(F.col("block_height") != gap + 1), -1)


@query
def chain_violations(x):
    return sequence.chain_violations(x.blocks.join(x.forked(TENTH).select("block_height", F.col("block_hash").alias("other")), "block_height").select("block_height", F.col("other").alias("block_hash"), "previous_hash"))


@query
def chain_violations_stored(x):
    # the batch's first block follows a block that was stored with another hash
    return sequence.chain_violations(x.blocks.where(F.col("block_height") > x.edge(TENTH)), x.forked(TENTH))


@query
def contiguous_range(x):
    return sequence.contiguous_range(x.blocks)


@query
def blocks_page(x):
    return sequence.page(x.blocks.select("block_height", "block_hash", "block_time", "tx_count"), [F.desc("block_height")], 50, 25)


@query
def utxo_keyset_page(x):
    return sequence.key_page(x.utxo.select("output_key", "value_base"), ["output_key"], ("tx000000000100:0",), 200)


@query
def balance_keyset_page(x):
    return sequence.key_page(x.balances, ["address", "asset_address"], ("S10", ""), 20)


@query
def top_fees(x):
    return x.transactions.where("fee_base is not null").orderBy(F.desc("fee_base"), F.desc("block_height"), F.desc("tx_index")).limit(100).select("txid", "fee_base", "block_height", "tx_index")


@query
def top_transactions(x):
    return x.transactions.orderBy(F.desc("output_total"), F.desc("block_height"), F.desc("tx_index")).limit(100).select("txid", "output_total", "block_height", "tx_index")


@query
def richest_addresses(x):
    return x.balances.orderBy(F.desc("balance"), F.asc("address")).limit(100).select("address", "balance")


@query
def address_utxos(x):
    return sequence.page(x.utxo.where("is_spendable and address <> ''").select("address", "output_key", "block_height", "tx_index", "vout", "value_base"), [F.desc("block_height"), F.desc("tx_index"), F.asc("vout"), F.asc("output_key")], 500)


@query
def search(x):
    # ids, heights, hashes between blanks, addresses, and texts that find nothing, against the whole ledger
    some = x.blocks.where("block_height % 50 = 0")
    texts = x.asked_txids.select(F.col("txid").alias("text")).union(some.select(F.col("block_height").cast("string"))).union(some.select(F.concat(F.lit(" "), "block_hash", F.lit(" ")))).union(x.asked_addresses).union(some.select(F.concat(F.lit("-"), F.col("block_height").cast("string"))))
    return explorer.search(texts, x.tx.select("txid", "block_height"), x.blocks, x.movements)


@query
def list_blocks(x):
    return explorer.list_blocks(x.blocks.where("block_height % 7 <> 3"), x.tail - 5, 50, 25).select("block_height", "block_hash", "block_time", "tx_count")


@query
def get_block(x):
    # by height, by an applied block's hash, and by the hash of a block that is stored only
    by_height = x.blocks.where("block_height % 50 = 0").select(F.col("block_height").cast("string").alias("ref"))
    by_hash = x.blocks.where("block_height % 50 = 1").select("block_hash")
    stored = x.forked(TENTH).where((F.col("block_height") % 50 == 2) & (F.col("block_height") >= x.edge(TENTH))).select("block_hash")
    return explorer.get_block(by_height.union(by_hash).union(stored), x.blocks, x.forked(TENTH), x.transactions, 20, 1)


@query
def get_block_by_hash(x):
    hashes = x.blocks.where("block_height % 50 = 1").select("block_hash").union(x.forked(TENTH).where("block_height % 50 = 2").select("block_hash"))
    return explorer.block_by_hash(hashes, x.blocks, x.forked(TENTH))


@query
def get_transaction_summary(x):
    return explorer.transaction_summary(x.asked_txids, x.creates, x.spends)


@query
def get_transaction_inputs(x):
    return explorer.transaction_inputs(x.asked_txids, x.spends, x.creates)


@query
def get_transaction_outputs(x):
    return explorer.transaction_outputs(x.asked_txids, x.creates, x.spends)


@query
def get_address(x):
    return explorer.get_address(x.asked_addresses, x.movements, x.utxo)


@query
def get_address_transactions(x):
    return explorer.address_transactions(x.asked_addresses, x.movements, x.transactions, 10, 5)


@query
def get_address_utxos(x):
    return explorer.address_utxos(x.asked_addresses, x.utxo, 10, 5)


@query
def raw_transactions(x):
    return explorer.raw_transactions(x.asked_txids, x.nested, x.tail, x.edge(TENTH))


@query
def transaction_refs(x):
    refs = derive.derive_tx_refs(x.nested, "core_process").where(F.col("block_height") <= x.edge(HALF))
    own = x.outputs_of(x.asked_txids)
    return explorer.transaction_refs(x.asked_txids, refs, own.where(F.col("block_height") <= x.edge(TENTH)), own.where("spent_by_txid is null"))


@query
def outputs_by_key(x):
    # single outputs: the second of every 50th order
    own = x.outputs_of(x.asked_txids)
    keys = x.asked_txids.select(F.concat("txid", F.lit(":1")).alias("output_key"))
    return versioned.lookup(own, keys, ["output_key"]).select("output_key", "address", "value_base", "block_height", "spent_by_txid", "spent_in_block")


# --- functions ---


def _texts(x):
    """Amount texts of lines, some with more places than eight."""
    price = amounts.format_amount(F.col("value_base"))
    return x.creates.select("output_key", F.when(F.col("vout") % 3 == 0, F.concat(price, F.lit("000"))).when(F.col("vout") % 3 == 1, F.concat(F.lit(" "), price, F.lit("9"))).otherwise(F.concat(F.lit("-"), price)).alias("text"))


@query
def to_base_units(x):
    return _texts(x).select("output_key", amounts.to_base_units(F.col("text")).alias("units"))


@query
def to_base_units_trunc(x):
    return _texts(x).select("output_key", amounts.to_base_units_trunc(F.col("text")).alias("units"))


@query
def hex_units(x):
    return x.creates.select("output_key", amounts.hex_units(F.concat(F.lit("0x"), F.lower(F.hex("value_base")))).alias("units"))


@query
def number_units(x):
    return x.creates_log.select("output_key", "l_partkey", "l_suppkey", amounts.number_to_base_units(F.col("l_extendedprice")).alias("units"))


@query
def hex_units_wide(x):
    wide = F.concat(F.lit("0x"), F.lower(F.hex("value_base")), F.lit("0" * 16))
    return x.creates.select("output_key", amounts.hex_units(wide).alias("units"))


@query
def parsed_times(x):
    at, n = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = F.when(n == 0, F.unix_timestamp(at).cast("string")).when(n == 1, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).otherwise(F.lit("no time"))
    return x.table("events").select("event_id", amounts.to_seconds(text).alias("seconds"))


@query
def balance_keys(x):
    parsed = amounts.parse_balance_key(amounts.balance_key(F.col("address"), F.concat(F.lit("x:"), "address")))
    return x.balances.select(parsed.alias("p")).select("p.address", "p.asset_address")


@query
def query_fingerprints(x):
    return x.table("customer").select("c_custkey", amounts.fingerprint(F.concat(F.lit("select "), "c_name")).alias("hash"))


@query
def redact_text(x):
    own, n = x.table("customer"), F.col("c_custkey")
    who = F.when(n % 2 == 0, F.concat("c_name", F.lit(":pw"))).otherwise(F.col("c_name"))
    text = F.concat(F.lit("http://"), who, F.lit("@host/x?"), F.when(n % 3 == 0, "Token=").when(n % 3 == 1, "PASSWORD=").otherwise("key="), n.cast("string"), F.lit("&a=1 end"))
    return own.select("c_custkey", amounts.redact(text).alias("redacted"))


# --- maintenance ---


def _state(x, h):
    return maintain.state_of(x.creates.where(F.col("block_height") <= h), x.spends.where(F.col("spent_in_block") <= h))


@query
def apply_window_utxo(x):
    c, s, e = _window(x)
    return maintain.apply_window(_state(x, e), c, s)


@query
def apply_window_balances(x):
    c, s, e = _window(x)
    return maintain.state_balances(maintain.apply_window(_state(x, e), c, s))


@query
def missing_prevouts(x):
    _, s, e = _window(x)
    return maintain.missing_prevouts(s, x.creates.where(F.col("block_height") <= e)).select("spent_output_key", "spent_by_txid")


@query
def double_spends(x):
    # the newest tenth, spent one block later than recorded
    _, s, _ = _window(x)
    return maintain.double_spends(s.withColumn("spent_in_block", F.col("spent_in_block") + 1), x.history).select("spent_output_key", "spent_by_txid", "spent_in_block")


@query
def repair_prevouts(x):
    _, s, e = _window(x)
    current = x.creates.where((F.col("block_height") > x.edge(HALF)) & (F.col("block_height") <= e))
    return maintain.repaired(s, current, x.history, e).select("output_key", "block_height", "value_base")


@query
def rewind_utxo(x):
    return maintain.rewind(maintain.state_of(x.creates, x.spends), x.edge(HALF))


@query
def rewind_balances(x):
    return maintain.state_balances(maintain.rewind(maintain.state_of(x.creates, x.spends), x.edge(HALF)))


@query
def reorg_replay(x):
    e = x.edge(TENTH)
    c, s = x.creates.where(F.col("block_height") >= e), x.spends.where(F.col("spent_in_block") >= e)
    # the new branch leaves out every second transaction of the blocks that it replaces
    return maintain.reorganized(x.creates, x.spends, c.where("tx_index % 2 = 0"), s.where("spent_tx_index % 2 = 0"), e)


@query
def applied_blocks(x):
    return x.blocks.select("block_height", "block_hash", "previous_hash")


def _materialized(x):
    return maintain.materialize_outputs(x.outputs, x.blocks, x.edge(HALF))


@query
def materialized_utxo(x):
    return _materialized(x)["utxo"].select("output_key", "address", "value_base", "version")


@query
def materialized_balances(x):
    return _materialized(x)["balances"]


@query
def materialized_blocks(x):
    return _materialized(x)["applied_blocks"]


@query
def backfilled_transactions(x):
    # what is stored is off by 1000; the older half is made anew
    stored = x.transactions.withColumn("fee_base", (F.col("fee_base") + 1000).cast(amounts.AMOUNT))
    return maintain.backfill_facts(stored, x.creates, x.spends, x.edge(HALF)).select("txid", "block_height", "fee_base")


def _folder(x, name):
    """A new folder for tables that a query writes and reads back."""
    folder = fact_folder(x.spark)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@query
def backfilled_in_place(x):
    # as above, but stored in buckets of heights, of which the older half is written anew
    path, facts = _folder(x, "backfill"), x.transactions.withColumn("fee_base", (F.col("fee_base") + 1000).cast(amounts.AMOUNT))
    heights.replace(x.spark, path, {"transactions": facts}, {"transactions": "block_height"}, 0, x.tail, max(1, x.tail // 16))
    maintain.backfill_in_place(x.spark, path, x.creates, x.taken, 0, x.edge(HALF))
    return heights.read(x.spark, path, "transactions").select("txid", "block_height", "fee_base")


@query
def materialized_in_place(x):
    # the state of the older half is published first, and then that of the whole chain in its place
    path = _folder(x, "state")
    for h in (x.edge(HALF), x.tail):
        publish_state(maintain.materialize_outputs(x.outputs, x.blocks, h), path)
    state = read_published(x.spark, path)
    held = state["balances"].select("address", "balance")
    held = F.broadcast(held) if held.count() <= blocks.MOST_SENT else held  # counted by the files' footers
    return state["utxo"].join(held, "address", "left").select("output_key", "address", "value_base", "version", "balance")


@query
def followed_state(x):
    # the chain arrives in batches, with a tail of other hashes that the last batch replaces
    path, h, e = _folder(x, "followed"), F.col("height"), x.edge(TENTH)
    fork = x.nested.where(h >= e).withColumn("hash", F.concat(F.lit("fork"), h.cast("string")))
    for i, batch in enumerate([x.nested.where(h < e), fork, x.nested.where(h >= e)]):
        blocks.apply_batch(batch, i, path)
    return blocks.state_with_balances(x.spark, path).select("output_key", "address", "value_base", "spent_by_txid", "spent_in_block", "balance")


@query
def online_heights(x):
    tails = x.blocks.agg((F.max("block_height") - 50).alias("tail"), F.max("block_height").alias("target"))
    return maintain.online_heights(tails, DEPTH, 40)


@query
def finalized_transactions(x):
    return x.transactions.where(F.col("block_height") <= max(-1, x.tail - DEPTH)).select("txid", "block_height", "fee_base")


@query
def balance_invariant(x):
    return maintain.balance_invariant(x.utxo, x.movements)


# --- explorer and analytics ---


@query
def block_transactions(x):
    counts = x.transactions.groupBy("block_height").agg(F.count("*").alias("total_count"))
    return x.transactions.join(counts, "block_height").select("block_height", "tx_index", "txid", "output_total", "fee_base", "total_count")


@query
def tx_inputs(x):
    own = x.creates.select(F.col("output_key").alias("spent_output_key"), "address", "value_base")
    return x.spends.join(own, "spent_output_key", "left").select(F.col("spent_by_txid").alias("txid"), "input_index", F.col("spent_output_key").alias("output_key"), "address", "value_base")


@query
def tx_outputs(x):
    return x.history.select("txid", "vout", "address", "value_base", F.col("spent_by_txid").isNotNull().alias("spent"), "spent_by_txid")


@query
def tx_summary(x):
    inputs = F.greatest(F.lit(1).cast("long"), F.col("input_count"))
    return x.transactions.select("txid", "block_height", inputs.alias("vin_size"), "output_count", "input_total", "output_total", "fee_base")


@query
def block_by_hash(x):
    # every stored hash against the applied blocks
    stored = x.forked(TENTH).select("block_hash")
    return x.blocks.join(stored, "block_hash", "left_semi").select("block_hash", "block_height", "tx_count")


@query
def raw_tx_lookup(x):
    # transactions of blocks that are stored and not yet processed
    newest = x.nested.where(F.col("height") > x.edge(TENTH))
    return newest.select(F.col("height").alias("block_height"), F.posexplode("tx").alias("tx_index", "t")).select("block_height", F.col("tx_index").cast("long").alias("tx_index"), F.col("t.txid").alias("txid"), F.size("t.vin").cast("long").alias("vin_size"))


def _views(x):
    return curated(x.transactions, x.balances, mempool.sampled(x.entries))


@query
def guarded_top_fees(x):
    end = x.blocks.where(F.col("block_height") == x.tail - DEPTH).agg(F.max("block_time")).first()[0] or 0
    sql = "select txid, fee_base, block_height from transactions where fee_base is not null order by fee_base desc, txid"
    return guarded_query(x.spark, sql, _views(x), end - 7 * 86400, end, x.tail - DEPTH, 1000).rows


@query
def curated_transactions(x):
    return view("transactions", x.transactions)


@query
def curated_balances(x):
    return view("balances", x.balances)


@query
def curated_mempool(x):
    return view("mempool_samples", mempool.sampled(x.entries)).withColumn("sampled_at", F.unix_timestamp("sampled_at"))


# --- mempool, watches, audit ---


@query
def mempool_samples(x):
    return mempool.sampled(x.entries).withColumn("sampled_at", F.unix_timestamp("sampled_at"))


@query
def mempool_entries(x):
    return mempool.normalized(x.entries).select("txid", "time", "size", "fee_base", "modified_fee", "fee_rate", F.array_join("depends", ",").alias("depends"))


@query
def mempool_page(x):
    own = mempool.normalized(x.entries).select("txid", "time", "size", "fee_base")
    return sequence.page(own, [F.coalesce("time", F.lit(-1)).desc(), F.asc("txid")], 500)


@query
def mempool_fee_distribution(x):
    return mempool.fee_distribution(mempool.sampled(x.entries))


@query
def mempool_retained(x):
    samples = mempool.sampled(x.entries)
    now = F.lit(samples.agg(F.max("sampled_at")).first()[0])
    return mempool.retained(samples, now).select("txid", F.unix_timestamp("sampled_at").alias("sampled_at"))


@query
def watch_matches(x):
    return mempool.watch_matches(x.watches, x.payments)


@query
def watch_feeds(x):
    # what a watcher that starts at the newest watch finds in the pool, and what comes later
    start = F.lit(x.watches.agg(F.max("created_at")).first()[0] or 0)
    return feeds(x.payments.where(F.col("seen_at") <= start), x.payments.where(F.col("seen_at") > start)).select("txid", "source")


@query
def watch_outcomes(x):
    return mempool.watch_outcomes(x.watches, mempool.watch_matches(x.watches, x.payments))


@query
def mempool_arrivals(x):
    return mempool.changes(x.snapshots, 1)


@query
def mempool_departures(x):
    return mempool.changes(x.snapshots, -1)


@query
def mempool_degraded(x):
    return mempool.degraded(x.snapshots, 10)


@query
def live_arrivals(x):
    return mempool.live_arrivals(x.snapshots, 10)


@query
def active_watches(x):
    return mempool.active_watches(x.watches, x.watches.agg(F.max("created_at")).first()[0] or 0)


@query
def accepted_watches(x):
    return mempool.accepted_watches(x.watches)


@query
def audit_search(x):
    return audit.search(x.audit, {"outcome": "failure"}, limit=500).select("audit_event_id", "actor", "operation", "created_at")


@query
def audit_retained(x):
    newest = x.audit.agg(F.max("created_at")).first()[0] or 0
    return audit.retained(x.audit, newest - 10 * 86400).select("audit_event_id", "created_at")


@query
def budget_replay(x):
    return audit.replay_budget(x.audit.select(F.col("audit_event_id").alias("request_id"), F.col("actor").alias("subject"), F.col("created_at").alias("at")), 5, 86400)
