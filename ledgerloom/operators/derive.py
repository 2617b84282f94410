"""Ledger rows from nested blocks: outputs, spends, blocks, references, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amounts import format_amount, to_base_units

VIN = "array<struct<coinbase:string,txid:string,vout:bigint,sequence:bigint>>"
VOUT = "array<struct<n:bigint,value:string,type:string,address:string,addresses:array<string>>>"
BLOCK = f"hash string, height bigint, time bigint, previousblockhash string, tx array<struct<txid:string,vin:{VIN},vout:{VOUT}>>"


def block_schema() -> T.StructType:
    return T._parse_datatype_string(BLOCK)


def first_address(address: Column, addresses: Column) -> Column:
    """The first address that isn't blank, trimmed; else empty."""
    both = F.concat(F.array(address), F.coalesce(addresses, F.array().cast("array<string>")))
    clean = F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.get(clean, F.lit(0)), F.lit(""))


def is_coinbase(vin: Column) -> Column:
    return F.coalesce(F.exists(vin, lambda x: F.coalesce(x["coinbase"], F.lit("")) != ""), F.lit(False))


def _txs(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("height").alias("block_height"), F.col("hash").alias("block_hash"), F.col("time").alias("block_time"), F.posexplode("tx").alias("tx_index", "tx"))


def derive_creates(blocks: DataFrame) -> DataFrame:
    """A row for each output; the key is the output's place in its transaction."""
    outs = _txs(blocks).select("*", is_coinbase(F.col("tx.vin")).alias("is_coinbase"), F.posexplode("tx.vout").alias("pos", "o"))
    address = first_address(F.col("o.address"), F.col("o.addresses"))
    return outs.select(
        F.concat_ws(":", "tx.txid", F.col("pos").cast("string")).alias("output_key"), F.col("tx.txid").alias("txid"), F.col("tx_index").cast("long").alias("tx_index"),
        F.coalesce("o.n", F.col("pos").cast("long")).alias("vout"), "block_height", "block_hash", "block_time", address.alias("address"),
        to_base_units(F.col("o.value")).cast("long").alias("value_base"), (address != "").alias("is_spendable"), "is_coinbase",
    )


def derive_spends(blocks: DataFrame) -> DataFrame:
    """A row for each input that isn't a coinbase; the index is the input's place among all."""
    ins = _txs(blocks).select("*", F.posexplode("tx.vin").alias("pos", "i")).where("coalesce(i.coinbase, '') = ''")
    return ins.select(
        F.concat_ws(":", "i.txid", F.col("i.vout").cast("string")).alias("spent_output_key"), F.col("tx.txid").alias("spent_by_txid"), F.col("block_height").alias("spent_in_block"),
        F.col("tx_index").cast("long").alias("spent_tx_index"), F.col("pos").cast("long").alias("input_index"),
    )


def derive_processed_blocks(blocks: DataFrame, *more: Column) -> DataFrame:
    return blocks.select(F.col("height").alias("block_height"), F.col("hash").alias("block_hash"), F.col("time").alias("block_time"), F.size("tx").cast("long").alias("tx_count"), F.col("previousblockhash").alias("previous_hash"), *more)


def derive_tx_refs(blocks: DataFrame, *sources: str) -> DataFrame:
    """txid to place, once for each source; version: height * 10^6 + index * 10, one more for the core process."""
    rank = {"raw_sync": 0, "core_process": 1}
    by = F.lit(sources[0]) if len(sources) == 1 else F.explode(F.array(*[F.lit(s) for s in sources]))
    rows = _txs(blocks).select(F.col("tx.txid").alias("txid"), "block_height", "block_hash", F.col("tx_index").cast("long").alias("tx_index"), by.alias("source"))
    number = F.lit(rank[sources[0]])
    for s in sources[1:]:
        number = F.when(F.col("source") == s, rank[s]).otherwise(number)
    return rows.withColumn("version", (F.col("block_height") * 1_000_000 + F.col("tx_index") * 10 + number).cast("long"))


def weight() -> Column:
    """Inputs and outputs of a nested block; what is missing counts 0."""
    n = lambda a: F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0))
    return F.coalesce(F.aggregate("tx", F.lit(0), lambda s, t: s + n(t["vin"]) + n(t["vout"])), F.lit(0)).cast("long").alias("weight")


def block_weights(blocks: DataFrame) -> DataFrame:
    """:func:`weight` of each block."""
    return blocks.select(F.col("height").alias("block_height"), weight())


def flat_weights(creates: DataFrame, spends: DataFrame, txs: DataFrame) -> DataFrame:
    """:func:`block_weights` of derived rows: outputs, spends, and the one input of each transaction (txid, block_height) that spends nothing."""
    n = lambda df, height: df.groupBy(F.col(height).alias("block_height")).agg(F.count("*").alias("weight"))
    first = txs.join(spends.select(F.col("spent_by_txid").alias("txid")), "txid", "left_anti")
    each = n(creates, "block_height").unionByName(n(spends, "spent_in_block")).unionByName(n(first, "block_height"))
    return each.groupBy("block_height").agg(F.sum("weight").alias("weight"))


def violations(blocks: DataFrame) -> DataFrame:
    """height and reason of blocks without hash, height, time, transactions or a transaction's id."""
    rules = {
        "no hash": F.coalesce(F.col("hash"), F.lit("")) == "",
        "no height": F.col("height").isNull(),
        "no time": F.col("time").isNull(),
        "no transactions": F.coalesce(F.size("tx"), F.lit(-1)) <= 0,
        "transaction without id": F.coalesce(F.exists("tx", lambda t: F.coalesce(t["txid"], F.lit("")) == ""), F.lit(False)),
    }
    found = F.array(*[F.when(bad, F.lit(reason)) for reason, bad in rules.items()])
    return blocks.select(F.col("height").alias("block_height"), F.explode(F.filter(found, lambda r: r.isNotNull())).alias("reason"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur twice or more, and how often."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def by_place(creates: DataFrame, spends: DataFrame | None, txs: DataFrame) -> DataFrame:
    """Outputs, inputs and transactions (KIND) under each other, those of a block in one partition: all that nests blocks is one shuffle."""
    columns = ["block_height", "tx_index", "kind", "nth", "txid", "block_time", "vout", "value_base", "address"]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    all_ = creates.select("block_height", "tx_index", F.lit(OUT).alias("kind"), F.col("pos").alias("nth"), *none("string", "txid"), *none("long", "block_time"), "vout", "value_base", "address")
    if spends is not None:
        all_ = all_.union(spends.select("spent_in_block", "spent_tx_index", F.lit(IN), "input_index", "prev_txid", *none("long", "block_time"), "prev_pos", *none("long", "value_base"), *none("string", "address")))
    all_ = all_.union(txs.select("block_height", "tx_index", F.lit(TX), *none("long", "nth"), "txid", "block_time", *none("long", "vout", "value_base"), *none("string", "address")))
    # a number that is given isn't lowered to few large partitions, whose sorts would spill
    return all_.select(*columns).repartition(int(all_.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block_height")


#: Kinds of rows of :func:`by_place`.
OUT, IN, TX = 0, 1, 2


def of_kind(kind: int, value: Column) -> Column:
    return F.when(F.col("kind") == kind, value)


def nest(creates: DataFrame, spends: DataFrame, txs: DataFrame) -> DataFrame:
    """Nested blocks (height, time, tx) of flat rows; a transaction without spends gets a coinbase input.

    ``creates``: block_height, tx_index, pos, vout, value_base, address; ``spends``: spent_in_block,
    spent_tx_index, prev_txid, prev_pos, input_index; ``txs``: txid, tx_index, block_height, block_time.
    """
    out = F.struct("nth", F.struct(F.col("vout").alias("n"), format_amount(F.col("value_base")).alias("value"), F.lit("pubkeyhash").alias("type"), "address", F.array("address").alias("addresses")).alias("x"))
    into = F.struct("nth", F.struct(F.lit(None).cast("string").alias("coinbase"), "txid", "vout", F.lit(0).cast("long").alias("sequence")).alias("x"))
    listed = lambda kind, value: F.sort_array(F.collect_list(of_kind(kind, value)))
    tx = by_place(creates, spends, txs).groupBy("block_height", "tx_index").agg(F.max(of_kind(TX, F.col("txid"))).alias("txid"), F.max("block_time").alias("block_time"), listed(IN, into).alias("i"), listed(OUT, out).alias("o"))
    none = F.array(F.struct(F.lit("00").alias("coinbase"), F.lit(None).cast("string").alias("txid"), F.lit(None).cast("long").alias("vout"), F.lit(0).cast("long").alias("sequence")))
    vin = F.when(F.size("i") > 0, F.transform("i", lambda x: x["x"])).otherwise(none).cast(VIN)
    body = F.struct("txid", vin.alias("vin"), F.transform("o", lambda x: x["x"]).cast(VOUT).alias("vout"))
    whole = tx.where("txid is not null").select("block_height", "block_time", F.struct("tx_index", body.alias("t")).alias("t")).groupBy("block_height").agg(F.max("block_time").alias("time"), F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(F.col("block_height").alias("height"), "time", F.transform("t", lambda x: x["t"]).alias("tx"))
