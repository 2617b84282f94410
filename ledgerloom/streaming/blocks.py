"""A stream of nested blocks kept as tables by key, through replays and reorganizations.

Four tables are kept: outputs with the spend that took them, blocks, the outputs that each block
touched (a journal), and balances. A micro-batch looks up what its keys ask for, works out the new
rows in one shuffle by output, adds them as runs and commits all tables with its own number in one manifest; so it counts
wholly or not at all, and a repeated batch is left out. Tables are merged as they grow
(:mod:`..sources.keyed`), so what a batch reads depends on its keys, not on how long the log is.

A batch that brings another block for a known height replaces all blocks from there on: the journal
names the outputs that they touched, which become what they were before. A spend of an output that
isn't there, or that is spent already, is an error unless ``strict`` is off.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.amounts import AMOUNT, total, txid_of
from ..operators import derive, maintain
from ..operators.versioned import maybe_among
from ..sources import manifest
from ..sources.keyed import BUCKET, GONE, RUN, KeyedTable

CREATE = ["output_key", "txid", "tx_index", "vout", "block_height", "block_hash", "block_time", "address", "value_base", "is_spendable", "is_coinbase"]
SPEND = ["spent_by_txid", "spent_in_block", "spent_tx_index", "input_index"]
#: How tables are dealt into buckets; 1 (and none) had the journal by thousands of heights.
FORMAT = 2
#: What is stored of an output, and of its spend; the rest follows from its key and its block.
MADE = ["block_height", "tx_index", "vout", "address", "value_base", "is_spendable", "is_coinbase"]
MADE_TYPE = "block_height:bigint,tx_index:bigint,vout:bigint,address:string,value_base:bigint,is_spendable:boolean,is_coinbase:boolean"
SPEND_TYPE = "spent_by_txid:string,spent_in_block:bigint,spent_tx_index:bigint,input_index:bigint"
#: What a batch's run says beside its rows.
ALSO = "_made boolean, _taken boolean, _was_address string, _was bigint, _fault string"
#: Heights whose blocks share a bucket.
HEIGHTS = 1000
#: Keys, and rows of a table, that are sent to all tasks at most.
MOST_SENT = 1 << 20


class Tables:
    """The tables under a path."""

    def __init__(self, path: str):
        range_of = lambda: F.floor(F.col("block_height") / HEIGHTS)
        self.outputs = KeyedTable(path, "outputs", "output_key string, " + f"{MADE_TYPE},{SPEND_TYPE}".replace(":", " "), ("output_key",), lambda: txid_of(F.col("output_key")))
        self.blocks = KeyedTable(path, "blocks", "block_height bigint, block_hash string, block_time bigint, tx_count bigint, previous_hash string", ("block_height",), range_of)
        self.journal = KeyedTable(path, "journal", "block_height bigint, output_key string", ("block_height", "output_key"), lambda: F.col("block_height"))
        self.balances = KeyedTable(path, "balances", f"address string, balance {AMOUNT}, outputs bigint", ("address",), lambda: F.col("address"))
        self.all = (self.outputs, self.blocks, self.journal, self.balances)


def _runs(content: dict, table: KeyedTable) -> list[dict]:
    return content.get("runs", {}).get(table.name, [])


def _committed(spark: SparkSession, path: str) -> dict:
    number, content = manifest.current(spark, path)
    if not number:
        raise ValueError(f"no ledger is kept under {path}")
    return _checked(content, path)


def _checked(content: dict, path: str) -> dict:
    if content and content.get("format") != FORMAT:
        raise ValueError(f"the ledger under {path} was dealt into buckets in another way; it must be made anew")
    return content


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """creates, spends or processed_blocks, of all blocks that count."""
    content, t = _committed(spark, path), Tables(path)
    if name == "processed_blocks":
        return t.blocks.read(spark, _runs(content, t.blocks))
    rows = t.outputs.read(spark, _runs(content, t.outputs))
    if name == "creates":
        return _whole(spark, content, t, rows.where("block_height is not null")).select(*CREATE)
    if name == "spends":
        return rows.where("spent_by_txid is not null").select(F.col("output_key").alias("spent_output_key"), *SPEND)
    raise ValueError(f"no table {name}")


def _whole(spark: SparkSession, content: dict, t: Tables, rows: DataFrame) -> DataFrame:
    """Stored outputs with their transaction, and the hash and time of their block."""
    blocks = t.blocks.read(spark, _runs(content, t.blocks)).select("block_height", "block_hash", "block_time")
    return rows.join(blocks, "block_height", "left").select("output_key", txid_of(F.col("output_key")).alias("txid"), *CREATE[2:], *SPEND)


def outputs_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The outputs whose ``output_key`` is among ``keys``, with their spend; reads the buckets of the keys only."""
    content, t = _committed(spark, path), Tables(path)
    return _whole(spark, content, t, t.outputs.lookup(spark, _runs(content, t.outputs), keys.select("output_key")))


def state(spark: SparkSession, path: str) -> DataFrame:
    """Outputs with their spend, of all blocks that count."""
    content, t = _committed(spark, path), Tables(path)
    rows = t.outputs.read(spark, _runs(content, t.outputs)).where("block_height is not null")
    return rows.select("output_key", txid_of(F.col("output_key")).alias("txid"), "block_height", "address", "value_base", "is_spendable", "spent_by_txid", "spent_in_block", "input_index")


def balances(spark: SparkSession, path: str) -> DataFrame:
    content, t = _committed(spark, path), Tables(path)
    return t.balances.read(spark, _runs(content, t.balances)).select("address", F.lit("").alias("asset_address"), "balance")


def state_with_balances(spark: SparkSession, path: str) -> DataFrame:
    """Outputs with their spend and what their address holds."""
    content = _committed(spark, path)
    own = balances(spark, path).select("address", "balance")
    few = sum(run["rows"] for run in _runs(content, Tables(path).balances)) <= MOST_SENT  # else Spark chooses
    return state(spark, path).join(F.broadcast(own) if few else own, "address", "left")


def apply_batch(batch: DataFrame, batch_id: int, path: str, strict: bool = True, source: str = "") -> None:
    """Apply a batch of nested blocks; ``batch_id`` counts the batches of ``source`` (a stream's checkpoint)."""
    spark = batch.sparkSession
    number, content = manifest.current(spark, path)
    if _checked(content, path).get("batches", {}).get(source, -1) >= batch_id:
        return
    batch.persist(StorageLevel.DISK_ONLY)  # tasks need their memory for the shuffle
    held = [batch]
    try:
        _apply(spark, batch, number, content, path, strict, {"batches": content.get("batches", {}) | {source: batch_id}}, held)
    finally:
        for df in held:
            df.unpersist()


def _apply(spark: SparkSession, batch: DataFrame, number: int, content: dict, path: str, strict: bool, mark: dict, held: list[DataFrame]) -> None:
    t = Tables(path)
    runs = {table.name: _runs(content, table) for table in t.all}
    known = t.blocks.lookup(spark, runs["blocks"], batch.select(F.col("height").alias("block_height"))).persist()
    # a short row for each of the batch's blocks, which are far larger themselves and stay where they are
    batch = batch.join(F.broadcast(known.select(F.col("block_height").alias("height"), F.col("block_hash").alias("hash"))), ["height", "hash"], "left_anti")
    if (bad := derive.violations(batch).first()) is not None:
        raise ValueError(f"block {bad['block_height']}: {bad['reason']}")
    blocks = derive.derive_processed_blocks(batch, derive.weight()).persist()
    held += [known, blocks]
    creates, spends = derive.derive_creates(batch), derive.derive_spends(batch)
    fork, sums = maintain.reorg_height(blocks, known).first()[0], blocks.agg(F.max("block_height").alias("top"), F.sum("weight").alias("n")).first()
    tail, top, n, at = content.get("tail", -1), sums["top"], sums["n"] or 0, number + 1
    marked = lambda df, flag: df.withColumn(GONE, F.lit(flag))
    undone = left = None
    if fork is not None:
        replaced = spark.range(fork, tail + 1).select(F.col("id").alias("block_height"))
        undone = t.journal.lookup(spark, runs["journal"], replaced, ["block_height"]).persist()
        left = t.blocks.lookup(spark, runs["blocks"], replaced).join(blocks.select("block_height"), "block_height", "left_anti")
        held.append(undone)
        n += undone.count()
    fresh = {"outputs": t.outputs.put(_outputs(spark, t.outputs, runs["outputs"], creates, spends, undone, fork, n), at, n, ALSO)}
    written = t.outputs.written(spark, fresh["outputs"], ALSO)
    if strict and (fault := written.where("_fault is not null").select("_fault").first()) is not None:
        manifest.remove(spark, f"{path}/{fresh['outputs']['folder']}")
        raise ValueError(fault[0])
    touched = F.filter(F.array(F.when(F.col("_made"), F.col("block_height")), F.when(F.col("_taken"), F.col("spent_in_block"))), lambda h: h.isNotNull())
    journal = written.select(F.explode(F.array_distinct(touched)).alias("block_height"), "output_key")
    fresh["journal"] = t.journal.put(marked(journal, False) if undone is None else marked(journal, False).unionByName(marked(undone.join(journal, ["block_height", "output_key"], "left_anti"), True)), at, n)
    fresh["blocks"] = t.blocks.write(marked(blocks.drop("weight"), False) if left is None else marked(blocks.drop("weight"), False).unionByName(marked(left, True)), at)
    # balances change by what the run that was just written changes
    was = written.where("_was is not null").select(F.col("_was_address").alias("address"), (-F.col("_was")).alias("value"), F.lit(-1).cast("long").alias("n"))
    change = _worth(written.where(f"not {GONE}")).unionByName(was).groupBy("address").agg(total(F.col("value")).alias("value"), F.sum("n").alias("n")).where("value <> 0 or n <> 0").persist()
    held.append(change)
    old = t.balances.lookup(spark, runs["balances"], change.select("address"))
    new = change.join(old, "address", "left").select("address", (F.coalesce("balance", F.lit(0).cast(AMOUNT)) + F.col("value")).cast(AMOUNT).alias("balance"), (F.coalesce("outputs", F.lit(0)) + F.col("n")).alias("outputs"))
    fresh["balances"] = t.balances.write(new.withColumn(GONE, F.col("outputs") == 0), at)
    dropped = []
    for table in t.all:
        runs[table.name], old_folders = table.compacted(spark, [*runs[table.name], fresh[table.name]])
        dropped += old_folders
    tail = tail if top is None else top if fork is not None else max(tail, top)
    manifest.commit(spark, path, number, {"format": FORMAT, "runs": runs, "tail": tail} | mark, dropped)


def _outputs(spark: SparkSession, table: KeyedTable, runs: list[dict], creates: DataFrame, spends: DataFrame, undone: DataFrame | None, fork: int | None, n: int) -> DataFrame:
    """The outputs that a batch and what it replaces touch, as they are after it: one shuffle by output, of ``n`` keys at most and what is stored of them.

    An output that is known stays, and so does a recorded spend; blocks from ``fork`` on don't count any more.
    Spends without an output are rows without a height. Beside the row stand (``ALSO``) whether the batch
    made it and took it, what it was worth to which address before, and what is wrong with its spends.
    """
    made, taken, old = F.struct(*MADE), F.struct("spent_in_block", "spent_tx_index", "input_index", "spent_by_txid"), F.struct(RUN, GONE, *MADE, *SPEND)
    parts = [creates.select("output_key", made.alias("made")), spends.select(F.col("spent_output_key").alias("output_key"), taken.alias("taken"))]
    if undone is not None:
        parts.append(undone.select("output_key", F.lit(True).alias("undone")))
    if runs:
        keys = parts[0].select("output_key")
        for part in parts[1:]:
            keys = keys.unionByName(part.select("output_key"))
        stored = table.versions(spark, runs, keys)
        stored = stored.join(F.broadcast(keys.distinct()), "output_key", "left_semi") if n <= MOST_SENT else maybe_among(stored, "output_key", keys)
        parts.append(stored.select("output_key", old.alias("old")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    for name, like in (("undone", "boolean"), ("old", None)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(like or f"struct<{RUN}:int,{GONE}:boolean,{MADE_TYPE},{SPEND_TYPE}>"))
    each = F.struct("taken.spent_by_txid", "taken.spent_in_block", "taken.input_index")
    spend = F.when(F.col("taken").isNotNull(), each)
    own = table.placed(rows, table.buckets_for(n)).groupBy(BUCKET, "output_key").agg(F.min("made").alias("made"), F.min("taken").alias("taken"), F.min(spend).alias("low"), F.max(spend).alias("high"), F.max("undone").alias("undone"), F.max("old").alias("old"))
    own = own.where("made is not null or taken is not null or undone").withColumn("now", F.when(~F.col(f"old.{GONE}"), F.col("old")))
    below = lambda c: F.lit(True) if fork is None else c < fork
    stays = below(F.coalesce("now.block_height", F.lit(-1)))
    was_made = F.when(F.col("now.block_height").isNotNull() & stays, F.struct(*[F.col(f"now.{c}").alias(c) for c in MADE]))
    was_taken = F.when(F.col("now.spent_by_txid").isNotNull() & stays & below(F.col("now.spent_in_block")), F.struct(*[F.col(f"now.{c}").alias(c) for c in ("spent_in_block", "spent_tx_index", "input_index", "spent_by_txid")]))
    own = own.withColumns({"was_made": was_made, "was_taken": was_taken}).withColumns({"m": F.coalesce("was_made", "made"), "s": F.coalesce("was_taken", "taken")})
    gone = F.col("m").isNull() & F.col("s").isNull()
    recorded = F.struct(F.col("was_taken.spent_by_txid"), F.col("was_taken.spent_in_block"), F.col("was_taken.input_index"))
    other = F.when(F.col("low") != recorded, F.col("low.spent_by_txid")).when(F.col("high") != recorded, F.col("high.spent_by_txid"))
    nowhere = F.when(F.col("taken").isNotNull() & F.col("m").isNull() & F.col("was_taken").isNull(), F.concat("taken.spent_by_txid", F.lit(" spends "), "output_key", F.lit(", which isn't there")))
    twice = F.when(F.col("taken").isNotNull() & F.col("was_taken").isNotNull(), F.concat(other, F.lit(" spends "), "output_key", F.lit(", which "), "was_taken.spent_by_txid", F.lit(" has spent")))
    worth = F.expr("now.is_spendable and now.address <> '' and now.spent_by_txid is null")
    return own.where(F.col("now").isNotNull() | ~gone).select(
        BUCKET, "output_key", *[F.col(f"m.{c}").alias(c) for c in MADE], *[F.col(f"s.{c}").alias(c) for c in SPEND], gone.alias(GONE),
        (F.col("made").isNotNull() & F.col("was_made").isNull()).alias("_made"), (F.col("taken").isNotNull() & F.col("was_taken").isNull()).alias("_taken"),
        F.when(worth, F.col("now.address")).alias("_was_address"), F.when(worth, F.col("now.value_base")).alias("_was"), F.coalesce(nowhere, twice).alias("_fault"),
    )


def _worth(rows: DataFrame) -> DataFrame:
    """What unspent outputs add to their addresses."""
    own = rows.where("is_spendable and address <> '' and spent_by_txid is null")
    return own.select("address", F.col("value_base").alias("value"), F.lit(1).cast("long").alias("n"))


def follow(blocks: DataFrame, path: str, checkpoint: str, strict: bool = True, **trigger) -> StreamingQuery:
    """Start keeping the ledger of a stream of nested blocks under ``path``."""
    return blocks.writeStream.foreachBatch(lambda batch, i: apply_batch(batch, i, path, strict, checkpoint)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
