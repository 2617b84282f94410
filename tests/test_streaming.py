"""Streams give what their batch forms give."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerloom.operators import derive, ledger, maintain
from ledgerloom.sources import files
from ledgerloom.streaming import blocks as block_stream
from ledgerloom.streaming import mempool as mempool_stream
from test_ledger import GOLDEN, block, frame, rows

AT = "2026-06-01 12:34:56.789"


def test_block_stream_with_reorganization(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    fork = [block(2, [("tx-9", [("tx-1", 1)], [("other", 58)])], "x"), block(3, [("tx-10", [("tx-9", 0)], [("last", 57)])], "x")]
    for part in (GOLDEN[:2], GOLDEN[2:], GOLDEN[1:2], fork):
        frame(spark, part).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(derive.block_schema()).json(src)
        block_stream.follow(stream, out, f"{tmp_path}/checkpoint").awaitTermination()
    whole = frame(spark, [*GOLDEN[:2], *fork])
    creates, spends = derive.derive_creates(whole), derive.derive_spends(whole)
    want = rows(ledger.balances(ledger.current_utxo(creates, spends)), "address", "balance")
    assert rows(block_stream.balances(spark, out), "address", "balance") == want
    assert rows(block_stream.read_table(spark, out, "processed_blocks"), "block_height", "block_hash") == [(0, "h0"), (1, "h1"), (2, "h2x"), (3, "h3x")]
    # the last batch again: nothing changes
    block_stream.apply_batch(frame(spark, fork), 4, out)
    assert rows(block_stream.balances(spark, out), "address", "balance") == want
    assert maintain.missing_prevouts(block_stream.read_table(spark, out, "spends"), block_stream.read_table(spark, out, "creates")).isEmpty()


def test_strict_block_stream(spark, tmp_path):
    """A spend of an output that isn't there, or is spent already, stops a strict stream; a fork spends what it replaces anew."""
    import pytest

    out = f"{tmp_path}/out"
    fork = [block(2, [("tx-9", [("tx-1", 1)], [("other", 58)])], "x")]
    for i, part in enumerate((GOLDEN[:2], GOLDEN[2:], GOLDEN[2:], fork)):
        block_stream.apply_batch(frame(spark, part), i, out, strict=True)
    assert rows(block_stream.read_table(spark, out, "processed_blocks"), "block_height", "block_hash")[-1] == (2, "h2x")
    for bad, what in (([("tx-30", [("nowhere", 0)], [("z", 1)])], "isn't there"), ([("tx-31", [("tx-1", 1)], [("z", 1)])], "has spent")):
        with pytest.raises(ValueError, match=what):
            block_stream.apply_batch(frame(spark, [block(3, bad, "x")]), 9, out, strict=True)


def test_spends_before_their_outputs(spark, tmp_path):
    """Without strictness a spend may come first; it is kept for its output. Another source counts its batches for itself."""
    import pytest

    out = f"{tmp_path}/out"
    with pytest.raises(ValueError, match="no ledger"):
        block_stream.state(spark, out)
    keys = spark.createDataFrame([("tx-0:0",), ("tx-1:1",), ("none:0",)], "output_key string")
    for i, part in enumerate((GOLDEN[1:], GOLDEN[:1])):
        block_stream.apply_batch(frame(spark, part), i, out, strict=False)
        if not i:
            assert rows(block_stream.outputs_of(spark, out, keys), "output_key", "block_height", "spent_by_txid")[0] == ("tx-0:0", None, "tx-1")
    whole = frame(spark, GOLDEN)
    creates, spends = derive.derive_creates(whole), derive.derive_spends(whole)
    state = ["output_key", "block_height", "value_base"]
    assert rows(block_stream.state(spark, out), *state) == rows(maintain.state_of(creates, spends), *state)
    assert rows(block_stream.balances(spark, out), "address", "balance") == rows(ledger.balances(ledger.current_utxo(creates, spends)), "address", "balance")
    assert rows(block_stream.read_table(spark, out, "spends"), "spent_output_key", "spent_by_txid") == rows(spends, "spent_output_key", "spent_by_txid")
    block_stream.apply_batch(frame(spark, [block(3, [("tx-3", [("tx-2", 0)], [("z", 25)])])]), 0, out, source="other")
    assert {r["output_key"] for r in block_stream.outputs_of(spark, out, keys).collect()} == {"tx-0:0", "tx-1:1"}
    assert ("z", 2_500_000_000) in rows(block_stream.balances(spark, out), "address", "balance")


def test_samples(spark, tmp_path):
    entry = json.dumps({"time": 1780000000, "height": 6000000, "vsize": 250, "size": 300, "fee": "0.01", "depends": ["a", " "]})
    bad = json.dumps({"vsize": 0, "size": -1, "fees": {"base": "0.5"}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"fetched_at": f"{AT}Z", "entries": {"t1": entry, "t2": bad}}))
    stream = spark.readStream.schema(files.MEMPOOL).json(f"{tmp_path}/in")
    query = mempool_stream.samples(stream).writeStream.format("memory").queryName("samples").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["txid"]: r for r in spark.table("samples").collect()}
    assert str(got["t1"]["sampled_at"]) == "2026-06-01 12:34:56" and (got["t1"]["fee_base"], got["t1"]["fee_rate"], got["t1"]["size_bytes"]) == (1000000, 4000000, 250)
    assert (got["t2"]["fee_base"], got["t2"]["fee_rate"], got["t2"]["entry_time"]) == (50000000, None, None)
    from ledgerloom.operators import mempool

    batch = mempool.sampled(files.read_mempool_snapshots(spark, f"{tmp_path}/in"))
    assert sorted(map(str, batch.collect())) == sorted(map(str, spark.table("samples").collect()))


def test_first_seen_and_matches(spark, tmp_path):
    schema = "txid string, seen_at timestamp, outputs array<struct<vout:int,address:string,value_base:bigint>>"
    rows_ = [("t1", AT, [(0, "a", 5), (1, "a", 6), (2, "b", 1)]), ("t1", AT, [(0, "a", 5)]), ("t2", AT, [(0, "b", 1)])]
    frame_ = spark.createDataFrame(rows_, "txid string, seen_at string, outputs array<struct<vout:int,address:string,value_base:bigint>>").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    frame_.coalesce(1).write.parquet(f"{tmp_path}/tx")
    watches = spark.createDataFrame([(1, "a", 10), (2, "b", 2), (3, "b", None)], "watch_id long, address string, min_value long")
    stream = mempool_stream.first_seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/tx"))
    query = stream.select("txid").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["txid"] for r in spark.table("seen").collect()) == ["t1", "t2"]
    unique = frame_.orderBy(F.size("outputs").desc()).limit(1).union(frame_.where("txid = 't2'"))
    assert rows(mempool_stream.matches(unique, watches), "watch_id", "txid", "paid") == [(1, "t1", 11), (3, "t1", 1), (3, "t2", 1)]
    assert rows(mempool_stream.feeds(unique.select("txid"), unique.select("txid")), "txid", "source") == [("t1", "catchup"), ("t1", "live"), ("t2", "catchup"), ("t2", "live")]
