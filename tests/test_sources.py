"""Block decoding from blocks that a small encoder makes, malformed blocks, files."""

from __future__ import annotations

import hashlib
import struct
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import udfs
from ledgerloom.operators import derive, ledger
from ledgerloom.sources import files, raw_blocks


def sha(b: bytes) -> bytes:
    return hashlib.sha256(hashlib.sha256(b).digest()).digest()


def size(n: int) -> bytes:
    return bytes([n]) if n < 0xFD else b"\xfd" + struct.pack("<H", n) if n < 1 << 16 else b"\xfe" + struct.pack("<I", n)


def encoded_tx(ins, outs, locktime=0, witnesses=False) -> bytes:
    """ins: (txid or None, vout, script), outs: (units, script)."""
    body = size(len(ins))
    for txid, vout, script in ins:
        body += (bytes.fromhex(txid)[::-1] if txid else bytes(32)) + struct.pack("<I", 0xFFFFFFFF if txid is None else vout) + size(len(script)) + script + struct.pack("<I", 7)
    body += size(len(outs)) + b"".join(struct.pack("<q", v) + size(len(s)) + s for v, s in outs)
    mark, tail = (b"\0\1", b"".join(size(1) + size(3) + b"abc" for _ in ins)) if witnesses else (b"", b"")
    return struct.pack("<i", 2) + mark + body + tail + struct.pack("<I", locktime)


def encoded_block(txs, before="11" * 32, version=1, parent=b"", time=1_400_000_000) -> bytes:
    head = struct.pack("<i", version) + bytes.fromhex(before)[::-1] + b"\x22" * 32 + struct.pack("<III", time, 0x1E0FFFF0, 99943)
    return head + parent + size(len(txs)) + b"".join(txs)


PAY = b"\x76\xa9\x14" + b"\x33" * 20 + b"\x88\xac"
COIN = encoded_tx([(None, 0, b"\x04abcd")], [(8_800_000_000, PAY), (0, b"\x6a\x02hi")])


def test_genesis_header():
    """The well-known first header of the chain and its hash."""
    root = "5b2a3f53f605d62c53e62932dac6925e3d74afa5a4b459745c36d42d0ed26a69"
    head = struct.pack("<i", 1) + bytes(32) + bytes.fromhex(root)[::-1] + struct.pack("<III", 1386325540, 0x1E0FFFF0, 99943)
    own = raw_blocks.decode(head + size(1) + COIN, 0)
    assert own["hash"] == "1a91e3dace36e2be3bf030a65679fe821aa1d6ef92e7c9902eb318182c355691"
    assert (own["previousblockhash"], own["merkleroot"], own["bits"], own["nonce"], own["time"]) == (None, root, "1e0ffff0", 99943, 1386325540)


def test_blocks(spark, tmp_path):
    script_hash, key = b"\xa9\x14" + b"\x44" * 20 + b"\x87", b"\x02" + b"\x55" * 32
    first = sha(COIN)[::-1].hex()
    spend = encoded_tx([(first, 0, b"\x01s"), ("99" * 32, 3, b"")], [(5, script_hash), (-7, size(33) + key + b"\xac"), (2**62, b"\x51" * 400)], locktime=9)
    branches = size(2) + bytes(64) + struct.pack("<I", 1) + size(0) + struct.pack("<I", 0)
    parent_head = b"\x66" * 80
    parent = encoded_tx([(None, 0, b"p")], [(1, PAY)], witnesses=True) + b"\x77" * 32 + branches + parent_head
    blocks = {5: encoded_block([COIN, spend]), 6: encoded_block([COIN] * 300, before="ab" * 32, version=1 | 1 << 8 | 98 << 16, parent=parent)}
    for height, data in blocks.items():
        (tmp_path / f"{height}.hex").write_text(data.hex() + "\n")
    decoded = raw_blocks.decode_blocks(raw_blocks.read_raw_blocks(spark, str(tmp_path)), strict=True).cache()
    got = {r["height"]: r["block"].asDict(recursive=True) for r in decoded.collect()}
    assert set(got) == {5, 6} and got[6]["nTx"] == 300 and got[6]["auxpow"] == {"parentBlockHash": sha(parent_head)[::-1].hex()} and got[5]["auxpow"] is None
    own = got[5]
    assert (own["hash"], own["size"], own["previousblockhash"], own["time"]) == (sha(blocks[5][:80])[::-1].hex(), len(blocks[5]), "11" * 32, 1_400_000_000)
    assert [(t["txid"], t["size"], t["locktime"], t["version"]) for t in own["tx"]] == [(sha(t)[::-1].hex(), len(t), lock, 2) for t, lock in ((COIN, 0), (spend, 9))]
    assert own["tx"][0]["vin"] == [{"coinbase": "0461626364", "txid": None, "vout": None, "sequence": 7, "script": None}]
    assert [(i["txid"], i["vout"], i["script"]) for i in own["tx"][1]["vin"]] == [(first, 0, "0173"), ("99" * 32, 3, "")]
    outs = [(o["n"], o["value"], o["script"]["type"]) for t in own["tx"] for o in t["vout"]]
    assert outs == [(0, "88.00000000", "pubkeyhash"), (1, "0.00000000", "nulldata"), (0, "0.00000005", "scripthash"), (1, "-0.00000007", "pubkey"), (2, "46116860184.27387904", "nonstandard")]
    owners = [o["script"]["addresses"] for t in own["tx"] for o in t["vout"]]
    assert owners[0] == [raw_blocks.address(0x1E, b"\x33" * 20)] and owners[2] == [raw_blocks.address(0x16, b"\x44" * 20)] and owners[3] == [raw_blocks.key_address(key)] and owners[1] is None
    creates = derive.derive_creates(raw_blocks.nested_blocks(decoded)).where("block_height = 5")
    assert sorted((r["output_key"], r["value_base"]) for r in ledger.credit_movements(creates).selectExpr("output_key", "amount_base as value_base").collect()) == sorted(
        [(f"{first}:0", 8_800_000_000), (f"{sha(spend)[::-1].hex()}:0", 5), (f"{sha(spend)[::-1].hex()}:1", -7)]
    )
    wrong = raw_blocks.wrong_hashes(decoded, decoded.select("height", F.when(F.col("height") == 6, "no").otherwise(F.col("block.hash")).alias("expected_hash")))
    assert [r["height"] for r in wrong.collect()] == [6]


def test_malformed_blocks(spark):
    one = encoded_block([COIN, COIN]).hex()
    bad = spark.createDataFrame([(1, "zz"), (2, one[:-8]), (3, one + "00"), (4, one[:100]), (5, None), (6, one)], "height long, hex string")
    errors = {r["height"]: r["error"] for r in raw_blocks.decode_blocks(bad).collect()}
    assert errors[6] is None and all(errors[h].startswith("invalid raw block payload") for h in (1, 2, 3, 4, 5))
    assert "trailing 1 bytes" in errors[3] and "tx_index=1" in errors[2] and f"tx_offset={81 + len(COIN)}" in errors[2]
    with pytest.raises(Exception, match="trailing 1 bytes"):
        raw_blocks.decode_blocks(bad.where("height = 3"), strict=True).collect()


def test_long_scripts_end():
    began = time.perf_counter()
    for script in (b"\x51" + bytes(100_000), b"\x51" + (b"\x21" + b"\x02" + b"a" * 32) * 20_000 + b"\x52", b"\x51" * 100_000 + b"\xae", b"\x6a" + b"\x4c\x01a" * 30_000):
        raw_blocks.script_kind(script)
    assert time.perf_counter() - began < 5


def test_functions_by_name(spark):
    udfs.register(spark)
    key = b"\x02" + b"\x55" * 32
    rows = spark.createDataFrame([(bytearray(PAY), bytearray(key), "0x" + "f" * 40), (None, None, "0xg"), (bytearray(b""), bytearray(b"k"), None)], "s binary, k binary, h string")
    got = rows.selectExpr("script_type(s) as t", "p2pkh_address(k) as a", "hex_units(h) as u").collect()
    assert [tuple(r) for r in got] == [("pubkeyhash", raw_blocks.key_address(key), str(16**40 - 1)), (None, None, None), ("nonstandard", raw_blocks.key_address(b"k"), None)]
    assert raw_blocks.key_address(key).startswith("D")


def test_scripts():
    a, b = "02" + "11" * 32, "03" + "22" * 32
    multi = raw_blocks.script_kind(bytes.fromhex(f"5121{a}21{b}52ae"))
    assert (multi["type"], multi["reqSigs"], len(multi["addresses"])) == ("multisig", 1, 2) and all(x.startswith("D") for x in multi["addresses"])
    kinds = {"6a04deadbeef": "nulldata", "51": "nonstandard", "76a914": "nonstandard", "6a05de": "nonstandard", f"5321{a}21{b}52ae": "nonstandard", "": "nonstandard", "6a4c02ffff": "nulldata"}
    assert {h: raw_blocks.script_kind(bytes.fromhex(h))["type"] for h in kinds} == kinds


def test_snapshots_and_facts(spark, tmp_path):
    from test_ledger import GOLDEN, frame

    blocks = frame(spark, GOLDEN)
    files.write_snapshots(blocks, f"{tmp_path}/snapshots")
    back = files.read_snapshots(spark, f"{tmp_path}/snapshots")
    assert sorted(map(str, back.select("hash", "height", "tx").collect())) == sorted(map(str, blocks.select("hash", "height", "tx").collect()))
    low = blocks.where("height < 2")
    facts = lambda b: {"creates": derive.derive_creates(b), "spends": derive.derive_spends(b), "processed_blocks": derive.derive_processed_blocks(b)}
    whole = facts(low)
    unfinished = {k: v for k, v in facts(blocks.where("height >= 2")).items() if k != "processed_blocks"}
    for _ in range(2):  # a window that is written again counts once
        files.append_facts({k: v for k, v in whole.items() if k != "processed_blocks"}, f"{tmp_path}/facts", "0-1")
        files.append_facts(whole, f"{tmp_path}/facts", "0-1")
        files.append_facts(unfinished, f"{tmp_path}/facts", "2-9")
    back = files.read_facts(spark, f"{tmp_path}/facts", "creates")
    assert back.columns == whole["creates"].columns and sorted(map(str, back.collect())) == sorted(map(str, whole["creates"].collect()))
    assert {r["block_height"] for r in back.collect()} == {0, 1}
    state = {"utxo": whole["creates"], "balances": ledger.balances(whole["creates"]), "applied_blocks": whole["processed_blocks"]}
    files.replace_state(state, f"{tmp_path}/snapshot")
    files.replace_state({k: v.limit(0) for k, v in state.items()}, f"{tmp_path}/state")
    files.import_state(spark, f"{tmp_path}/snapshot", f"{tmp_path}/state")
    assert {k: v.count() for k, v in files.read_state(spark, f"{tmp_path}/state").items()} == {k: v.count() for k, v in state.items()}


def test_corrupt_snapshot(spark, tmp_path):
    """A file that isn't gzip under that name is an error, not an empty block."""
    (tmp_path / "1.json.gz").write_bytes(b"no gzip")
    with pytest.raises(Exception):
        files.read_snapshots(spark, str(tmp_path)).collect()
