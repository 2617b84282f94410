"""A three-block ledger worked out by hand, properties of the state, functions."""

from __future__ import annotations

import json
import random
from decimal import Decimal
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import amounts
from ledgerloom.operators import audit, derive, explorer, ledger, maintain, mempool, sequence, versioned

COIN = 10**8


def block(height, txs, salt=""):
    """txs: [(txid, [(previous txid, place)], [(address, coins)])]."""
    tx = [
        {
            "txid": t,
            "vin": [{"coinbase": None, "txid": p, "vout": n, "sequence": 0} for p, n in ins] or [{"coinbase": "00", "txid": None, "vout": None, "sequence": 0}],
            "vout": [{"n": i, "value": str(v), "type": "pubkeyhash", "address": None, "addresses": [a] if a else []} for i, (a, v) in enumerate(outs)],
        }
        for t, ins, outs in txs
    ]
    return {"hash": f"h{height}{salt}", "height": height, "time": 1_700_000_000 + 60 * height, "previousblockhash": f"h{height - 1}" if height else None, "tx": tx}


GOLDEN = [
    block(0, [("tx-0", [], [("source", 100)])]),
    block(1, [("tx-1", [("tx-0", 0)], [("intermediary", 40), ("source", 59)])]),
    block(2, [("tx-2", [("tx-1", 0)], [("target", 25), ("intermediary", 14)])]),
]


def frame(spark, blocks):
    return spark.createDataFrame(blocks, derive.block_schema())


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_golden_ledger(spark):
    b = frame(spark, GOLDEN)
    creates, spends = derive.derive_creates(b), derive.derive_spends(b)
    utxo = ledger.current_utxo(creates, spends)
    assert rows(ledger.balances(utxo), "address", "balance") == [("intermediary", 14 * COIN), ("source", 59 * COIN), ("target", 25 * COIN)]
    assert rows(ledger.transactions(creates, spends), "txid", "is_coinbase") == [("tx-0", True), ("tx-1", False), ("tx-2", False)]
    assert {r["txid"]: r["fee_base"] for r in ledger.transactions(creates, spends).collect()} == {"tx-0": None, "tx-1": COIN, "tx-2": COIN}
    assert maintain.balance_invariant(utxo, ledger.movements(creates, spends)).isEmpty()
    assert rows(ledger.address_activity(ledger.movements(creates, spends)), "address", "received", "sent", "tx_count") == [("intermediary", 54 * COIN, 40 * COIN, 2), ("source", 159 * COIN, 100 * COIN, 2), ("target", 25 * COIN, 0, 1)]
    assert rows(derive.block_weights(b), "block_height", "weight") == [(0, 2), (1, 3), (2, 3)]
    assert derive.violations(b).isEmpty() and sequence.chain_violations(derive.derive_processed_blocks(b)).isEmpty()


def test_violations_and_blank_addresses(spark):
    broken = [GOLDEN[0] | {"hash": None}, GOLDEN[1] | {"tx": []}, GOLDEN[2] | {"time": None}]
    assert rows(derive.violations(frame(spark, broken)), "block_height", "reason") == [(0, "no hash"), (1, "no transactions"), (2, "no time")]
    found = spark.createDataFrame([(" a ", ["b"]), ("  ", [" ", "c"]), (None, None)], "x string, y array<string>").select(derive.first_address(F.col("x"), F.col("y")).alias("a"))
    assert [r["a"] for r in found.collect()] == ["a", "c", ""]


def test_rewind_and_replay(spark):
    b = frame(spark, GOLDEN)
    creates, spends = derive.derive_creates(b), derive.derive_spends(b)
    state = maintain.state_of(creates, spends)
    before = maintain.rewind(state, 2)
    assert rows(maintain.state_balances(before), "address", "balance") == [("intermediary", 40 * COIN), ("source", 59 * COIN)]
    new = [block(2, [("tx-9", [("tx-1", 1)], [("other", 58)])], "x")]
    c, s = derive.derive_creates(frame(spark, new)), derive.derive_spends(frame(spark, new))
    assert rows(maintain.state_balances(maintain.reorganized(creates, spends, c, s, 2)), "address", "balance") == [("intermediary", 40 * COIN), ("other", 58 * COIN)]
    known = derive.derive_processed_blocks(b)
    assert maintain.reorg_height(derive.derive_processed_blocks(frame(spark, new)), known).first()[0] == 2
    assert maintain.pending_blocks(derive.derive_processed_blocks(frame(spark, [GOLDEN[2], *new])), known).count() == 1


chains = st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=3), min_size=1, max_size=5)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(chains, st.integers(1, 4))
def test_windows_equal_one_go(spark, plan, cut):
    """Applying window by window, twice each, equals the state in one go; rewinding equals the prefix."""
    free, blocks = [], []
    for h, txs in enumerate(plan):
        made = []
        for i, (take, pay) in enumerate(txs):
            ins = [free.pop(0) for _ in range(min(take, len(free)))]
            outs = [(f"a{(h + k) % 3}", h + k + 1) for k in range(pay + 1)]
            made.append((f"t{h}-{i}", ins, outs))
            free += [(f"t{h}-{i}", k) for k in range(pay + 1)]
        blocks.append(block(h, made))
    b = frame(spark, blocks)
    creates, spends = derive.derive_creates(b).cache(), derive.derive_spends(b).cache()
    whole = maintain.state_of(creates, spends)
    cut = min(cut, len(plan))
    state = maintain.state_of(creates.where(F.col("block_height") < cut), spends.where(F.col("spent_in_block") < cut))
    late = creates.where(F.col("block_height") >= cut), spends.where(F.col("spent_in_block") >= cut)
    for _ in range(2):
        state = maintain.apply_window(state, *late)
    name = lambda df: sorted(map(str, df.select("output_key", "spent_by_txid", "spent_in_block", "value_base").collect()))
    assert name(state) == name(whole)
    prefix = maintain.state_of(creates.where(F.col("block_height") < cut), spends.where(F.col("spent_in_block") < cut))
    assert name(maintain.rewind(whole, cut)) == name(prefix)
    assert maintain.balance_invariant(ledger.current_utxo(creates, spends), ledger.movements(creates, spends)).isEmpty()


def test_amounts(spark):
    texts = ["1", " 1.5 ", "-0.00000001", "1.123456789", "1.1234567800", "x", None, "92233720368547758.07"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r["a"], r["b"]) for r in df.select(amounts.to_base_units(F.col("t")).alias("a"), amounts.to_base_units_trunc(F.col("t")).alias("b")).collect()]
    d = Decimal
    assert got == [(d(COIN), d(COIN)), (d(150000000), d(150000000)), (d(-1), None), (None, d(112345678)), (d(112345678), d(112345678)), (None, None), (None, None), (d(9223372036854775807000000), d(9223372036854775807000000))]
    with pytest.raises(Exception, match="not an amount"):
        df.where("t = 'x'").select(amounts.to_base_units(F.col("t"), strict=True)).collect()
    shown = spark.createDataFrame([(0,), (1,), (-1,), (6250500000001,), (2**63 - 1,)], "v long").select(amounts.format_amount(F.col("v")).alias("s"))
    assert [r["s"] for r in shown.collect()] == ["0.00000000", "0.00000001", "-0.00000001", "62505.00000001", "92233720368.54775807"]
    rate = spark.createDataFrame([(1000000, 250), (5, 0), (None, 3)], "f long, s long").select(amounts.fee_rate(F.col("f"), F.col("s")).alias("r"))
    assert [r["r"] for r in rate.collect()] == [4000000, None, None]


def test_pages_and_sequences(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k long")
    assert [r["k"] for r in sequence.page(df, [F.desc("k")], 3, 2).collect()] == [7, 6, 5]
    with pytest.raises(ValueError, match="500"):
        sequence.page(df, ["k"], 501)
    keys = df.select(F.format_string("k%d", "k").alias("k"))
    first = sequence.key_page(keys, ["k"], None, 4).collect()
    assert [r["k"] for r in first] == ["k0", "k1", "k2", "k3"] and first[0]["next_key"] == "k3"
    assert sequence.key_page(keys, ["k"], ("k7",), 4).first()["next_key"] is None
    heights = spark.createDataFrame([(h,) for h in (0, 1, 2, 4, 5)], "block_height long")
    assert sequence.sync_frontier(heights, -1).first()[0] == 2 and sequence.sync_frontier(heights, 2).first()[0] == 2
    assert not sequence.contiguous_range(heights).first()["contiguous"]
    empty = heights.limit(0)
    assert sequence.sync_frontier(empty, 7).first()[0] == 7


def test_versions(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y"), ("a", 2, "z")], "k string, v long, s string")
    assert rows(versioned.latest_by(log, ["k"], [F.desc("v")]), "k", "v") == [("a", 3), ("b", 2)]
    assert rows(versioned.as_of(log, "v", 2, ["k"], [F.desc("v")]), "k", "s") == [("a", "z"), ("b", "y")]


def test_order_dependent_folds(spark):
    watches = spark.createDataFrame([(i, 1, 100 + i, 500) for i in range(6)] + [(9, 1, 600, 900), (10, 2, 100, 200)], "watch_id long, owner long, created_at long, expires_at long")
    assert {r["watch_id"]: r["accepted"] for r in mempool.accepted_watches(watches).collect()} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 9: True, 10: True}
    asked = spark.createDataFrame([(i, 1, t) for i, t in enumerate([0, 10, 20, 59, 60, 61])], "request_id long, subject long, at long")
    assert [(r["allowed"], r["remaining"]) for r in sorted(audit.replay_budget(asked, 2, 60).collect())] == [(True, 1), (True, 0), (False, 0), (False, 0), (True, 1), (True, 0)]


def test_amounts_of_numbers_and_hex(spark):
    """Values worked out from the published rules, not from the same formula."""
    df = spark.createDataFrame([(1e-8, "0x1"), (1e-7, "ff"), (0.1 + 0.2, "0x" + "0" * 50 + "1f"), (12.5, "0" * 3 + "f" * 31), (-3.0, "f" * 32), (1e-9, "0X1"), (None, "0x"), (2.0**40, "xyz"), (0.0, "-1")], "v double, h string")
    got = df.select(amounts.number_to_base_units(F.col("v")).alias("u"), amounts.hex_units(F.col("h")).alias("x")).collect()
    plain = lambda v: None if v is None else int(v)
    assert [plain(r["u"]) for r in got] == [1, 10, 30_000_000, 1_250_000_000, -300_000_000, 0, None, 2**40 * 10**8, 0]
    assert [plain(r["x"]) for r in got] == [1, 255, 31, 16**31 - 1, None, None, None, None, None]
    times = spark.createDataFrame([("12",), (" 1700000000 ",), ("1970-01-01T00:00:01.999Z",), ("2020-01-01T00:00:00+01:00",), ("x",), (None,)], "t string").select(amounts.to_seconds(F.col("t")).alias("s"))
    assert [r["s"] for r in times.collect()] == [12, 1700000000, 1, 1577833200, None, None]
    keys = spark.createDataFrame([("a:b:c",), ("a",), ("",), (":b",)], "k string").select(amounts.parse_balance_key(F.col("k")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in keys] == [("a", "b:c"), ("a", ""), ("", ""), ("", "b")]
    texts = ["http://user:pw@host/", "http://user@host", "Password=abc&x=1 TOKEN=q,z secret=", "x" * 600]
    hidden = spark.createDataFrame([(t,) for t in texts], "t string").select(amounts.redact(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in hidden] == ["http://***:***@host/", "http://user@host", "Password=*** TOKEN=*** secret=", "x" * 500]


def test_mempool_fees_by_json_kind(spark):
    """Numbers in any notation count; of a sample a fee of another kind gives way to the nested one, of an explorer entry it doesn't."""
    raw = {
        "number": '{"fee": 0.00000001, "vsize": 1000}', "power": '{"fee": 1e-7, "size": 10.0}', "true": '{"fee": true, "fees": {"base": "0.5"}, "vsize": "7"}', "null": '{"fee": null, "fees": {"base": 2}}',
        "blank": '{"fee": " ", "fees": {"base": 3, "modified": "0.1", "ancestor": 1, "descendant": 2}}', "bad": '{"fee": "x", "fees": {"base": 4}, "size": -1, "vsize": 9}', "none": "{}", "broken": "{", "precise": '{"fee": "0.000000001"}',
        "depends": json.dumps({"depends": ["a", " ", 5, "b"]}),
    }
    entries = spark.createDataFrame([(k, v) for k, v in raw.items()], "txid string, raw_json string").withColumn("fetched_at", F.timestamp_seconds(F.lit(5)))
    sampled = {r["txid"]: (r["fee_base"], r["size_bytes"], r["fee_rate"]) for r in mempool.sampled(entries).collect()}
    assert sampled == {
        "number": (1, 1000, 1), "power": (10, 10, 1000), "true": (50_000_000, None, None), "null": (200_000_000, None, None), "blank": (300_000_000, None, None), "bad": (None, 9, None), "none": (None, None, None),
        "broken": (None, None, None), "precise": (None, None, None), "depends": (None, None, None),
    }
    normal = {r["txid"]: r for r in mempool.normalized(entries).collect()}
    assert [normal[k]["fee_base"] for k in ("number", "true", "null", "blank", "bad")] == [1, None, None, None, None]
    blank = normal["blank"]
    assert (blank["modified_fee"], blank["ancestor_fee"], blank["descendant_fee"]) == (10_000_000, 100_000_000, 200_000_000)
    assert normal["depends"]["depends"] == ["a", "b"] and normal["broken"]["depends"] == []


def test_median_of_counts(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 7, 400):
        rates = [rng.choice([rng.randint(0, 50), rng.randint(0, 10**12), 65535, 65536]) for _ in range(n)]
        df = spark.createDataFrame([(r,) for r in rates] + [(None,)], "fee_rate long")
        got = mempool.fee_distribution(df).first()
        assert (got["samples"], got["median"]) == (n + 1, None if not rates else round(median(rates), 4))


def test_degraded_snapshots_match_nothing(spark):
    snaps = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "a"), (3, "d"), (4, "a"), (4, "e")]
    got = mempool.live_arrivals(spark.createDataFrame(snaps, "snapshot long, txid string"), 3)
    # 2 is degraded; 3 starts from nothing known, so a and d are new again
    assert rows(got, "snapshot", "txid") == [(1, "a"), (1, "b"), (3, "a"), (3, "d"), (4, "e")]


def test_as_of_and_strict_windows(spark):
    creates = spark.createDataFrame([("o", "t1", 1, 5, "a"), ("o", "t1", 8, 6, "a"), ("p", "t2", 2, 7, "a")], "output_key string, txid string, block_height long, value_base long, address string")
    spends = spark.createDataFrame([("o", "s1", 3, 0), ("o", "s2", 9, 0)], "spent_output_key string, spent_by_txid string, spent_in_block long, input_index long")
    keys = spark.createDataFrame([("o",), ("o",), ("x",)], "output_key string")
    at = lambda h: rows(ledger.history_as_of(creates, spends, keys, h), "output_key", "value_base", "spent_by_txid")
    assert at(0) == [] and at(2) == [("o", 5, None)] and at(5) == [("o", 5, "s1")] and at(9) == [("o", 6, "s2")]
    state = spark.createDataFrame([("o", "t1", 1, "a", 5, True, "s1", 3, 0), ("p", "t2", 2, "a", 7, True, None, None, None)], "output_key string, txid string, block_height long, address string, value_base long, is_spendable boolean, spent_by_txid string, spent_in_block long, input_index long")
    none = state.limit(0)
    spend = lambda key, by, at: spark.createDataFrame([(key, by, at, 0)], "spent_output_key string, spent_by_txid string, spent_in_block long, input_index long")
    assert maintain.apply_window_strictly(state, none, spend("p", "s3", 4)).where("spent_by_txid is null").isEmpty()
    assert maintain.apply_window_strictly(state, none, spend("o", "s1", 3)).count() == 2  # the same spend again
    with pytest.raises(ValueError, match="isn't there"):
        maintain.apply_window_strictly(state, none, spend("q", "s3", 4))
    with pytest.raises(ValueError, match="has spent"):
        maintain.apply_window_strictly(state, none, spend("o", "s3", 4))


def test_folds_across_batches(spark):
    """Owners and subjects larger than a batch are folded whole; null is one of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        n = 100
        watches = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, i, i + 20) for i in range(n)], "watch_id long, owner long, created_at long, expires_at long")
        got = {r["watch_id"]: r["accepted"] for r in mempool.accepted_watches(watches).collect()}
        live, want = {0: [], 1: [], 2: []}, {}
        for i in range(n):
            own = live[i % 3] = [e for e in live[i % 3] if e > i]
            want[i] = len(own) < 5
            if want[i]:
                own.append(i + 20)
        assert got == want and not all(want.values())
        requests = spark.createDataFrame([(i, i % 2, i) for i in range(n)], "request_id long, subject long, at long")
        found = rows(audit.replay_budget(requests, 3, 10), "request_id", "allowed", "remaining")
        state, expect = {0: (None, 0), 1: (None, 0)}, []
        for i in range(n):
            start, used = state[i % 2]
            if start is None or i >= start + 10:
                start, used = i, 0
            ok = used < 3
            used += ok
            state[i % 2] = (start, used)
            expect.append((i, ok, 3 - used))
        assert found == expect
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_single_reads(spark):
    """One argument is a table of one row."""
    blocks = spark.createDataFrame([(5, "h5", 2), (7, "abc", 1)], "block_height long, block_hash string, tx_count long")
    refs = spark.createDataFrame([("t1", 5), ("77", 5)], "txid string, block_height long")
    owners = spark.createDataFrame([("abc",), ("abc",)], "address string")
    find = lambda q: rows(explorer.search(explorer.one(spark, "text", q), refs, blocks, owners), "priority", "kind", "found", "block_height")
    assert find(" 5 ") == [(0, "block", "5", 5)] and find("77") == [] and find(" ") == [] and find("t1") == [(1, "transaction", "t1", 5)]
    assert find("abc") == [(2, "block", "abc", 7), (3, "address", "abc", None)]
    assert rows(explorer.list_blocks(blocks, 8, 2, 1), "block_height") == [(7,)] and rows(explorer.list_blocks(blocks, -1, 1, 1), "block_height") == [(5,)]
    with pytest.raises(ValueError):
        explorer.list_blocks(blocks, 8, 501, 0)
    stored = spark.createDataFrame([(5, "old", 2), (9, "h9", 3)], "block_height long, block_hash string, tx_count long")
    facts = spark.createDataFrame([(5, i, f"x{i}", 1, 1, 10, 1) for i in range(4)] + [(9, 0, "y", 1, 1, 5, None)], "block_height long, tx_index long, txid string, input_count long, output_count long, output_total long, fee_base long")
    get = lambda ref: rows(explorer.get_block(explorer.one(spark, "ref", ref), blocks, stored, facts, 2, 1), "block_hash", "total_count", "tx_index", "txid")
    assert get("5") == [("h5", 2, 1, "x1"), ("h5", 2, 2, "x2")] == get("old") and get("nothing") == []
    nested = spark.createDataFrame([(h, f"h{h}", [("t", [], [])]) for h in (3, 4, 5000)], "height long, hash string, tx array<struct<txid:string,vin:array<int>,vout:array<int>>>")
    where = lambda tail, done: rows(explorer.raw_transactions(explorer.one(spark, "txid", "t"), nested, tail, done), "block_height", "tx_index")
    assert where(4, 0) == [(4, 0)] and where(4, 4) == [] and where(5000, -1) == [(5000, 0)] and where(4999, -1) == []
