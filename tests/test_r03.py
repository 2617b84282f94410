"""Faults found in round 3, each on a small input."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.plans.registry import QUERIES
from ledgerloom.plans.tables import Ledger
from ledgerloom.sources.keyed import KeyedTable

DATA = "/root/testdata/sf0.001"


def test_pro_rata_rounds_down(spark):
    """A share just below a whole number isn't rounded up first (F1)."""
    inputs = spark.createDataFrame([("g", "a", 1, 4_000_000), ("g", "b", 4_000_000, 4_000_000), ("h", "a", 10**17, 10**17), ("h", "b", 10**17 + 1, 10**17)], "`group` string, address string, weight long, target long")
    got = {(r["group"], r["address"]): int(r["allocated"]) for r in ledger.pro_rata(inputs, "target").collect()}
    assert got == {("g", "a"): 0, ("g", "b"): 4_000_000, ("h", "a"): 10**34 // (2 * 10**17 + 1), ("h", "b"): 10**17 - 10**34 // (2 * 10**17 + 1)}


def plan_of(spark, df):
    """The physical plan of ``df`` where no table is small enough to be broadcast."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no driver tables here")
def test_lines_are_shuffled_once(spark):
    """Facts: lines travel by their order alone, as numbers; spends come from the kept outputs."""
    x = Ledger(spark, DATA)
    plan = plan_of(spark, x.latest)
    assert "hashpartitioning(output_key" not in plan and plan.count("hashpartitioning(l_orderkey") == 1
    widest = max((line for line in plan.splitlines() if "Exchange" in line), key=len)
    assert "block_hash" not in widest and plan.count("Exchange") <= 7
    assert "lineitem.parquet" not in plan_of(spark, x.spends)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no driver tables here")
def test_a_view_reads_its_own_source(spark, tmp_path):
    """The mempool's view needs no orders."""
    (tmp_path / "events.parquet").symlink_to(f"{DATA}/events.parquet")
    assert QUERIES["curated_mempool"](spark, str(tmp_path)).count() == spark.read.parquet(f"{DATA}/events.parquet").count()


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no driver tables here")
def test_blocks_are_nested_in_one_shuffle(spark):
    """Rows of a block go to its partition at once, with no join by transaction or output before."""
    x = Ledger(spark, DATA)
    for df in (x.nested, x.wire):
        plan = plan_of(spark, df)
        assert plan.count("hashpartitioning(block_height") == 1
        assert not any(f"hashpartitioning({c}" in plan for c in ("txid", "output_key", "spent_output_key", "spent_by_txid"))
    assert plan_of(spark, QUERIES["tx_refs_latest"](spark, DATA)).count("hashpartitioning(block_height") == 1


def test_filters_of_the_key_only(spark, tmp_path):
    """A table by key has no Bloom filters of a megabyte for each column (F8)."""
    rows = spark.range(100).selectExpr("cast(id as string) as output_key", "id as a", "cast(id as string) as b", "id * 2 as c")
    table = KeyedTable(f"file://{tmp_path}", "outputs", "output_key string, a bigint, b string, c bigint", ("output_key",), lambda: F.col("output_key"))
    run = table.load(rows, 100)
    files = list(tmp_path.rglob("*.parquet"))
    assert files and sum(f.stat().st_size for f in files) < 200_000 * len(files)
    assert table.lookup(spark, [run], rows.where("a < 3").select("output_key")).count() == 3


def test_large_batches_are_written_once(spark, tmp_path, monkeypatch):
    """A batch of many outputs goes to its buckets at once, with no run before them; with the map of keys as with the keys themselves."""
    from functools import partial

    from ledgerloom.operators import derive
    from ledgerloom.streaming import blocks as block_stream
    from test_ledger import GOLDEN, block, frame, rows

    monkeypatch.setattr(block_stream, "KeyedTable", partial(KeyedTable, rows_per_bucket=2))
    fork = [block(2, [("tx-9", [("tx-1", 1)], [("other", 58), ("more", 1)])], "x"), block(3, [("tx-10", [("tx-9", 0)], [("last", 57)])], "x")]
    whole = frame(spark, [*GOLDEN[:2], *fork])
    creates, spends = derive.derive_creates(whole), derive.derive_spends(whole)
    for most in (0, 1 << 20):
        monkeypatch.setattr(block_stream, "MOST_SENT", most)
        out = f"{tmp_path}/{most}"
        for i, part in enumerate((GOLDEN, fork)):
            block_stream.apply_batch(frame(spark, part), i, out)
        assert list((tmp_path / str(most) / "outputs").glob("1-*")) and not list((tmp_path / str(most) / "outputs").glob("0-*"))
        for name, of, key in (("creates", creates, "output_key"), ("spends", spends, "spent_output_key")):
            columns = sorted(of.columns)
            assert rows(block_stream.read_table(spark, out, name), key, *columns) == rows(of, key, *columns)
        held = rows(ledger.balances(ledger.current_utxo(creates, spends)), "address", "balance")
        assert rows(block_stream.balances(spark, out), "address", "balance") == held
        # a reorganization that goes back to before the fork finds what it touched
        block_stream.apply_batch(frame(spark, [block(2, [("tx-11", [("tx-1", 1)], [("new", 58)])], "y")]), 2, out)
        assert {r["output_key"] for r in block_stream.state(spark, out).where("block_height >= 2").collect()} == {"tx-11:0"}


def test_large_run_above_small_ones(spark, tmp_path):
    """Small runs that are older than one that went to a higher level at once don't hide its rows."""
    table = KeyedTable(f"file://{tmp_path}", "t", "k bigint, v bigint", ("k",), lambda: F.col("k"), rows_per_bucket=4)
    put = lambda n, rows: table.put(spark.createDataFrame([(k, n, False) for k in rows], "k long, v long, _gone boolean"), n, len(rows))
    runs = []
    for n, keys in enumerate(([1, 2], [2, 3], range(20), [3], [4], [5], [6]), 1):
        runs, _ = table.compacted(spark, [*runs, put(n, keys)])
    want = {k: 3 for k in range(20)} | {3: 4, 4: 5, 5: 6, 6: 7}
    assert {r["k"]: r["v"] for r in table.read(spark, runs).collect()} == want


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no driver tables here")
def test_facts_carry_their_spend(spark, tmp_path):
    """Unspent outputs, movements and transaction facts join no outputs with spends by their keys."""
    x = Ledger(spark, DATA)
    for df in (x.utxo, x.movements, x.transactions, QUERIES["address_summary"](spark, DATA), QUERIES["materialized_utxo"](spark, DATA)):
        plan = plan_of(spark, df)
        assert "hashpartitioning(output_key" not in plan and "hashpartitioning(spent_output_key" not in plan
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(x.utxo, ledger.current_utxo(x.creates, x.spends)) and same(x.transactions, ledger.transactions(x.creates, x.spends))
    assert same(x.movements, ledger.movements(x.creates, x.spends))


def test_stores_dealt_in_another_way_are_refused(spark, tmp_path):
    """A store of blocks whose buckets mean something else isn't read as if they didn't."""
    from ledgerloom.sources import manifest
    from ledgerloom.streaming import blocks as block_stream
    from test_ledger import GOLDEN, frame

    path = f"file://{tmp_path}/old"
    (tmp_path / "old").mkdir()
    manifest.commit(spark, path, 0, {"runs": {}, "tail": -1, "batches": {"": 0}})
    for use in (lambda: block_stream.state(spark, path), lambda: block_stream.apply_batch(frame(spark, GOLDEN), 1, path)):
        with pytest.raises(ValueError, match="made anew"):
            use()
