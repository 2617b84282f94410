"""Manifests, tables by key and by height: what counts, what is read, what a write that dies leaves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import derive, ledger, maintain
from ledgerloom.sources import files, heights, keyed, manifest
from test_ledger import GOLDEN, frame, rows


def test_manifests(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert manifest.current(spark, path) == (0, {})
    for n in range(1, 8):
        (tmp_path / "t" / f"f{n}").mkdir(parents=True)
        assert manifest.commit(spark, path, n - 1, {"at": n}, [f"f{n}"]) == n
    assert manifest.current(spark, path) == (7, {"at": 7})
    with pytest.raises(manifest.Conflict):  # another writer began from the same number
        manifest.commit(spark, path, 6, {"at": "other"})
    assert manifest.current(spark, path)[1] == {"at": 7}
    assert {p.name for p in (tmp_path / "t").iterdir()} == {"_manifests", "f4", "f5", "f6", "f7"}  # the rest has gone
    assert not manifest.put_new(spark, f"{path}/_manifests/000000000007.json", "x") and len([p for p in (tmp_path / "t/_manifests").iterdir() if not p.name.endswith(".crc")]) == 4
    assert manifest.read_text(spark, f"{path}/none") is None


def test_keyed_tables(spark, tmp_path):
    """200 batches: the newest row of a key counts, and a lookup opens a few files, however long the log is."""
    table = keyed.KeyedTable(f"file://{tmp_path}", "t", "k bigint, v bigint", ("k",), lambda: F.col("k"), rows_per_bucket=32)
    rng, runs, want, most, asked = random.Random(1), [], {}, 0, spark.createDataFrame([(1,), (700,), (-5,)], "k long")
    for i in range(1, 201):
        batch = {rng.randrange(1000): (rng.randrange(1000), rng.random() < 0.2) for _ in range(12)}
        for k, (v, gone) in batch.items():
            want.pop(k, None)
            if not gone:
                want[k] = v
        if i < 195:  # earlier runs are made as they would be read, not through Spark, to save time
            folder = f"t/0-{i}"
            import pyarrow as pa
            import pyarrow.parquet as pq

            (tmp_path / folder).mkdir(parents=True)
            pq.write_table(pa.table({"k": list(batch), "v": [v for v, _ in batch.values()], "_gone": [g for _, g in batch.values()]}), tmp_path / folder / "part-0.parquet")
            runs.append({"folder": folder, "number": i, "level": 0, "buckets": 1, "rows": len(batch), "filled": [0]})
        else:
            runs.append(table.write(spark.createDataFrame([(k, v, g) for k, (v, g) in batch.items()], "k long, v long, _gone boolean").coalesce(1), i))
        if i % keyed.FAN == 0:
            runs, dropped = table.compacted(spark, runs)
            assert dropped
        if i in (60, 120, 199, 200):
            most = max(most, len(table.versions(spark, runs, asked).inputFiles()))
            assert {r["k"]: r["v"] for r in table.lookup(spark, runs, asked).collect()} == {k: want[k] for k in (1, 700) if k in want}
    assert {r["k"]: r["v"] for r in table.read(spark, runs).collect()} == want
    whole = len(table.versions(spark, runs).inputFiles())
    assert most <= 3 * 4 * keyed.FAN and most < whole and max(r["buckets"] for r in runs) >= 16
    assert sum(r["rows"] for r in runs) < 0.75 * 200 * 12  # what is replaced or gone is merged away
    assert len(runs) <= 4 * (keyed.FAN - 1)


def test_lookup_of_few_keys_opens_few_files(spark, tmp_path):
    """100 keys of a table in 4096 buckets: less than a twentieth of its files."""
    table = keyed.KeyedTable(f"file://{tmp_path}", "t", "txid string, vout bigint", ("txid", "vout"), lambda: F.col("txid"), rows_per_bucket=4)
    rows_ = spark.range(16384).select(F.concat(F.lit("tx"), F.floor(F.col("id") / 2)).alias("txid"), (F.col("id") % 2).alias("vout"))
    run = table.load(rows_, 16384)
    keys = spark.range(100).select(F.concat(F.lit("tx"), F.col("id") * 37).alias("txid"))
    whole, some = table.versions(spark, [run]).inputFiles(), table.versions(spark, [run], keys).inputFiles()
    assert run["buckets"] == 4096 and len(some) < len(whole) / 20
    assert table.lookup(spark, [run], keys, ["txid"]).count() == 200  # all outputs of a transaction lie together
    assert table.lookup(spark, [run], spark.createDataFrame([("none",)], "txid string"), ["txid"]).isEmpty()


def test_tables_by_height(spark, tmp_path):
    path = f"file://{tmp_path}"
    facts = spark.range(1000).select(F.col("id").alias("h"), (F.col("id") * 2).alias("x"))
    assert len(heights.replace(spark, path, {"f": facts}, {"f": "h"}, 0, 999, 100)) == 10
    before = set(heights.read(spark, path, "f").inputFiles())
    some = facts.where("h between 250 and 349").withColumn("x", F.lit(-1).cast("long"))
    assert len(heights.replace(spark, path, {"f": some}, {"f": "h"}, 250, 349)) == 2  # the touched buckets only
    assert len(before - set(heights.read(spark, path, "f").inputFiles())) * 10 <= len(before) * 2 + 10
    got = heights.read(spark, path, "f")
    assert (got.count(), got.where("x = -1").count(), got.agg(F.sum("h")).first()[0]) == (1000, 100, 499500)
    assert len(heights.read(spark, path, "f", 250, 260).inputFiles()) < len(got.inputFiles()) / 5
    # heights outside the range, or a job that dies: the table stays
    for bad in (facts.where("h < 20"), facts.where("h < 10").withColumn("x", F.raise_error(F.lit("lost")).cast("long"))):
        with pytest.raises(Exception):
            heights.replace(spark, path, {"f": bad}, {"f": "h"}, 0, 9)
    assert heights.read(spark, path, "f").where("h < 250").agg(F.sum("x")).first()[0] == 249 * 250
    heights.replace(spark, path, {"f": facts.limit(0)}, {"f": "h"}, 900, 999)  # rows may go, too
    assert heights.read(spark, path, "f").count() == 900


def test_backfill_in_place(spark, tmp_path):
    b = frame(spark, GOLDEN)
    creates, spends = derive.derive_creates(b), derive.derive_spends(b)
    path, whole = f"file://{tmp_path}", ledger.transactions(creates, spends)
    heights.replace(spark, path, {"transactions": whole.withColumn("fee_base", F.lit(7).cast("decimal(38,0)"))}, {"transactions": "block_height"}, 0, 2, 1)
    assert len(maintain.backfill_in_place(spark, path, creates, spends, 1, 1)) == 1
    got = rows(heights.read(spark, path, "transactions"), "txid", "fee_base", "input_count")
    assert got == [("tx-0", 7, 0), ("tx-1", 100_000_000, 1), ("tx-2", 7, 1)]


def test_published_state(spark, tmp_path):
    path = f"file://{tmp_path}"
    b = frame(spark, GOLDEN)
    creates, spends, blocks = derive.derive_creates(b), derive.derive_spends(b), derive.derive_processed_blocks(b)
    files.publish_state(maintain.materialize(creates, spends, blocks, 1), path)
    with pytest.raises(Exception):  # dies in its second table
        later = maintain.materialize(creates, spends, blocks, 2)
        files.publish_state(later | {"balances": later["balances"].withColumn("balance", F.raise_error(F.lit("lost")).cast("decimal(38,0)"))}, path)
    state = files.read_published(spark, path)
    assert sorted(state) == ["applied_blocks", "balances", "utxo"] and rows(state["applied_blocks"], "block_height") == [(0,), (1,)] and rows(state["utxo"], "version") == [(1,), (1,)]
    files.publish_state(maintain.materialize(creates, spends, blocks, 2), path)
    assert rows(files.read_published(spark, path)["applied_blocks"], "block_height") == [(0,), (1,), (2,)]


def test_kept_tables_are_published_last(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "fact_folder", lambda spark: f"file://{tmp_path}")
    first = spark.range(100).toDF("x")
    (tmp_path / "facts-0" / "_temporary").mkdir(parents=True)  # a write that has only begun
    assert files.kept(spark, first, "facts", ["x"], "a").count() == 100
    with pytest.raises(Exception):
        files.kept(spark, spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("x")), "other", ["x"], "a")
    assert files.kept(spark, spark.range(7).toDF("x"), "other", ["x"], "a").count() == 7
    assert files.kept(spark, spark.range(7).toDF("x"), "facts", ["x"], "a").count() == 100  # kept
    assert files.kept(spark, spark.range(7).toDF("x"), "facts", ["x"], "b").count() == 7  # another source
