"""The blocks format: files outside the heights asked for aren't opened."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import block_source, raw_blocks
from test_sources import COIN, encoded_block


@pytest.fixture
def stored(spark, tmp_path):
    block_source.register(spark)
    for h in range(40):
        data = encoded_block([COIN] * (h % 3 + 1)).hex()
        if h % 2:
            (tmp_path / f"{h}.hex").write_text(data + "\n")
        else:
            (tmp_path / f"{h}.hex.gz").write_bytes(gzip.compress(data.encode()))
    (tmp_path / "notes.txt").write_text("no block")
    return tmp_path


def test_only_heights_asked_for_are_opened(spark, stored):
    for h in (*range(1, 10, 2), *range(21, 40, 2)):  # to open one of these is an error
        (stored / f"{h}.hex").write_bytes(b"\xff\xfe")
    read = lambda **options: spark.read.format("blocks").options(**options).load(str(stored))
    some = read(low=10, high=19, per_partition=4)
    assert [r["height"] for r in some.orderBy("height").collect()] == list(range(10, 20)) and some.rdd.getNumPartitions() == 3
    assert some.where("height = 12").count() == 1 and some.count() == 10 and read(low=77).isEmpty() and read(low=12, high=11).isEmpty()
    for bad in (read(), read(low=8), read(high=1)):
        with pytest.raises(Exception):
            bad.collect()
    decoded = raw_blocks.decode_blocks(some, strict=True)
    assert {(r["height"], r["n"]) for r in decoded.select("height", F.col("block.nTx").alias("n")).collect()} == {(h, h % 3 + 1) for h in range(10, 20)}


def test_stream_of_blocks(spark, stored, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    for more in (0, 5):
        for h in range(40, 40 + more):
            (stored / f"{h}.hex").write_text("00")
        stream = spark.readStream.format("blocks").load(str(stored)).select("height")
        stream.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").trigger(once=True).start().awaitTermination()
        assert sorted(r["height"] for r in spark.read.parquet(f"{out}/t").collect()) == list(range(40 + more))
