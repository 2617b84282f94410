"""Streams with state by key give their batch forms' rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, mempool
from ledgerloom.streaming import stateful


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)


def streamed(spark, path, parts, schema, build, read=None):
    """What a stream gives that gets its rows in parts, one batch each."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        build(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect())


def mixed(rng, rows, at, parts=3):
    """Rows in parts that follow each other, out of order inside a part."""
    rows = sorted(rows, key=lambda r: r[at])
    step = -(-len(rows) // parts)
    out = [rows[i : i + step] for i in range(0, len(rows), step)]
    for part in out:
        rng.shuffle(part)
    return out


def test_accepted_watches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), t := 1 + rng.randrange(3000), t + rng.randrange(1, 900)) for i in range(90)]
    schema = "watch_id long, owner long, created_at long, expires_at long"
    want = sorted(tuple(r) for r in mempool.accepted_watches(spark.createDataFrame(rows, schema), 3).collect() if r["owner"] is not None)
    got = streamed(spark, tmp_path, [*mixed(rng, rows, 2), [(999, 77, 10**6, 10**6 + 1)], [(1000, 77, 10**6 + 9, 10**6 + 10)]], schema, lambda s: stateful.accepted_watches(s, 3).where("owner is not null"))
    assert [r for r in got if r[1] != 77] == want and {r[2] for r in want} == {True, False}


def test_replayed_budgets(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 2]), 1 + rng.randrange(400)) for i in range(120)]
    schema = "request_id long, subject long, at long"
    want = sorted(tuple(r) for r in audit.replay_budget(spark.createDataFrame(rows, schema), 5, 60).collect())
    got = streamed(spark, tmp_path, [*mixed(rng, rows, 2), [(999, 77, 10**6)], [(1000, 77, 10**6 + 9)]], schema, lambda s: stateful.replayed_budgets(s, 5, 60))
    assert [r for r in got if r[1] != 77] == want and {r[2] for r in want} == {True, False}


def test_live_arrivals(spark, tmp_path):
    """A snapshot with too many ids matches nothing and clears what was known."""
    sets = {0: [1, 2], 1: [2, 3], 2: list(range(20)), 3: [2, 3, 4], 4: [4], 6: [4, 1], 7: [4]}
    rows = [(s, s * 3600 + 1, ids) for s, ids in sets.items()]
    flat = spark.createDataFrame([(s, i) for s, _, ids in rows for i in ids], "snapshot long, txid long")
    want = sorted(tuple(r) for r in mempool.live_arrivals(flat, 10).collect())
    parts = [[rows[1], rows[0]], rows[2:4], rows[4:], [(900, 900 * 3600, [77])], [(901, 901 * 3600, [77])]]
    build = lambda s: stateful.live_arrivals(s.withColumn("at", F.timestamp_seconds("at")), 10)
    got = streamed(spark, tmp_path, parts, "snapshot long, at long, txids array<long>", build)
    assert [r for r in got if r[1] != 77] == want and (3, 2) in want and (1, 2) not in want


#: A stream begins with a watermark at 1970, so what lies there is late.
EPOCH = 1_780_000_000


def session_outcomes(spark, path, parts):
    build = lambda s: stateful.sessions(s.withColumn("at", F.timestamp_millis("at")), 300).select("watch_id", "outcome", "txid")
    return streamed(spark, path, [[(w, k, t, int((EPOCH + at) * 1000)) for w, k, t, at in part] for part in parts], "watch_id long, kind string, txid string, at long", build)


def test_sessions(spark, tmp_path):
    parts = [[(1, "open", None, 0), (2, "open", None, 0), (3, "open", None, 0)], [(1, "match", "x", 60), (1, "match", "w", 120), (3, "match", "late", 360)], [(9, "open", None, 1800)], [(1, "match", "again", 1860), (9, "match", "y", 1860)]]
    assert session_outcomes(spark, tmp_path, parts) == [(1, "appeared", "x"), (2, "timeout", None), (3, "timeout", None), (9, "appeared", "y")]


def test_sessions_wait_and_end(spark, tmp_path):
    """A match that comes before its opening counts, and a closed or unopened watch leaves no state."""
    parts = [
        [(1, "match", "x", 5), (2, "match", "before", 1), (5, "open", None, 0)], [(1, "open", None, 2), (2, "open", None, 4)], [(2, "match", "y", 30), (1, "open", None, 26), (3, "match", "never opened", 40)],
        [(5, "match", "z", 60)], [(9, "open", None, 2400)], [(9, "match", "w", 2460), (8, "open", None, 3540)],
    ]
    assert session_outcomes(spark, tmp_path, parts) == [(1, "appeared", "x"), (2, "appeared", "y"), (5, "appeared", "z"), (9, "appeared", "w")]
    left = lambda name: {r[0] for r in spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/check").select("key.watch_id").collect()}
    assert left("watch") <= {8, 9} and left("early") == set()


def test_hot_watch_holds_one_match_a_millisecond(spark, tmp_path):
    parts = [[(1, "match", f"t{i:05d}", 1 + i % 5 / 1000) for i in range(3000)]]
    assert session_outcomes(spark, tmp_path, parts) == []
    kept = spark.read.format("statestore").option("stateVarName", "early").load(f"{tmp_path}/check")
    assert kept.count() <= 5
    assert session_outcomes(spark, tmp_path, [[(1, "open", None, 1.002)]]) == [(1, "appeared", "t00002")]
