"""Every registered ledger query against its SQL on the smallest tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans.oracle import ORACLE_SQL
from ledgerloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral() else float(value)
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def guarded(spark, sql, start=0, end=5, limit=10):
    from ledgerloom.plans.analytics import guarded_query

    views = {
        "transactions": spark.createDataFrame([(f"t{i}", i, i, 10 * i) for i in range(10)], "txid string, block_height long, block_time long, fee_base long"),
        "balances": spark.createDataFrame([("a", 1)], "address string, balance long"),
        "mempool_samples": spark.sql("select timestamp_seconds(3) as sampled_at, 'x' as txid"),
    }
    return guarded_query(spark, sql, views, start, end, 3, limit)


def test_guarded_rows(spark):
    import hashlib

    found = guarded(spark, "select txid, fee_base from transactions where block_time >= :from_time order by txid;", "1970-01-01T00:00:01Z", "5")
    assert [tuple(r) for r in found.rows.collect()] == [("t1", 10), ("t2", 20), ("t3", 30)]
    assert found.columns == [("txid", "string"), ("fee_base", "bigint")] and (found.start, found.end, found.finalized) == ("1970-01-01T00:00:01Z", "1970-01-01T00:00:05Z", 3)
    assert found.hash == hashlib.sha256(b"select txid, fee_base from transactions where block_time >= :from_time order by txid").hexdigest()
    joined = guarded(spark, "with m as (select max(balance) as b from balances) select txid, 'drop table; -- x' as note from transactions join m on b = 1 -- a comment", limit=2).rows
    assert joined.count() == 2 and guarded(spark, "select txid from mempool_samples").rows.count() == 1
    assert guarded(spark, "select count(*) as n, sum(fee_base * 2) as f from transactions").rows.first()["n"] == 4


def test_guards(spark, tmp_path):
    spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/secret")
    spark.range(3).createOrReplaceTempView("outside")
    bad = [
        (f"select count(*) from parquet.`{tmp_path}/secret`",), (f'select count(*) from parquet."{tmp_path}/secret"',), ("drop table x",), ("select 1; select 2",), ("select * from transactions",), ("select txid, t.* from transactions t",),
        ("with a as (select 1 as x) insert into transactions select x from a",), ("select id from outside",), ("select x from global_temp.y",), ("select x from spark_catalog.default.y",), ("select id from nowhere",), ("",), ("select txid from transactions " + " " * 9000 + "where 1 = 1",),
        ("select 1 as x", 10, 5), ("select 1 as x", 0, 8 * 86400), ("select 1 as x", 0, 5, 0), ("select 1 as x", 0, 5, 1001), ("select 1 as x", "no time", 5),
    ]
    for args in bad:
        with pytest.raises(Exception):
            guarded(spark, *args).rows.collect()


def test_guard_by_plan(spark):
    """What the text looks like doesn't count, only what Spark reads in it."""
    from ledgerloom.plans.guard import Refused

    spark.range(3).write.mode("overwrite").saveAsTable("private_t")
    from_views = "from transactions"
    try:
        for sql in [
            "select count(1) as n -- c\r from private_t", "select count(1) as n from private_t", "select id from `private_t`", "select id from default.private_t", "select id from identifier('private_t')", "select id from identifier('private' || '_t')", "table private_t",
            f"select reflect('java.lang.System','getProperty','user.home') {from_views}", f"select java_method('java.lang.System','getenv','PATH') as p {from_views}", f"select system.builtin.reflect('a','b') {from_views}", f"select `reflect`('java.lang.System','getProperty','user.home') {from_views}",
            "select id from range(1000)", "select t.id from transactions, range(100) t", "select col from explode(array(1, 2))", f"select explode(sequence(1, 100000)) as x {from_views}", "select x from transactions lateral view explode(array(1)) as x", "select 1 as x", "values (1)", "select col1 from values (1)",
            f"select * {from_views}", f"select t.* {from_views} t", f"select struct(*) {from_views}", f"select count(txid), (select max(id) from private_t) as m {from_views}", f"select txid {from_views} where exists (select 1 from private_t)", f"select txid {from_views} where block_time in (select id from private_t)",
            # a name that is a common table expression elsewhere only
            "select a.x, b.id from (with private_t as (select 1 as x from transactions) select x from private_t) a, private_t b", "with transactions as (select 1 as x) select x from transactions", "with recursive r(n) as (select 1 union all select n + 1 from r) select n from r, transactions",
            f"select txid {from_views} tablesample (1 percent)", f"select /*+ broadcast(t) */ txid {from_views} t", f"select current_user {from_views}", f"select current_user() as u {from_views}", f"select input_file_name() as f {from_views}", f"select repeat(txid, 100000000) as r {from_views}", f"select transform(array(1), x -> x) as r {from_views}", f"select rand() as r {from_views}",
            "insert into private_t select 1", "create view v as select 1", "set x = 1", "from transactions insert into private_t select block_height", "explain select txid from transactions", "select txid from transactions; select 1", "select txid from (describe transactions)", "cache table transactions", f"select txid {from_views} union all select string(id) from private_t",
            f"select sum(block_height) over w as s {from_views} window w as (partition by reflect('a', 'b'))", f"select txid {from_views} order by reflect('a', 'b')", f"select txid {from_views} group by txid having reflect('a', 'b') = 'c'",
        ]:
            with pytest.raises(Refused):
                guarded(spark, sql)
                print("not refused:", sql)
    finally:
        spark.sql("drop table private_t")


def test_guard_lets_pass(spark):
    for sql, n in [
        ("select count(*) as n from transactions -- c\r where 1 = 0", 1), ("select 'from private_t; drop table x -- *' as `a;b`, txid from transactions /* * */", 4), ("with a as (select txid, fee_base from transactions), b as (select max(fee_base) as m from a) select a.txid from a join b on a.fee_base = b.m", 1),
        ("select txid, row_number() over (partition by block_height order by fee_base desc rows between unbounded preceding and current row) as r, sum(fee_base) over w as s from transactions window w as (order by block_height)", 4),
        ("select case when fee_base > 10 then 'high' else 'low' end as kind, avg(fee_base) as a, count(distinct txid) as c, count_if(fee_base > 1) filter (where block_height > 0) as f from transactions group by 1 having count(*) > 0 order by a desc limit 1 offset 1", 1),
        ("select txid from transactions where block_height between 0 and 1 and txid like 't%' and block_time is not null union select address from balances where exists (select 1 from transactions) and address in (select address from balances)", 3),
        ("select date_trunc('hour', timestamp_seconds(block_time)) as h, percentile_approx(fee_base, 0.5) as p, round(sum(fee_base) / count(*), 2) as q, cast(max(block_time) as string) as m from transactions where block_time >= :from_time and block_height <= :finalized group by all", 1), ("select (select max(balance) from balances) as b, extract(hour from sampled_at) as h from mempool_samples", 1),
    ]:
        assert len(guarded(spark, sql).rows.collect()) == n, sql
