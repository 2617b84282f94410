"""Faults found in round 4, each on a small input."""

from __future__ import annotations

from ledgerloom.plans.registry import QUERIES
from test_ledger import rows


def test_address_summary_is_whole(spark, tmp_path):
    """Balance and unspent outputs of each address too, next to its history; zeros where all is spent (F1)."""
    orders = [(1, 7, "2020-01-01"), (2, 7, "2020-01-02"), (3, 8, "2020-01-02")]
    lines = [
        # returned lines of an order are spent by its customer's next one, if there is one; open lines have no address
        (1, 1, 5, 1, 10.00, "R", "F"), (1, 1, 5, 2, 20.00, "A", "F"), (1, 1, 6, 3, 40.00, "R", "F"), (1, 1, 6, 4, 80.00, "N", "O"),
        (2, 1, 5, 1, 1.60, "N", "F"), (2, 1, 9, 2, 3.20, "R", "F"), (3, 1, 9, 1, 6.40, "A", "F"),
    ]
    day = "cast({} as timestamp)".format
    made = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, at string").selectExpr("o_orderkey", "o_custkey", f"{day('at')} as o_orderdate")
    sold = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string")
    made.write.parquet(f"{tmp_path}/orders.parquet")
    sold.selectExpr("*", "timestamp '2020-02-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(QUERIES["address_summary"](spark, str(tmp_path)), "address", "balance", "received", "sent", "tx_count", "utxo_count")
    assert got == [("S5", 2160, 3160, 1000, 2, 2), ("S6", 0, 4000, 4000, 2, 0), ("S9", 960, 960, 0, 2, 2)]
