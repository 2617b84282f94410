"""Guarded SQL over curated views: the user's text sees finalized rows of a bounded window only."""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .guard import Refused, check_analyzed, check_parsed

MOST_ROWS, DEFAULT_ROWS, MOST_S, MOST_CHARACTERS = 1000, 100, 7 * 86400, 8000
VIEWS = ("transactions", "balances", "mempool_samples")


#: The columns that each view shows.
SHOWN = {
    "transactions": ["txid", "block_height", "block_time", "tx_index", "is_coinbase", "input_count", "output_count", "input_total", "output_total", "fee_base"],
    "balances": ["address", "balance"],
    "mempool_samples": ["sampled_at", "txid", "entry_time", "size_bytes", "fee_base", "fee_rate"],
}


def view(name: str, source: DataFrame) -> DataFrame:
    """One view; the others' sources aren't touched."""
    return source.select(*SHOWN[name])


def curated(transactions: DataFrame, balances: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
    """All views."""
    return {name: view(name, df) for name, df in zip(VIEWS, (transactions, balances, samples), strict=True)}


@dataclass(frozen=True)
class Guarded:
    """A guarded query's rows and what is said of them."""

    rows: DataFrame
    columns: list[tuple[str, str]]
    hash: str
    start: str
    end: str
    finalized: int


def seconds_of(value: int | str, field: str) -> int:
    """Unix seconds of a number, a text of figures, or an ISO time (UTC where it names no zone)."""
    text = str(value).strip()
    if re.fullmatch(r"[0-9]+", text):
        return int(text)
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{field} is no time: {value}") from None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() // 1)


def time_window(start: int | str, end: int | str) -> tuple[int, int]:
    lo, hi = seconds_of(start, "start"), seconds_of(end, "end")
    if not 0 < hi - lo <= MOST_S:
        raise ValueError("the window is 1 second to 7 days")
    return lo, hi


def checked_sql(spark: SparkSession, sql: str) -> str:
    """The text of one SELECT over the curated views without the semicolons at its end; ``guard.Refused`` for anything else."""
    text = re.sub(r"(;\s*)+$", "", sql.strip())
    if not text or len(text) > MOST_CHARACTERS:
        raise Refused(f"a query has 1 to {MOST_CHARACTERS} characters")
    check_parsed(spark, text, set(VIEWS))
    return text


def guarded_query(spark: SparkSession, sql: str, views: dict[str, DataFrame], start: int | str, end: int | str, finalized: int, limit: int = DEFAULT_ROWS) -> Guarded:
    """A SELECT over the curated views, [start, end), blocks up to ``finalized``, ``limit`` rows at most.

    The text's plan is checked (:mod:`guard`) as parsed and as analyzed. It runs in a session of its
    own, whose views are cut before it sees them, in which files can't be read as tables; as a
    subquery, so that it can't be a command. It may use ``:from_time``, ``:to_time`` and ``:finalized``.
    """
    lo, hi = time_window(start, end)
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"the limit is 1 to {MOST_ROWS}")
    text = checked_sql(spark, sql)
    own = {
        "transactions": views["transactions"].where((F.col("block_time") >= lo) & (F.col("block_time") < hi) & (F.col("block_height") <= finalized)),
        "balances": views["balances"],
        "mempool_samples": views["mempool_samples"].where((F.col("sampled_at") >= F.timestamp_seconds(F.lit(lo))) & (F.col("sampled_at") < F.timestamp_seconds(F.lit(hi)))),
    }
    session, shared = spark.newSession(), f"guarded_{uuid.uuid4().hex}_"
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for name, df in own.items():
        df.createGlobalTempView(shared + name)
        session.sql(f"create temporary view {name} as select * from global_temp.{shared}{name}")
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        rows = session.sql(f"select * from (\n{text}\n) limit {int(limit)}", args={"from_time": lo, "to_time": hi, "finalized": finalized})
        check_analyzed(rows, set(own))
        columns = rows.dtypes
    finally:
        for name in own:
            spark.catalog.dropGlobalTempView(shared + name)
    iso = lambda s: datetime.fromtimestamp(s, timezone.utc).isoformat().replace("+00:00", "Z")
    return Guarded(rows, columns, hashlib.sha256(text.encode()).hexdigest(), iso(lo), iso(hi), finalized)
