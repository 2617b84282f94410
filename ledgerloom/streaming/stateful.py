"""Streams that keep state by key: folds in time order, sessions of watches.

Built on state processors with RocksDB's state store (:func:`use_rocksdb`), timers in event time and
typed state. The batch forms are in ``operators.mempool`` and ``operators.audit``; a stream gives their
rows once the watermark has passed them. Handlers finish before they return: a generator would touch
its state only after Spark has gone on to the next key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import mempool

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Timers are set to whole seconds, so that a busy key has few.
GRID_MS = 1000


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need this store; it is chosen when a query first starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ms(at: pd.Series) -> list[int]:
    return ((at - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)).tolist()


class OrderedFold(StatefulProcessor):
    """Folds each key's rows in order of time and id, once the watermark has passed their time.

    Until then they wait in state, so a key holds the rows of the watermark's delay and the fold's own
    few values. ``fold`` takes these values (None at first), the time in ms, the id and the row's other
    values (which are never null), and gives the new ones and an output row, which follows the key, or
    None. What wasn't touched for ``forget_ms`` of
    event time goes.
    """

    def __init__(self, values: str, carried: str, out: list[str], fold: Callable, forget_ms: int):
        self.values, self.carried, self.out, self.fold, self.forget_ms = values, carried, out, fold, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, id bigint", self.values)
        self.now = handle.getValueState("now", f"last bigint, {self.carried}")

    def _timer(self, ms: int) -> None:
        self.handle.registerTimer((ms // GRID_MS + 1) * GRID_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for df in rows:
            own = df.drop(columns=["key", "at", "id"])
            for at, number, *values in zip(_ms(df["at"]), df["id"].tolist(), *(own[c].tolist() for c in own), strict=True):
                self.waiting.updateValue((at, number), tuple(values))
                timers.add(at // GRID_MS)
        for t in timers:
            self._timer(t * GRID_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k, v) for k, v in self.waiting.iterator() if k[0] < due)
        now = self.now.get() if self.now.exists() else None
        if not ready:
            if now is not None and now[0] + self.forget_ms <= due:
                self.now.clear()
            return iter(())
        carried, out, last = None if now is None else tuple(now[1:]), [], ready[-1][0][0]
        for (at, number), values in ready:
            carried, row = self.fold(carried, at, number, values)
            if row is not None:
                out.append((key[0], *row))
            self.waiting.removeKey((at, number))
        self.now.update((last, *carried))
        self._timer(last + self.forget_ms)
        return iter([pd.DataFrame(out, columns=["key", *self.out])] if out else ())


def _folded(rows: DataFrame, delay: str, out: str, processor: OrderedFold) -> DataFrame:
    """``rows``: key, at, id and the fold's values."""
    return rows.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(processor, out, "append", "eventTime")


def accepted_watches(watches: DataFrame, most: int = mempool.MOST_WATCHES, delay: str = "1 minute", forget_s: int = 40 * 86400) -> DataFrame:
    """``operators.mempool.accepted_watches`` of a stream (watch_id, owner, created_at, expires_at in seconds).

    State of an owner without new watches goes after ``forget_s``, which must be longer than a watch lives.
    """

    def fold(live, at, watch, values):
        created, expires = values
        alive = [e for e in (live[0] if live else []) if e > created]
        accepted = len(alive) < most
        return ([*alive, expires] if accepted else alive,), (watch, accepted)

    rows = watches.select(F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("key"), F.timestamp_seconds("created_at").alias("at"), F.col("watch_id").alias("id"), "created_at", "expires_at")
    fold_ = OrderedFold("created bigint, expires bigint", "live array<bigint>", ["watch_id", "accepted"], fold, forget_s * 1000)
    return _folded(rows, delay, "key string, watch_id long, accepted boolean", fold_).select("watch_id", F.col("key").try_cast("long").alias("owner"), "accepted")


def replayed_budgets(requests: DataFrame, most: int = 300, seconds: int = 60, delay: str = "10 seconds") -> DataFrame:
    """``operators.audit.replay_budget`` of a stream (request_id, subject, at in seconds)."""

    def fold(window, at, request, values):
        (second,) = values
        start, used = window or (second, 0)
        if second >= start + seconds:
            start, used = second, 0
        allowed = used < most
        used += allowed
        return (start, used), (request, allowed, most - used)

    rows = requests.select(F.coalesce(F.col("subject").cast("string"), F.lit("")).alias("key"), F.timestamp_seconds("at").alias("at"), F.col("request_id").alias("id"), F.col("at").alias("second"))
    fold_ = OrderedFold("second bigint", "start bigint, used bigint", ["request_id", "allowed", "remaining"], fold, seconds * 1000)
    return _folded(rows, delay, "key string, request_id long, allowed boolean, remaining long", fold_).select("request_id", F.col("key").try_cast("long").alias("subject"), "allowed", "remaining")


def live_arrivals(snapshots: DataFrame, most: int = mempool.OVERFLOW, step_s: int = 3600, delay: str = "1 minute") -> DataFrame:
    """``operators.mempool.live_arrivals`` of a stream of snapshots (snapshot, at, txids: array of different ids).

    A snapshot of more than ``most`` ids matches nothing and isn't remembered, so what it would have
    hidden is new in the next. An id is forgotten when the next snapshot, ``step_s`` later, must have come.
    """

    def fold(last, at, snapshot, values):
        return (snapshot,), None if last and last[0] == snapshot - 1 else (snapshot,)

    sound = snapshots.where(F.size("txids") <= most)
    rows = sound.select("at", F.col("snapshot").alias("id"), F.explode("txids").alias("txid")).select(F.col("txid").cast("string").alias("key"), "at", "id", F.lit(0).cast("long").alias("none"))
    fold_ = OrderedFold("none bigint", "snapshot bigint", ["snapshot"], fold, 2 * step_s * 1000)
    return _folded(rows, delay, "key string, snapshot long", fold_).select("snapshot", F.col("key").cast(snapshots.schema["txids"].dataType.elementType).alias("txid"))


def _outcome(watch, outcome: str, txid: str | None, ms: int) -> Iterator[pd.DataFrame]:
    return iter([pd.DataFrame([(watch, outcome, txid, pd.Timestamp(ms, unit="ms"))], columns=["watch_id", "outcome", "txid", "ended_at"])])


class Session(StatefulProcessor):
    """A watch: when it was opened, whether it is closed, and matches that came before its opening.

    Of these one is kept for each millisecond from the watermark on, as an opening from before is late.
    """

    def __init__(self, length_ms: int):
        self.length = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.watch = handle.getValueState("watch", "opened bigint, closed boolean")
        self.early = handle.getMapState("early", "at bigint", "txid string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.watch.get() if self.watch.exists() else None
        opened, closed = had or (None, False)
        matches: dict[int, str] = {}
        before = opened
        for df in rows:
            if closed:
                continue
            for kind, txid, at in zip(df["kind"], df["txid"], _ms(df["at"]), strict=True):
                if kind == "open":
                    opened = at if opened is None else min(opened, at)
                else:
                    matches[at] = min(matches.get(at, txid), txid)
        if closed or (opened is None and not matches):
            return iter(())
        if opened is None:
            for at, txid in matches.items():
                old = self.early.getValue((at,)) if self.early.containsKey((at,)) else None
                self.early.updateValue((at,), (txid if old is None else min(old[0], txid),))
            for second in {at // GRID_MS for at in matches}:
                self.handle.registerTimer((second + 1) * GRID_MS)
            return iter(())
        if before is None:  # what waited for the opening
            for (at,), (txid,) in self.early.iterator():
                matches[at] = min(matches.get(at, txid), txid)
            self.early.clear()
        if opened != before:
            self.handle.registerTimer(opened + self.length)
        hits = [(at, txid) for at, txid in matches.items() if opened <= at < opened + self.length]
        self.watch.update((opened, bool(hits)))
        return _outcome(key[0], "appeared", *reversed(min(hits))) if hits else iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not self.watch.exists():
            for (at,), _ in list(self.early.iterator()):
                if at < due:
                    self.early.removeKey((at,))
            return iter(())
        opened, closed = self.watch.get()
        if due < opened + self.length:
            return iter(())
        self.watch.clear()
        return iter(()) if closed else _outcome(key[0], "timeout", None, opened + self.length)


def sessions(events: DataFrame, seconds: int = mempool.SESSION_S, delay: str = "10 seconds") -> DataFrame:
    """One outcome per watch from a stream of events (watch_id, kind, txid, at).

    ``kind`` is "open" or "match". The first match within the session closes it; else a timeout comes
    once the watermark has passed its end. A closed watch is remembered, and its events are ignored,
    until the watermark is past its session.
    """
    keyed = events.withWatermark("at", delay).groupBy("watch_id")
    return keyed.transformWithStateInPandas(Session(seconds * 1000), "watch_id long, outcome string, txid string, ended_at timestamp", "append", "eventTime")
