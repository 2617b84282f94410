"""Tables by key that grow by batches and are read by key, not whole.

A table is a list of runs. A batch adds a small run of its rows; of a key the row of the newest run
counts, and one that is marked gone hides it. As soon as ``FAN`` runs of a level are there they are
merged into one of the next level, so each row is rewritten about once for each level and a reader
meets at most ``FAN - 1`` runs of each; a batch of more rows than a bucket should have is merged, or put into
buckets, at once. Merged runs are dealt into buckets by a hash of the key, or of
what its keys share (the transaction of an output key, a range of heights), and sorted in the bucket,
with Parquet's Bloom filters on the key. Numbers of buckets are powers of two, so the buckets that a
list of keys asks for are found once and folded for smaller runs. More than ``MOST_LISTED`` buckets
are not listed: the run is then read whole.

Runs are plain dictionaries for a manifest (:mod:`manifest`); nothing counts before it is committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.versioned import latest_by
from . import manifest

FAN, MOST_LISTED, MOST_BUCKETS = 4, 4096, 1 << 20
GONE, RUN, BUCKET = "_gone", "_run", "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """A table under ``path``/``name``: ``columns`` (a schema in DDL) by ``key``.

    ``place`` gives what rows of one bucket share, from the key's columns.
    """

    path: str
    name: str
    columns: str
    key: tuple[str, ...]
    place: Callable[[], Column]
    rows_per_bucket: int = 1 << 18

    @property
    def _schema(self) -> str:
        return f"{self.columns}, {GONE} boolean"

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.place()), F.lit(n)).cast("int")

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.columns)

    def _read(self, spark: SparkSession, run: dict, buckets: set[int] | None) -> DataFrame:
        base = f"{self.path}/{run['folder']}"
        if run["buckets"] == 1 or buckets is None:
            df = spark.read.schema(self._schema).option("recursiveFileLookup", True).parquet(base)
        else:
            wanted = sorted({b % run["buckets"] for b in buckets} & set(run["filled"]))
            if not wanted:
                return spark.createDataFrame([], self._schema).withColumn(RUN, F.lit(run["number"]))
            df = spark.read.schema(self._schema).parquet(*(f"{base}/{BUCKET}={b}" for b in wanted))
        return df.withColumn(RUN, F.lit(run["number"]))

    def buckets_of(self, runs: list[dict], keys: DataFrame) -> set[int] | None:
        """The buckets, of the run with most, that hold ``keys`` (the columns of ``place``); None for too many to list."""
        most = max((r["buckets"] for r in runs), default=1)
        if most == 1:
            return {0}
        found = keys.select(self._bucket(most).alias("b")).distinct().limit(MOST_LISTED + 1).collect()
        return None if len(found) > MOST_LISTED else {r["b"] for r in found}

    def versions(self, spark: SparkSession, runs: list[dict], keys: DataFrame | None = None) -> DataFrame:
        """Rows of all runs that may hold ``keys``, with the number of their run."""
        buckets = None if keys is None else self.buckets_of(runs, keys)
        parts = [self._read(spark, run, buckets) for run in runs]
        if not parts:
            return spark.createDataFrame([], self._schema).withColumn(RUN, F.lit(0))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _newest(self, versions: DataFrame) -> DataFrame:
        return latest_by(versions, list(self.key), [F.desc(RUN)])

    def read(self, spark: SparkSession, runs: list[dict]) -> DataFrame:
        """The table."""
        rows = self.versions(spark, runs)
        return (rows if len(runs) < 2 else self._newest(rows)).where(f"not {GONE}").drop(GONE, RUN)

    def lookup(self, spark: SparkSession, runs: list[dict], keys: DataFrame, on: list[str] | None = None) -> DataFrame:
        """The rows whose columns ``on`` (default: the key) are among ``keys``; ``place`` must follow from them."""
        on = list(self.key) if on is None else on
        some = self.versions(spark, runs, keys).join(keys.select(*on).distinct(), on, "left_semi")
        return (some if len(runs) < 2 else self._newest(some)).where(f"not {GONE}").drop(GONE, RUN)

    def placed(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Rows with their bucket, those of a key (and of a bucket, where there are more) in one partition: what is grouped by both is written without another shuffle."""
        return rows.withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET) if buckets > 1 else rows.withColumn(BUCKET, F.lit(0)).repartition(*self.key)

    def put(self, rows: DataFrame, number: int, n_rows: int, also: str = "") -> dict:
        """Write a batch's rows as a run: in buckets at once if they are more than a bucket should have."""
        buckets = self.buckets_for(n_rows)
        return self.write(rows, number, int(buckets > 1), buckets, also)

    def written(self, spark: SparkSession, run: dict, also: str) -> DataFrame:
        """A run that was just written, with its further columns."""
        return spark.read.schema(f"{self._schema}, {also}").option("recursiveFileLookup", True).parquet(f"{self.path}/{run['folder']}")

    def write(self, rows: DataFrame, number: int, level: int = 0, buckets: int = 1, also: str = "") -> dict:
        """Write rows (the columns, and whether the key is gone) as a run; rows that are :meth:`placed` stay where they are.

        ``also``: further columns (in DDL) for who reads the run at once (:meth:`written`); others don't see them.
        """
        folder, spark = f"{self.name}/{level}-{number}-{uuid.uuid4().hex}", rows.sparkSession
        columns = [f.name for f in self.empty(spark).schema]
        more = [f.name for f in T._parse_datatype_string(also)] if also else []
        out = rows.select(*columns, GONE, *more, *([BUCKET] if BUCKET in rows.columns else []))
        how = {"compression": "zstd"}
        if level:  # filters of the key only, as large as its values ask for
            how |= {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.key}
        if buckets > 1:
            out = out if BUCKET in out.columns else self.placed(out, buckets)
            out.sortWithinPartitions(BUCKET, *self.key).write.options(**how).partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            names = [s.getPath().getName() for s in manifest._fs(spark, self.path).listStatus(manifest._path(spark, f"{self.path}/{folder}"))]
            filled = [int(n.removeprefix(f"{BUCKET}=")) for n in names if n.startswith(f"{BUCKET}=")]
        else:
            out.drop(BUCKET).sortWithinPartitions(*self.key).write.options(**how).parquet(f"{self.path}/{folder}")
            filled = [0]
        n = spark.read.schema(self._schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{folder}").count()  # from the files' footers
        return {"folder": folder, "number": number, "level": level, "buckets": buckets, "rows": n, "filled": sorted(filled)}

    def buckets_for(self, rows: int) -> int:
        """A power of two."""
        return min(MOST_BUCKETS, 1 << max(0, (max(1, rows) - 1) // self.rows_per_bucket).bit_length())

    def compacted(self, spark: SparkSession, runs: list[dict]) -> tuple[list[dict], list[str]]:
        """Merge levels that are full; the runs that are left, oldest first, and folders that no longer count."""
        runs, dropped, level = sorted(runs, key=lambda r: r["number"]), [], 0
        while level <= max((r["level"] for r in runs), default=-1):
            own = [r for r in runs if r["level"] == level]
            newer = max((r["number"] for r in runs if r["level"] > level), default=0)
            # a batch went to a higher level at once: what is older than it is merged for itself, as its rows would else hide newer ones
            passed = [r for r in own if r["number"] < newer]
            own = passed or own
            if passed or len(own) >= FAN or level == 0 and any(r["rows"] > self.rows_per_bucket for r in own):
                merged = self._newest(self.versions(spark, own))
                if own[0] is runs[0]:  # nothing older is left for a gone key to hide
                    merged = merged.where(f"not {GONE}")
                run = self.write(merged, own[-1]["number"], level + 1, self.buckets_for(sum(r["rows"] for r in own)))
                runs = sorted([r for r in runs if r not in own] + [run], key=lambda r: r["number"])
                dropped += [r["folder"] for r in own]
            if not passed:
                level += 1
        return runs, dropped

    def load(self, rows: DataFrame, n_rows: int) -> dict:
        """A whole table as one run in buckets; ``n_rows``: about how many rows it has."""
        return self.write(rows.withColumn(GONE, F.lit(False)), 0, 1, self.buckets_for(n_rows))
