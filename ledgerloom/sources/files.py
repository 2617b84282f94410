"""Snapshots, mempool files and fact tables on any file system that Spark reaches."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derive import block_schema
from . import manifest

MEMPOOL = "fetched_at timestamp, entries map<string,string>"
#: Fact tables in the order in which a window is written: a window counts once its blocks are there.
TABLES = ["creates", "spends", "movements", "transactions", "processed_blocks"]


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Nested blocks from JSON files (gzip too); a corrupt document is an error."""
    return spark.read.schema(block_schema()).option("mode", "FAILFAST").json(path)


def write_snapshots(blocks: DataFrame, path: str, per_bucket: int = 10_000) -> None:
    """Nested blocks as gzip JSON, in folders of ``per_bucket`` heights."""
    bucket = F.floor(F.col("height") / per_bucket).alias("height_bucket")
    blocks.withColumn("height_bucket", bucket).write.mode("append").partitionBy("height_bucket").option("compression", "gzip").json(path)


def mempool_entries(snapshots: DataFrame) -> DataFrame:
    """Snapshots (fetched_at, entries) to a row per entry with its raw JSON."""
    return snapshots.select("fetched_at", F.explode("entries").alias("txid", "raw_json"))


def read_mempool_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return mempool_entries(spark.read.schema(MEMPOOL).json(path))


def append_facts(tables: dict[str, DataFrame], path: str, window: str) -> None:
    """Append a window's facts; processed blocks last, as the record that the window is complete.

    ``window`` names it (its first and last height, say): each table gets a folder of that name, which
    a repeated attempt overwrites, so that a window written twice counts once.
    """
    for name in TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/window_id={window}")


def read_facts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A fact table without the rows of windows that were never completed."""
    text = lambda df: df.withColumn("window_id", F.col("window_id").cast("string"))
    done = text(spark.read.parquet(f"{path}/processed_blocks")).select("window_id").distinct()
    return text(spark.read.parquet(f"{path}/{name}")).join(done, "window_id", "left_semi").drop("window_id")


def fact_folder(spark: SparkSession) -> str | None:
    """Where a session keeps the facts that it derives: in the shared checkpoint folder.

    Where none is set, a local session uses a temporary folder, and a cluster keeps no facts.
    """
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not have and not re.match(r"local(\[|$)", spark.sparkContext.master):
        return None
    return f"{have.rstrip('/') if have else _local_folder()}/facts-{spark.sparkContext.applicationId}"


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ledgerloom-")


def kept(spark: SparkSession, df: DataFrame, name: str, order: list[str], stamp: str = "", within: Sequence[str] = (), shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` as a table that the session keeps, written once and in order, so that reads skip what they don't ask for.

    The rows go to a new folder; a file that names it is put in place last and only once. So a table
    that is still being written, or whose writer died, isn't read, and of two writers one counts.
    ``stamp`` tells the source from its later state: another stamp is another table. Rows of one range
    are sorted by ``within`` too; ``shape`` makes the table's columns of the rows once they are in order, so
    that what can be derived isn't shuffled and sorted.
    """
    folder = fact_folder(spark)
    if folder is None:
        return shape(df)
    pointer = f"{folder}/{name}-{hashlib.sha256(stamp.encode()).hexdigest()[:16]}.current"
    if (path := manifest.read_text(spark, pointer)) is None:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        shape(df.repartitionByRange(*order).sortWithinPartitions(*order, *within)).write.option("compression", "zstd").parquet(path)
        if not manifest.put_new(spark, pointer, path):
            manifest.remove(spark, path)
            path = manifest.read_text(spark, pointer)
    return spark.read.schema(shape(df).schema).parquet(path)


def publish_state(tables: dict[str, DataFrame], path: str) -> None:
    """Put state tables in the place of those under ``path``, all at once; a writer that dies leaves the old ones."""
    spark = next(iter(tables.values())).sparkSession
    number, content = manifest.current(spark, path)
    known, dropped = dict(content.get("state", {})), []
    for name, df in tables.items():
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{path}/{folder}")
        dropped += [known[name]["folder"]] if name in known else []
        known[name] = {"folder": folder, "schema": df._jdf.schema().toDDL()}
    manifest.commit(spark, path, number, content | {"state": known}, dropped)


def read_published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of :func:`publish_state`, all of one commit."""
    state = manifest.current(spark, path)[1].get("state", {})
    return {name: spark.read.schema(of["schema"]).parquet(f"{path}/{of['folder']}") for name, of in state.items()}


#: State tables of a snapshot.
STATE = ["utxo", "balances", "applied_blocks"]


def replace_state(tables: dict[str, DataFrame], path: str) -> None:
    """Write state tables anew (imports and compactions)."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in STATE}


def import_state(spark: SparkSession, snapshot: str, path: str) -> None:
    """Replace the state under ``path`` by the one of a snapshot, which must have all its tables."""
    replace_state(read_state(spark, snapshot), path)
