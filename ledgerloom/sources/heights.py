"""Tables in buckets of heights, of which a write replaces those that it touches, all at once.

Each bucket's rows lie in a folder that the manifest names. A write of a range of heights makes the
touched buckets anew (rows of theirs outside the range are copied), in a folder of its own, and then
commits: until then, and if it dies before, readers see what was there. Reads of a range of heights
open the folders of its buckets only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest

PER_BUCKET, BUCKET = 10_000, "_bucket"


def _of(content: dict, name: str) -> dict[int, str]:
    return {int(b): folder for b, folder in content.get("tables", {}).get(name, {}).get("buckets", {}).items()}


def _open(spark: SparkSession, path: str, schema: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, name: str, low: int | None = None, high: int | None = None, content: dict | None = None) -> DataFrame:
    """The rows of a table with heights from ``low`` to ``high``, both included."""
    content = manifest.current(spark, path)[1] if content is None else content
    about = content["tables"][name]
    own = {b: f for b, f in _of(content, name).items() if (low is None or b >= low // about["per_bucket"]) and (high is None or b <= high // about["per_bucket"])}
    rows = _open(spark, path, about["schema"], [own[b] for b in sorted(own)])
    h = F.col(about["height"])
    rows = rows if low is None else rows.where(h >= low)
    return rows if high is None else rows.where(h <= high)


def replace(spark: SparkSession, path: str, tables: dict[str, DataFrame], height: dict[str, str], low: int, high: int, per_bucket: int = PER_BUCKET) -> list[str]:
    """Put rows in the place of all with heights from ``low`` to ``high`` in these tables, in one commit; the folders written.

    ``height`` names each table's column of heights; its rows outside the range are an error. A table
    keeps the schema and bucket size that it began with.
    """
    number, content = manifest.current(spark, path)
    known, written, dropped = dict(content.get("tables", {})), [], []
    for name, df in tables.items():
        about = known.get(name, {"schema": df._jdf.schema().toDDL(), "height": height[name], "per_bucket": per_bucket, "buckets": {}})
        size, h, buckets = about["per_bucket"], F.col(about["height"]), _of(content, name)
        outside = F.when(h.isNull() | (h < low) | (h > high), F.raise_error(F.lit(f"{name}: a height outside {low} to {high}")).cast("boolean")).otherwise(F.lit(True))
        rows = df.where(outside)
        touched = [b for b in buckets if low // size <= b <= high // size]
        edges = [b for b in touched if b * size < low or (b + 1) * size - 1 > high]
        if edges:
            kept = _open(spark, path, about["schema"], [buckets[b] for b in edges]).where((h < low) | (h > high))
            rows = rows.select(*kept.columns).unionByName(kept)
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, F.floor(h / size).cast("int")).repartition(BUCKET, F.col(about["height"])).sortWithinPartitions(BUCKET, about["height"]).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{path}/{folder}")
        fs = manifest._fs(spark, path)
        made = [s.getPath().getName() for s in fs.listStatus(manifest._path(spark, f"{path}/{folder}")) if s.isDirectory()]
        fresh = {int(n.removeprefix(f"{BUCKET}=")): f"{folder}/{n}" for n in made if n.startswith(f"{BUCKET}=")}
        dropped += [buckets[b] for b in touched]
        known[name] = about | {"buckets": {str(b): f for b, f in sorted(({b: f for b, f in buckets.items() if b not in touched} | fresh).items())}}
        written += sorted(fresh.values())
    manifest.commit(spark, path, number, content | {"tables": known}, dropped)
    return written
