"""``spark.read.format("blocks")``: stored wire blocks by height, and the stream of those that come.

Files are named <height>.hex, or <height>.hex.gz, under one path on any file system that Arrow reaches.
A partition holds a range of heights. The options ``low`` and ``high`` bound the heights (both
included), so files of other heights are never opened. (They are options and not pushed-down conditions:
Spark keeps what one query pushes down for later queries of the same frame, which would lose rows.) As
a stream, a batch holds the heights that have come since the
last; a block that is stored again under its old name isn't seen again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "height bigint, hex string"
#: Blocks of a partition.
PER_PARTITION = 500
_NAME = re.compile(r"^([0-9]+)\.hex(\.gz)?$")


def _listed(path: str) -> tuple[object, dict[int, str]]:
    """The file system and the file of each height."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = {}
    for info in where.get_file_info(fs.FileSelector(root)):
        if info.is_file and (m := _NAME.match(info.base_name)):
            found[int(m[1])] = info.path
    return where, found


def _ranges(files: dict[int, str], size: int) -> list[InputPartition]:
    heights = sorted(files)
    return [InputPartition([(h, files[h]) for h in heights[i : i + size]]) for i in range(0, len(heights), size)]


def _blocks(path: str, files: list[tuple[int, str]]) -> Iterator[tuple]:
    from pyarrow import fs

    where = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
    for height, name in files:
        with where.open_input_stream(name, compression="gzip" if name.endswith(".gz") else None) as file:
            yield height, file.read().decode("ascii").strip()


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int, low: int, high: int | None):
        self.path, self.size, self.low, self.high = path, size, low, high

    def partitions(self) -> list[InputPartition]:
        files = {h: f for h, f in _listed(self.path)[1].items() if h >= self.low and (self.high is None or h <= self.high)}
        return _ranges(files, self.size) or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _blocks(self.path, partition.value)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"height": -1}

    def latestOffset(self) -> dict:
        return {"height": max(_listed(self.path)[1], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges({h: f for h, f in _listed(self.path)[1].items() if start["height"] < h <= end["height"]}, self.size)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _blocks(self.path, partition.value)


class BlockSource(DataSource):
    """Options: ``path``; ``low``, ``high``: the heights to read; ``per_partition``: blocks of a partition."""

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("per_partition", PER_PARTITION))

    def reader(self, schema) -> DataSourceReader:
        high = self.options.get("high")
        return _Reader(*self._options(), int(self.options.get("low", 0)), None if high is None else int(high))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._options())


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(BlockSource)
