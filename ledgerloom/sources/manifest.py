"""Which files of a stored table count: numbered manifests, the highest one is the table.

A write puts its files into a new folder and then commits a manifest that names it, so readers see
all of a write or nothing, and a writer that dies leaves what was there. A manifest is written aside
and renamed to its number without overwriting, which file systems with atomic renames (HDFS, local
disks) let one writer do; another one that began from the same number gets an error. Folders that a
commit no longer names stay for ``GRACE`` further commits, as readers of older manifests may be at work.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

GRACE = 3


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def stamp(spark: SparkSession, path: str) -> str:
    """What tells a file or folder from its later state: path, size, time of its last change."""
    status = _fs(spark, path).getFileStatus(_path(spark, path))
    return f"{status.getPath()}:{status.getLen()}:{status.getModificationTime()}"


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None where there is none."""
    if not exists(spark, path):
        return None
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file all at once, unless it is there already; was it written?"""
    aside = f"{path}.{uuid.uuid4().hex}"
    stream = _fs(spark, path).create(_path(spark, aside), False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, aside), _path(spark, path), none)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
            raise
        remove(spark, aside)
        return False


def _numbers(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, f"{path}/_manifests"):
        return []
    names = [s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, f"{path}/_manifests"))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _file(path: str, number: int) -> str:
    return f"{path}/_manifests/{number:012d}.json"


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; (0, {}) where nothing was committed."""
    numbers = _numbers(spark, path)
    return (numbers[-1], json.loads(read_text(spark, _file(path, numbers[-1])))["content"]) if numbers else (0, {})


def commit(spark: SparkSession, path: str, after: int, content: dict, dropped: list[str] = ()) -> int:
    """Make ``content`` the table that follows manifest ``after``; folders of ``dropped`` go some commits later."""
    number, old = after + 1, []
    if after:
        old = json.loads(read_text(spark, _file(path, after)))["dropped"]
    due = [d for d in old if d[0] + GRACE < number]
    waiting = [d for d in old if d[0] + GRACE >= number] + [[number, p] for p in dropped]
    if not put_new(spark, _file(path, number), json.dumps({"content": content, "dropped": waiting})):
        raise Conflict(f"manifest {number} of {path} is there already")
    for _, p in due:
        remove(spark, f"{path}/{p}")
    for n in _numbers(spark, path):
        if n + GRACE < number:
            remove(spark, _file(path, n))
    return number
