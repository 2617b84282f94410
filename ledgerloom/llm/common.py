"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of the six ASCII white-space characters, as a Java regular expression.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a local session gets a new one, and a cluster an error."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not have:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        have = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(have)
    return have.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Spark's cleaner removes the files when the frame is no longer used, if the cluster asks for that.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as compressed Parquet under the shared folder; what was written, and its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed Parquet under the shared folder and read it back; for wide rows."""
    return stored_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove what :func:`stored_at` wrote, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def tidied(batches):
    """Pass a task's batches on, with :func:`tidy` before and after."""
    tidy()
    try:
        yield from batches
    finally:
        tidy()


#: Rows and bytes that one call of an annotating function gets at most (a longer single text is a call of its own).
CALL_ROWS, CALL_BYTES = 1000, 2 << 20


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def annotate(docs: DataFrame, text_col: str, make: Callable[[], Callable], out: T.StructType, name: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column ``name`` computed from each text (or list of numbers), without a shuffle.

    ``make`` runs once per task and gives a function from a list of values (None for null) to a list
    of rows or an Arrow struct array. Only the columns of ``keep`` (default: all) are sent back.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    keep = list(docs.columns) if keep is None else keep
    cols = list(dict.fromkeys([*keep, text_col]))
    at, kind = cols.index(text_col), to_arrow_type(out)

    def run(batches):
        yield from tidied(annotated(batches))

    def annotated(batches):
        fn = make()
        for batch in batches:
            column = batch.column(at)
            listed = pa.types.is_list(column.type)
            sizes = [(n or 0) * (8 if listed else 1) for n in (pc.list_value_length if listed else pc.binary_length)(column).to_pylist()]
            i = 0
            while i < len(sizes):
                j, total = i + 1, sizes[i]
                while j < len(sizes) and j - i < CALL_ROWS and total + sizes[j] <= CALL_BYTES:
                    total += sizes[j]
                    j += 1
                got = fn(column.slice(i, j - i).to_pylist())
                got = got.cast(kind) if isinstance(got, pa.Array) else pa.array(got, kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(cols.index(k)).slice(i, j - i) for k in keep), got], names=[*keep, name])
                i = j

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(name, out, True)])
    return docs.select(*cols).mapInArrow(run, schema)


#: Bits of the bitmap of :func:`maybe_in`, and of one of its rows.
MAP_BITS, MAP_ROW = 1 << 26, 1 << 15


def marked(df: DataFrame, key: Column, members: DataFrame, member_key: str, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: may the key be among the members? False is certain.

    A bitmap of hashed keys of fixed size (8 MB, whatever the number of members) is broadcast, so
    that wide rows need no shuffle to be told apart; where it says true, an exact join must follow.
    """
    row, bits = free_name(df, "bitmap_row"), free_name(df, "bitmap_bits")
    spot = F.pmod(F.xxhash64(F.col(member_key)), F.lit(MAP_BITS))
    rows = members.select(spot.alias("s")).groupBy(F.floor(F.col("s") / MAP_ROW).cast("int").alias(row)).agg(F.bitmap_construct_agg(F.col("s") % MAP_ROW).alias(bits))
    own = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    byte = F.conv(F.hex(F.substring(F.col(bits), ((own % MAP_ROW) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), (own % 8).cast("int"))).cast("int") % 2 == 1
    joined = df.join(F.broadcast(rows), F.floor(own / MAP_ROW).cast("int") == F.col(row), "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(row, bits)


def maybe_in(df: DataFrame, key: Column, members: DataFrame, member_key: str) -> DataFrame:
    """The rows of ``df`` whose key may be among the members; never drops one that is."""
    name = free_name(df, "maybe")
    return marked(df, key, members, member_key, name).where(name).drop(name)
