"""Functions for SQL by name: what Spark's own functions can't express, as Arrow-batched UDFs, and the rest as they are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.raw_blocks import key_address, script_kind


@F.pandas_udf(StringType())
def script_type(scripts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The kind of an output script (binary)."""
    for batch in scripts:
        yield batch.map(lambda s: None if s is None else script_kind(bytes(s))["type"])


@F.pandas_udf(StringType())
def p2pkh_address(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The address that pays to the hash of a public key (binary)."""
    for batch in keys:
        yield batch.map(lambda k: None if k is None else key_address(bytes(k)))


@F.pandas_udf(StringType())
def hex_units(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A hexadecimal text of any length as a decimal text; null if it isn't one."""

    def units(text: str | None) -> str | None:
        digits = (text or "").strip().removeprefix("0x")
        return str(int(digits, 16)) if digits and all(c in "0123456789abcdefABCDEF" for c in digits) else None

    for batch in texts:
        yield batch.map(units)


def register(spark: SparkSession) -> None:
    """Make them known to SQL under their names."""
    for function in (script_type, p2pkh_address, hex_units):
        spark.udf.register(function.__name__, function)
