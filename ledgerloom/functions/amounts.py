"""Amounts: integer base units (10^8 to a coin), decimal texts, fee rules. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 8
AMOUNT = "decimal(38,0)"


def total(value: Column) -> Column:
    """Exact sum of base units."""
    return F.sum(value.cast("decimal(20,0)")).cast(AMOUNT)


def total_if(condition: Column, value: Column) -> Column:
    return total(F.when(condition, value).otherwise(F.lit(0)))


def format_amount(value: Column) -> Column:
    """Base units as a decimal text with eight places; exact for all 64-bit values."""
    return (value.cast("decimal(20,0)") / F.lit(100000000).cast("decimal(9,0)")).cast("decimal(28,8)").cast("string")


def _units(text: Column, whole: Column, places: Column) -> Column:
    digits = F.concat(whole, F.rpad(F.substring(places, 1, DIGITS), DIGITS, "0"))
    return F.when(text.startswith("-"), -digits.cast(AMOUNT)).otherwise(digits.cast(AMOUNT))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def to_base_units(text: Column, strict: bool = False) -> Column:
    """A decimal text in base units. More than eight places are allowed only if the rest are zeros.

    Anything else is null, or an error if ``strict``.
    """
    t = _trimmed(text)
    good = t.rlike(r"^-?[0-9]+(\.[0-9]{1,8}0*)?$")
    units = _units(t, F.regexp_extract(t, r"^-?([0-9]+)", 1), F.regexp_extract(t, r"\.([0-9]+)$", 1))
    bad = F.raise_error(F.concat(F.lit("not an amount: "), F.coalesce(text, F.lit("null")))).cast(AMOUNT) if strict else F.lit(None).cast(AMOUNT)
    return F.when(good, units).otherwise(F.when(text.isNotNull(), bad))


def number_to_base_units(value: Column, strict: bool = False) -> Column:
    """A number in base units: brought to eight fixed places first, so that 1e-8 is one unit."""
    return to_base_units(value.cast("double").cast("decimal(38,8)").cast("string"), strict)


def json_part(record: Column, path: str) -> Column:
    """A part of a parsed JSON record, null where it isn't there (a JSON null is a value of its own)."""
    return F.try_variant_get(record, path, "variant")


def json_kind(part: Column) -> Column:
    """"number", "text" or "other"; null where the part isn't there."""
    kind = F.schema_of_variant(part)
    return F.when(kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(kind == "STRING", "text").when(kind.isNotNull(), "other")


def json_units(part: Column) -> Column:
    """A JSON number or text in base units; anything else is null."""
    kind = json_kind(part)
    number = number_to_base_units(F.when(kind == "number", F.try_variant_get(part, "$", "double")))
    return F.when(kind == "number", number).when(kind == "text", to_base_units(F.try_variant_get(part, "$", "string")))


def json_count(part: Column) -> Column:
    """A JSON number that is an integer of 0 or more; anything else is null."""
    value = F.when(json_kind(part) == "number", F.try_variant_get(part, "$", "double"))
    return F.when((value >= 0) & (value == F.floor(value)), F.try_variant_get(part, "$", "decimal(38,0)").try_cast("long"))


def to_base_units_trunc(text: Column) -> Column:
    """A decimal text without sign in base units; places beyond eight are cut off."""
    t = _trimmed(text)
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), _units(t, F.regexp_extract(t, r"^([0-9]+)", 1), F.regexp_extract(t, r"\.([0-9]+)$", 1)))


def hex_units(text: Column) -> Column:
    """A hexadecimal text (with or without 0x) as an unsigned integer; null if it isn't one or has more than 31 digits (2^124)."""
    digits = F.regexp_extract(_trimmed(text), r"^(?:0x)?0*([0-9a-fA-F]*)$", 1)
    good = _trimmed(text).rlike(r"^(0x)?[0-9a-fA-F]+$") & (F.length(digits) < 32)
    wide = F.lpad(digits, 32, "0")
    half = lambda at: F.conv(F.substring(wide, at, 16), 16, 10).cast("decimal(20,0)")
    units = F.when(F.length(digits) < 32, (half(1).cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast(AMOUNT) + half(17))
    return F.when(good, units.cast(AMOUNT))


def fee_rate(fee: Column, size: Column) -> Column:
    """Base units per 1000 bytes, cut to a whole number; null without a size."""
    rate = fee.cast("decimal(20,0)") * 1000 / size.cast("decimal(20,0)")
    return F.when(size > 0, F.when(rate < 0, F.ceil(rate)).otherwise(F.floor(rate)).cast("long"))


def fee(coinbase: Column, inputs: Column, outputs: Column) -> Column:
    """Inputs less outputs, which may be negative; null for coinbase or unresolved inputs."""
    return F.when(~coinbase & (inputs != 0), (inputs - outputs).cast(AMOUNT))


def redact(text: Column) -> Column:
    """Without credentials in urls and name=value pairs (in either case), and at most 500 characters."""
    # fixed values: patterns, replacements and length are what results must follow
    hidden = F.regexp_replace(text, r"://[^/@\s]+:[^/@\s]+@", "://***:***@")
    hidden = F.regexp_replace(hidden, r"(?i)(password|token|secret)=\S+", "$1=***")
    return F.left(hidden, F.lit(500))


def to_seconds(text: Column) -> Column:
    """Unix seconds of a text of seconds or of an ISO time, rounded down; null if it is neither."""
    t = _trimmed(text)
    return F.when(t.rlike(r"^[0-9]+$"), t.try_cast("long")).otherwise(F.floor(F.unix_micros(F.try_to_timestamp(t)) / 1_000_000).cast("long"))


def fingerprint(text: Column) -> Column:
    """What a query's text is known by."""
    return F.sha2(text.cast("binary"), 256)


# --- keys ---


def block_identity(height: Column, block_hash: Column) -> Column:
    return F.concat(height.cast("string"), F.lit(":"), block_hash)


def balance_key(address: Column, asset: Column) -> Column:
    return F.concat(address, F.lit(":"), asset)


def parse_balance_key(key: Column) -> Column:
    """address and asset_address; all after the first colon is the asset."""
    at = F.instr(key, ":")
    return F.struct(F.when(at > 0, F.substring(key, F.lit(1), at - 1)).otherwise(key).alias("address"), F.when(at > 0, F.substring(key, at + 1, F.length(key))).otherwise("").alias("asset_address"))


def txid_of(output_key: Column) -> Column:
    """The transaction of an output key."""
    return F.substring_index(output_key, ":", 1)
