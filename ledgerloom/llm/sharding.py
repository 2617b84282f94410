"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id), so equal texts stand together. The
splitters between the shards are found by counting: each round sums the exact bytes of the rows
between candidate boundaries (64 for every splitter still open) over all partitions, and continues
inside the bin that holds the splitter's target. A splitter is settled when its bin is lighter than
``TOLERANCE`` of a shard, or holds one text only. The law says that shards are near equal: their bytes
differ from the mean by at most ``NEAR`` of it where rows allow. Equal texts stay together wherever
that law allows it, that is, where a splitter beside them misses its target by half of ``NEAR`` at
most; else they are divided at the splitter by the hash of the id, and the result says so. The driver
gets at most 64 sums for each splitter and round. Then the rows are exchanged once.

The slot is the row's number in its shard. Numbering runs over many sub-buckets of each shard, whose
sizes are counted beforehand, so that no task holds a shard.

Defined cases: null text has no bytes and counts as a text of its own; null ids are a value like
others; rows equal in text and id stay together and take their slots in any order; an empty table has no rows; other columns are
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_name, table

SHARDS = 24
#: The law: shards' bytes differ from their mean by at most this share of it, where rows allow.
NEAR = 0.02
#: Share of a shard's bytes to which a splitter's place is found.
TOLERANCE = 0.0005
ROW_BYTES = 8
BITS, RADIX = 63, 6
#: Rows of a sub-bucket that one task numbers, and the most sub-buckets of a shard.
SUB_ROWS, MOST_SUBS = 50_000, 4096
TOP = (1 << BITS) - 1


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _hash63(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def _refine(rows: DataFrame, key: str, of: Column | None, open_: dict[int, tuple], tolerance: float) -> dict[int, dict]:
    """The bin in which each open splitter ends.

    open_: splitter -> (target bytes, bytes before the interval, group). ``of``: a row's group, where
    several intervals are refined side by side. Returns splitter -> bin: lo, hi, below, bytes, single.
    """
    done: dict[int, dict] = {}
    state = {s: {"target": t, "below": below, "group": g, "prefix": 0} for s, (t, below, g) in open_.items()}
    shift = BITS
    while state:
        nxt = max(0, shift - RADIX)
        group = of if of is not None else F.lit(0).cast("long")
        pairs = sorted({(x["group"], x["prefix"]) for x in state.values()})
        here = F.lit(False)
        for g, prefix in pairs:
            here = here | ((group == F.lit(g).cast("long")) & (F.shiftright(F.col(key), shift) == F.lit(prefix).cast("long")) if shift < BITS else (group == F.lit(g).cast("long")))
        bins = rows.where(here).groupBy(group.alias("g"), F.shiftright(F.col(key), nxt).alias("bin")).agg(F.sum("size").alias("bytes"), F.min(key).alias("least"), F.max(key).alias("most")).collect()
        for s, x in list(state.items()):
            own = sorted((b for b in bins if b["g"] == x["group"] and (shift == BITS or b["bin"] >> (shift - nxt) == x["prefix"])), key=lambda b: b["bin"])
            below = x["below"]
            for b in own:
                if below + b["bytes"] >= x["target"] or b is own[-1]:
                    break
                below += b["bytes"]
            single = b["least"] == b["most"]
            if single or b["bytes"] <= tolerance or nxt == 0:
                lo, hi = (b["least"], b["most"] + 1) if single else (b["bin"] << nxt, (b["bin"] + 1) << nxt)
                done[s] = {"lo": lo, "hi": hi, "below": below, "bytes": b["bytes"], "single": single, "target": x["target"]}
                del state[s]
            else:
                x |= {"below": below, "prefix": b["bin"]}
        shift = nxt
    return done


def _nearer(b: dict) -> int:
    return b["lo"] if b["target"] - b["below"] <= b["below"] + b["bytes"] - b["target"] else b["hi"]


def _missed(b: dict) -> float:
    """By how many bytes the nearer side of a bin misses the target."""
    return min(b["target"] - b["below"], b["below"] + b["bytes"] - b["target"])


def splitters(rows: DataFrame, n: int, tolerance: float = TOLERANCE, near: float = NEAR) -> list[tuple[int, int]]:
    """n - 1 boundaries (u, v): the rows at or after the i-th belong to shard i + 1 or a later one.

    rows: u and v (63-bit keys), size.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return [(TOP, TOP)] * (n - 1)
    shard = total / n
    first = _refine(rows, "u", None, {i: (total * i / n, 0, 0) for i in range(1, n)}, shard * tolerance)
    heavy = {i: (b["target"], b["below"], b["lo"]) for i, b in first.items() if b["single"] and _missed(b) > shard * near / 2}
    second = _refine(rows.where(F.col("u").isin(*{g for *_, g in heavy.values()})), "v", F.col("u"), heavy, shard * tolerance) if heavy else {}
    out = []
    for i, b in first.items():
        at = (first[i]["lo"], _nearer(second[i])) if i in second else (_nearer(b), 0)
        out.append((min(at[0], TOP), min(at[1], TOP)))
    return sorted(out)


def shard_by_bytes(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard``, ``slot`` (numbered from 0 in each shard) and ``divided`` (equal texts lie in several shards); their columns of that name are replaced."""
    docs = docs.drop("shard", "slot", "divided")
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    u, v = _hash63(text, text.isNull()), _hash63(ident, ident.isNull())
    rows = cut(docs.select(u.alias("u"), v.alias("v"), row_size(text).alias("size")))
    cuts = splitters(rows, n)

    def shard(a: Column, b: Column) -> Column:
        at = F.lit(0)
        for x, y in cuts:
            at = at + ((a > x) | ((a == x) & (b >= y))).cast("int")
        return at

    count = rows.count()
    subs = min(MOST_SUBS, max(1, -(-count // (n * SUB_ROWS))))
    place = lambda a, b: F.struct(shard(a, b).alias("shard"), F.pmod(F.xxhash64(a, b), F.lit(subs)).cast("int").alias("sub"))
    filled = rows.groupBy(place(F.col("u"), F.col("v")).alias("p")).count()
    before = Window.partitionBy("p.shard").orderBy("p.sub").rowsBetween(Window.unboundedPreceding, -1)
    names = {x: free_name(docs, x) for x in ("u", "v", "p", "before", "nth")}
    starts = filled.select(F.col("p").alias(names["p"]), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(names["before"]))
    keyed = docs.withColumns({names["u"]: u, names["v"]: v})
    keyed = keyed.withColumn(names["p"], place(F.col(names["u"]), F.col(names["v"])))
    order = Window.partitionBy(names["p"]).orderBy(names["u"], names["v"])
    numbered = keyed.withColumn(names["nth"], F.row_number().over(order) - 1)
    # at most n * MOST_SUBS rows of offsets
    out = numbered.join(F.broadcast(starts), names["p"], "left")
    inside = [x for x, y in cuts if y > 0]
    divided = F.col(names["u"]).isin(*inside) if inside else F.lit(False)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{names['p']}.shard").alias("shard"), (F.col(names["nth"]) + F.col(names["before"])).cast("long").alias("slot"), divided.alias("divided"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = F.coalesce("text", F.lit(""))
    placed = shard_by_bytes(docs.select("doc_id", "text", row_size(F.col("text")).alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "divided")
