"""Mempool snapshots and watches, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import fee_rate, json_count, json_kind, json_part, json_units, total

RETENTION_S, SESSION_S, OVERFLOW, MOST_WATCHES = 3600, 300, 100_000, 5


def first_count(record: Column, *names: str) -> Column:
    """The first of the fields that is an integer of 0 or more."""
    return F.coalesce(*[json_count(json_part(record, f"$.{n}")) for n in names])


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out once, where Spark would put their expressions into each use of them; no shuffle."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _fee_or_nested(own: Column, nested: Column) -> Column:
    """The amount of ``own`` (the part "fee") if it is a number or a text that isn't blank, else of ``nested`` ("fees.base")."""
    text = F.trim(F.try_variant_get(own, "$", "string"))
    usable = (json_kind(own) == "number") | ((json_kind(own) == "text") & (text != ""))
    return F.when(F.coalesce(usable, F.lit(False)), json_units(own)).otherwise(json_units(nested))


def sampled(entries: DataFrame) -> DataFrame:
    """Samples of snapshot entries (fetched_at, txid, raw JSON)."""
    parsed = settled(entries.select("fetched_at", "txid", F.try_parse_json("raw_json").alias("record")))
    record = F.col("record")
    parts = settled(parsed.select("fetched_at", "txid", first_count(record, "time").alias("entry_time"), first_count(record, "height").alias("entry_height"), first_count(record, "vsize", "size").alias("size_bytes"), json_part(record, "$.fee").alias("fee"), json_part(record, "$.fees.base").alias("base")))
    counted = settled(parts.select("fetched_at", "txid", "entry_time", "entry_height", "size_bytes", _fee_or_nested(F.col("fee"), F.col("base")).cast("long").alias("fee_base")))
    return counted.select(F.date_trunc("second", "fetched_at").alias("sampled_at"), "txid", "entry_time", "entry_height", "size_bytes", "fee_base", fee_rate(F.col("fee_base"), F.col("size_bytes")).alias("fee_rate"))


def normalized(entries: DataFrame) -> DataFrame:
    """Explorer form of entries: size before vsize, flat amounts before nested ones (whatever they are), dependencies without blanks."""
    record = F.col("record")

    def part(flat: str, nested: str) -> Column:
        own = json_part(record, f"$.{flat}")
        return F.when(own.isNotNull(), json_units(own)).otherwise(json_units(json_part(record, f"$.fees.{nested}"))).cast("long")

    listed = F.coalesce(F.try_variant_get(record, "$.depends", "array<variant>"), F.array().cast("array<variant>"))
    depends = F.filter(F.transform(F.filter(listed, lambda v: json_kind(v) == "text"), lambda v: F.try_variant_get(v, "$", "string")), lambda x: F.trim(x) != "")
    parsed = entries.withColumn("record", F.try_parse_json("raw_json"))
    own = parsed.select(
        "txid", "fetched_at", first_count(record, "time").alias("time"), first_count(record, "size", "vsize").alias("size"), part("fee", "base").alias("fee_base"), part("modifiedfee", "modified").alias("modified_fee"),
        part("ancestorfees", "ancestor").alias("ancestor_fee"), part("descendantfees", "descendant").alias("descendant_fee"), depends.alias("depends"),
    )
    return own.withColumn("fee_rate", fee_rate(F.col("fee_base"), F.col("size")))


def retained(samples: DataFrame, now: Column, seconds: int = RETENTION_S) -> DataFrame:
    return samples.where(F.col("sampled_at") > now - F.make_dt_interval(secs=F.lit(seconds)))


#: Rates that share a bucket when the median is looked for.
RATE_BITS = 16


def fee_distribution(samples: DataFrame) -> DataFrame:
    """Samples, average and median of the rates. The median is read from counts: first the bucket, then the rate in it."""
    samples = settled(samples.select("fee_rate"))
    rates = samples.where("fee_rate is not null").groupBy("fee_rate").agg(F.count("*").alias("n"))
    bucket = F.shiftright("fee_rate", RATE_BITS)
    buckets = rates.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket of rates
    placed = buckets.select("bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), "n", F.sum("n").over(Window.partitionBy()).alias("all"))
    middle = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    chosen = placed.where(middle(low) | middle(high)).select("bucket", "before", "all")
    inside = rates.withColumn("bucket", bucket).join(chosen, "bucket")
    order = Window.partitionBy("bucket").orderBy("fee_rate").rowsBetween(Window.unboundedPreceding, -1)
    ranked = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    ends = ranked.agg(F.max(F.when(middle(low), F.col("fee_rate"))).alias("low"), F.max(F.when(middle(high), F.col("fee_rate"))).alias("high"))
    whole = samples.agg(F.count("*").alias("samples"), F.round(F.avg(F.col("fee_rate").cast("double")), 4).alias("average"))
    both = whole.unionByName(ends, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("samples", "average", "low", "high")])  # of two rows
    return both.select("samples", "average", F.round((F.col("low").cast("double") + F.col("high")) / 2, 4).alias("median"))


def watch_matches(watches: DataFrame, outputs: DataFrame, seconds: int = SESSION_S) -> DataFrame:
    """Transactions that pay a watched address while its watch is open: all its outputs, their sum at least the watch's minimum.

    watches: watch_id, address, min_value, created_at; outputs: txid, vout, address, value_base,
    seen_at. Both meet in buckets of time, so that an address with many watches and payments doesn't
    bring all of them together.
    """
    bucket = F.floor(F.col("created_at") / seconds)
    open_ = watches.select("watch_id", "address", "min_value", "created_at", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    seen = outputs.withColumn("bucket", F.floor(F.col("seen_at") / seconds))
    hit = open_.join(seen, ["address", "bucket"]).where((F.col("seen_at") >= F.col("created_at")) & (F.col("seen_at") < F.col("created_at") + seconds))
    hit = hit.groupBy("watch_id", "address", "txid", "min_value").agg(F.min("seen_at").alias("seen_at"), total(F.col("value_base")).alias("paid"), F.count("*").alias("outputs"))
    return hit.where("paid >= coalesce(min_value, 0)").select("watch_id", "address", "txid", "seen_at", "paid", "outputs")


def watch_outcomes(watches: DataFrame, matches: DataFrame, seconds: int = SESSION_S) -> DataFrame:
    """One outcome per watch: its first match within the session, else a timeout at its end."""
    m = matches.select("watch_id", "txid", "seen_at")
    in_time = watches.join(m, "watch_id").where((F.col("seen_at") >= F.col("created_at")) & (F.col("seen_at") < F.col("created_at") + seconds))
    first = in_time.groupBy("watch_id").agg(F.min(F.struct("seen_at", "txid")).alias("m"))
    return watches.select("watch_id", "created_at").join(first, "watch_id", "left").select("watch_id", F.when(F.col("m").isNull(), "timeout").otherwise("appeared").alias("outcome"), F.col("m.txid").alias("txid"), F.coalesce("m.seen_at", F.col("created_at") + seconds).alias("ended_at"))


def changes(snapshots: DataFrame, step: int = 1) -> DataFrame:
    """Ids of a snapshot that the one before lacks (``step`` 1), or that the next lacks (-1); (snapshot, txid)."""
    near = snapshots.select((F.col("snapshot") + step).alias("snapshot"), "txid")
    return snapshots.join(near, ["snapshot", "txid"], "left_anti")


def degraded(snapshots: DataFrame, most: int = OVERFLOW) -> DataFrame:
    return snapshots.groupBy("snapshot").agg(F.count_distinct("txid").alias("entries")).withColumn("degraded", F.col("entries") > most)


def live_arrivals(snapshots: DataFrame, most: int = OVERFLOW) -> DataFrame:
    """The ids (snapshot, txid) that are matched against watches: new ones of snapshots that aren't degraded.

    A degraded snapshot matches nothing and clears what was known, so all ids of the next one are new.
    """
    sound = snapshots.join(degraded(snapshots, most).where("not degraded").select("snapshot"), "snapshot", "left_semi").select("snapshot", "txid")
    return changes(sound, 1)


def active_watches(watches: DataFrame, now: int) -> DataFrame:
    """Watches that haven't expired, with their number among the owner's."""
    w = Window.partitionBy("owner").orderBy("created_at", "watch_id")
    return watches.where(F.col("expires_at") > now).select("watch_id", "owner", "created_at", F.row_number().over(w).cast("long").alias("nth"))


def accepted_watches(watches: DataFrame, most: int = MOST_WATCHES) -> DataFrame:
    """Watches in order of creation; one is rejected while the owner has ``most`` accepted and not expired.

    Acceptance depends on the acceptances before. An owner's watches lie in one partition, in time
    order, and pass batch by batch; only the live expiries (``most`` at most) are carried along.
    """

    def fold(batches):
        owner, live = object(), []
        for batch in batches:
            accepted = []
            for who, created, expires in zip(batch["who"], batch["created_at"], batch["expires_at"], strict=True):
                live = [e for e in live if e > created] if who == owner else []
                owner = who
                accepted.append(len(live) < most)
                if accepted[-1]:
                    live.append(expires)
            yield batch.assign(accepted=accepted)[["watch_id", "owner", "accepted"]]

    own = watches.select("watch_id", "owner", "created_at", "expires_at", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("who"))
    return own.repartition("who").sortWithinPartitions("who", "created_at", "watch_id").mapInPandas(fold, "watch_id long, owner long, accepted boolean")
