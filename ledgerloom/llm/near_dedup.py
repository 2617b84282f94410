"""Near-duplicate documents by MinHash signatures, banding and verified links.

1. A document (a row, whatever its id) is its set of distinct word shingles, as 64-bit hashes.
   Documents with equal sets form a class with a number of its own; from then on only classes count,
   and the least document id of each component is looked up at the end.
2. ``BANDS * ROWS`` universal hash functions give each set its minima; equal minima in all rows of a
   band put two sets into one bucket. At similarity 0.8 a pair misses all buckets with probability
   3e-6.
3. First every set is compared with one popular set of its buckets (a star, not all pairs). Links
   that hold are merged into components. In buckets that hold several components, signatures are
   compared across components, block by block. Sets with a close partner there are then compared
   exactly, all with all of their cluster of buckets across components, in blocks that give back
   links only. Pairs inside one component need no test, as they cannot change the result; no other
   close pair of a bucket stays untested, and no pairs are written out.
4. A link is verified on the full shingle sets. Before that, pairs are dropped of which fewer than
   ``LEAST_AGREEING`` minima agree (``least=0`` turns that off and decides every pair on full sets).
5. Components: alternating large-star and small-star.

Defined cases: null text and text without words have an empty set and are linked with nothing; fewer
words than a shingle are one shingle; repeated rows have the same class, rows of one id with
different texts are documents of their own; a null id never stands for a class and gets a null
component; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, cut, free_name, marked, maybe_in, table, tidied
from .components import components

BANDS, ROWS = 32, 5
PERCENT = 80
#: A pair is dropped if fewer minima agree; at similarity 0.8 that is 6 standard deviations off.
LEAST_AGREEING = int(0.61 * BANDS * ROWS)
#: Sets of a bucket whose signatures are compared at once, and sets of a cluster, with so many hashes in all, that are compared whole.
SIGNATURES, SETS, SET_HASHES = 2048, 512, 1 << 20
#: Dealt members (of one pair of blocks, or of many small buckets) that one group of the signature comparison holds on average.
GROUP_ROWS = 2000
_WORDS_KEPT = 150_000
#: Lower-case A-Z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SKETCH = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("same", T.BinaryType()),
    T.StructField("sig", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])
SET = T.StructType([T.StructField("hashes", T.BinaryType())])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingler(size: int) -> Callable:
    """A function from a text to the sorted array of its distinct shingle hashes."""
    import numpy as np

    known, odd = _Hashes(), [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]

    def shingles(text: str | None):
        words = (text or "").encode().translate(LOWER).split()
        if len(known) > _WORDS_KEPT:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(size, len(h))
        x = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            x = (x ^ (x >> np.uint64(29))) * odd[0] + h[i : len(h) - k + 1 + i] * odd[1]
        x ^= x >> np.uint64(32)
        x *= odd[2]
        x ^= x >> np.uint64(29)
        return np.unique(x)

    return shingles


def sketcher(size: int) -> Callable:
    """A function from texts to rows of SKETCH."""
    import hashlib

    import numpy as np

    shingles, k = shingler(size), BANDS * ROWS
    rng = np.random.Generator(np.random.PCG64(20240229))
    a = rng.integers(0, 2**63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, k, np.uint64) * np.uint64(2) + rng.integers(0, 2, k, np.uint64)
    salt = rng.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
    room = np.empty((512, k), np.uint64)

    def minima(x):
        low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 512):
            part = x[i : i + 512, None]
            own = room[: len(part)]
            np.multiply(part, a, out=own)
            own += b
            np.minimum(low, own.min(axis=0), out=low)
        return low

    def sketch(texts):
        out = []
        for text in texts:
            x = shingles(text)
            if not len(x):
                out.append({"n": 0, "same": None, "sig": None, "bands": []})
                continue
            low = minima(x)
            rows = (low ^ (low >> np.uint64(31))).reshape(BANDS, ROWS)
            keys = (rows * salt).sum(axis=1, dtype=np.uint64) + salt[:, 0] * np.arange(1, BANDS + 1, dtype=np.uint64)
            keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            sig = (low >> np.uint64(16)).astype(np.uint16)
            out.append({"n": len(x), "same": hashlib.blake2b(x.tobytes(), digest_size=16).digest(), "sig": sig.tobytes(), "bands": keys.view(np.int64).tolist()})
        return out

    return sketch


def set_maker(size: int) -> Callable:
    shingles = shingler(size)
    return lambda texts: [{"hashes": shingles(t).tobytes()} for t in texts]


def _agree(least: int) -> Callable:
    """Of pairs (a, b, sa, sb) those whose signatures agree enough: (a, b)."""

    def run(batches):
        import numpy as np

        for p in batches:
            if len(p):
                sa = np.frombuffer(b"".join(p["sa"]), np.uint16).reshape(len(p), -1)
                sb = np.frombuffer(b"".join(p["sb"]), np.uint16).reshape(len(p), -1)
                yield p.loc[(sa == sb).sum(axis=1) >= least, ["a", "b"]]

    return run


def _similar(percent: int) -> Callable:
    def run(batches):
        import numpy as np

        for p in batches:
            keep = []
            for x, y in zip(p["ha"], p["hb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield p.loc[keep, ["a", "b"]]

    return run


def _blocks(key: Any, group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two blocks of a group; one block alone is compared with itself."""
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    return left, left if right.empty else right


def _across(least: int) -> Callable:
    """The sets of each pair of blocks (key, x, y) that have an untested partner of another component whose signature agrees enough."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = group.sort_values(["key", "x", "y", "side"])
        sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), -1)
        ids, of, side, tried = (g[c].to_numpy() for c in ("id", "component", "side", "tried"))
        names = g[["key", "x", "y"]].to_numpy()
        begins = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
        close = np.zeros(len(g), bool)
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(g)], strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            first = mid if mid < hi else lo
            for k in range(lo, mid):
                n = (sig[first:hi] == sig[k]).sum(axis=1)
                near = (n >= least) & (of[first:hi] != of[k]) & (ids[first:hi] != tried[k]) & (tried[first:hi] != ids[k])
                close[k] |= near.any()
                close[first:hi] |= near
        return pd.DataFrame({"id": np.unique(ids[close])})

    return run


def _exact(percent: int) -> Callable:
    """Of two blocks: links between components, on full sets; a component that is joined already isn't joined again."""

    def run(key: Any, group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        left, right = _blocks(key, group)
        sets = [np.frombuffer(h, np.uint64) for h in right["hashes"]]
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets])
        begins = np.cumsum(sizes) - sizes
        ids, of, joined, out = right["id"].to_numpy(), right["component"].to_numpy().copy(), {}, []
        mark = np.zeros(len(tokens), np.int64)
        for h, i, c in zip(left["hashes"], left["id"], left["component"], strict=True):
            own = np.frombuffer(h, np.uint64)
            spot = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
            spot = spot[tokens[spot] == own]
            mark[spot] = 1
            both = np.add.reduceat(mark[at], begins)
            mark[spot] = 0
            while c in joined:
                c = joined[c]
            for j in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)):
                if of[j] != c and ids[j] != i:
                    out.append((min(i, ids[j]), max(i, ids[j])))
                    joined[int(of[j])] = int(c)
                    of[of == of[j]] = c
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _pairs(proposed: DataFrame) -> DataFrame:
    return proposed.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


def _dealt(members: DataFrame, key: str, block: int) -> DataFrame:
    """Members (key, id, component, weight, c: weight of all) of a group dealt into blocks: a row for each pair of blocks that a member is in.

    In a group that weighs more than ``block``, components of as much have blocks of their own, which
    aren't paired with each other; the members of smaller ones share the first blocks.
    """
    few, many = members.where(F.col("c") <= block), members.where(F.col("c") > block)
    small = few.select(key, "id", "component", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"))
    sizes = many.groupBy(key, "component").agg(F.sum("weight").alias("size")).withColumn("large", F.col("size") >= block)
    blocks = F.ceil(F.col("size") / block)
    total = sizes.groupBy(key).agg(F.ceil(F.coalesce(F.sum(F.when(~F.col("large"), F.col("size"))), F.lit(0)) / block).cast("int").alias("shared"), F.coalesce(F.sum(F.when(F.col("large"), blocks)), F.lit(0)).cast("int").alias("others"))
    before = Window.partitionBy(key).orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    large = sizes.where("large").select(key, "component", blocks.cast("int").alias("blocks"), F.coalesce(F.sum(blocks).over(before), F.lit(0)).cast("int").alias("begin"))
    own = many.join(total, key).join(large, [key, "component"], "left")
    begin = F.when(F.col("blocks").isNull(), 0).otherwise(F.col("shared") + F.col("begin"))
    own = own.withColumn("begin", begin).withColumn("n", F.coalesce("blocks", "shared")).withColumn("own", F.col("begin") + F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    to = F.filter(F.sequence(F.lit(0), F.col("shared") + F.col("others") - 1), lambda o: F.col("blocks").isNull() | (o < F.col("begin")) | (o >= F.col("begin") + F.col("n")))
    other = F.transform(to, lambda o: F.struct(F.least("own", o).alias("x"), F.greatest("own", o).alias("y"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    return small.unionByName(own.select(key, "id", "component", F.inline(other)))


class NearDuplicates:
    """Classes and components of the documents; see the module's text."""

    def __init__(self, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, least: int = LEAST_AGREEING):
        self.size, self.percent, self.least = size, percent, least
        text = F.col(f"`{text_col}`")
        self.docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("digest"), text.alias("text"))
        sketched = annotate(self.docs, "text", lambda: sketcher(size), SKETCH, "s", ["doc", "digest"])
        self.rows = cut(sketched.select("doc", "digest", "s.*"))
        known = self.rows.where("n > 0 and doc is not null").groupBy("same").agg(F.min(F.struct("doc", "digest")).alias("first"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n").alias("n"))
        # the numbers hold from here on, as later steps read what was written
        self.classes = cut(known.select(F.monotonically_increasing_id().alias("id"), "same", F.col("first.doc").alias("doc"), F.col("first.digest").alias("digest"), "sig", "bands", "n"))

    def buckets(self) -> DataFrame:
        """key, id, popularity: the buckets with two sets at least.

        Members of a bucket are counted before the shuffle; those that are alone in theirs don't travel
        again, told apart by a bitmap of fixed size, and a hot bucket's may be split in the join.
        """
        each = self.classes.select("id", F.explode("bands").alias("key"))
        filled = cut(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
        shared = cut(maybe_in(each, F.col("key"), filled.select(F.col("key").alias("bucket")), "bucket").join(filled, "key"))
        return shared.select("key", "id").join(shared.groupBy("id").agg(F.sum("c").alias("popularity")), "id")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        sig = self.classes.select("id", "sig")
        close = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").mapInPandas(lambda rows, f=_agree(self.least): tidied(f(rows)), "a long, b long")
        return self.confirmed(cut(close))

    def sets(self, ids: DataFrame) -> DataFrame:
        """id and hashes: the shingle sets of these classes, from the text of one document of each."""
        wanted = self.classes.join(ids, "id", "left_semi").select("id", "doc", "digest")
        own = maybe_in(self.docs.where("doc is not null"), F.col("digest"), wanted, "digest").join(wanted, ["doc", "digest"]).dropDuplicates(["id"])
        size = self.size
        return annotate(own, "text", lambda: set_maker(size), SET, "s", ["id"]).select("id", "s.hashes")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        sets = self.sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
        return cut(both.mapInPandas(lambda rows, f=_similar(self.percent): tidied(f(rows)), "a long, b long"))

    def links(self) -> DataFrame:
        """Verified links (a, b) that connect every component."""
        shared = cut(self.buckets())
        top = shared.groupBy("key").agg(F.max(F.struct("popularity", (-F.col("id")).alias("m"))).alias("top"))
        to = shared.join(top, "key").select("id", F.struct("top.popularity", F.col("top.m")).alias("top")).where(F.col("id") != -F.col("top.m"))
        tried = cut(to.groupBy("id").agg((-F.max("top")["m"]).alias("to")))
        found = self.verified(_pairs(tried))
        of = components(found)
        now = cut(shared.select("key", "id").join(of.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("key", "c")
        close = cut(self._close(now.join(mixed, "key"), tried))
        return found if close.isEmpty() else found.union(self._rest(now.join(close, "id", "left_semi")))

    def _close(self, members: DataFrame, tried: DataFrame) -> DataFrame:
        """Of buckets with several components (key, id, component, c): the ids that have a close untested partner in another one."""
        known = self.classes.select("id", "sig").join(tried.withColumnRenamed("to", "tried"), "id", "left").fillna(-1, ["tried"])
        # many small buckets share a group, the blocks of large ones are spread
        dealt = _dealt(members.withColumn("weight", F.lit(1)), "key", SIGNATURES)
        bins = max(1, -(-dealt.count() // GROUP_ROWS))
        return dealt.join(known, "id").groupBy(F.pmod(F.xxhash64("key", "x", "y"), F.lit(bins))).applyInPandas(_across(self.least), "id long").distinct()

    def _rest(self, members: DataFrame) -> DataFrame:
        """Links among sets that still have a close partner in another component, of whole bucket clusters."""
        members = cut(members)
        lead = members.groupBy("key").agg(F.min("id").alias("lead"))
        cluster = components(members.join(lead, "key").select(F.col("id").alias("a"), F.col("lead").alias("b"))).toDF("id", "key")
        sized = members.select("id", "component").distinct().join(cluster, "id").join(self.classes.select("id", "n"), "id")
        sized = sized.select("key", "id", "component", (F.col("n") + SET_HASHES // SETS).alias("weight"))
        sized = cut(sized.join(sized.groupBy("key").agg(F.sum("weight").alias("c")), "key"))
        rows = _dealt(sized, "key", SET_HASHES).join(self.sets(sized.select("id")), "id")
        return cut(rows.groupBy("key", "x", "y").applyInPandas(_exact(self.percent), "a long, b long").distinct())

    def result(self) -> DataFrame:
        """id, digest, n, component per document row."""
        of = components(self.links()).withColumnRenamed("node", "id")
        own = self.classes.select("id", "same", "doc").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = own.groupBy("component").agg(F.min("doc").alias("least"))
        reps = own.join(least, "component").select("same", "least")
        found = self.rows.select("doc", "digest", "n", "same").join(reps, "same", "left")
        return found.select(F.col("doc").alias("id"), "digest", "n", F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc")).alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_AGREEING) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    found = NearDuplicates(docs, size, percent, id_col, text_col, least).result()
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least id.

    Of rows with the same id in one component the one with the least text hash stays, of repeated
    ones with the same id and text one; rows without words or id all stay. Only rows that may have
    to go are shuffled.
    """
    found = cut(NearDuplicates(docs, size, percent, id_col, text_col).result().where("n > 0 and id is not null"))
    stays = found.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("first"), F.count("*").alias("c"))
    joined = found.join(stays, "component")
    odd_rows = joined.where("c > 1").select("id", "digest", (F.struct("id", "digest") == F.col("first")).alias("stays")).distinct()
    mark, digest, flag = free_name(docs, "odd"), free_name(docs, "digest"), free_name(docs, "stays")
    key = F.col(f"`{id_col}`").cast("long")
    # rows that have to go, and those that stay once
    flagged = marked(docs.withColumn(digest, F.xxhash64(f"`{text_col}`")), F.xxhash64(key, F.col(digest)), odd_rows.select(F.xxhash64("id", "digest").alias("both")), "both", mark)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = odd_rows.select(F.col("id").alias(mark + "id"), F.col("digest").alias(digest + "id"), F.col("stays").alias(flag))
    odd = flagged.where(mark).join(own, (key == F.col(mark + "id")) & (F.col(digest) == F.col(digest + "id")), "left")
    once = odd.where(F.col(flag)).dropDuplicates([mark + "id", digest + "id"])
    rest = odd.where(F.col(flag).isNull())
    return flagged.where(~F.col(mark)).select(*columns).unionByName(rest.select(*columns)).unionByName(once.select(*columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


OP9_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 3], ' ') as shingle from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * shared >= 80 * (nx.n + ny.n - shared)),
b as (select x, y from e union all select y, x from e),
reach as (select doc_id as a, doc_id as z from w union select a, y from reach join b on b.x = z),
c as (select a, min(z) as component from reach group by a)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, component as component_id, w.doc_id = component as kept from w join c on c.a = w.doc_id left join n on n.doc_id = w.doc_id
"""
