"""Removal of repeated strings of 200 bytes by bucket-pointer refinement.

A byte goes if it lies in a 200-byte string that also starts anywhere else in the corpus. Strings
are put in buckets, which are refined until they hold equal strings only:

1. Initial q-gram buckets, over the whole corpus. Every 200-byte window names the least of its
   32-byte grams (by hash, the first of equals) as its anchor; neighbouring windows mostly share it.
   Equal windows have equal anchors at equal offsets, so a bucket is the set of anchors with the same
   gram, and holds one row for a run of windows instead of one for each byte. Buckets of one anchor
   are done: nothing repeats. A hash decides only which bucket a string goes to.
2. Anchors of a bucket that agree in all of their surroundings, from the first byte of the run's first
   window to the last of its last one, are done too: every window repeats. Surroundings are compared
   by 128-bit hashes; one of the anchors goes on and stands for all against the rest of the bucket.
3. The anchors that are left travel as one context string each, and each bucket is refined by bucket
   pointers: positions are sorted by their 8 bytes, then by their own bucket and the one that the
   position 8 further on points to, which gives the buckets of 16 bytes, and so on from the pointers
   just made to 32, 64, 128 and 200 bytes. A position that is alone in its bucket is settled and takes
   no part in later rounds. These buckets hold equal bytes, by comparison of the bytes themselves.

A bucket with more than ``HOT_KEY`` open anchors would be too large for one group. Its windows go one
by one to the buckets of their 200 bytes (by 128-bit hashes), which are counted before the shuffle.
Equal 128-bit hashes count as equal strings: a false match has a probability of 1e-18 in 1e10 of them.

Texts are known by 64-bit hashes, chosen so that no two different texts of the corpus share one.

Defined cases: null text is empty; texts shorter than 200 bytes keep all; texts of any length are
worked on in pieces that overlap; repeated rows are repeats of each other; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name, marked, maybe_in, stored, table, tidied

LENGTH, GRAM = 200, 32
#: Windows in one piece of a long text, and bytes of short texts that are worked on together.
PIECE, BATCH = 4 << 20, 1 << 20
#: Open anchors of a bucket that is refined in one group (some 3 MB of contexts).
HOT_KEY = 10_000
#: Contexts that one group of the window comparison holds on average.
GROUP_ROWS = 3000
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> int:
    return pow(_BASE, n, 1 << 64)


def _doubled(ids: dict, upto: int) -> None:
    """Names of the strings of lengths 2, 4 .. ``upto`` that start at each byte, each from the level before."""
    import numpy as np

    q = 1
    while q < upto:
        x = ids[q]
        ids[2 * q] = x[:-q] * np.uint64(_power(q)) + x[q:] if len(x) > q else x[:0]
        q *= 2


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def equal_windows(data, ends, starts):
    """Which of the 200-byte strings that begin at ``starts`` begin at another of them too? By bucket pointers.

    ``data`` holds strings end to end, ``ends`` where they end; no window crosses an end.
    """
    import numpy as np

    n = len(data)
    if n < LENGTH or len(starts) < 2:
        return np.zeros(len(starts), bool)
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    at, q = np.arange(n), 8
    grams = np.lib.stride_tricks.sliding_window_view(data, q).copy().view(np.uint64).ravel()
    open_ = at[: n - q + 1][at[: n - q + 1] + q <= end[: n - q + 1]]
    names, pointer = grams[open_], None

    def refined(names, open_):
        """Pointers of all positions: the bucket of an open one that isn't alone, else one of its own; and the positions still open."""
        _, bucket, size = np.unique(names, return_inverse=True, return_counts=True)
        kept = size[bucket] > 1
        pointer = at + n
        pointer[open_[kept]] = bucket[kept]
        return pointer, open_[kept]

    while q < 128:
        pointer, open_ = refined(names, open_)
        open_ = open_[open_ + 2 * q <= end[open_]]
        names = pointer[open_] * (2 * n) + pointer[open_ + q]
        q *= 2
    pointer, open_ = refined(names, open_)
    whole = pointer[starts] < n  # 200 bytes: the first 128 and the last 128 of them
    some = starts[whole]
    _, bucket, size = np.unique(pointer[some] * (2 * n) + pointer[some + LENGTH - q], return_inverse=True, return_counts=True)
    found = np.zeros(len(starts), bool)
    found[whole] = size[bucket] > 1
    return found


def anchors(data, ends):
    """Anchors of the texts that lie end to end in ``data``: gram name, anchor, first window, windows."""
    import numpy as np

    w = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]
    ids = {1: data.astype(np.uint64) + np.uint64(1)}
    _doubled(ids, GRAM)
    gram = _mixed(ids[GRAM])
    # the place takes the low bits, so that of equal grams the first is least
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: span - w], least[w - span :])
    place = (least & low).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= LENGTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, np.minimum(ends[long] - LENGTH + 1, len(place)), -1)
    valid = np.cumsum(inside[:-1]) > 0
    # a text's windows end before the next text's begin, unless both lie side by side
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.concatenate([first, [len(place)]]))
    keep = valid[first]
    first, count = first[keep], count[keep]
    return [gram[place[first]], place[first], first, count]


def _pieces(texts: list[bytes]):
    """(numbers of the texts, offsets in them, ends in the data, data): short texts together, long ones in overlapping pieces."""
    import numpy as np

    some, size = [], 0
    for i, b in enumerate(texts):
        if len(b) < LENGTH:
            continue
        parts = [(i, 0, b)] if len(b) <= PIECE else [(i, at, b[at : at + PIECE + LENGTH - 1]) for at in range(0, len(b) - LENGTH + 1, PIECE)]
        for part in parts:
            if some and size + len(part[2]) > BATCH:
                yield [x[0] for x in some], [x[1] for x in some], np.cumsum([len(x[2]) for x in some]), np.frombuffer(b"".join(x[2] for x in some), np.uint8)
                some, size = [], 0
            some.append(part)
            size += len(part[2])
    if some:
        yield [x[0] for x in some], [x[1] for x in some], np.cumsum([len(x[2]) for x in some]), np.frombuffer(b"".join(x[2] for x in some), np.uint8)


def _runs(texts, lo, hi):
    """The union of the spans [lo, hi) of each text; they come sorted by text and lo."""
    import numpy as np

    if not len(lo):
        return texts, lo, hi
    fresh = np.ones(len(lo), bool)
    fresh[1:] = (texts[1:] != texts[:-1]) | (lo[1:] > np.maximum.accumulate(hi + texts * (1 << 40))[:-1] - texts[1:] * (1 << 40))
    first = np.flatnonzero(fresh)
    return texts[first], lo[first], np.maximum.reduceat(hi, first)


def _names(raw: bytes, first, sizes, seeds):
    """128-bit hashes of parts of ``raw``, as two columns."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh128_digest
    return np.frombuffer(b"".join([digest(raw[a : a + n], seed=o) for a, n, o in zip(first.tolist(), sizes.tolist(), seeds.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def _anchor_rows(batches):
    """Texts (doc, text) to anchors: key, context (c1, c2), doc, place (first window << 16 | offset << 8 | windows - 1), n.

    n is 1, or 2 where the text itself or the batch has the anchor in the same surroundings again;
    of such anchors one goes on, and the windows of a text's others are settled: they leave as spans
    with n = 0, place the first byte and c1 the one after the last. So neither periodic texts nor
    copies fill a bucket.
    """
    import numpy as np

    for batch in batches:
        times = batch.groupby("doc")["doc"].transform("size")
        batch = batch.assign(n=np.minimum(times, 2))[~batch["doc"].duplicated()]
        docs, copies, texts = batch["doc"].to_numpy(), batch["n"].to_numpy(), [t.encode() for t in batch["text"]]
        for owners, offsets, ends, data in _pieces(texts):
            key, place, first, count = anchors(data, ends)
            text = np.searchsorted(ends, first, side="right")
            begins = np.concatenate([[0], ends[:-1]])
            off = place - first
            context = _names(data.tobytes(), first, count + LENGTH - 1, off)
            at = first - begins[text] + np.array(offsets, np.int64)[text]
            owner = np.array(owners, np.int64)[text]
            name = _mixed(key ^ _mixed(context[:, 0].view(np.uint64) ^ _mixed(owner.astype(np.uint64) + np.uint64(1))))
            _, lead, group = np.unique(name, return_index=True, return_inverse=True)
            of = lead[group]
            same = (key == key[of]) & (context == context[of]).all(axis=1) & (owner == owner[of])
            many = np.bincount(group[same], minlength=len(lead))
            leads = ~same
            leads[lead] = True
            n = np.maximum(copies[owner], np.where(same, np.minimum(many[group], 2), 1))
            again = ~leads
            of, lo, hi = _runs(owner[again], at[again], at[again] + count[again] - 1 + LENGTH)
            spread = _mixed(docs[of].view(np.uint64) + lo.astype(np.uint64)) if len(of) else np.zeros(0, np.uint64)
            none = np.zeros(len(of), np.int64)
            yield pd.DataFrame({
                "key": np.concatenate([key[leads], spread]).view(np.int64),
                "c1": np.concatenate([context[leads, 0], hi]),
                "c2": np.concatenate([context[leads, 1], none]),
                "doc": np.concatenate([docs[owner[leads]], docs[of]]),
                "place": np.concatenate([(at << 16 | off << 8 | (count - 1))[leads], lo]),
                "n": np.concatenate([n[leads], none]),
            })


def _context_rows(batches):
    """Texts with the keys and places of their open anchors to contexts: key, doc, first window, bytes."""
    for batch in batches:
        for doc, text, keys, places in zip(batch["doc"], batch["text"], batch["keys"], batch["places"], strict=True):
            b = text.encode()
            for i in range(0, len(keys), 10_000):
                at, n = places[i : i + 10_000] >> 16, (places[i : i + 10_000] & 255) + LENGTH
                yield pd.DataFrame({"key": keys[i : i + 10_000], "doc": doc, "at": at, "bytes": [b[x:y] for x, y in zip(at.tolist(), (at + n).tolist(), strict=True)]})


def _windows(group: pd.DataFrame):
    """The contexts end to end, where they end, where their windows begin, each window's context and number in it."""
    import numpy as np

    sizes = group["bytes"].map(len).to_numpy(np.int64)
    ends = np.cumsum(sizes)
    count = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(group)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(b"".join(group["bytes"]), np.uint8), ends, (ends - sizes)[row] + nth, row, nth


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows (doc, lo, hi) that occur twice or more among the contexts."""
    import numpy as np

    data, ends, starts, row, nth = _windows(group)
    hit = np.flatnonzero(equal_windows(data, ends, starts))
    at = group["at"].to_numpy()[row[hit]] + nth[hit]
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (row[hit][1:] != row[hit][:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(hit)]]) - 1 if len(hit) else first
    return pd.DataFrame({"doc": group["doc"].to_numpy()[row[hit][first]], "lo": at[first], "hi": at[last] + LENGTH})


def _window_rows(batches):
    import numpy as np

    for batch in batches:
        if len(batch):
            data, _, starts, row, nth = _windows(batch)
            names = _names(data.tobytes(), starts, np.full(len(starts), LENGTH), np.zeros(len(starts), np.int64))
            yield pd.DataFrame({"c1": names[:, 0], "c2": names[:, 1], "doc": batch["doc"].to_numpy()[row], "at": batch["at"].to_numpy()[row] + nth})


def _removed(batches):
    """Texts with the begins and ends of their spans to (id, n_bytes, spans, kept)."""
    for batch in batches:
        out = []
        for i, text, begins, ends in zip(batch["id"], batch["text"], batch["begins"], batch["ends"], strict=True):
            b, runs = text.encode(), []
            for lo, hi in sorted(zip(begins.tolist(), ends.tolist(), strict=True)) if begins is not None else ():
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            kept, at = [], 0
            for lo, hi in runs:
                kept.append(b[at:lo])
                at = hi
            out.append((i, len(b), runs, b"".join([*kept, b[at:]])))
        yield pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept"]).astype({"id": "Int64"})


def repeated_spans(docs: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """doc, lo, hi: parts of the texts of ``docs`` (doc, text) in which every window repeats; they may overlap."""
    rows = stored(docs.where(F.octet_length("text") >= LENGTH).mapInPandas(lambda rows: tidied(_anchor_rows(rows)), "key long, c1 long, c2 long, doc long, place long, n long"), "anchors")
    # buckets are counted before the shuffle, and the anchors that are alone in theirs never travel
    full = rows.where("n > 0").groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    some = maybe_in(rows.where("n > 0"), F.col("key"), full.withColumnRenamed("key", "bucket"), "bucket")
    pairs = cut(some.groupBy("key", "c1", "c2").agg(F.sum("n").alias("same"), F.min(F.struct("doc", "place")).alias("lead")))
    windows = F.col("place").bitwiseAND(F.lit(255))
    again = some.join(pairs.where("same > 1").select("key", "c1", "c2"), ["key", "c1", "c2"], "left_semi")
    settled = rows.where("n = 0").select("doc", F.col("place").alias("lo"), F.col("c1").alias("hi"))
    settled = settled.union(again.select("doc", F.shiftright("place", 16).alias("lo"), (F.shiftright("place", 16) + windows + LENGTH).alias("hi")))
    # of anchors that agree, one stands for all against the others of the bucket
    many = pairs.groupBy("key").agg(F.count("*").alias("open")).where("open > 1")
    opened = cut(pairs.join(many, "key").select("key", "open", "lead.doc", "lead.place"))
    usual, hot = opened.where(F.col("open") <= hot_key), opened.where(F.col("open") > hot_key)
    bins = max(1, -(-usual.count() // GROUP_ROWS))
    found = _contexts(docs, usual).groupBy(F.pmod(F.xxhash64("key"), F.lit(bins))).applyInPandas(_repeated, "doc long, lo long, hi long")
    out = settled.union(found)
    if not hot.isEmpty():
        one_by_one = _contexts(docs, hot).mapInPandas(lambda rows: tidied(_window_rows(rows)), "c1 long, c2 long, doc long, at long")
        twice = one_by_one.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2")
        out = out.union(one_by_one.join(twice, ["c1", "c2"], "left_semi").select("doc", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi")))
    return out.distinct()


def _contexts(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """key, doc, first window, bytes of the opened anchors."""
    left = opened.groupBy("doc").agg(F.collect_list(F.struct("key", "place")).alias("o")).select("doc", F.col("o.key").alias("keys"), F.col("o.place").alias("places"))
    # one of all copies, so that contexts are as many as the opened anchors; copies meet before the shuffle
    texts = maybe_in(docs, F.col("doc"), opened.select(F.col("doc").alias("of")), "of").groupBy("doc").agg(F.first("text").alias("text"))
    return texts.join(left, "doc").select("doc", "text", "keys", "places").mapInPandas(lambda rows: tidied(_context_rows(rows)), "key long, doc long, at long, bytes binary")


def _text_names(docs: DataFrame, text: Column) -> Column:
    """A 64-bit hash of the text under which no two different texts of ``docs`` meet."""
    seed = 0
    while True:
        name = F.xxhash64(F.lit(seed), text)
        each = docs.select(name.alias("doc"), F.sha2(text.cast("binary"), 256).alias("sha")).groupBy("doc").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
        if each.where("lo <> hi").isEmpty():
            return name
        seed += 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs [lo, hi) of bytes, in order), kept (the other bytes).

    Texts without repeats stay where they are; only those that may have some are shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    own = own.withColumn("doc", _text_names(own, F.col("text")))
    spans = repeated_spans(own.select("doc", "text"), hot_key).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))
    spans = cut(spans.select("doc", F.col("s.lo").alias("begins"), F.col("s.hi").alias("ends")))
    may = free_name(own, "may")
    flagged = marked(own, F.col("doc"), spans.select(F.col("doc").alias("of")), "of", may)
    none = F.lit(None).cast("array<long>")
    rest = flagged.where(~F.col(may)).select("id", "text", none.alias("begins"), none.alias("ends"))
    some = flagged.where(may).join(spans, "doc", "left").select("id", "text", "begins", "ends")
    return rest.union(some).mapInPandas(lambda rows: tidied(_removed(rows)), "id long, n_bytes long, spans array<array<long>>, kept binary").withColumnRenamed("id", "doc_id")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP3_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
q as (select r, n, j, substr(h, 2000 * j + 1, 2398) as part from (select r, h, n, unnest(range(0, (greatest(n - 199, 0) + 999) // 1000)) as j from d)),
w as (select r, 1000 * j + k as i, md5(substr(part, 2 * k + 1, 400)) as m from (select r, j, part, unnest(range(0, least(1000, n - 199 - 1000 * j))) as k from q)),
s as (select r, i from w where m in (select m from w group by m having count(*) > 1)),
t as (select r, i, case when i <= lag(i) over (partition by r order by i) + 200 then 0 else 1 end as fresh from s),
u as (select r, i, sum(fresh) over (partition by r order by i rows unbounded preceding) as run from t),
g as (select r, min(i) as lo, max(i) + 200 as hi from u group by r, run),
k as (select g.r, lo, hi, substr(h, 2 * coalesce(lag(hi) over (partition by g.r order by lo), 0) + 1, 2 * (lo - coalesce(lag(hi) over (partition by g.r order by lo), 0))) as gap from g join d on d.r = g.r),
f as (select r, sum(hi - lo) as n_removed, count(*) as n_spans, string_agg(gap, '' order by lo) as front, max(hi) as last from k group by r)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join f on f.r = d.r
"""
