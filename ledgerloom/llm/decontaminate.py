"""Benchmark passages in documents, found by Wu-Manber search over words.

Texts become sequences of word hashes. The patterns are the items' windows of ten consecutive words
(an item of fewer words is one window). For each pattern length there are the tables of Wu and
Manber: the hash of a block of two words gives how far the search may jump (0 if the block ends a
pattern), the hash of the suffix that ends there gives a bucket of patterns, and the words of each
pattern of the bucket are compared with those of the text. Many positions of many texts advance
together as array operations.

Only the benchmark is sent to the executors, in blocks of at most ``BLOCK_BYTES`` of item text by
measured size: normalised text, word offsets and sorted suffix hashes, about five bytes for one of
text. There is one pass over the documents for each block, and one block in a worker at a time;
between passes the documents are written to the shared folder. A benchmark of one block, the usual
case, is one pass and nothing is written or shuffled.

Defined cases: null text or text without words has no words and no hits; null item texts have no
windows; windows of an item with null id hit words but name no item; repeated items count once per
id; repeated documents are each searched for themselves; whole texts are searched; other columns are
kept or not read; an item longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, free_name, stored, table

WINDOW = 10
#: Bytes of item text in one block of patterns.
BLOCK_BYTES = 16 << 20
#: Hashes of words that a task remembers.
_WORDS_KEPT = 150_000
_TABLE = 1 << 20
_SEGMENT = 512
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
#: Bytes to words: lower-case A-Z, keep a-z, 0-9 and all bytes of other characters, blank the rest.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _odd(m: int):
    """The multipliers of the words of a suffix of length ``m``."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(m))
    return rng.integers(0, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1)


def _suffix(hashes, first, odd):
    """Hashes of the suffixes that begin at the words ``first``."""
    import numpy as np

    out = np.zeros(len(first), np.uint64)
    for j in range(len(odd)):
        out += (hashes[first + j] ^ (hashes[first + j] >> np.uint64(31))) * odd[j]
    return out ^ (out >> np.uint64(29))


class _Length:
    """Tables for all patterns of one length: sorted suffix hashes, the first word of each pattern, the items of each."""

    def __init__(self, hashes, first, owner, m: int):
        import numpy as np

        self.m, self.block, self.odd = m, min(2, m), _odd(m)
        shift = np.full(_TABLE, m - self.block + 1, np.uint8)
        for j in range(self.block - 1, m):
            spots = self._mix(hashes, first + j)
            shift[spots] = np.minimum(shift[spots], m - 1 - j)
        self.shift = shift
        keys = _suffix(hashes, first, self.odd)
        order = np.argsort(keys, kind="stable")
        keys, first, owner = keys[order], first[order], owner[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        for j in range(m):  # patterns of one hash but different words are apart
            fresh[1:] |= hashes[first[1:] + j] != hashes[first[:-1] + j]
        begins = np.flatnonzero(fresh)
        self.keys, self.first, self.owner, self.owners = keys[begins], first[begins].astype(np.int32), owner.astype(np.int32), np.append(begins, len(keys)).astype(np.int32)

    def _mix(self, hashes, last):
        import numpy as np

        x = hashes[last - self.block + 1] * np.uint64(0x9E3779B97F4A7C15) + hashes[last]
        return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)

    def find(self, hashes, starts, ends):
        """Pairs (position of first word, pattern) in the texts ``hashes[start:end]`` whose suffix hashes agree."""
        import numpy as np

        m = self.m
        lows = starts + m - 1
        fits = lows < ends
        lows, highs = lows[fits], ends[fits]
        pieces = np.maximum((highs - lows + _SEGMENT - 1) // _SEGMENT, 0)
        text = np.repeat(np.arange(len(lows)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = lows[text] + nth * _SEGMENT
        stop = np.minimum(at + _SEGMENT, highs[text])
        spots, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            jump = self.shift[self._mix(hashes, at)].astype(np.int64)
            hit = at[jump == 0] - m + 1
            if len(hit):
                own = _suffix(hashes, hit, self.odd)
                slot = np.searchsorted(self.keys, own)
                while True:
                    same = slot < len(self.keys)
                    same[same] = self.keys[slot[same]] == own[same]
                    if not same.any():
                        break
                    hit, own, slot = hit[same], own[same], slot[same]
                    spots.append(hit)
                    kinds.append(slot)
                    slot = slot + 1
            at = at + np.maximum(jump, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        return np.concatenate(spots), np.concatenate(kinds)


class Patterns:
    """A block of items (id, text), to be sent to the executors and searched for."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        import numpy as np

        import xxhash

        self.ids = sorted({item for item, _ in items if item is not None})
        number = {item: i for i, item in enumerate(self.ids)}
        parts, sizes, owner = [], [], []
        for item, text in items:
            if words := words_of(text):
                parts += words
                sizes.append(len(words))
                owner.append(number.get(item, -1))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.text, self.offsets = b" ".join(parts), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        n = np.array(sizes, np.int64)
        begins, m, of = np.cumsum(n) - n, np.minimum(n, window), np.array(owner, np.int64)
        self.lengths = []
        for length in np.unique(m):
            some = np.flatnonzero(m == length)
            count = n[some] - length + 1
            first = np.repeat(begins[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            self.lengths.append(_Length(hashes, first, np.repeat(of[some], count), int(length)))

    def words(self, first: int, m: int) -> bytes:
        return self.text[self.offsets[first] : self.offsets[first + m] - 1]


def searcher(patterns: Patterns) -> Callable:
    """A function from texts to rows of HITS."""
    import numpy as np

    known = _Hashes()

    def search(texts):
        split = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in split]).astype(np.int64) if split else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        if len(known) > _WORDS_KEPT:
            known.clear()
        hashes = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(ends[-1]) if len(ends) else 0)
        spans: list[list[list[int]]] = [[] for _ in texts]
        names: list[set[int]] = [set() for _ in texts]
        for tables in patterns.lengths:
            m, firsts, owner, owners = tables.m, tables.first, tables.owner, tables.owners
            spots, kinds = tables.find(hashes, starts, ends)
            doc = np.searchsorted(ends, spots, side="right")
            order = np.argsort(doc, kind="stable")  # of a text one window may occur many times
            for d, s, k in zip(doc[order].tolist(), (spots - starts[doc])[order].tolist() if len(doc) else [], kinds[order].tolist(), strict=True):
                if b" ".join(split[d][s : s + m]) == patterns.words(firsts[k], m):
                    spans[d].append([s, s + m])
                    names[d].update(owner[owners[k] : owners[k + 1]].tolist())
        return [{"n_words": len(w), "spans": merged(s), "items": sorted(patterns.ids[i] for i in x if i >= 0)} for w, s, x in zip(split, spans, names, strict=True)]

    return search


def merged(spans: list[list[int]]) -> list[list[int]]:
    """The union of half-open intervals, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _n_hit(spans: list[Column]) -> Column:
    """Words in the union of the spans of each block of items."""
    if len(spans) == 1:
        return F.aggregate(spans[0], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    each = F.flatten(F.array(*[F.transform(s, lambda x: F.sequence(x[0], x[1] - 1)) for s in spans]))
    return F.size(F.array_distinct(F.flatten(each))).cast("long")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "hits", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (columns ``keep``) with a struct ``name``: n_words, n_hit, items, spans; a pass for each block of items.

    spans: per block of items, the hit runs of words as [first, after last]; items: ids as strings.
    """
    keep = list(docs.columns) if keep is None else keep
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    deal = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    out, added = docs, []
    for i in range(n):
        patterns = Patterns([tuple(r) for r in items.where(deal == i).collect()], window)
        own = docs.sparkSession.sparkContext.broadcast(patterns)
        added.append(free_name(out, f"{name}_{i}"))
        last = i == n - 1
        columns = list(dict.fromkeys([*keep, *added[:-1]] if last else [*keep, text_col, *added[:-1]]))
        out = annotate(out, text_col, lambda own=own: searcher(own.value), HITS, added[-1], columns)
        out = out if last else stored(out, "hits")
    spans = [F.col(f"`{a}`.spans") for a in added]
    hits = F.struct(
        F.col(f"`{added[0]}`.n_words").alias("n_words"),
        _n_hit(spans).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"`{a}`.items") for a in added])))).alias("items"),
        F.array(*spans).alias("spans"),
    )
    return out.select(*[F.col(f"`{k}`") for k in keep], hits.alias(name))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
with w as (
  select 0 as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
  union all
  select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
pattern as (
  select distinct id as item, least(len(words), 10) as m, array_to_string(words[i:i + 9], ' ') as p
  from (select id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from w where kind = 1 and len(words) > 0)),
doc as (select id, words, m, unnest(range(1, len(words) - m + 2)) as i from (select * from w where kind = 0) d cross join (select distinct m from pattern) where len(words) >= m),
hit as (select doc.id, doc.i, doc.m, pattern.item from doc join pattern on pattern.m = doc.m and pattern.p = array_to_string(doc.words[doc.i:doc.i + doc.m - 1], ' ')),
covered as (select id, count(distinct k) as n_hit from (select id, unnest(range(i, i + m)) as k from hit) group by id),
named as (select id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct id, item::varchar as item from hit) group by id)
select w.id as doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join covered on covered.id = w.id left join named on named.id = w.id where w.kind = 0
"""
