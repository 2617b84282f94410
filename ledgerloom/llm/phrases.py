"""Phrase collocations from a weighted de Bruijn graph.

A text (A-Z in lower case) is split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and these into words
``[^\\x20\\x09]+``. Only the longest grams (``max_words`` words) are counted as such: each is an edge
between the overlapping nodes of its first and its last ``max_words - 1`` words. Where a piece ends,
the last 1, 2, ... ``max_words - 1`` words are noted as corrections. All shorter counts follow: a
phrase is followed by a word or ends its piece, so its count is the flow out of it, plus its correction.

Edges and corrections are counted task by task over a bounded number of words and shuffled once, by their
node, so that Spark sums up edges and the flow out of each node where they arrive; what is below
``min_count`` can be no candidate and only goes on as flow out of shorter nodes. What is left is
compacted, with a rest for each node (its count less its edges that are left): a node with one edge in and one out is an inner node of a path, each path
becomes one row of words and weights, and an inner node's count is read off it (weight out plus
rest); only nodes where paths begin or end need their flow summed up. Inner nodes find the head of
their path by pointer doubling. Nodes that have none after ``ROUNDS`` rounds (in circles, or further
than 2**ROUNDS from it) are left as ends, which is always right, so a path's row is bounded.

Candidates are phrases of 2 to ``max_words`` words with a count a >= ``min_count``. The score of a cut
into parts with counts l and r is floor(1000000 * a * a / (l * r)), in decimals of 38 digits, exact
for counts below 10**16; the lowest counts, the shortest first part among equals. Phrases inside a
longer candidate that has ``share`` percent of their count are left out.

Defined cases: a null text has no words, a null language is ``und``; empty and blank pieces have no
words; pieces shorter than an edge live in the corrections alone; texts and pieces of any length are
taken whole, in parts; repeated rows count each; further columns aren't read; an empty table gives
no rows. Hot phrases are counted before the shuffle, so a node's task gets a row for each different
edge of each task at most, which it aggregates as a stream; ranks are taken within shares of a language
first, so no task holds a language.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, stored, table, tidied

MAX_WORDS, MIN_COUNT, SHARE, TOP, UNNAMED = 3, 10, 50, 2000, "und"
#: Words, and their bytes, whose edges a task counts before it gives them on; a longer piece is held in parts.
HELD, HELD_BYTES = 500_000, 32 << 20
#: Rounds of pointer doubling, and shares into which a language is dealt to be ranked.
ROUNDS, SHARES = 12, 64
#: A node is its language, a tab (which no word has) and its words.
_EDGES = T.StructType([T.StructField("node", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_SIFTED = T.StructType([*_EDGES, T.StructField("k", T.IntegerType())])
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")


class _Ids(dict):
    """A number for each word, in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Held:
    """Words of pieces whose edges and ends a task hasn't yet given on."""

    def __init__(self, max_words: int):
        self.most, self.langs = max_words, _Ids()
        self._clear()

    def _clear(self) -> None:
        self.words, self.sizes, self.lang, self.ended, self.bytes = [], [], [], [], 0

    def full(self) -> bool:
        return len(self.words) >= HELD or self.bytes > HELD_BYTES

    def add(self, lang: str, piece: bytes):
        """Hold a piece; batches come out whenever enough is held."""
        words = piece.split()  # space and tab: the other white space ends a piece
        while len(words) > HELD:  # a part overlaps the next, so that each edge lies in one
            part, words = words[:HELD], words[HELD - self.most + 1 :]
            yield from self._hold(lang, part, False)
        if words:
            yield from self._hold(lang, words, True)

    def _hold(self, lang: str, words: list[bytes], ended: bool):
        self.words += words
        self.sizes.append(len(words))
        self.lang.append(self.langs[lang])
        self.ended.append(ended)
        self.bytes += sum(map(len, words))
        if self.full():
            yield from self.given()

    def given(self):
        """Batches of the edges and ends of what is held, equal ones as one row."""
        import numpy as np
        import pyarrow as pa

        if not self.words:
            return
        ids = _Ids()
        word = np.fromiter(map(ids.__getitem__, self.words), np.int64, len(self.words))
        vocabulary = pa.array(list(ids), pa.binary())
        langs = pa.array([x.encode() for x in self.langs], pa.binary())
        sizes, lang, ended = np.array(self.sizes), np.array(self.lang, np.int64), np.array(self.ended)
        begins = np.cumsum(sizes) - sizes
        count = np.maximum(0, sizes - self.most + 1)
        starts = np.repeat(begins - (np.cumsum(count) - count), count) + np.arange(count.sum())
        yield _counted(word, vocabulary, langs, starts, np.repeat(lang, count), self.most, True)
        for k in range(1, self.most):
            some = ended & (sizes >= k)
            yield _counted(word, vocabulary, langs, (begins + sizes)[some] - k, lang[some], k, False)
        self._clear()


def _counted(word, vocabulary, langs, starts, lang, size: int, edge: bool):
    """A batch of the different runs of ``size`` words that begin at ``starts``, with how many there are."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    key, most, n = lang, len(langs), len(vocabulary)
    for i in range(size):
        if most > (1 << 62) // n:  # numbers for what is there instead of for what could be
            key, most = np.unique(key, return_inverse=True)[1], len(key) + 1
        key, most = key * n + word[starts + i], most * n
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    at = starts[first]
    parts = [vocabulary.take(pa.array(word[at + i])) for i in range(size)]
    whole = parts[: size - edge]
    names = pc.binary_join_element_wise(*whole, pa.scalar(b" ", pa.binary())) if len(whole) > 1 else whole[0]
    node = pc.binary_join_element_wise(langs.take(pa.array(lang[first])), names, pa.scalar(b"\t", pa.binary()))
    last = parts[-1] if edge else pa.nulls(len(at), pa.binary())
    return pa.RecordBatch.from_arrays([node.cast(pa.string()), last.cast(pa.string()), pa.array(count.astype(np.int64))], names=_EDGES.names)


def edges(docs: DataFrame, max_words: int = MAX_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """node, word (null: an end of pieces), n; a key may have rows of many tasks."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col), F.lit(UNNAMED)).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        held = _Held(max_words)
        for batch in batches:
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                for piece in _BREAK.split(batch.column("text")[i].as_py().lower()):  # of bytes: A-Z only
                    yield from held.add(lang, piece)
        yield from held.given()

    return rows.mapInArrow(lambda batches: tidied(run(batches)), _EDGES)


def graph(counted: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, k, node, word, n: edges, and with a null word the counts of nodes, if they are ``min_count`` or more.

    With k below ``max_words - 1``: flow out of shorter nodes, in parts; k 0: words of the language, in parts.
    """
    whole = counted.repartition("node").groupBy("node", "word").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    both = F.explode(F.when(F.col("word").isNotNull() & (F.col("n") >= min_count), F.array(none, F.col("word"))).otherwise(F.array(none)))
    nodes = whole.select("node", both.alias("word"), "n").groupBy("node", "word").agg(F.sum("n").alias("n"))  # where they are

    def sift(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        parts, held = [], 0
        for batch in batches:
            node, n = batch.column("node"), batch.column("n")
            words = pc.replace_substring_regex(node, r"(?s)^.*\t", "")
            k = pc.add(pc.count_substring(words, " "), 1).cast(pa.int32())
            batch = pa.RecordBatch.from_arrays([*batch.columns, k], names=_SIFTED.names)
            yield batch.filter(pc.and_(pc.equal(k, max_words - 1), pc.greater_equal(n, min_count)))
            # what flows into shorter nodes, and into the language
            flow = batch.filter(pc.is_null(batch.column("word"))).select(["node", "n", "k"])
            own = flow.filter(pc.less(flow.column("k"), max_words - 1))
            some = [own.columns, [pc.replace_substring_regex(flow.column("node"), r"(?s)[^\t]*$", ""), flow.column("n"), pa.array([0] * flow.num_rows, pa.int32())]]
            for _ in range(max_words - 2):
                flow = flow.filter(pc.greater(flow.column("k"), 1))
                flow = pa.RecordBatch.from_arrays([pc.replace_substring_regex(flow.column("node"), " [^ ]*$", ""), flow.column("n"), pc.subtract(flow.column("k"), 1).cast(pa.int32())], names=["node", "n", "k"])
                some.append(flow.columns)
            parts.append(summed(pa.concat_tables([pa.table(list(x), names=["node", "n", "k"]) for x in some])))
            held += parts[-1].num_rows
            if held > HELD:
                parts = [summed(pa.concat_tables(parts))]
                held = parts[0].num_rows
                if held > HELD // 2:
                    yield from given(parts)
                    parts, held = [], 0
        yield from given(parts)

    def summed(flow):
        out = flow.group_by(["node", "k"]).aggregate([("n", "sum")])
        return out.select(["node", "n_sum", "k"]).rename_columns(["node", "n", "k"])

    def given(parts):
        import pyarrow as pa

        for part in summed(pa.concat_tables(parts)).to_batches() if parts else []:
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.nulls(part.num_rows, pa.string()), part.column("n"), part.column("k")], names=_SIFTED.names)

    found = nodes.mapInArrow(lambda batches: tidied(sift(batches)), _SIFTED)
    words = F.substring_index("node", "\t", -1)
    return found.select(F.expr("left(node, length(node) - length(substring_index(node, '\t', -1)) - 1)").alias("lang"), "k", words.alias("node"), "word", "n")


def _moved(node: Column, word: Column, max_words: int) -> Column:
    """The node that an edge leads to."""
    return word if max_words == 2 else F.concat_ws(" ", F.substring_index(node, " ", 2 - max_words), word)


def inner_nodes(links: DataFrame) -> DataFrame:
    """lang, node, head, d for nodes with one edge in and one out: the first such node of the path and how far it lies back.

    ``links``: lang, node, word, n, to.
    """
    out = links.groupBy("lang", "node").agg(F.count("*").alias("c")).where("c = 1").drop("c")
    into = links.groupBy("lang", F.col("to").alias("node")).agg(F.count("*").alias("c"), F.min("node").alias("before")).where("c = 1 and before <> node").drop("c")
    inner = cut(out.join(into, ["lang", "node"]))
    known = inner.select("lang", F.col("node").alias("before"), F.lit(1).alias("known"))
    now = cut(inner.join(known, ["lang", "before"], "left").select("lang", "node", F.expr("if(known = 1, before, node)").alias("head"), F.coalesce("known", F.lit(0)).alias("d")))
    further = lambda df: df.join(df.select("lang", F.col("node").alias("head"), F.col("head").alias("next"), F.col("d").alias("more")), ["lang", "head"])
    for _ in range(ROUNDS):
        ahead = further(now)
        if ahead.where("more > 0").isEmpty():
            return now
        now = cut(ahead.select("lang", "node", F.col("next").alias("head"), (F.col("d") + F.col("more")).alias("d")))
    return cut(further(now).where("more = 0").select("lang", "node", "head", "d"))


def rests(weighted: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, node, rest: the count of each node less the edges that the graph has of it."""
    own = weighted.where(F.col("k") == max_words - 1)
    out = own.where("word is not null").groupBy("lang", "node").agg(F.sum("n").alias("out"))
    return own.where("word is null").join(out, ["lang", "node"], "left").select("lang", "node", (F.col("n") - F.coalesce("out", F.lit(0))).alias("rest"))


def paths(weighted: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The compacted graph: lang, words, weights, rests.

    The edge i of a path is the ``max_words`` words from i on and has the weight i; the node before
    it, if it isn't the path's first, has the rest i beside that weight.
    """
    w = F.col("word")
    links = weighted.where(w.isNotNull()).select("lang", "node", "word", "n", _moved(F.col("node"), w, max_words).alias("to"))
    inner = inner_nodes(links)
    rest = rests(weighted, max_words)
    source = inner.join(rest, ["lang", "node"], "left").select("lang", "node", F.col("head").alias("head_from"), F.col("d").alias("d_from"), F.coalesce("rest", F.lit(0)).cast("long").alias("rest"))
    target = inner.select("lang", F.col("node").alias("to"), F.col("head").alias("head_to"), F.col("d").alias("d_to"))
    placed = links.join(source, ["lang", "node"], "left").join(target, ["lang", "to"], "left")
    head, pos = F.coalesce("head_to", "head_from"), F.coalesce(F.col("d_to"), F.col("d_from") + 1, F.lit(0))
    alone = F.when(head.isNull(), F.struct("node", "word"))
    rows = placed.groupBy("lang", head.alias("head"), alone.alias("alone")).agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), "node", "word", "n", "rest"))).alias("e"))
    return rows.select("lang", F.concat(F.split(F.col("e")[0]["node"], " "), F.col("e")["word"]).alias("words"), F.col("e")["n"].alias("weights"), F.col("e")["rest"].alias("rests"))


def phrase_counts(weighted: DataFrame, compact: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """lang, k, phrase, n of all phrases of 1 to ``max_words`` words with n >= ``min_count``."""
    phrase = lambda size: F.array_join(F.slice("words", F.col("i") + 1, size), " ")
    steps = compact.select("lang", "words", "rests", F.posexplode("weights").alias("i", "n")).select("lang", "i", "n", F.col("rests")[F.col("i")].alias("rest"), phrase(max_words).alias("edge"), phrase(max_words - 1).alias("node"))
    longest = steps.select("lang", F.lit(max_words).alias("k"), F.col("edge").alias("phrase"), "n")
    within = steps.where("i > 0").select("lang", F.lit(max_words - 1).alias("k"), F.col("node").alias("phrase"), (F.col("n") + F.col("rest")).alias("n"))
    # flow out of the nodes where paths begin or end: their paths' first weights and their rest
    rest = rests(weighted, max_words).select("lang", F.col("node").alias("phrase"), F.col("rest").alias("n"))
    rest = rest.join(within.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    ends = steps.where("i = 0").select("lang", F.col("node").alias("phrase"), "n").unionByName(rest).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    found = longest.unionByName(within).unionByName(ends.select("lang", F.lit(max_words - 1).alias("k"), "phrase", "n"))
    # flow out of shorter nodes: all that begins with them
    begun = weighted.where((F.col("k") > 0) & (F.col("k") < max_words - 1)).groupBy("lang", "k", F.col("node").alias("phrase")).agg(F.sum("n").alias("n"))
    found = found.unionByName(begun)
    return found.where(F.col("n") >= min_count)


def _parts(phrase: Column, size: Column, least: int, cuts: bool) -> Column:
    """Cuts of a phrase (k, left, right), or the phrases inside it of ``least`` words or more."""
    words = F.split(phrase, " ")
    if cuts:
        return F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("cut"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, size - k), " ").alias("right")))
    inside = lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(least), size - 1), inside)))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, share: int = SHARE, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations (None: all)."""
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have 2 words or more and a count of 1 or more")
    weighted = stored(graph(edges(docs, max_words, text_col, lang_col), max_words, min_count), "graph")
    counts = stored(phrase_counts(weighted, stored(paths(weighted, max_words), "paths"), max_words, min_count), "phrases")
    total = weighted.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    found = counts.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    inside = found.where("k > 2").select("lang", F.explode(_parts(F.col("phrase"), F.col("k"), 2, False)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = found.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a").drop("longer")
    cuts = left.select("lang", "phrase", "a", F.explode(_parts(F.col("phrase"), F.col("k"), 1, True)).alias("c")).select("lang", "phrase", "a", "c.*")
    own = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cuts = cuts.join(own("left", "l"), ["lang", "left"]).join(own("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(16,0))"
    score = F.expr(f"(cast({wide('a')} * {wide('a')} as decimal(31,0)) * cast(1000000 as decimal(7,0))) div (cast({wide('l')} * {wide('r')} as decimal(38,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"))
    scored = scored.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        nth = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= top).drop("rank")
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    else:
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return scored.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
with pieces as (
    select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w
    from (select coalesce(lang, '{UNNAMED}') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from pieces, range(1, {MAX_WORDS + 1}) g(k) where len(w) >= k),
f as materialized (select lang, k, phrase, count(*) as a from grams group by all),
total as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
cand as materialized (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1 and a >= {MIN_COUNT}),
inside as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer from cand, range(2, {MAX_WORDS}) g(m), range(1, {MAX_WORDS}) h(i) where m < k and i + m - 1 <= k group by all),
cuts as (
    select c.lang, c.phrase, c.a, cut, l.a as l, r.a as r, 1000000::hugeint * c.a * c.a // (l.a::hugeint * r.a) as score
    from (select *, unnest(range(1, k)) as cut from cand) c
    join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1:], ' ')),
scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
kept as (select s.* from scored s left join inside i using (lang, phrase) where longer is null or 100 * longer < {SHARE} * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join total using (lang) where rank <= {TOP}
"""
