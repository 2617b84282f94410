"""Quality rules whose cutoffs carry a guarantee against false rejection.

Every document gets counts of words, symbols, repeated lines and repeated word windows. The base
rule rejects very short and very repetitive texts. Further rules (``RULES``) reject a document when
an integer score exceeds a cutoff, and the cutoffs are chosen from labelled documents:

* a stratum is a language; good labelled documents that pass the base rule are its holdout;
* the pairs of a rule and a cutoff that reject bad labelled documents are put in an order, by how much
  more often they reject those than documents without a label. This order knows nothing of the
  holdout;
* the pairs join the verdict in this order, one more at each step. A step is certified when the exact
  binomial test rejects "the rules of this step together lose at least ``alpha`` of the good
  documents", and the walk ends at the first step that isn't (fixed sequence, so that all rules of a
  stratum share one level and no further correction is needed for them);
* over strata the level is divided by the number of those that are large enough to pass at all
  (Bonferroni with Tarone's count), so all guarantees hold together with probability ``1 - delta``.
  The last certified step decides; a stratum with too few labels to certify one keeps its documents.

Everything is DataFrame code. The corpus is read once for the counts; what is gathered for the fit
is one row per stratum, rule and score level, whatever the corpus size.

Defined cases: null or blank text has no words and fails the base rule; a null stratum is a stratum;
null labels are ignored; a document labelled twice counts with its lowest label; repeated rows are
judged each for itself; other columns of the input are not read, so their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, cut, free_name, let, marked, table

MIN_WORDS = 50
ALPHA = 0.02
DELTA = 0.05
#: Rule: score in thousandths (an SQL expression over the counts), first cutoff, step, cutoffs.
RULES = {
    "symbols_per_word": ("n_symbols * 1000 div n_words", 50, 50, 40),
    "repeated_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 50, 25, 38),
    "repeated_words": ("n_repeat_words * 1000 div n_words", 50, 25, 38),
    "long_words": ("word_chars * 1000 div n_words", 5000, 250, 40),
    "short_words": ("-(word_chars * 1000 div n_words)", -5000, 100, 40),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside a three-word window that the text has more than once.

    Each window becomes a long: its hash with the low bits replaced by its position. Sorting these
    brings equal windows together; neighbours with equal hashes are compared by their words.
    """
    keep = F.expr("-1L")

    def marked(mask: Column) -> Column:
        packed = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(mask.bitwiseXOR(keep)).bitwiseOR(i.cast("long")),
        )

        def covered(s: Column) -> Column:
            at = lambda k: F.get(s, k).bitwiseAND(mask).cast("int")
            same = lambda k: F.get(s, k).bitwiseXOR(F.get(s, k - 1)) <= mask
            equal = lambda p, q: (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))
            hits = F.filter(F.sequence(F.lit(1), n - 3), lambda k: (F.get(s, k).bitwiseXOR(F.get(s, k - 1)) >= 0) & same(k) & equal(at(k), at(k - 1)))
            spots = F.transform(hits, lambda k: F.array(*[at(j) + d for j in (k, k - 1) for d in (0, 1, 2)]))
            return F.size(F.array_distinct(F.flatten(spots)))

        return let(F.sort_array(packed), covered)

    bits = F.ceil(F.log2(n.cast("double"))).cast("int")
    return F.when(n >= 4, let(F.expr("1L") * F.pow(F.lit(2.0), bits).cast("long") - 1, marked)).otherwise(F.lit(0))


def text_counts(text: Column) -> Column:
    """A struct of the counts of one text; all are long and not null."""
    whole = F.coalesce(text, F.lit(""))
    body = F.trim(whole, F.lit(SPACES))

    def counted(words: Column) -> Column:
        n = F.when(F.get(words, F.lit(0)) == "", F.lit(0)).otherwise(F.size(words))
        lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
        symbols = F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))
        return let(
            F.struct(n.alias("n"), lines.alias("lines")),
            lambda v: F.struct(
                v["n"].cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                (F.size(v["lines"]) - F.size(F.array_distinct(v["lines"]))).cast("long").alias("n_dup_lines"),
                _repeat_words(words, v["n"]).cast("long").alias("n_repeat_words"),
                F.size(v["lines"]).cast("long").alias("n_lines"),
            ),
        )

    return let(F.split(body, SPACE_RUN, -1), counted)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """One narrow row per document: id, stratum, counts, base verdict."""
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum).alias("stratum"), text_counts(F.col(text_col)).alias("c"))
    return counted.select("doc_id", "stratum", "c.*").withColumn("base_failed", base_failed())


#: Rows by stratum and rule of so many at most are broadcast.
BROADCAST_ROWS = 100_000


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if they are few by count."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _scored(rows: DataFrame) -> DataFrame:
    """A row per document and rule; level: how many of the rule's cutoffs the score exceeds."""
    rules = [
        F.expr(f"named_struct('rule', '{rule}', 'level', least({k}L, greatest(0L, (({score}) - {lo} + {step - 1}) div {step})))") for rule, (score, lo, step, k) in RULES.items()
    ]
    return rows.select("*", F.inline(F.array(*rules)))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), by its terms in logarithms; exact to double precision."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("t"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1).cast("double") / i.cast("double")) + odds
        return F.struct(t.alias("t"), (acc["sum"] + F.exp(t)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, start, step, lambda acc: acc["sum"])


def fit_cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: stratum, rule, cutoff, n_good, false_rejections, p_value.

    ``rows`` as from :func:`features`; ``labels``: doc_id and quality (1 good, 0 bad). The last three
    are those of the whole last certified step of the stratum.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = rows.where("not base_failed")
    # without a label, the quality is null
    scored = _scored(passed.select("doc_id", "stratum", *COUNTS, "n_lines").join(known, "doc_id", "left"))
    levels = cut(scored.groupBy("stratum", "rule", "level").agg(*[F.count(F.when(is_, 1)).alias(name) for name, is_ in (("good", F.col("quality") == 1), ("bad", F.col("quality") == 0), ("other", F.col("quality").isNull()))]))
    path = cut(_path(levels))
    # the first step that rejects a good document: the least one among the cutoffs that its scores exceed
    held = _scored(passed.join(known.where("quality = 1"), "doc_id").withColumn("nth", F.monotonically_increasing_id())).where("level > 0")
    reached = path.withColumn("first", F.min("step").over(Window.partitionBy("stratum", "rule").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reached = reached.select(F.col("stratum").alias("of"), F.col("rule").alias("by"), "j", "first")
    lost = held.join(_small(reached), F.col("stratum").eqNullSafe(F.col("of")) & (F.col("rule") == F.col("by")) & (F.col("level") - 1 == F.col("j")))
    lost = lost.groupBy("nth", "stratum").agg(F.min("first").alias("first"))
    at = lost.where("first is not null").groupBy("stratum", "first").agg(F.count("*").alias("lost"))
    # every document has one level for each rule, so one rule counts the good ones
    one = next(iter(RULES))
    goods = levels.where(F.col("rule") == one).groupBy("stratum").agg(F.sum("good").alias("n_good"))
    n_strata = _tested(goods, alpha, delta)
    order = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = _joined(path.where("step is not null"), goods)
    steps = _joined(steps, at.withColumnRenamed("first", "step"), "step")
    steps = steps.withColumn("false_rejections", F.sum(F.coalesce("lost", F.lit(0))).over(order))
    steps = steps.withColumn("p_value", F.when(F.col("false_rejections") < alpha * F.col("n_good"), binomial_tail(F.col("false_rejections"), F.col("n_good"), alpha)).otherwise(F.lit(1.0)))
    certified = steps.withColumn("ok", F.min(F.col("p_value") <= delta / n_strata).over(order)).where("ok")
    value = F.expr("case rule " + " ".join(f"when '{r}' then {lo} + j * {step}" for r, (_, lo, step, _) in RULES.items()) + " end")
    last = certified.groupBy("stratum").agg(F.max_by(F.struct("n_good", "false_rejections", "p_value"), "step").alias("last"))
    best = certified.groupBy("stratum", "rule").agg(F.min(value).alias("cutoff"))
    return _joined(best, last).select("stratum", "rule", "cutoff", "last.*")


def _tested(goods: DataFrame, alpha: float, delta: float) -> int:
    """By how many strata the level is divided: Tarone's count, which leaves out those that are too small to pass in any case.

    It is the least k for which at most k strata could reach ``delta / k`` without one false rejection.
    """
    size = Window.orderBy(F.col("n_good").desc(), "stratum")  # one row for each stratum
    ranked = goods.where("n_good > 0").select(F.row_number().over(size).alias("k"), F.lead("n_good").over(size).alias("next"))
    enough = F.col("next").isNull() | (F.pow(F.lit(1 - alpha), F.col("next")) > F.lit(delta) / F.col("k"))
    return ranked.where(enough).agg(F.min("k")).first()[0] or 1


def _joined(rows: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with what ``more`` has of their stratum (null is one) and of the other keys."""
    names = ["stratum", *keys]
    right = more.select(*[F.col(c).alias(f"of_{c}" if c in names else c) for c in more.columns])
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return rows.join(right, on, "left").drop(*[f"of_{c}" for c in names])


def _path(levels: DataFrame) -> DataFrame:
    """All pairs (stratum, rule, j) of a rule and its j-th cutoff; step: the pair's place in the order of its stratum, or null.

    A pair has a place if it rejects bad labelled documents, at a greater share than unlabelled ones.
    """
    grid = F.expr("case rule " + " ".join(f"when '{r}' then {k}" for r, (_, _, _, k) in RULES.items()) + " end")
    seen = levels.groupBy("stratum", "rule").agg(F.sum("bad").alias("n_bad"), F.sum("other").alias("n_other"), F.collect_list(F.struct("level", "bad", "other")).alias("seen"))
    each = seen.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (grid - 1).cast("long"))).alias("j"))
    total = lambda what: F.aggregate(F.filter("seen", lambda s: s["level"] > F.col("j")), F.lit(0).cast("long"), lambda a, s: a + s[what])
    each = each.select("stratum", "rule", "j", "n_bad", "n_other", total("bad").alias("bad"), total("other").alias("other"))
    # shares with one unlabelled document more, so that they compare without a division by zero
    gain = (F.col("bad") / F.col("n_bad")) / ((F.col("other") + 1) / (F.col("n_other") + 1))
    useful = each.withColumn("gain", F.when(F.col("bad") > 0, gain)).withColumn("useful", F.coalesce(F.col("gain") > 1, F.lit(False)))
    ranked = useful.withColumn("nth", F.row_number().over(Window.partitionBy("stratum", "useful").orderBy(F.col("gain").desc(), F.col("bad").desc(), "rule", F.col("j").desc())))
    return ranked.select("stratum", "rule", "j", F.when(F.col("useful"), F.col("nth")).alias("step"))


def judge(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: false where the base rule or a certified rule of the stratum rejects."""
    by = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    own = rows.join(by.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = [F.coalesce(F.expr(f"({score}) > cutoffs['{rule}']"), F.lit(False)) for rule, (score, *_) in RULES.items()]
    fails = over[0]
    for x in over[1:]:
        fails = fails | x
    return own.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~fails)).drop("of", "cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts and verdict per document: doc_id, stratum, counts, n_lines, base_failed, kept."""
    rows = cut(features(docs))
    return judge(rows, fit_cutoffs(rows, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    Counts depend on the text alone, so the pass that fits the cutoffs also tells, by a bitmap of
    hashed texts and strata, which rows are certainly kept; only the others are counted again. No text
    is shuffled or stored.
    """
    text, of = F.col(f"`{text_col}`"), F.col(f"`{stratum}`")
    mark = free_name(docs, "mark")
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), of.alias("stratum"), text.alias("text"), F.xxhash64(text, of).alias("key"))
    rows = cut(keyed.select("doc_id", "stratum", "key", text_counts(F.col("text")).alias("c")).select("doc_id", "stratum", "key", "c.*").withColumn("base_failed", base_failed()))
    cutoffs = _small(cut(fit_cutoffs(rows.drop("key"), labels)))
    rejected = judge(rows, cutoffs).where("not kept").select("key")
    flagged = marked(docs, F.xxhash64(text, of), rejected, "key", mark)
    counted = flagged.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), of.alias("stratum"), F.col(mark).alias("mark"), F.when(F.col(mark), text_counts(text)).alias("c"))
    judged = judge(counted.select("row", "stratum", "mark", "c.*").withColumn("base_failed", base_failed()), cutoffs)
    return judged.where("not mark or kept").select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept")
