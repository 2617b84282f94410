"""Secrets in texts: known shapes, and long tokens that a battery of tests finds random.

The known shapes are assignments to a secret's name, access keys and long hexadecimal runs. Every
token of at least ``TOKEN`` characters is a candidate besides. Its encoding is inferred from its
characters (hexadecimal, base 32, base 64), and three tests compare it with ordinary text or
identifiers written in that alphabet:

* uniformity: the chi-squared statistic over the alphabet, against its law for a source whose
  characters coincide as often as in text (noncentral chi-squared, by its mean and variance);
* runs: the number of runs of digits, capitals and small letters, against a source that changes
  class as seldom as identifiers do;
* serial correlation of neighbouring characters, against sequences, by Fisher's transformation.

The three normal scores are added. They aren't independent, and ordinary tokens differ from corpus to
corpus, so the law of the sum is taken from the corpus (an empirical null in Efron's sense): for each
encoding its middle is the median of all candidates and its width the distance from there down to the
16 % quantile, both drawn towards the law of three independent scores as if ``PRIOR`` tokens had
followed that, and never below it, so that p-values only become more careful. The lower tail of the
chi-squared statistic is lighter than the normal one, which errs on the same side. The false-discovery
rate over all candidates of the corpus is held at ``FDR`` by the weighted procedure of Benjamini and
Hochberg, with weights in proportion to a token's length, as a longer token carries more evidence.
The corpus is read once; p-values are counted in fixed bins, so the driver gets at most ``BINS``
numbers, and two for each encoding.

Known shapes are placed by running sums over blocks of matches, and tokens of more than ``PIECE``
characters are tested in equal pieces whose scores are put together, so that neither many matches nor
one endless token take more than their share of time and memory.

All of it is DataFrame code. Defined cases: null counts as empty; texts are searched whole; repeated
rows are each searched for themselves and each of their tokens is a candidate; an empty table has no
candidates; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table

KINDS = ["assign", "access", "hex", "random"]
NAMES = ["password", "passwd", "secret", "token"]


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: As Java expressions; the letters of names in either case, without case folding beyond ASCII.
ASSIGN = rf"""({"|".join(map(_any_case, NAMES))}|{_any_case("api")}_?{_any_case("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
LEAST_VALUE = 6
TOKEN = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{TOKEN},}}+"

#: Encoding: expression, alphabet, how often two characters coincide in text written in it.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.18),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065),
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.06),
}
#: How often identifiers change between digits, capitals and small letters; a sequence's correlation.
CLASS_CHANGE, SEQUENCE = 0.3, 0.5
FDR = 0.01
BINS = 3000
#: Tokens whose scores the fitted law is drawn from beside those of the corpus.
PRIOR = 50
#: Characters of a token that are tested at once, and lengths that are summed up in a block.
PIECE, BLOCK = 4096, 256


def running(lengths: Column) -> Column:
    """Of each of the lengths the sum of those before it; block by block, as arrays can't be appended to in place."""
    size = F.size(lengths)
    parts = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    upto = lambda values, begin: F.aggregate(values, F.array(begin), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def placed(parts: Column) -> Column:
        begins = upto(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x)), F.lit(0))
        each = F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), upto)
        return F.flatten(F.transform(each, lambda e: F.slice(e, F.lit(1), F.size(e) - 1)))

    return F.when(size > 0, let(parts, placed)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Spans [start, end) in code points of the pattern's leftmost matches that don't overlap.

    Matches whose ``group`` is shorter than ``least`` are left out, after they took their place.
    """
    rx, none = F.lit(pattern), F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda g: F.length(g))
        sizes = F.transform(hits, lambda h: F.length(h))

        def spans(v: Column) -> Column:
            begins = F.zip_with(running(F.zip_with(v["gaps"], v["sizes"], lambda g, n: g + n)), v["gaps"], lambda before, g: before + g)
            return F.zip_with(begins, v["sizes"], lambda a, n: F.struct(a.alias("start"), (a + n).alias("end")))

        found = let(F.struct(gaps.alias("gaps"), sizes.alias("sizes")), spans)
        if least:
            values = F.transform(F.regexp_extract_all(text, rx, F.lit(group)), lambda v: F.length(v) >= least)
            kept = F.filter(F.zip_with(found, values, lambda s, ok: F.struct(s.alias("s"), ok.alias("ok"))), lambda x: x["ok"])
            found = F.transform(kept, lambda x: x["s"])
        return F.when(F.size(hits) > 0, found).otherwise(none)

    return let(F.regexp_extract_all(text, rx, F.lit(0)), placed)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal law (the rational form 26.2.17 of Abramowitz and Stegun), above 1e-300."""
    a = F.least(F.abs(z), F.lit(36.0))
    t = 1 / (1 + 0.2316419 * a)
    q = F.exp(-a * a / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, q).otherwise(1 - q)


def _piece_score(text: Column, alphabet: Column, coincide: Column) -> Column:
    """The sum of the three scores of one piece of a token."""
    n = F.length(text).cast("double")

    def tested(c: Column) -> Column:
        codes, k = c["codes"], F.length(alphabet).cast("double")
        squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter(codes, lambda y: y == x)).cast("double"), F.lit(2.0)))
        chi = squares * k / n - n
        excess = n * (k * coincide - 1)
        uniform = (k - 1 + excess - chi) / F.sqrt(2 * (k - 1 + 2 * excess))
        changes = F.size(F.regexp_extract_all(F.translate(text, "+/=", ""), F.lit("[0-9]+|[a-z]+|[A-Z]+"), F.lit(0))) - 1
        runs = (changes - (n - 1) * CLASS_CHANGE) / F.sqrt((n - 1) * CLASS_CHANGE * (1 - CLASS_CHANGE))
        mean = F.aggregate(codes, F.lit(0.0), lambda s, x: s + x) / n

        def correlated(m: Column) -> Column:
            square = F.aggregate(codes, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
            cross = F.aggregate(F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda x, y: F.coalesce((x - m) * (y - m), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
            r = F.when(square > 0, F.least(F.abs(cross / square), F.lit(0.999))).otherwise(F.lit(0.999))
            return (F.atanh(F.lit(SEQUENCE)) - F.atanh(r)) * F.sqrt(n - 3)

        return uniform + runs + let(mean, correlated)

    codes = F.transform(F.split(text, ""), lambda ch: (F.instr(alphabet, ch) - 1).cast("double"))
    return let(F.struct(codes.alias("codes")), tested)


def randomness(token: Column) -> Column:
    """encoding and score of a token: how random it looks against ordinary text in that encoding; 3 independent normal scores would have a sum of variance 3."""
    core = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")

    def scored(v: Column) -> Column:
        text, n = v["core"], F.length(v["core"])
        is_hex, is_32 = text.rlike(ENCODINGS["hex"][0]), text.rlike(ENCODINGS["base32"][0])
        kind = F.when(is_hex, "hex").when(is_32, "base32").otherwise("base64")
        pick = lambda i: F.when(is_hex, F.lit(ENCODINGS["hex"][i])).when(is_32, F.lit(ENCODINGS["base32"][i])).otherwise(F.lit(ENCODINGS["base64"][i]))
        lower = F.when(is_hex, F.lower(text)).otherwise(text)

        def pieced(x: Column) -> Column:
            size = F.ceil(n / x["pieces"]).cast("int")
            total = F.aggregate(F.sequence(F.lit(0), x["pieces"] - 1), F.lit(0.0), lambda acc, i: acc + _piece_score(F.substring(x["text"], i * size + 1, size), x["alphabet"], x["coincide"]))
            return total / F.sqrt(x["pieces"].cast("double"))

        made = F.struct(lower.alias("text"), pick(1).alias("alphabet"), pick(2).alias("coincide"), F.ceil(n / PIECE).cast("int").alias("pieces"))
        return F.struct(kind.alias("encoding"), F.when(n >= TOKEN - 4, let(made, pieced)).otherwise(F.lit(-99.0)).alias("score"))

    return let(F.struct(core.alias("core")), scored)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (known shapes: start, kind number, end) and candidates (start, end, encoding, score)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    base = F.sort_array(F.concat(marked(spans_of(text, ASSIGN, LEAST_VALUE, 2), 0), marked(spans_of(text, ACCESS), 1), marked(spans_of(text, HEX), 2)))
    tokens = F.transform(spans_of(text, CANDIDATE), lambda s: let(randomness(F.substring(text, s["start"] + 1, s["end"] - s["start"])), lambda r: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["encoding"].alias("encoding"), r["score"].alias("score"))))
    return docs.select(F.col(id_col).alias("doc_id"), base.alias("base"), tokens.alias("candidates"))


def fitted(tokens: DataFrame) -> dict[str, tuple[float, float]]:
    """Middle and width of the law of ordinary tokens' scores, by encoding; from encoding and score of all candidates."""
    width = math.sqrt(3)
    laws = dict.fromkeys(ENCODINGS, (0.0, width))
    for r in tokens.groupBy("encoding").agg(F.count("*").alias("n"), F.percentile_approx("score", [0.16, 0.5], 10_000).alias("q")).collect():
        share = r["n"] / (r["n"] + PRIOR)
        low, middle = r["q"]
        laws[r["encoding"]] = (max(0.0, share * middle), max(width, share * (middle - low) + (1 - share) * width))
    return laws


def discovered(found: DataFrame, fdr: float = FDR) -> tuple[dict[str, tuple[float, float]], float, int | None]:
    """The laws of ordinary tokens, the mean length of the candidates, and the bin from which on they are discoveries (None: none is)."""
    tokens = found.select(F.explode("candidates").alias("c")).select((F.col("c.end") - F.col("c.start")).alias("n"), "c.encoding", "c.score")
    laws = fitted(tokens)
    total, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    if not total:
        return laws, 1.0, None
    at, best = 0, None
    for b, count in sorted(tokens.groupBy(_bin(_standard(F.col("encoding"), F.col("score"), laws), F.col("n"), mean).alias("bin")).count().collect(), reverse=True):
        at += count
        if 10 ** (-b / 10) * total / at <= fdr:
            best = b
    return laws, mean, best


def _standard(encoding: Column, score: Column, laws: dict[str, tuple[float, float]]) -> Column:
    out = F.lit(None).cast("double")
    for name, (middle, width) in laws.items():
        out = F.when(encoding == name, (score - middle) / width).otherwise(out)
    return out


def _bin(score: Column, n: Column, mean: float) -> Column:
    """Tenths of a power of ten by which the token's weighted p-value lies below 1."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(-10 * F.log10(upper_tail(score) * mean / n)))).cast("int")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind number, end); spans also has the random tokens."""
    found = cut(scan(docs, id_col, text_col))
    laws, mean, least = discovered(found, fdr)
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    random = F.filter("candidates", lambda c: (_bin(_standard(c["encoding"], c["score"], laws), c["end"] - c["start"], mean) >= (BINS + 1 if least is None else least)) & apart(c))
    more = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("doc_id", *map(count, range(3)), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
