"""Small tables and plain versions for the operators' tests."""

from __future__ import annotations

import random
from pathlib import Path

DATA = "/root/testdata/sf0.001"
HAVE_DATA = Path(DATA).is_dir()
#: Names that operators use or return, as columns of the input.
CLASHING = "n_words hits hits_0 pii bpe s shard slot maybe odd same u v p before nth row stratum kept spans id key component n_chars bitmap_row bitmap_bits cutoffs of c decoded ids"
WORDS = "of the and to in is it that was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randint(0, 99))]) for _ in range(n))


def documents(spark, rows, extra: bool = False):
    """rows: (doc_id, text) or (doc_id, text, lang, source); columns of the documents table."""
    full = [(*r, *("en", "src")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHING.split() if c not in df.columns})
    return df


def edge_rows(rng: random.Random):
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long = prose(rng, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, long), (5, long), (6, long), (None, "no id " * 60), (None, None), (7, "ß é 字 😀 " * 40), (8, "same text " * 30), (9, "same text " * 30), (10, "#*$%&|<>")]


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
