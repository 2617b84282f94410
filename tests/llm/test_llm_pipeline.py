"""The pipeline against a plain version, stage by stage, and the registered queries."""

from __future__ import annotations

import html
import re

import duckdb
import pytest
from helpers import DATA, HAVE_DATA, documents, edge_rows, got
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import quality
from ledgerloom.llm.registry import ORACLE_SQL, QUERIES
from test_llm_maps import plain_hits, plain_pii
from test_llm_shuffles import plain_counts, plain_near

pytestmark = pytest.mark.skipif(not HAVE_DATA, reason="no driver tables here")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages(spark):
    """Each stage on the documents that the one before keeps; too few labels here to certify a cutoff."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert quality.fit_cutoffs(quality.features(docs), spark.read.parquet(f"{DATA}/labels.parquet")).isEmpty()

    good = stage("quality rules")(spark, docs, DATA)
    counts = {i: plain_counts(t) for i, t in rows}
    rows = [(i, t) for i, t in rows if counts[i][0] >= 50 and 100 * counts[i][4] <= 50 * counts[i][0]]
    assert good.columns == docs.columns and got(good, "doc_id", "text") == sorted(rows, key=repr)

    single = stage("near duplicates")(spark, good, DATA)
    keep = {i for i, _, c in plain_near(rows, 5) if i == c}
    rows = [r for r in rows if r[0] in keep]
    assert single.columns == docs.columns and got(single, "doc_id", "text") == sorted(rows, key=repr)

    clean = stage("benchmark passages")(spark, single, DATA)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    plain = [r for r in rows if not plain_hits(r[1], items)[1]] if len(rows) < 50 else None
    hit = duckdb.sql(ORACLE_SQL["op5_decontaminate"].replace("from documents", f"from '{DATA}/documents.parquet'").replace("from benchmark", f"from '{DATA}/benchmark.parquet'"))
    bad = {r[0] for r in hit.select("doc_id", "contaminated").fetchall() if r[1]}
    rows = [r for r in rows if r[0] not in bad]
    assert plain is None or plain == rows
    assert bad and clean.columns == docs.columns and got(clean, "doc_id", "text") == sorted(rows, key=repr)

    safe = stage("personal data")(spark, clean, DATA)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in safe.collect()}
    names = ["EMAIL", "IP", "CARD", "PHONE"]
    for i, t in rows:
        out, at = "", 0
        for a, k, b in plain_pii(t):
            if a >= at:
                out += t[at:a] + f"[{names[k]}]"
            at = max(at, b)
        assert texts[i] == (out + t[at:], len(out + t[at:]))
    assert safe.columns == docs.columns and any("[EMAIL]" in t for t, _ in texts.values())

    last = stage("byte pair encoding")(spark, safe, DATA)
    assert {r["doc_id"] for r in last.collect()} == {i for i, _ in rows}
    assert got(corpus_pipeline.run(spark, DATA), *last.columns) == got(last, *last.columns)


def test_stages_on_edges(spark):
    import random

    docs = documents(spark, edge_rows(random.Random(2)), extra=True)
    for df in (docs, docs.limit(0), docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])):
        for name, run in corpus_pipeline.STAGES:
            out = run(spark, df, DATA)
            assert out.count() <= df.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    assert got(df, *columns) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_extraction_of_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in QUERIES["op1_extract"](spark, DATA).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)
        text = re.sub(r"<(script|style|form|aside|nav|footer).*?</\1>|<!--.*?-->", "", body[1] if body else "", flags=re.S)
        text = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|br|h1|div|li|ul)[^>]*>", " ", text)))
        assert r["text"] == " ".join(text.split()) and r["n_chars"] == len(r["text"])
