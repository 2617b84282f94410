"""Cases of the first round's advice: what an operator left out or got wrong."""

from __future__ import annotations

import itertools
import random
import re

import pandas as pd
import pytest
from helpers import DATA, HAVE_DATA, documents, prose
from test_llm_shuffles import plain_removal

from ledgerloom.llm import html, near_dedup, pii, substrings

PARAGRAPH = "A long paragraph of the page's own text, of many words, so that its ratio is high and it stands out among all the other lines."


def test_extraction_selects_by_ratio():
    main = lambda page: html.main_text(page)["text"]
    lists = "<ul><li><a href=1>Other story one</a><li><a href=2>Other story two</a><li><a href=3>And a third one</a></ul><div><h3><a href=4>A teaser's title here</a></h3><p>Some words of it.</div><div><h3><a href=5>Next teaser's title</a></h3><p>More words of it.</div>"
    text = f"<h1>Title</h1><p>{PARAGRAPH}<p>Short.<p>{PARAGRAPH}<p>{PARAGRAPH}<ul><li>a<li>b</ul>"
    assert main(f"<body><main>{text}{lists}</main></body>") == f"Title {PARAGRAPH} Short. {PARAGRAPH} {PARAGRAPH} a b"
    teasers = "<div><article><a href=1>Teaser</a><p>Few words</article><article><a href=2>Teaser</a><p>Few words</article></div>"
    assert main(f"<body>{teasers}<div>{text}</div></body>").startswith(f"Title {PARAGRAPH} Short. {PARAGRAPH} {PARAGRAPH}")
    assert "Teaser" not in main(f"<body>{teasers}<div>{text}</div></body>")
    assert main("<article><a href=1>only links</a></article>") == "only links"


@pytest.mark.skipif(not HAVE_DATA, reason="no data")
def test_extraction_without_article_tags(spark):
    same = total = right = 0
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        with_tags = html.main_text(r["html"])["text"]
        without = html.main_text(re.sub(r"</?article>", "", r["html"] or ""))["text"]
        total += len(with_tags)
        right += len(without)
        same += with_tags == without
        assert without in with_tags or set(without.split()) <= set(with_tags.split())
    assert right > 0.9 * total and same > 0


def test_extraction_doubts_class_names():
    main = lambda page: html.main_text(page)["text"]
    text = f"<h1>Title</h1><p>{PARAGRAPH}<p>{PARAGRAPH}<p>{PARAGRAPH}"
    want = f"Title {PARAGRAPH} {PARAGRAPH} {PARAGRAPH}"
    for name in ("has-sidebar", "no-sidebar", "layout--sidebar-right", "sidebar", "widget"):
        assert main(f"<body><div class='{name}'><p>aside<article>{text}</article></div></body>") == want
        assert main(f"<body><div class='{name}'>{text}</div></body>") == want
    for name in ("article-header", "header"):
        assert main(f"<article><div class='{name}'><h1>Title</h1></div><p>{PARAGRAPH}<p>{PARAGRAPH}<p>{PARAGRAPH}</article>") == want
    for name in ("ad", "ad-1", "AD", "cookie-banner", "comments share"):
        assert main(f"<body><div class='{name}'>Buy this now, it is cheap.</div><article>{text}<div class='{name}'>Buy this now.</div></article></body>") == want
        assert main(f"<body>{text}<div class='{name}'>Buy this now.</div></body>") == want
    assert main(f"<article>{text}<p class='notice'>{PARAGRAPH} {PARAGRAPH}</article>") == f"{want} {PARAGRAPH} {PARAGRAPH}"
    # an advert longer than the article doesn't displace it
    assert main("<body><div class='ad'>Some words that are more than the article has.</div><article><p>Few.</article></body>") == "Few."


MIXED = {
    "call plus one 555 555 0123": ("phone", "plus one 555 555 0123"),
    "one dot 92 dot 168 dot 1": ("ip", "one dot 92 dot 168 dot 1"),
    "call plus 1 five five five five oh one two three four five ok": ("phone", "plus 1 five five five five oh one two three four five"),
    "plus one (555) 555 0123 x": ("phone", "plus one (555) 555 0123"),
    "PLUS 1 555 555 0123": ("phone", "PLUS 1 555 555 0123"),
    "é plus\u00a0one\u00a0555 555 0123": ("phone", "plus\u00a0one\u00a0555 555 0123"),
    "1 dot 92 dot one six eight dot 1": ("ip", "1 dot 92 dot one six eight dot 1"),
    "item 300, one nine two dot one six eight dot zero dot one": ("ip", "one nine two dot one six eight dot zero dot one"),
    "pay 4242, four two four two, 4242, 4242": ("card", "4242, four two four two, 4242, 4242"),
}


def test_spelled_digits_with_figures():
    find = pii.Finder().spans
    for text, want in MIXED.items():
        for around in ("", " and one of them, no two"):  # other words of the text don't matter
            assert [(pii.KINDS[k], (text + around)[a:b]) for a, k, b, _ in find(text + around)] == [want], text
    clean = ["one plus one is two", "plus 5 of 100 dogs", "the un 12 of 2020-12-11", "one 12 and 3 dot 4", "plus"]
    assert not any(map(find, clean))


def test_copies_open_no_more_contexts(spark, monkeypatch):
    rng = random.Random(8)
    text = prose(rng, 120)
    changed = f"{text[:300]} one changed line {text[330:]}"
    rows_of = substrings._context_rows

    def contexts(copies, hot):
        made = spark.sparkContext.accumulator(0)

        def counted(batches):
            for out in rows_of(batches):
                made.add(len(out))
                yield out

        monkeypatch.setattr(substrings, "_context_rows", counted)
        rows = [(i, text) for i in range(copies)] + [(1000, changed)]
        found = substrings.remove_repeats(documents(spark, rows).repartition(12), hot_key=hot)
        own = sorted(((r["doc_id"], r["n_bytes"], [list(s) for s in r["spans"]], bytes(r["kept"])) for r in found.collect()), key=repr)
        assert own == plain_removal(rows)
        return made.value

    emitted = [contexts(copies, 10**6) for copies in (2, 60)]
    assert emitted[0] == emitted[1] > 0
    # the bucket is as hot as its contexts are many, not as its copies
    assert contexts(60, 50) == emitted[0]


def bucket(spark, sizes, key=1):
    of = [c for c, n in enumerate(sizes) for _ in range(n)]
    return [(key, 1000 * key + i, 1000 * key + c, len(of)) for i, c in enumerate(of)]


def test_blocks_pair_components_only(spark):
    rows = [x for k, sizes in enumerate([[600, 1], [40, 25, 3, 1, 1, 1], [1] * 35, [30, 30], [5, 2]]) for x in bucket(spark, sizes, k)]
    dealt = near_dedup._dealt(spark.createDataFrame(rows, "key long, id long, component long, c long").selectExpr("*", "1 as weight"), "key", 10).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r["key"], r["x"], r["y"]), ([], []))[r["side"]].append(r["id"])
    met = {frozenset(p) for (_, x, y), (a, b) in groups.items() for p in (itertools.combinations(a, 2) if x == y else itertools.product(a, b))}
    for a, b in itertools.combinations(rows, 2):
        assert a[0] != b[0] or a[2] == b[2] or frozenset((a[1], b[1])) in met
    # one stray against the blocks of a large component, which meet nothing else
    assert sum(r["key"] == 0 for r in dealt) == 600 + 61


def test_signature_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SIGNATURES", 10)
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 20)
    monkeypatch.setattr(near_dedup, "_across", lambda least: lambda group: pd.DataFrame({"id": [len(group)]}))
    found = object.__new__(near_dedup.NearDuplicates)
    found.least = near_dedup.LEAST_AGREEING
    rows = bucket(spark, [1] * 200)
    found.classes = spark.createDataFrame([(r[1], b"x") for r in rows], "id long, sig binary")
    sizes = found._close(spark.createDataFrame(rows, "key long, id long, component long, c long"), spark.createDataFrame([], "id long, to long"))
    assert max(r["id"] for r in sizes.collect()) <= 200
