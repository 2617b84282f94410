"""Operators that work on each text alone: extraction, benchmark search, personal data, BPE."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from helpers import documents, edge_rows, got, prose
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, html, pii


def test_extraction():
    main = lambda page: html.main_text(page)["text"]
    assert main(None) == main("") == main("<p>") == ""
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div>"
        "<article><header><h1>Head&amp;line</h1></header><p>One  two\n three<br>four &lt;b&gt; <b>bo</b>ld<p>Second<ul><li>a<li>b</ul><aside>no</aside><form>f</form><div class='comments'><p>reader</div></article><footer>c</footer></body>"
    )
    assert main(page) == "Head&line One two three four <b> bold Second a b"
    free = "<body><div><a href=1>Home</a> <a href=2>About</a></div><div><p>A long text of the page, of many words, again and again it goes on.<p>More of this text, which has many words too, and on it goes here.</div><div><a>x</a> <a>y</a></div>"
    assert main(free) == "A long text of the page, of many words, again and again it goes on. More of this text, which has many words too, and on it goes here."
    assert main("</div></p>stray &#x41;&nbsp;text") == "stray A text"
    assert html.threshold([1.0, 1.0]) < 1.0 < html.threshold([1.0, 9.0]) < 9.0


def test_extraction_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>hi there", "y")], "page_id long, url string, html string, main string")
    found = html.extract(pages.drop("main"), keep=["page_id", "url"])
    assert got(found.select("page_id", "main.text"), "page_id", "text") == [(1, ""), (1, ""), (None, "hi there")]
    assert html.extract(pages.limit(0), keep=["page_id"]).isEmpty()


def plain_hits(text, items):
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    hit, named = set(), set()
    for item, it in items:
        own = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (it or "").encode())]
        m = min(10, len(own))
        for i in range(len(own) - m + 1 if own else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == own[i : i + m]:
                    hit |= set(range(j, j + m))
                    named |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_benchmark_search(spark, block_bytes):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(3, "of the"), (None, "unnamed item here"), (20, None), (21, " .,")]
    rows = edge_rows(rng)
    for i in range(100, 160):
        a, b = rng.choice(items[:12])[1], prose(rng, rng.randint(0, 700))
        rows.append((i, f"{b} {a.upper() if i % 2 else a.replace(' ', ', ')}. {prose(rng, 5)}" if i % 3 else b))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_benchmark(documents(spark, rows, extra=True), benchmark, keep=["doc_id", "n_words", "hits_0"], name="found", block_bytes=block_bytes)
    assert found.columns == ["doc_id", "n_words", "hits_0", "found"]
    own = [(r["doc_id"], r["found"]["n_words"], r["found"]["n_hit"], r["found"]["items"]) for r in found.collect()]
    short = [r for r in rows if r[1] is None or len(r[1]) < 50_000]
    want = [(i, *plain_hits(t, items)) for i, t in short]
    assert sorted((x for x in own if x[1] < 20_000), key=repr) == sorted(want, key=repr)
    assert len([x for x in own if x[1] >= 20_000]) == 3
    assert decontaminate.find_benchmark(documents(spark, rows), benchmark.limit(0), keep=["doc_id"]).where("hits.n_hit > 0").isEmpty()
    assert decontaminate.find_benchmark(documents(spark, rows).limit(0), benchmark).isEmpty()


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_plain_personal_data():
    rng = random.Random(3)
    parts = ["a.b@c-d.com", "x@y", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4242 4242 4242 4242", "4242424242424241", "+1 (319) 555-5132", "+123", "12 34-56", " ", "é字", "@", ".", "+", "7" * 15, "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert pii.plain_spans(text) == plain_pii(text)


DISGUISED = {
    "mail joe [at] example [dot] com now": ("email", "joe [at] example [dot] com"),
    "joe.smith at mail dot example dot org": ("email", "joe.smith at mail dot example dot org"),
    "é x (at) y.com": ("email", "x (at) y.com"),
    "аdmin@ехample.com": ("email", "аdmin@ехample.com"),
    "joe​@exam­ple.com": ("email", "joe​@exam­ple.com"),
    "１９２.168.0.1 here": ("ip", "１９２.168.0.1"),
    "one nine two dot one six eight dot zero dot one": ("ip", "one nine two dot one six eight dot zero dot one"),
    "call plus one five five five one two three four five six seven ok": ("phone", "plus one five five five one two three four five six seven"),
    "pay four two four two, four two four two, four two four two, four two four two": ("card", "four two four two, four two four two, four two four two, four two four two"),
}


def test_disguised_personal_data():
    find = pii.Finder().spans
    for text, want in DISGUISED.items():
        assert [(pii.KINDS[k], text[a:b]) for a, k, b, base in find(text) if not base] == [want], text
    clean = ["see me at home. Then dot com", "meet at noon.It", "one two three", "un deux trois quatre cinq six", "the 1.2 at 3.4 of a", "пример текста о доме"]
    assert not any(map(find, clean))


def test_masking_and_edges(spark):
    rng = random.Random(4)
    rows = [*edge_rows(rng), (50, "write a@b.com or +1 (319) 555-5132, joe [at] x [dot] org, bye"), (51, "a@b.com"), (52, "😀 a@b.com 😀")]
    docs = documents(spark, rows, extra=True)
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in masked.where("doc_id >= 50 or doc_id < 4").collect()}
    assert texts == {1: None, 2: "", 3: " \n\t ", 50: "write [EMAIL] or [PHONE], [EMAIL], bye", 51: "[EMAIL]", 52: "😀 [EMAIL] 😀"}
    assert pii.mask_pii(docs.limit(0)).isEmpty()


def test_bpe(spark):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    rng = random.Random(1)
    parts = [*"ab'sTt .\n\t  éß#|<>19,-", " ", "　", "​", "字", "😀", "<|endoftext|>", "'ll", "n't", "\r\n", "the ", "  ", "<|endof", "text|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    with open(bpe.default_tokenizer(), "rb") as file:
        codec = bpe.Codec(file.read())
    for text in texts:
        ids = own.encode(text, add_special_tokens=False).ids
        assert [int(i) for part in codec.encode(text) for i in part] == ids, text
        assert "".join(codec.decode([ids[:7], ids[7:]])) == own.decode(ids, skip_special_tokens=False)
    rows = edge_rows(rng)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))))
    docs = documents(spark, rows, extra=True)
    assert got(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.digests(docs.limit(0)).isEmpty()
    kept = bpe.encode_bpe(docs.withColumn("bpe2", F.lit(1)), keep=["doc_id", "bpe", "text"], name="coded")
    assert kept.columns == ["doc_id", "bpe", "text", "coded"]
    back = bpe.decode_bpe(kept.select("text", F.col("coded.ids").alias("ids")), "ids", keep=["text"])
    assert back.where("coalesce(text, '') <> decoded.text").isEmpty()


def test_bpe_slices_and_cache(monkeypatch):
    """Slices, calls and caches of any size give the same ids; one token of megabytes is encoded whole."""
    import tokenizers

    own = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    rng = random.Random(8)
    text = prose(rng, 3000) + "x" * 500 + "\n" * 300 + "".join(rng.choice("aé字😀 .") for _ in range(2000))
    want = own.encode(text, add_special_tokens=False).ids
    with open(bpe.default_tokenizer(), "rb") as file:
        content = file.read()
    for size, cache, at_once in ((1, 1000, 3), (100, 5000, 7), (4096, 1, 100)):
        monkeypatch.setattr(bpe, "SLICE", size)
        monkeypatch.setattr(bpe, "CACHE_BYTES", cache)
        monkeypatch.setattr(bpe, "AT_ONCE", at_once)
        codec = bpe.Codec(content)
        assert [int(i) for part in codec.encode(text) for i in part] == want
        assert len(codec.cache) * 220 <= cache + 1000
    monkeypatch.undo()
    long = "".join(rng.choice("ab") for _ in range(1 << 20))
    assert "".join(codec.decode(codec.encode(long))) == long
