"""Operators that compare texts with each other, or with labels: 2, 3, 4, 6, 7, 9 and components."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from helpers import documents, edge_rows, got, prose
from pyspark.sql import functions as F

from ledgerloom.llm import common, near_dedup, quality, secrets, sharding, substrings, warc
from ledgerloom.llm.components import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5040)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == want and found.count() == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_bitmap(spark):
    df = spark.range(20_000).withColumn("maybe", F.lit(1))
    members = spark.range(0, 20_000, 7).withColumnRenamed("id", "m")
    kept = common.maybe_in(df, F.col("id"), members, "m")
    ids = {r["id"] for r in kept.collect()}
    assert kept.columns == df.columns and ids >= set(range(0, 20_000, 7)) and len(ids) < 3100
    assert common.maybe_in(df, F.col("id"), members.limit(0), "m").isEmpty()


# --- archives ---


def test_archives(spark):
    big = "payload é " * 200
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "", big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", "\r\n\r\nWARC/1.0\r\n filedesc://x\n" * 50), (9, "u", "x" * 1000), (10, "u", "x" * 1000), (11, "u", "y" * 999), (12, "u", "y" * 999)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, value string").repartition(3)
    back = warc.read_warc(spark, warc.write_warc(warc.convert(warc.read_arc(spark, warc.write_arc(pages)))))
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        keeper = max((r[0] for r in rows if r[2] == html and r[0] is not None), default=None) if len(b) >= 1000 else i
        revisit = keeper != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert got(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert {r["url"] for r in back.collect()} == {"http://a/%20b", "-", "u"}
    assert {bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()} == {r[2] or "" for r in rows}
    assert {r["version"] for r in warc.read_arc(spark, warc.write_arc(pages)).collect()} <= {1, 2}
    assert warc.read_warc(spark, warc.write_warc(warc.convert(warc.read_arc(spark, warc.write_arc(pages.limit(0)))))).isEmpty()


def test_archive_formats():
    two = f"filedesc://f 0.0.0.0 20010101000000 text/plain 200 - - 0 f {len(warc.ARC_FIELDS[2]) + 8}\n2 0 org\n{warc.ARC_FIELDS[2]}\n\nhttp://x 1.2.3.4 19990102030405 text/html 200 - - 0 f 5\nhello\n"
    one = f"filedesc://f 0.0.0.0 19970101000000 text/plain {len(warc.ARC_FIELDS[1]) + 8}\n1 0 org\n{warc.ARC_FIELDS[1]}\n\nhttp://y 1.2.3.4 19990102030405 text/plain 3\na\nb\n"
    found = list(warc.parse_arc((two + one).encode()))
    assert [(r["version"], r["url"], r["payload"], r["head"]) for r in found] == [(2, "http://x", b"hello", b""), (1, "http://y", b"a\nb", b"")]
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc((one[:-3]).encode()))
    with pytest.raises(ValueError, match="fields"):
        list(warc.parse_arc((one + "http://z 1 2 3 4 5 0\n").encode()))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse_warc(b"nothing"))


# --- repeated strings ---


def plain_removal(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = collections.Counter(b[k : k + 200] for _, b in texts for k in range(len(b) - 199))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if times[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = [[m.start(), m.end()] for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "piece"), [(10**6, 4 << 20), (2, 700)])
def test_repeats(spark, monkeypatch, hot, piece):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (20, 40, 45, 60, 120)]
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "x" * 450), (None, passages[2]), (6, "é字" * 90), (7, "é字" * 90), (7, "é字" * 90), (8, "ab" * 150)]
    for i in range(20, 60):
        text = prose(rng, rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            text += " " + p[rng.randint(0, 60) : len(p) - rng.randint(0, 60)] + " " + prose(rng, rng.randint(0, 30))
        rows.append((i, text))
    if piece < 1000:  # workers get these functions by value, so the patched sizes travel with them
        monkeypatch.setattr(substrings, "PIECE", piece)
        monkeypatch.setattr(substrings, "BATCH", 2000)
    found = substrings.remove_repeats(documents(spark, rows, extra=True), hot_key=hot)
    own = sorted(((r["doc_id"], r["n_bytes"], [list(s) for s in r["spans"]], bytes(r["kept"])) for r in found.collect()), key=repr)
    assert own == plain_removal(rows)
    assert substrings.remove_repeats(documents(spark, rows).limit(0)).isEmpty()


def test_equal_windows():
    """Bucket pointers against slices, on strings of few letters and of many, with windows at every place."""
    rng = random.Random(31)
    for letters in ("a", "ab", "abcdefgh"):
        for _ in range(30):
            parts = [("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) * rng.randint(1, 9)).encode() for _ in range(rng.randint(1, 12))]
            common = "".join(rng.choice("abcdefgh") for _ in range(rng.choice([150, 199, 200, 203, 260]))).encode()
            parts = [rng.choice([p, p + common, common + p, p + common + p[:9]]) for p in parts]
            data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
            starts = np.array([e - len(p) + i for p, e in zip(parts, ends, strict=True) for i in range(len(p) - 199) if rng.random() < 0.9], np.int64)
            times = collections.Counter(data[i : i + 200] for i in starts)
            want = [times[data[i : i + 200]] > 1 for i in starts]
            assert substrings.equal_windows(np.frombuffer(data, np.uint8), ends, starts).tolist() == want


# --- quality ---


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    times = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {k + d for k in range(len(words) - 2) if times[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    rng = random.Random(7)
    rows = edge_rows(rng) + [(i, "".join(rng.choice(["a ", "b ", "c ", "\n", "# ", "\t", "\x0b", "é ", " ", "a b c "]) for _ in range(rng.randint(0, 90)))) for i in range(100, 300)]
    found = quality.features(documents(spark, rows, extra=True))
    want = [(i, *(c := plain_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows]
    assert got(found, "doc_id", *quality.COUNTS, "base_failed") == sorted(want, key=repr)


def test_binomial(spark):
    cases = [(0, 10, 0.1), (3, 100, 0.02), (50, 4000, 0.01), (2000, 500_000, 0.004)]
    for k, n, p in cases:
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        own = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("p")).first()[0]
        assert own == pytest.approx(want, rel=1e-6)


def plain_fit(rows, labels, alpha=quality.ALPHA, delta=quality.DELTA):
    """rows: (id, stratum, counts, n_lines, base_failed) to {stratum: {rule: cutoff}}, as the module's text says."""
    score = {
        "symbols_per_word": lambda r: r["n_symbols"] * 1000 // r["n_words"],
        "repeated_lines": lambda r: r["n_dup_lines"] * 1000 // max(r["n_lines"], 1),
        "repeated_words": lambda r: r["n_repeat_words"] * 1000 // r["n_words"],
        "long_words": lambda r: r["word_chars"] * 1000 // r["n_words"],
        "short_words": lambda r: -(r["word_chars"] * 1000 // r["n_words"]),
    }
    known = {}
    for i, q in labels:
        if i is not None and q is not None:
            known[i] = min(q, known.get(i, q))
    strata = collections.defaultdict(lambda: ([], [], []))  # bad, good, without a label
    for r in rows:
        if not r["base_failed"]:
            strata[r["stratum"]][known.get(r["doc_id"], 2)].append(r)
    sizes = sorted((len(good) for _, good, _ in strata.values() if good), reverse=True)
    k = next((k for k in range(1, len(sizes)) if (1 - alpha) ** sizes[k] > delta / k), max(1, len(sizes)))
    out = {}
    for name, (bad, good, other) in strata.items():
        path = []
        for rule, (_, lo, step, n) in quality.RULES.items():
            for j in range(n):
                over = lambda rs, at=lo + j * step, f=score[rule]: sum(f(r) > at for r in rs)
                if over(bad):
                    gain = (over(bad) / len(bad)) / ((over(other) + 1) / (len(other) + 1))
                    if gain > 1:
                        path.append((-gain, -over(bad), rule, -j))
        cutoffs = {}
        for *_, rule, j in sorted(path):
            _, lo, step, _ = quality.RULES[rule]
            now = {**cutoffs, rule: min(lo - j * step, cutoffs.get(rule, 10**9))}
            lost = sum(any(score[r](g) > c for r, c in now.items()) for g in good)
            tail = sum(math.comb(len(good), i) * alpha**i * (1 - alpha) ** (len(good) - i) for i in range(lost + 1))
            if lost >= alpha * len(good) or tail > delta / k:
                break
            cutoffs = now
        if cutoffs:
            out[name] = cutoffs
    return out


def test_cutoffs(spark):
    """The same cutoffs as a plain fit; clean labels catch the bad, and false rejections keep to the bound."""
    rng = random.Random(8)
    row = lambda i, lang, symbols, chars=500, lines=0: (i, lang, 100, chars, symbols, lines, 0, 10, False)
    rows = [row(i, "en", rng.randint(0, 9), rng.randint(400, 700)) for i in range(1000)] + [row(10_000 + i, "en", rng.randint(50, 200)) for i in range(100)] + [row(11_000 + i, "en", 0, rng.randint(650, 900), rng.randint(0, 9)) for i in range(50)]
    rows += [row(20_000 + i, None, rng.randint(0, 300)) for i in range(60)] + [row(30_000 + i, "de", rng.randint(0, 40)) for i in range(400)] + [row(40_000 + i, "de", rng.randint(20, 90), 500, 9) for i in range(60)]
    rows += [row(50_000 + i, rng.choice(["en", "de", None]), rng.randint(0, 60), rng.randint(400, 800), rng.randint(0, 3)) for i in range(700)]
    feats = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    labels = [(r[0], int(r[0] < 10_000 or 30_000 <= r[0] < 40_000)) for r in rows if r[0] < 50_000] + [(0, 1), (None, 1), (5, None), (99_999, 0)]
    cuts = quality.fit_cutoffs(feats, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    own = {s: {c["rule"]: c["cutoff"] for c in cuts if c["stratum"] == s} for s in {c["stratum"] for c in cuts}}
    assert own == plain_fit([r.asDict() for r in feats.collect()], labels) and set(own) == {"en", "de"}
    judged = quality.judge(feats, spark.createDataFrame(cuts))
    assert judged.where("doc_id < 10000 and not kept").count() <= 1000 * quality.ALPHA
    assert judged.where("doc_id between 10000 and 10999 and kept").isEmpty()
    assert judged.where("stratum is null and not kept").isEmpty()


def test_guarantee(spark):
    """Of a rule that loses more than alpha of the good documents no cutoff passes, but for a share delta of the trials."""
    rng = random.Random(17)
    n, trials, rate = 300, 60, 1.2 * quality.ALPHA
    rows = [(1000 * t + i, f"s{t}", 100, 500, 90 if rng.random() < rate else 0, 0, 0, 10, False) for t in range(trials) for i in range(n)]
    rows += [(900_000 + t, f"s{t}", 100, 500, 90, 0, 0, 10, False) for t in range(trials)]
    feats = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    labels = spark.createDataFrame([(r[0], int(r[0] < 900_000)) for r in rows], "doc_id long, quality int")
    assert quality.fit_cutoffs(feats, labels).isEmpty()  # all together: one false certificate in 20 such runs at most


def test_quality_edges(spark):
    rows = edge_rows(random.Random(1)) + [(77, "fine words here and there with more of them " * 1 + prose(random.Random(3), 80))]
    docs = documents(spark, rows, extra=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    failed = {r["doc_id"] for r in quality.features(docs).where("base_failed").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - failed and 77 not in failed
    assert quality.keep_good(docs.limit(0), labels).isEmpty() and quality.quality_rules(docs.limit(0), labels).isEmpty()


# --- shards ---


def test_shards(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(3000)] + [(5000 + i, "hot text of many copies") for i in range(1500)] + edge_rows(rng)[:4]
    docs = documents(spark, rows, extra=True)
    placed = sharding.shard_by_bytes(docs, 24).select(*docs.columns, "shard", "slot") if "shard" not in docs.columns else sharding.shard_by_bytes(docs, 24)
    assert sorted(placed.columns) == sorted([*docs.columns, "divided"])
    sized = placed.withColumn("size", sharding.row_size(F.col("text")))
    by = sized.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()
    mean = sum(r["b"] for r in by) / 24
    assert len(by) == 24 and all((r["lo"], r["hi"] + 1, r["d"]) == (0, r["n"], r["n"]) for r in by)
    assert max(abs(r["b"] - mean) for r in by) <= 500
    spread = placed.where("text = 'hot text of many copies'").select("shard").distinct().count()
    again = placed.where("text <> 'hot text of many copies' and text <> ''").groupBy("text").agg(F.count_distinct("shard").alias("s")).where("s > 1")
    assert spread > 1 and again.isEmpty()
    assert sharding.shard_by_bytes(docs.limit(0)).isEmpty()
    assert sharding.shard_by_bytes(docs.limit(1)).first()["slot"] == 0
    assert sharding.shard_by_bytes(documents(spark, [(1, "same")] * 50)).select("slot").distinct().count() <= 50


# --- secrets ---

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets(spark):
    rng = random.Random(11)
    parts = ["Token", "token=", "secret: ", "PASSWD='", "api_key=", "apikey:", "abc", "abcdef", "AKIA", "AKIA" + "ABCD1234" * 2, "0123456789abcdef", "deadbeef", " ", "\n", "é😀", "=", ":", '"', "x"]
    rows = edge_rows(rng) + [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(100, 700)]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = {1000 + i: "".join(rng.choice(alphabet) for _ in range(40)) for i in range(40)}
    rows += [(i, f"é see {k} there") for i, k in planted.items()]
    clean = ["internationalization_of_words", "https://www.example.com/some/long/path/with/words", "ThisIsSomeLongIdentifierName", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789"]
    rows += [(2000 + i, t) for i, t in enumerate(clean * 20)]
    found = secrets.find_secrets(documents(spark, rows, extra=True)).collect()
    key = lambda spans: [(s["start"], s["kind"], s["end"]) for s in spans]
    assert sorted(((r["doc_id"], key(r["base"])) for r in found), key=repr) == sorted(((i, plain_secrets(t or "")) for i, t in rows), key=repr)
    more = {r["doc_id"]: [s for s in key(r["spans"]) if s[1] == 3] for r in found}
    hit = [i for i, k in planted.items() if more[i] == [(6, 3, 6 + len(k))]]
    assert len(hit) >= 36
    assert sum(bool(more[2000 + i]) for i in range(100)) <= 2
    assert all(set(key(r["base"])) <= set(key(r["spans"])) for r in found)
    assert secrets.find_secrets(documents(spark, rows).limit(0)).isEmpty()


# --- near duplicates ---


def plain_near(rows, size, percent=80):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(parent, i)) for i, s in sets), key=repr)


@pytest.mark.parametrize(("size", "block"), [(4, 2048), (5, 3)])
def test_near_duplicates(spark, monkeypatch, size, block):
    rng = random.Random(13)
    rows = edge_rows(rng) + [(11, "one two"), (12, "ONE  two\n"), (13, "one two three four"), (14, "a b c d e f")]
    for g in range(100, 1000, 100):
        words = prose(rng, rng.choice([12, 60, 150, 400])).split()
        for k in range(rng.choice([2, 5, 14])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 9999)}"
            rows.append((g + k, " ".join(copy)))
            words = copy if g % 200 else words  # chains as well as stars
    rng.shuffle(rows)
    if block < 10:
        monkeypatch.setattr(near_dedup, "SIGNATURES", block)
        monkeypatch.setattr(near_dedup, "SETS", block)
        monkeypatch.setattr(near_dedup, "SET_HASHES", 500)
    docs = documents(spark, rows, extra=True)
    found = near_dedup.near_duplicates(docs, size, least=0 if block < 10 else near_dedup.LEAST_AGREEING)
    want = plain_near(rows, size)
    assert got(found, "doc_id", "n_shingles", "component_id") == want
    kept = near_dedup.keep_one(docs, size)
    assert kept.columns == docs.columns
    stay = [i for i, n, c in want if i is None or n == 0 or i == c]
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    repeated = len(stay) - len([i for i in stay if i is None]) - len({i for i in stay if i is not None})
    assert len(ids) == len(stay) - repeated and set(ids) == set(stay)
    assert near_dedup.near_duplicates(docs.limit(0), size).isEmpty() and near_dedup.keep_one(docs.limit(0), size).isEmpty()


def test_near_duplicates_of_one_id(spark):
    """Rows of one id with different texts are documents of their own; no link of either is lost."""
    rng = random.Random(21)
    a, b = prose(rng, 200), prose(rng, 200)
    rows = [(5, a), (5, b), (2, a + " x"), (3, b + " y"), (4, prose(rng, 100))]
    docs = documents(spark, rows)
    found = got(near_dedup.near_duplicates(docs), "doc_id", "component_id", "kept")
    assert found == [(2, 2, True), (3, 3, True), (4, 4, True), (5, 2, False), (5, 3, False)]
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs).collect()) == [2, 3, 4]
