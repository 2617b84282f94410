"""Phrases, centroids and pieces against plain versions of their whole results."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from helpers import CLASHING, documents, edge_rows, got
from pyspark.sql import functions as F

from ledgerloom.llm import centroids, phrases, piece_bpe
from ledgerloom.llm.registry import QUERIES

# phrases


def plain_phrases(rows, max_words=3, least=10, share=50, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(a for p, a in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        scored = []
        for p, a in cand.items():
            if 100 * longer[p] >= share * a:
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def phrase_rows():
    rng = random.Random(5)
    words = "a b c d É é 字 x1 😀 The the of".split()
    line = "one long line that is met again and again and holds words met nowhere else"
    rows = [(None, "en"), ("", "en"), (" \t ", "de"), (".,;", None), ("round and " * 60, "en"), ("tick tock " * 40 + ".", None), ("same same same same same same same same same same same same", "de")]
    rows += [(line + rng.choice([".", "\n", " " + rng.choice(words)]), rng.choice(["en", None])) for _ in range(30)]
    rows += [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\t", " ", "\x0b", "\x1c", "\xa0"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(200)]
    return rows


@pytest.mark.parametrize(("max_words", "least", "top"), [(3, 10, 2000), (2, 3, 7), (4, 5, 2000), (5, 20, 3)])
def test_phrases(spark, monkeypatch, max_words, least, top):
    rows = phrase_rows()
    monkeypatch.setattr(phrases, "HELD", 29 if max_words == 4 else 300)
    docs = documents(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)], extra=max_words == 4).repartition(5)
    found = got(phrases.collocations(docs, max_words, least, top=top), *COLUMNS)
    assert found == plain_phrases(rows, max_words, least, top=top) and len({r[0] for r in found}) >= 2


def test_phrase_query(spark, tmp_path):
    rows = phrase_rows() + [("a b c " * 30_000, "fr"), ("y" * 300_000 + " z" * 50, "fr")]
    documents(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate(rows)]).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op11_phrases"](spark, str(tmp_path))
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert got(df, *COLUMNS) == plain_phrases(rows)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(documents(spark, [(1, "x")]).limit(0)).collect() == []
    assert phrases.collocations(documents(spark, [(1, None), (2, "few words")])).collect() == []


@pytest.mark.parametrize("rounds", [12, 2])
def test_paths_hold_every_edge_once(spark, monkeypatch, rounds):
    monkeypatch.setattr(phrases, "ROUNDS", rounds)
    once = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate([*phrase_rows(), (once, "en"), (once, "en")])])
    weighted = phrases.graph(phrases.edges(docs), min_count=2).cache()
    rows = phrases.paths(weighted).collect()
    own = Counter((r["lang"], tuple(r["words"][i : i + 3]), n) for r in rows for i, n in enumerate(r["weights"]))
    assert max(own.values()) == 1 and set(own) == {(r["lang"], (*r["node"].split(" "), r["word"]), r["n"]) for r in weighted.where("word is not null").collect()}
    assert {r["k"] for r in weighted.where("word is not null").collect()} == {2}
    longest = max(len(r["weights"]) for r in rows)
    assert longest == 38 if rounds == 12 else longest <= 2**rounds + 2
    # no two paths could be one: where a path ends and exactly one begins, another edge goes in or out, or a round is closed
    if rounds == 12:
        into, out = Counter(), Counter()
        for lang, words, _ in own:
            into[lang, words[1:]] += 1
            out[lang, words[:2]] += 1
        for r in rows:
            first, last = (r["lang"], tuple(r["words"][:2])), (r["lang"], tuple(r["words"][-2:]))
            assert into[last] != 1 or out[last] != 1 or last == first or len(r["weights"]) == 1


def test_scores_beyond_64_bits(spark):
    x = 3_000_000_000_000
    q = "(cast(cast({0} as decimal(16,0)) * cast({0} as decimal(16,0)) as decimal(31,0)) * cast(1000000 as decimal(7,0))) div (cast(cast({1} as decimal(16,0)) * cast({2} as decimal(16,0)) as decimal(38,0)))"
    assert q.split("{0}")[0] == "(cast(cast("
    assert spark.range(1).select(F.expr(q.format(x, x + 1, x + 7))).first()[0] == 1000000 * x * x // ((x + 1) * (x + 7))


# centroids


def plain_clusters(rows, k=8, rounds=10, dims=64, seed=3):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else m for j, m in enumerate(c)]
    last = [(i, *reversed(near(v))) for i, v in kept]
    own = Counter()
    for _, j, d in last:
        own[j] += d
    return sorted(((i, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in last), key=repr)


CLUSTERS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def vectors(seed, n=300, dims=64):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(10, dims)) / 3
    rows = [(i, (middles[rng.integers(10)] + rng.normal(size=dims) / rng.choice([3, 20])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[8][1]), (900, [0.0] * dims), (901, [0.0] * dims), (902, None), (903, []), (904, [0.5] * (dims + 1)), (905, [None] + [0.5] * (dims - 1)), (906, [float("nan")] * dims), (907, [float("inf")] * dims), (908, [-0.0001] * dims), (909, [3000.5] * dims)]
    return rows


def test_clusters(spark, tmp_path):
    rows = vectors(1)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES["op12_centroids"](spark, str(tmp_path))
    assert dict(df.dtypes) == dict(zip(CLUSTERS, ["bigint", "int", "bigint", "bigint", "bigint", "string"], strict=True))
    assert got(df, *CLUSTERS) == plain_clusters(rows)


def test_clusters_with_other_parameters(spark):
    rows, trace = [(i, v[:7]) for i, v in vectors(2) if v and len(v) == 64 and None not in v], []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in [*CLASHING.split(), "v", "cluster", "lower", "distance", "part", "k0", "big"]})
    found = centroids.cluster(df, k=5, rounds=30, dims=7, seed=11, trace=trace)
    assert got(found, *CLUSTERS) == plain_clusters(rows, 5, 30, 7, 11)
    assert len(trace) < 31 and trace[-1]["drift"] == 0 and trace[0]["scanned"] == trace[0]["vectors"]
    assert any(t["scanned"] < t["vectors"] / 2 for t in trace[1:]) and any(t["lost"] < 0.9 * t["drift"] for t in trace[1:])
    assert centroids.cluster(df, k=5, rounds=1, dims=7, keep=["vec_id", "part", "k0"]).columns[:3] == ["vec_id", "part", "k0"]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [i / 3] * 64) for i in range(n)] + [(50, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(centroids.cluster(df), *CLUSTERS) == plain_clusters(rows)


def test_large_components(spark):
    rows = [(i, [120_000.0 * (-1) ** i + i * 900] * 64) for i in range(9)]
    assert got(centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2), *CLUSTERS[:3]) == sorted(((r[0], r[1], r[2]) for r in plain_clusters(rows, 2)), key=repr)
    with pytest.raises(Exception, match="lies beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_loosening_bounds_every_point_of_the_sphere():
    rng, tighter = np.random.default_rng(4), 0
    for dims in (2, 3, 40):
        for _ in range(60):
            old = rng.normal(size=(4, dims)) * 10
            new = old + rng.normal(size=(4, dims)) * rng.choice([0.1, 3, 20])
            radius = rng.random(4) * rng.choice([1, 10])
            lost = centroids.loosening(old, new, radius)
            for i in range(4):
                step = rng.normal(size=(400, dims))
                points = old[i] + radius[i] * step / np.linalg.norm(step, axis=1)[:, None] * rng.choice([1, 0.7])
                nearer = [np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1) for j in range(4) if j != i]
                drift = max(np.linalg.norm(new[j] - old[j]) for j in range(4) if j != i)
                assert np.max(nearer) <= lost[i] <= drift * (1 + 1e-8) + 1e-8
                tighter += lost[i] < 0.8 * drift
    assert tighter > 100


# pieces


@pytest.fixture(scope="module")
def codec():
    with open(piece_bpe.default_ranks(), "rb") as file:
        return piece_bpe.Codec(file.read(), piece_bpe.default_pattern())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids_of(codec, text):
    return [int(i) for part in codec.encode(text) for i in part]


def test_pieces_of_any_text(codec, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "SLICE", 50)
    monkeypatch.setattr(piece_bpe, "AT_ONCE", 20)
    monkeypatch.setattr(piece_bpe, "CACHE_BYTES", 20_000)
    rng = random.Random(3)
    parts = ["the", "'s", "'S", " ", "  ", "\n", "\t ", "é", "字字", "😀", "123", "!?", "'ll", "ing", " wor", "\x1c", "　", "▁", "\x00", "<|endoftext|>", "<unk>", "aaaa", "́"]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 300)))
        ids = ids_of(codec, text)
        assert ids == library.encode_ordinary(text) and codec.decode(np.array(ids, np.int64)) == text.encode()
    for text in ["a" * 100_000, " " * 3000 + "x", "é" * 20_000, "ab" * 50_000, "".join(map(chr, range(0x20, 0x3000)))]:
        assert ids_of(codec, text) == library.encode_ordinary(text)


def test_every_token_is_its_own_piece(codec):
    model = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe.serialised(codec.ranks))
    assert model.vocab_size() == len(codec.ranks) + 1 and model.unk_id() == len(codec.ranks) and model.bos_id() == model.eos_id() == model.pad_id() == -1
    for token, rank in list(codec.ranks.items())[::97]:
        assert model.id_to_piece(rank) == piece_bpe.mapped(token) and model.get_score(rank) == -rank


def test_ranks_with_gaps(tmp_path):
    tokens = [*(bytes([b]) for b in range(256)), b"ab", b"abc", b"bc", b" ab"]
    ranks = {t: 3 * i + 5 for i, t in enumerate(tokens)}
    content = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    own, plain = piece_bpe.Codec(content, public_tokenizers.PATTERN), tiktoken.Encoding("gaps", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["abc abcab bcab", "zabc  ab", " abc"]:
        assert ids_of(own, text) == plain.encode_ordinary(text) and own.decode(np.array(ids_of(own, text))) == text.encode()
    with pytest.raises(ValueError, match="twice"):
        piece_bpe.read_ranks(content + b"\n" + base64.b64encode(b"abc") + b" 9999")
    with pytest.raises(ValueError, match="no token"):
        piece_bpe.read_ranks(base64.b64encode(b"a") + b" 0")


def test_pieces_query(spark, tmp_path, library):
    rows = edge_rows(random.Random(8)) + [(50 + i, "copies of one text, " * 9) for i in range(40)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op13_pieces"](spark, str(tmp_path))
    want = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert QUERIES["op13_pieces"].__name__ == "op13_pieces" and df.limit(0).collect() == []


def test_pieces_and_back(spark, library):
    rows = edge_rows(random.Random(9))
    coded = piece_bpe.encode_pieces(documents(spark, rows, extra=True), name="coded")
    assert {tuple(r["coded"]["ids"]) for r in coded.where("doc_id = 7").collect()} == {tuple(library.encode_ordinary("ß é 字 😀 " * 40))}
    back = piece_bpe.decode_pieces(coded.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.col("coded.ids")).alias("i")), "i").collect()
    assert all(bytes(r["decoded"]["bytes"]).decode() == (r["text"] or "") for r in back) and len(back) == len(rows)
    empty = documents(spark, rows).limit(0)
    assert piece_bpe.encode_pieces(empty).collect() == [] and piece_bpe.round_trip(empty).collect() == []
