"""Byte-level BPE encoding and decoding with forced boundaries.

Two adjacent bytes that occur side by side in no vocabulary token can never end up in one token, so
between them the text may be cut before encoding. A cut must not change how the tokenizer splits
text into words either: it is made only after an ASCII character that isn't white space (so no run
of white space is cut, whose last character the pattern treats apart) and never before an apostrophe
(which may begin a contraction). Both hold for the bytes of added tokens too, as these are part of
the vocabulary. The fragments between cuts are encoded independently, each distinct short one once
as long as it stays in a cache of bounded bytes, and their ids are concatenated.

Texts are worked on in slices that end at cuts, so that beside the text itself a task holds the
fragments of one slice only. The tokenizer's file is read by the driver and broadcast (it must not
be larger than ``MOST_FILE``), so executors need no copy of it.

Defined cases: null counts as empty; empty text has no ids; a text of any length is cut into
fragments and never truncated; repeated rows are encoded each for itself; other columns are kept as
they are or not read at all.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, table

#: Bytes of fragments, ids and their objects in each of a task's two generations of remembered ones.
CACHE_BYTES = 16 << 20
#: Fragments of more bytes are not remembered; bytes of text in a slice; fragments encoded in one call.
REMEMBERED, SLICE, AT_ONCE = 64, 1 << 20, 10_000
_ENTRY = 220
MOST_FILE = 64 << 20
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
TEXT = T.StructType([T.StructField("text", T.StringType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes follow, in order, from 256.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(tokenizer) -> dict[int, bytes]:
    """The bytes of each id."""
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    byte = _byte_of()
    return {i: added[i].encode() if i in added else bytes(byte[c] for c in token) for token, i in tokenizer.get_vocab(with_added_tokens=True).items()}


def cut_table(tokens):
    """65536 booleans: may the text be cut between these two bytes (first * 256 + second)?"""
    import numpy as np

    inside = np.zeros(65536, bool)
    for token in tokens:
        b = np.frombuffer(token, np.uint8).astype(np.int64)
        inside[b[:-1] * 256 + b[1:]] = True
    first, second = np.divmod(np.arange(65536), 256)
    return ~inside & (first > 0x20) & (first < 0x7F) & (second != ord("'"))


def _tokenizer(content: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(content.decode())
    own.no_truncation()
    own.no_padding()
    return own


class Strings:
    """A byte string for each id; ``joined`` puts those of many ids together."""

    def __init__(self, of: dict[int, bytes]):
        import numpy as np

        every = [of.get(i, b"") for i in range(max(of) + 1)]
        self.sizes = np.array([len(x) for x in every], np.int32)
        self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.flat = np.frombuffer(b"".join(every), np.uint8)

    def joined(self, ids) -> bytes:
        import numpy as np

        n = self.sizes[ids]
        before = np.cumsum(n, dtype=np.int32) - n
        spot = np.repeat(self.begins[ids] - before, n)
        spot += np.arange(len(spot), dtype=np.int32)
        return self.flat[spot].tobytes()


class Codec:
    """Encodes and decodes texts slice by slice."""

    def __init__(self, content: bytes):
        self.own = _tokenizer(content)
        tokens = token_bytes(self.own)
        self.may_cut = cut_table(tokens.values())
        self.bytes, self.figures = Strings(tokens), Strings({i: b"%d," % i for i in tokens})
        # the fragments of late, and those before them; what is used again moves to the first
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.used = 0

    def ends(self, b: bytes) -> list[int]:
        """Where the fragments of ``b`` may end, without its own end."""
        import numpy as np

        a = np.frombuffer(b, np.uint8)
        if len(a) < 2:
            return []
        pairs = a[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= a[1:]
        return (np.flatnonzero(self.may_cut[pairs]) + 1).tolist()

    def slices(self, b: bytes) -> Iterator[list[bytes]]:
        """Fragments of slices of about ``SLICE`` bytes, each ending at a cut or with the text."""
        at, size = 0, SLICE
        while at < len(b):
            part, last = b[at : at + size], at + size >= len(b)
            ends = self.ends(part)
            if last:
                ends.append(len(part))
            elif not ends:  # no cut so far: look further
                size *= 2
                continue
            yield [part[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            at, size = at + ends[-1], SLICE

    def coded(self, pieces: list[bytes]) -> bytes:
        """The ids of the fragments, as 32-bit numbers."""
        parts = list(map(self.cache.get, pieces))
        gaps = [i for i, q in enumerate(parts) if q is None]
        fresh = {pieces[i]: b"" for i in gaps}
        fresh |= {p: q for p in fresh if (q := self.older.get(p))}
        new = [p for p, q in fresh.items() if not q]
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            for p, got in zip(some, self.own.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                fresh[p] = array("i", got.ids).tobytes()
        for i in gaps:
            parts[i] = fresh[pieces[i]]
        for p, q in fresh.items():
            if len(p) <= REMEMBERED:
                self.used += len(p) + len(q) + _ENTRY
                if self.used > CACHE_BYTES:
                    self.older, self.cache, self.used = self.cache, {}, len(p) + len(q) + _ENTRY
                self.cache[p] = q
        return b"".join(parts)

    def encode(self, text: str | None) -> Iterator:
        """The ids of a text, an array for each slice."""
        import numpy as np

        for pieces in self.slices((text or "").encode()):
            yield np.frombuffer(self.coded(pieces), np.int32)

    def decode(self, parts) -> Iterator[str]:
        """The text of arrays of ids: the tokens' bytes, joined, read as UTF-8."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield reader.decode(self.bytes.joined(ids))
        yield reader.decode(b"", True)


def file_broadcast(spark: SparkSession, path: str):
    """The tokenizer's file, for the executors."""
    with open(path, "rb") as file:
        content = file.read(MOST_FILE + 1)
    if len(content) > MOST_FILE:
        raise ValueError(f"a tokenizer of more than {MOST_FILE} bytes isn't broadcast")
    return spark.sparkContext.broadcast(content)


def encode_bpe(docs: DataFrame, path: str | None = None, text_col: str = "text", name: str = "bpe", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with a struct column ``name`` of the token ids of each text."""
    content = file_broadcast(docs.sparkSession, path or default_tokenizer())

    def make():
        import numpy as np

        own = Codec(content.value)
        return lambda texts: [{"ids": np.concatenate([np.zeros(0, np.int32), *own.encode(t)])} for t in texts]

    return annotate(docs, text_col, make, IDS, name, keep)


def decode_bpe(docs: DataFrame, ids_col: str, path: str | None = None, name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with a struct column ``name`` of the text of the ids in ``ids_col``; null ids have an empty text."""
    content = file_broadcast(docs.sparkSession, path or default_tokenizer())

    def make():
        import numpy as np

        own = Codec(content.value)
        return lambda rows: [{"text": "".join(own.decode([np.array(ids or [], np.int32)]))} for ids in rows]

    return annotate(docs, ids_col, make, TEXT, name, keep)


def round_trip(docs: DataFrame, path: str | None = None, text_col: str = "text", name: str = "bpe", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with a struct ``name``: n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    One pass encodes each slice, decodes its ids and feeds both digests, so ids never leave the task.
    """
    content = file_broadcast(docs.sparkSession, path or default_tokenizer())

    def make() -> Callable:
        own = Codec(content.value)

        def one(text: str | None) -> dict:
            n, ids_hash, text_hash, figures = 0, hashlib.sha256(), hashlib.sha256(), b""

            def counted():
                nonlocal n, figures
                for ids in own.encode(text):
                    n += len(ids)
                    ids_hash.update(figures)
                    figures = own.figures.joined(ids)
                    yield ids

            for part in own.decode(counted()):
                text_hash.update(part.encode())
            ids_hash.update(figures[:-1])  # no comma after the last id
            return {"n_tokens": n, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": text_hash.hexdigest()}

        return lambda texts: list(map(one, texts))

    return annotate(docs, text_col, make, DIGESTS, name, keep)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return round_trip(docs.select("doc_id", "text"), path, keep=["doc_id"]).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
