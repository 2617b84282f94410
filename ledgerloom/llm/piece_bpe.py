"""Byte-level BPE through a sentencepiece model that is serialised from the vocabulary.

The vocabulary is a file of ranks (base-64 token and rank on each line). Every byte is mapped to a
character of its own, so each token becomes a piece of such characters; pieces are scored by their
negative rank and put in order of rank, the model's type is BPE and its normalisation the identity.
sentencepiece then merges the pair of the highest score first, the leftmost among equals, which is
the merge of the lowest rank. Texts are split by the pre-token pattern and each pre-token is encoded
for itself; one that is a token as a whole is that token, as ranks that no merge reaches would
otherwise never come out. Decoding maps ids back to their bytes.

Texts are worked on in slices that end between a character that isn't white space and one that is:
every alternative of the pattern ends a match there, and only runs of white space look ahead. The
file is read by the driver and broadcast (``bpe.MOST_FILE`` at most), so executors need no copy of
it. Pre-tokens of late are remembered in a cache of bounded bytes.

Defined cases: null counts as empty; empty text has no ids; a text of any length is encoded whole;
repeated rows are encoded each for itself; other columns are kept as they are or not read at all;
null ids decode to nothing. A file whose tokens or ranks repeat, or that lacks one of the 256 bytes,
is an error.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import IDS, Strings, file_broadcast
from .common import annotate, table

#: Bytes of pre-tokens, ids and their objects in each of a task's two generations of remembered ones.
CACHE_BYTES = 16 << 20
#: Pre-tokens of more characters are not remembered; characters of a slice; pre-tokens encoded in one call.
REMEMBERED, SLICE, AT_ONCE = 64, 1 << 19, 10_000
_ENTRY = 220
BYTES = T.StructType([T.StructField("bytes", T.BinaryType())])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
UNKNOWN = "<unk>"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The rank of each token of a file of ranks."""
    lines = [line.split() for line in content.splitlines() if line.strip()]
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    if len(ranks) < len(lines) or len(set(ranks.values())) < len(ranks):
        raise ValueError("a token or a rank occurs twice")
    if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for {len(lacking)} of the bytes, such as {lacking[0]}")
    return ranks


#: The character of each byte: letters that no normalisation and no white-space rule touches.
_CHARACTER = [chr(0x100 + b) for b in range(256)]


def mapped(token: bytes) -> str:
    """The piece of a token."""
    return "".join(map(_CHARACTER.__getitem__, token))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The bytes of a sentencepiece model: pieces in order of rank, and one for the unknown after them.

    Field numbers are those of the public ``sentencepiece_model.proto``: pieces 1 (piece 1, score 2,
    type 3 with 2 for unknown), trainer 2 (model type 3 with 2 for BPE, ids 40 to 43), normaliser 3
    (name 1, dummy prefix 3, extra white space 4, escaped white space 5).
    """
    order = sorted(ranks, key=ranks.__getitem__)
    parts = [_block(1, _block(1, mapped(t).encode()) + b"\x15" + struct.pack("<f", -float(ranks[t]))) for t in order]
    parts.append(_block(1, _block(1, UNKNOWN.encode()) + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    absent = (1 << 64) - 1  # -1: the model has no such piece
    trainer = _number(3, 2) + _number(4, len(order) + 1) + _number(40, len(order)) + b"".join(_number(f, absent) for f in (41, 42, 43))
    rules = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*parts, _block(2, trainer), _block(3, rules)])


class Codec:
    """Encodes and decodes texts slice by slice."""

    def __init__(self, content: bytes, pattern: str):
        import numpy as np
        import regex
        import sentencepiece

        self.ranks = read_ranks(content)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        self.rank_of = np.array(sorted(self.ranks.values()), np.uint32)  # of the model's ids
        self.bytes = Strings({r: t for t, r in self.ranks.items()})
        self.words, self.end = regex.compile(pattern), regex.compile(r"\S(?=\s)")
        # the pre-tokens of late, and those before them; what is used again moves to the first
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.used = 0

    def slices(self, text: str) -> Iterator[str]:
        """Slices of about ``SLICE`` characters, each ending where a pre-token does."""
        at = 0
        while at < len(text):
            found = self.end.search(text, at + SLICE - 1) if len(text) - at > SLICE else None
            to = found.end() if found else len(text)
            yield text[at:to]
            at = to

    def coded(self, words: list[str]) -> bytes:
        """The ids of the pre-tokens, as 32-bit numbers."""
        import numpy as np

        parts = list(map(self.cache.get, words))
        gaps = [i for i, q in enumerate(parts) if q is None]
        fresh = {words[i]: b"" for i in gaps}
        new = []
        for w in fresh:
            if q := self.older.get(w):
                fresh[w] = q
            elif (r := self.ranks.get(b := w.encode())) is not None:
                fresh[w] = array("I", [r]).tobytes()
            else:
                new.append((w, mapped(b)))
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            for (w, _), ids in zip(some, self.own.encode([m for _, m in some], out_type=int, num_threads=1), strict=True):
                fresh[w] = self.rank_of[np.array(ids, np.int64)].tobytes()
        for i in gaps:
            parts[i] = fresh[words[i]]
        for w, q in fresh.items():
            if len(w) <= REMEMBERED:
                self.used += 2 * len(w) + len(q) + _ENTRY
                if self.used > CACHE_BYTES:
                    self.older, self.cache, self.used = self.cache, {}, 2 * len(w) + len(q) + _ENTRY
                self.cache[w] = q
        return b"".join(parts)

    def encode(self, text: str | None) -> Iterator:
        """The ids of a text, an array for each slice."""
        import numpy as np

        for part in self.slices(text or ""):
            yield np.frombuffer(self.coded(self.words.findall(part)), np.uint32)

    def decode(self, ids) -> bytes:
        return self.bytes.joined(ids)


def _codec(docs: DataFrame, path: str | None, pattern: str | None) -> Callable[[], Codec]:
    content, pattern = file_broadcast(docs.sparkSession, path or default_ranks()), pattern or default_pattern()
    return lambda: Codec(content.value, pattern)


def encode_pieces(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", name: str = "bpe", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with a struct column ``name`` of the ids of each text."""
    codec = _codec(docs, path, pattern)

    def make():
        import numpy as np

        own = codec()
        return lambda texts: [{"ids": np.concatenate([np.zeros(0, np.int32), *own.encode(t)]).astype(np.int32)} for t in texts]

    return annotate(docs, text_col, make, IDS, name, keep)


def decode_pieces(docs: DataFrame, ids_col: str, path: str | None = None, name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with a struct column ``name`` of the bytes of the ids in ``ids_col``."""
    codec = _codec(docs, path, None)

    def make():
        import numpy as np

        own = codec()
        return lambda rows: [{"bytes": own.decode(np.array(ids or [], np.int64))} for ids in rows]

    return annotate(docs, ids_col, make, BYTES, name, keep)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", name: str = "bpe", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with a struct ``name``: n_tokens, ids_sha256 (little-endian 32-bit ids), decoded_sha256.

    One pass encodes each slice, decodes its ids and feeds both digests, so ids never leave the task.
    """
    codec = _codec(docs, path, pattern)

    def make() -> Callable:
        own = codec()

        def one(text: str | None) -> dict:
            n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in own.encode(text):
                n += len(ids)
                ids_hash.update(ids.astype("<u4").tobytes())
                bytes_hash.update(own.decode(ids))
            return {"n_tokens": n, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": bytes_hash.hexdigest()}

        return lambda texts: list(map(one, texts))

    return annotate(docs, text_col, make, DIGESTS, name, keep)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", *(F.col(f"bpe.{c}").alias(c) for c in DIGESTS.names))
