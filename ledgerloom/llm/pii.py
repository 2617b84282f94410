"""Personal data in texts, also where it is disguised.

Plain identifiers (email, ip, card, phone) are found in the text itself. Then transducers rewrite a
copy of the text and note for every character of the copy which source characters it stands for:

* look-alike letters, full-width and other compatibility forms and foreign digits become ASCII;
  invisible characters vanish;
* "at" and "dot", bracketed or as words, become "@" and "." where an address can stand;
* runs of spelled digits, also mixed with figures, become digits, "plus" before them "+".

The same patterns search the copy, and a match that holds a rewritten character is mapped back to
the source and added, unless it overlaps a plain identifier. Figures in front of spelled digits may
belong to them or not, so runs are read from the first spelled digit or "plus" on, then from the
figures on as groups, then from the figures on as one number; what is found first counts.

Every search is linear in the text: addresses are read from each "@" or "at" outwards, the other
patterns give nothing back, and the source of each character is kept in arrays.

Defined cases: null counts as empty; texts of any length are searched whole; repeated rows are each
searched for themselves; other columns are kept or not read.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, free_name, table

KINDS = ["email", "ip", "card", "phone"]
# Possessive repeats, and starts where a run of digits begins, match the same and never look at a character twice.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters in front of the "@" of an address as it stands, and those between the dots of a disguised one.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PART = LOCAL - {"."}
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
MASKED = T.StructType([T.StructField("text", T.StringType())])

# Letters of other alphabets that look like Latin ones.
LOOK_ALIKE = {
    like: plain
    for pair in (
        "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx іi ѕs јj ԁd һh ӏl ԛq ԝw "  # Cyrillic
        "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιi "  # Greek
        "ıi ɡg ․. ‧. ·. ・. 。. ‐- ‑- ‒- –- −-"
    ).split()
    for like, plain in [pair]
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Names of the digits 0 to 9 in English, German, French and Spanish; some belong to two languages.
SPELLED = {
    name: str(digit)
    for names in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for digit, name in enumerate(names.split())
} | {"oh": "0"}


def _compatible() -> dict[str, str]:
    """Compatibility forms of one ASCII character, and foreign decimal digits, by Unicode's own rules."""
    out = {}
    for block in (range(0x2460, 0x2500), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x2070, 0x20A0)):
        for code in block:
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and 0x21 <= ord(plain) < 0x7F:
                out[chr(code)] = plain
    for code in range(0x660, 0x10000):
        if (digit := unicodedata.decimal(chr(code), None)) is not None:
            out.setdefault(chr(code), str(digit))
    return out


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def run_before(text: str, at: int, chars: frozenset, floor: int) -> int:
    """Where the run of ``chars`` that ends at ``at`` begins, ``floor`` at the earliest."""
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, found from each "@" outwards, so that a long run of letters is read once."""
    at, last = text.find("@"), 0
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            begin = run_before(text, at, LOCAL, last)
            if begin < at:
                last = domain.end()
                yield begin, last
        at = text.find("@", at + 1)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every identifier that stands in the text as it is."""
    out = [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


#: Bytes to words in lower case, for a quick look whether a text spells digits at all.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A run without "plus" and "dot" has so many parts or digits at least, or is no identifier.
LEAST_SPELLED, LEAST_DIGITS = 4, 10
_DOTS = ("dot", "punkt", "point", "punto")
_NAME = "|".join(sorted(SPELLED, key=len, reverse=True))
_LEFT_OUT = 0xFFFFFFFF
#: Characters that the quick look for spelled digits reads at once.
_LOOK = 1 << 18


def _fold_table():
    """For each code point the one that takes its place."""
    import numpy as np

    chars = _compatible() | LOOK_ALIKE | dict.fromkeys(INVISIBLE, "")
    table = np.arange(max(map(ord, chars)) + 1, dtype=np.uint32)
    for char, plain in chars.items():
        table[ord(char)] = ord(plain) if plain else _LEFT_OUT
    return table


class Copy:
    """A rewritten text; ``starts[i]`` and ``ends[i]`` bound the source of its i-th character, ``new[i]``: rewritten?"""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.new = text, None, None, None

    def _arrays(self):
        import numpy as np

        if self.starts is None:
            self.starts = np.arange(len(self.text), dtype=np.int32)
            self.ends = self.starts + 1
            self.new = np.zeros(len(self.text), bool)

    def fold(self, table) -> None:
        """Put plain characters for the look-alikes and leave out invisible ones; of an unchanged copy."""
        import numpy as np

        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        known = codes < len(table)
        plain = codes.copy()
        plain[known] = table[codes[known]]
        if (plain == codes).all():
            return
        stay = plain != _LEFT_OUT
        self.starts = np.flatnonzero(stay).astype(np.int32)
        self.ends = self.starts + 1
        self.new = (plain != codes)[stay]
        # what is left out counts as a rewriting of what stands before it
        before = np.searchsorted(self.starts, np.flatnonzero(~stay)) - 1
        self.new[before[before >= 0]] = True
        self.text = plain[stay].tobytes().decode("utf-32-le")

    def replaced(self, begins: array, ends: array, puts: list[str]) -> Copy:
        """A copy with the parts [begin, end) replaced; in order, not overlapping."""
        import numpy as np

        self._arrays()
        a, b, n = np.array(begins, np.int64), np.array(ends, np.int64), len(self.text)
        pieces, last = [], 0
        for x, y, put in zip(begins, ends, puts, strict=True):
            pieces += (self.text[last:x], put)
            last = y
        pieces.append(self.text[last:])
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(sizes) - sizes
        source = np.zeros(len(pieces), np.int64)
        source[0::2], source[1::2] = np.concatenate([[0], b]), a
        put = np.zeros(len(pieces), bool)
        put[1::2] = True
        of = np.repeat(np.arange(len(pieces)), sizes)
        rewritten = put[of]
        spot = source[of] + np.where(rewritten, 0, np.arange(len(of)) - begin[of])
        out = Copy("".join(pieces))
        out.starts = self.starts[spot]
        spot[rewritten] = b[of[rewritten] // 2] - 1
        out.ends = self.ends[spot]
        out.new = rewritten | self.new[spot]
        gone = begin[1::2][(sizes[1::2] == 0) & (b > a)] - 1
        out.new[gone[gone >= 0]] = True
        return out


class Taken:
    """Spans that don't overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Take [a, b) if it is free."""
        i = bisect_left(self.ends, a + 1)
        if i < len(self.starts) and self.starts[i] < b:
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


class Addresses:
    """The transducer of "at" and "dot": from each "at" outwards, part by part."""

    def __init__(self):
        opened, closed = r"[\[({<]\s*+", r"\s*+[\])}>]"
        dots = "|".join(map(re.escape, (*_DOTS, ".")))
        self.hint = re.compile(rf"{opened}(?:at|@|arroba|ät|{dots}){closed}|\sdot\s|@\s|\s@", re.I)
        self.at = re.compile(rf"{opened}(?:at|@|arroba|ät){closed}|@|(?<=\s)at(?=\s)", re.I)
        self.dot = re.compile(rf"\s*+{opened}(?:{dots}){closed}\s*+|\s++dot\s++", re.I)
        self.label = re.compile(r"[A-Za-z0-9-]++")
        self.space = re.compile(r"\s*+")

    def dot_before(self, text: str, end: int) -> int | None:
        """Where the disguised dot that ends at ``end`` begins."""
        i = end
        while i and text[i - 1].isspace():
            i -= 1
        if i and text[i - 1] in "])}>":
            i -= 1
            while i and text[i - 1].isspace():
                i -= 1
            word = next((w for w in (*_DOTS, ".") if text[max(0, i - len(w)) : i].lower() == w), None)
            if word is None:
                return None
            i -= len(word)
            while i and text[i - 1].isspace():
                i -= 1
            if not i or text[i - 1] not in "[({<":
                return None
            i -= 1
        elif i < end and text[max(0, i - 3) : i].lower() == "dot" and i > 3 and text[i - 4].isspace():
            i -= 3
        else:
            return None
        while i and text[i - 1].isspace():
            i -= 1
        return i

    def before(self, text: str, end: int, floor: int) -> list[tuple[int, int]] | None:
        """The dots, last first, in the parts that end at ``end``; None without a part."""
        dots: list[tuple[int, int]] = []
        part = end
        while True:
            begin = run_before(text, part, PART, floor)
            if begin == part:
                return dots[:-1] if dots else None
            if begin - 1 > floor and text[begin - 1] == ".":
                dots.append((begin - 1, begin))
            elif (dot := self.dot_before(text, begin)) is not None and dot > floor:
                dots.append((dot, begin))
            else:
                return dots
            part = dots[-1][0]

    def after(self, text: str, begin: int, disguised: bool) -> tuple[list[tuple[int, int]], int] | None:
        """The dots between the labels from ``begin`` on and the end of these; the first one disguised, if asked."""
        dots: list[tuple[int, int]] = []
        label = self.label.match(text, begin)
        end = begin
        while label:
            end = label.end()
            dot = self.dot.match(text, end)
            span = dot.span() if dot else (end, end + 1) if text[end : end + 1] == "." and (dots or not disguised) else None
            label = self.label.match(text, span[1]) if span else None
            if label:
                dots.append(span)
        return (dots, end) if dots else None

    def edits(self, text: str) -> tuple[array, array, list[str]]:
        begins, ends, puts, last = array("i"), array("i"), [], 0
        for m in self.at.finditer(text):
            lo, hi = m.start(), self.space.match(text, m.end()).end()
            while lo > last and text[lo - 1].isspace():
                lo -= 1
            if lo <= last or text[lo - 1] not in PART:
                continue
            after = self.after(text, hi, m[0].lower() == "at")
            before = self.before(text, lo, last) if after else None
            if before is None:
                continue
            for a, b in (*reversed(before), (lo, hi), *after[0]):
                begins.append(a)
                ends.append(b)
                puts.append("@" if a == lo else ".")
            last = after[1]
        return begins, ends, puts


class Numbers:
    """The transducer of spelled digits."""

    def __init__(self):
        dot = "|".join(_DOTS)
        digits = rf"(?:(?:{_NAME})|[0-9]++)(?!\w)"
        more = rf"(?:[\s,-]++(?:(?<=\s)(?:{dot})\s++)?{digits})"
        self.runs = [re.compile(rf"(?<!\w)(?:plus[\s-]++{digits}{more}*+|{first}{more}++)", re.I) for first in (rf"(?:{_NAME})(?!\w)", digits)]
        self.piece = re.compile(rf"(plus)[\s-]+|({_NAME})|([\s,-]+(?:{dot})\s+)|((?<=[0-9])[\s,-]+|[\s,-]+(?=[0-9]))|([\s,-]+)", re.I)
        self.part = re.compile(r"[^\s,-]+")
        self.names, self.dots = frozenset(x.encode() for x in SPELLED), frozenset(x.encode() for x in _DOTS)
        self.signs = self.names | {b"plus"}
        self.blank = re.compile(r"\s")

    def spelled(self, text: str) -> bool:
        """Can a run be in the text: a spelled digit or plus next to another one or to figures? Looked at part by part."""
        at = 0
        while at < len(text):
            end = len(text) if at + _LOOK >= len(text) else (m.start() if (m := self.blank.search(text, at + _LOOK)) else len(text))
            part = text[at:end]
            words = (part if part.isascii() else " ".join(part.lower().split())).encode().translate(_WORDS).split()
            if not self.signs.isdisjoint(words):
                words = [w for w in words if w not in self.dots]
                if not words or at and words[0] in self.signs or end < len(text) and words[-1] in self.signs:
                    return True  # its neighbour may be in another part
                for i, w in enumerate(words):
                    if w in self.signs:
                        for near in (*words[i - 1 : i], *words[i + 1 : i + 2]) if i else words[1:2]:
                            if near in self.names or near.isdigit():
                                return True
            at = end + 1
        return False

    def edits(self, text: str, kind: int) -> tuple[array, array, list[str]]:
        """Rewriting of runs from a spelled digit or plus on (0), from figures on, as groups (1) or as one number (2)."""
        begins, ends, puts = array("i"), array("i"), []
        for m in self.runs[kind > 0].finditer(text):
            plus, dot, count = m[0][:4].lower() == "plus", False, 0
            for p in self.piece.finditer(text, *m.span()):
                dot |= bool(p[3])
                count += bool(p[2])
            if not (plus or dot and count):
                if not count:
                    continue
                parts, figures = sum(1 for _ in self.part.finditer(text, *m.span())), sum(c.isdigit() for c in m[0])
                if parts < LEAST_SPELLED and count + figures < LEAST_DIGITS:
                    continue
            for p in self.piece.finditer(text, *m.span()):
                begins.append(p.start())
                ends.append(p.end())
                puts.append("+" if p[1] else SPELLED[p[2].lower()] if p[2] else "." if p[3] else " " if p[4] and kind == 1 else "")
        return begins, ends, puts


class Finder:
    """All personal data of one text after the other."""

    def __init__(self):
        self.table, self.addresses, self.numbers = _fold_table(), Addresses(), Numbers()

    def disguised(self, text: str) -> list[tuple[int, int, int]]:
        copy = Copy(text)
        if not text.isascii():
            copy.fold(self.table)
        if any(x in copy.text for x in ("@", "[", "(", "{", "<", "dot", "Dot", "DOT")) and self.addresses.hint.search(copy.text):
            edits = self.addresses.edits(copy.text)
            if edits[0]:
                copy = copy.replaced(*edits)
        found = []
        for kind in range(3) if self.numbers.spelled(copy.text) else ():
            edits = self.numbers.edits(copy.text, kind)
            if edits[0]:
                found += self.rewritten(copy.replaced(*edits))
            elif kind:
                break
        return found or self.rewritten(copy)

    @staticmethod
    def rewritten(copy: Copy) -> list[tuple[int, int, int]]:
        """Identifiers of the copy that hold a rewritten character, in the source."""
        if copy.starts is None:
            return []
        return [(int(copy.starts[a]), kind, int(copy.ends[b - 1])) for a, kind, b in plain_spans(copy.text) if copy.new[a:b].any()]

    def spans(self, text: str | None) -> list[tuple[int, int, int, bool]]:
        """(start, kind number, end, base) of everything found, in order."""
        text = text or ""
        base = plain_spans(text)
        more = self.disguised(text)
        out = [(a, k, b, True) for a, k, b in base]
        if more:
            taken = Taken([(a, b) for a, _, b in base])
            out += [(a, k, b, False) for a, k, b in more if taken.add(a, b)]
        return sorted(out)

    def masked(self, text: str | None) -> str | None:
        """``text`` with every span replaced by its kind in brackets; overlapping spans as one, named by the first."""
        out, last = [], 0
        for a, kind, b, _ in self.spans(text):
            if a >= last:
                out += (text[last:a], f"[{KINDS[kind].upper()}]")
            last = max(last, b)
        return "".join([*out, text[last:]]) if out else text


def _found(texts: list[str | None], finder: Finder):
    """Rows of FOUND as an Arrow array."""
    import numpy as np
    import pyarrow as pa

    starts, kinds, ends, base, counts = array("i"), array("b"), array("i"), array("b"), array("i", [0])
    for text in texts:
        for a, k, b, plain in finder.spans(text):
            starts.append(a)
            kinds.append(k)
            ends.append(b)
            base.append(plain)
        counts.append(len(starts))
    names = pa.array(KINDS).take(pa.array(np.array(kinds, np.int8)))
    spans = pa.StructArray.from_arrays([names, pa.array(np.array(starts, np.int32)), pa.array(np.array(ends, np.int32)), pa.array(np.array(base, bool))], names=["kind", "start", "end", "base"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(np.array(counts, np.int32)), spans)], names=["spans"])


def find_pii(docs: DataFrame, text_col: str = "text", name: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with a struct ``name`` of the spans (kind, start, end, base)."""

    def make() -> Callable:
        own = Finder()
        return lambda texts: _found(texts, own)

    return annotate(docs, text_col, make, FOUND, name, keep)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with identifiers masked in the text; null texts stay null, the columns stay the same."""
    name = free_name(docs, "pii")

    def make() -> Callable:
        own = Finder()
        return lambda texts: [{"text": own.masked(t)} for t in texts]

    clean = annotate(docs, text_col, make, MASKED, name, [c for c in docs.columns if c != text_col])
    return clean.select(*[F.col(f"`{name}`.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("pii.spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("pii.spans")).alias("spans"), F.size("pii.spans").cast("long").alias("n_found"))
