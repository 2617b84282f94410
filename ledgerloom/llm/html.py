"""Main text of web pages.

The standard library's parser reads each page as a stream of events. They are gathered into lines,
one for each block of text, with the length of the text and of its links and the number of tags
(text-to-tag ratio, as in content extraction by tag ratios). The ratios are smoothed by a Gaussian
over neighbouring lines, and a threshold found by clustering the smoothed values in two groups
selects the content lines of every page, with lines whose own ratio is above it (a paragraph between
headings). What elements say of themselves are features beside it:

* navigation, headers and footers of the page, asides, forms and scripts are left out and count with a
  ratio of zero; so do elements whose class or id alone names them a notice, an advert, comments and
  the like, unless they hold half of the page's text in several lines, or all of it, or their own ratio
  is above the mean of the selected lines; the mark doesn't reach into an article or main element;
* containers that are a fifth links and have no line above the threshold, and containers that
  directly hold more links than other text, are link lists or teasers, wherever they stand;
* an article or main element is content if the threshold selects a line in it, and then with its short
  lines. If such elements hold most of the selected text, nothing outside them is content;
* elsewhere the short lines of a container go with it if most of the text that it directly holds is
  selected, headings go with what follows them, and lists, tables and quotations go with the content if
  it stands before and after them in the container that holds them;
* ``LEAST_SIMILAR`` or more containers of one kind and class beside each other, each of them a short
  line and others without a heading, are replies of readers and left out, if text with a high ratio
  that isn't of their kind stands before them, and neither in the container nor in the article or main
  element that holds them.

Defined cases: null or empty pages have empty text; unclosed, stray and unknown tags are tolerated, and
what a page ends with after its last ``>`` is text; pages are read whole, in time proportional to their
length whatever they hold; repeated rows are read each for itself; other columns are kept or not read.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser, attrfind_tolerant, tagfind_tolerant

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, table

# Elements by what they mean for the text.
SKIP = frozenset("script style noscript template svg math head title iframe object embed canvas audio video select textarea button datalist map".split())
BOILER = frozenset("nav footer aside form dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
#: Elements that hold lines of one kind together.
GROUPS = frozenset("html body article main section div ul ol dl menu table blockquote figure details center nav aside header footer form fieldset dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Shares of links from which a container without a selected line, and any container by its own lines, is a link list.
LINKED, MOSTLY_LINKED = 0.2, 0.5
#: An element marked by its class is taken at its word if it has fewer characters for a tag.
LEAST_RATIO = 50
#: Containers that go with the content around them; how many containers like one another, and how short their first line, make replies.
WITHIN = frozenset("ul ol dl table blockquote figure details".split())
LEAST_SIMILAR, SHORT = 3, 60
#: A character reference of so many digits is beyond all characters.
_HUGE = re.compile(r"&#[0-9]{1000,}")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Classes or ids, also joined by hyphens or numbered, that mark what isn't content unless the ratio says otherwise.
MARKS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup sidebar widget related recommended share sharing social comment comments disqus replies breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer header masthead toolbar skip login search".split()
)
#: An element inside which this one, left open, ends: its own kind.
CLOSES = {"p": BLOCK - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SIGMA, RADIUS = 1.0, 2
TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.IntegerType()), T.StructField("threshold", T.DoubleType())])


NOTHING = ("", False, False, 0, False, -1, 0)


def marked(named: str, main: bool) -> bool:
    """Do the classes and ids ``named`` mark an element? A header of an article is its own."""
    for token in named.lower().split():
        parts = [x for x in re.split(r"[_-]|\d+", token) if x]
        if parts and MARKS.issuperset(parts) and not (main and parts == ["header"]):
            return True
    return False


class Lines(HTMLParser):
    """Gathers lines: [text parts, tags, characters in links, left out, number of the container, heading?, marked element, floor].

    ``groups`` has for each container the number of the one around it (always a lower one), that of
    the article or main element that it lies in or is itself (-1: none), its tag and its classes. ``marks`` has for each
    element marked by its class the one around it (lower, or -1); those of a line under its floor stand
    around its article or main element and don't count.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, bool, int, bool, int, int]] = []  # tag, silent, boilerplate, container, heading, mark, floor
        self.counts: dict[str, int] = {}  # how often each tag is open
        self.marks: list[int] = []
        self.groups: list[tuple[int, int, str, str]] = [(-1, -1, "", "")]
        self.links = 0
        self.unfinished: set[int] = set()  # where attributes begin that no end of a tag follows
        self.endless: dict[str, int] = {}  # from where on a comment or section has no end
        self._new()

    def read(self, page: str) -> None:
        """Read a whole page, once."""
        at = page.rfind(">") + 1  # nothing that begins behind it ends
        self.rawdata = _HUGE.sub("&#1114112", page[:at])
        self.close()
        if at < len(page):
            self.handle_data(unescape(_HUGE.sub("&#1114112", page[at:])))

    def check_for_whole_start_tag(self, i):
        """-1 for a tag without an end; what is found not to end is remembered, so that it isn't read again from each ``<`` in it."""
        at = tagfind_tolerant.match(self.rawdata, i + 1).end()
        if at in self.unfinished:
            return -1
        end = super().check_for_whole_start_tag(i)
        while end < 0 and at not in self.unfinished:
            self.unfinished.add(at)
            one = attrfind_tolerant.match(self.rawdata, at)
            at = one.end() if one else at
        return end

    def _endless(self, kind: str, i: int, end: str) -> bool:
        if i < self.endless.get(kind, len(self.rawdata) + 1) and self.rawdata.find(end, i) < 0:
            self.endless[kind] = i
        return i >= self.endless.get(kind, len(self.rawdata) + 1)

    def parse_comment(self, i, report=1):
        if i >= self.endless.get("comment", len(self.rawdata) + 1):
            return -1
        if (end := super().parse_comment(i, report)) < 0:
            self.endless["comment"] = i
        return end

    def parse_marked_section(self, i, report=1):
        """A section ends at ``]]>``, one of unknown kind at ``>``."""
        end = "]]>" if self.rawdata.startswith("[CDATA[", i + 2) else ">"
        return -1 if self._endless(end, i, end) else self.rawdata.find(end, i) + len(end)

    def _new(self) -> None:
        _, silent, out, group, heading, mark, floor = self.open[-1] if self.open else NOTHING
        self.lines.append([[], 1, 0, out or silent, group, heading, mark, floor])

    def handle_starttag(self, tag, attrs):
        if self.open and self.open[-1][0] in CLOSES and tag in CLOSES[self.open[-1][0]]:
            self.handle_endtag(self.open[-1][0])
        self.lines[-1][1] += 1
        if tag == "a":
            self.links += 1
        if tag not in VOID:
            _, silent, out, group, heading, mark, floor = self.open[-1] if self.open else NOTHING
            main = self.groups[group][1] >= 0
            named = " ".join(v for k, v in attrs if k in ("class", "id") and v)
            role = next((v for k, v in attrs if k == "role" and v), "").lower()
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v, re.I) for k, v in attrs)
            out = out or tag in BOILER or role in ROLES or hidden or (tag == "header" and not main)
            if named and tag not in ("html", "body", *MAIN) and marked(named, main):
                self.marks.append(mark)
                mark = len(self.marks) - 1
            if tag in GROUPS or role == "main":
                self.groups.append((group, len(self.groups) if tag in MAIN or role == "main" else self.groups[group][1], tag, " ".join(v for k, v in attrs if k == "class" and v)))
                group = len(self.groups) - 1
                if self.groups[group][1] == group:
                    floor = len(self.marks)
            self.open.append((tag, silent or tag in SKIP, out, group, heading or tag in HEADINGS, mark, floor))
            self.counts[tag] = self.counts.get(tag, 0) + 1
        if tag in BLOCK:
            self._new()

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in VOID:
            if tag == "br":
                self._new()
            return
        while self.counts.get(tag):  # a stray end tag closes nothing, and isn't looked for
            last = self.open.pop()[0]
            self.counts[last] -= 1
            if last == tag:
                break
        self.lines[-1][1] += 1
        if tag in BLOCK or tag in SKIP:
            self._new()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.open and self.open[-1][1]:
            return
        self.lines[-1][0].append(data)
        if self.links:
            self.lines[-1][2] += len(data.strip())


def threshold(values: list[float]) -> float:
    """The middle between the means of the two groups that one-dimensional 2-means ends with."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above:
            return low - 1.0
        now = sum(below) / len(below), sum(above) / len(above)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def link_lists(lines: list[tuple], groups: list[tuple[int, int, str, str]], ratio: list[float], cut: float) -> list[bool]:
    """Is each container a link list or teaser, or does it lie in one?"""
    own, whole = [[0, 0] for _ in groups], [[0, 0, False] for _ in groups]  # text, links, a line above the threshold?
    for (text, _, links, out, group, *_), r in zip(lines, ratio, strict=True):
        if not out:
            own[group][0] += len(text)
            own[group][1] += links
            whole[group][2] |= r > cut
    found = []
    for g in range(len(groups) - 1, -1, -1):
        whole[g][0] += own[g][0]
        whole[g][1] += own[g][1]
        if (around := groups[g][0]) >= 0:
            whole[around] = [whole[around][0] + whole[g][0], whole[around][1] + whole[g][1], whole[around][2] or whole[g][2]]
    for g, (around, *_) in enumerate(groups):
        text, links, high = whole[g]
        found.append((around >= 0 and found[around]) or (not high and links > 0 and links >= LINKED * text))
    # what a container holds directly says nothing of the containers in it
    return [x or (links > 0 and links > MOSTLY_LINKED * text) for x, (text, links) in zip(found, own, strict=True)]


def held(lines: list[tuple], marks: list[int]) -> list[list[int]]:
    """Text, text without links, tags and lines that each marked element holds."""
    found = [[0, 0, 0, 0] for _ in marks]
    for text, tags, links, out, _, _, mark, _ in lines:
        if mark >= 0 and not out:
            found[mark] = [found[mark][0] + len(text), found[mark][1] + max(0, len(text) - links), found[mark][2] + tags, found[mark][3] + 1]
    for m in range(len(marks) - 1, -1, -1):
        if marks[m] >= 0:
            found[marks[m]] = [a + b for a, b in zip(found[marks[m]], found[m], strict=True)]
    return found


def covered(lines: list[tuple], marks: list[int], valid: list[bool]) -> list[bool]:
    """Does each line lie in an element whose mark is valid for it?"""
    nearest: list[int] = []  # the innermost valid mark
    for m, around in enumerate(marks):
        nearest.append(m if valid[m] else nearest[around] if around >= 0 else -1)
    return [mark >= 0 and nearest[mark] >= floor for *_, mark, floor in lines]


def smoothed(ratio: list[float]) -> list[float]:
    import math

    weight = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
    smooth = []
    for i in range(len(ratio)):
        near = [(weight[d + RADIUS], ratio[i + d]) for d in range(-RADIUS, RADIUS + 1) if 0 <= i + d < len(ratio)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return smooth


def replies(lines: list[tuple], groups: list[tuple[int, int, str, str]], ratio: list[float]) -> list[bool]:
    """Does each container lie in, or is it, one of several that look like replies of readers to what comes before?"""
    first: list[tuple | None] = [None] * len(groups)
    shape, began = [[0, 0] for _ in groups], [len(lines)] * len(groups)  # lines, headings; the first line
    for i, line in enumerate(lines):
        g = line[4]
        first[g], began[g] = first[g] or line, min(began[g], i)
        shape[g][0] += 1
        shape[g][1] += line[5]
    for g in range(len(groups) - 1, 0, -1):
        around = groups[g][0]
        shape[around] = [a + b for a, b in zip(shape[around], shape[g], strict=True)]
        if began[g] < began[around]:
            first[around], began[around] = first[g], began[g]
    kinds: dict[tuple, list[int]] = {}
    for g, (around, _, tag, named) in enumerate(groups):
        if named and first[g] and len(first[g][0]) < SHORT and shape[g][0] > 1 and not shape[g][1]:
            kinds.setdefault((around, tag, named), []).append(g)
    kinds = {k: own for k, own in kinds.items() if len(own) >= LEAST_SIMILAR}
    alike = {g for own in kinds.values() for g in own}
    like = [False] * len(groups)
    for g, (around, *_) in enumerate(groups):
        like[g] = g in alike or (around >= 0 and like[around])
    # where text that isn't of their kind stands: the first such line, containers and article elements that hold some
    rich = [(i, line[4]) for i, (line, r) in enumerate(zip(lines, ratio, strict=True)) if r > LEAST_RATIO and not like[line[4]]]
    start, holders, declared = rich[0][0] if rich else len(lines), {g for _, g in rich}, {groups[g][1] for _, g in rich} - {-1}
    found = [False] * len(groups)
    for (around, *_), own in kinds.items():
        if around not in holders and groups[around][1] not in declared:
            for g in own:
                found[g] = began[g] > start
    for g, (around, *_) in enumerate(groups):
        found[g] = found[g] or (around >= 0 and found[around])
    return found


def within(lines: list[tuple], groups: list[tuple[int, int, str, str]], kept: list[bool]) -> list[bool]:
    """Does each container lie in a list, table or quotation with content before and after it in the container that holds it?"""
    began, first, last = [-1] * len(groups), [len(lines)] * len(groups), [-1] * len(groups)
    for i, (line, k) in enumerate(zip(lines, kept, strict=True)):
        g = line[4]
        began[g] = i if began[g] < 0 else began[g]
        if k:
            first[g], last[g] = min(first[g], i), i
    for g in range(len(groups) - 1, 0, -1):
        if began[g] >= 0 and (began[groups[g][0]] < 0 or began[g] < began[groups[g][0]]):
            began[groups[g][0]] = began[g]
    found = [False] * len(groups)
    for g, (around, _, tag, _) in enumerate(groups):
        found[g] = around >= 0 and (found[around] or (tag in WITHIN and first[around] < began[g] < last[around]))
    return found


def selected(lines: list[tuple], groups: list[tuple[int, int, str, str]], high: list[bool], usable: list[bool], doubted: list[bool]) -> list[bool]:
    """The lines of the content: those ``high``, and of the others ``usable`` those that their elements tie to them; ``doubted`` ones (marked by a class) have no say against article and main elements."""
    chosen = [False] * len(groups)
    for (*_, group, _, _, _), x in zip(lines, high, strict=True):
        while x and group >= 0 and not chosen[group]:
            chosen[group], group = True, groups[group][0]
    declared = [groups[line[4]][1] for line in lines]
    inside = sum(len(line[0]) for line, x, d in zip(lines, high, declared, strict=True) if x and d >= 0)
    outside = sum(len(line[0]) for line, x, d, doubt in zip(lines, high, declared, doubted, strict=True) if x and d < 0 and not doubt)
    kept = [use and d >= 0 and chosen[d] for use, d in zip(usable, declared, strict=True)]
    if inside and inside >= outside:
        return kept
    own: dict[int, list[int]] = {}  # selected and usable text that a container holds directly
    for line, x, use in zip(lines, high, usable, strict=True):
        own.setdefault(line[4], [0, 0])
        own[line[4]][0] += len(line[0]) * x
        own[line[4]][1] += len(line[0]) * use
    kept = [k or x or (use and 0 < own[line[4]][1] <= 2 * own[line[4]][0]) for k, x, use, line in zip(kept, high, usable, lines, strict=True)]
    for i in range(len(lines) - 2, -1, -1):
        kept[i] = kept[i] or (usable[i] and lines[i][5] and kept[i + 1])
    between = within(lines, groups, kept)
    return [k or (use and between[line[4]]) for k, use, line in zip(kept, usable, lines, strict=True)]


def main_text(page: str | None) -> dict:
    """text, number of content lines and threshold of one page."""
    if not page:
        return {"text": "", "lines": 0, "threshold": None}
    reader = Lines()
    reader.read(page)
    # HTML's white space; other space characters of a text are kept as one space too
    lines = [(" ".join("".join(parts).split()), *rest) for parts, *rest in reader.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return {"text": "", "lines": 0, "threshold": None}
    ratio = [0.0 if out else max(0, len(text) - links) / tags for text, tags, links, out, *_ in lines]
    answers = replies(lines, reader.groups, ratio)
    if any(answers):
        lines = [(*line[:3], line[3] or answers[line[4]], *line[4:]) for line in lines]
        ratio = [0.0 if line[3] else r for line, r in zip(lines, ratio, strict=True)]
    whole, marks = sum(len(line[0]) for line in lines if not line[3]), held(lines, reader.marks)
    valid = [text < whole and (2 * text < whole or n == 1) for text, _, _, n in marks]
    doubted = covered(lines, reader.marks, valid)
    smooth = smoothed([0.0 if x else r for x, r in zip(doubted, ratio, strict=True)])
    cut = threshold(smooth)
    if any(doubted):
        content = [r for r, v, x in zip(ratio, smooth, doubted, strict=True) if v > cut and not x]
        usual = max(cut, LEAST_RATIO, sum(content) / max(1, len(content)))
        valid = [v and not (tags and text > usual * tags) for v, (_, text, tags, _) in zip(valid, marks, strict=True)]
        out = covered(lines, reader.marks, valid)
        ratio = [0.0 if x else r for x, r in zip(out, ratio, strict=True)]
        smooth = smoothed(ratio)
        lines = [(*line[:3], line[3] or x, *line[4:]) for x, line in zip(out, lines, strict=True)]
    lists = link_lists(lines, reader.groups, ratio, cut)
    usable = [not line[3] and not lists[line[4]] for line in lines]
    if not any(usable):  # nothing but links
        usable = [not line[3] for line in lines]
    high = [use and (s > cut or r > cut) for use, s, r in zip(usable, smooth, ratio, strict=True)]
    kept = selected(lines, reader.groups, high if any(high) else usable, usable, covered(lines, reader.marks, [True] * len(marks)))
    found = [line[0] for line, k in zip(lines, kept, strict=True) if k]
    return {"text": " ".join(found), "lines": len(found), "threshold": cut}


def extract(pages: DataFrame, html_col: str = "html", name: str = "main", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (columns ``keep``) with a struct ``name``: text, lines, threshold."""
    return annotate(pages, html_col, lambda: lambda texts: [main_text(t) for t in texts], TEXT, name, keep)


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.select("page_id", "url", "main.text", F.length("main.text").cast("long").alias("n_chars"))
