"""Pages that are hostile, or whose parts only their structure tells apart."""

from __future__ import annotations

import time

import pytest

from ledgerloom.llm import html

PARA = "Some long sentence of an article that goes on with many words in it, so that its ratio is high. " * 3
OTHER = "Quite another sentence that nobody wrote for the article but which is as long as the others are. " * 3
text = lambda page: html.main_text(page)["text"]
UNITS = ["a <b", "<!--", '<a href="x ', '<a href="x>y" ', "<!-- x > ", "<![CDATA[ > ", "<![foo[ ", "<? ", "</a ", "<a y='>' ", "<", "<div>", "<p>x</p>", '<a x="', "&#", "&#9", "&amp", "<script>", "</", "<a =", "<ul><li>x", "<![ ", "<!d", "<table>", "</div>"]


@pytest.mark.parametrize("unit", UNITS)
def test_long_hostile_pages(unit):
    """Twice the page takes about twice the time: a page of a megabyte takes seconds, whatever it holds."""
    for tail in ("", ">"):
        began = time.process_time()
        html.main_text(unit * ((1 << 20) // len(unit)) + tail)
        assert time.process_time() - began < 20


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p>x <b y", "a x <b y"), ("<p>one</p>&amp; <i", "one & <i"), ("<p>a</p><![foo[ b ]>c", "a c"), ("<p>a<!-- b", "a<!-- b"), ("<p>a</p><![CDATA[ b > c ]]>d", "a d"), ("&#" + "9" * 5000 + "; a", "� a"), ("<b title='x>y'>b</b> c", "b c"), ("no tags at all", "no tags at all"), ("<", "<"), (">", ">"), ("<p", "<p"),
    ],
)
def test_unfinished_markup(page, want):
    assert text(page) == want


def test_lists_and_tables_within_the_content():
    table = "<table><tr><td>cell one</td><td>cell two</td></tr></table><ul><li>first item</li><li>second item</li></ul>"
    page = f"<body><div><p>{PARA}</p><p>{PARA}</p>{table}<p>{PARA}</p></div></body>"
    assert text(page) == " ".join([PARA.strip(), PARA.strip(), "cell one cell two first item second item", PARA.strip()])
    # neither before the content nor after it
    assert "cell" not in text(f"<body><div>{table}<p>{PARA}</p><p>{PARA}</p></div></body>") and "item" not in text(f"<body><div><p>{PARA}</p><p>{PARA}</p></div><div>{table}</div></body>")
    links = "<ul>" + "".join(f"<li><a href='{i}'>link {i}</a></li>" for i in range(5)) + "</ul>"
    assert "link" not in text(f"<body><div><p>{PARA}</p><p>{PARA}</p>{links}<p>{PARA}</p></div></body>")


def test_replies_of_readers():
    says = "".join(f'<div class="user-feedback"><p>Anna {i}</p><p>{OTHER}</p></div>' for i in range(6))
    article = f"<h1>Title</h1><p>{PARA}</p><p>{PARA}</p>"
    want = f"Title {PARA.strip()} {PARA.strip()}"
    for page in (f'<article>{article}</article><div class="reader-responses">{says}</div>', f'<div class="story">{article}</div><section>{says}</section>', f'<main><div>{article}</div></main><div><div>{says}</div></div>'):
        assert text(f"<body>{page}</body>") == want
    # alike, yet the article itself: with headings, in the article element, or with nothing before
    parts = "".join(f'<div class="part"><h2>Part {i}</h2><p>{OTHER}</p></div>' for i in range(4))
    assert text(f"<body><div>{article}</div><div>{parts}</div></body>").count("nobody wrote") == 4 * 3
    assert text(f"<body><article>{article}<div>{says}</div></article></body>").count("nobody wrote") == 6 * 3
    assert text(f"<body><div>{says}</div></body>").count("nobody wrote") == 6 * 3
