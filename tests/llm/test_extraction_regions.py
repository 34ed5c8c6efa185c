"""Articles in several elements, and pages that declare none."""

import pytest

from brasstally.llm import extraction

LONG = "A paragraph of the article that is long enough to be chosen as text of the page, with some words more."

DECLARED = [
    (f"<body><article><p>{LONG}</p><p>Short.</p></article><article><p>{LONG}</p><p>End.</p></article></body>", f"{LONG} Short. {LONG} End."),
    (f"<body><div><p>Before: {LONG}</p></div><article><h1>Title</h1><p>{LONG}</p></article></body>", f"Before: {LONG} Title {LONG}"),
    (f"<body><main><article><p>{LONG}</p></article><p>{LONG}</p></main></body>", f"{LONG} {LONG}"),
]
PLAIN = [
    (f"<body><div><h1>T</h1>{f'<p>{LONG}</p>' * 12}</div><div><h2>Last</h2><p>{LONG}</p></div></body>", f"T {' '.join([LONG] * 12)} Last {LONG}"),
    (f"<h1>Title</h1><p>{LONG}</p><p>Yes.</p><p>{LONG}</p><p>{LONG}</p>", f"Title {LONG} Yes. {LONG} {LONG}"),
]


@pytest.mark.parametrize(("html", "text"), DECLARED)
def test_declared_articles(html, text):
    assert extraction.main_text(html) == text


@pytest.mark.parametrize(("html", "text"), PLAIN)
def test_pages_without_declared_article(html, text):
    assert extraction.main_text(html) == text
