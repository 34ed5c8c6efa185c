"""What the ratios decide: pages without declared articles, doubtful names, and time on long pages."""

import time

import numpy as np
import pytest

from brasstally.llm import extraction
from brasstally.llm.extraction import main_text

LONG = "A paragraph of the article that is long enough to be chosen as text of the page, with some words more."
LINKS = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
UNNAMED = f"<body><div><ul>{LINKS}</ul></div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><ul><li>one</li></ul></div><div><a href=x>More</a> <a href=y>Next</a></div></body>"


def slow_selection(lines, sigma=1.0):
    """Ratios, smoothing and two clusters by plain loops."""
    ratio = [np.log1p(len(t) / max(tags, 1)) for t, tags, *_ in lines]
    at = lambda i: ratio[min(max(i, 0), len(ratio) - 1)]
    weights = [np.exp(-(d**2) / (2 * sigma**2)) for d in range(-2, 3)]
    smooth = [sum(w * at(i + d) for d, w in zip(range(-2, 3), weights, strict=True)) / sum(weights) for i in range(len(ratio))]
    low, high = min(smooth), max(smooth)
    for _ in range(32):
        a = [x for x in smooth if x <= (low + high) / 2]
        b = [x for x in smooth if x > (low + high) / 2]
        if not a or not b:
            break
        low, high = float(np.mean(a)), float(np.mean(b))
    return [max(r, x) >= ((low + high) / 2 if high > low else low - 1) for r, x in zip(ratio, smooth, strict=True)]


def test_selection_against_slow_one():
    r = np.random.default_rng(1)
    for _ in range(200):
        lines = [("x" * int(r.integers(1, 400)), int(r.integers(0, 9)), 0, False, 0, 0) for _ in range(r.integers(1, 40))]
        assert extraction._selected(lines).tolist() == slow_selection(lines)


def test_unnamed_menus_go_by_their_ratios(monkeypatch):
    want = f"Title {LONG} {LONG} one"
    assert main_text(UNNAMED) == want
    # without the clustering, or without the ratios, they stay
    monkeypatch.setattr(extraction, "_selected", lambda lines: np.ones(len(lines), bool))
    assert main_text(UNNAMED) != want and "Link 3" in main_text(UNNAMED)


def test_smoothing_changes_the_selection(monkeypatch):
    pages = [f"<body><div><p>{LONG}</p><p>{'w ' * k}</p><p>{LONG}</p></div><div><a href=x>{'m ' * 12}</a></div></body>" for k in range(1, 30)]
    lines = []
    for html in pages:
        page = extraction._Lines()
        page.feed(html)
        page.close()
        page.end_line()
        lines.append(page.lines)
    before = [extraction._selected(x).tolist() for x in lines]
    monkeypatch.setattr(extraction, "smoothed", lambda r: r)
    assert before != [extraction._selected(x).tolist() for x in lines]


@pytest.mark.parametrize("name", ["legal-analysis", "notice-period", "adsense", "header-story", "commentary", "sharecropping-essay"])
def test_doubtful_names_with_content_stay(name):
    assert main_text(f"<body><article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article></body>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("name", ["cookie-notice", "nav-list", "site-footer", "ad", "sidebar-left", "comments", "cookieBar", "share-buttons", "footer-links", "comment-author", "related-posts", "post-comments", "newsletter-signup"])
def test_sure_names_go(name):
    assert main_text(f"<body><article><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article></body>") == LONG


def test_doubtful_names_without_content_go():
    assert main_text(f"<body><article><p>{LONG}</p><p>{LONG}</p><div class='share-things'><ul>{LINKS}</ul></div></article></body>") == f"{LONG} {LONG}"


def test_headers_in_articles_are_headers():
    assert main_text(f"<body><article><header><h1>Site</h1></header><p>{LONG}</p></article></body>") == LONG


def test_short_blocks_between_selected_ones_stay():
    assert main_text(f"<body><div><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div></div></body>") == f"{LONG} Short. {LONG}"
    # what no element holds together with selected lines is no part of the article
    assert main_text(f"<body><div><p>Short start.</p></div><div><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("html", ["<span><br>" * 8000, "<div><span>" * 8000, "<ul><li><br>" * 4000, "<p><b>x" * 8000, "<p>" + "<i>" * 20_000 + "</b>" * 20_000])
def test_long_pages_take_little_time(html):
    began = time.perf_counter()
    main_text(html + "end")
    assert time.perf_counter() - began < 5
