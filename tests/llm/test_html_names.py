"""Density decides where names can't: pages without names, and names that would take the article itself."""

import re

import pandas as pd
import pytest

from lastrum.llm import html_text
from lastrum.llm.html_text import main_text

PROSE = "the house of the man is on the hill and it was to be seen from the road by all who came"


@pytest.fixture(scope="module")
def pages(sf_dir):
    """Each page as it is, without names and article, and with plain divs for its furniture too."""
    whole = pd.read_parquet(f"{sf_dir}/pages.parquet").html
    bare = [re.sub(r' (class|id|role)="[^"]*"', "", p.replace("<article>", "<div>").replace("</article>", "</div>")) for p in whole]
    return list(whole), bare, [re.sub(r"<(/?)(nav|footer|aside|header)\b", r"<\1div", p) for p in bare]


def test_pages_without_names_and_article(pages):
    whole, bare, _ = pages
    kept = gone = furniture = 0
    for p, b in zip(whole, bare, strict=True):
        text, got = main_text(p).split("\n"), main_text(b).split("\n")
        kept += sum(len(x.split()) for x in got if x in text) >= 0.9 * sum(len(x.split()) for x in text)
        others = [x.text for x in html_text.classify(b) if x.text not in text]
        furniture += sum(len(x.split()) for x in others)
        gone += sum(len(x.split()) for x in others if x not in got)
    assert kept >= 0.9 * len(whole) and gone >= 0.8 * furniture > 0


@pytest.mark.parametrize(("limit", "off"), [("STOPS", 0.0), ("LINKS", 2.0), ("GOOD", 0)])
def test_each_limit_decides_on_the_pages(pages, monkeypatch, limit, off):
    before = [main_text(p) for p in pages[2]]
    monkeypatch.setattr(html_text, limit, off)
    assert sum(a != main_text(p) for a, p in zip(before, pages[2], strict=True)) >= 0.05 * len(before)


def test_names_do_not_empty_an_article():
    assert main_text(f'<article><p class="login">{PROSE}</p></article>') == PROSE
    assert main_text(f'<article><h1>Head</h1><section class="notice-board"><h2>Sub</h2><p>{PROSE}</p><p>Short.</p></section></article>') == f"Head\nSub\n{PROSE}\nShort."
    assert main_text(f'<nav><a href="x">Home</a></nav><div class="search-results ad"><p>{PROSE}</p></div>') == PROSE
    assert main_text(f'<article><p>{PROSE}</p><div class="notice">{PROSE} {PROSE}</div></article>') == PROSE
    assert main_text(f'<article><p>Kurz.</p></article><div class="ad">{PROSE}</div>') == "Kurz."
    assert main_text(f'<article><p>Kurz.</p><div class="comments">{PROSE}</div></article>') == "Kurz."
