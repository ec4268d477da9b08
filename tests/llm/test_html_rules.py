"""The block rules: without landmarks, furniture on any element, and hostile pages in linear time."""

import time

import pandas as pd
import pytest

from lastrum.llm.html_text import classify, main_text

PROSE = "the house of the man is on the hill and it was to be seen from the road by all who came"


def test_same_text_without_an_article_element(sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").html
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    texts = [main_text(p) for p in pages]
    assert sum(a == main_text(b) for a, b in zip(texts, bare, strict=True)) >= 0.95 * len(texts) and all(texts)


@pytest.mark.parametrize("furniture", ['<p class="advert">{}</p>', '<p class="comment">{}</p>', "<p hidden>{}</p>", '<p><span class="ad">{}</span></p>', '<p><em style="display: none">{}</em></p>', '<div role="navigation">{}</div>', '<p aria-hidden="true">{}</p>', "<textarea>{}</textarea>"])
def test_furniture_on_any_element(furniture):
    for article in ("<article>{}</article>", "<div>{}</div>"):
        page = article.format(f"<p>{PROSE} one</p>" + furniture.format(f"{PROSE} gone") + f"<p>{PROSE} two</p>")
        assert main_text(page) == f"{PROSE} one\n{PROSE} two"


def test_density_and_neighbours_decide():
    links = "".join(f'<p><a href="{i}">link number {i}</a></p>' for i in range(4))
    page = f"<div>{links}<h2>Head</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p>Last.</p>{links}<p>Loose end</p></div>"
    assert main_text(page) == f"Head\n{PROSE}\nShort.\n{PROSE}\nLast."
    assert [b.good for b in classify(page)].count(False) == 9


def test_inline_furniture_ends_with_its_element():
    assert main_text(f'<p>{PROSE} <b class="ad">x <b>y</b> z</b> end</p>') == f"{PROSE} end"
    assert main_text(f'<p>{PROSE} <b class="ad">never closed</p><p>{PROSE} next</p>') == f"{PROSE}\n{PROSE} next"


@pytest.mark.parametrize("part", ["<a ", "<div>", "<a \"'", "<ul><article>", '<p><span class="ad">', "<script", "<!--", "</div", "<li>", "&amp;", '<p class="' + "ad " * 9])
def test_two_megabytes_of_anything(part):
    began = time.perf_counter()
    main_text(part * (2_000_000 // len(part)))
    assert time.perf_counter() - began < 10
