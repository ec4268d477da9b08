"""An article within furniture is taken; furniture within an article isn't, nor articles in closed asides and comments."""

import pytest

from lastrum.llm import html_text

BODY = "<h1>Head</h1><p>First text here.</p><div class=ad>Buy</div><form><label>Mail</label></form><p>Last.</p>"
ARTICLE = f"<article>{BODY}</article>"
WRAPPED = [
    f"<form action=x>{ARTICLE}</form>",
    *(f"<div class='{c}'>{ARTICLE}</div>" for c in ("has-sidebar", "sidebar", "modal", "header", "search", "login", "page has-comments")),
    *(f"<{open_}><p>Furniture</p>{ARTICLE}" for open_ in ("div class=ad", "aside", "header", "footer", "nav")),
    f"<div><aside><p>Furniture</p>{ARTICLE}</div>",
    f"<form><main>{BODY}</main></form>",
    f"<main><div class=has-sidebar>{ARTICLE}</div></main>",
    f"<header><p>Site</p>{ARTICLE}</header>",
]
BESIDE = [
    f"{ARTICLE}<aside><article><p>Another story of the day.</p></article></aside>",
    f"{ARTICLE}<section id=comments><article><p>I read it.</p></article></section>",
    f"{ARTICLE}<div hidden><article><p>Not shown.</p></article></div>",
    f"{ARTICLE}<footer><article><p>About.</p></article></footer>",
    f"<article>{BODY}<div class=related><article><p>Another.</p></article></div><article class=comment><p>I read it.</p></article></article>",
]


@pytest.mark.parametrize("page", [*WRAPPED, *BESIDE])
def test_only_the_article_is_good(page):
    good = [b.text for b in html_text.classify(f"<html><body>{page}</body></html>") if b.landmark and not b.furniture]
    assert good == ["Head", "First text here.", "Last."]
