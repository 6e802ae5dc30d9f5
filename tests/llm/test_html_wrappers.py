"""Wrappers of the main text are no furniture."""

import pytest

from tidemark.llm import html


@pytest.mark.parametrize(
    "source,text",
    [
        ("<div class='layout with-sidebar'><article>a</article><div class='sidebar'>s</div></div>", "a"),
        ("<body class='x'><form><div class='no-sidebar with-nav'><main>m</main><nav>n</nav></div></form>", "m"),
        ("<div class='comment-enabled'><div role='main'>r</div><div class='comments'>c</div></div>", "r"),
        ("<div class='has-sidebar'><section><article>a</article></section><article>b</article></div><div role=main class='with-nav'>c</div>", "a b"),
        ("<div role=main class='with-nav'>c</div>", "c"),
        ("<article>a<div class='related'><article>teaser</article></div></article>", "a"),
        ("<article>a</article><div class='comments'><article class='comment'>c</article></div>", "a"),
    ],
)
def test_wrappers(source, text):
    page = html.Page(source)
    gone = page.furniture()
    assert page.text(gone, page.main(gone)) == text
