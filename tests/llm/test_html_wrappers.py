"""Boilerplate words on a wrapper of the page's main part don't take its text; on real boilerplate they do."""

import numpy as np
import pytest

from fieldloom.llm import html_cut

TEXT = [f"This is the {n} paragraph of the article, and it tells a long story, with commas and full stops." for n in ("first", "second", "third", "fourth")]
BODY = "".join(f"<p>{x}</p>" for x in TEXT)
SIDE = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"
NOISE = "<div class='comments'><p>Bad comment.</p></div><div class='ad'>Buy it now.</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"{SIDE}<div id='page' class='has-sidebar'><article>{BODY}</article>{NOISE}</div>",
        f"{SIDE}<article class='post no-comments'>{BODY}</article>{NOISE}",
        f"{SIDE}<main class='share-enabled'>{BODY}{NOISE}</main>",
        f"{SIDE}<div class='layout sidebar-right'><div>{BODY}</div></div>{NOISE}",
        f"{SIDE}<div class='widget-page'><main class='share'><article class='entry reply-open'>{BODY}</article></main>{NOISE}</div>",
        f"{SIDE}<article class='no-comments'><p>{TEXT[0]}</p><p>{TEXT[1]}</p><p>{TEXT[2]}</p><p>{TEXT[3]}</p></article><div class='comments'>{'<article class=comment><p>I think so too.</p></article>' * 60}</div>",
        f"<form id=aspnetForm>{SIDE}<main>{BODY}</main><div><input name=q></div>{NOISE}</form>",
    ],
)
def test_wrapped_articles_come_out(page):
    assert html_cut.main_text(page, html_cut.PLAIN_WEIGHTS) == "\n".join(TEXT)


def test_boilerplate_beside_the_article_stays_out():
    page = f"<div class='ad-content'><p>{TEXT[0]}</p></div><article>{BODY}<div class='related'><p>{TEXT[1]}</p></div></article><aside><article>{BODY}</article></aside>"
    assert html_cut.main_text(page, html_cut.PLAIN_WEIGHTS) == "\n".join(TEXT)


def test_the_cut_turns_labels():
    """A short piece that the classifier alone takes for boilerplate stays with the paragraphs around it, and vice versa."""
    kept = f"<div><p>{TEXT[0]}</p><div>Short piece here.</div><p>{TEXT[1]}</p></div>"
    blocks = html_cut.blocks_of(kept)
    alone = html_cut.features(blocks) @ html_cut.PLAIN_WEIGHTS > 0
    assert alone.tolist() == [True, False, True]
    assert html_cut.main_text(kept, html_cut.PLAIN_WEIGHTS) == "\n".join([TEXT[0], "Short piece here.", TEXT[1]])
    item = "<li><a href=x>News</a></li>"
    menu = f"<ul>{item * 3}<li><p>See all news.</p></li>{item * 3}</ul>"
    blocks = html_cut.blocks_of(menu)
    alone = html_cut.features(blocks) @ html_cut.PLAIN_WEIGHTS > 0
    assert alone.any()
    assert html_cut.main_text(menu, html_cut.PLAIN_WEIGHTS) == ""


def test_learnt_weights_let_text_and_markup_decide():
    """Markup outweighs the look of a text, and pages without markup are told by their texts."""
    pages = [f"<body>{SIDE}<article><h1>Title of {k}</h1>{BODY}</article>{NOISE}<footer>Copyright {k}</footer></body>" for k in range(40)]
    blocks = [html_cut.blocks_of(p) for p in pages]
    x = [html_cut.features(b) for b in blocks]
    w = html_cut.fit_blocks(np.concatenate(x), np.array([float(b.content and not b.boiler) for bs in blocks for b in bs]))
    page = f"<article><h1>Title</h1>{BODY}</article><footer><p>{TEXT[0]}</p></footer><section class=comments><p>{TEXT[1]}</p></section>"
    assert html_cut.main_text(page, w) == "\n".join(["Title", *TEXT])
    assert html_cut.main_text(f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div>{BODY}</div><div>Imprint</div></body>", w) == "\n".join(TEXT)
