"""Pages generated around a known article: its text, whole and alone, must come out."""

from __future__ import annotations

import html
import random

import pytest

from reelgrid.llm import html_extract

WORDS = "house river tree water stone green small old road field door window paper garden light winter".split()
STOPS = "the of and to in that it was for on with as he they at by from his had not".split()


def _sentence(rng, n):
    return " ".join(rng.choice(STOPS) if rng.random() < 0.45 else rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def _escaped(rng, text):
    out = html.escape(text)
    return out.replace(" ", rng.choice([" ", "\n  ", " "]), 1).replace("and", "&#97;nd", 1)


def _boilerplate(rng):
    link = lambda: f'<a href="/{rng.randrange(99)}">{rng.choice(WORDS).title()}</a>'
    return rng.choice([
        lambda: "<nav><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(1, 9))) + "</ul></nav>",
        lambda: f'<div class="cookie-notice"><p>We use cookies. {link()}</p></div>',
        lambda: f'<aside class="sidebar"><h3>Related</h3>{link()}<br>{link()}</aside>',
        lambda: "<form action='/s'><label>Name</label><input name=q><button>Go</button></form>",
        lambda: f'<div id="comments"><div class="comment"><p>{_sentence(rng, 14)}</p></div></div>',
        lambda: f'<div class="ad">Buy {rng.choice(WORDS)} now</div>',
        lambda: "<script>if (a < b) { document.write('<p>no</p>') }</script><style>p { color: red }</style><!-- <p>no</p> -->",
        lambda: "<noscript><p>Turn on scripts</p></noscript><template><p>no</p></template>",
    ])()


@pytest.mark.parametrize("seed", range(60))
def test_the_article_comes_out(seed):
    rng = random.Random(seed)
    blocks, body = [], []
    title = _sentence(rng, 5)[:-1]
    blocks.append(title)
    body.append(f"<h1>{_escaped(rng, title)}</h1>")
    for _ in range(rng.randrange(2, 9)):
        text = " ".join(_sentence(rng, rng.randrange(9, 25)) for _ in range(rng.randrange(1, 5)))
        blocks.append(text)
        inner = _escaped(rng, text)
        if rng.random() < 0.3:
            at = inner.index(" ", 10)
            inner = f"{inner[:at]} <b>{inner[at + 1:]}</b>"
        body.append(rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<section><p class='text'>{}</p></section>"]).format(inner))
    wrap = rng.choice(["<article>{}</article>", "<main><article class='post'>{}</article></main>", "<div role='main'>{}</div>", "<main id='content'>{}</main>"])
    before, after = ("".join(_boilerplate(rng) for _ in range(rng.randrange(4))) for _ in range(2))
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body><header><a href='/'>Site</a></header>{before}{wrap.format(''.join(body))}{after}<footer>&copy; 2020 Site</footer></body></html>"
    assert html_extract.main_text(page, "\n\n") == "\n\n".join(blocks)


@pytest.mark.parametrize("seed", range(30))
def test_long_prose_without_an_article_element(seed):
    """Only density decides here: long blocks of prose stay, link lists go."""
    rng = random.Random(seed)
    prose = [" ".join(_sentence(rng, rng.randrange(18, 30)) for _ in range(3)) for _ in range(rng.randrange(2, 6))]
    links = "<ul>" + "".join(f'<li><a href="{i}">{rng.choice(WORDS)}</a></li>' for i in range(6)) + "</ul>"
    page = f"<body><div class='top'>{links}</div>" + "".join(f"<div>{_escaped(rng, p)}</div>" for p in prose) + f"<div>{links}</div></body>"
    assert html_extract.main_text(page, "\n\n") == "\n\n".join(prose)
