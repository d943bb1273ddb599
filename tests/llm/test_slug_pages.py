"""Pages whose ids and classes are made from titles, made with the text that belongs to them."""

import random
import re

import pytest

from viatrix.llm.html_extract import main_text

TITLES = ["Social impact", "Search and rescue", "Related work", "Market share", "Water tags in use", "The comment on law", "Header files explained", "Notice of motion", "Menu prices rise", "Footer of a mountain", "A sponsor for science", "Login habits", "Plain words"]
PARTS = ['<section class="comments"><h3>Comments</h3><p>first, I say!</p></section>', '<div id="related-posts"><h3>More stories</h3><a href="/x">another</a></div>', '<aside><p>Buy, now</p></aside>', '<div class="share-buttons"><a>post it</a></div>', '<p class="advertisement">Buy, buy, buy</p>', '<div class="ad-slot-1">Cheap, things</div>', '<form><label>Mail</label><button>Send</button></form>', '<ul class="tags"><li><a>one</a></li></ul>', '<p class="cookie-notice">We use, cookies</p>']


def slug(title):
    return re.sub(r"[^a-z]+", "-", title.lower())


@pytest.mark.parametrize("seed", range(60))
def test_titles(seed):
    """Headings, sections and paragraphs stay whatever their titles; parts of the page go wherever they stand."""
    r, blocks, out = random.Random(seed), [], []
    say = lambda n: " ".join(r.choice(["water", "law, and", "runs", "over", "stone,", "again"]) for _ in range(n)) + "."
    for title in r.sample(TITLES, 6):
        kind, text, more = r.choice(["h2", "section", "p"]), say(40), say(8)
        if r.random() < 0.5:
            more += " Press <button>OK</button>to go on."
        plain = more.replace("<button>OK</button>", "")
        head = f"<h2 id='{slug(title)}'>{title}</h2>" if kind == "h2" else f"<h2>{title}</h2>"
        body = f"<p class='{slug(title) if kind == 'p' else 'text'}'>{text}</p><p>{more}</p>"
        blocks.append(f'<section id="{slug(title)}">{head}{body}</section>' if kind == "section" else head + body)
        out += [title, text, plain]
        if r.random() < 0.6:
            blocks.append(r.choice(PARTS))
    page = f"<html><body><nav><a>Home</a></nav><article><h1>News, today</h1>{''.join(blocks)}</article><footer>All rights, reserved</footer></body></html>"
    assert main_text(page) == "\n".join(["News, today", *[" ".join(x.split()) for x in out]])


@pytest.mark.parametrize("name", ["row", "part", "text-block"])
def test_rows_of_one_text(name):
    """Without an article element: siblings of the best element's tag and class belong to it, however short."""
    long_ = "One, two, three, and a good deal more of the same, which goes on."
    rows = [f"<p>{long_}</p><p>{long_}</p>", "<p>Short</p>", "<ul><li>first</li><li>second</li></ul>", f"<p>{long_}</p>"]
    page = f"<body><div class='menu'><a>Home</a><a>News</a></div><div>{''.join(f'<div class={name!r}>{x}</div>' for x in rows)}<div class='footer'>All, rights</div></div></body>"
    assert main_text(page) == "\n".join([long_, long_, "Short", "first", "second", long_])


def test_a_section_without_heading_goes():
    page = '<article><p>One, two, three, four, five.</p><section class="promo-strip"><p>Buy, now</p></section><section class="market-share"><h2>Share</h2><p>Seven, eight</p></section></article>'
    assert main_text(page) == "One, two, three, four, five.\nShare\nSeven, eight"
