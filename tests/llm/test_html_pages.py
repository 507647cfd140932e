"""Pages written by hand, of kinds that the training pages don't copy: nothing of an article is lost, nothing else is kept."""

import pytest

from bitextile.llm import htmltext as H

TEXTS = [
    "The old bridge over the river was closed on Monday after inspectors found cracks in two of its piers, the council said.",
    "Traffic is sent over the northern road until further notice, which adds ten minutes to most journeys, and lorries must use the motorway.",
    "Repairs may take until spring, as parts have to be cast anew, and nobody makes them any longer in this country.",
]
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Sport</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 The Gazette. All rights reserved.</footer>"
SIDE = "<aside><h3>Most read</h3><ul><li><a href=/1>One story</a></li><li><a href=/2>Another story</a></li></ul></aside>"
COMMENTS = "<section class=comments><h3>2 comments</h3><div class=comment><p>Good riddance, I say.</p></div></section>"


def page(core, before=NAV, after=SIDE + FOOT):
    return f"<html><head><title>t</title></head><body>{before}{core}{after}</body></html>"


def cases(n):
    own = (TEXTS * 2)[:n]
    body, last = "".join(f"<p>{p}</p>" for p in own), TEXTS[2]
    return {
        "one-word heading": (page(f"<article><h1>Bridge</h1>{body}</article>"), ["Bridge", *own]),
        "in a div": (page(f"<div class=content><h1>Bridge</h1>{body}</div>"), ["Bridge", *own]),
        "heading between": (page(f"<article><h1>Bridge closed</h1><p>{own[0]}</p><h2>Why</h2>{body}</article>"), ["Bridge closed", own[0], "Why", *own]),
        "short list": (page(f"<article><h1>Bridge closed for months</h1>{body}<ul><li>Steel</li><li>Stone piers</li><li>Wood</li></ul><p>{last}</p></article>"), ["Bridge closed for months", *own, "Steel", "Stone piers", "Wood", last]),
        "steps": (page(f"<main><h1>How to cross</h1>{body}<ol><li>Turn left</li><li>Drive on</li></ol></main>"), ["How to cross", *own, "Turn left", "Drive on"]),
        "table": (page(f"<article><h1>Bridge closed for months</h1>{body}<table><tr><th>Year</th><th>Cost</th></tr><tr><td>1999</td><td>12</td></tr></table><p>{last}</p></article>"), ["Bridge closed for months", *own, "Year", "Cost", "1999", "12", last]),
        "figure": (page(f"<article><h1>Bridge closed for months</h1>{body}<figure><img src=x><figcaption>The bridge</figcaption></figure><p>{last}</p></article>"), ["Bridge closed for months", *own, "The bridge", last]),
        "line breaks": (page(f"<div class=content>{'<br><br>'.join(own)}</div>"), [" ".join(own)]),
        "quote": (page(f"<article>{body}<blockquote>We wait.</blockquote></article>"), [*own, "We wait."]),
        "article alone": (f"<article>{body}</article>", own),
        "paragraphs alone": (f"<html><body>{body}</body></html>", own),
        "in the body": (page(f"<h1>Bridge closed</h1>{body}", NAV, FOOT), ["Bridge closed", *own]),
        "no tags": ("\n".join(own), [" ".join(own)]),
        "comments": (page(f"<article><h1>Bridge</h1>{body}</article>{COMMENTS}"), ["Bridge", *own]),
        "terms": (page(f"<article><h1>Terms used</h1>{body}<dl><dt>Pier</dt><dd>What holds it</dd></dl></article>"), ["Terms used", *own, "Pier", "What holds it"]),
        "code": (page(f"<article><h1>Code</h1>{body}<pre>x = 1</pre></article>"), ["Code", *own, "x = 1"]),
        "boxes": (page(f"<div id=main><div class=row><h1>Bridge</h1>{''.join(f'<div>{p}</div>' for p in own)}</div></div>"), ["Bridge", *own]),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_nothing_of_an_article_is_lost(n):
    found = cases(n)
    got = H.extract([source for source, _ in found.values()], H.model())
    assert {k: x.split("\n") for k, x in zip(found, got)} == {k: want for k, (_, want) in found.items()}


def test_new_made_pages():
    """Pages of the generator that no part of the model has seen: few blocks on the wrong side."""
    import numpy as np

    rng, m, wrong, blocks = np.random.Generator(np.random.PCG64(99)), H.model(), 0, 0
    for _ in range(150):
        p = H.Page(H._made(rng))
        if p.blocks:
            wrong += H._wrong(p, H.decode(p, m.trees.logodds(H.features(p, m.odds)), m.begin))
            blocks += len(p.blocks)
    assert wrong < 0.03 * blocks
