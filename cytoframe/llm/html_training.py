"""A small labelled table of page blocks: pages put together from hand-written parts, ``data-main`` says whether what follows is main text.

Each part has a form that names what it is and forms that name nothing, so that a page's parts can often be told by their words and links only.
"""

from __future__ import annotations

from itertools import cycle

_LONG = "The valley was quiet when the survey team arrived in early spring, and the river had not yet begun to rise over the meadows below the old mill."
_OTHER = "Residents said that the plan, first drawn up ten years ago, had been changed many times before the council agreed to vote on it last week."
_MID = "Measurements taken over three seasons agree with the earlier report."
_HUGE = f"{_LONG} {_OTHER} {_MID} {_LONG} {_OTHER}"

# bodies of articles, as lists of (tag, text)
ARTICLES = (
    (("h1", "Spring in the valley"), ("p", _LONG), ("p", "Quiet."), ("p", _OTHER)),
    (("h1", "Results"), ("p", _MID), ("p", _LONG), ("p", "It was late."), ("p", _HUGE)),
    (("h2", "Council votes"), ("p", _OTHER), ("p", _HUGE), ("p", _MID)),
    (("h1", "A long walk home through the hills and back to the sea"), ("p", _HUGE), ("p", _LONG), ("p", _OTHER)),
    (("h1", "Notes"), ("p", _MID), ("blockquote", _LONG), ("p", 'See <a href="/s">the study</a> for more on what the river did in the years before.')),
    (("p", _OTHER), ("p", _LONG), ("p", _MID)),
    (("h1", "One more winter"), ("p", _HUGE), ("p", "Nobody came."), ("p", "Then it rained for a week, as it does."), ("p", _HUGE)),
    (("h1", "Figures"), ("p", _LONG), ("p", 'Read <a href="/q">the tables of the year before</a>, which show how far the water came and how long it stayed on the fields.'), ("p", _OTHER)),
    (("h1", "Short of breath"), ("p", "Yes. It was cold that day, and all of us were glad to be home."), ("p", _LONG)),
)

# what stands around articles: a form with names, and forms without
MENUS = (
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>',
    '<div><div><a href="/">Home</a></div><div><a href="/news">News and views</a></div><div><a href="/about">About</a></div></div>',
    '<div><a href="/">Start</a> | <a href="/x">Archive of all years</a> | <a href="/y">Contact</a></div>',
    '<ul><li><a href="/1">Weather</a></li><li><a href="/2">Sport and leisure</a></li><li><a href="/3">Books</a></li></ul>',
)
NOTICES = (
    '<div class="cookie-notice">We use cookies to make this site work and to learn how people read it, as the law allows.</div>',
    '<div>We use cookies to make this site work. <a href="/ok">Accept all cookies and go on</a> <a href="/no">Refuse</a></div>',
    '<div><a href="/u">Sign in</a> or <a href="/v">subscribe now to read on</a></div>',
)
ADVERTS = (
    '<div class="ad">Buy one, get one free.</div>',
    f'<div class="advert">{_MID}</div>',
    '<div><a href="/b">Buy one pair of boots and get the second one free</a></div>',
    '<div><a href="/c">Cheap flights from six cities</a> Today only</div>',
)
LISTS = (
    f'<section class="related"><p>{_OTHER}</p></section>',
    f'<aside><p>{_MID}</p></aside>',
    f'<div class="sidebar"><p>{_LONG}</p></div>',
    '<div><div><a href="/r1">How the mill was saved from the flood</a></div><div><a href="/r2">Ten walks in the hills</a></div></div>',
    '<ul><li><a href="/p">Previous story of the week</a></li><li><a href="/n">Next story</a></li></ul>',
)
COMMENTS = (
    f'<div class="comments"><p>{_LONG}</p><p>I agree.</p></div>',
    f'<section id="comments"><div><p>{_OTHER}</p><p>{_MID}</p></div></section>',
    '<div><a href="/u/anna">anna</a> <a href="/u/anna/2">2 days ago</a></div><div>I agree.</div><div><a href="/reply">Reply</a> <a href="/flag">Report</a></div>',
    '<div><a href="/u/otto">otto</a></div><div>Well said, my thoughts too.</div><div><a href="/reply">Reply</a></div>',
    f'<form><p>{_MID}</p></form>',
)
FOOTERS = (
    "<footer>&copy; 2020 Example Press. All rights reserved.</footer>",
    '<footer>&copy; press.example.com &middot; The valley was quiet when the survey team came.</footer>',
    '<div><a href="/t">Terms of use</a> <a href="/p">Privacy</a> <a href="/i">Imprint</a></div><div>Copyright Example</div>',
    '<div><a href="/top">Top</a></div><div>Page 3</div>',
)
WRAPS = ("<article>{}</article>", "<div>{}</div>", "<main>{}</main>", "{}", "<div><div>{}</div></div>")


def _article(parts: tuple[tuple[str, str], ...], wrap: str, inside: str, unclosed: bool) -> str:
    cells = [f'<{tag} data-main="1">{text}' + ("" if unclosed and tag == "p" else f"</{tag}>") for tag, text in parts]
    if inside:
        cells.insert(min(2, len(cells)), _other(inside))
    return wrap.format("".join(cells))


def _other(part: str) -> str:
    """A part whose blocks aren't main text."""
    for tag in ("div", "p", "li", "nav", "ul", "footer", "aside", "section", "form"):
        part = part.replace(f"<{tag}>", f'<{tag} data-main="0">').replace(f"<{tag} class", f'<{tag} data-main="0" class').replace(f"<{tag} id", f'<{tag} data-main="0" id')
    return part


def _pages(n: int = 60) -> tuple[str, ...]:
    """n pages: their parts go through their forms at different paces."""
    at = {k: cycle(v) for k, v in {"menu": MENUS, "notice": NOTICES, "advert": ADVERTS, "list": LISTS, "comment": COMMENTS, "footer": FOOTERS, "wrap": WRAPS, "article": ARTICLES}.items()}
    out = []
    for i in range(n):
        head = _other(next(at["menu"])) * (i % 5 != 4) + _other(next(at["notice"])) * (i % 3 == 0) + _other(next(at["advert"])) * (i % 2)
        inside = next(at["advert"]) if i % 4 == 1 else ""
        tail = _other(next(at["list"])) * (i % 3 != 1) + _other(next(at["comment"])) * (i % 5 < 3) + _other(next(at["footer"])) * (i % 7 != 6)
        out.append(f'<html><body>{head}{_article(next(at["article"]), next(at["wrap"]), inside, i % 6 == 5)}{tail}</body></html>')
    return tuple(out)


#: Pages of few blocks, where neighbours are missing.
SMALL = (
    f'<p data-main="1">{_OTHER}</p><p data-main="1">{_LONG}</p><p data-main="1">{_MID}</p>',
    f'<div data-main="1">{_LONG}</div>',
    f'<p data-main="1">{_MID}</p>',
    '<p data-main="1">A few words stand here.</p>',
    '<p data-main="1">Rain fell.</p>',
    '<article><h1 data-main="1">One word</h1><p data-main="1">Yes.</p><p data-main="1"><a href="/l">A whole paragraph that is a link</a></p><p data-main="1">No.</p></article>',
    f'<article><p data-main="1">{_LONG}</p><ul><li data-main="1">Salt</li><li data-main="1">Flour</li><li data-main="1"><a href="/w">Water</a></li></ul><table><tr><td data-main="1">Name</td><td data-main="1">Weight</td></tr></table></article>',
    f'<article><p data-main="1">{_MID}</p><p data-main="1">Over.</p></article>',
    '<article><h1 data-main="1">Only a title</h1></article>',
    '<article><p data-main="1">Yes</p><p data-main="1">No</p><p data-main="1">Maybe.</p></article>',
    f'<body>{_other(MENUS[0])}<article><p data-main="1">Brief.</p></article>{_other(FOOTERS[0])}</body>',
    f'<body>{_other(MENUS[0])}{_other(ADVERTS[0])}<article><h1 data-main="1">Brief</h1><p data-main="1">Soon</p><p data-main="1">Later on.</p></article>{_other(FOOTERS[1])}</body>',
    f'<body>{_other(MENUS[0])}{_other(ADVERTS[0])}<article><h1 data-main="1">Seen</h1><p data-main="1">{_MID}</p><p data-main="1">No.</p><p data-main="1">{_HUGE}</p></article>{_other(FOOTERS[1])}</body>',
    f'<body>{_other(MENUS[0])}<main><h2 data-main="1">List</h2><ul><li data-main="1">First point of the plan.</li><li data-main="1">Second point.</li></ul><p data-main="1">{_MID}</p></main>{_other(COMMENTS[0])}{_other(FOOTERS[0])}</body>',
)
PAGES = _pages() + SMALL
