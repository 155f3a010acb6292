from __future__ import annotations

import math

from fathom.llm import html
from fathom.llm.html import blocks, extract, extract_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="no-comments has-sidebar">
<nav><a href=/x>Menu, one.</a></nav><header><p>Site name, here.</p></header><div class="cookie-notice">We use cookies, yes.</div>
<article><h1>A  title</h1><!-- <p>no</p> --><p><b>First &amp; bold,<br>text &lt;here&gt;.<p>Second&nbsp;one.</p><div class="ad">Buy, now.</div>
<form><input value="x"><p>Name, please.</p></form><ul><li>One<li>Two</ul>Loose words<section id="comments"><p>Great, post.</p></section></article>
<aside><p>Side, text.</p></aside><footer>&copy; x</footer>"""


def test_article():
    assert extract(PAGE) == "A title\nFirst & bold, text <here>.\nSecond one.\nOne\nTwo\nLoose words"


def test_without_article():
    body = "<div class=content><h2>Head</h2><p>Long text, with marks; and more of them, so that it counts. It does.</p><p>Short.</p><p>More text, and more, to read. Yes.</p></div>"
    page = f"<body><div class=menu>a, b</div><div><a href=1>one</a> <a href=2>two</a></div>{body}<div class=sidebar><p>Not, this. Text, text, text.</p></div></body>"
    assert extract(page) == "Head\nLong text, with marks; and more of them, so that it counts. It does.\nShort.\nMore text, and more, to read. Yes."


def test_the_end_without_article():
    long = "<p>" + "Long text, with marks; and more of them, so that it counts. It does. " * 6 + "</p>"
    ends = {
        "<ul>" + "<li>A closing item of the list, sixty characters or so, it says.</li>" * 4 + "</ul>": "A closing item of the list, sixty characters or so, it says.",
        "<table><tr><th>Year<th>Sum<tr><td>1999<td>12</table>": "12",
        "<h2>Outlook</h2><p class=short>Short.</p>": "Outlook\nShort.",
        "<div>Text right in a div</div>": "Text right in a div",
        "<h2><a href=#x>Linked head</a></h2><p class=short>Short.</p>": "Linked head\nShort.",
    }
    for end, last in ends.items():
        page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><div class=content><div>By an author</div><h1>A heading of forty characters, or so, it is</h1>{long * 5}{end}</div><div><a href=3>three</a></div></body>"
        lines = extract(page).split("\n")
        assert lines[:2] == ["By an author", "A heading of forty characters, or so, it is"] and "\n".join(lines).endswith(last), end
        assert len(lines) == len(blocks(page)) - (1 if "three" in page else 0) - 1, end
        assert not {"one two", "three"} & set(lines)
    assert extract(f"<body><div><section class=a>{long}</section><section class=b><h2>B</h2>c</section></div><div><a href=1>x</a></div>").endswith("\nB\nc")
    assert extract(f"<table><tr><td><a href=1>x</a><td><b>{long}</b><ul><li>a<li>b</ul></table>").endswith("\na\nb")


def test_names_that_declare_nothing_else():
    long = "Long text, with marks; and more of them, so that it counts. It does. " * 6
    head = f"<h1>Title</h1><p>{long}</p>"
    kept = [
        "<h2 id=share-prices>Head</h2>", "<h2 id=comments>Head</h2>", "<section id=related-work><p>More, text.</p></section>", "<p class=notice-period>Period, text.</p>",
        "<div class='content has-sidebar'><p>In, here.</p></div>", "<div class=no-comments>In, here.</div>",
    ]
    gone = ["ad", "cookie-notice", "site-header x", "comment-list", "ad-300x250", "NavBar-2 nav", "related-posts", "footer__links"]
    for outer in ("article", "div"):
        for part in kept:
            assert extract(f"<{outer}>{head}{part}<p>{long}</p></{outer}>").count("\n") == 3, part
        for name in gone:
            assert extract(f"<{outer}>{head}<div class='{name}'><p>Gone, text.</p></div><p>{long}</p></{outer}>").count("\n") == 2, name


def test_names_around_the_text():
    long = "Long text, with marks; and more of them, so that it counts. It does."
    inner = f"<div class=menu>Menu, text</div><h1>Title</h1><p>{long}</p><p>{long}</p>"
    for start, end in (("<div class=sidebar>", "</div>"), ("<form action=/page.aspx>", "</form>"), ("<form><div id=comments>", "</div></form>"), ("<main><div class=widget>", "</div></main>")):
        assert extract(f"<body>{start}{inner}{end}<footer>x</footer>") == f"Title\n{long}\n{long}", start
    assert extract(f"<form><article>{inner}</article></form>") == f"Title\n{long}\n{long}"
    # What is named an advert stays one beside an article, however short that is.
    assert extract(f"<div class=ad>{long}</div><article><p>Short.</article>") == "Short."
    assert extract(f"<article><p>{long} {long}<div class=ad>{long}</div></article>") == f"{long} {long}"


def test_which_article():
    long = "Long text, with marks; and more of them, so that it counts. It does. " * 3
    text, teaser = f"<h1>Title</h1><p>{long}</p><p>{long}</p><p class=x>Last.</p>", f"<article><p>{long}</p></article>"
    whole = ["Title", long.strip(), long.strip(), "Last."]
    # A teaser that is an article does not replace the text; what is inside the same container stays.
    assert extract(f"<body><div>{text}</div>{teaser}").split("\n") == [*whole, long.strip()]
    assert extract(f"<body>{teaser}<div>{text}</div>{teaser}").split("\n") == [long.strip(), *whole, long.strip()]
    # The article is the text where it holds most; other articles with text stay, what is outside does not.
    assert extract(f"<body><article>{text}{text}</article><article><p>{long}</p></article><p>{long}</p>").split("\n") == [*whole, *whole, long.strip()]


def test_links_in_main():
    long = "Long text, with marks; and more of them, so that it counts. It does. " * 3
    links = "<ul><li><a href=1>One page</a></li><li><a href=2>Another page</a></li><li><a href=3>A third</a></li></ul>"
    page = f"<main>{links}<h1><a href=#t>Title</a></h1><p>{long}</p><div><a href=/s>The source</a></div><p>{long}</p><ul><li>a<li>b</ul><h2>More</h2>{links}</main>"
    assert extract(page).split("\n") == ["Title", long.strip(), "The source", long.strip(), "a", "b", "More"]


def test_names_weigh_and_do_not_decide():
    long = "Long text, with marks; and more of them, so that it counts. It does. " * 3
    text, p = long.strip(), f"<p>{long}</p>"
    assert extract('<div class="article social-policy"><h1>T</h1><p>Article body, about things.</p></div>') == "T\nArticle body, about things."
    site = "<header><h1>Site, name.</h1></header>"
    assert extract(f"<body>{site}<div class=post><div class=post-header><h1>Head</h1></div>{p}{p}</div><footer>x</footer>").split("\n") == ["Head", text, text]
    page = f"<body>{site}<article><header><h1>Head</h1><p>By me.</p></header>{p}<p class=related>{long}</p>{p}</article><footer>x, y, z.</footer>"
    assert extract(page).split("\n") == ["Head", "By me.", text, text, text]
    page = f"<body><div id=nav><a href=1>x</a></div><h1>Head</h1><div class=content>{p}<p class=related>More text, as well.</p><ul><li>a<li>b</ul></div><div id=comments><h3>Said</h3><div class=comment>{p}{p}</div></div>"
    assert extract(page).split("\n") == ["Head", text, "More text, as well.", "a", "b"]
    assert extract(f"<body><div><h1>H</h1>{p}<div class=newsletter><form><p>Subscribe, now. {long}</p></form></div>{p}</div>").split("\n") == ["H", text, text]


def test_pages_whose_markup_says_nothing():
    long = "Long text, with marks; and more of them, so that it counts. It does. " * 3
    menu = "<div class=x1><a href=1>One page</a><a href=2>Another page</a></div>"
    body = f"<h2>Head</h2><p>{long}</p><table><tr><td>1<td>2</table><p>Short</p><p>{long}</p>"
    page = f"<body><div class=c7>{menu}<div>Your town, today</div><div class=q>{body}</div><div class=r><ul><li><a href=1>More, on this</a><li><a href=2>Other</a></ul></div><div>All rights kept</div></div>"
    whole = "\n".join(["Head", long.strip(), "1", "2", "Short", long.strip()])
    assert extract(page) == whole


def test_ratios_decide(monkeypatch):
    long = "Long text, with marks; and more of them, so that it counts. It does. " * 3
    page = f"<body><nav><a href=1>Menu</a></nav><div class=ad>Buy, now.</div><article><h1>T</h1><p>{long}</p></article><footer>x</footer>"
    assert extract(page) == "T\n" + long.strip()
    monkeypatch.setattr(html, "content_paths", lambda found, said: {b.element.path for b in found})
    assert extract(page).split("\n") == ["Menu", "Buy, now.", "T", long.strip(), "x"]


def test_ratios_against_loops():
    """Paths are written out and sums taken block by block."""
    page = PAGE.replace("<article>", "<main><section class='a b'>").replace("</article>", "</section></main>")
    found = blocks(page)
    said = html.weights(found)

    def name(e):
        return (name(e.parent) + "/" + e.tag if e.parent else "") if e.tag not in html._INLINE else name(e.parent)

    order = []
    for b in found:
        if b.element.path not in order:
            order.append(b.element.path)
    text, marks, factor = [], [], []
    for path in order:
        own = [(b, w) for b, w in zip(found, said, strict=True) if b.element.path == path]
        assert len({name(b.element) for b, _ in own}) == 1
        text.append(sum(len(b.text) - b.linked for b, _ in own) / len(own))
        marks.append((sum(c in ".,;:!?…。、！？؛،" for b, _ in own for c in b.text) + 1) / len(own))
        factor.append(max(w for _, w in own))
    near = lambda v, i: [(v[k], math.exp(-((k - i) ** 2) / 2)) for k in range(max(0, i - 1), min(len(v), i + 2))]
    smooth = lambda v, i: sum(x * w for x, w in near(v, i)) / sum(w for _, w in near(v, i))
    fused = []
    for i in range(len(order)):
        t = smooth(text, i)
        fused.append(t * smooth(marks, i) * min(1, text[i] / t) * factor[i] if t else 0.0)
    got = html.ratios(found, said)
    assert all(math.isclose(got[path], f, rel_tol=1e-12) for path, f in zip(order, fused, strict=True))
    mean = sum(fused) / len(fused)
    threshold = max(1.0, min(max(fused), 0.8 * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))))
    assert html.content_paths(found, said) == {path for path, f in zip(order, fused, strict=True) if f >= threshold}


def test_long_texts():
    assert extract("a, b. " * 400_000) == ("a, b. " * 400_000).strip()
    assert len(extract("<article><p>" + "word, " * 300_000 + "<p>end.</article><nav><a href=1>x</a></nav>")) == 1_800_004


def test_broken_markup():
    assert extract(None) == extract("") == extract("<nav>x</nav>") == extract("<!-- open") == ""
    assert extract("plain 1 < 2 & 3") == "plain 1 < 2 & 3"
    assert extract("<article><p>a<b>b<p>c</b> d<script>if (x<y) {") == "ab\nc d"
    assert extract("<p title='a>b'>x</p>") == "x"
    assert extract("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x")]
    found = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text == extract(PAGE), r.n_chars) for r in found) == [("1", True, len(extract(PAGE)))] * 2 + [("None", False, 0)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
