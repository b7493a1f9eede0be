import math
import random
import time

from tessera.llm import html_extract as H

LONG = "This is a sentence of the article, with several words and a comma. " * 4


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">Menu {i}</a></li>' for i in range(6)) + "</ul></nav>"
FOOT = "<footer>&copy; 2020 &middot; Some footer text that is not so short at all.</footer>"


def want(*blocks):
    return "\n".join(" ".join(b.split()) for b in blocks)


def test_article_with_broken_markup():
    html = page(NAV + '<!-- ad --><div class="ad">Buy this now please.</div><article><h1>Title &amp; more&amp</h1><p><b>First line.<br><p>' + LONG + "</p><p>Be. Erin.</p></article>" + FOOT)
    assert H.main_text(html) == want("Title & more&", "First line.", LONG, "Be. Erin.")


def test_short_article():
    html = page(NAV + '<div class="ad">An advert with many more words than the article itself has, really many.</div><article><h1>T</h1><p>Short.</p></article>' + FOOT)
    assert H.main_text(html) == want("T", "Short.")


def test_sections_sidebar_comments_form():
    html = page(
        '<header><a href="/">Site</a> <h2>Slogan of the site</h2></header>' + NAV + '<div id="cookie-notice">We use cookies on this site, please accept.</div><main><h1>Head</h1><section><h2>A</h2><p>' + LONG + "</p><p>" + LONG
        + "</p></section><section><h2>B</h2><p>Only&nbsp;short \n text</p><ul><li>one</li><li>two <a href='x'>linked</a> words</li></ul></section>"
        + '<form><label>Mail</label><input name="x"><button>Send</button></form><section class="comments"><h3>Comments</h3><p>' + LONG + "</p></section></main>"
        + '<aside class="sidebar"><p>' + LONG + "</p></aside>" + FOOT
    )
    assert H.main_text(html) == want("Head", "A", LONG, LONG, "B", "Only short text", "one", "two linked words")


def test_plain_divs():
    html = page('<div class="menu"><a href="a">a</a> <a href="b">b</a></div><div class="wrap"><h1>Head</h1><div><p>' + LONG + "</p><p>" + LONG + "</p><p>x</p></div></div><div id='footer'>Footer words here</div>")
    assert H.main_text(html) == want("Head", LONG, LONG, "x")


def test_more_layouts():
    inner = "<h1>Head</h1><p>" + LONG + "</p><p>Short one.</p><table><tr><td>a</td><td>b &lt; c</td></tr></table><blockquote>Quoted words</blockquote><pre>x =  1\n y</pre>"
    text = want("Head", LONG, "Short one.", "a b < c", "Quoted words", "x = 1 y")
    shells = [
        '<div id="topnav"><a href="a">Start</a></div><article class="post with-sidebar"><div class="content no-sidebar">{}</div><div class="share">Share this</div><div id="commentlist"><p>Nice text, thank you very much.</p></div></article><div class="sitefooter">Foot</div>',
        '<div class="page"><div class="header"><p>Name of the site and slogan</p></div><div class="main">{}</div><div class="sidebar"><h3>Popular</h3><p>Some other text here</p></div><div class="comments"><p>' + LONG + "</p></div></div>",
        '<main>{}<aside>Also <a href="x">this</a></aside><form><p>Subscribe to our list</p><input></form></main><div role="contentinfo">Imprint</div><div class="cookie-banner" hidden>We use cookies</div>',
        '<table><tr><td class="menu"><a href="a">A</a><a href="b">B</a></td><td><article>{}</article></td></tr></table><noscript>Turn scripts on</noscript>',
    ]
    for shell in shells:
        assert H.main_text(page(shell.replace("{}", inner))) == text, shell


def test_edges(spark):
    assert [H.main_text(x) for x in (None, "", "<html></html>", "plain &lt;text&gt;\n here")] == ["", "", "", "plain <text> here"]
    assert H.main_text("<div>" * 5000 + "deep" + "</div>" * 3000) == "deep"
    rows = [(1, "u", page("<p>" + LONG), "own"), (2, None, None, "own"), (None, "u", "", "own")]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.text) for r in out] == [(1, "u", want(LONG)), (2, None, ""), (None, "u", "")]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_several_articles():
    part = lambda n: "<article>" + "".join(f"<p>Part {n}, paragraph {i}. {LONG}</p>" for i in range(10)) + "</article>"
    html = page(NAV + "<div>" + part(1) + part(2) + "</div>" + FOOT)
    assert H.main_text(html) == want(*(f"Part {n}, paragraph {i}. {LONG}" for n in (1, 2) for i in range(10)))


def test_odd_declarations_and_many_end_tags_do_no_harm():
    assert H.main_text("<![foo[ x ]]> hello") == "hello"
    assert "<![ x" in H.main_text("<![ x") or H.main_text("<![ x") == ""
    assert H.main_text("<![if IE]><p>one</p><![endif]><p>two</p>") == "one\ntwo"
    began = time.time()
    assert H.main_text("<div>" * 20_000 + "deep" + "</b></i>" * 20_000) == "deep"
    assert time.time() - began < 5


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "<p>x y</p>", "kept", "c")], "page_id long, raw string, html string, c0 string")
    out = H.extract(df, html_col="raw")
    assert out.columns == ["page_id", "html", "c0", "text"] and [tuple(r) for r in out.collect()] == [(1, "kept", "c", "x y")]


def test_densities_against_a_recursive_version():
    r = random.Random(3)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return " ".join("w" * r.randint(1, 8) for _ in range(r.randint(0, 12)))
        tag = r.choice(["div", "p", "a", "span", "section"])
        return f"<{tag}>" + " ".join(tree(depth - 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    for _ in range(60):
        p = H.Page(page(tree(5)))
        t = p.tree

        def count(i, link=False):
            """(characters, tags, link characters, link tags) of a subtree, by its events."""
            if p.gone[i]:
                return (0, 0, 0, 0)
            link = link or t.tag[i] == "a"
            own = sum(len("".join(x.split())) for k, j, x in t.events if k == 2 and j == i)
            kids = [count(c, link) for c in p.children[i]]
            return (own + sum(x[0] for x in kids), 1 + sum(x[1] for x in kids), own * link + sum(x[2] for x in kids), (t.tag[i] == "a") + sum(x[3] for x in kids))

        body = t.tag.index("body")
        total = count(body)
        for i, d in enumerate(p.densities()):
            if i < body or p.gone[i]:
                continue
            up, inside = t.parent[i], False
            while up >= 0:
                inside |= t.tag[up] == "a"
                up = t.parent[up]
            c, n, lc, ln = count(i, inside)
            if not c:
                assert d == 0
                continue
            base = math.log(c / max(c - lc, 1) * lc + total[2] / total[0] * c + math.e)
            assert math.isclose(d, c / n * math.log(max(c / max(lc, 1) * n / max(ln, 1), 1.0)) / (math.log(base) if base > 1 + 1e-9 else 1), rel_tol=1e-9, abs_tol=1e-12)


def test_an_article_keeps_its_sections():
    """No part of an article goes for a word in its name or for its links; only names that stand alone, of parts with little text."""
    body = "".join(f"<p>Paragraph {i}. {LONG}</p>" for i in range(6))
    text = [f"Paragraph {i}. {LONG}" for i in range(6)]
    kept = {
        f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p><p>{LONG}</p></section>': ["Discussion", LONG, LONG],
        f'<section id="related-work"><p>{LONG}</p></section>': [LONG],
        f'<section id="search-algorithms"><p>{LONG}</p></section>': [LONG],
        f'<div class="notice-board"><p>{LONG}</p></div>': [LONG],
        '<p><a href="a">One link</a>, <a href="b">another link</a> and <a href="c">a third one</a>.</p>': ["One link, another link and a third one."],
        '<ol><li><a href="a">First reference</a></li><li><a href="b">Second reference</a></li><li><a href="c">Third reference</a></li></ol>': ["First reference", "Second reference", "Third reference"],
        "<p>Formula <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a=2</annotation></math> and <object>a fallback</object> end.</p>": ["Formula a=2 and a fallback end."],
        f'<div class="commentary"><p>{LONG}</p></div>': [LONG],
    }
    for part, more in kept.items():
        assert H.main_text(page(NAV + f"<article><h1>Head</h1>{body}{part}</article>" + FOOT)) == want("Head", *text, *more), part
    gone = ['<div class="share">Share this</div>', '<div class="ad-container">Buy it</div>', '<ul class="related-posts"><li><a href="x">More</a></li></ul>', f'<div id="comments"><p>{LONG * 9}</p></div>', f'<section class="user-comments">{LONG}</section>', "<aside>Aside</aside>", '<div role="search">Find</div>', '<div class="newsletter-signup">Mail</div>']
    for part in gone:
        assert H.main_text(page(NAV + f"<article><h1>Head</h1>{body}{part}</article>" + FOOT)) == want("Head", *text), part


def test_hostile_pages_take_linear_time():
    n = 100_000
    pages = ["<a " * n, "<!--" * n, '<a href="' * n, "<p><button>" + "<span>" * n + "<div></div>" * n, "<" * n, "</" * n, "<script>" * n, "&" * n, "<a b='" * n, "<table><tr><td>" * 20_000 + "x", "<li>" * n, "<![" * n, "<p>" * n + "</div>" * n]
    for html in pages:
        began = time.time()
        H.main_text(html)
        assert time.time() - began < 15, html[:30]


def test_scanner():
    cases = {
        "a < b <3 and <> x": "a < b <3 and <> x", "<p a=1 b='x>y' c=\"<q>\" d>in</p>": "in", "<P CLASS=x>Up</p >case": "Up\ncase", "<!-->a<!-- x --!> b -->c": "ac", "x<!-- open": "x", "<br/>a<br>b": "a b", "<p>one<div>two</div>": "one\ntwo", "<script>if (a</b) '</scripts>'</SCRIPT >t": "t", "<textarea><b>no</textarea>yes": "yes",
        "<p title='&gt;'>&lt;p&gt; &#x41;&notit; &amp</p>": "<p> A¬it; &", "<?php x ?>y": "y", "<!DOCTYPE html>z": "z", "<a href=x/>l</a>": "l", "end <a": "end", "<p a=\"never closed>text": "", "<style>p{}</style": "", "<ul><li>a<ul><li>b</ul><li>c</ul>": "a\nb\nc",
    }
    for html, text in cases.items():
        assert H.main_text(html) == text, html


def test_one_long_page_takes_little_memory():
    import subprocess
    import sys

    code = """
import resource, sys
sys.path.insert(0, %r)
from tessera.llm import html_extract as H
html = "<html><body><article>" + "".join("<p>" + "some words in a paragraph. " * 40 + "</p>" for _ in range(28_000)) + "</article></body></html>"
low = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = H.main_text(html)
print(len(html), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - low) * 1024 / len(html))
assert len(text) > 28_000_000
"""
    import __spark_entry__ as entry

    out = subprocess.run([sys.executable, "-c", code % entry.__file__.rsplit("/", 1)[0]], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 30_000_000 and float(out[1]) < 10
