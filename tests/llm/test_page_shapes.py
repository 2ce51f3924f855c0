"""Page shapes of many makers: exactly the article is left, whatever its frame is called."""

import pytest

from eventflow.llm import html_extract

TITLE = "How the harbour was rebuilt"
FIRST = "In the spring of that year the council decided, after long talks, to rebuild the old harbour from the ground up."
SECOND = "Nobody knew what it would cost, but the fishermen, who had waited for years, were glad that work began at last."
THIRD = "Three winters later the first boats came in again and the quay was full of people who had never seen the sea so calm."
BODY = f"<p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p>"
ARTICLE = f"<h1>{TITLE}</h1>{BODY}"
WHOLE = f"{TITLE} {FIRST} {SECOND} {THIRD}"
MENU = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(30))
CELLS = "".join(f'<td><a href="/{i}">Topic {i}</a></td>' for i in range(12))
THREAD = "".join(f'<li><p>Reader {i} says that this was well worth reading and asks for more of the kind.</p></li>' for i in range(60))

SHAPES = {
    "state of the sidebar on the body": f'<body class="single has-sidebar"><div>{ARTICLE}</div></body>',
    "no sidebar on the body": f'<body class="page no-sidebar">{ARTICLE}</body>',
    "fixed header as a state": f'<div class="header-fixed"><div>{ARTICLE}</div></div>',
    "topics of a post": f'<article class="post tag-legal category-terms">{ARTICLE}</article>',
    "a name with a soft word": f'<div id="news-alert-story">{ARTICLE}</div>',
    "one form around the page": f'<form id="aspnetForm"><div class="nav"><a href="/">Home</a></div><div>{ARTICLE}</div></form>',
    "plain form around the page": f"<body><form action='/x'>{ARTICLE}<input type=text></form></body>",
    "the entry's header": f'<div class="post"><div class="entry-header"><h1>{TITLE}</h1></div><div class="entry-content">{BODY}</div></div>',
    "a linked title": f'<div class="post"><h1><a href="/x">{TITLE}</a></h1>{BODY}</div>',
    "menu in plain elements": f"<div><ul>{MENU}</ul></div><div>{ARTICLE}</div>",
    "menu in a table": f"<table><tr>{CELLS}</tr></table><div>{ARTICLE}</div>",
    "menu after the article": f"<div>{ARTICLE}</div><div><ul>{MENU}</ul></div>",
    "links in a last line": f'<div>{ARTICLE}</div><div><a href="/i">Imprint</a> <a href="/c">Contact</a></div>',
    "links apart by bars": f'<p><a href="/">Home</a> | <a href="/n">News</a> | <a href="/a">About us</a></p><div>{ARTICLE}</div>',
    "menu inside the article": f"<article><h1>{TITLE}</h1><p>{FIRST}</p><ul>{MENU}</ul><p>{SECOND}</p><p>{THIRD}</p></article>",
    "link inside a sentence": f'<article><h1>{TITLE}</h1>{BODY.replace("the fishermen", chr(60) + "a href=/f>the fishermen</a>")}</article>',
    "a paragraph of one link": f'<article><h1>{TITLE}</h1><p><a href="/p">{FIRST}</a></p><p>{SECOND}</p><p>{THIRD}</p></article>',
    "list items without links": f"<article><h1>{TITLE}</h1><ul><li>{FIRST}</li><li>{SECOND}</li></ul><p>{THIRD}</p></article>",
    "sidebar": f'<div id="main">{ARTICLE}</div><div class="sidebar-left"><p>Read what others liked best this week.</p></div>',
    "aside": f"<main>{ARTICLE}<aside><p>Read what others liked best this week.</p></aside></main>",
    "site header and footer": f'<header class="site-header"><p>The daily paper of the coast</p></header><article>{ARTICLE}</article><footer><p>All rights reserved by us</p></footer>',
    "long thread of comments": f'<article>{ARTICLE}</article><div class="post-comments"><ol>{THREAD}</ol></div>',
    "comment form": f'<article>{ARTICLE}</article><form class="comment-form"><p>Tell us what you think of it</p><textarea>x</textarea></form>',
    "cookie notice": f'<div class="cookie-notice"><p>We use cookies to make this site work for you.</p></div><article>{ARTICLE}</article>',
    "advert between paragraphs": f'<article><h1>{TITLE}</h1><p>{FIRST}</p><div class="ad-banner"><p>Buy two boats and pay for one only.</p></div><p>{SECOND}</p><p>{THIRD}</p></article>',
    "newsletter": f'<article>{ARTICLE}<div class="newsletter-signup"><p>Get our letter every week by mail.</p></div></article>',
    "breadcrumbs": f'<div class="breadcrumbs"><a href="/">Home</a> › <a href="/n">News</a> › Harbour</div><article>{ARTICLE}</article>',
    "scripts and styles": f"<style>p{{}}</style><script>var a = '<p>no</p>';</script><article>{ARTICLE}</article><noscript>Turn it on</noscript>",
}


@pytest.fixture(scope="module")
def extractor():
    return html_extract.Extractor(html_extract.learn())


@pytest.mark.parametrize("shape", SHAPES)
def test_exactly_the_article(extractor, shape):
    assert extractor.extract(SHAPES[shape]) == WHOLE


def test_pages_without_an_article(extractor):
    for page in (f"<ul>{MENU}</ul>", f"<nav>{MENU}</nav>", f'<div class="comments">{THREAD}</div>', "<footer><p>All rights reserved</p></footer>"):
        assert extractor.extract(page) == ""


def test_long_pages_and_repeated_rows(spark):
    long = "<article>" + "".join(f"<p>Paragraph number {i} says a little more.</p><ul>{MENU}</ul>" for i in range(2000)) + "</article>"
    df = spark.createDataFrame([(1, long), (1, long), (2, None)], "page_id long, html string")
    rows = html_extract.extract_pages(df).orderBy("page_id").collect()
    want = " ".join(f"Paragraph number {i} says a little more." for i in range(2000))
    assert [r.text for r in rows] == [want, want, ""] and rows[0].n_chars == len(want)
