"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page is read as a sequence of tags and runs of words. Every tag scores negative, every word
positive, unless it stands inside elements that the labelled pages show around menus, adverts,
comments and the like; one linear scan then finds the contiguous region with the highest sum. Inside
that region runs in such elements are left out. However long they are, all such elements between two
words of main text cost ``SKIP`` once, tags and runs together, so only tags outside them end a region.
Weights come from labelled pages: a logistic regression of "is main text" on the names, classes, ids
and roles of the open elements weighs words, and log odds of a tag standing inside or outside main
text weigh tags.

Three things are told by more than an element's own name. Neighbouring blocks of which nearly every word
is linked are link lines, a key of its own that the labelled pages weigh (a lone link, a heading that is a
link and links inside sentences are none). Compound class words that name a state or a topic of the page
(has-sidebar, tag-legal, header-fixed), or soften a word of main text (entry-header), say nothing, nor do
classes of html and body. A form that holds more than half of the page's unlinked words is its frame.

Scripts, styles, the head and comments in the markup never count as words. White space is one space,
character references are decoded, an element that HTML treats as a block parts words.

Defined results: null html is empty; a page without words, or whose every region scores at most 0,
has empty text; of equally good regions the first and shortest counts; unclosed elements, comments
and scripts reach to the page's end or to their parent's end tag; repeated rows each get their text;
pages of any length are read whole; an empty table gives an empty table; columns named like an output are replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Compound class words that name a state or a topic of the page, not a part of it: by their first word
#: (has-sidebar, tag-legal) or their last (header-fixed).
STATE_FIRST = frozenset("has no not is with without tag category cat format status type layout template theme lang author".split())
STATE_LAST = frozenset("fixed sticky enabled disabled open closed active visible".split())
#: In a compound with a word for main text (entry-header, news-alert-story) these do not speak against it.
MAIN_PART = frozenset("article entry post story content main body text".split())
SOFT_PART = frozenset("header heading head title banner alert notice notification legal terms".split())
#: Elements that may frame a whole page; one that holds more than half of its unlinked words is no part of it.
FRAMES = ("form", ".form")
#: The key of blocks, and of tags between them, that are links one after another: least number of links, and
#: share of their words that are linked.
LINKS, LEAST_LINKS, LINKED = "link line", 2, 2 / 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg math title select object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend "
    "li main menu nav ol option optgroup p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body br button caption dd dt frameset head html legend li option optgroup select summary tbody td textarea tfoot th thead tr".split())
#: Cost of all that is left out between two words of a region.
SKIP = 0.5


#: However many containers speak for main text, they add no more than this, so that one element
#: that speaks against it decides; weaker evidence against it than BAD is left aside.
GOOD, BAD = 0.8, -1.0


@dataclass
class Run:
    """Words between two tags, or a tag (``words`` 0); ``keys`` are those of the open elements, a tag's
    own element included."""

    tag: str = ""
    words: int = 0
    text: str = ""
    keys: tuple[str, ...] = ()
    block: bool = False


@dataclass
class Weights:
    word: float = 1.0
    keys: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)


def element_keys(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role. What stands on the page's own frame
    (html, body) describes the page and is left aside, as are compounds that name no part of a page."""
    keys = [name]
    if name not in ("html", "body") and (attributes and "=" in attributes or "hidden" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            for word in (m[2] or m[3] or m[4] or m[5] or "").split():
                parts = [p.lower() for p in PART.findall(word)]
                if len(parts) > 1:
                    if parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
                        continue
                    if not MAIN_PART.isdisjoint(parts):
                        parts = [p for p in parts if p not in SOFT_PART]
                keys += [f".{p}" for p in parts]
    return tuple(dict.fromkeys(keys))


def page_runs(page: str) -> list[Run]:
    """The page's runs with what only the whole page tells: link lines, and forms around everything."""
    runs = list(read_page(page))
    _mark_link_lines(runs)
    for frame in FRAMES:
        words = [(r.words, frame in r.keys) for r in runs if r.words and LINKS not in r.keys]
        if 2 * sum(n for n, inside in words if inside) > sum(n for n, _ in words):
            for r in runs:
                if frame in r.keys:
                    r.keys = tuple(k for k in r.keys if k != frame)
    return runs


def _mark_link_lines(runs: list[Run]) -> None:
    """Neighbouring blocks (headings apart) of which nearly every word is linked, with several links."""
    blocks: list[tuple[int, int, int, bool]] = []  # first and last run with words, links, linked
    first, last, words, linked, links, heading = -1, -1, 0, 0, 0, False
    for i, r in enumerate([*runs, Run(tag="end", block=True)]):
        if r.words:
            first, last = (i if first < 0 else first), i
            words += r.words
            heading |= not HEADINGS.isdisjoint(r.keys)
            if "a" in r.keys:
                linked, links = linked + r.words, links + 1
        elif r.block and words:
            blocks.append((first, last, links, linked >= LINKED * words and not heading))
            first, last, words, linked, links, heading = -1, -1, 0, 0, 0, False
    at = 0
    while at < len(blocks):
        to = at
        while to < len(blocks) and blocks[to][3]:
            to += 1
        if sum(b[2] for b in blocks[at:to]) >= LEAST_LINKS:
            for r in runs[blocks[at][0] : blocks[to - 1][1] + 1]:
                r.keys = (*r.keys, LINKS)
        at = max(to, at + 1)


def read_page(page: str) -> Iterator[Run]:
    """Tags and runs of words in page order, with the keys of all open elements."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            raw = page[at:stop]
            text = html_lib.unescape(raw) if "&" in raw else raw
            words = len(text.split())
            if text:
                yield Run(words=words, text=text, keys=stack[-1][1] if stack else ())
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = end if close < 0 else close + 3
        elif not name:
            continue
        elif m[1] or m[4]:
            keys = stack[-1][1] if stack else ()
            if opened[name]:
                while stack:
                    top, keys = stack.pop()
                    opened[top] -= 1
                    if top == name:
                        break
            yield Run(tag=name, keys=keys, block=name in BLOCK)
        else:
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
                yield Run(tag=name, keys=stack[-1][1] if stack else (), block=name in BLOCK)
                continue
            if name in ENDS_P and opened["p"]:
                _close(stack, opened, "p")
            elif name == "li" and stack and stack[-1][0] == "li":
                _close(stack, opened, "li")
            above = keys = stack[-1][1] if stack else ()
            if name not in VOID:
                # A header inside the article is the article's own.
                key = "article header" if name == "header" and ("article" in above or "main" in above) else name
                new = tuple(k for k in element_keys(key, m[3] or m[6] or "") if k not in above)
                keys = above + new if new else above
                stack.append((name, keys))
                opened[name] += 1
            yield Run(tag=name, keys=keys, block=name in BLOCK)


def _close(stack: list, opened: Counter, name: str) -> None:
    """Ends an open element, unless an element that holds paragraphs of its own was opened since."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            for top, _ in stack[i:]:
                opened[top] -= 1
            del stack[i:]
            return
        if stack[i][0] in BLOCK:
            return


class Extractor:
    def __init__(self, weights: Weights):
        self.weights = weights
        self.known: dict[tuple[str, ...], float] = {}

    def word_score(self, keys: tuple[str, ...]) -> float:
        score = self.known.get(keys)
        if score is None:
            if len(self.known) > 50_000:
                self.known.clear()
            w = [self.weights.keys.get(k, 0.0) for k in keys]
            good = min(sum(x for x in w if x > 0), GOOD)
            score = self.known[keys] = self.weights.word + good + sum(x for x in w if x < BAD)
        return score

    def extract(self, page: str) -> str:
        runs = page_runs(page)
        best, best_from, best_to = 0.0, 0, 0
        total, begin = 0.0, 0
        tags = self.weights.tags
        kept = [False] * len(runs)
        skipped = False
        for i, r in enumerate(runs):
            if r.tag or r.words:
                score = self.word_score(r.keys)
                if score <= 0:
                    total -= 0 if skipped else SKIP
                    skipped = True
                elif r.tag:
                    total += tags.get(r.tag, -0.2)
                else:
                    kept[i], skipped = True, False
                    total += min(score, 1.0) * r.words
            if total <= 0:
                total, begin = 0.0, i + 1
            elif total > best:
                best, best_from, best_to = total, begin, i + 1
        parts = []
        for i in range(best_from, best_to):
            r = runs[i]
            if r.tag:
                if r.block:
                    parts.append(" ")
            elif kept[i] or not r.words:
                parts.append(r.text)
        return " ".join("".join(parts).split())


#: Labelled fragments of pages; {} is where words stand. First main text, then everything else.
CONTENT = """
<article><h1>{}</h1><p>{}</p><p>{}</p></article>
<article><header><h1>{}</h1><p>{}</p></header><p>{}</p><h2>{}</h2><p>{} <a>{}</a> {}</p></article>
<main><h1>{}</h1><p>{}</p><blockquote>{}</blockquote><p>{}</p></main>
<main><article><p>{}</p><ul><li>{}</li><li>{}</li></ul><p>{}</p></article></main>
<section><h2>{}</h2><p>{}</p><figure><figcaption>{}</figcaption></figure><pre>{}</pre></section>
<div><h1>{}</h1><p>{}</p><div><p>{}</p></div></div>
<div><p>{}</p><table><tr><td>{}</td><td>{}</td></tr></table></div>
<div><p><b>{}</b><br>{}</p><ol><li>{}</li></ol></div>
<article><p><b>{}</b><br>{}</p><section><h3>{}</h3><p>{}</p></section></article>
<p>{}</p>
<h1>{}</h1>
"""
CONTENT_WORDS = "content post entry main article body text story container wrapper page row col inner"
OTHER = """
<nav><ul><li><a>{}</a></li><li><a>{}</a></li></ul></nav>
<nav><p>{}</p></nav>
<header><h1>{}</h1><p>{}</p></header>
<header><div>{}</div><nav><a>{}</a></nav></header>
<aside><h3>{}</h3><p>{}</p><ul><li><a>{}</a></li></ul></aside>
<dialog><p>{}</p></dialog>
<form><p>{}</p><label>{}</label><button>{}</button></form>
<button>{}</button>
<fieldset><label>{}</label></fieldset>
<footer><p>{}</p></footer>
<footer>{}</footer>
<menu><li>{}</li></menu>
<ul><li><a>{}</a></li><li><a>{}</a></li><li><a>{}</a></li></ul>
<div><a>{}</a> <a>{}</a></div>
<div><ul><li><a>{}</a></li><li><a>{}</a></li></ul></div>
<p><a>{}</a> <a>{}</a> <a>{}</a></p>
<table><tr><td><a>{}</a></td><td><a>{}</a></td></tr></table>
"""
OTHER_WORDS = (
    "nav menu navbar navigation topbar masthead header banner logo breadcrumb breadcrumbs sidebar complementary related recommended widget popular trending toc pagination pager "
    "ad ads advert advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert warning disclaimer popup modal overlay dialog "
    "form search login signup newsletter subscribe subscription paywall share sharing social follow comment comments commentlist disqus reply replies respond responses discussion feedback "
    "footer contentinfo copyright legal terms hidden"
)
AROUND = ("{}", "<html><body>{}</body></html>", "<div>{}</div>", "<main>{}</main>", '<article class="post">{}</article>', '<div class="content">{}</div>')


def labelled_pages() -> list[tuple[str, bool]]:
    """(fragment in its surroundings, is main text): every fragment in the same surroundings, and
    every class word on blocks of its own."""
    boxes = ('<div class="{}"><p>{{}}</p></div>', '<p class="{}">{{}}</p>', '<section id="{}"><h2>{{}}</h2><p>{{}}</p></section>', '<ul class="{}"><li>{{}}</li></ul>')
    rows = []
    for label, fragments, words in ((True, CONTENT, CONTENT_WORDS), (False, OTHER, OTHER_WORDS)):
        inner = [*fragments.strip().splitlines(), *(box.format(w) for w in words.split() for box in boxes)]
        headed = [x for x in inner if x.startswith("<header>")]
        rows += [(around.format(x), label) for x in inner for around in (AROUND[:3] if x in headed else AROUND)]
    return rows


def learn(pages: list[tuple[str, bool]] | None = None, steps: int = 3000, rate: float = 0.5, decay: float = 1e-4) -> Weights:
    """Weights from labelled fragments: full-batch gradient descent on a few hundred runs."""
    rows, tags = [], {True: Counter(), False: Counter()}
    for page, label in pages if pages is not None else labelled_pages():
        runs = list(read_page(page.replace("{}", "word")))
        _mark_link_lines(runs)
        for run in runs:
            if run.tag:
                tags[label][run.tag] += 1
            elif run.words:
                rows.append((run.keys, label))
    names = sorted({k for keys, _ in rows for k in keys})
    at = {k: i for i, k in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (keys, _) in enumerate(rows):
        x[i, [at[k] for k in keys]] = 1
    y = np.array([label for _, label in rows], float)
    side = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(len(names)), 0.0
    for _ in range(steps):
        g = side * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= rate * 10 * (x.T @ g + decay * w)
        b -= rate * g.sum()
    inside, outside = sum(tags[True].values()), sum(tags[False].values())
    odds = {t: np.log((tags[True][t] + 1) / (inside + 50)) - np.log((tags[False][t] + 1) / (outside + 50)) for t in tags[True] | tags[False]}
    return Weights(max(b, 0.5), dict(zip(names, w.tolist(), strict=True)), {t: float(np.clip(0.3 * o - 0.15, -0.6, -0.05)) for t, o in odds.items()})


def extract_pages(df: DataFrame, weights: Weights | None = None, html: str = "html") -> DataFrame:
    """Adds text and n_chars (code points of the text) for every row."""
    weights = df.sparkSession.sparkContext.broadcast(weights or learn())

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extractor = Extractor(weights.value)
        for pages in parts:
            yield pages.fillna("").map(extractor.extract)

    return df.drop("text", "n_chars").withColumn("text", text_of(html)).withColumn("n_chars", F.length("text").cast("long"))
