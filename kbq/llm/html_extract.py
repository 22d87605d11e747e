"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden label, content or boilerplate. A node's potential comes from what is seen
of it (tag, what its class, id and role say, length, link share and sentence marks of its own text; a header within an article
or main element is a tag of its own, as it has the title); the potential of
a parent and child pair says how labels follow each other, by the child's kind of tag. All are counts from labelled
pages, smoothed. Sum-product messages go up the tree and down again, for the nodes of many pages at a time, level by
level; text is kept where the marginal of content is at least one half.

Labelled pages are pages whose main part is marked: `labelled_pages()` makes a varied set by rule, and pages of the
corpus that name their own main part (one article or main element) are added, about `sample` of them, chosen by a hash
of page_id and url. Counts are summed by Spark.

Inline elements belong to the block around them; a line break is white space. Scripts, styles, heads, templates and
form controls have no text. Unclosed and misnested elements are closed where a new block or an outer end tag closes
them; an unfinished tag at the end of a page is markup, a tag with a quote that is never closed ends at the next >,
and a skipped element that is never closed is a tag alone (scripts and the like run to the end). Null and empty pages give an empty text. Every row gives a
row, also repeated ones and those with null page_id or url. No rows: no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbq.llm.common import bounded_batches, column, hash_sample, slices, tidy

#: A comment, a tag or a declaration. A tag with a quote that is never closed ends at the next >.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?:>|\Z)|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)", re.S)
#: Elements whose content is no text of the page; those of the first set run to the end of a page that does not close them, an unclosed one of the others is a tag like any other.
_RAW = set("script style textarea iframe noscript".split())
_SKIPPED = _RAW | set("head template svg select button object".split())
_HEAD_ENDS = re.compile(r"</head\b[^>]*>|(?=<(?:body|p|div|article|main|section|h[1-6]|nav|header|footer|aside|ul|ol|table|form)\b)", re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|data-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes besides itself, as long as no listed border stands between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NO_P_INSIDE = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_BAD = re.compile(r"(?<![a-z])(?:nav|navbar|navigation|menu|menus|header|masthead|topbar|footer|foot|bottom|sidebar|side|aside|widget|rail|ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|share|sharing|social|related|recommended|more|comment|comments|reply|replies|respond|disqus|discussion|form|login|signup|search|subscribe|newsletter|breadcrumb|breadcrumbs|pagination|pager|tags|legal|copyright|skip|toolbar|complementary|contentinfo)(?![a-z])")
_GOOD = re.compile(r"(?<![a-z])(?:article|main|content|post|entry|story|body|text|page-content|maincontent)(?![a-z])")
_TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "body", "dl"]
_TAG_NO = {t: i for i, t in enumerate(_TAGS)}
#: Kinds of child tags that have transition potentials of their own.
_KINDS = {"article": 1, "main": 1, "section": 2, "div": 2, "nav": 3, "header": 3, "footer": 3, "aside": 3, "form": 3}
_N_KINDS = 4
#: The tag's number of a header within an article or main element, which is no page header: it has the title.
_INNER_HEADER = len(_TAGS) + 1
#: Numbers of values of a node's features: tag, names, text length, link share, sentence mark.
_SIZES = (len(_TAGS) + 2, 4, 4, 4, 2)


class Page:
    """Block elements of one page: parents before children, with their own text in pieces and the order of all pieces."""

    __slots__ = ("parent", "tag", "names", "label", "blocks", "own", "linked", "marks")

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.label = [-1], ["body"], [0], [None]
        self.blocks: list[tuple[int, str]] = []
        self.own, self.linked, self.marks = [0], [0], [False]


def parse(source: str | None) -> Page:
    page = Page()
    stack = [0]
    pieces: list[str] = []
    linked = links = 0
    source = source or ""

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                node = stack[-1]
                page.blocks.append((node, text))
                page.own[node] += len(text)
                page.linked[node] += linked
                page.marks[node] |= text[-1] in ".!?:…\"”»" or ". " in text
        linked = 0

    def drop(depth: int) -> None:
        for n in stack[depth:]:
            opened[page.tag[n]] -= 1
        del stack[depth:]

    def close_to(depth: int) -> None:
        nonlocal links
        flush()
        drop(depth)
        links = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text.strip())

    at = 0
    opened: Counter[str] = Counter()  # open elements by name, the root aside
    never: set[str] = set()  # elements that are not closed any more
    while m := _MARKUP.search(source, at):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1], m[3].removesuffix(">")
        if name in _SKIPPED:
            if not closing and not (name == "svg" and attributes.endswith("/")) and name not in never:
                ends = _HEAD_ENDS if name == "head" else re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I)
                if end := ends.search(source, at):
                    at = end.end()
                elif name in _RAW:
                    at = len(source)
                else:
                    never.add(name)
            continue
        if name in ("html", "body"):  # the root stands for both, marked or not
            if 'data-label="content"' in attributes:
                page.label[0] = "content"
            continue
        if name in _INLINE:
            if name == "br":
                pieces.append(" ")
            elif name == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        if closing:
            if not opened[name]:  # a stray end tag: the open elements are not searched
                flush()
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == name:
                    close_to(depth)
                    break
            continue
        flush()
        links = 0
        if name in _NO_P_INSIDE and page.tag[stack[-1]] == "p":
            drop(len(stack) - 1)
        if name in _CLOSES:
            closed, borders = _CLOSES[name]
            for depth in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closed) else ():
                if page.tag[stack[depth]] in borders:
                    break
                if page.tag[stack[depth]] in closed:
                    drop(depth)
                    break
        if name in _VOID:
            continue
        names, label = 0, None
        for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            value = value.strip("\"'").lower()
            if key.lower() == "data-label":
                label = value
            else:
                names |= (1 if _BAD.search(value) else 0) | (2 if _GOOD.search(value) else 0)
        page.parent.append(stack[-1])
        page.tag.append(name)
        page.names.append(names)
        page.label.append(label)
        page.own.append(0)
        page.linked.append(0)
        page.marks.append(False)
        if not attributes.endswith("/"):
            stack.append(len(page.tag) - 1)
            opened[name] += 1
    if at < len(source):
        say(source[at:])
    flush()
    return page


class Nodes:
    """The nodes of many pages in flat arrays."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64)
        self.parent = np.where(parent < 0, -1, parent + np.repeat(self.first[:-1], sizes))
        tags = [t for p in pages for t in p.tag]
        own = np.fromiter((x for p in pages for x in p.own), np.int64)
        linked = np.fromiter((x for p in pages for x in p.linked), np.int64)
        share = np.minimum(linked / np.maximum(own, 1), 1)
        self.features = np.stack([
            np.fromiter((_TAG_NO.get(t, len(_TAGS)) for t in tags), np.int64, len(tags)),
            np.fromiter((x for p in pages for x in p.names), np.int64),
            np.digitize(own, [1, 25, 100]),
            np.where(own == 0, 0, 1 + np.digitize(share, [0.01, 0.5])),
            np.fromiter((x for p in pages for x in p.marks), np.int64),
        ], axis=1)
        self.kind = np.fromiter((_KINDS.get(t, 0) for t in tags), np.int64, len(tags))
        depth = np.zeros(len(tags), np.int64)
        level, self.levels = np.flatnonzero(self.parent < 0), []
        order = np.argsort(self.parent, kind="stable")
        sorted_parent = self.parent[order]
        while len(level):  # children of a level: found by their parents in the sorted list
            self.levels.append(level)
            a, b = np.searchsorted(sorted_parent, level), np.searchsorted(sorted_parent, level, side="right")
            n = b - a
            level = order[np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)]
            depth[level] = len(self.levels)
        within = np.fromiter((t in ("article", "main") for t in tags), bool, len(tags))
        for level in self.levels[1:]:
            within[level] |= within[self.parent[level]]
        inner = within & (self.features[:, 0] == _TAG_NO["header"])
        self.features[inner, 0], self.kind[inner] = _INNER_HEADER, _KINDS["section"]

    def labels(self, pages: list[Page], own_main: bool) -> np.ndarray:
        """1 for nodes inside the marked main part, 0 for others. own_main: the mark is the page's article or main element."""
        flat = [(t, x) for p in pages for t, x in zip(p.tag, p.label)]
        opens = np.array([t in ("article", "main") if own_main else x == "content" for t, x in flat], bool)
        ends = np.array([t in ("nav", "aside", "form", "footer") if own_main else x == "other" for t, x in flat], bool)
        label = np.zeros(len(flat), np.int64)
        for level in self.levels:
            above = np.where(self.parent[level] >= 0, label[self.parent[level]], 0)
            label[level] = np.where(opens[level], 1, np.where(ends[level], 0, above))
        return label


class Model:
    """Log potentials from counts; `marginals` is the sum-product pass."""

    def __init__(self, counts: dict[tuple[int, int, int], float], smooth: float = 0.5):
        """counts: (feature, value, label) -> n; features from 100 on are transitions: 100 + kind, value = parent's label."""
        self.unary = []
        for f, size in enumerate(_SIZES):
            table = np.array([[counts.get((f, v, y), 0.0) for y in (0, 1)] for v in range(size)]) + smooth
            self.unary.append(np.log(table / table.sum(axis=0)))
        table = np.array([[[counts.get((100 + k, p, y), 0.0) for y in (0, 1)] for p in (0, 1)] for k in range(_N_KINDS)]) + smooth
        self.pair = np.log(table / table.sum(axis=2, keepdims=True))

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """P(content) of every node."""
        up = sum(table[nodes.features[:, f]] for f, table in enumerate(self.unary))
        pair = self.pair[nodes.kind]
        to_parent = np.zeros_like(up)
        for level in reversed(nodes.levels[1:]):
            to_parent[level] = np.logaddexp(pair[level, :, 0] + up[level, None, 0], pair[level, :, 1] + up[level, None, 1])
            np.add.at(up, nodes.parent[level], to_parent[level])
        belief = up.copy()
        for level in nodes.levels[1:]:
            above = belief[nodes.parent[level]] - to_parent[level]  # the parent's belief without this child's message
            belief[level] = up[level] + np.logaddexp(pair[level, 0] + above[:, :1], pair[level, 1] + above[:, 1:])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def extract(sources: list[str | None], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    nodes = Nodes(pages)
    content = model.marginals(nodes) >= 0.5
    out = []
    for page, first in zip(pages, nodes.first.tolist()):
        out.append("\n".join(text for node, text in page.blocks if content[first + node]))
    return out


def labelled_pages() -> list[str]:
    """Pages made by rule: every kind of main part with every kind of boilerplate, before, after and within it. data-label marks content and other."""
    mains = ["<article{}>", "<main{}>", '<div class="content"{}>', '<div id="main-content"{}>', '<section class="post"{}>', '<div class="entry"{}>', "<div{}>"]
    others = [
        '<nav{}><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li><li><a href="/c">About</a></li></ul></nav>',
        '<div class="menu"{}><ul><li><a href="/a">Start</a></li><li><a href="/b">All topics</a></li></ul></div>',
        "<header{}><h2>The Daily Site</h2><p>News and more since long ago.</p></header>",
        '<div id="header"{}><p>Welcome to our site.</p></div>',
        "<footer{}><p>&copy; 2020 The Site. All rights are reserved by the owner of this site.</p></footer>",
        '<div class="footer"{}>Imprint and contact. Written by the people of this site for their readers.</div>',
        "<footer{}>&copy; site.example.net &middot; A line about the owner of the site. And one more.</footer>",
        '<aside{}><h3>Latest</h3><p>A teaser of another story that is told at some length elsewhere on the site.</p></aside>',
        '<div class="sidebar"{}><h3>Popular</h3><ul><li><a href="/x">Ten things to know about it</a></li></ul><p>Other words at the side of the page.</p></div>',
        '<div class="ad"{}>Buy this now. It is the best offer of the year for you and all your friends and family.</div>',
        '<div class="advert banner"{}><p>A sponsored message. Read on to see what you can win when you join today.</p></div>',
        '<div class="cookie-notice"{}><p>We use cookies to give you the best experience. By going on you agree to that.</p></div>',
        '<div class="notice"{}>This page was moved. Please update your bookmarks, and tell others about it.</div>',
        '<form action="/s"{}><p>Sign up for our letter. We never share your address with anybody at all.</p><label>Mail</label></form>',
        '<section class="comments"{}><h3>3 comments</h3><div class="comment"><p>I think this is a very good piece, thank you for it. I have read it twice.</p></div><div class="comment"><p>Not so sure about the second part.</p></div></section>',
        '<div id="comments"{}><ul><li><p>First! What a story, I must say. Where can I read more of this?</p></li></ul></div>',
        '<ul class="share"{}><li><a href="/f">Share</a></li><li><a href="/t">Send</a></li></ul>',
        '<div class="related"{}><h3>Related</h3><p><a href="/z">Another story you may like to read</a></p></div>',
    ]
    body = "<h1>A title of the story</h1><p>The first paragraph tells what happened, where and when. It has some sentences, and they go on for a while.</p><p>Short one.</p><h2>A part</h2><p>Then more text follows with <a href='/l'>a link</a> in it, and it too is of some length, as texts are.</p><ul><li>one point of a list.</li><li>and a second point</li></ul><p>No.</p><blockquote><p>Somebody said this and that.</p></blockquote><p>A closing paragraph that sums up what was said before, so that readers can go home.</p>"
    plain = "<p>Only two paragraphs make up this page. They are not very long, but they say it all.</p><p>That is it</p>"
    titles = ["<header><h1>A title of the story</h1></header>", "<header><h1>A title of the story</h1><p>Told by one who was there</p></header>", "<header><div><h1>A title</h1><h2>And what it is about, in a line.</h2></div></header>"]
    rest = "<p>The first paragraph tells what happened, where and when. It has some sentences.</p><p>Then more text follows, and it too is of some length, as texts are.</p>"
    pages = []
    for (i, main), (j, other) in product(enumerate(mains), enumerate(others)):
        after = others[(j + i + 4) % len(others)].format(' data-label="other"')
        before, within = other.format(' data-label="other"'), other.format(' data-label="other"')
        end = "</" + re.match(r"<(\w+)", main)[1] + ">"
        inner = [body, plain, body + within, within + body][(i + j) % 4] if j >= 4 else [body, plain][(i + j) % 2]
        core = main.format(' data-label="content"') + inner + end
        wrapped = f'<div class="wrapper">{core}</div>' if (i + j) % 3 == 0 else core
        pages.append(f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{wrapped}{after}</body></html>")
    for i, other in enumerate([*others, *others[::3]]):  # the main part without an element of its own
        marked = other.format(' data-label="other"')
        pages.append(f'<html><body data-label="content">{marked if i % 3 else ""}{[body, plain][i % 2]}{"" if i % 2 else marked}</body></html>')
    for main in ["<div{}>", "<div{}><div>", "<section{}>", "<article{}>"]:  # nothing but the main part
        pages += [f'<html><body>{main.format(' data-label="content"')}{inner}</body></html>' for inner in (body, plain) for _ in range(4)]
    for main, title, other in product(mains[:2], titles, others[::9]):  # a header of the article's own
        end = "</" + re.match(r"<(\w+)", main)[1] + ">"
        marked = other.format(' data-label="other"')
        pages.append(f"<html><body>{others[2].format(' data-label="other"')}{main.format(' data-label="content"')}{title}{rest}{end}{marked}</body></html>")
    return pages


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in slices(batches, "html", 4 << 20):
        own_main = column(batch, "own_main").to_pylist()
        for flag in (False, True):
            pages = [parse(h) for h, o in zip(column(batch, "html").to_pylist(), own_main) if o == flag]
            if flag:
                pages = [p for p in pages if sum(t in ("article", "main") for t in p.tag) == 1]
            if not pages:
                continue
            nodes = Nodes(pages)
            label = nodes.labels(pages, flag)
            weight = 1 if flag else 20  # the made pages are few and cover more cases
            for f in range(len(_SIZES)):
                for (v, y), n in Counter(zip(nodes.features[:, f].tolist(), label.tolist())).items():
                    total[f, v, y] += n * weight
            child = np.flatnonzero(nodes.parent >= 0)
            for (k, p, y), n in Counter(zip(nodes.kind[child].tolist(), label[nodes.parent[child]].tolist(), label[child].tolist())).items():
                total[100 + k, p, y] += n * weight
    if total:
        columns = [*zip(*total), list(total.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["feature", "value", "label", "n"])


def train(spark: SparkSession, pages: DataFrame | None = None, sample: int = 2000, made: list[str] | None = None) -> Model:
    """Counts over the labelled pages (`made`: in place of labelled_pages()); a few hundred sums reach the driver."""
    labelled = spark.createDataFrame([(p, False) for p in (labelled_pages() if made is None else made)], "html string, own_main boolean")
    if pages is not None:
        marked = hash_sample(pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")), sample, "page_id", "url")
        labelled = labelled.unionByName(marked.select("html", F.lit(True).alias("own_main")))
    found = labelled.mapInArrow(tidy(_count), "feature long, value long, label long, n long").groupBy("feature", "value", "label").agg(F.sum("n").alias("n")).collect()
    return Model({(r["feature"], r["value"], r["label"]): r["n"] for r in found})


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    bounded_batches(pages.sparkSession)
    model = model or train(pages.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            text = extract(column(batch, "html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
