"""Main text of web pages by a tree-structured graphical model over the DOM, read out by sum-product message passing."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modweave.llm.common import table

#: Within a tag a quote opens a string only as the first sign of a value, as HTML has it.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]++)|=)*+"
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(" + _ATTRS + r")(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr math mi mn mo ms mrow mfrac msup msub msubsup msqrt mroot mtext mspace mover munder munderover mstyle semantics".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never text of the page, whatever the model says: no prose, or what stands in where a player or script is missing.
_DROPPED = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg object audio video canvas select option button datalist map annotation annotation-xml".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("html body table td th caption button article section div main aside nav header footer blockquote li form".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_BAD = re.compile(r"(?<![a-z])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|side-?bar|aside|footer|header|masthead|comments?|disqus|respon[ds]\w*|repl(?:y|ies)|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|overlay|social|shar(?:e|ing)|related|recommend\w*|newsletter|subscri\w*|sign-?up|log-?in|breadcrumbs?|widget|tool-?bar|copyright|legal|pagination|pager|search|form|teaser|skip|hidden|tracking)(?![a-z])", re.I)
_GOOD = re.compile(r"(?<![a-z])(?:article|content|main|post|entry|story|body|text|prose)(?![a-z])", re.I)

_KINDS = {t: k for k, tags in enumerate([
    "article main", "nav menu", "header", "footer", "aside", "form fieldset label legend input dialog", "ul ol dl", "li dt dd", "p",
    "h1", "h2 h3 h4 h5 h6", "table thead tbody tfoot tr td th caption", "section div center details summary", "html body #root", "figure figcaption", "blockquote pre address",
]) for t in tags.split()}
_N_KINDS = 17
#: Bias, tag kinds, good name, bad name, long text, short text, mostly links, ends as a sentence does, hidden.
N_FEATURES = 1 + _N_KINDS + 7


class Page:
    """Elements in document order (parents first) and the runs of text between block boundaries, with their elements."""

    __slots__ = ("tags", "parents", "names", "runs", "own", "linked")

    def __init__(self, html: str):
        self.tags, self.parents, self.names = ["#root"], [-1], [""]
        self.runs: list[tuple[int, str]] = []
        self.own, self.linked = [0], [0]
        stack, block = [0], [0]  # open elements; for each, the nearest block element
        chunk: list[str] = []
        chunk_of, links, dropped, at, n = 0, 0, 0, 0, len(html)

        def flush() -> None:
            nonlocal chunk
            if chunk:
                text = " ".join("".join(chunk).split())
                if text:
                    self.runs.append((chunk_of, text))
                    self.own[chunk_of] += len(text)
                chunk = []

        def text_from(lo: int, hi: int) -> None:
            nonlocal chunk_of
            if lo < hi and not dropped:
                if chunk and chunk_of != block[-1]:
                    flush()
                chunk_of = block[-1]
                s = html[lo:hi]
                s = unescape(s) if "&" in s else s
                chunk.append(s)
                if links:
                    self.linked[chunk_of] += len(s)

        def pop() -> None:
            nonlocal links, dropped
            tag = self.tags[stack.pop()]
            block.pop()
            links -= tag == "a"
            dropped -= tag in _DROPPED
            if tag not in _INLINE:
                flush()

        while at < n:
            lt = html.find("<", at)
            m = _MARKUP.match(html, lt) if lt >= 0 else None
            while lt >= 0 and not m:
                nxt = html.find("<", lt + 1)
                lt, m = nxt, _MARKUP.match(html, nxt) if nxt >= 0 else None
            if lt < 0:
                text_from(at, n)
                break
            text_from(at, lt)
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                inline = tag in _INLINE
                for i in range(len(stack) - 1, 0, -1):
                    t = self.tags[stack[i]]
                    if t == tag:
                        while len(stack) > i:
                            pop()
                        break
                    if inline and t not in _INLINE:
                        break
                continue
            if tag == "br" or tag == "hr":
                flush()
                continue
            if tag in _VOID:
                continue
            if tag in _ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    t = self.tags[stack[i]]
                    if t == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if t in _SCOPE:
                        break
            if tag in _CLOSES:
                ends, within = _CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    t = self.tags[stack[i]]
                    if t in within:
                        break
                    if t in ends:
                        while len(stack) > i:
                            pop()
                        break
            if tag not in _INLINE:
                flush()
            me = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.names.append(m[3])
            self.own.append(0)
            self.linked.append(0)
            if m[3].endswith("/") and tag not in _KINDS:
                continue
            stack.append(me)
            block.append(block[-1] if tag in _INLINE else me)
            links += tag == "a"
            dropped += tag in _DROPPED
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = end.start() if end else n
        while len(stack) > 1:
            pop()
        flush()

    def features(self) -> list[list[int]]:
        """The features that are on, element by element (inline elements have none but the bias)."""
        last = dict(self.runs)
        below_own, below_linked = self.own[:], self.linked[:]
        for i in range(len(self.tags) - 1, 0, -1):
            below_own[self.parents[i]] += below_own[i]
            below_linked[self.parents[i]] += below_linked[i]
        out = []
        for i, tag in enumerate(self.tags):
            on = [0]
            if tag not in _INLINE:
                on.append(1 + _KINDS.get(tag, _N_KINDS - 1))
                attrs = self.names[i]
                if attrs:
                    found = _ATTR.findall(attrs)
                    named = " ".join(v for k, v in found if k.lower() in ("class", "id", "role")).replace("_", "-")
                    if named:
                        if _GOOD.search(named):
                            on.append(_N_KINDS + 1)
                        if _BAD.search(named):
                            on.append(_N_KINDS + 2)
                    if any(k.lower() == "hidden" or k.lower() == "aria-hidden" and "true" in v or k.lower() == "style" and re.search(r"display\s*:\s*none", v) for k, v in found):
                        on.append(_N_KINDS + 7)
                if self.own[i] >= 80:
                    on.append(_N_KINDS + 3)
                elif self.own[i]:
                    on.append(_N_KINDS + 4)
                if below_own[i] and 2 * below_linked[i] > below_own[i]:
                    on.append(_N_KINDS + 5)
                if self.own[i] and last[i][-1:] in ".!?…\"”»":
                    on.append(_N_KINDS + 6)
            out.append(on)
        return out

    def edges(self) -> list[int]:
        """The kind of each element's tie to its parent: 0 inline, 1 other, 2 where the child is named a region of its own."""
        own = {"nav", "aside", "footer", "header", "form", "article", "main", "menu"}
        return [0 if t in _INLINE else 2 if t in own or a and _BAD.search(a) else 1 for t, a in zip(self.tags, self.names)]


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(unary: list[float], parents: list[int], kinds: list[int], ties: list[tuple[float, float]]) -> tuple[list[float], list[tuple[float, float]]]:
    """P(content) of each element, and P(both content), P(neither) of each element with its parent.

    ``unary`` are log-odds of content. A tie (same1, same0) is the log-potential of two contents and of two
    non-contents. Messages go from the leaves up and from the root down, once each, so the marginals are exact.
    """
    n = len(unary)
    up, down = unary[:], [0.0] * n  # log-odds gathered from below; from above
    sent = [0.0] * n
    for i in range(n - 1, 0, -1):
        s1, s0 = ties[kinds[i]]
        sent[i] = _log_sum(s1 + up[i], 0.0) - _log_sum(up[i], s0)
        up[parents[i]] += sent[i]
    p, pair = [0.0] * n, [(0.0, 0.0)] * n
    for i in range(n):
        if i:
            s1, s0 = ties[kinds[i]]
            above = up[parents[i]] + down[parents[i]] - sent[i]
            down[i] = _log_sum(s1 + above, 0.0) - _log_sum(above, s0)
            # joint of parent (above) and child (up)
            a, b, c, d = s1 + above + up[i], above, up[i], s0
            top = max(a, b, c, d)
            a, b, c, d = (math.exp(x - top) for x in (a, b, c, d))
            z = a + b + c + d
            pair[i] = (a / z, d / z)
        x = up[i] + down[i]
        p[i] = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
    return p, pair


WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
#: Labelled pages that the model is trained on. The number is fixed, whatever the input's size.
TRAINING_PAGES = 160


def labelled_page(rng: random.Random) -> tuple[str, dict[int, int]]:
    """A page of common layout whose elements are labelled: 1 content, 0 not; elements around both have no label.

    Content carries ``y1`` and the rest ``y0`` as a mark that is read and taken out before training.
    """
    say = lambda a, b: " ".join(rng.choice(WORDS) for _ in range(rng.randint(a, b)))
    line = lambda a, b: say(a, b).capitalize() + rng.choice("...!?")
    maybe = lambda x, p=0.5: x if rng.random() < p else ""
    links = lambda n: "<ul y0>" + "".join(f'<li y0><a href="/{rng.choice(WORDS)}">{say(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def named(names: str, inside: str, tag: str = "div") -> str:
        return f'<{tag} y0 {rng.choice(["class", "id"])}="{rng.choice(names.split())}">{inside}</{tag}>'

    def para() -> str:
        x = line(6, 60) if rng.random() < 0.8 else line(1, 4)
        if rng.random() < 0.2:
            x = f"<b>{say(1, 5)}</b> {x}"
        if rng.random() < 0.2:
            x += f' <a href="/x">{say(1, 3)}</a>'
        if rng.random() < 0.1:
            x = f"<b>{x}<br>"
            return f"<p y1>{x}"
        return f"<p y1>{x}</p>"

    def body() -> str:
        parts = [f"<h1 y1>{say(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 8)):
            parts.append(rng.choices([
                para(), f"<h2 y1>{say(1, 6)}</h2>", f"<ul y1><li y1>{line(3, 20)}</li><li y1>{line(3, 20)}</li></ul>", f"<blockquote y1>{line(5, 40)}</blockquote>",
                f"<table y1><tr y1><td y1>{say(1, 5)}</td><td y1>{say(1, 5)}</td></tr></table>", f"<pre y1>{say(4, 20)}</pre>", f"<figure y1><figcaption y1>{line(3, 12)}</figcaption></figure>",
                f"<div y1>{line(6, 50)}</div>", named("ad ads advert sponsored promo-box newsletter related share-buttons", maybe(f"<p y0>{line(2, 20)}</p>") or line(2, 20)), f"<aside y0><p y0>{line(3, 30)}</p></aside>",
            ], [14, 2, 2, 1, 1, 1, 1, 2, 1, 1])[0])
        return "".join(parts)

    comments = named("comments comment-list reader-comments disqus", "".join(f'<div y0 class="comment"><p y0>{line(4, 40)}</p></div>' for _ in range(rng.randint(1, 5))), rng.choice(["div", "section"]))
    inner = body() + maybe(comments, 0.15)
    main = rng.choice(["<article y1>{}</article>", "<main y1>{}</main>", '<div y1 class="content">{}</div>', '<div y1 id="main-content">{}</div>', '<div y1 class="post-body">{}</div>', "<article y1><div y1>{}</div></article>", "<main y1><article y1>{}</article></main>"]).format(inner)
    before = [
        maybe(f"<header y0><h1 y0>{say(1, 3)}</h1>{maybe(f'<p y0>{line(2, 8)}</p>')}</header>"), maybe(named("header masthead banner", say(1, 6))), maybe(f"<nav y0>{links(rng.randint(2, 8))}</nav>", 0.8), maybe(named("menu nav navbar breadcrumbs", links(3)), 0.3),
        maybe(named("cookie-notice consent notice alert popup", f"<p y0>{line(5, 30)}</p>"), 0.3), maybe(named("ad advert banner-ad sponsored", line(2, 25)), 0.5), maybe(f"<form y0><label y0>{say(1, 3)}</label><p y0>{say(2, 8)}</p></form>", 0.3),
    ]
    after = [
        maybe(f"<aside y0><h2 y0>{say(1, 3)}</h2>{links(3)}<p y0>{line(3, 30)}</p></aside>", 0.4), maybe(named("sidebar widget related", f"<h3 y0>{say(1, 3)}</h3><p y0>{line(3, 30)}</p>{links(3)}"), 0.4), maybe(comments, 0.3),
        maybe(named("newsletter subscribe signup social share", f"<p y0>{line(3, 15)}</p>"), 0.3), maybe(f"<footer y0>&copy; {say(1, 3)} &middot; {line(3, 15)}{maybe(f'<p y0>{line(3, 20)}</p>')}</footer>", 0.8), maybe(named("footer copyright legal", line(3, 20)), 0.2),
    ]
    html = "<html><head><title>t</title></head><body>" + "".join(before) + maybe("<div y->", 0.3) + main + "".join(after) + "</body></html>"
    labels = {i + 1: int(y) for i, y in enumerate(re.findall(r"<[a-z]\w*(?: y([01-]))?[^>]*>", re.sub(r"<br>", "", html))) if y in ("0", "1")}
    return re.sub(r" y[01-]", "", html), labels


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES, rounds: int = 30, seed: int = 7) -> tuple[tuple[float, ...], tuple[tuple[float, float], ...]]:
    """Unary weights and ties: gradient ascent on the conditional likelihood of the labelled pages.

    The gradient is the difference of expected counts with and without the labels clamped, both by message passing.
    """
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        html, labels = labelled_page(rng)
        page = Page(html)
        on = page.features()
        clamp = [0.0] * len(on)
        for i, y in labels.items():
            clamp[i] = 60.0 if y else -60.0
        data.append((on, page.parents, page.edges(), clamp))
    w, ties = np.zeros(N_FEATURES), np.ones((3, 2))
    gw, gt = np.full(N_FEATURES, 1e-3), np.full((3, 2), 1e-3)
    for _ in range(rounds):
        dw, dt = -0.5 * w, np.zeros((3, 2))
        weights, pairs = w.tolist(), [tuple(t) for t in ties.tolist()]
        for on, parents, kinds, clamp in data:
            unary = [sum(weights[f] for f in fs) for fs in on]
            free, both = marginals(unary, parents, kinds, pairs)
            held, both_held = marginals([u + c for u, c in zip(unary, clamp)], parents, kinds, pairs)
            for i, fs in enumerate(on):
                d = held[i] - free[i]
                for f in fs:
                    dw[f] += d
                if i:
                    dt[kinds[i], 0] += both_held[i][0] - both[i][0]
                    dt[kinds[i], 1] += both_held[i][1] - both[i][1]
        gw += dw**2
        gt += dt**2
        w += 0.7 * dw / np.sqrt(gw)
        ties += 0.7 * dt / np.sqrt(gt)
    return tuple(w.tolist()), tuple(tuple(t) for t in ties.tolist())


def main_text(html: str | None, model=None) -> str:
    """The text of the runs whose element is more likely content than not, in page order, joined by single spaces."""
    if not html:
        return ""
    weights, ties = model or trained()
    page = Page(html)
    if not page.runs:
        return ""
    p, _ = marginals([sum(weights[f] for f in fs) for fs in page.features()], page.parents, page.edges(), ties)
    return " ".join(text for i, text in page.runs if p[i] > 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Pages are worked on one by one, so nothing is shuffled and a page's tree is all that is in memory. Null html
    and pages without content give ''. Repeated rows give repeated results. An empty table gives an empty result.
    Extra columns are not read.
    """
    model = trained()  # on the driver, once; a few dozen numbers go to the tasks

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, model) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
