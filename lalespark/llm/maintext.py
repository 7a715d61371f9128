"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf tag path. Per path, text length and punctuation are
aggregated over its nodes and fused; paths above the threshold are content. Both are bounded for each block, so that one
very long block doesn't outweigh all others. The container is the <article> elements or <main> if they hold most content, or
else the deepest element that holds nearly all; a block in it makes part of the text if its path is content. Of the others
only short nodes between content stay: headings that content follows, and list items, table cells and the like beside content,
or near it by ratios smoothed along the page; not what is mostly links, nor what has a wrapper of its own. Elements that are
hidden (by the attribute or display:none) or boilerplate by tag never count, nor those with a class, id or role that is one
of WORDS or begins or ends with one (comment-list, siteFooter), unless they hold <main>, or all articles and no small part of the page, or nearly all content.

Null or empty html, and pages without text, give an empty string. Extra columns are ignored; repeated rows repeat.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag's name, and the rest of a tag: quotes part values only after an equals sign.
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
#: Elements that are left out whole, with all markup in them; the first ones reach to the end of the page if they aren't closed.
TO_THE_END = frozenset("script style textarea title".split())
LEFT_OUT = TO_THE_END | frozenset("noscript template iframe svg select option button object math canvas audio video".split())
#: Fixed values of the HTML standard: elements without content, elements within a line, and what a new block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var img wbr".split())
#: Elements that structure a text: short blocks in them may stand between content.
STRUCTURE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption details summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element named like boilerplate stays with this share of the page's content, or with an article of that share in it.
#: Length and marks of a block count up to these; a block of which more than LINKED is links is no short node of a text;
#: a heading stays if a kept block follows within HEADING_REACH blocks.
MOST_NAMED, LEAST_ARTICLE = 0.8, 0.3
MOST_LENGTH, MOST_MARKS, LINKED, HEADING_REACH = 300, 4, 0.5, 3
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements, and classes, ids or roles of boilerplate.
BOILERPLATE = frozenset("nav footer aside head menu dialog header".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments complementary contentinfo cookie cookies consent copyright "
    "disqus footer footnav gdpr header hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination paywall popup "
    "promo promoted promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe syndication toolbar widget".split()
)
#: Of these only whole names count: parts of names that are as common on an article's own elements.
WHOLE_ONLY = frozenset("header hidden search legal".split())
#: Parts that turn a name into its opposite or into a remark about the page.
NEGATIONS = frozenset("no not non without with has is hide show after before".split())
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_BLANK = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")


@lru_cache(maxsize=20_000)
def like_boilerplate(names: str) -> bool:
    """Whether a class, id or role is one of WORDS, or a compound that begins or ends with one, as comment-list or siteFooter."""
    for name in names.split():
        if name.lower() in WORDS:
            return True
        parts = [x.lower() for x in _PARTS.findall(name)]
        if len(parts) > 1 and NEGATIONS.isdisjoint(parts) and not {parts[0], parts[-1]}.isdisjoint(WORDS - WHOLE_ONLY):
            return True
    return False


def _signs(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether it is named like boilerplate."""
    hidden = named = False
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden":
                hidden = hidden or value.lower() != "until-found"
            elif name == "style":
                hidden = hidden or _NONE.search(value) is not None
            elif name in ("class", "id", "role"):
                named = named or like_boilerplate(value)
    return hidden, named and tag not in ("main", "article")


@dataclass
class Page:
    """Blocks in page order, and the elements they lie in as a tree: an element's parent has a smaller number; 0 is above all.

    An inline element is in the tree only if it is named like boilerplate. A form counts as named, as some sites have all of
    a page in one. shape numbers an element's path of tags.
    """

    texts: list[str] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)  # share of a block that is in links
    at: list[int] = field(default_factory=list)  # a block's element
    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    shape: list[int] = field(default_factory=lambda: [0])
    named: list[bool] = field(default_factory=lambda: [False])

    def up(self, values: list[float]) -> list[float]:
        """From a value for each block: the sum over the blocks in each element."""
        out = [0.0] * len(self.tag)
        for e, v in zip(self.at, values, strict=True):
            out[e] += v
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def down(self, marked: list[bool]) -> list[bool]:
        """Whether each element or one around it is marked."""
        out = list(marked)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def only(self, blocks: list[int]) -> Page:
        return Page([self.texts[k] for k in blocks], [self.linked[k] for k in blocks], [self.at[k] for k in blocks], self.tag, self.parent, self.shape, self.named)


def blocks(html: str) -> Page:
    """The blocks of a page that aren't hidden nor boilerplate by tag. Each character is read a bounded number of times."""
    page = Page()
    shapes: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int]] = []  # open elements, and where each is in the tree
    open_: dict[str, int] = {}  # how many of each tag are open
    hidden = 0  # depth from which on the stack is boilerplate, 0 for none
    text, linked = [], 0  # of this block, and characters in links
    unclosed: set[str] = set()  # elements to leave out whose end isn't on the rest of the page

    def add(s: str):
        nonlocal linked
        text.append(s)
        if open_.get("a"):
            linked += len(_BLANK.sub(" ", unescape(s)).strip())

    def flush():
        nonlocal linked
        if text:
            s = _BLANK.sub(" ", unescape("".join(text))).strip()
            if s:
                page.texts.append(s)
                page.linked.append(linked / len(s))
                page.at.append(stack[-1][1] if stack else 0)
            text.clear()
            linked = 0

    def pop(to: int):
        nonlocal hidden
        while len(stack) > to:
            tag, e = stack[-1]
            if tag in INLINE and page.named[e] and page.tag[e] == tag:
                flush()
            stack.pop()
            open_[tag] -= 1
        if hidden > to:
            hidden = 0

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        name = _NAME.match(html, lt + 1)
        if not name and not html.startswith(("<!", "<?", "</"), lt):  # a plain character
            lt = min(lt + 1, size)
            if not hidden:
                add(html[at:lt])
            at = lt
            continue
        if lt > at and not hidden:
            add(html[at:lt])
        if not name:  # a comment or the like
            mark = "-->" if html.startswith("<!--", lt) else ">"
            end = html.find(mark, lt + 2)
            at = size if end < 0 else end + len(mark)
            continue
        rest = _REST.match(html, name.end())
        if not rest:  # the page ends within a tag
            break
        at = rest.end()
        tag, closing = name[0].lower(), html[lt + 1] == "/"
        tag = tag.removeprefix("/")
        whole = False
        if tag in LEFT_OUT and not closing and tag not in unclosed:
            end = _ends(tag).search(html, at)
            if end or tag in TO_THE_END:
                at = end.end() if end else size
                continue
            unclosed.add(tag)
        if tag in LEFT_OUT and not closing:
            whole = True  # hidden until an element around it ends
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if closing:
            if open_.get(tag):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if inline and stack[k][0] not in INLINE:
                        break
            continue
        if not inline:  # a block ends an open paragraph and what is left open in it
            for k in range(len(stack) - 1, -1, -1):
                above = stack[k][0]
                if above == "p" or above in CLOSES.get(tag, ()):
                    pop(k)
                    if above == "p" or tag not in ("td", "th", "tr"):
                        break
                elif above not in INLINE and not (tag == "tr" and above in ("td", "th")):
                    break
        unseen, like = _signs(tag, html[name.end() : at - 1])
        like = not hidden and (like or tag == "form")
        if like:
            flush()
        parent = stack[-1][1] if stack else 0
        e = parent
        if not inline or like:
            e = len(page.tag)
            page.tag.append(tag)
            page.parent.append(parent)
            page.shape.append(shapes.setdefault((page.shape[parent], tag), len(shapes) + 1))
            page.named.append(like)
        within = open_.get("article") or open_.get("main")
        stack.append((tag, e))
        open_[tag] = open_.get(tag, 0) + 1
        if not hidden and (unseen or whole or tag in BOILERPLATE and not (tag == "header" and within)):
            hidden = len(stack)
    flush()
    return page


@lru_cache
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*+>", re.I)


def smooth(x: np.ndarray, reach: int = 2) -> np.ndarray:
    """Weighted mean over neighbouring blocks."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / 1.0) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]
    return np.convolve(x, kernel, "full")[reach : reach + len(x)] / weight


def _container(page: Page, weight: list[float]) -> list[bool]:
    """Whether each element lies in the container: articles or main with most of the weight, or else the deepest element with
    nearly all."""
    inside, total = page.up(weight), sum(weight)
    for name in ("article", "main"):
        outer = page.down([t == name for t in page.tag])
        if sum(w for w, e in zip(weight, page.at, strict=True) if outer[e]) > 0.5 * total:
            return outer
    # Elements are numbered from the outside in.
    best = max((e for e in range(1, len(page.tag)) if page.tag[e] not in ("p", "li") and inside[e] >= 0.8 * total), default=0)
    return page.down([e == best for e in range(len(page.tag))])


def _ratios(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Whether each block is content, and whether it would be by ratios that are smoothed along the page."""
    _, of = np.unique([page.shape[e] for e in page.at], return_inverse=True)
    nodes = np.bincount(of)
    length = np.array([min(len(t), MOST_LENGTH) for t in page.texts], dtype=float)
    marks = np.array([min(len(_MARKS.findall(t)), MOST_MARKS) for t in page.texts], dtype=float)
    text_ratio, mark_ratio = (np.bincount(of, length) / nodes)[of], (np.bincount(of, marks) / nodes)[of]
    fused = text_ratio * (1 + mark_ratio)
    least = 0.5 * fused.mean()
    near = np.bincount(of, smooth(text_ratio) * (1 + smooth(mark_ratio))) / nodes
    return fused >= least, near[of] >= least


def _without(page: Page) -> Page:
    """The blocks outside elements that are named like boilerplate, where the ratios don't say that the name misleads."""
    has = page.up([1.0] * len(page.at))
    suspects = [e for e, like in enumerate(page.named) if like and has[e]]
    if not suspects:
        return page
    content, _ = _ratios(page)
    length = [len(t) if c else 0 for t, c in zip(page.texts, content.tolist(), strict=True)]
    inside, total = page.up(length), sum(length)
    n = len(page.tag)
    marked = [has[e] > 0 and page.tag[e] in ("main", "article") for e in range(n)]
    below, mains, largest = [0] * n, [0] * n, [0.0] * n  # main and article elements within an element: all, main, and the most content in one
    around = [0] * n
    for e in range(n - 1, 0, -1):
        p = page.parent[e]
        below[p] += below[e] + marked[e]
        mains[p] += mains[e] + (marked[e] and page.tag[e] == "main")
        largest[p] = max(largest[p], largest[e], inside[e] if marked[e] else 0.0)
    for e in range(1, n):
        around[e] = around[page.parent[e]] + marked[page.parent[e]]
    every = sum(marked)
    gone = [False] * n
    for e in suspects:
        most = inside[e] >= MOST_NAMED * total and every == below[e] + around[e] + marked[e]
        alone = every == below[e] > 0  # no other main or article, be it around it or elsewhere
        gone[e] = not (mains[e] or most or alone and largest[e] >= LEAST_ARTICLE * total)
    gone = page.down(gone)
    return page.only([k for k, e in enumerate(page.at) if not gone[e]])


def main_text(html: str | None) -> str:
    page = _without(blocks(html)) if html else Page()
    if not page.texts:
        return ""
    content, near = (x.tolist() for x in _ratios(page))
    inside = _container(page, [float(len(t)) if c else 0.0 for t, c in zip(page.texts, content, strict=True)])
    at = [k for k, e in enumerate(page.at) if inside[e]]
    main = [k for k in at if content[k]]
    if not main:
        return ""
    holds = [x > 0 for x in page.up(_flags(main, len(page.at)))]  # elements that hold content
    holds[0] = True
    structural = [True] * len(page.tag)  # whether all elements from the nearest that holds content are of a text's structure
    for e in range(1, len(page.tag)):
        structural[e] = holds[e] or page.tag[e] in STRUCTURE and structural[page.parent[e]]
    keep = set(main)
    follows = len(page.texts) + HEADING_REACH  # the next content block, walking back
    for n in range(len(at) - 1, -1, -1):
        k = at[n]
        e = page.at[k]
        if content[k]:
            follows = n
            continue
        if not structural[e]:
            continue
        if not holds[e] and page.tag[e] in HEADINGS:
            if follows - n <= HEADING_REACH and (page.linked[k] <= LINKED or page.tag[e] == "h1"):
                keep.add(k)
        elif page.linked[k] <= LINKED and (main[0] < k < main[-1] or near[k]):
            keep.add(k)
            follows = n
    return " ".join(page.texts[k] for k in sorted(keep))


def _flags(chosen: list[int], n: int) -> list[bool]:
    out = [False] * n
    for k in chosen:
        out[k] = True
    return out


def _run(batches):
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
