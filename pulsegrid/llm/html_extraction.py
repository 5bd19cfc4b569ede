"""HTML extraction: a page's blocks are labelled content or boilerplate by a minimum cut.

Two kinds of nodes stand in a page's graph. Text blocks: a fitted classifier of their text, of their neighbours, and of what the names around them say gives the capacities to source and
sink. Elements that say something by their tag or role: their evidence, for each block in them, is their capacity. Edges join blocks that are neighbours in
page order, blocks of one parent, and each block with the element nearest around it; max-flow finds the labels of least cost.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, table, without_clashes

#: A comment, a declaration, or a tag with its attributes; what is never closed runs to the page's end.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# HTML's element names.
UNREAD = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "audio", "video", "title", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr br input button".split()
)
HEAD_ONLY = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
#: Elements that a start tag of the same group closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "tbody", "thead", "article", "section", "main", "body", "div", "nav", "footer", "aside"}
SECTIONS = {"article", "section", "main", "nav", "aside", "footer", "header", "form"}
HEADINGS, ITEMS, PARAGRAPHS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"p", "blockquote", "pre"}
# Names and tags that say something about the blocks in an element.
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "header", "head"}
BOILERPLATE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription share sharing social related recommend recommended recommendations trending popular "
    "sidebar aside rail nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer foot copyright legal masthead topbar toolbar "
    "comment comments commentlist disqus reply replies respond discussion responses login signin signup register search widget skip".split()
)
CONTENT_NAMES = set("article content post entry story body text main".split())
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words that turn a name on a wrapper into a remark about it (has-sidebar).
REMARKS = {"has", "with", "no", "without"}
# Evidence of elements for each block in them, and capacities of edges, all in log-odds.
BOILERPLATE, ARTICLE, MAIN = -5.0, 2.6, 1.3
TIE_BOILERPLATE, TIE_CONTENT, ADJACENT, SAME_PARENT, SAME_SECTION, SIBLING = 5.5, 2.0, 0.2, 0.5, 0.2, 0.3
#: A block's text says so much at most, in log-odds, and the names around it so much.
CERTAIN, NAMED = 2.5, 5.0
#: What the classifier expects before it has seen a page: weights of bias, length, share of link text, end of a sentence, copyright sign, heading, item
#: of a list, paragraph, the lengths and link shares of the neighbours, and names of boilerplate and of content around the block.
PRIOR = np.array([-0.6, 2.5, -3.5, 0.8, -2.5, 0.3, -0.5, 0.5, 1.0, -1.0, -5.0, 1.0])
#: How many of these are of the text.
OF_TEXT = 10
#: Strength of that expectation; pages that the weights are fitted on (all if there are fewer, else about so many, chosen by a hash of the page), and blocks of each.
PRIOR_STRENGTH, TRAIN_PAGES, TRAIN_BLOCKS = 0.02, 1_000, 40


class Element:
    """An element on the way to blocks. found: what its tag or role says; named: what its names say (-1, 0 or 1), and at last those around it too; soft: that what it says against its blocks is worth nothing if
    it turns out to be a wrapper of the page."""

    __slots__ = ("chars", "clear", "content", "evidence", "found", "heading", "inner", "marked", "named", "number", "parent", "section", "soft", "tag")

    def __init__(self, tag: str, number: int, parent: Element | None, found: float, named: int, soft: bool, section: int):
        self.tag, self.number, self.parent, self.found, self.named, self.soft, self.section = tag, number, parent, found, named, soft, section
        self.chars = self.content = self.marked = self.inner = 0
        self.heading, self.evidence, self.clear = False, 0.0, 0


class Block:
    __slots__ = ("element", "linked", "parent", "parts", "tag", "text")

    def __init__(self, element: Element, parent: Element):
        self.element, self.parent, self.tag, self.parts, self.linked, self.text = element, parent, parent.tag, [], 0, ""


def _says(tag: str, attributes: str, in_article: bool) -> tuple[float, int, bool, bool]:
    """What an element says about the blocks in it: evidence of its tag or role, what its names say, whether what it says against them is soft, and whether the tag alone is clear (for the classifier's labels)."""
    names: set[str] = set()
    role, unseen = "", False
    if len(attributes) > 4 and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                for name in value.split():
                    parts = set(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-"))
                    names |= set() if parts & REMARKS else parts
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and UNSEEN.search(value)):
                unseen = True
    by_tag = tag in BOILERPLATE_TAGS and not (tag == "header" and in_article)
    bad = bool(names & BOILERPLATE_NAMES) and not (tag in ("article", "main") and not names & {"comment", "comments", "reply"})
    named = -1 if bad else 1 if names & CONTENT_NAMES else 0
    if unseen or role in BOILERPLATE_ROLES or (by_tag and tag not in ("form", "header")):
        return BOILERPLATE, named, False, by_tag
    if by_tag:
        return BOILERPLATE, named, True, True
    if tag == "article" or role == "article":
        return ARTICLE, named, True, True
    if tag == "main" or role == "main":
        return MAIN, named, True, True
    return 0.0, named, True, False


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order: runs of text between block-level tags. An open element is looked at when it closes, so nesting costs no more than its tags."""
    out: list[Block] = []
    root = Element("", 0, None, 0.0, 0, False, 0)
    made, stack, opened = [root], [root], Counter()
    at, block, links = 0, None, 0

    def close(depth: int) -> None:
        nonlocal links
        for e in stack[depth:]:
            opened[e.tag] -= 1
            links -= e.tag == "a"
        del stack[depth:]

    def say(text: str) -> None:
        nonlocal block
        top = stack[-1]
        if top.tag in INLINE and top.found < 0 and not top.soft:
            return  # words within a line that nobody sees
        if block is None:
            if not text or text.isspace():
                return
            if stack[-1].tag == "head":
                close(len(stack) - 1)
            k = len(stack) - 1
            while stack[k].tag in INLINE:
                k -= 1
            block = Block(stack[-1], stack[k])
            out.append(block)
        elif top is not block.element:
            block.element = block.parent  # no inline element holds all of it
        block.parts.append(text)
        if links:
            block.linked += len(text)

    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            if name not in INLINE:
                block = None
            if opened[name] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != name:
                    depth -= 1
                close(depth)
            continue
        if name in UNREAD:
            if not m[3].endswith("/>") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = len(page) if end is None else (page.find(">", end.start()) + 1 or len(page))
            if name not in INLINE and name not in ("svg", "math", "canvas"):
                block = None
            continue
        if name == "br":
            say(" ") if block is not None else None
            continue
        if opened["head"] and name not in HEAD_ONLY:  # its end tag may be left out
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "head")
            close(depth)
        if name not in INLINE:
            block = None
            ends = CLOSED_BY.get(name, set())
            if opened["p"] or any(opened[x] for x in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends or stack[i].tag == "p":
                        close(i)
                        if name not in ("td", "th", "tr"):
                            break
                    elif stack[i].tag in SCOPES and stack[i].tag not in ends:
                        break
        elif name == "a" and opened["a"]:  # links don't nest
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "a")
            if all(x.tag in INLINE for x in stack[depth:]):
                close(depth)
        if name in VOID or m[3].endswith("/>"):
            continue
        found, named, soft, clear = _says(name, m[3], opened["article"] + opened["main"] > 0)
        if name in INLINE and name != "a" and not found and not named:
            continue
        top = stack[-1]
        e = Element(name, len(made), top, found, named, soft, len(made) if name in SECTIONS else top.section)
        e.clear = (1 if found > 0 else -1) if clear and found else 0
        made.append(e)
        stack.append(e)
        opened[name] += 1
        links += name == "a"
        if name not in INLINE:
            top.inner += 1
        if name == "h1":
            top.heading = True
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if not b.parent.inner and b.parent.parent:  # a paragraph, item or cell: its parent is what it shares with others
            b.parent = b.parent.parent
    out = [b for b in out if b.text]
    _weigh(made, out)
    return out


def _weigh(made: list[Element], found: list[Block]) -> None:
    """Sets every element's evidence and names, its own and what it inherits, and whether tags alone make it clear. What a tag says against its blocks stays so, whatever is inside; names of boilerplate take away
    what tags of content say.

    An element that is boilerplate by its names alone (or a form or header) says nothing if it wraps the page's content: if at least half of the page's text outside links is in it
    and so is every element that says content; or nearly all of that text, a main heading and other such elements.
    """
    for b in found:
        b.element.chars += max(0, sum(map(len, b.parts)) - b.linked)
    for e in reversed(made[1:]):  # children before parents
        bad = e.found < 0 or e.named < 0
        e.content += (e.found > 0 or e.named > 0) and not bad
        e.marked += bad
        up = e.parent
        up.chars += e.chars
        up.content += e.content
        up.marked += e.marked
        up.heading |= e.heading
    page = made[0]
    for e in made[1:]:
        own, named = e.found, e.named
        if (own < 0 or named < 0) and e.soft and page.chars:
            share = e.chars / page.chars
            if page.content:
                wraps = share >= 0.5 and e.content == page.content
            else:
                wraps = share >= 0.8 and e.heading and e.marked > 1
            own, named = (0.0 if wraps and own < 0 else own), (0 if wraps and named < 0 else named)
        above = e.parent
        e.named = -1 if named < 0 or above.named < 0 else max(named, above.named)
        if own < 0 or above.evidence < 0:
            e.evidence = min(own, above.evidence)
        else:
            e.evidence = 0.0 if e.named < 0 else max(own, above.evidence)
        if not own:
            e.number = above.number  # the nearest element around that says something
        tag_says = e.clear if own == e.found else 0
        if above.clear < 0 or tag_says < 0:
            e.clear = -1
        elif e.evidence > 0 and (above.clear > 0 or tag_says > 0):
            e.clear = 1
        else:
            e.clear = 0


def features(found: list[Block]) -> np.ndarray:
    """A row of numbers for each block, from its text, its tag and its neighbours' text, and from the names, but not the tags, of the elements around it."""
    n = len(found)
    x = np.zeros((n, len(PRIOR)))
    x[:, 0] = 1
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        x[i, 1] = min(1.0, math.log1p(words) / 3.7)
        x[i, 2] = min(1.0, b.linked / max(1, sum(map(len, b.parts))))
        x[i, 3] = b.text[-1] in ".!?…\"'”"
        x[i, 4] = "©" in b.text[:40]
        x[i, 5], x[i, 6], x[i, 7] = b.tag in HEADINGS, b.tag in ITEMS, b.tag in PARAGRAPHS
        x[i, 10], x[i, 11] = b.element.named < 0, b.element.named > 0
    for k, column in ((8, 1), (9, 2)):
        around = np.concatenate([x[:1, column], x[:, column], x[-1:, column]])  # a page's ends are their own neighbours
        x[:, k] = (around[:-2] + around[2:]) / 2
    return x


def log_odds(found: list[Block], weights: np.ndarray = PRIOR) -> list[float]:
    """The classifier: log-odds that a block is content, by its own text and by the names around it, each within its bound."""
    x = features(found)
    text, names = x[:, :OF_TEXT] @ weights[:OF_TEXT], x[:, OF_TEXT:] @ weights[OF_TEXT:]
    return (np.clip(text, -CERTAIN, CERTAIN) + np.clip(names, -NAMED, NAMED)).tolist()


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights of a logistic classifier that are likeliest under PRIOR, both labels weighing alike; PRIOR itself where a label is missing. Newton steps."""
    w = PRIOR.copy()
    if not 0 < y.sum() < len(y):
        return w
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + PRIOR_STRENGTH * (w - PRIOR)
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> np.ndarray:
    """The classifier's weights, from pages themselves: blocks that a tag alone makes clear (article or main against nav, footer, aside, form or header) are its labels, and
    their text and names, never those tags, are what it learns from. The sample holds about train_pages pages, and TRAIN_BLOCKS blocks of each, evenly spaced; only their features reach the driver.

    Pages without such tags, an empty table and null pages leave the weights at PRIOR. Repeated pages are sampled together."""
    n = pages.count()
    some = pages.select(F.col(html_col).alias("_raw")).where(F.pmod(F.xxhash64(F.lit(7), "_raw"), F.lit(1_000_000)) < 1e6 * train_pages / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 128):
            labels, rows = [], []
            for page in b.column(0).to_pylist():
                found = blocks(page or "")
                if found:
                    x = features(found)
                    clear = [i for i, block in enumerate(found) if block.element.clear]
                    for i in clear[:: max(1, -(-len(clear) // TRAIN_BLOCKS))]:
                        labels.append(int(found[i].element.clear > 0))
                        rows.append(x[i].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    got = some.mapInArrow(run, "y int, x array<double>").toArrow()
    x, y = np.array(got.column("x").to_pylist()).reshape(-1, len(PRIOR)), got.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the same whatever order the rows came in
    return fit_weights(x[order], y[order].astype(float))


def graph(found: list[Block], own: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(scores, edges) of the page's graph: first the blocks, then the elements nearest around them that say something."""
    scores, edges, last, place = list(own), [], {}, {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            edges.append((i - 1, i, ADJACENT + SAME_PARENT * (a.parent is b.parent) + SAME_SECTION * (a.element.section == b.element.section)))
        j = last.get(id(b.parent))
        if j is not None and j < i - 1:
            edges.append((j, i, SIBLING))
        last[id(b.parent)] = i
        e = b.element
        if e.evidence:
            k = place.setdefault((e.number, e.evidence), len(scores))
            if k == len(scores):
                scores.append(0.0)
            scores[k] += e.evidence
            edges.append((i, k, TIE_BOILERPLATE if e.evidence < 0 else TIE_CONTENT))
    return scores, edges


def max_flow(head: list[int], capacity: list[float], arcs: list[list[int]], source: int, sink: int) -> list[bool]:
    """Sends all the flow there is, along shortest paths in levels, and returns which nodes the source still reaches. Arc i leads to head[i], its
    reverse is i ^ 1, and arcs[u] leave u. capacity is used up."""
    n = len(arcs)
    while True:
        level, todo = [-1] * n, deque([source])
        level[source] = 0
        while todo:
            u = todo.popleft()
            for i in arcs[u]:
                v = head[i]
                if level[v] < 0 and capacity[i] > 1e-9:
                    level[v] = level[u] + 1
                    todo.append(v)
        if level[sink] < 0:
            return [x >= 0 for x in level]
        tried, path, u = [0] * n, [], source
        while True:
            if u == sink:
                sent = min(capacity[i] for i in path)
                full = len(path)
                for k in range(len(path) - 1, -1, -1):
                    i = path[k]
                    capacity[i] -= sent
                    capacity[i ^ 1] += sent
                    if capacity[i] <= 1e-9:
                        full = k
                u = head[path[full] ^ 1]
                del path[full:]
                continue
            a = arcs[u]
            while tried[u] < len(a):
                i = a[tried[u]]
                if capacity[i] > 1e-9 and level[head[i]] == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(a):
                path.append(a[tried[u]])
                u = head[path[-1]]
            elif path:  # nothing more goes that way
                u = head[path.pop() ^ 1]
                tried[u] += 1
            else:
                break


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (content or not) of least cost: a label against a node's score costs the score, a pair of different labels the edge between them."""
    n = len(scores)
    head, capacity, arcs = [], [], [[] for _ in range(n + 2)]

    def join(u: int, v: int, there: float, back: float) -> None:
        arcs[u].append(len(head))
        arcs[v].append(len(head) + 1)
        head.extend((v, u))
        capacity.extend((there, back))

    for i, x in enumerate(scores):
        if x > 0:
            join(n, i, x, 0.0)
        elif x < 0:
            join(i, n + 1, -x, 0.0)
    for i, j, x in edges:
        join(i, j, x, x)
    return max_flow(head, capacity, arcs, n, n + 1)[:n]


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    """The blocks that the cut calls content, joined by line feeds; empty if there are none."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = min_cut(*graph(found, log_odds(found, weights)))
    return "\n".join(b.text for b, k in zip(found, keep, strict=False) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, weights: np.ndarray | None = None) -> DataFrame:
    """pages (of its columns only keep, if given) plus text, the page's main text, and n_chars, its code points. Without weights they are fitted on pages.

    Null and empty pages, and pages of boilerplate alone, give the empty text. Broken markup is read as far as it goes: unclosed elements end where their parents
    do, an unfinished tag at the end of the page is dropped. Repeated rows give the same text. An empty table gives an empty result; columns named
    like the new ones are replaced.
    """
    weights = fit(pages, html_col) if weights is None else weights
    kept = without_clashes(pages.select(*keep) if keep else pages, "text", "n_chars", "_raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 128):
            texts = [main_text(x, weights) for x in b.column(b.num_columns - 1).to_pylist()]
            columns = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return pages.select(*kept.columns, F.col(html_col).alias("_raw")).mapInArrow(run, f"{schema}, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
