"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags, with recovery from unclosed ones. A logistic classifier on a
block's own features (ancestors, class and id words, link density, length, punctuation) gives each block the cost of
either label; these are its terminal capacities. Neighbouring blocks, and more so those close in the DOM, are tied by
smoothness edges, as are those that follow each other in one parent with others between. The minimum cut, found by
augmenting paths, separates content from boilerplate, and nothing but the cut decides: lists of words and tags only
enter the costs. There are no labelled pages to fit the weights to; they are parameters.

A form that holds more than half of a page's text wraps the page and does not count as one. Scripts, styles and the like have no text.

Defined cases: null html is empty; a page without content has the empty text and n_chars 0; pages of any length and
depth; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm._shared import table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "xmp", "noframes", "head"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the key closes when they are open without a wall between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "html", "nav", "aside", "main", "header", "footer", "form"}
#: Ancestors whose text is hardly ever main text.
NEVER = {"nav", "button", "footer", "aside", "menu", "dialog"}
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|side-?bar\w*|nav\w*|menu\w*|footer\w*|masthead|cookies?|consent|gdpr|popup\w*|modal\w*|"
    r"comments?|replies|reply|respond|disqus|share\w*|sharing|related|recommend\w*|breadcrumbs?|pagination|pager|newsletter|subscribe\w*|signup|login|widgets?|toolbar|skip\w*|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
WEAK_HINT = re.compile(r"(?:^|[\s_-])(?:header|notices?|alerts?|social|tags)(?=$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|post|story|entry|content|main|body|text)(?=$|[\s_-])", re.I)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Weights of the classifier: intercept, in article or main, good hint, bad hint, weak hint, hardly ever, in a form, link density, log length, sentence end, heading, table or list.
WEIGHTS = (-0.6, 3.0, 1.0, -9.0, -2.0, -12.0, -9.0, -3.5, 0.55, 0.5, 0.5, -0.2)
#: Smoothness between neighbours, its part for one more common ancestor, and that between the next ones in one parent.
ADJACENT, PROXIMITY, MOST_PROXIMITY, SIBLING = 0.35, 0.1, 0.6, 0.2


class Block:
    __slots__ = ("text", "path", "links", "feature")

    def __init__(self, text: str, path: tuple, links: int, feature: tuple):
        self.text, self.path, self.links, self.feature = text, path, links, feature


def _verdict(name: str, attributes: str, inside: tuple, number: int) -> tuple[bool, bool, bool, bool, bool, int]:
    """(in article, good, bad, weak, never, number of the form) of an element, given its parent's."""
    article, good, bad, weak, never, form = inside
    if name in ("article", "main"):
        article, form = True, 0
    elif name == "form":
        form = number
    never = never or name in NEVER or (name == "header" and not article)
    if attributes:
        for m in ATTR.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if HINT.search(value) and name not in ("body", "html", "article", "main"):
                    bad = True
                elif WEAK_HINT.search(value) and name not in ("body", "html", "article", "main"):
                    weak = True
                elif GOOD.search(value):
                    good = True
            elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                never = True
            elif key == "role" and value.lower() in ("main", "article"):
                article = True
    return article, good, bad, weak, never, form


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int]] = [("", (False, False, False, False, False, 0), 0)]  # name, verdict, number
    number, at, anchor = 0, 0, 0
    parts: list[str] = []
    linked = 0

    def flush(heading: str = "") -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                name = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "")
                out.append(Block(text, tuple(x[2] for x in stack), min(linked, len(text)), (*stack[-1][1], name)))
            parts.clear()
        linked = 0

    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if anchor:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        if m[1]:
            if name == "a":
                anchor = max(0, anchor - 1)
            elif name in BLOCK:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] in WALLS and name in ("p", "li", "dd", "dt"):
                        break
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if name == "head":
                    end = end or re.compile(r"<body\b", re.I).search(page, at)
                    at = (end.start() if end and end[0].lower().startswith("<body") else end.end()) if end else at
                else:
                    at = end.end() if end else len(page)
            if name not in ("svg", "math", "object"):
                flush() if name in ("textarea", "select", "iframe", "head", "title") else None
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            anchor = anchor + 1 if not anchor else anchor
        elif name in BLOCK or name == "button":
            flush()
            anchor = 0 if name in BLOCK and name != "p" else anchor
            if name == "hr":
                continue
            closes = CLOSES.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in closes:
                    del stack[i:]
                    if stack[-1][0] not in closes:
                        break
                elif stack[i][0] in WALLS:
                    break
            number += 1
            stack.append((name, _verdict(name, m[3], stack[-1][1], number), number))
        elif name == "img" or name in VOID:
            continue
    flush()
    size: dict[int, int] = {}
    for b in out:
        size[b.feature[5]] = size.get(b.feature[5], 0) + len(b.text)
    for b in out:
        form = b.feature[5]
        b.feature = (*b.feature[:5], bool(form) and 2 * size[form] <= sum(size.values()), b.feature[6])
    return out


def content_score(block: Block) -> float:
    """Log odds that a block is content."""
    article, good, bad, weak, never, form, name = block.feature
    n = len(block.text)
    x = (1, article, good, bad, weak, never, form, block.links / n, math.log1p(n / 20), block.text[-1] in ".!?…:;\"'»”", name in ("h1", "h2", "h3"), name in ("td", "th", "li"))
    return sum(w * v for w, v in zip(WEIGHTS, x, strict=True))


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least total cost. content[i]: the cost of calling i boilerplate; boilerplate[i]: that
    of calling it content; an edge costs its weight if its ends differ. Shortest augmenting paths; the source side is
    what the residual graph still reaches."""
    n = len(content)
    source, sink = n, n + 1
    graph: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, (a, b) in enumerate(zip(content, boilerplate, strict=True)):
        through = min(a, b)  # flows straight through
        if a > through:
            graph[source][i] = a - through
            graph[i][source] = 0.0
        if b > through:
            graph[i][sink] = b - through
            graph[sink][i] = 0.0
    for i, j, w in edges:
        graph[i][j] = graph[i].get(j, 0.0) + w
        graph[j][i] = graph[j].get(i, 0.0) + w
    while True:
        parent = {source: source}
        queue = deque((source,))
        while queue and sink not in parent:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 1e-12 and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if sink not in parent:
            return [i in parent for i in range(n)]
        path, v = [], sink
        while v != source:
            path.append((parent[v], v))
            v = parent[v]
        flow = min(graph[u][v] for u, v in path)
        for u, v in path:
            graph[u][v] -= flow
            graph[v][u] = graph[v].get(u, 0.0) + flow


def labels(found: list[Block]) -> list[bool]:
    """Content or not, block by block; runs of blocks under one parent with like verdicts are one node."""
    groups: list[list[int]] = []
    for i, b in enumerate(found):
        p = found[groups[-1][0]] if groups else None
        if p is not None and p.feature[:6] == b.feature[:6] and p.path[:-1] == b.path[:-1]:
            groups[-1].append(i)
        else:
            groups.append([i])
    scores = [sum(content_score(found[i]) for i in g) for g in groups]
    edges = []
    last: dict[tuple, int] = {}
    for i, g in enumerate(groups):
        if i:
            a, b = found[groups[i - 1][-1]], found[g[0]]
            common = 0
            for x, y in zip(a.path, b.path, strict=False):
                if x != y:
                    break
                common += 1
            edges.append((i - 1, i, ADJACENT + min(MOST_PROXIMITY, PROXIMITY * common)))
        parent = found[g[0]].path[:-1]
        if last.get(parent, i - 1) < i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    out = [False] * len(found)
    for g, good in zip(groups, minimum_cut([max(x, 0.0) for x in scores], [max(-x, 0.0) for x in scores], edges), strict=True):
        for i in g:
            out[i] = good
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
