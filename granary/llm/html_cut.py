"""Main text of web pages by minimum cut.

A page becomes blocks of text. A classifier gives each block evidence for content or boilerplate, from its words, links and
end, and from the elements and names around it; that is the capacity of its edge to the source or the sink. The article,
main and content elements are nodes of their own that hang on the source; a block is joined to the nearest one around it (DOM
proximity), and to its neighbours in the page, the closer the nearer they are in the tree. The blocks on the source's side of the
minimum cut are the article: so a short line or a link stays with its article, and a long advert doesn't.

The classifier is logistic, on a few binned features, and fitted to the corpus: blocks inside article and main elements are
examples of content, blocks inside menus, footers and the like of boilerplate. Its prior are the weights of PRIOR.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

#: Elements of HTML, by what they mean here.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td dd li figcaption".split())
#: Elements whose text isn't shown as text. Of the second kind one that is closed by its own slash, or not closed before the
#: page goes on with another part, hides nothing.
RAW, NO_TEXT = "script|style|noscript|template|textarea|title", "iframe|object|svg|canvas|select|button|audio|video|math"
BOILER_TAGS = frozenset("nav footer aside form menu dialog head fieldset search".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Parts of class and id names. Those of LAYOUT mean nothing inside an article or main element.
LAYOUT = frozenset("nav navbar navigation menu header masthead sidebar banner topbar toolbar breadcrumb breadcrumbs footer notice".split())
BOILER = LAYOUT | frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments disqus replies reply respond cookie "
    "cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations pagination pager widget rail copyright legal disclaimer alert skip tags paywall trending hidden".split()
)
#: Those of BOILER that count against an article, too: readers' comments, adverts, and teasers of other articles.
AGAINST = frozenset("comment comments disqus replies reply respond ad ads advert adverts advertisement sponsor sponsored promo promotion related recommended recommendations trending".split())
CONTENT = frozenset("article articles content post posts entry entries story stories main body text prose news".split())
#: Parts that say nothing. A name is boilerplate if its parts are BOILER and these; with others it is a hint only.
PLAIN = CONTENT | frozenset(
    "area bar block bottom box btn button buttons col column container cont group head icons inner item items left link links list "
    "container panel right row section site slot top unit wrap wrapper page global primary secondary sticky fixed the of and to".split()
)
#: Evidence of what stands around a block: inside boilerplate, inside an element with a hint of it, inside a page's header.
IN_BOILER, IN_HINT, IN_HEADER = -8.0, -2.0, -5.0
#: Most evidence of a block's own text, either way.
MOST = 2.5
#: Content elements, by kind: evidence of the element, and capacity between it and its blocks. Any block's own text weighs less
#: than the first capacity. A main element with an article inside counts as named; the body stands in if there is neither. An
#: article is never given up for its many short lines.
ROOTS = {"element": (1e6, 3.0), "named": (2.0, 1.2), "body": (1.0, 0.6)}
#: Capacity between neighbours, and what more if they are near in the tree and in the same parts of the page.
NEXT, KIN = 0.25, 0.5
#: Prior weights of the features: always; words up to 1, 3, 7, 15, 31, more; links none, less than half, more; ends as a sentence; heading;
#: begins like a copyright line.
PRIOR = (0.0, -1.5, -1.0, -0.5, 0.2, 1.0, 1.8, 0.3, -0.8, -2.5, 0.6, 0.5, -4.0)
_WORD_BINS = (1, 3, 7, 15, 31)
#: How firmly the prior stands: as the curvature that so many examples or so would have.
FIRM = 20.0

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>])[^>]*>(?:.*?</\1\s*>|(?<!/>).*)|"
    rf"<(?P<mute>{NO_TEXT})(?=[\s/>])[^>]*(?:(?<!/)>(?:(?!</?(?:article|main|section|p|h[1-6]|nav|header|footer|aside|body)[\s>]|<(?P=mute)[\s>]).)*?</(?P=mute)\s*>|>)|"
    r"""<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?][^>]*>""",
    re.S | re.I,
)
#: Name and value of an attribute: in quotes, bare, or without one.
_NAMES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?=;|$)", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


def named(attributes: str) -> tuple[str, bool]:
    """What an element's names say ("ad", "layout", "hint", "content" or nothing), and whether it is hidden."""
    kinds, seen = set(), set()
    for key, value in _NAMES.findall(attributes):
        key = key.lower()
        if key in seen:  # of an attribute that repeats, the first counts
            continue
        seen.add(key)
        value = unescape(value[1:-1] if value[:1] in ("'", '"') else value)
        if key == "hidden" or key == "style" and _UNSEEN.search(value) or key == "aria-hidden" and value.strip().lower() == "true":
            return "ad", True
        if key == "role":
            kinds |= {"ad" for x in value.lower().split() if x in BOILER_ROLES} | {"content" for x in value.lower().split() if x in CONTENT_TAGS}
        elif key in ("class", "id"):
            kinds |= {_kind_of(name) for name in value.split()}
    if "content" in kinds and kinds & {"ad", "layout"}:  # such as a post that has tags
        return "hint", False
    return next((k for k in ("ad", "layout", "content", "hint") if k in kinds), ""), False


def _kind_of(name: str) -> str:
    # hidden counts as a whole name: overflow-hidden and the like hide nothing
    parts = {p.lower() for p in _PART.findall(name) if p.lower() != "hidden" or name.lower() == "hidden"}
    boiler = parts & BOILER
    if not boiler:
        return "content" if parts & CONTENT else ""
    return "hint" if parts - BOILER - PLAIN else "layout" if boiler <= LAYOUT else "ad"


def against(attributes: str) -> bool:
    """Whether an article's names say that it is no part of the page's text."""
    names = [x for key, value in _NAMES.findall(attributes) if key.lower() in ("class", "id") for x in unescape(value.strip("\"'")).split()]
    return named(attributes)[0] == "ad" and any(_kind_of(x) == "ad" and {p.lower() for p in _PART.findall(x)} & AGAINST for x in names)


class Block:
    """text, words, linked (share of its letters in links), tag, parent and depth in the tree, root (number of the content element
    around it, 0 for none), boiler (inside boilerplate), around (evidence of what stands around it)."""

    __slots__ = ("text", "words", "linked", "tag", "parent", "depth", "root", "boiler", "around")


class _Open:
    """An element that is open: its tag and number, the content element around it, whether it is inside boilerplate by its nature
    or by a layout name, and how much hints of it weigh."""

    __slots__ = ("tag", "number", "root", "boiler", "layout", "hint")

    def __init__(self, tag: str, number: int, above: _Open | None):
        self.tag, self.number = tag, number
        self.root, self.boiler, self.layout, self.hint = (above.root, above.boiler, above.layout, above.hint) if above else (0, False, 0.0, 0.0)


def blocks_of(html: str) -> tuple[list[Block], dict[int, str]]:
    """Blocks with text, in page order, and the content elements' kinds by number. Unclosed and badly nested elements are closed as
    far as needed."""
    stack = [_Open("", 0, None)]
    out: list[Block] = []
    roots: dict[int, str] = {}
    articles: set[int] = set()
    written: set[int] = set()  # content elements that have text of their own besides headings
    text: list[str] = []
    linked = count = at = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            words = unescape("".join(text)).split()
            if words:
                b, top = Block(), stack[-1]
                b.text, b.words, b.tag, b.depth, b.root = " ".join(words), len(words), top.tag, len(stack), top.root
                b.parent = stack[-2].number if top.tag in TEXTUAL and len(stack) > 1 else top.number
                b.linked = min(1.0, linked / max(1, len(b.text)))
                b.boiler = top.boiler or top.layout <= IN_BOILER
                b.around = IN_BOILER * top.boiler + top.layout + max(IN_HINT, top.hint)
                out.append(b)
                if not b.boiler and b.tag not in _HEADINGS:
                    written.add(b.root)
            text.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m[0][:9].upper() == "<![CDATA[":
                text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
                opened = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), None)
                if opened:
                    del stack[opened:]
            elif tag == "a":
                in_link = False
        elif tag in BLOCK:
            flush()
            in_link = False
            if stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr")):
                stack.pop()
            if tag in ("body", "main", "article") and stack[-1].tag == "head":
                stack.pop()
            if tag in VOID:
                continue
            count += 1
            new = _Open(tag, count, stack[-1])
            kind, hidden = named(m["more"]) if m["more"] and tag not in ("html", "body") else ("", False)
            # an article inside another that has text, or with such a name, is a reader's comment, or leads to another page
            if tag == "article" and (new.root in articles and new.root in written or kind == "ad" and against(m["more"])):
                new.boiler = True
            elif tag in CONTENT_TAGS and not hidden:
                # what an article's own names say doesn't count against it
                if new.root and roots[new.root] == "element":
                    roots[new.root] = "named"
                roots[count], new.root, new.layout, new.hint = "element", count, 0.0, 0.0
                if tag == "article":
                    articles.add(count)
            elif tag in BOILER_TAGS or kind == "ad":
                new.boiler = True
            elif kind == "layout":
                new.layout += 0.0 if new.root and roots[new.root] == "element" else IN_BOILER
            elif tag == "header":
                new.layout += 0.0 if new.root else IN_HEADER
            elif kind == "hint":
                new.hint += IN_HINT
            elif kind == "content" and not (new.root and roots[new.root] == "element"):
                roots[count], new.root = "named", count
            stack.append(new)
        elif tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = True
    if at < len(html):
        text.append(html[at:])
    flush()
    for i, b in enumerate(out[:-1]):
        # a heading over nothing but boilerplate of its own article, such as the comments', goes with it
        if b.tag in _HEADINGS and b.tag != "h1" and b.root in written and not b.boiler and out[i + 1].boiler and out[i + 1].root == b.root:
            after = next((x for x in out[i + 1 :] if not x.boiler), None)
            if after is None or after.root != b.root or after.tag in _HEADINGS and after.tag <= b.tag:
                b.boiler, b.around = True, IN_BOILER
    return out, roots


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_ENDS = re.compile(r"[.!?…:;][\"'”’»)\]]*$")


def features(b: Block) -> tuple[int, ...]:
    """Numbers of the features that a block has."""
    words = sum(b.words > x for x in _WORD_BINS)
    links = 0 if not b.linked else 1 if b.linked < 0.5 else 2
    rest = (bool(_ENDS.search(b.text)), b.tag[:1] == "h" and b.tag[1:].isdigit(), bool(_RIGHTS.match(b.text)))
    return (0, 1 + words, 7 + links, *(10 + i for i, x in enumerate(rest) if x))


def evidence(b: Block, weights: Sequence[float]) -> float:
    return max(-MOST, min(MOST, sum(weights[i] for i in features(b)))) + b.around


def label(b: Block, roots: dict[int, str]) -> bool | None:
    """What the page's elements say of a block: content, boilerplate, or nothing."""
    return False if b.boiler else True if b.root and roots[b.root] == "element" and not b.around else None


def fitted(counts: Sequence[tuple[Sequence[int], int, int]]) -> list[float]:
    """Weights from (features, blocks, blocks of content): the maximum of the logistic likelihood and the prior, by Newton's steps."""
    prior = np.array(PRIOR)
    x = np.zeros((len(counts), len(PRIOR)))
    for i, (which, _, _) in enumerate(counts):
        x[i, list(which)] = 1
    n, yes = (np.array([c[k] for c in counts], float) for k in (1, 2))
    if not yes.sum() or yes.sum() == n.sum():
        return list(PRIOR)
    # both kinds weigh alike, whatever their numbers
    no, half = n - yes, n.sum() / 2
    yes, no = yes * half / yes.sum(), no * half / no.sum()
    scale = min(1.0, 2000 / n.sum())  # beyond that many examples only their shares count, not their number
    yes, no, w = yes * scale, no * scale, prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (yes - (yes + no) * p) - FIRM * (w - prior)
        step = np.linalg.solve(x.T @ (x * ((yes + no) * p * (1 - p))[:, None]) + FIRM * np.eye(len(w)), slope)
        w += step * min(1.0, 1.0 / np.abs(step).max()) if np.abs(step).max() > 0 else 0.0
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def minimum_cut(evidence: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut: node i hangs on the source with evidence[i] if that is
    positive, on the sink with -evidence[i] else; edges join nodes both ways. Shortest augmenting paths, from all nodes
    with flow left to give at once; the side is what they still reach in the end, so a tie goes to the sink's side."""
    n = len(evidence)
    give, take = [max(x, 0.0) for x in evidence], [max(-x, 0.0) for x in evidence]
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [w, w]
    while True:
        by = [-2] * n
        queue = deque(i for i in range(n) if give[i] > 1e-9)
        for i in queue:
            by[i] = -1
        end = -1
        while queue and end < 0:
            i = queue.popleft()
            for e in near[i]:
                j = to[e]
                if room[e] > 1e-9 and by[j] == -2:
                    by[j] = e
                    if take[j] > 1e-9:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [x != -2 for x in by]
        flow, i = take[end], end
        while by[i] >= 0:
            flow = min(flow, room[by[i]])
            i = to[by[i] ^ 1]
        flow = min(flow, give[i])
        give[i] -= flow
        take[end] -= flow
        i = end
        while by[i] >= 0:
            room[by[i]] -= flow
            room[by[i] ^ 1] += flow
            i = to[by[i] ^ 1]


def graph(blocks: list[Block], roots: dict[int, str], weights: Sequence[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Evidence of the nodes (blocks, then content elements) and the edges between them."""
    used = {b.root: "" for b in blocks}
    kinds = {r: roots[r] if r else "body" for r in used if r or not any(k == "element" for k in roots.values())}
    place = {r: len(blocks) + i for i, r in enumerate(kinds)}
    nodes, edges = [evidence(b, weights) for b in blocks] + [ROOTS[k][0] for k in kinds.values()], []
    for i, b in enumerate(blocks):
        if b.root in place and not b.boiler:
            edges.append((i, place[b.root], ROOTS[kinds[b.root]][1]))
        if i:
            a = blocks[i - 1]
            near = a.root == b.root and a.boiler == b.boiler
            apart = 0 if a.parent == b.parent else 1 + abs(a.depth - b.depth)
            edges.append((i - 1, i, NEXT + near * KIN / (1 + apart)))
    return nodes, edges


def main_text(html: str, weights: Sequence[float] = PRIOR) -> str:
    blocks, roots = blocks_of(html)
    side = minimum_cut(*graph(blocks, roots, weights))
    return " ".join(b.text for b, content in zip(blocks, side, strict=False) if content)


def fit(pages: DataFrame) -> list[float]:
    """Weights fitted to all blocks of pages that have a label. The blocks are counted by their features, of which there are a few
    hundred kinds whatever the pages; only the counts leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, ...], list[int]] = {}
        for batch in batches:
            for x in column(batch, "html"):
                blocks, roots = blocks_of(x.as_py() or "")
                for b in blocks:
                    content = label(b, roots)
                    if content is not None:
                        n = found.setdefault(features(b), [0, 0])
                        n[0] += 1
                        n[1] += content
        yield pa.RecordBatch.from_arrays(
            [pa.array([",".join(map(str, k)) for k in found], pa.string()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))], names=["features", "n", "content"]
        )

    counted = pages.select("html").mapInArrow(run, "features string, n long, content long")
    rows = counted.groupBy("features").agg(F.sum("n").alias("n"), F.sum("content").alias("content")).orderBy("features").collect()
    return fitted([([int(i) for i in r["features"].split(",")], r["n"], r["content"]) for r in rows])


def extract(pages: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """page_id, url, text (the article's text, empty if none) and n_chars (its code points) of every row of pages.

    weights: those of the classifier, or None to fit them to these pages. Null html is the empty page. Ids and urls pass
    through, null or repeated as they are; other columns don't. The whole html is read; a page is one row's work, so
    memory follows the longest page.
    """
    weights = fit(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in column(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)
    schema = f"page_id {kind['page_id']}, url string, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
