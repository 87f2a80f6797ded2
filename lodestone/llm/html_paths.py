"""HTML main-content extraction by consensus of a host's pages.

1. Each page's containers are scored: text of paragraphs counts for the container that holds them and half for the one
   around it, by length and commas, less what lies in links; names such as nav, ad, footer or article weigh too.
2. A container's path is generalised: tags with their classes from the root on, digits in classes and repeated classes gone,
   so pages of one template share paths. In Spark each page votes for its best container's path, by host; the path of
   most votes wins (ties: the higher summed score, then the lesser path). A host of one page has its own vote alone.
3. Each page is read again with the path that won on its host. Where it has no container of that path with text, its own
   best one serves, and ``used`` says so.

Pages are parsed where they are read, once to vote and once to extract; only votes are shuffled. Winners, a row per host,
are broadcast if they are small by count, else joined by host, whose pages may then be many for one host: that join is left
to adaptive skew handling.

A page is read in one pass: a start tag costs no walk up the tree, an end tag only closes what it ends, and paths are compared on
the way down, so time grows with the length of a page whatever it holds.

Edge cases: a null or empty page gives a row with a null text; a page without containers gives its whole text as path
"page"; a null URL or one without a host is host ""; unclosed and crossed tags are mended as browsers do for paragraphs
and lists; a tag without an end is text, and once a quoted attribute has no end, tags from there on end at the first >; scripts,
styles and comments are no text, to the end of the page if they have no end; several containers of the winning path are joined in page order;
pages that repeat vote each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import per_slice, small_enough, written

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_TO_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_SKIPPED = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "noscript", "template", "svg", "textarea")}
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("article body div main section td form center".split())
_BLOCK = _CONTAINER | frozenset("address aside blockquote dd details dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li nav ol p pre table tbody thead tfoot tr th ul".split())
_PARAGRAPH = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt".split())
_INLINE = frozenset("b i em strong span font u small big s tt code".split())
_NO_TEXT = frozenset(("head", "title"))
_OUTSIDE = frozenset(("nav", "footer", "header", "aside"))
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"\bads?\b|banner|combx|comment|footer|foot|header|menu|meta|nav|related|remark|rss|share|sidebar|sponsor|promo|pager|popup|cookie", re.I)
_DIGITS = re.compile(r"\d+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


@dataclass(eq=False)
class Node:
    tag: str
    classes: str
    parent: Node | None
    parts: list[str | Node] = field(default_factory=list)
    score: float = 0.0
    #: The nearest that isn't an inline element, itself or above; and the container that counts text in it, if any.
    block: Node | None = None
    container: Node | None = None

    def __post_init__(self) -> None:
        above = self.parent
        self.block = self if self.tag not in _INLINE or above is None else above.block
        self.container = self if self.tag in _CONTAINER else None if self.tag in _OUTSIDE or above is None else above.container

    def name(self) -> str:
        return self.tag + "".join(f".{c}" for c in self.classes.split())

    def path(self) -> str:
        names, node = [], self
        while node is not None and node.parent is not None:
            names.append(node.name())
            node = node.parent
        return "/".join(reversed(names))


def _general(attributes: str) -> str:
    m = _CLASS.search(attributes) if "class" in attributes or "CLASS" in attributes else None
    if not m:
        return ""
    names = (_DIGITS.sub("", c).strip("-_") for c in (m[1] or m[2] or m[3] or "").split())
    return " ".join(sorted({c for c in names if c}))


def _tokens(page: str):  # noqa: ANN202
    """(start, end, name, attributes, whether it is an end tag) of each tag, comment or skipped element; name is "" of the latter two."""
    at, quotes, close = 0, True, -1
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", "", False
            at = end
            continue
        other, closing = page[at + 1 : at + 2] in ("!", "?"), page[at + 1 : at + 2] == "/"
        m = None if other else _NAME.match(page, at + 1 + closing)
        if not other and not m:
            at += 1
            continue
        if close < at:  # the next > from here on
            close = page.find(">", at)
        if close < 0:
            return
        end, begins = close + 1, m.end() if m else at + 2
        if m and quotes:
            full = _TO_END.match(page, begins)
            quotes = full is not None
            end = full.end() if full else end
        name = m[0].lower() if m else ""
        if name in _SKIPPED and not closing:
            stop = _SKIPPED[name].search(page, end)
            end = stop.end() if stop else len(page)
            yield at, end, "", "", False
        else:
            yield at, end, name, page[begins : end - 1], closing
        at = end


def parse(page: str) -> Node:
    root = Node("", "", None)
    node, at = root, 0
    open_: dict[str, int] = {}  # how many of each tag are open
    for start, end, tag, attributes, closing in _tokens(page):
        if start > at:
            node.parts.append(page[at:start])
        at = end
        if not tag:
            continue
        upto = None  # what ends here
        if closing:
            if open_.get(tag):
                upto = node
                while upto.tag != tag:
                    upto = upto.parent
        elif tag in _BLOCK:
            up = node.block
            if up.tag == "p" or (tag == up.tag and tag in ("li", "dd", "dt", "td", "th", "tr")):
                upto = up  # a block ends an open paragraph, an item the one before
        while upto is not None and node is not upto.parent:
            open_[node.tag] -= 1
            node = node.parent
        if closing:
            continue
        child = Node(tag, _general(attributes) if tag in _BLOCK else "", node)
        node.parts.append(child)
        if tag not in _VOID and not attributes.endswith("/"):
            node = child
            open_[tag] = open_.get(tag, 0) + 1
    if at < len(page):
        node.parts.append(page[at:])
    return root


def _walk(root: Node):  # noqa: ANN202
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [p for p in reversed(node.parts) if not isinstance(p, str)]


def text_of(root: Node) -> str:
    """Text as read: a line for each block, white space single within."""
    out: list[str] = []
    stack: list[str | Node] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x if x == "\n" else " ".join(("." + html.unescape(x) + ".").split())[1:-1] if not x.isspace() else " ")
            continue
        if x.tag in _NO_TEXT:
            continue
        block = x.tag in _BLOCK or x.tag == "br"
        if block:
            stack.append("\n")
        stack += reversed(x.parts)
        if block:
            stack.append("\n")
    return "\n".join(line for raw in "".join(out).split("\n") if (line := " ".join(raw.split())))


def _sizes(root: Node) -> dict[Node, tuple[int, int, int]]:
    """Characters, those in links, and commas, of each element with all in it."""
    out: dict[Node, tuple[int, int, int]] = {}
    for node in reversed(list(_walk(root))):
        n = linked = commas = 0
        if node.tag not in _NO_TEXT:
            for p in node.parts:
                if isinstance(p, str):
                    n += len(p.strip())
                    commas += p.count(",")
                else:
                    a, b, c = out[p]
                    n, linked, commas = n + a, linked + b, commas + c
        out[node] = (n, n if node.tag == "a" else linked, commas)
    return out


def containers(root: Node) -> list[Node]:
    """The containers that have a score, in page order."""
    size = _sizes(root)
    found: dict[Node, float] = {}
    for node in _walk(root):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if node.tag in _PARAGRAPH:
            n, linked, commas = size[node]
        elif node.tag in _CONTAINER and own:
            n, linked, commas = own, 0, sum(p.count(",") for p in node.parts if isinstance(p, str))
        else:
            continue
        if not n:
            continue
        points = (n / 100 + commas) * (1 - linked / n)
        up, share = (node if node.tag in _CONTAINER else node.parent).container, 1.0
        while up is not None and share > 0.1:
            found[up] = found.get(up, 0.0) + points * share
            share /= 2
            up = up.parent.container
    out = []
    for node in _walk(root):
        if node in found:
            n, linked, _ = size[node]
            name = f"{node.tag} {node.classes}"
            weight = 1.25 if _GOOD.search(name) else 1.0
            if _BAD.search(name):
                weight *= 0.2
            node.score = found[node] * weight * (1 - linked / n if n else 1)
            if node.score > 0:
                out.append(node)
    return out


def best(page: str) -> tuple[str, float] | None:
    found = containers(parse(page))
    if not found:
        return None
    top = max(found, key=lambda x: x.score)
    return top.path(), top.score


def _outermost(root: Node, path: str) -> list[Node]:
    """The containers of that path, in page order, but those within another."""
    hits, stack = [], [(root, 0)]  # nodes whose own path is the first so many characters
    while stack:
        node, upto = stack.pop()
        if upto > len(path):
            if node.tag in _CONTAINER:
                hits.append(node)
            continue
        for child in reversed(node.parts):
            if not isinstance(child, str) and path.startswith(name := child.name(), upto):
                end = upto + len(name)
                if end == len(path) or path[end] == "/":
                    stack.append((child, end + 1))
    return hits


def extract(page: str, path: str | None) -> tuple[str, str, str]:
    """(path, used, text): by the given path, else by the page's own best container, else all text."""
    root = parse(page)
    if path is not None:
        hits = _outermost(root, path)
        text = "\n".join(t for t in map(text_of, hits) if t)
        if text:
            return path, "consensus", text
    found = containers(root)
    if found:
        top = max(found, key=lambda x: x.score)
        return top.path(), "own", text_of(top)
    return "page", "page", text_of(root)


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score: the vote of each page that has a container."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [best(p) if p else None for p in batch.column("html").to_pylist()]
        keep = [i for i, x in enumerate(found) if x]
        if not keep:
            return None
        return pa.RecordBatch.from_pydict({"host": batch.column("host").take(pa.array(keep)), "path": [found[i][0] for i in keep], "score": [found[i][1] for i in keep]})

    return _with_host(pages).select("host", "html").mapInArrow(per_slice(run, "html"), "host string, path string, score double")


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "html", F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))).alias("host"))


def winners(pages: DataFrame) -> DataFrame:
    """host, path, n_votes, n_pages: a row for each host."""
    counted = votes(pages).groupBy("host", "path").agg(F.count("*").alias("n_votes"), F.sum(F.round("score", 3).cast("decimal(28,3)")).alias("score"))
    by_host = Window.partitionBy("host")
    place = F.row_number().over(by_host.orderBy(F.desc("n_votes"), F.desc("score"), "path"))
    return counted.select("host", "path", "n_votes", F.sum("n_votes").over(by_host).alias("n_pages"), place.alias("place")).where("place = 1").drop("place", "score")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, host, path, used (consensus, own or page), n_votes, n_pages of the host, text: one row for each page."""
    won = written(winners(pages), "host-paths")
    side = F.broadcast(won) if small_enough(won, 300) else won
    joined = _with_host(pages).join(side, "host", "left").select("page_id", "host", "html", "path", "n_votes", "n_pages")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(None, None, None) if not p else extract(p, path) for p, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        path, used, text = zip(*rows)
        cols = {c: batch.column(c) for c in ("page_id", "host")}
        cols |= {"path": pa.array(path, pa.string()), "used": pa.array(used, pa.string())}
        cols |= {c: batch.column(c) for c in ("n_votes", "n_pages")}
        return pa.RecordBatch.from_pydict(cols | {"text": pa.array(text, pa.string())})

    return joined.mapInArrow(per_slice(run, "html"), "page_id long, host string, path string, used string, n_votes long, n_pages long, text string")
