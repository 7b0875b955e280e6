"""Main text of web pages by wrapper induction.

Up to ``SAMPLE`` pages of each host, picked by hash, are parsed to trees and
aligned with the first of them by simple tree matching: the largest set of
matched node pairs that keeps parents and order; the roots must have the same
tag and class. The matching depends on labels only, so subtrees of equal shape
are one kind, a pair of kinds is worked out once, equal kinds at both ends of
two child lists are matched without a search (nothing could be better), and the
rest row by row as arrays: one exact matching for pages of any size and depth.
A node that is matched in most pages with the same text of its own is template;
a matched node whose text varies, or that most pages lack, is a slot. The
wrapper of a host is the path of the lowest block container that holds the slot
text outside furniture (menus, headers, footers, side bars, notices, adverts,
forms, comments, scripts) of every sampled page, and the texts of all blocks
that are template throughout. An ``article`` or ``main`` element with nearly
all slot text of every sampled page marks its content itself: nothing but
furniture is taken out of it.

An element is furniture by its tag, by a whole class name or role
(``FURNITURE_NAMES``), by a class or id that speaks of comments, or if it is
hidden; by another id only if it is a container whose content is the same on
most sampled pages of its host. A header or footer inside an ``article`` or
``main`` belongs to it unless it holds a menu. ``body``, ``article`` and
``main`` never are furniture.

Where the path ends at such an element, its nodes are a page's main text.
Elsewhere that is every block outside furniture, on the path or beside it, but
for the template blocks (same text in a container of the same label); template
blocks between slots of the path's container stay, for they are its headings.
A page that lacks the path, or a host whose sample shows fewer than two
different pages, falls back to the outermost ``article`` or ``main`` elements
or the body. Blocks are read in page order.

Hosts' samples are chosen by per-host minima of several hashes, a partial
aggregate, so that a host with a third of all pages is no hot spot; wrappers
are sent to all tasks while they are small (``SENT_BYTES``) and joined by host
and salt beyond.

Defined cases: null and empty html give the empty text; null urls are one
host; unclosed and stray tags are repaired as browsers do for the common
cases; repeated rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import cut, slices

SAMPLE = 5
SENT_HOSTS = 50_000
SENT_BYTES = 64 << 20
SALTS = 16
#: Slot text of a page that an article or main must hold, and matched pages that make a node template.
HOLDS, MOST = 0.9, 0.75
#: Cells of one child lists' table; larger ones are split in two again and again, with the same outcome.
TABLE_CELLS = 4_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<svg\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl article body html".split())
FURNITURE = frozenset("nav header footer aside form head title menu button select dialog".split())
#: Whole names of classes and roles (and of ids, see ``induce``), lower case.
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus "
    "footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo related replies search share sharing sidebar sidenav "
    "signup social sponsored subscribe toc toolbar widget complementary contentinfo".split()
)
#: Parts of a class or id that speak of readers' comments, and parts that say something else about them.
COMMENT_PARTS = frozenset("comment comments commentlist commentlists usercomments disqus respond".split())
NOT_ITSELF = frozenset("has no with without show hide allow open closed".split())
#: Where a wrapper's path may lead; never a paragraph, a heading or an inline element.
CONTAINERS = frozenset("article aside blockquote body center dd details div dl dt fieldset figure footer form header li main menu nav ol section table tbody td th tr ul".split())
#: Never furniture, whatever their class, id or role.
CONTENT = frozenset("html body article main".split())
MAIN = ("article", "main")


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    furniture: bool
    items: list = field(default_factory=list)  # nodes and strings in page order
    ident: str = ""  # a container's id, if it is the name of a kind of furniture
    kind: int = -1  # equal for subtrees of equal labels, see Kinds

    def nodes(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    def own_text(self) -> str:
        return squeeze(" ".join(x for x in self.items if isinstance(x, str)))


def squeeze(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def parse(page: str) -> Node:
    """The tree of a page; scripts, styles and the like are left out."""
    root = Node("html", "html", False)
    stack = [root]
    for m in TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if m["raw"] is None and (piece[0] != "<" or piece == "<"):
                stack[-1].items.append(piece)
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in BLOCK:
                    break
            continue
        if tag in ("html", "body", "head"):
            if tag == "html":
                continue
            if tag == "body":
                del stack[1:]
        if tag in BLOCK:
            _close(stack, ("p",))
        if tag in ENDS_ITSELF:
            _close(stack, ENDS_ITSELF[tag])
        rest = m["rest"]
        node = _node(tag, rest)
        if tag in ("header", "footer", "nav", "menu") and not (tag in ("header", "footer") and node.label != tag and _named_furniture(rest)):
            _inside(tag, node, stack)
        stack[-1].items.append(node)
        if tag not in VOID and not rest.endswith("/"):
            stack.append(node)
    return root


def _named_furniture(rest: str) -> bool:
    return _node("div", rest).furniture


def _inside(tag: str, node: Node, stack: list[Node]) -> None:
    """A header or footer of an article is part of it; a menu makes the header or footer around it furniture."""
    for x in reversed(stack):
        if tag in ("nav", "menu"):
            if x.tag in ("header", "footer"):
                x.furniture = True
                return
        elif x.tag in MAIN:
            node.furniture = False
            return
        if x.tag in CONTENT:
            return


def _node(tag: str, rest: str) -> Node:
    """An element by its tag and the text of its attributes."""
    furniture = tag in FURNITURE
    if not rest or rest == "/":
        return Node(tag, tag, furniture)
    named, ident, hidden, comments = [], "", False, False
    names: set[str] = set()
    for name, value in ATTRIBUTE.findall(rest):
        name = name.lower()
        if name in ("class", "id", "role"):
            value = value.strip("\"'")
            named.append(value)
            if name == "id":
                ident = value
            else:
                names.update(value.lower().split())
            comments = comments or (name != "role" and _about_comments(value.lower()))
        elif name == "hidden" or (name == "style" and HIDDEN_STYLE.search(value)):
            hidden = True
    if tag in CONTENT:
        furniture = False
    else:
        furniture = furniture or hidden or not names.isdisjoint(FURNITURE_NAMES) or (comments and tag in CONTAINERS)
    ident = ident if tag in CONTAINERS and tag not in CONTENT and ident.lower() in FURNITURE_NAMES else ""
    return Node(tag, f"{tag}.{' '.join(named)}" if named else tag, furniture, ident=ident)


def _about_comments(value: str) -> bool:
    """Whether one of the names is that of comments: its parts, between hyphens and the like, say so and nothing against."""
    for name in value.split():
        parts = set(re.split(r"[-_:.]+", name))
        if parts & COMMENT_PARTS and not parts & NOT_ITSELF:
            return True
    return False


def _close(stack: list[Node], tags: tuple[str, ...]) -> None:
    """End the nearest open element of these tags, unless a container stands between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in SCOPE or (stack[i].tag in BLOCK and "p" in tags):
            return


def _all(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(x.nodes())


class Kinds:
    """Kinds of subtrees by their labels, and how well two kinds match."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.label: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def mark(self, tree: Node) -> None:
        for x in reversed(list(_all(tree))):
            below = tuple(n.kind for n in x.nodes())
            x.kind = self.known.setdefault((x.label, below), len(self.label))
            if x.kind == len(self.label):
                self.label.append(x.label)
                self.below.append(below)
                self.size.append(1 + sum(self.size[k] for k in below))

    def score(self, a: int, b: int) -> int:
        """Simple tree matching: the number of node pairs in the largest ordered matching of two trees."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.scores:
                todo.pop()
            elif x == y:
                self.scores[x, y] = self.size[x]
            elif self.label[x] != self.label[y]:
                self.scores[x, y] = 0
            else:
                head, left, right, tail = self._trimmed(self.below[x], self.below[y])
                open_ = [(i, j) for i in set(left) for j in set(right) if (i, j) not in self.scores]
                if open_:
                    todo += open_
                    continue
                same = sum(self.size[k] for k in self.below[x][:head]) + sum(self.size[k] for k in self.below[x][len(self.below[x]) - tail :])
                self.scores[x, y] = 1 + same + (int(self._last_row(left, right)[-1]) if left and right else 0)
        return self.scores[a, b]

    @staticmethod
    def _trimmed(left: tuple, right: tuple) -> tuple[int, tuple, tuple, int]:
        """Lists without the equal kinds at their ends, whose number comes with them."""
        most = min(len(left), len(right))
        head = next((i for i in range(most) if left[i] != right[i]), most)
        tail = next((i for i in range(most - head) if left[-1 - i] != right[-1 - i]), most - head)
        return head, left[head : len(left) - tail], right[head : len(right) - tail], tail

    def _weights(self, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the distinct kinds of both lists, and where each item stands among them."""
        a, b = list(dict.fromkeys(left)), list(dict.fromkeys(right))
        table = np.array([[self.scores[x, y] for y in b] for x in a], np.int64)
        at_a, at_b = ({k: i for i, k in enumerate(v)} for v in (a, b))
        return table, np.array([at_a[k] for k in left]), np.array([at_b[k] for k in right])

    def _rows(self, left: tuple, right: tuple) -> Iterator[np.ndarray]:
        """Best sums of the first items of ``left`` with the first 0, 1, 2, ... of ``right``."""
        table, i, j = self._weights(left, right)
        row = np.zeros(len(right) + 1, np.int64)
        yield row
        for x in i:
            row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + table[x][j]))])
            yield row

    def _last_row(self, left: tuple, right: tuple) -> np.ndarray:
        row = np.zeros(len(right) + 1, np.int64)
        for row in self._rows(left, right):  # noqa: B007
            pass
        return row

    def aligned(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of the children that are matched with each other, in order."""
        head, left, right, tail = self._trimmed(self.below[a], self.below[b])
        found = [(i, i) for i in range(head)]
        todo = [(0, left, 0, right)] if left and right else []
        while todo:
            i, x, j, y = todo.pop()
            for u in set(x):
                for v in set(y):
                    self.score(u, v)
            if len(x) > 1 and len(x) * len(y) > TABLE_CELLS:
                half = len(x) // 2
                down, up = self._last_row(x[:half], y), self._last_row(x[half:][::-1], y[::-1])[::-1]
                k = int(np.argmax(down + up))
                todo += [(i + half, x[half:], j + k, y[k:]), (i, x[:half], j, y[:k])]
                continue
            found += [(head + i + u, head + j + v) for u, v in self._walked_back(x, y)] if y else []
        n, m = len(self.below[a]), len(self.below[b])
        return found + [(n - k, m - k) for k in range(tail, 0, -1)]

    def _walked_back(self, left: tuple, right: tuple) -> list[tuple[int, int]]:
        table = np.stack(list(self._rows(left, right)))
        i, j, out = len(left), len(right), []
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]


def pairs(a: Node, b: Node, kinds: Kinds) -> Iterator[tuple[Node, Node]]:
    """The matched pairs of two marked trees."""
    todo = [(a, b)] if kinds.score(a.kind, b.kind) else []
    while todo:
        x, y = todo.pop()
        yield x, y
        left, right = x.nodes(), y.nodes()
        todo += [(left[i], right[j]) for i, j in kinds.aligned(x.kind, y.kind)]


def induce(pages: list[str]) -> dict:
    """The wrapper of a host: ``path`` to its content node, the template ``texts`` by container and constant ``ids``."""
    pages = sorted(set(pages))
    trees = [parse(p) for p in pages]
    if len(trees) < 2:
        return {}
    first, seen, same, met, kinds = trees[0], {}, {}, [], Kinds()
    for tree in trees:
        kinds.mark(tree)
    for other in trees[1:]:
        met.append(list(pairs(first, other, kinds)))
        for a, b in met[-1]:
            seen[id(a)] = seen.get(id(a), 0) + 1
            same[id(a)] = same.get(id(a), 0) + (a.own_text() == b.own_text())
    most = MOST * len(met)
    fixed = lambda n: seen.get(id(n), 0) >= most and same.get(id(n), 0) >= most
    constant: dict[int, bool] = {}
    for n in reversed(list(_all(first))):
        constant[id(n)] = fixed(n) and all(constant[id(x)] for x in n.nodes())
    ids = sorted({n.ident for n in _all(first) if n.ident and constant[id(n)]})
    template = {id(n) for n in _all(first) if fixed(n)}
    template |= {id(b) for found in met for a, b in found if id(a) in template and a.own_text() == b.own_text()}

    held: dict[int, int] = {}
    for tree in trees:
        for n in reversed(list(_all(tree))):  # letters of slot text in and below a node
            own = 0 if id(n) in template else len(n.own_text())
            held[id(n)] = 0 if n.furniture or (n.ident and n.ident in ids) else own + sum(held[id(x)] for x in n.nodes())
    totals = [held[id(t)] for t in trees]
    if not any(totals):
        return {}
    path, here = [first.label], [[t] for t in trees]
    while path[-1].split(".")[0] not in MAIN:
        down = {x.label: x.tag for nodes in here for n in nodes for x in n.nodes() if x.tag in CONTAINERS and held.get(id(x))}
        for label, tag in down.items():
            below = [[x for n in nodes for x in n.nodes() if x.label == label] for nodes in here]
            share = HOLDS if tag in MAIN else 1
            if all(sum(held.get(id(x), 0) for x in nodes) >= share * total for nodes, total in zip(below, totals, strict=True)):
                path.append(label)
                here = below
                break
        else:
            break
    texts = []
    if path[-1].split(".")[0] not in MAIN:
        texts = sorted({(label, text) for label, text, parts in runs(first) if all(id(n) in template for n in parts)})
    return {"path": path, "texts": texts, "ids": ids}


def _at(node: Node, path: list[str]) -> list[Node]:
    found = [node] if node.label == path[0] else []
    for label in path[1:]:
        found = [x for n in found for x in n.nodes() if x.label == label]
    return found


def _outermost(node: Node, tags: tuple[str, ...]) -> list[Node]:
    """The elements of these tags that stand in no other of them, nor in furniture."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.tag in tags and not x.furniture:
            out.append(x)
        elif not x.furniture:
            todo.extend(reversed(x.nodes()))
    return out


def runs(node: Node, ids: frozenset[str] = frozenset()) -> list[tuple[str, str, list[Node]]]:
    """Blocks in page order: label of the container, text, and the nodes that the text is from.

    Inline elements belong to the block around them; ``ids`` are left out.
    """
    out: list[tuple[str, str, list[Node]]] = []
    held: list[str] = []
    parts: list[Node] = []

    def flush(block: Node) -> None:
        text = squeeze("".join(held))
        if text:
            out.append((block.label, text, list(parts)))
        held.clear()
        parts.clear()

    todo = [(node, node, iter(node.items))]
    while todo:
        x, block, items = todo[-1]
        for item in items:
            if isinstance(item, str):
                held.append(item)
                if not item.isspace():
                    parts.append(x)
            elif item.furniture or (item.ident and item.ident in ids):
                flush(block)
            elif item.tag in BLOCK:
                flush(block)
                todo.append((item, item, iter(item.items)))
                break
            else:
                if item.tag == "br":
                    held.append(" ")
                todo.append((item, block, iter(item.items)))
                break
        else:
            todo.pop()
            if x is block:
                flush(x)
    return out


def blocks(node: Node, template: frozenset[tuple[str, str]], ids: frozenset[str], inside: list[Node]) -> list[str]:
    """Texts of the node's blocks but for the template ones, which stay between the first and the last slot of ``inside``."""
    found = runs(node, ids)
    within = {id(x) for n in inside for x in _all(n)}
    slots = [i for i, (label, text, parts) in enumerate(found) if (label, text) not in template and parts and id(parts[0]) in within]
    first, last = (slots[0], slots[-1]) if slots else (0, -1)
    return [text for i, (label, text, parts) in enumerate(found) if (label, text) not in template or (first < i < last and parts and id(parts[0]) in within)]


def extract(page: str | None, wrapper: dict) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tree = parse(page)
    template, ids = frozenset((a, b) for a, b in wrapper.get("texts", ())), frozenset(wrapper.get("ids", ()))
    path = wrapper.get("path", [])
    held = _at(tree, path) if path else []
    found, inside = held, []
    if found and path[-1].split(".")[0] not in MAIN:
        found, inside = [tree], held  # what stands beside the path and is no template is text as well
    if not found:
        found = _outermost(tree, MAIN)
        template = template if not found else frozenset()
        found = found or [tree]
    return "\n".join(b for node in found for b in blocks(node, template, ids, inside))


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, wrapper as JSON) for every host."""
    rows = pages.select(host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.xxhash64("html"))
    least = [F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("h"), F.col("key"))).getField("key").alias(f"k{i}") for i in range(sample)]
    picked = rows.select("host", "key").groupBy("host").agg(*least)
    picked = cut(picked.select("host", F.explode(F.array_distinct(F.array(*[f"k{i}" for i in range(sample)]))).alias("key")))
    if picked.count() <= SENT_HOSTS * sample:
        picked = F.broadcast(picked)
    chosen = rows.join(picked, ["host", "key"]).groupBy("host", "key").agg(F.first("html").alias("html"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iat[0]], "wrapper": [json.dumps(induce(list(pdf["html"])), ensure_ascii=False)]})

    return chosen.groupBy("host").applyInPandas(learn, "host string, wrapper string")


def main_texts(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = cut(wrappers(pages, sample))
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    if (known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= SENT_BYTES:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")
        spread = known.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = rows.withColumn("salt", salt).join(spread, ["host", "salt"], "left").drop("salt")
    joined = joined.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce("wrapper", F.lit("{}")).alias("wrapper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for piece in slices(batches, "html"):
            texts = []
            for page, w in zip(piece.column("html").to_pylist(), piece.column("wrapper").to_pylist(), strict=True):
                if w not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    parsed[w] = json.loads(w)
                texts.append(extract(page, parsed[w]))
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
