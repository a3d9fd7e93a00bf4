"""Main text of web pages by wrapper induction.

A page is parsed, forgivingly, into a tree of elements; siblings of one kind (tag, class, id, role) share a node, as
the items of a list do. For each host, up to `sample` pages are drawn by a hash of their id. Their trees are aligned
one after the other by simple tree matching and merged into the host's wrapper. Blocks whose text is the same on
all sampled pages are template; blocks with varying text are slots. The article's slots are those under
the element that says it is the article (or else the smallest element with most of the varying text), without
those whose kind says that they are something else. Every page of the host is then aligned with the wrapper and
gives the text of its article nodes; nodes that the wrapper does not know follow the node they stand in.
A layout of the host may be absent from its sample. A page of which the wrapper takes nothing, or less than it holds in
nodes that the wrapper has never seen, gives its own article, too, found on the page alone; what the wrapper knows as
template stays out.

The sample of a host is cut by a rank that each task bounds before its shuffle; wrappers reach pages through
a salted lookup, so a host with a third of all pages is split over all partitions.

Defined results: null and empty pages give an empty text. Pages without a host share one wrapper. Repeated rows get
equal results. An empty table gives no rows. Elements more than `DEEPEST` levels down count as their ancestor there;
their text is kept.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import attach
from quotemill.session import ship_package

DEEPEST = 100
#: Pages of a host, with different texts, that must agree before a text counts as template.
AGREE = 4

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math title select option button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an element's start tag ends, if open, up to an element that encloses.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "body": ("head", ()),
}
NOISE_TAGS = frozenset("nav footer aside form head header dialog menu".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice popup modal overlay alert comment comments reply "
    "replies disqus share sharing social related recommended newsletter subscribe subscription signup login search form pagination pager "
    "toolbar widget copyright legal skip hidden".split()
)
ARTICLE_WORDS = frozenset("article main content post entry story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+|[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.IGNORECASE)


class Node:
    """An element, or siblings of one kind together."""

    __slots__ = ("kind", "tag", "children", "order", "keep", "fixed")

    def __init__(self, kind: str, tag: str):
        self.kind, self.tag = kind, tag
        self.children: dict[str, Node] = {}
        self.keep = self.fixed = False

    def child(self, kind: str, tag: str) -> Node:
        node = self.children.get(kind)
        if node is None:
            node = self.children[kind] = Node(kind, tag)
        return node

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children.values():
            yield from c.walk()

    def shape(self) -> str:
        inner = "".join(c.shape() for c in self.children.values())
        return f"{self.kind}({inner})"


def kind_of(tag: str, rest: str) -> str:
    """An element's kind: its tag and what its class, id and role say, numbers left out."""
    if "=" not in rest and "hidden" not in rest:
        return tag
    said = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(rest)).lower()
    names = sorted(set(re.findall(r"[a-z]+", said)))
    if _HIDDEN.search(re.sub(r"(?:href|src|content|alt|title)\s*=\s*(?:\"[^\"]*\"|'[^']*')", "", rest)):
        names.append("hidden")
    return f"{tag}.{'.'.join(names)}" if names else tag


def is_noise(node: Node) -> bool:
    return node.tag in NOISE_TAGS or any(w in NOISE_WORDS for w in node.kind.split(".")[1:])


def parse(page: str) -> tuple[Node, list[list[tuple[Node, str]]]]:
    """The tree of a page, and its blocks in order, each a list of (element, text)."""
    root = Node("html", "html")
    stack: list[tuple[str, Node]] = [("html", root)]
    blocks: list[list[tuple[Node, str]]] = [[]]

    def text(part: str) -> None:
        if part:
            blocks[-1].append((stack[min(len(stack), DEEPEST) - 1][1], entities.unescape(part)))

    def brk() -> None:
        if blocks[-1]:
            blocks.append([])

    def close(tags: tuple[str, ...], inside: tuple[str, ...]) -> None:
        """End the innermost of `tags` that is open within `inside`, with all that it holds."""
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in tags:
                del stack[at:]
                return
            if stack[at][0] in inside:
                return

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in BLOCKS:
                brk()
            if any(t == tag for t, _ in stack[1:]):
                close((tag,), ("article",) if tag not in BLOCKS else ())
            continue
        if tag in RAW and not m["rest"].endswith("/"):
            done = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = done.end() if done else len(page)
            continue
        if tag == "br" or tag == "hr" or tag in VOID:
            if tag == "hr":
                brk()
            elif tag == "br":
                text(" ")
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            brk()
            close(("p",), ("article", "section", "div", "td", "li", "body", "blockquote"))
        if tag in ENDS:
            ended, inside = ENDS[tag]
            for t in ended.split():
                close((t,), inside)
        if not m["rest"].endswith("/"):
            parent = stack[min(len(stack), DEEPEST) - 1][1]
            stack.append((tag, parent if len(stack) >= DEEPEST else parent.child(kind_of(tag, m["rest"]), tag)))
    return root, [b for b in blocks if b]


def match(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the size of the largest match of two trees that keeps levels and order."""
    if a.kind != b.kind:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = _table(list(a.children.values()), list(b.children.values()), memo)[-1][-1] + 1
    return memo[key]


def _table(left: list[Node], right: list[Node], memo: dict[tuple[int, int], int]) -> list[list[int]]:
    m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x, y, memo))
    return m


def align(a: Node, b: Node, memo: dict[tuple[int, int], int], out: dict[int, Node]) -> dict[int, Node]:
    """id of each node of `a` to the node of `b` that it matches."""
    if a.kind != b.kind:
        return out
    out[id(a)] = b
    left, right = list(a.children.values()), list(b.children.values())
    m = _table(left, right, memo)
    i, j = len(left), len(right)
    while i and j:
        got = match(left[i - 1], right[j - 1], memo)
        if got and m[i][j] == m[i - 1][j - 1] + got:
            align(left[i - 1], right[j - 1], memo, out)
            i, j = i - 1, j - 1
        elif m[i][j] == m[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def text_of(blocks: list[list[tuple[Node, str]]]) -> dict[int, list[str]]:
    """Words by element."""
    out: dict[int, list[str]] = {}
    for block in blocks:
        for node, part in block:
            if words := part.split():
                out.setdefault(id(node), []).extend(words)
    return out


def induce(pages: list[str]) -> Node:
    """The wrapper of a host, from some of its pages: a tree whose nodes say whether their text is the article's."""
    wrapper = Node("html", "html")
    texts: dict[int, list[str]] = {}  # by wrapper node that is a block, with what stands inline in it, one for each page
    sizes: dict[int, int] = {}
    different = set()
    parsed = [parse(p) for p in dict.fromkeys(pages)]
    for tree, blocks in parsed:
        own = text_of(blocks)
        different.add(" ".join(w for words in own.values() for w in words))
        pairs = align(tree, wrapper, {}, {})

        said: dict[int, list[str]] = {}

        def merge(node: Node, into: Node, block: Node) -> None:
            words = own.get(id(node), [])
            block = into if node.tag in BLOCKS else block
            said.setdefault(id(block), []).extend(words)
            sizes[id(into)] = sizes.get(id(into), 0) + sum(map(len, words))
            for c in node.children.values():
                known = pairs.get(id(c))
                merge(c, known if known is not None and known.kind == c.kind else into.child(c.kind, c.tag), block)

        merge(tree, wrapper, wrapper)
        for node, words in said.items():
            texts.setdefault(node, []).append(" ".join(words))

    template = {i for i, t in texts.items() if len(different) >= AGREE and len(t) >= AGREE and len(set(t)) == 1 and t[0]}

    def weight(node: Node, skip: set[int]) -> int:
        """Letters of varying text, links against it."""
        if is_noise(node) and node.tag != "html":
            return 0
        own = 0 if id(node) in skip else sizes.get(id(node), 0)
        inner = sum(weight(c, skip) for c in node.children.values())
        return -2 * (own + max(inner, 0)) if node.tag == "a" else own + inner

    def articles(node: Node) -> list[Node]:
        """The outermost elements that say they are the article, outside noise."""
        if is_noise(node) and node.tag not in ("header", "html"):
            return []
        if node.tag in ("article", "main") or "main" in node.kind.split(".")[1:]:
            deeper = [n for c in node.children.values() for n in articles(c)] if node.tag != "article" else []
            return deeper or [node]
        return [n for c in node.children.values() for n in articles(c)]

    roots = [r for r in articles(wrapper) if weight(r, set()) > 0]
    if not roots:
        named = [n for n in wrapper.walk() if any(w in ARTICLE_WORDS for w in n.kind.split(".")[1:]) and not is_noise(n) and weight(n, template) > 0]
        best = max(named, key=lambda n: weight(n, template), default=wrapper)
        total = weight(wrapper, template)
        if weight(best, template) < total / 2:
            best = wrapper
        # Down to the smallest element that still has most of the text.
        while deeper := [c for c in best.children.values() if weight(c, template) > 0.7 * weight(best, template) > 0]:
            best = deeper[0]
        roots = [best]

    def mark(node: Node, inside: bool, above: bool = True) -> None:
        """Inline elements share the fate of their block."""
        node.keep = inside and (id(node) not in template if node.tag in BLOCKS else above)
        for c in node.children.values():
            mark(c, inside and not is_noise(c), node.keep)

    for node in wrapper.walk():
        node.fixed = id(node) in template
    for root in roots:
        mark(root, True)
    if not any(n.keep and sizes.get(id(n)) for n in wrapper.walk()):
        template.clear()
        for root in roots:
            mark(root, True)
    return wrapper


def dump(node: Node) -> list:
    return [node.kind, node.keep + 2 * node.fixed, [dump(c) for c in node.children.values()]]


def load(data: list) -> Node:
    node = Node(data[0], data[0].split(".")[0])
    node.keep, node.fixed = bool(data[1] & 1), bool(data[1] & 2)
    for c in data[2]:
        node.children[c[0]] = load(c)
    return node


#: What a wrapper says of a node: the article's; template or something else; left out though it may hold an article;
#: never seen.
KEPT, OTHER, LEFT, UNSEEN = range(4)


def extract(page: str, wrapper: Node, plans: dict[str, list[tuple[int, bool]]]) -> str:
    """The article's blocks, by the wrapper, and by the page itself where the wrapper does not hold its article.

    `plans` remembers the alignment of each shape of tree: what each node is, and whether it is template.
    """
    tree, blocks = parse(page)
    shape = tree.shape()
    if shape not in plans:
        pairs = align(tree, wrapper, {}, {})
        plan: list[tuple[int, bool]] = []

        def decide(node: Node, above: bool, noisy: bool) -> None:
            known = pairs.get(id(node))
            noisy = noisy or is_noise(node)
            mine = known.keep if known is not None else above and not is_noise(node)
            fixed = known is not None and known.fixed
            plan.append((KEPT if mine else OTHER if noisy or fixed else LEFT if known is not None else UNSEEN, fixed))
            for c in node.children.values():
                decide(c, mine, noisy)

        decide(tree, False, False)
        if len(plans) < 10_000:
            plans[shape] = plan
    else:
        plan = plans[shape]
    nodes = list(tree.walk())
    kept = {id(node) for node, (what, _) in zip(nodes, plan, strict=True) if what == KEPT}
    letters, said = [0] * 4, text_of(blocks)
    for node, (what, _) in zip(nodes, plan, strict=True):
        letters[what] += sum(map(len, said.get(id(node), ())))
    if letters[UNSEEN] > letters[KEPT] or letters[LEFT] and not letters[KEPT]:
        # Alone, a page's wrapper is its own tree.
        own = zip(nodes, plan, induce([page]).walk(), strict=True)
        kept |= {id(node) for node, (_, fixed), mine in own if mine.keep and not fixed}
    lines = (" ".join("".join(part for node, part in block if id(node) in kept).split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def main_text(pages: DataFrame, sample: int = 12) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ship_package(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    order = Window.partitionBy("host").orderBy(F.xxhash64(F.lit("wrapper"), "page_id"), "page_id", "html")
    drawn = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select("host", "rank", "html")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper = induce(pdf.sort_values("rank")["html"].tolist())
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [json.dumps(dump(wrapper))]})

    wrappers = drawn.groupBy("host").applyInPandas(learn, "host string, wrapper string")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[Node, dict]] = {}
        for pdf in batches:
            out = []
            for wrapper, page in zip(pdf["wrapper"], pdf["html"], strict=True):
                if wrapper not in known:
                    if len(known) >= 200:
                        known.clear()
                    known[wrapper] = (load(json.loads(wrapper)), {})
                out.append(extract(page, *known[wrapper]))
            result = pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": out})
            result["n_chars"] = result["text"].str.len().astype("int64")
            yield result

    met = attach(rows, wrappers, ["host"], F.col("page_id"))
    return met.select("page_id", "url", "html", "wrapper").mapInPandas(apply, "page_id long, url string, text string, n_chars long")
