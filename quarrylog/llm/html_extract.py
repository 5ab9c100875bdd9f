"""Main-text extraction with a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags and
style tokens are one node of the site's tree. A node's presentation importance
is the entropy of the child layouts it shows over the host's pages, and that of
a node with text of its own the mean of one minus the entropy of each of its
runs of text over the pages, so what every page repeats is worth little. A
branch is worth its own importance and, the fewer layouts it has, its children's.

Every page is decided by its branches' importances. A branch stays if its score
is positive: the log-odds of its importance, which count the more, the more
pages the site has, and the weight of what the markup says. Menus, headers,
footers, sidebars, adverts and reader comments often are text that no other page
has, so tags, roles and names that say so outweigh any importance; a name that
may as well belong to an article ("share", "related") counts less inside the
main part, so that such a branch goes only if the site repeats it. The main part
is the page's articles, main element or content containers, whichever holds
enough text by importance (a teaser beside the main element does not), or else
the whole page. ``marks=False`` leaves all to the entropy. Scripts, styles,
forms and hidden elements are never text.

The tree is never gathered anywhere: per host, path and feature only sums
travel, pre-aggregated in every batch, and the joins back may split a hot host.

Defined results: null or empty html gives an empty text; a null url belongs to
the host ""; repeated rows are pages of their own, which the tree sees once each;
malformed markup is read leniently (unclosed elements end with their parent), at
any depth of nesting; of a page with text outside of noise the branch of most
text stays at least; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Made, beside, materialize, table

DECAY = 0.9
#: Weights in log-odds: any branch, inside a marked main part, a name that may be an article's (inside and outside of it), what markup says for sure.
BASE, INSIDE, DOUBTFUL_INSIDE, DOUBTFUL, SURE = 0.6, 3.0, -3.2, -4.0, -9.0
#: A marked part is the main one if it holds this share of the text of the next wider one, or of the page.
OF_WIDER, OF_PAGE = 0.5, 0.2

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul br".split()
)
_CLOSES_P = _BLOCK - {"br", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head"}
#: An open element of these ends when one of the same group starts beside it.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NEVER = frozenset("head form script style noscript template iframe svg math button select input textarea label object embed audio video canvas title xmp".split())
_NOISE_TAGS = frozenset("nav header footer aside menu dialog".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login comment comments commentlist disqus paywall pagination pager copyright".split()
)
_DOUBTFUL_WORDS = frozenset("banner promo promotion side header notice notices alert respond reply replies discussion related recommended share sharing social widget widgets skip".split())
_MAIN_WORDS = frozenset("article content main post entry story articlebody postbody maincontent".split())
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>|</[^a-zA-Z][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}


_KEEPS_P = _BLOCK - {"p"}
_KEEPS_ITEM = frozenset({"ul", "ol", "dl", "table", "select", "menu", "div", "section", "article"})


class Node:
    __slots__ = ("tag", "style", "mark", "children", "path")

    def __init__(self, tag: str, style: str, mark: int, path: int) -> None:
        self.tag, self.style, self.mark, self.path = tag, style, mark, path
        self.children: list[Node | str] = []


#: What markup says of an element.
HIDDEN, NOISE, UNSURE, PLAIN, CONTAINER, MAIN, ARTICLE = -3, -2, -1, 0, 1, 2, 3


def _describe(tag: str, raw: str) -> tuple[str, int]:
    """Style tokens of an element, and what they say of it."""
    attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}
    tokens = [w for w in re.split(r"[\s_-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()) if w]
    tokens = [re.sub(r"\d+", "", w) for w in tokens]
    style, role = ".".join([tag, *sorted({w for w in tokens if w})]), attrs.get("role", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""))
    if tag in ("html", "body"):
        return style, PLAIN
    if hidden or tag in _NEVER:
        return style, HIDDEN
    if tag in _NOISE_TAGS or role in _NOISE_ROLES or any(w in _NOISE_WORDS for w in tokens):
        return style, NOISE
    if tag == "article" or role == "article":
        return style, ARTICLE
    if tag == "main" or role == "main":
        return style, MAIN
    if any(w in _DOUBTFUL_WORDS for w in tokens):
        return style, UNSURE
    return style, CONTAINER if any(w in _MAIN_WORDS for w in tokens) and tag in ("div", "section", "td") else PLAIN


def parse(source: str) -> Node:
    """A tree of elements and decoded strings."""
    root = Node("#", "#", PLAIN, 0)
    stack, at, known, is_open = [root], 0, {}, Counter()

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    def cut(k: int) -> None:
        for n in stack[k:]:
            is_open[n.tag] -= 1
        del stack[k:]

    def close(names: set[str] | frozenset[str], until: frozenset[str]) -> None:
        if not any(is_open[t] for t in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                cut(k)
                return
            if stack[k].tag in until:
                return

    while m := _TAG.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(html.escape(m[0][9:-3]))
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if is_open[tag]:
                close({tag}, frozenset())
            elif tag == "br":
                stack[-1].children.append(Node("br", "br", PLAIN, 0))
            continue
        if tag in _CLOSES_P:
            close({"p"}, _KEEPS_P)
        if tag in _SIBLINGS:
            close(_SIBLINGS[tag], _KEEPS_ITEM)
        key = (tag, m[3])
        if key not in known:
            known[key] = _describe(tag, m[3])
        style, mark = known[key]
        node = Node(tag, style, mark, xxhash.xxh3_64_intdigest(style, seed=stack[-1].path & 0xFFFFFFFFFFFFFFFF))
        stack[-1].children.append(node)
        if tag in _RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else len(source)
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            is_open[tag] += 1
    text(source[at:])
    return root


def elements(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


def _outermost(node: Node, mark: int) -> list[Node]:
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.mark == mark:
            found.append(n)
        elif n.mark > NOISE:
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return found


def _blocks(roots: list[Node], drop) -> list[str]:
    """Texts of the blocks in page order, without the branches that ``drop`` names."""
    parts: list[str] = []
    todo: list[Node | str] = list(reversed(roots))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        if n.tag == "\0":  # the end of a block
            parts.append("\0")
            continue
        if drop(n):
            parts.append("\0" if n.tag in _BLOCK else "")
            continue
        if n.tag in _BLOCK:
            parts.append("\0")
            todo.append(Node("\0", "", PLAIN, 0))
        todo.extend(reversed(n.children))
    return [b for b in (" ".join(p.split()) for p in "".join(parts).split("\0")) if b]


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _layout(node: Node) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(c.style for c in node.children if isinstance(c, Node)))


def _runs(node: Node) -> Counter:
    """The node's own runs of text, in lower case."""
    return Counter(r for r in (" ".join(c.lower().split()) for c in node.children if isinstance(c, str)) if r)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _features() -> Callable[[pd.DataFrame], Iterator[Made]]:
    """Per batch, host, path and feature: on how many pages, how often, and the sum of c log c; and per page the paths it uses."""

    def run(batch: pd.DataFrame) -> Iterator[Made]:
        sums: dict[tuple, list] = {}
        uses: list[tuple] = []
        for host, key, source in zip(batch["host"], batch["key"].tolist(), batch["html"], strict=True):
            if not source:
                continue
            page: dict[tuple, int] = {}
            for n in elements(parse(source)):
                path = _signed(n.path)
                page[path, "layout", _signed(_layout(n))] = 1
                if n.mark != HIDDEN:
                    for r, count in _runs(n).items():
                        feature = (path, "text", _signed(xxhash.xxh3_64_intdigest(r)))
                        page[feature] = page.get(feature, 0) + count
            uses.extend((host, path, "use", key, 0, 0, 0.0) for path in {p for p, _, _ in page})
            for (path, kind, feature), c in page.items():
                s = sums.setdefault((host, path, kind, feature), [0, 0, 0.0])
                s[0] += 1
                s[1] += c
                s[2] += c * math.log(c)
        rows = [(*k, *v) for k, v in sums.items()] + uses
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7
        yield [0] * len(rows), dict(zip(_SUMS, columns, strict=True))

    return run


_SUMS = ("host", "path", "kind", "feature", "pages", "total", "clogc")


def gathered(hosted: DataFrame) -> DataFrame:
    """Sums of every feature, and the paths that pages use (kind ``use``, with the page's key as feature)."""
    return beside(hosted, lambda: _features(), ["host", "key", "html"], "host string, path long, kind string, feature long, pages long, total long, clogc double")


def style_tree(features: DataFrame) -> DataFrame:
    """(host, path, pages, importance, layouts) of every node of every site's tree; a page counts once for each layout of the node."""
    each = features.where("kind <> 'use'").groupBy("host", "path", "kind", "feature").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "clogc")])
    spread = F.log("total") - F.col("clogc") / F.col("total")  # entropy over pages, in nats
    log_pages = F.col("pages") * F.log("pages")
    layout = F.col("kind") == "layout"
    sums = each.groupBy("host", "path").agg(
        F.sum(F.when(layout, F.col("pages"))).alias("m"),
        F.sum(F.when(layout, log_pages)).alias("plogp"),
        F.count(F.when(layout, 1)).alias("layouts"),
        F.sum(F.when(~layout, spread)).alias("spread"),
        F.count(F.when(~layout, 1)).alias("runs"),
    )
    log_m = F.log("m")
    presentation = F.when(F.col("m") > 1, (log_m - F.col("plogp") / F.col("m")) / log_m).otherwise(1.0)
    content = F.when(F.col("m") > 1, 1 - F.col("spread") / F.col("runs") / log_m).otherwise(1.0)
    own = F.when(F.col("runs") > 0, F.greatest(content, presentation)).otherwise(presentation)
    return sums.select("host", "path", F.col("m").alias("pages"), own.alias("importance"), "layouts")


Tree = dict[int, tuple[float, int, int]]


def importances(root: Node, tree: Tree) -> dict[int, float]:
    """By id of every element: its own importance and, the fewer layouts it has, its children's."""
    out: dict[int, float] = {}
    for n in reversed(list(elements(root))):  # children first
        own, layouts, _ = tree.get(_signed(n.path), (1.0, 1, 1))
        below = [out[id(c)] for c in n.children if isinstance(c, Node) and c.tag not in _VOID and c.children]
        if below:
            share = DECAY**layouts
            has_text = any(isinstance(c, str) and c.strip() for c in n.children)
            own = max((1 - share) * own + share * sum(below) / len(below), own if has_text else 0.0)
        out[id(n)] = own
    return out


def log_odds(importance: float, pages: int) -> float:
    """Between -3 and 3; 0 where the site's only page says nothing of what it repeats."""
    belief = 0.5 + (importance - 0.5) * (1 - 1 / max(1, pages))
    return math.log((belief + 0.05) / (1.05 - belief))


def _heading_inside(node: Node) -> bool:
    return any(c.tag in ("h1", "h2", "h3") for c in elements(node))


def main_parts(root: Node, weigh: Callable[[Node], float]) -> list[Node]:
    """The articles, the main elements or the containers that hold the page's text, or nothing. ``weigh``: text by importance."""
    mass: dict[int, float] = {}
    for n in reversed(list(elements(root))):
        text = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        below = sum(mass[id(c)] for c in n.children if isinstance(c, Node))
        mass[id(n)] = 0.0 if n.mark <= NOISE else text * weigh(n) + below
    groups = [g for g in (_outermost(root, mark) for mark in (ARTICLE, MAIN, CONTAINER)) if g]
    held = [sum(mass[id(n)] for n in g) for g in groups]
    for k, g in enumerate(groups):
        if held[k] >= OF_WIDER * max(held[k + 1 :], default=0.0) and held[k] >= OF_PAGE * mass[id(root)] and held[k]:
            return g
    return []


def text_of(root: Node, tree: Tree, marks: bool = True) -> str:
    """The text of the page's branches of positive score."""
    worth = importances(root, tree)
    odds = lambda n: log_odds(worth[id(n)], tree.get(_signed(n.path), (1.0, 1, 1))[2])
    main = main_parts(root, lambda n: 1 / (1 + math.exp(-odds(n)))) if marks else []
    bonus, doubtful = (INSIDE, DOUBTFUL_INSIDE) if main else (0.0, DOUBTFUL)
    chosen = {id(n) for n in main}

    def drop(n: Node) -> bool:
        if n.mark == HIDDEN:
            return True
        if n.tag in ("#", "html", "body", "br") or id(n) in chosen:
            return False
        weight = 0.0
        if marks and n.mark == NOISE and not (main and n.tag == "header" and _heading_inside(n)):  # an article's header holds its headline
            weight = SURE
        elif marks and n.mark == UNSURE:
            weight = doubtful
        return (weight < 0 or n.tag in _BLOCK) and BASE + bonus + weight + odds(n) < 0

    blocks = _blocks(main or [root], drop)
    if not blocks:  # all that is not noise by its markup is repeated: the branch of most text
        outside = {id(x) for n in elements(root) if n.mark <= NOISE for x in elements(n)}
        leaves = [n for n in elements(root) if n.tag in _BLOCK and id(n) not in outside and not any(isinstance(c, Node) and c.tag in _BLOCK - {"br"} for c in n.children)]
        blocks = max((_blocks([n], lambda x: x.mark <= UNSURE) for n in leaves), key=lambda b: sum(map(len, b)), default=[])
    return " ".join(blocks)


def _decided(marks: bool):
    def factory() -> Callable[[pd.DataFrame], Iterator[Made]]:
        unpack = zstandard.ZstdDecompressor()

        def run(batch: pd.DataFrame) -> Iterator[Made]:
            texts = []
            for packed, nodes in zip(batch["packed"], batch["nodes"], strict=True):
                tree = {n["path"]: (n["importance"], n["layouts"], n["pages"]) for n in nodes} if nodes is not None else {}
                texts.append(text_of(parse(unpack.decompress(packed).decode()), tree, marks) if packed else "")
            yield range(len(texts)), {"text": texts}

        return run

    return factory


def _packed() -> Callable[[pd.DataFrame], Iterator[Made]]:
    pack = zstandard.ZstdCompressor()
    return lambda batch: iter([(range(len(batch)), {"packed": [pack.compress(h.encode("utf-8", "replace")) if h else None for h in batch["html"]]})])


def extract(pages: DataFrame, marks: bool = True) -> DataFrame:
    """``pages``: page_id, url, html. One row each: page_id, url, text, n_chars."""
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"), F.xxhash64("page_id", "url", "html").alias("key"))
    features = materialize(gathered(hosted), "features")
    tree = materialize(style_tree(features), "tree")
    uses = features.where("kind = 'use'").select("host", "path", F.col("feature").alias("key"))
    nodes = uses.join(tree, ["host", "path"]).groupBy("key").agg(F.collect_set(F.struct("path", "importance", "layouts", "pages")).alias("nodes"))
    # The pages travel compressed; a page of many elements brings no more nodes than it has.
    carried = beside(hosted, lambda: _packed(), ["html"], "packed binary", keeps=["page_id", "url", "key"])
    texts = beside(carried.join(nodes, "key", "left"), _decided(marks), ["packed", "nodes"], "text string", keeps=["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
