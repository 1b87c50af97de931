"""Main text of web pages by union-free wrapper inference.

Pages of a host are printed from a few templates: pages are of one template if
they have the same set of container paths, and an article, a main or neither.
From all pages of a template a **wrapper** is inferred: a regular expression without unions over the
page's token stream, built by aligning pages, and then what is known of groups of them, with
each other. Inside each element the children are first folded (a run of like
siblings, or of like pairs and triples, becomes a repeated group), then aligned:
children found in both are merged, children found in one only become optional,
and texts that differ become slots. Every text place is content or
boilerplate: places inside menus, footers, adverts, forms, notices, comments and
the like are boilerplate; where the wrapper has an article (or else a main)
element, that is the evidence for content, and places outside it are boilerplate;
where it has not, constant blocks are boilerplate and the rest of the element
that holds most of the template's varying text is content. The wrapper's label
decides every place of every page.

* Constant or varying is counted over all different pages: a block is constant if
  at least half of the host's (or the template's) pages that have its path, and
  more than one page, have this text there.
* Every task aligns its pages of a template, pairs first, then pairs of pairs; the
  tasks' partial wrappers are aligned by template in two levels, so a host with a
  third of all pages costs no task more than another one. Elements are aligned only
  if tag, names and what marks them as boilerplate are the same: the places that a
  wrapper knows, and so its labels, do not depend on the order of the pages.
* All pages are written with their template and joined with its wrapper's labels, those of
  every place, as the few elements below which they change (Spark broadcasts the wrappers while
  they are small, and splits hot templates in a sort-merge join otherwise).
* The blocks of all pages are counted, also of those with an article: a menu that they print
  is constant for the host's other pages too. Nothing goes from an article for being constant.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by ``\\n`` in page order; nothing else is dropped.

Defined cases: null or empty html gives an empty text; a null url belongs to
the host ``''``; a page without tags is one block; unclosed tags end with their
parent; repeated rows give the same text; other columns play no part.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, map_arrow, map_arrow_stream, written

#: Groups in which the tasks' partial wrappers of a template are aligned before they are aligned with each other.
GROUPS = 64
#: Partial wrappers that a task holds before it hands them on.
HELD_WRAPPERS = 5_000

# HTML vocabulary and the names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDARY = frozenset("article aside body div dl footer form header html main nav ol section table td th ul blockquote".split())
#: Containers whose paths tell templates apart.
CONTAINERS = frozenset("body div section table td center".split())
DROP_TAGS = frozenset("nav footer aside form head menu button select option input label noscript template iframe object svg math canvas audio video dialog".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "footer sidebar rail widget widgets related recommended recommendations share sharing social notice notices alert cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion pagination pager copyright toolbar search".split())
OUTSIDE_ONLY = frozenset("header masthead topbar top".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|title|textarea|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"']*>))*)>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    """An element: ``key`` (tag and names), whether it is boilerplate by name, children (nodes and texts)."""

    __slots__ = ("tag", "key", "drop", "outside", "kids")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.key, self.kids = tag, tag, []
        self.drop, self.outside = tag in DROP_TAGS, tag == "header"
        if attrs and not attrs.isspace():
            names: list[str] = []
            for name, a, b, c in _ATTR.findall(attrs):
                value, name = (a or b or c).lower(), name.lower()
                if name in ("class", "id"):
                    names += _NAME.findall(value)
                    if tag == "article":  # whole names only: an article may be filed under "category-social"
                        self.drop |= not DROP_NAMES.isdisjoint(value.split()) or any(v.startswith("comment") for v in value.split())
                elif name == "role":
                    self.drop |= value in DROP_ROLES
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.drop = True
            if names:
                self.key = f"{tag}.{'.'.join(sorted(set(names)))}"
                if tag not in ("html", "body", "article", "main"):
                    self.drop |= not DROP_NAMES.isdisjoint(names)
                    self.outside |= not OUTSIDE_ONLY.isdisjoint(names)


def parse(page: str) -> Node:
    """A page as a tree; unclosed elements end where their parent ends."""
    root = Node("#page", "")
    stack, at = [root], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in BOUNDARY and tag not in BOUNDARY:
                    break
            continue
        closes = SAME_LEVEL.get(tag, ()) + (("p",) if tag in CLOSES_P else ())
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in BOUNDARY and not (tag in ("li", "tr", "td", "th") and stack[k].tag in ("tr", "td", "th") and stack[k].tag in closes):
                    break
        node = Node(tag, m.group(4))
        stack[-1].kids.append(node)
        if tag not in VOID and not m.group(4).rstrip().endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


# ---- wrapper inference ---------------------------------------------------------------------

class Item:
    """A place of a wrapper: an element with its own items, or a text (``text`` is None once it is a slot).

    Items of one ``kind`` are aligned: the element's key, tag and whether it is boilerplate by name.
    """

    __slots__ = ("key", "kind", "node", "kids", "text", "optional", "repeated", "varying", "seen")

    def __init__(self, key: str, node: Node | None = None, text: str | None = None):
        self.key, self.node, self.kids, self.text = key, node, [], text
        self.kind = (key, node.tag, node.drop, node.outside) if node else key
        self.optional = self.repeated = False
        self.varying, self.seen = 0, 1

    def expression(self) -> str:
        """The wrapper as a regular expression over tokens."""
        inner = "".join(k.expression() for k in self.kids)
        body = ("#SLOT" if self.text is None else f"'{self.text}'") if self.key == "#text" else f"<{self.key}>{inner}</{self.key}>"
        return f"({body}){'*' if self.optional and self.repeated else '+' if self.repeated else '?'}" if self.optional or self.repeated else body


def _clean(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def items_of(node: Node) -> list[Item]:
    out = []
    for kid in node.kids:
        if isinstance(kid, str):
            if kid and not kid.isspace():
                out.append(Item("#text", text=_clean(kid)))
        else:
            item = Item(kid.key, kid)
            item.kids = items_of(kid)
            out.append(item)
    return fold(out)


def fold(items: list[Item]) -> list[Item]:
    """Neighbouring repeats of one, two or three items become repeated items."""
    for width in (1, 2, 3):
        out: list[Item] = []
        for item in items:
            out.append(item)
            n = len(out)
            if n >= 2 * width and all(out[n - 2 * width + k].kind == out[n - width + k].kind for k in range(width)) and any(x.key != "#text" for x in out[n - width :]):
                for k in range(width):
                    merge(out[n - 2 * width + k], out[n - width + k])
                    out[n - 2 * width + k].repeated = True
                del out[n - width :]
        items = out
    return items


def merge(known: Item, new: Item) -> None:
    """Takes ``new`` into ``known``: differing texts become a slot, children are aligned."""
    known.seen += new.seen
    known.optional |= new.optional
    known.repeated |= new.repeated
    if known.key == "#text":
        if known.text != new.text or known.text is None:
            known.varying += new.varying + len(new.text or "") + len(known.text or "")
            known.text = None
        return
    known.varying += new.varying
    known.kids = align(known.kids, new.kids)


def align(known: list[Item], new: list[Item]) -> list[Item]:
    """One item list that covers both: what only one of them has becomes optional."""
    out: list[Item] = []
    kinds = [x.kind for x in known], [x.kind for x in new]
    same = [("equal", 0, len(known), 0, len(new))] if kinds[0] == kinds[1] else None
    for what, a0, a1, b0, b1 in same or SequenceMatcher(None, *kinds, autojunk=False).get_opcodes():
        if what == "equal":
            for a, b in zip(known[a0:a1], new[b0:b1]):
                merge(a, b)
                out.append(a)
        else:
            for x in known[a0:a1] + new[b0:b1]:
                x.optional = True
                out.append(x)
    return fold(out)


def item_of(tree: Node) -> Item:
    """The wrapper of one page."""
    item = Item(tree.key, tree)
    item.kids = items_of(tree)
    return item


def infer(pages: list[str]) -> Item:
    """The wrapper of some pages of one host."""
    wrapper: Item | None = None
    for page in pages:
        mine = item_of(parse(page))
        if wrapper is None:
            wrapper = mine
        else:
            merge(wrapper, mine)
    return wrapper or Item("#page")


class Aligned:
    """Wrappers aligned in pairs, then pairs of pairs: every page takes part in as many alignments as their number's logarithm."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Item]] = []

    def add(self, item: Item, rank: int = 0) -> None:
        while self.held and self.held[-1][0] == rank:
            known = self.held.pop()[1]
            merge(known, item)
            item, rank = known, rank + 1
        self.held.append((rank, item))

    def whole(self) -> Item:
        item = self.held.pop()[1]
        while self.held:
            known = self.held.pop()[1]
            merge(known, item)
            item = known
        return item


def packed(wrapper: Item) -> str:
    """A wrapper as JSON: its items from the top down, each with its depth."""
    rows, todo = [], [(0, wrapper)]
    while todo:
        depth, x = todo.pop()
        n = x.node
        rows.append((depth, x.key, [n.tag, n.drop, n.outside] if n else None, x.text, x.optional, x.repeated, x.varying, x.seen))
        todo += [(depth + 1, k) for k in reversed(x.kids)]
    return json.dumps(rows, separators=(",", ":"))


def unpacked(text: str) -> Item:
    above: list[Item] = []
    for depth, key, element, words, optional, repeated, varying, seen in json.loads(text):
        node = None
        if element:
            node = Node(element[0], "")
            node.key, node.drop, node.outside = key, element[1], element[2]
        item = Item(key, node, words)
        item.optional, item.repeated, item.varying, item.seen = optional, repeated, varying, seen
        del above[depth:]
        if above:
            above[-1].kids.append(item)
        above.append(item)
    return above[0]


def region_of(sizes: list[tuple[tuple[str, ...], int]]) -> tuple[str, ...]:
    """The element that holds most of the varying text: down while an inner one still has 0.6 of it."""
    weight: dict[tuple[str, ...], int] = {}
    for path, size in sizes:
        for k in range(len(path) + 1):
            weight[path[:k]] = weight.get(path[:k], 0) + size
    region: tuple[str, ...] = ()
    while True:
        inner = [p for p in weight if len(p) == len(region) + 1 and p[: len(region)] == region and p[-1].split(".")[0] in BOUNDARY]
        best = max(inner, key=lambda p: (weight[p], p), default=None)
        if best is None or weight[best] < 0.6 * max(1, weight.get((), 0)):
            return region
        region = best


def places_of(wrapper: Item) -> list[tuple[tuple[str, ...], Item, bool, str, bool]]:
    """Every text place: path, item, whether dropped, the article or main (or both, outermost first) it is in, whether inside of a header or the like."""
    places: list[tuple[tuple[str, ...], Item, bool, str, bool]] = []

    def walk(item: Item, path: tuple[str, ...], drop: bool, main: str, outside: bool) -> None:
        for kid in item.kids:
            if kid.key == "#text":
                places.append((path, kid, drop, main, outside))
            else:
                n = kid.node
                # as in own_element: an article in a header is not the page's article
                enters = n.tag in ("article", "main") and n.tag not in main.split() and not drop and (bool(main) or not outside)
                walk(kid, (*path, kid.key), drop or n.drop, f"{main} {n.tag}".strip() if enters else main, outside or n.outside)

    walk(wrapper, (), False, "", False)
    return places


def told(wrapper: Item, own: str, region: tuple[str, ...]) -> dict[str, bool]:
    """The labels that differ from what a page tells by itself (:func:`content` without labels): what the wrapper adds."""
    alone: dict[str, set[bool]] = {}

    def walk(item: Item, path: tuple[str, ...], main: bool, outside: bool) -> None:
        for kid in item.kids:
            if kid.key == "#text":
                alone.setdefault("/".join(path), set()).add(main if own else not outside and path[: len(region)] == region)
            elif not kid.node.drop:  # nothing inside a dropped element is a page's content, whatever its label
                walk(kid, (*path, kid.key), main or bool(own) and kid.node.tag == own, outside or kid.node.outside)

    walk(wrapper, (), False, False)
    said = labels(wrapper, wrapper.seen, region)
    return {path: said[path] for path, own_word in alone.items() if own_word != {said[path]}}


def labels(wrapper: Item, pages: int, region: tuple[str, ...] | None = None) -> dict[str, bool]:
    """Content (true) or boilerplate (false) for every text place, by its path of element keys.

    With ``region`` (the element that all pages of the template say holds the
    content) constant blocks are told apart by the caller's counts.
    """
    places = places_of(wrapper)
    article = {p[3].split()[0] for p in places if p[3] and not p[2]}
    wanted = "article" if "article" in article else "main" if "main" in article else ""
    out: dict[str, bool] = {}
    if wanted:
        for path, _, drop, main, _ in places:
            name = "/".join(path)
            out[name] = out.get(name, False) or (not drop and (wanted in main.split() or wanted == "main" and bool(main)))
        return out
    free = [(path, item) for path, item, drop, _, outside in places if not drop and not outside]
    counted = region is not None
    if region is None:
        region = region_of([(path, item.varying if pages > 1 else len(item.text or "") + item.varying) for path, item in free])
    for path, item, drop, _, outside in places:
        name = "/".join(path)
        constant = not counted and pages > 1 and item.text is not None and item.seen > 1 and not item.repeated
        out[name] = out.get(name, False) or (not drop and not outside and path[: len(region)] == region and not constant)
    return out


def subtrees(labels: dict[str, bool]) -> dict[str, bool]:
    """The fewest elements whose labels give those of all places: a place has that of the longest beginning of its path."""
    nodes: set[str] = set()
    for path in labels:
        while path not in nodes:
            nodes.add(path)
            path = path.rpartition("/")[0]
    top_down = sorted(nodes, key=lambda p: (len(p.split("/")) if p else 0, p))
    cost = {p: [0.0, 0.0] for p in nodes}  # changes below an element, if it is boilerplate and if it is content
    for path, label in labels.items():
        cost[path][not label] = float("inf")
    for path in reversed(top_down[1:]):
        above = cost[path.rpartition("/")[0]]
        for label in (False, True):
            above[label] += min(cost[path][label], 1 + cost[path][not label])
    given: dict[str, bool] = {}
    out: dict[str, bool] = {}
    for path in top_down:
        above = given[path.rpartition("/")[0]] if path else cost[""][True] < cost[""][False]
        given[path] = above if not path or cost[path][above] < 1 + cost[path][not above] else not above
        if not path or given[path] != above:
            out[path] = given[path]
    return out


@dataclass
class Known:
    """What is known of a page's template: labels by place, the content's element, keys of constant blocks, labels by :func:`subtrees`."""

    labels: dict[str, bool] = field(default_factory=dict)
    region: str | None = None
    constant: frozenset[int] = frozenset()
    subtrees: dict[str, bool] = field(default_factory=dict)

    def label(self, path: str) -> bool | None:
        if path in self.labels or not self.subtrees:
            return self.labels.get(path)
        while path and path not in self.subtrees:
            path = path.rpartition("/")[0]
        return self.subtrees.get(path)


def own_element(tree: Node) -> str:
    """``article`` or else ``main`` if the page has one with text that no menu, notice or comment holds; else empty."""
    found: set[str] = set()

    def walk(node: Node, within: str) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                if within and not kid.isspace():
                    found.add(within)
            elif not kid.drop and (within or not kid.outside):
                walk(kid, within or (kid.tag if kid.tag in ("article", "main") else ""))

    walk(tree, "")
    return "article" if "article" in found else "main" if "main" in found else ""


def blocks_of(tree: Node, own: str) -> list[tuple[str, list[tuple[str, bool, bool, str]]]]:
    """The page's blocks outside boilerplate by name: their path, and of each text place, dropped, in ``own``, text."""
    blocks: list[tuple[str, list[tuple[str, bool, bool, str]]]] = []
    parts: list[tuple[str, bool, bool, str]] = []

    def flush(path: str) -> None:
        if parts:
            blocks.append((path, parts.copy()))
            parts.clear()

    def walk(node: Node, path: str, block: str, drop: bool, main: bool) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                parts.append((path, drop, main, html_lib.unescape(kid) if "&" in kid else kid))
            elif kid.tag == "br":
                parts.append((path, drop, main, " "))
            else:
                inner_drop = drop or kid.drop or (kid.outside and not main)
                if inner_drop and (kid.drop or drop):
                    if kid.tag in BLOCKS:
                        flush(block)
                    continue  # nothing inside can be content
                inner = f"{path}/{kid.key}" if path else kid.key
                if kid.tag in BLOCKS:
                    flush(block)
                walk(kid, inner, inner if kid.tag in BLOCKS else block, inner_drop, main or kid.tag == own)
                if kid.tag in BLOCKS:
                    flush(inner)

    walk(tree, "", "", False, False)
    flush("")
    return blocks


def block_key(path: str, parts: list[tuple[str, bool, bool, str]]) -> tuple[int, int]:
    """A signed 64-bit key of a block's path and undropped text, and the text's code points (0: no text)."""
    text = " ".join("".join(t for _, drop, _, t in parts if not drop).split())
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), len(text)


def extract(page: str, known: dict[str, bool] | Known) -> str:
    """The page's content blocks; ``known`` is what the host's pages say of its template (empty: rules alone)."""
    tree = parse(page)
    own = own_element(tree)
    if not isinstance(known, Known):
        known = Known(known)
    if not own and not known.labels and known.region is None:
        known = Known(labels(infer([page]), 1))
    return content(tree, own, known)


def content(tree: Node, own: str, known: Known) -> str:
    def keep(path: str, drop: bool, main: bool) -> bool:
        label = known.label(path)
        if own:  # a place that the wrapper knows goes by its label, any other by the page's own article
            return not drop and (main if label is None else label)
        if label is not None:
            return label
        if known.region is None:
            return not drop and known.labels.get(path.rpartition("/")[0], True)
        return not drop and (not known.region or f"{path}/".startswith(f"{known.region}/"))

    out = []
    for path, parts in blocks_of(tree, own):
        text = " ".join("".join(t for place, drop, main, t in parts if keep(place, drop, main)).split())
        if text and (own or not known.constant or block_key(path, parts)[0] not in known.constant):
            out.append(text)
    return "\n".join(out)


# ---- Spark jobs ----------------------------------------------------------------------------

def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def survey(tree: Node) -> tuple[int, str, list[dict]]:
    """The template key of a page, its own element, and its different blocks: path, key, code points, first block of the path."""
    own = own_element(tree)
    containers: set[str] = {f"own:{own}"}

    def walk(node: Node, path: str) -> None:
        for kid in node.kids:
            if not isinstance(kid, str) and not kid.drop:
                inner = f"{path}/{kid.key}"
                if kid.tag in CONTAINERS:
                    containers.add(inner)
                walk(kid, inner)

    walk(tree, "")
    template = int.from_bytes(hashlib.blake2b("\n".join(sorted(containers)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
    found: dict[int, dict] = {}
    paths: set[str] = set()
    for path, parts in blocks_of(tree, ""):
        key, size = block_key(path, parts)
        if size and key not in found:
            found[key] = {"path": path, "block": key, "size": size, "first": path not in paths}
            paths.add(path)
    return template, own, list(found.values())


PAGE = "page_id long, url string, html string, host string"
BLOCK = "struct<path: string, block: bigint, size: bigint, first: boolean>"


def surveyed(base: DataFrame) -> DataFrame:
    """The pages with their template, own element and blocks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        templates, owns, blocks = [], [], []
        for page in batch.column("html"):
            template, own, found = survey(parse(page.as_py()))
            templates.append(template)
            owns.append(own)
            blocks.append(found)
        kind = pa.list_(pa.struct([("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("first", pa.bool_())]))
        rows = batch.select(["page_id", "url", "html", "host"])
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(templates, pa.int64()), pa.array(owns, pa.string()), pa.array(blocks, kind)], names=[*rows.schema.names, "template", "own", "blocks"])

    return map_arrow(base.select("page_id", "url", "html", "host"), run, f"{PAGE}, template long, own string, blocks array<{BLOCK}>")


def counted(pages: DataFrame) -> DataFrame:
    """``(host, template, varying, constant)`` of surveyed pages: code points of varying text by path, keys of constant blocks.

    All pages are counted; the rows are those of the templates without an article or main, whose labels need them.
    """
    # a copy of a page counts once
    different = pages.select("host", "template", "own", "blocks", F.xxhash64("html").alias("h")).dropDuplicates(["host", "h"])
    texts = written(different.select("host", "template", "own", F.inline("blocks")).groupBy("host", "template", "own", "path", "block")
                    .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.col("first").cast("long")).alias("first")), "blocks")
    free = texts.where("own = ''")
    of_template = free.groupBy("host", "template", "path").agg(F.sum("first").alias("pages"))
    of_host = texts.groupBy("host", "path").agg(F.sum("first").alias("pages"))
    half = (F.col("n") >= 2) & (2 * F.col("n") >= F.col("pages"))
    by_host = (texts.groupBy("host", "path", "block").agg(F.sum("n").alias("n")).where("n >= 2")
               .join(of_host, ["host", "path"]).where(half).select("host", "block"))
    by_template = (free.where("n >= 2").select("host", "template", "path", "block", "n")
                   .join(of_template, ["host", "template", "path"]).where(half & (F.col("pages") >= 3)).select("host", "template", "block"))
    in_host = free.join(by_host.withColumn("c1", F.lit(True)), ["host", "block"], "left")
    both = in_host.join(by_template.withColumn("c2", F.lit(True)), ["host", "template", "block"], "left").withColumn("c", F.col("c1").isNotNull() | F.col("c2").isNotNull())
    paths = both.groupBy("host", "template", "path").agg(F.sum(F.when(~F.col("c"), F.col("size")).otherwise(0)).alias("size"), F.collect_list(F.when(F.col("c"), F.col("block"))).alias("constant"))
    return paths.groupBy("host", "template").agg(F.to_json(F.collect_list(F.struct("path", "size"))).alias("varying"), F.to_json(F.flatten(F.collect_list("constant"))).alias("constant"))


PARTIAL = "host string, template long, own string, wrapper string"
_PARTIAL = pa.schema([("host", pa.string()), ("template", pa.int64()), ("own", pa.string()), ("wrapper", pa.string())])


def _partial_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pages as one partial wrapper a template (more, where it has more templates than it holds)."""
    held: dict[tuple[str, int], tuple[str, Aligned]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*key, own, packed(aligned.whole())) for key, (own, aligned) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTIAL)], schema=_PARTIAL)

    for batch in batches:
        for host, template, own, page in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "own")), batch.column("html")):
            if (host, template) not in held:
                if len(held) >= HELD_WRAPPERS:
                    yield out()
                held[host, template] = own, Aligned()
            held[host, template][1].add(item_of(parse(page.as_py())))
    if held:
        yield out()


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, template, wrapper, expression)`` of surveyed pages: what is known of each template (its labels by :func:`subtrees`) as JSON, and the wrapper itself."""
    partial = map_arrow_stream(bounded_batches(pages.select("host", "template", "own", "html")), _partial_wrappers, PARTIAL)

    def aligned(rows: pd.DataFrame) -> Item:
        found = Aligned()
        for text in sorted(rows["wrapper"]):
            found.add(unpacked(text))
        return found.whole()

    def some(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key[:2], min(rows["own"]), packed(aligned(rows)))], columns=["host", "template", "own", "wrapper"])

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        varying, constant = rows["varying"].iloc[0], rows["constant"].iloc[0]
        sizes = [(tuple(x["path"].split("/")) if x.get("path") else (), x["size"]) for x in json.loads(varying or "[]")]
        region = region_of(sizes)
        wrapper = aligned(rows)
        known = {"labels": subtrees(labels(wrapper, wrapper.seen, region)), "region": "/".join(region), "constant": sorted(json.loads(constant or "[]"))}
        return pd.DataFrame([(*key, json.dumps(known, ensure_ascii=False, sort_keys=True), wrapper.expression())], columns=["host", "template", "wrapper", "expression"])

    grouped = partial.groupBy("host", "template", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g")).applyInPandas(some, PARTIAL)
    return grouped.join(counted(pages), ["host", "template"], "left").groupBy("host", "template").applyInPandas(one, "host string, template long, wrapper string, expression string")


@lru_cache(1_000)
def known_of(wrapper: str | None) -> Known:
    """What :func:`wrappers` wrote of a template."""
    x = json.loads(wrapper) if wrapper else {}
    return Known({}, x.get("region"), frozenset(x.get("constant", ())), x.get("labels", {}))


TEXT = "page_id long, url string, text string, n_chars long"


def _texts(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    seen = written(surveyed(base), "pages")
    known = written(wrappers(seen), "wrappers").select("host", "template", "wrapper")

    def by_wrapper(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column("wrapper").dictionary_encode()  # a template's labels once a batch, not once a page
        different = found.dictionary.to_pylist()
        texts = [extract(page.as_py(), known_of(None if at is None else different[at])) for page, at in zip(batch.column("html"), found.indices.to_pylist())]
        return _texts(batch, texts)

    joined = seen.join(known, ["host", "template"], "left").select("page_id", "url", "html", "wrapper")
    return map_arrow(joined, by_wrapper, TEXT)
