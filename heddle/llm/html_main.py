"""Main text of HTML pages by wrapper induction.

Pages of a host share a template. Each page is parsed to a tree whose like siblings are folded into one repeated node.
Trees of a host are aligned one after the other by simple tree matching (the alignment of ordered children that matches
most nodes), which gives a tree of all nodes of the host with the number of pages that have each: nodes of most
pages are the template's slots. Texts of slots are counted exactly, over all pages: those of most pages are template;
what varies is content, and lies in the region of the tree below which most of the different texts stand. Alignment is done for each partition's pages, and the partial trees of a host, a few for each
partition, are aligned again; texts are counted by hash, partially before they are shuffled; so no host's pages are
gathered, and one may hold any share of the pages.

Slots that stand for something else vary, too (menus, adverts, comments), so what lies in elements of NOT_CONTENT, or in
elements whose role, id or a whole token of whose class says so, never counts as content, within the region or without one. Class and id say nothing of
elements of WHOLE, of headers in an article or main element, and of an element that holds most of the page's text. Where a page has an article or main element only
what lies in one counts.

A page whose whole content stands on most pages of its host is a copy, not template, and keeps all of it; every other page
loses its constant texts, however much of it they are. Hosts need `least_pages` pages with any text, and a text must stand
on that many: with fewer nothing tells template from content, so texts of such hosts stay whole.

A null or empty html gives an empty text, a null url the host ''. Repeated pages give equal results. Pages of any size
are read whole; elements nested deeper than DEPTH count as that deep. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, slices, written

DEPTH = 64
WHOLE_SLOT = -1
#: Elements of HTML by their part in the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOT_CONTENT = frozenset("head script style noscript template nav header footer aside form button select option textarea input iframe object svg canvas dialog menu title".split())
ROOTS = frozenset("article main".split())
WHOLE = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SIGNS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: A start tag closes open elements of the named kinds.
_LISTED = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {t: ("p",) for t in _LISTED} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
#: Elements that such closing doesn't go beyond.
_WALLS = frozenset("article aside body div footer form header html main nav section table td th ul ol dl blockquote".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
HEADS = frozenset("header masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def _marked(attrs: str) -> tuple[str, bool, set[str]]:
    """What tells an element from others of its kind, whether its role says that it is no content, and its sign words."""
    label, out, signs = [], False, set()
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        if name.lower() == "role":
            out |= value.strip().lower() in ROLES
            continue
        if name.lower() == "class":
            label.append(".".join(sorted(value.split())))
        signs |= SIGNS.intersection(value.lower().split())
    return " ".join(label), out, signs


class Block:
    __slots__ = ("path", "root", "sign", "text")

    def __init__(self, path: tuple[str, ...], text: str, root: bool, sign: int = -1):
        self.path, self.text, self.root, self.sign = path, text, root, sign


def _without_signs(found: list[Block], outer: list[int]) -> list[Block]:
    """The blocks that lie in no element with a sign word, other than one that holds most of the page's text.

    outer: for each such element the next one that holds it, or -1. An element holds no less than those in it, so the
    innermost decides.
    """
    if not outer:
        return found
    sizes = [0] * len(outer)
    for b in found:
        if b.sign >= 0:
            sizes[b.sign] += len(b.text)
    for i in range(len(outer) - 1, -1, -1):
        if outer[i] >= 0:
            sizes[outer[i]] += sizes[i]
    most = sum(len(b.text) for b in found) / 2
    return [b for b in found if b.sign < 0 or sizes[b.sign] > most]


def blocks(page: str) -> list[Block]:
    """Texts of block elements in page order with the labels of their ancestors; what is no content by its elements is left out."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, int]] = []  # element, label, no content, in a root, innermost element with sign words
    run: list[str] = []
    flags = (False, False, -1)
    outer: list[int] = []

    def flush() -> None:
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text and not flags[0]:
                out.append(Block(tuple(x[1] for x in stack if x[0] not in INLINE)[:DEPTH], text, flags[1], flags[2]))

    def close(to: int) -> None:
        nonlocal flags
        if any(x[0] not in INLINE or x[2] or x[4] >= 0 for x in stack[to:]):
            flush()
        del stack[to:]
        flags = stack[-1][2:] if stack else (False, False, -1)

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i >= 0 and (tag not in INLINE or all(x[0] in INLINE for x in stack[i:])):
                close(i)
            continue
        if tag in CLOSES:
            i = len(stack)
            low = i
            while i and stack[i - 1][0] not in _WALLS - set(CLOSES[tag]):
                i -= 1
                if stack[i][0] in CLOSES[tag]:
                    low = i
            if low < len(stack):
                close(low)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            run.append(" ")
            continue
        label, no, signs = _marked(m[3])
        inline = tag in INLINE
        if tag == "br":
            run.append(" ")
        if tag in VOID:
            if not inline:
                flush()
            continue
        if tag in WHOLE:
            no, signs = False, set()
        if flags[1]:
            signs -= HEADS
        no = no or tag in NOT_CONTENT and not (tag == "header" and flags[1])
        if not inline or no or signs:
            flush()
        held = flags[2]
        if signs:
            outer.append(held)
            held = len(outer) - 1
        stack.append((tag, f"{tag} {label}".strip(), flags[0] or no, flags[1] or tag in ROOTS, held))
        flags = stack[-1][2:]
    flush()
    return _without_signs(out, outer)


class Node:
    """A node of a host's tree and the number of pages that have it."""

    __slots__ = ("children", "count", "label")

    def __init__(self, label: str, count: int = 1, children: list[Node] | None = None):
        self.label, self.count, self.children = label, count, children or []

    def add(self, other: Node) -> None:
        """Align another tree of the same label with this one and take it in."""
        self.count += other.count
        if not other.children:
            return
        merged, i = [], 0
        for j, k in align(self.children, other.children):
            if j is not None:
                merged += self.children[i:j]
                i = j + 1
                if k is not None:
                    self.children[j].add(other.children[k])
                merged.append(self.children[j])
            else:
                merged.append(other.children[k])
        self.children = merged + self.children[i:]

    def dump(self) -> list:
        return [self.label, self.count, [c.dump() for c in self.children]]

    @classmethod
    def load(cls, x: list) -> Node:
        return cls(x[0], x[1], [cls.load(c) for c in x[2]])


def likeness(a: Node, b: Node) -> int:
    """Nodes that the best alignment of two trees matches (simple tree matching)."""
    if a.label != b.label:
        return 0
    best = [0] * (len(b.children) + 1)
    for x in a.children:
        row = [0]
        for j, y in enumerate(b.children):
            row.append(max(best[j + 1], row[j], best[j] + likeness(x, y)))
        best = row
    return 1 + best[-1]


def align(left: list[Node], right: list[Node]) -> list[tuple[int | None, int | None]]:
    """Pairs of positions of the best alignment in order; None stands for a node that only the other side has."""
    if [x.label for x in left] == [y.label for y in right] and len({x.label for x in left}) == len(left):
        return [(i, i) for i in range(len(left))]
    table = [[0] * (len(right) + 1)]
    gain = [[likeness(x, y) for y in right] for x in left]
    for i in range(len(left)):
        row = [0]
        for j in range(len(right)):
            row.append(max(table[i][j + 1], row[j], table[i][j] + gain[i][j]))
        table.append(row)
    i, j, out = len(left), len(right), []
    while i or j:
        if i and j and gain[i - 1][j - 1] and table[i][j] == table[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and table[i][j] == table[i - 1][j]:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def text_hash(text: str) -> int:
    """A hash whose lowest 16 bits are the text's length, as far as they go."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 16 | min(len(text), 0xFFFF)


def tree(found: list[Block]) -> Node:
    """The page's tree of blocks; siblings with one label are one node."""
    root = Node("")
    at: dict[tuple[str, ...], Node] = {(): root}
    for b in found:
        for d in range(1, len(b.path) + 1):
            path = b.path[:d]
            if path not in at:
                at[path] = Node(path[-1])
                at[path[:-1]].children.append(at[path])
    return root


@lru_cache(10_000)
def slot_hash(path: tuple[str, ...]) -> int:
    return text_hash("/".join(path))


@lru_cache(10_000)
def slots_above(path: tuple[str, ...]) -> frozenset[int]:
    return frozenset(slot_hash(path[:i]) for i in range(len(path) + 1))


def content(found: list[Block], region: int | None = None) -> list[Block]:
    """The blocks in the host's content region, if the page has any; of these or else all, those in an article or main element, if there are any."""
    inside = [b for b in found if region in slots_above(b.path)] if region is not None else []
    found = inside or found
    return [b for b in found if b.root] if any(b.root for b in found) else found


def whole_hash(found: list[Block]) -> int:
    return text_hash("\n".join(b.text for b in found))


def keys(found: list[Block]) -> set[tuple[int, int]]:
    """Slot and text, by hash, of each block, and of the whole content at WHOLE_SLOT; a text counts once for a page and slot."""
    return {(slot_hash(b.path), text_hash(b.text)) for b in found} | {(WHOLE_SLOT, whole_hash(content(found)))}


def region_of(root: Node, mass: dict[int, int], most: float = 0.6) -> int:
    """The slot below which the host's pages differ: from the root on, the child that holds most of the different texts, as long as it is no mere text.

    mass: characters of the different texts of each slot, but for the template's. Headings beside the slot so found belong to it, and so does the
    rest of the article or main element around it.
    """
    below: dict[tuple[str, ...], set[str]] = {}

    def walk(node: Node, path: tuple[str, ...]) -> None:
        for c in node.children:
            below.setdefault(path, set()).add(c.label)
            walk(c, (*path, c.label))

    walk(root, ())
    totals: dict[tuple[str, ...], int] = {}

    def total(path: tuple[str, ...]) -> int:
        totals[path] = mass.get(slot_hash(path), 0) + sum(total((*path, x)) for x in below.get(path, ()))
        return totals[path]

    total(())
    path: tuple[str, ...] = ()
    while below.get(path):
        best = max(sorted(below[path]), key=lambda x: totals[(*path, x)])
        own = (*path, best)
        if own not in below or not totals[own] or totals[own] < most * totals[path]:
            break
        path = own
    kind = lambda x: x.split(" ")[0]
    while path and any(kind(x) in HEADINGS for x in below[path[:-1]]):
        path = path[:-1]
    around = [i for i, x in enumerate(path) if kind(x) in ROOTS]
    return slot_hash(path[: around[0] + 1] if around else path)


def slots(root: Node, share: float) -> list[int]:
    """The slots that at least that share of the host's pages have; nodes of one path count together."""
    counts: dict[tuple[str, ...], int] = {}

    def walk(node: Node, path: tuple[str, ...]) -> None:
        for c in node.children:
            own = (*path, c.label)
            counts[own] = counts.get(own, 0) + c.count
            walk(c, own)

    walk(root, ())
    counts[()] = root.count
    return sorted({WHOLE_SLOT} | {slot_hash(p) for p, n in counts.items() if n >= share * root.count})


def main_text(page: str | None, constant: frozenset[str] | set[str] = frozenset(), region: int | None = None) -> tuple[str, str]:
    """The text, and what told content from the rest: the host's `wrapper`, or only `elements`."""
    every = blocks(page) if page else []
    found = content(every, region)
    rule = "wrapper" if region is not None and any(region in slots_above(b.path) for b in every) else "elements"
    if constant and f"{WHOLE_SLOT}|{whole_hash(content(every))}" not in constant:
        found = [b for b in found if f"{slot_hash(b.path)}|{text_hash(b.text)}" not in constant]
    return "\n".join(b.text for b in found), rule


def templates(pages: DataFrame, least_pages: int = 3, share: float = 0.6, url: str = "url", html: str = "html") -> DataFrame:
    """host, its content region and its constant texts, a row for each host with enough pages."""
    named = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Node] = {}
        counts: dict[tuple[str, int, int], int] = {}

        def send() -> pa.RecordBatch:
            hosts, slot, text = zip(*counts, strict=True) if counts else ((), (), ())
            none = [None] * len(trees)
            columns = [pa.array([*trees, *hosts], pa.string()), pa.array([json.dumps(t.dump()) for t in trees.values()] + [None] * len(hosts), pa.string())]
            columns += [pa.array([*none, *x], pa.int64()) for x in (slot, text, counts.values())]
            return pa.RecordBatch.from_arrays(columns, names=["host", "tree", "slot", "text", "n"])

        for batch in slices(batches, "html"):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = blocks(page or "")
                if not found:
                    continue
                own = tree(found)
                if host in trees:
                    trees[host].add(own)
                else:
                    trees[host] = own
                for slot, text in keys(found):
                    counts[host, slot, text] = counts.get((host, slot, text), 0) + 1
            if len(trees) > 5000 or len(counts) > 200_000:  # what is in hand is bounded; what is sent is put together later
                yield send()
                trees.clear()
                counts.clear()
        if trees:
            yield send()

    def merge(frame: pd.DataFrame, masses: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for x in frame["tree"].sort_values():
            own = Node.load(json.loads(x))
            if whole is None:
                whole = own
            else:
                whole.add(own)
        if whole is None or whole.count < least_pages:
            return pd.DataFrame({"host": [], "pages": [], "slot": [], "region": []}, dtype=object)
        region = region_of(whole, dict(zip(masses["slot"], masses["mass"], strict=True)))
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "pages": [whole.count], "slot": [slots(whole, share)], "region": [region]})

    partial = written(mapped(named, learn, "host string, tree string, slot long, text long, n long"))
    texts = written(partial.filter("tree is null").groupBy("host", "slot", "text").agg(F.sum("n").alias("n")))
    # each page has one text at WHOLE_SLOT
    sizes = texts.filter(F.col("slot") == WHOLE_SLOT).groupBy("host").agg(F.sum("n").alias("pages"))
    constant = (F.col("n") >= least_pages) & (F.col("n") >= share * F.col("pages"))
    masses = written(texts.filter(F.col("slot") != WHOLE_SLOT).join(sizes, "host").filter(~constant).groupBy("host", "slot").agg(F.sum(F.col("text").bitwiseAND(0xFFFF)).alias("mass")))
    trees = partial.filter("tree is not null").select("host", "tree").groupBy("host")
    hosts = written(trees.cogroup(masses.groupBy("host")).applyInPandas(merge, "host string, pages long, slot array<long>, region long"))
    # most texts stand on one page, so few are left before the joins
    counts = texts.filter(F.col("n") >= least_pages)
    found = counts.join(hosts.select("host", F.explode("slot").alias("slot"), "pages"), ["host", "slot"]).filter(F.col("n") >= share * F.col("pages"))
    constant = found.groupBy("host").agg(F.sort_array(F.collect_list(F.concat_ws("|", "slot", "text"))).alias("constant"))
    return hosts.select("host", "region").join(constant, "host", "left")


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least_pages: int = 3, share: float = 0.6, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text, n_chars of each page, and `rule`: what told content from the rest, the host's `wrapper` or, on hosts with few pages, `elements`."""
    learned = written(templates(pages, least_pages, share, url, html))
    width = learned.agg(F.sum(F.octet_length("host") + 64 + F.coalesce(F.octet_length(F.concat_ws("", "constant")), F.lit(0)))).first()[0]
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), F.col(html).alias("html"))
    joined = named.join(F.broadcast(learned) if (width or 0) <= broadcast_bytes else learned, "host", "left").select("page_id", "url", "html", "constant", "region")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("rule", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, ...], frozenset[str]] = {}
        for batch in slices(batches, "html"):
            texts, rules = [], []
            for page, own, region in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                key = tuple(own or ())
                if key not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[key] = frozenset(key)
                text, rule = main_text(page, seen[key], region)
                texts.append(text)
                rules.append(rule)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(rules, pa.string())], names=schema.names)

    return mapped(joined, run, schema)
