"""Main text of web pages by wrapper induction.

Pages become trees of blocks, the whole page with its menus and footers. Pages of one host are aligned with a seed page by
simple tree matching; a block whose text most of them repeat at the same aligned place is template, what varies is a slot.
The slots' text then shows where the host keeps its content: the deepest container that every page has once and that holds
half of all varying text is its region, and slots outside of it (menus, adverts, sidebars, footers with changing words) go too.
Only what is left inside the region is judged by what HTML calls it (nav, aside, form, a class `comments`).

Hosts are split into salted groups of about GROUP distinct pages, each aligned with its own seed; the groups'
counts merge by text and the path of labels, which doesn't depend on a seed, so that no task holds a large host.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stored, table
from .words import slices

GROUP, LEAST_PAGES, LEAST_PART = 64, 4, 0.5
REGION, ONCE = 0.5, 1.2  # a region's share of a host's varying text, and how often a page has it at most, on average
SMALL = 100_000  # wrappers of up to so many texts are broadcast; beyond, they are joined by host
DEPTH, OPEN = 200, 512  # levels of a block tree, and of open elements in a page; deeper ones count to the last level
LONG = 1 << 20  # pairs of children beyond which only equal subtrees are aligned, in the longest common order

# Elements, roles and class names by their meaning in HTML.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("html body main article section div center table tbody tr td header hgroup form fieldset details".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
UNSEEN = frozenset("head script style noscript template iframe button select textarea svg canvas object title xmp noembed noframes".split())
APART = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
CLASSES = frozenset("ad ads advert adverts advertisement sponsored promo banner cookie cookies consent notice comment comments sidebar menu navbar nav navigation breadcrumb breadcrumbs footer newsletter subscribe related social popup modal".split())
COMPOUND = frozenset("ad ads advert cookie comment comments sidebar footer nav menu newsletter".split())  # also as a part: comment-list
FRAMES = frozenset("html body main article".split())  # never boilerplate; their classes often name the page
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# every alternative is possessive and ends at the page's end at the latest, so that a page is read once whatever it holds
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "items", "label")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items, self.label = tag, attrs, [], tag


def parse(page: str) -> Node:
    """The element tree; texts are strings among the items, character references decoded. A tag that the page's end cuts off is no text."""
    root = Node("#root", {})
    stack = [root]
    opened: dict[str, int] = {}

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].items.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].items.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag not in BLOCKS and stack[i].tag in BLOCKS:
                        break  # a stray inline end tag closes no block
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if open_tag == "p" or open_tag in CLOSES.get(tag, ()):
                    close(i)
                    break
                if open_tag in BLOCKS:
                    break
        node = Node(tag, {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTR.findall(m[3])} if m[3] else {})
        stack[-1].items.append(node)
        if tag in RAW:
            shut = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end if shut is None else page.find(">", shut.start()) + 1 or end
        elif (tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCKS and tag != "hr") and len(stack) < OPEN:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def unseen(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or bool(a) and node.tag not in FRAMES and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(a.get("style", ""))))


def apart(node: Node, in_article: bool) -> bool:
    """Whether HTML sets the element apart from the text around it: by its tag, its role or a whole word of its class."""
    if node.tag in APART or node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in FRAMES:
        return False
    if node.attrs.get("role", "").lower() in ROLES:
        return True
    for word in node.attrs.get("class", "").lower().split():
        parts = re.split("[-_]+", word)
        if word in CLASSES or parts[0] in COMPOUND or parts[-1] in COMPOUND:
            return True
    return False


def label_of(node: Node) -> str:
    """Tag, class and id as a step of a path; numbers of two digits or more are one, long names a hash."""
    if node.tag in FRAMES:
        return f"{node.tag}."
    name = " ".join([*node.attrs.get("class", "").split(), *(f"#{x}" for x in node.attrs.get("id", "").split())])
    name = re.sub(r"\d\d+", "0", name).replace("/", "|")
    return f"{node.tag}.{name if len(name) <= 32 else xxhash.xxh32_hexdigest(name)}"


def block_tree(node: Node) -> Node:
    """The page's blocks as a tree: elements by label, leaves `#` whose items are the one text and whether it is set apart."""
    out = Node("#region", {})
    # (source, target, whether it is a block, whether in an article, whether apart); text runs gather until a block starts or ends
    stack: list = [(iter(node.items), out, True, False, False)]
    run: list[str] = []

    def flush(target: Node, aside: bool) -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            leaf = Node("#", {})
            leaf.items += [text, aside]
            target.items.append(leaf)

    while stack:
        items, target, block, in_article, aside = stack[-1]
        x = next(items, None)
        if x is None:
            stack.pop()
            if block:
                flush(target, aside)
        elif isinstance(x, str):
            run.append(x)
        elif unseen(x):
            if x.tag in BLOCKS:
                flush(target, aside)
        elif x.tag in BLOCKS:
            flush(target, aside)
            within, own = in_article or x.tag in ("main", "article"), aside or apart(x, in_article)
            if len(stack) < DEPTH:
                new = Node(x.tag, {})
                new.label = label_of(x)
                target.items.append(new)
                stack.append((iter(x.items), new, True, within, own))
            else:
                stack.append((iter(x.items), target, True, within, own))
        else:
            if x.tag == "br":
                run.append(" ")
            stack.append((iter(x.items), target, False, in_article, aside))
    return out


def leaves(tree: Node) -> Iterator[tuple[str, str, bool]]:
    """(text, path of labels, whether set apart) in page order."""
    todo = [(tree, "")]
    while todo:
        x, path = todo.pop()
        if x.tag == "#":
            yield x.items[0], f"{path}/#", x.items[1]
        else:
            todo.extend((y, path if y.tag == "#" else f"{path}/{y.label}") for y in reversed(x.items))


def boxes(tree: Node) -> dict[str, int]:
    """How many containers within containers only there are by path."""
    out: dict[str, int] = {}
    todo = [(tree, "")]
    while todo:
        x, path = todo.pop()
        for y in x.items:
            if y.tag in CONTAINERS:
                here = f"{path}/{y.label}"
                out[here] = out.get(here, 0) + 1
                todo.append((y, here))
    return out


def page_tree(page: str) -> Node:
    return block_tree(parse(page))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def slot(path: str, text: int) -> int:
    """A text at a path of labels."""
    return _digest(f"{text} {path}")


# --- simple tree matching over serialised trees: [label, child, ...]; a leaf is its text's digest


def serialise(node: Node) -> list | int:
    if node.tag == "#":
        return _digest(node.items[0])
    return [node.label, *map(serialise, node.items)]


def common_order(xs: tuple, ys: tuple) -> list[tuple[int, int]]:
    """The longest order-keeping pairs of equal items that both sides have once."""
    def once(items: tuple) -> dict:
        at: dict = {}
        for i, x in enumerate(items):
            at[x] = -1 if x in at else i
        return at

    a, b = once(xs), once(ys)
    pairs = sorted((i, b[x]) for x, i in a.items() if i >= 0 and b.get(x, -1) >= 0)
    tails: list[int] = []
    ends: list[int] = []
    back = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at:at + 1], ends[at:at + 1] = [j], [k]
        back.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Matcher:
    """Simple tree matching: the largest order-keeping matching of two trees whose matched nodes' parents match.

    Subtrees of equal shape are matched whole; scores are kept by pairs of shapes. Of the largest matchings,
    texts() takes one with the most equal texts: a matched node counts TEXTS, and a leaf of equal text 1 more.
    """

    TEXTS = 1 << 24

    def __init__(self) -> None:
        self.shapes: dict = {}
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}
        self.kids: list[tuple] = []
        self.labels: list = []
        self.trees: dict = {}
        self.shape_of: list[int] = []
        self.held: list[frozenset[int]] = []  # digests of a tree's texts
        self.full: list[int] = []  # score of a tree with itself
        self.parts: list[tuple] = []
        self.tree_scores: dict[tuple[int, int], int] = {}

    def shape(self, t) -> int:
        return self.shape_from("#" if isinstance(t, int) else t[0], () if isinstance(t, int) else tuple(map(self.shape, t[1:])))

    def shape_from(self, label: str, kids: tuple) -> int:
        key = (label, kids)
        if key not in self.shapes:
            self.shapes[key] = len(self.sizes)
            self.sizes.append(1 + sum(self.sizes[k] for k in kids))
            self.kids.append(kids)
            self.labels.append(label)
        return self.shapes[key]

    def score(self, a: int, b: int) -> int:
        if a == b:
            return self.sizes[a]
        if self.labels[a] != self.labels[b]:
            return 0
        if (a, b) not in self.scores:
            self.scores[a, b] = 1 + self.align(self.kids[a], self.kids[b])[0]
        return self.scores[a, b]

    def align(self, xs: tuple, ys: tuple) -> tuple[int, list[tuple[int, int]]]:
        """Best total and pairs (i, j) of children; equal ends are matched first, which loses nothing."""
        head, total, pairs = 0, 0, []
        while head < min(len(xs), len(ys)) and xs[head] == ys[head]:
            total += self.sizes[xs[head]]
            pairs.append((head, head))
            head += 1
        tail = 0
        while tail < min(len(xs), len(ys)) - head and xs[-1 - tail] == ys[-1 - tail]:
            total += self.sizes[xs[-1 - tail]]
            tail += 1
            pairs.append((len(xs) - tail, len(ys) - tail))
        n, m = len(xs) - head - tail, len(ys) - head - tail
        if n * m > LONG:
            found = common_order(xs[head : len(xs) - tail], ys[head : len(ys) - tail])
            total += sum(self.sizes[xs[head + i]] for i, _ in found)
            pairs += [(head + i, head + j) for i, j in found]
        elif n and m:
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n):
                for j in range(m):
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + self.score(xs[head + i], ys[head + j]))
            total += best[n][m]
            i, j = n, m
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((head + i, head + j))
        return total, pairs

    def numbered(self, t) -> tuple:
        """(number, label or digest, children) of a tree with its texts; equal trees have one number."""
        leaf = isinstance(t, int)
        kids = () if leaf else tuple(map(self.numbered, t[1:]))
        head, parts = t if leaf else t[0], tuple(k[0] for k in kids)
        number = self.trees.get((head, parts))
        if number is None:
            number = self.trees[head, parts] = len(self.full)
            self.shape_of.append(self.shape_from("#" if leaf else head, tuple(self.shape_of[k] for k in parts)))
            self.held.append(frozenset([t]) if leaf else frozenset().union(*(self.held[k] for k in parts)))
            self.full.append(self.TEXTS + (1 if leaf else sum(self.full[k] for k in parts)))
            self.parts.append(parts)
        return number, head, kids

    def tree_score(self, a: int, b: int) -> int:
        if a == b:
            return self.full[a]
        x, y = self.shape_of[a], self.shape_of[b]
        if self.labels[x] != self.labels[y] or self.held[a].isdisjoint(self.held[b]):
            return self.TEXTS * self.score(x, y)
        if (a, b) not in self.tree_scores:
            self.tree_scores[a, b] = self.TEXTS + self.align_trees(self.parts[a], self.parts[b])[0]
        return self.tree_scores[a, b]

    def align_trees(self, xs: tuple, ys: tuple) -> tuple[int, list[tuple[int, int]]]:
        """As align(), by tree_score(): only equal trees are matched at the ends, as they alone have no better partner."""
        head, shorter = 0, min(len(xs), len(ys))
        while head < shorter and xs[head] == ys[head]:
            head += 1
        tail = 0
        while tail < shorter - head and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        n, m = len(xs) - head - tail, len(ys) - head - tail
        pairs = [(i, i) for i in range(head)] + [(len(xs) - i, len(ys) - i) for i in range(1, tail + 1)]
        if n * m > LONG:
            pairs += [(head + i, head + j) for i, j in common_order(xs[head : len(xs) - tail], ys[head : len(ys) - tail])]
            n = 0
        total = sum(self.full[xs[i]] for i, _ in pairs)
        if n and m:
            best = np.zeros((n + 1, m + 1), np.int64)
            for i in range(n):
                gain = np.array([self.tree_score(xs[head + i], y) for y in ys[head : head + m]], np.int64)
                best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + gain))
            total += int(best[n, m])
            i, j = n, m
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((head + i, head + j))
        return total, pairs

    def texts(self, seed: tuple, page: tuple, place: str = "", path: str = "") -> Iterator[tuple[str, str, int]]:
        """(place in the seed, path of labels, digest of the page's text) of matched leaves of numbered trees."""
        for i, j in self.align_trees(self.parts[seed[0]], self.parts[page[0]])[1]:
            x, y = seed[2][i], page[2][j]
            if isinstance(x[1], int) and isinstance(y[1], int):
                yield f"{place}/{i}", f"{path}/#", y[1]
            elif x[1] == y[1]:
                yield from self.texts(x, y, f"{place}/{i}", f"{path}/{x[1]}")


def wrap(trees: list) -> list[tuple[int, int, int]]:
    """(slot, pages that repeat the text there, pages aligned there) of a group of serialised trees.

    The seed is the tree of median size. A slot's path has labels only, so that it is the same from any seed; aligned are
    the pages that have something at a place of the seed where the text is. Texts that one page has are left out.
    """
    seed = sorted(trees, key=lambda t: (len(str(t)), str(t)))[len(trees) // 2]
    m = Matcher()
    same: dict[tuple[str, int], set[int]] = {}
    places: dict[tuple[str, int], set[str]] = {}
    aligned: dict[str, set[int]] = {}
    first = m.numbered(seed)
    for k, t in enumerate(trees):
        for place, path, text in m.texts(first, m.numbered(t)):
            same.setdefault((path, text), set()).add(k)
            places.setdefault((path, text), set()).add(place)
            aligned.setdefault(place, set()).add(k)
    return [(slot(path, text), len(of), len(set().union(*(aligned[p] for p in places[path, text])))) for (path, text), of in same.items() if len(of) > 1]


LEAVES = "texts array<string>, paths array<string>, slots array<long>, sizes array<int>, aparts array<boolean>, boxes array<string>, counts array<int>"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, tree, h, LEAVES): every page parsed once. Pages without a host share the host ''."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    strings, longs, ints, flags = pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, "html"):
            trees, hashes, cols = [], [], []
            for t in texts:
                tree = page_tree(t.decode("utf-8", "replace"))
                trees.append(json.dumps(serialise(tree), separators=(",", ":")))
                hashes.append(_digest(trees[-1]))
                found, box = list(leaves(tree)), boxes(tree)
                cols.append(([x[0] for x in found], [x[1] for x in found], [slot(p, _digest(x)) for x, p, _ in found], [len(x[0]) for x in found], [x[2] for x in found], list(box), list(box.values())))
            made = [pa.array(c, k) for c, k in zip(zip(*cols), (strings, strings, longs, ints, flags, strings, ints))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), pa.array(trees, pa.string()), pa.array(hashes, pa.int64()), *made], names=["page_id", "url", "host", "tree", "h", *LEAVES.replace(",", "").split()[::2]])

    return bounded(rows).mapInArrow(run, f"page_id {kind}, url string, host string, tree string, h long, {LEAVES}")


def template(found: DataFrame) -> DataFrame:
    """(host, slot) of the template's texts, from all distinct pages of parsed()."""
    trees = stored(found.select("host", "h", "tree").dropDuplicates(["host", "h"]))
    sizes = stored(trees.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES))  # stored, so that the join can split a hot host
    dealt = trees.join(sizes, "host").withColumn("salt", F.pmod(F.col("h"), F.ceil(F.col("n") / GROUP).cast("long")))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        # should two hosts share a group's hash, each is still wrapped by itself
        parts = [pd.DataFrame(wrap([json.loads(t) for t in x["tree"]]), columns=["slot", "same", "aligned"]).assign(host=h, pages=len(x)) for h, x in pdf.groupby("host")]
        return pd.concat(parts)

    # one key, not two: rows dealt by host for the join above would pass as dealt by host and salt
    counts = dealt.select("host", F.xxhash64("host", "salt").alias("group"), "tree").groupBy("group").applyInPandas(group, "slot long, same long, aligned long, host string, pages long")
    merged = counts.groupBy("host", "slot").agg(F.sum("same").alias("same"), F.sum("aligned").alias("aligned"), F.sum("pages").alias("pages"))
    kept = merged.join(sizes, "host").filter((F.col("same") >= LEAST_PAGES) & (F.col("same") >= LEAST_PART * F.col("aligned")) & (F.col("same") >= LEAST_PART * F.col("pages")) & (F.col("same") >= 0.2 * F.col("n")))
    return kept.select("host", "slot")


def regions(found: DataFrame, templates: DataFrame, hints: bool = True) -> DataFrame:
    """(host, region): path of the container of the host's content. Text that is template or set apart has no say.

    A region and all around it are containers that a page has once; it is the deepest with REGION of the text, but never
    leaves a first heading (h1) out.
    """
    each = found.select("host", F.explode(F.arrays_zip("paths", "slots", "sizes", "aparts")).alias("x")).select("host", F.col("x.paths").alias("path"), F.col("x.slots").alias("slot"), F.col("x.sizes").alias("size"), F.col("x.aparts").alias("apart"))
    varying = (each.filter("not apart") if hints else each).groupBy("host", "path", "slot").agg(F.sum("size").alias("size"))
    varying = varying.join(templates, ["host", "slot"], "left_anti").groupBy("host", "path").agg(F.sum("size").alias("size"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("box"), F.element_at(parts, i + 1).startswith("h1.").alias("h1")))
    volume = varying.filter(F.size(parts) > 2).select("host", "size", F.explode(above).alias("a")).groupBy("host", F.col("a.box").alias("box")).agg(F.sum("size").alias("size"), F.sum(F.when(F.col("a.h1"), F.col("size")).otherwise(0)).alias("h1"))
    total = varying.groupBy("host").agg(F.sum("size").alias("total"))
    box = found.select("host", F.explode(F.arrays_zip("boxes", "counts")).alias("x")).groupBy("host", F.col("x.boxes").alias("box")).agg(F.sum("x.counts").alias("n"), F.count("*").alias("pages"))
    able = volume.join(box, ["host", "box"]).join(total, "host").filter((F.col("size") >= REGION * F.col("total")) & (F.col("n") <= ONCE * F.col("pages")))
    place = F.struct(F.size(F.split("box", "/")).alias("depth"), "box")
    return able.groupBy("host").agg(F.coalesce(F.min(F.when(F.col("h1") > 0, place)), F.max(place))["box"].alias("region"))


def extract(pages: DataFrame, hints: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    Character references are decoded, white space within a block is one space, blocks are joined by a newline in page
    order. A null or empty html has an empty text; pages whose url is null or has no host form one host; equal
    pages count once for the template; repeated rows stay; an empty table gives no rows; other columns
    are ignored. Hosts of fewer than LEAST_PAGES distinct pages have no template, only a region. A page without its
    host's region is judged as a whole. Any text is read once from start to end; a page with very many
    children in one element is aligned by equal subtrees. Without `hints` induction alone decides.
    """
    found = stored(parsed(pages))
    slots = stored(template(found))
    wrappers = regions(found, slots, hints).join(slots.groupBy("host").agg(F.collect_list("slot").alias("known")), "host", "full")
    wrappers = stored(wrappers.withColumnRenamed("host", "__host"))
    size = wrappers.agg(F.coalesce(F.sum(F.coalesce(F.size("known"), F.lit(0)) + 1), F.lit(0))).first()[0]
    joined = found.join(F.broadcast(wrappers) if size <= SMALL else wrappers, F.col("host") == F.col("__host"), "left")
    within = lambda p: p.startswith(F.concat(F.coalesce("region", F.lit("")), F.lit("/")))
    here = F.exists("paths", within)
    stays = lambda x: ~(x["aparts"] & F.lit(hints)) & ~F.coalesce(F.array_contains("known", x["slots"]), F.lit(False)) & (~F.col("here") | within(x["paths"]))
    kept = joined.withColumn("here", here).select("page_id", "url", F.array_join(F.transform(F.filter(F.arrays_zip("texts", "paths", "slots", "aparts"), stays), lambda x: x["texts"]), "\n").alias("text"))
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
