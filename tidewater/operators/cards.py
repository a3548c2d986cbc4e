"""Context cards: what a section fixed for later ones, shrunk to a bound, scored, chosen under a budget and written out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.text import clip, numbers_with_units, pipe_cells, trim, units16
from tidewater.session import cut

from .order import positions

MOST, BUDGET = 700, 6000  # characters of a card and of all cards of a section
# Words of lines that name something, and the text above the cards.
NAMES = "비전|목표|추진전략|전략|중점|세부사업|사업명|사업|과제|지표"
HEADER = (
    "[앞서 작성한 절의 결정 사항]",
    "※ 이 계획서의 앞선 절에서 이미 확정한 내용이다. 비전·전략 이름·사업명·수치를 여기에",
    "   맞춰 쓴다. 달리 써야 할 이유가 있으면 그 이유를 본문에 밝힌다. 아래 내용을 그대로",
    "   옮겨 적지는 말고, 이 절이 맡은 몫만 쓴다.",
    "",
)
HEADER_SIZE = len("\n".join(HEADER)) + 1
# How many numbers, points, tables and names stay after each step of shrinking; None is all.
STEPS = (
    (12, 8, 4, 12), (6, 8, 4, 12), (6, 5, 4, 12), (3, 5, 4, 12), (3, 5, 2, 12), (3, 3, 2, 12), (3, 3, 2, 8), (3, 3, 1, 8), (3, 1, 1, 8), (0, 1, 1, 8), (0, 1, 1, 5), (0, 0, 1, 5),
    (0, 0, 1, 4), (0, 0, 1, 3), (0, 0, 1, 2), (0, 0, 1, 1),
)


def chapter(section: Column) -> Column:
    """Chapter of a section id: 03-a-1 is in 03."""
    return F.substring_index(section, "-", 1)


def _first(a: Column, n: int) -> Column:
    """The first n distinct texts that aren't empty."""
    return F.slice(F.array_distinct(F.filter(a, lambda x: x != "")), 1, n)


def cards(texts: DataFrame, key: str, no: str, title: str, text: str) -> DataFrame:
    """(key, no, title, heads, points, names, tables, numbers) of each marked-up text, shrunk to MOST characters.

    Headings and lines with bullets ○ and ◆ are points; lines with a word of NAMES are names, and first cells of tables with
    one too. Notes, widths of columns and places of figures are passed over. A blank line doesn't end a table.
    """
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("ln", "line")).withColumn("line", trim(F.col("line")))
    passed = F.col("line").rlike(r"^\{cols=[\d,.\s]+\}$|^\[\[도식:[^\]]+\]\]$") | (F.col("line") == "")
    row = F.col("line").rlike(r"^\|(.+)\|$")
    lines = lines.filter(~passed).withColumn("_row", row)
    lines = lines.withColumn("_tab", F.sum(F.when(F.col("_row"), 0).otherwise(1)).over(W.partitionBy(key).orderBy("ln")))

    rows = lines.filter(F.col("_row") & ~F.col("line").rlike(r"(?U)^\|[\s|:-]+\|$")).select(key, "_tab", "ln", pipe_cells(F.col("line")).alias("cells"))
    each = rows.groupBy(key, "_tab").agg(F.min_by("cells", "ln").alias("head"), F.sort_array(F.collect_list(F.struct("ln", F.col("cells")[0].alias("first")))).alias("body"))
    first = F.transform(_first(F.transform(F.slice("body", 2, F.greatest(F.size("body"), F.lit(1))), lambda x: x["first"]), 6), lambda v: clip(v, 20))
    table = F.struct("_tab", F.filter(F.transform("head", lambda h: clip(h, 24)), lambda h: h != "").alias("header"), F.size("head").alias("cols"), first.alias("first"))
    tables = each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(table)), lambda t: t.dropFields("_tab")).alias("tables"))

    plain = lines.filter(~F.col("_row"))
    head, bullet = r"^#{1,4}\s+(.+)$", r"^([○▪◆◎▶·]|-)\s+(.+)$"
    is_head, is_note = F.col("line").rlike(head), F.col("line").rlike(r"^※\s*(.+)$")
    body = F.when(is_head, F.regexp_extract("line", head, 1)).when(F.col("line").rlike(bullet), F.regexp_extract("line", bullet, 2)).otherwise(F.col("line"))
    kind = F.when(is_head, "head").when(is_note, "note").when(F.col("line").rlike(r"^[○◆]\s+(.+)$"), "point").otherwise("text")
    plain = plain.select(key, "ln", kind.alias("kind"), body.alias("body")).filter("kind <> 'note'")
    listed = lambda when, n: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("ln", clip(F.col("body"), n).alias("t"))))), lambda x: x["t"])
    found = plain.groupBy(key).agg(listed(F.col("kind") == "head", 60).alias("heads"), listed(F.col("kind") == "point", 110).alias("points"), listed(F.col("body").rlike(NAMES), 60).alias("names"))

    out = texts.select(key, no, title, numbers_with_units(F.coalesce(text, F.lit(""))).alias("numbers")).join(found, key, "left").join(tables, key, "left")
    none, no_table = F.array().cast("array<string>"), F.array().cast("array<struct<header:array<string>,cols:int,first:array<string>>>")
    out = out.withColumns({**{c: F.coalesce(c, none) for c in ("heads", "points", "names")}, "tables": F.coalesce("tables", no_table)})
    in_cells = F.filter(F.flatten(F.transform("tables", lambda t: t["first"])), lambda v: v.rlike(NAMES))
    out = out.select(key, no, title, _first(F.col("heads"), 10).alias("heads"), _first(F.col("points"), 8).alias("points"), _first(F.concat("names", in_cells), 12).alias("names"), F.slice("tables", 1, 4).alias("tables"), _first(F.col("numbers"), 12).alias("numbers"))
    return trimmed(out, key, no, title)


def card_text(key: Column, no: Column, title: Column, names: Column, points: Column, tables: Column, numbers: Column) -> Column:
    """A card in lines: its section, fixed names, points, tables and numbers."""
    label = F.array_join(F.filter(F.array(no, title), lambda x: x.isNotNull() & (x != "")), " ")
    some = lambda a, text: F.when(F.size(a) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.concat(F.lit("◆ "), label, F.lit(" ("), key.cast("string"), F.lit(")"))), some(names, F.concat(F.lit("  - 확정된 이름: "), F.array_join(names, " / "))),
        F.transform(points, lambda p: F.concat(F.lit("  - "), p)), F.transform(tables, table_line), some(numbers, F.concat(F.lit("  - 수치: "), F.array_join(numbers, ", "))),
    )
    return F.array_join(lines, "\n")


def table_line(t: Column) -> Column:
    first = F.when(F.size(t["first"]) > 0, F.concat(F.lit(" (첫 칸: "), F.array_join(t["first"], ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("  - 표 "), t["cols"].cast("string"), F.lit("열: "), F.array_join(t["header"], " | "), first)


def trimmed(found: DataFrame, key: str, no: str, title: str, most: int = MOST) -> DataFrame:
    """The cards after as many of STEPS as it takes to have `most` characters at most; the last step's where none is enough.

    A card's size is that of its head and of the items that each list keeps, so sizes are added up from the items' and no
    card is written to be measured.
    """
    names = ("numbers", "points", "tables", "names")
    none = F.array().cast("array<string>")
    head = units16(card_text(F.col(key), F.col(no), F.col(title), none, none, F.slice("tables", 1, 0), none))
    sizes = found.withColumns({f"_{c}": F.transform(c, (lambda x: units16(table_line(x))) if c == "tables" else units16) for c in names} | {"_head": head})
    # a list in one line has what stands before it and between its items; others have a line each
    one_line = {"names": ("  - 확정된 이름: ", " / "), "numbers": ("  - 수치: ", ", ")}

    def size(c: str, n: int) -> Column:
        k = F.least(F.size(f"_{c}"), F.lit(n))
        total = F.aggregate(F.slice(f"_{c}", 1, n), F.lit(0), lambda x, y: x + y)
        if c in one_line:
            before, between = one_line[c]
            return F.when(k > 0, total + 1 + len(before) + len(between) * (k - 1)).otherwise(0)
        return total + k * (1 if c == "tables" else 1 + len("  - "))

    cuts = {(c, s[i]) for s in STEPS for i, c in enumerate(names)}
    sizes = sizes.withColumns({f"_{c}_{n}": size(c, n) for c, n in sorted(cuts)})
    chosen = None
    for s in STEPS[:-1]:
        fits = F.col("_head") + sum((F.col(f"_{c}_{n}") for c, n in zip(names, s)), F.lit(0)) <= most
        kept = F.struct(*[F.lit(n).alias(c) for c, n in zip(names, s)])
        chosen = F.when(fits, kept) if chosen is None else chosen.when(fits, kept)
    last = F.struct(*[F.lit(n).alias(c) for c, n in zip(names, STEPS[-1])])
    out = sizes.withColumn("_s", chosen.otherwise(last))
    # one after the other: a new column beside a lambda could be taken for the old one
    return out.select(*[F.slice(c, F.lit(1), F.col("_s")[c]).alias(c) if c in names else F.col(c) for c in found.columns])


def merged(cards: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The cards with new ones in the place of those of equal key, and the others of them behind, in their own order; of several new cards of a key the last counts."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("_new"), F.min(order).alias("_first"))
    added = positions(last.join(cards.select(key), key, "left_anti"), "_first", key, name="_behind").select(key, "_new", "_behind")
    top = cards.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_top"))
    values = [c for c in cards.columns if c not in (key, order)]
    kept = cards.join(last.select(key, "_new"), key, "left")
    kept = kept.select(key, order, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values])
    behind = added.crossJoin(F.broadcast(top))  # one row
    kind = dict(cards.dtypes)[order]
    return kept.union(behind.select(key, (F.col("_top") + F.col("_behind") + 1).cast(kind).alias(order), *[F.col(f"_new.{c}").alias(c) for c in values]))


def score(target: str = "t", card: str = "c") -> Column:
    """0 for the target itself and for later cards; 10, +100 for its mirror, +60 in the first chapter, +40 in its own chapter,
    +30 just before it, and up to 20 for nearness. Aliases need id, ord, chapter; the target mirrors too."""
    t, c = (lambda n: F.col(f"{target}.{n}")), (lambda n: F.col(f"{card}.{n}"))
    points = (
        F.lit(10) + F.when(t("mirrors") == c("id"), 100).otherwise(0) + F.when(c("chapter") == "01", 60).otherwise(0) + F.when(c("chapter") == t("chapter"), 40).otherwise(0)
        + F.when(c("ord") == t("ord") - 1, 30).otherwise(0) + F.greatest(F.lit(0), 20 - (t("ord") - c("ord")))
    )
    return F.when((c("id") == t("id")) | (c("ord") > t("ord")), 0).otherwise(points).cast("int")


NEAR = 20  # a card so many places before its target gets nothing for nearness


def _capped(cards: DataFrame, keys: list[str], budget: int, times: int = 1) -> DataFrame:
    """Of the cards of equal size in a group the first that fit in the budget together, `times` over: no others of that size can."""
    nth = F.row_number().over(W.partitionBy(*keys, "size").orderBy("ord", "id"))
    return cards.withColumn("_r", nth).filter(F.col("_r") <= times * F.floor(F.lit(budget) / (F.col("size") + 1))).drop("_r")


def _reachable(cards: DataFrame, keys: list[str], budget: int, but_one: bool = False) -> DataFrame:
    """Of the cards of a group, in order, those that a greedy choice may reach: whoever takes a card has taken all before it that
    are no larger, as there was more room then. but_one: one chapter may be left out, so the fullest one doesn't count.

    Expects _capped() cards, so that a group is bounded by the budget, whatever the document.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums, chapters, fullest = None, np.zeros(budget + 2, np.int64), {}, 0
        for b in batches:
            kept = []
            for at, (group, chapter, size) in enumerate(zip(zip(*[b[k].tolist() for k in keys]), b["chapter"].tolist(), b["size"].tolist())):
                if group != now:
                    now, chapters, fullest = group, {}, 0
                    sums[:] = 0
                before = int(sums[: size + 1].sum()) - (fullest if but_one else 0)
                if before + size + 1 <= budget:
                    kept.append(at)
                sums[size] += size + 1
                chapters[chapter] = chapters.get(chapter, 0) + size + 1
                fullest = max(fullest, chapters[chapter])
            yield b.iloc[kept]

    return cards.repartition(*keys).sortWithinPartitions(*keys, "ord", "id").mapInPandas(fold, cards.schema)


def candidates(targets: DataFrame, cards: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc, target, id, ord, score, size): for each target (doc, id, ord, chapter, mirrors) the cards (doc, id, ord, chapter, size) of its
    document that pick() may take under the budget, and few others; it takes the same of them as of all pairs.

    Cards that earn points of their own are joined by key: the mirror, and those less than NEAR places before. All others of a
    chapter score the same and go in order from the front, where the budget bounds how many can ever be taken; these are found
    once a chapter and once a document. ord is the place in the document, one card a place; sizes are integers. So a document
    with n targets makes rows in proportion to n.
    """
    cards = cards.select("doc", "id", "ord", "chapter", "size").filter(F.col("size") < budget)
    t = targets.select("doc", F.col("id").alias("target"), F.col("ord").alias("t_ord"), F.col("chapter").alias("t_chapter"), F.col("mirrors").alias("t_mirrors"))
    shape = ["doc", "target", "t_ord", "t_chapter", "t_mirrors", "id", "ord", "chapter", "size"]
    near = t.withColumn("_at", F.explode(F.sequence(F.lit(1), F.lit(NEAR - 1)))).withColumn("ord", F.col("t_ord") - F.col("_at")).join(cards, ["doc", "ord"])
    mirror = t.filter("t_mirrors is not null").withColumn("id", F.col("t_mirrors")).join(cards, ["doc", "id"]).filter(F.col("ord") <= F.col("t_ord") - NEAR)
    by_chapter = _capped(cards, ["doc", "chapter"], budget)
    same = _reachable(by_chapter, ["doc", "chapter"], budget)
    other = _reachable(_capped(by_chapter.filter("chapter <> '01'"), ["doc"], budget, 2), ["doc"], budget, but_one=True)
    far = (F.col("ord") <= F.col("t_ord") - NEAR) & ~F.coalesce(F.col("id") == F.col("t_mirrors"), F.lit(False))
    of_chapter = t.withColumn("chapter", F.col("t_chapter")).join(same, ["doc", "chapter"]).filter(far)
    of_first = t.filter("t_chapter <> '01'").join(same.filter("chapter = '01'"), "doc").filter(far)
    of_others = t.join(other, "doc").filter(far & (F.col("chapter") != F.col("t_chapter")))
    found = None
    for some in (near, mirror, of_chapter, of_first, of_others):
        found = some.select(*shape) if found is None else found.union(some.select(*shape))
    found = found.select("doc", "target", "id", "ord", "size", F.struct(F.col("target").alias("id"), F.col("t_ord").alias("ord"), F.col("t_chapter").alias("chapter"), F.col("t_mirrors").alias("mirrors")).alias("t"), F.struct("id", "ord", "chapter").alias("c"))
    return found.select("doc", "target", "id", "ord", score().alias("score"), "size")


def pick(scored: DataFrame, key: str, budget: int, header: int = 0) -> DataFrame:
    """(key, ord, id) of the cards (key, id, ord, score, size) taken: best score first, then document order, each that still fits.

    A card that doesn't fit is passed over and smaller ones go on; each takes its size and 1. The cards of a key come in
    order and only what is used is carried from one to the next, so no task holds a key's cards.
    """
    kinds = {f.name: f.dataType for f in scored.schema}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, 0
        for b in batches:
            taken = []
            for at, (k, size) in enumerate(zip(b[key].tolist(), b["size"].tolist())):
                if k != now:
                    now, used = k, header
                if used + size + 1 <= budget:
                    used += int(size) + 1
                    taken.append(at)
            yield b.iloc[taken][[key, "ord", "id"]]

    ordered = scored.filter("score > 0").select(key, "ord", "id", "score", "size").repartition(key).sortWithinPartitions(key, F.desc("score"), "ord", "id")
    return ordered.mapInPandas(fold, T.StructType([T.StructField(c, kinds[c]) for c in (key, "ord", "id")]))


FEW = 256  # cards of a document that are ranked against each other as they are


def chosen(cards: DataFrame, budget: int, header: int = 0) -> DataFrame:
    """(doc, target, ord, id): what pick() takes for each card (doc, id, ord, chapter, mirrors, size) of its document, without a row a pair.

    Documents of up to FEW cards meet as a whole in a task, many at once: scores, order and the greedy choice are arrays over
    targets and cards. Larger ones go through candidates() and pick(), which hold no document.
    """
    cards = cards.select("doc", "id", "ord", "chapter", "mirrors", "size").filter("doc is not null")
    kind = {f.name: f.dataType for f in cards.schema}
    out = T.StructType([T.StructField(c, kind[k]) for c, k in (("doc", "doc"), ("target", "id"), ("ord", "ord"), ("id", "id"))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            if not t.num_rows:
                continue
            # the last document may go on
            last = pc.equal(t["doc"], t["doc"][-1]).to_numpy().argmax()
            rest = t.slice(last)
            yield from _chosen(t.slice(0, last), budget, header)
        if rest is not None:
            yield from _chosen(rest, budget, header)

    counted = cards.withColumn("_n", F.count("*").over(W.partitionBy("doc")))
    few = counted.filter(F.col("_n") <= FEW).drop("_n").sortWithinPartitions("doc").mapInArrow(fold, out)
    large = cut(cards.groupBy("doc").count().filter(F.col("count") > FEW).select("doc"))
    if large.isEmpty():
        return few
    some = cards.join(large, "doc", "left_semi")
    found = candidates(some, some, budget).withColumn("key", F.struct("doc", "target"))
    return few.union(pick(found, "key", budget, header).select("key.doc", "key.target", "ord", "id"))


def _chosen(t: pa.Table, budget: int, header: int, cells: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """What each card of whole documents, one behind the other, takes."""
    if not t.num_rows:
        return
    codes = lambda c: pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    doc = codes(t["doc"])
    t = t.take(np.lexsort((codes(t["id"]) if not pa.types.is_integer(t["id"].type) else t["id"].to_numpy(), t["ord"].to_numpy(), doc)))
    doc, place, n = codes(t["doc"]), t["ord"].to_numpy().astype(np.int64), t.num_rows
    both = codes(pa.chunked_array([t["id"].combine_chunks(), t["mirrors"].cast(t["id"].type).combine_chunks()]))
    ids, mirror = both[:n], both[n:]
    chapter, first = codes(t["chapter"]), pc.fill_null(pc.equal(t["chapter"], "01"), False).to_numpy()
    size = pc.fill_null(t["size"], budget).to_numpy().astype(np.int64)
    start = np.searchsorted(doc, doc)
    ends = np.flatnonzero(np.r_[(doc[1:] != doc[:-1]) | (place[1:] != place[:-1]), True]) + 1
    reach = ends[np.searchsorted(ends, np.arange(n), "right")] - start  # cards of the document up to the target's place
    order, at = np.argsort(reach, kind="stable"), 0
    while at < n:
        # targets that may reach about as many cards
        wide = int(reach[order[at]]) // 8 * 8 + 8
        rows = order[at : min(np.searchsorted(reach[order], wide, "right"), at + max(1, cells // wide))]
        at += len(rows)
        # a line a card and a column a target, so that all steps go along the targets
        k = np.arange(wide)[:, None]
        c = np.minimum(start[rows] + k, n - 1)
        away = place[rows] - place[c]
        score = 10 + 100 * ((mirror[rows] == ids[c]) & (mirror[rows] >= 0)) + 60 * first[c] + 40 * ((chapter[rows] == chapter[c]) & (chapter[rows] >= 0)) + 30 * (away == 1) + np.maximum(0, NEAR - away)
        none = (k >= reach[rows]) | (ids[c] == ids[rows])
        ranked = np.sort(np.where(none, 1 << 30, (1 << 10) - score << 16 | k).astype(np.int32), axis=0)
        c = np.minimum(start[rows] + (ranked & 0xFFFF), n - 1)
        need = np.where(ranked == 1 << 30, budget + 1, size[c] + 1)
        used, taken = np.full(len(rows), header, np.int64), np.zeros(c.shape, bool)
        for i in range(wide):
            fits = used + need[i] <= budget
            used += need[i] * fits
            taken[i] = fits
        col, line = np.nonzero(taken.T)
        if len(col):
            cards = t.take(c[line, col])
            targets = t.take(rows[col])
            yield pa.RecordBatch.from_arrays([x.combine_chunks() for x in (targets["doc"], targets["id"], cards["ord"], cards["id"])], ["doc", "target", "ord", "id"])


def context(found: DataFrame, target: str, order: str, text: str) -> DataFrame:
    """(target, context): the header and the chosen cards' texts in document order; targets without cards have no row."""
    each = found.groupBy(target).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("all"))
    return each.select(target, F.array_join(F.concat(F.lit(list(HEADER)), F.transform("all", lambda x: x["t"])), "\n").alias("context"))
