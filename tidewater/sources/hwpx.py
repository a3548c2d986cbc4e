"""Packages of the hwpx kind as rows: entries with what is wrong with them, paragraphs and tables of the body, styles of the header.

A task reads one package at a time; all that relates its rows (markers by style, references without a target, bullets that
are set twice, levels by guess) is DataFrame work.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import trim

# Entries that a package must have, and symbols of bullets.
NEEDED = ("mimetype", "Contents/header.xml", "Contents/content.hpf", "META-INF/container.xml")
SYMBOLS = "□○-·･•▪◦∙※"
OLD = bytes.fromhex("d0cf11e0")

PARAGRAPHS = "part string, ln int, style int, para int, char int, kind string, text string, notes array<string>, grid array<array<string>>, widths array<int>"
STYLES = "style int, title string, para int, char int, size double, bold boolean, left double"
ENTRIES = "nth int, entry string, bytes long, crc long, problem string"
REFERENCES = "attr string, ref int, defined boolean"


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _some(e, *names: str) -> list:
    return [x for x in e.iter() if _local(x) in names]


def _int(e, name: str, other: int = 0) -> int:
    try:
        return int(float(e.get(name, other)))
    except ValueError:
        return other


def paragraph_text(p) -> tuple[str, list[str]]:
    """Text of a paragraph's own runs, tabs as spaces, and of its footnotes; not of its tables."""
    text, notes = [], []
    for t in (t for r in p if _local(r) == "run" for t in r):
        if _local(t) == "t":
            text.append((t.text or "") + "".join((" " if _local(x) == "tab" else "") + (x.tail or "") for x in t))
        elif _local(t) == "tab":
            text.append(" ")
        notes += [" ".join("".join(x.text or "" for x in _some(n, "t")).split()) for n in _some(t, "footNote")]
    return " ".join("".join(text).split()), notes


def table_grid(t) -> tuple[list[list[str]], list[int]]:
    """Cells of a table, merged ones as text at the top left and blanks beside, and the columns' widths in percent of their sum."""
    rows, cols = _int(t, "rowCnt"), _int(t, "colCnt")
    grid, width = [[""] * cols for _ in range(rows)], [0] * cols
    for r, tr in enumerate(x for x in t if _local(x) == "tr"):
        for at, tc in enumerate(x for x in tr if _local(x) == "tc"):
            part = {_local(x): x for x in tc if _local(x) in ("cellAddr", "cellSpan", "cellSz")}
            row = _int(part["cellAddr"], "rowAddr", r) if "cellAddr" in part else r
            col = _int(part["cellAddr"], "colAddr", at) if "cellAddr" in part else at
            if 0 <= row < rows and 0 <= col < cols:
                grid[row][col] = " ".join(x for x in (paragraph_text(p)[0] for p in _some(tc, "p")) if x)
                if "cellSz" in part and ("cellSpan" not in part or _int(part["cellSpan"], "colSpan", 1) == 1):
                    width[col] = max(width[col], _int(part["cellSz"], "width"))
    total = sum(width)
    return grid, [max(1, int(w / total * 100 + 0.5)) for w in width] if total else []


def _sections(z: zipfile.ZipFile) -> list[str]:
    return sorted(n for n in z.namelist() if posixpath.dirname(n) == "Contents" and posixpath.basename(n).startswith("section") and n.endswith(".xml"))


def _read_paragraphs(z: zipfile.ZipFile) -> Iterator[tuple]:
    for part in _sections(z):
        for ln, p in enumerate(x for x in ElementTree.fromstring(z.read(part)) if _local(x) == "p"):
            text, notes = paragraph_text(p)
            char = next((_int(r, "charPrIDRef") for r in p if _local(r) == "run" and r.get("charPrIDRef")), None)
            tables = [t for r in p if _local(r) == "run" for t in r if _local(t) == "tbl"]
            grid, widths = table_grid(tables[0]) if tables else (None, None)
            yield part, ln, _int(p, "styleIDRef"), _int(p, "paraPrIDRef"), char, "table" if tables else "para", text, notes, grid, widths


def _read_styles(z: zipfile.ZipFile) -> Iterator[tuple]:
    root = ElementTree.fromstring(z.read("Contents/header.xml"))
    chars = {_int(c, "id"): (_int(c, "height", 1000) / 100, bool(_some(c, "bold")) or c.get("bold") in ("1", "true")) for c in _some(root, "charPr")}
    lefts = {_int(p, "id"): next((_int(x, "value") / 100 for m in _some(p, "margin") for x in _some(m, "left")), 0.0) for p in _some(root, "paraPr")}
    for s in _some(root, "style"):
        para, char = _int(s, "paraPrIDRef"), _int(s, "charPrIDRef")
        size, bold = chars.get(char, (10.0, False))
        yield _int(s, "id"), s.get("name", ""), para, char, size, bold, lefts.get(para, 0.0)


def _read_entries(z: zipfile.ZipFile) -> Iterator[tuple]:
    for nth, i in enumerate(z.infolist()):
        problem = None
        try:
            data = z.read(i)
            if i.filename.endswith((".xml", ".hpf")):
                ElementTree.fromstring(data)
        except ElementTree.ParseError:
            problem = "no well-formed XML"
        except (zipfile.BadZipFile, zlib.error):
            problem = "damaged"
        yield nth, i.filename, i.file_size, i.CRC, problem


def _read_references(z: zipfile.ZipFile) -> Iterator[tuple]:
    kinds = {"style": "styleIDRef", "paraPr": "paraPrIDRef", "charPr": "charPrIDRef", "borderFill": "borderFillIDRef"}
    for x in ElementTree.fromstring(z.read("Contents/header.xml")).iter():
        if _local(x) in kinds and x.get("id"):
            yield kinds[_local(x)], _int(x, "id"), True
    for part in _sections(z):
        for x in ElementTree.fromstring(z.read(part)).iter():
            yield from ((a, _int(x, a), False) for a in kinds.values() if x.get(a))


def _rows(files: DataFrame, fields: str, read: Callable) -> DataFrame:
    """(name, fields..., error) of the packages (name, content); one that can't be read is a row with its reason."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
    names, types = zip(*(f.split(" ") for f in fields.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content")):
                try:
                    raw = data.as_py() or b""
                    if raw[:4] == OLD:
                        raise ValueError("an old binary format")
                    found = [(name, *r, None) for r in read(zipfile.ZipFile(io.BytesIO(raw)))]
                except Exception as e:  # a broken file is a row with its reason, not a failed job
                    found = [(name, *[None] * len(names), str(e) or type(e).__name__)]
                if found:
                    cols = [pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), *(kinds[t] for t in types), pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["name", *names, "error"])

    return files.select("name", "content").mapInArrow(run, f"name string, {fields}, error string")


def paragraphs(files: DataFrame) -> DataFrame:
    """(name, PARAGRAPHS, error): the paragraphs of all body parts in order, tables as grids."""
    return _rows(files, PARAGRAPHS, _read_paragraphs)


def styles(files: DataFrame) -> DataFrame:
    """(name, STYLES, error): styles by number with name, size, weight and left margin."""
    return _rows(files, STYLES, _read_styles)


def entries(files: DataFrame) -> DataFrame:
    """(name, ENTRIES, error): entries of the archives with what is wrong with each."""
    return _rows(files, ENTRIES, _read_entries)


def references(files: DataFrame) -> DataFrame:
    """(name, REFERENCES, error): numbers of styles and shapes, as defined and as used."""
    return _rows(files, REFERENCES, _read_references)


def verdict(found: DataFrame) -> DataFrame:
    """(name, problem) of entries(): what can't be opened, is damaged or missing, and archives that don't begin with their type."""
    bad = found.filter(F.coalesce("problem", "error").isNotNull()).select("name", F.when(F.col("error").isNotNull(), F.concat(F.lit("can't be opened: "), "error")).otherwise(F.concat("entry", F.lit(": "), "problem")).alias("problem"))
    have = found.filter("error is null").groupBy("name").agg(F.collect_set("entry").alias("have"), F.min_by("entry", "nth").alias("first"))
    gone = have.select("name", F.explode(F.array_except(F.lit(list(NEEDED)), "have")).alias("e")).select("name", F.concat(F.lit("missing: "), "e").alias("problem"))
    order = have.filter("array_contains(have, 'mimetype') and first <> 'mimetype'").select("name", F.lit("mimetype isn't the first entry").alias("problem"))
    return bad.union(gone).union(order)


def body_part(paras: DataFrame, wanted: str, found: DataFrame) -> DataFrame:
    """The paragraphs of the wanted part, or, in a package without it, of the largest part by the bytes of its entry (entries())."""
    parts = paras.filter("error is null").select("name", "part").distinct().join(found.select("name", F.col("entry").alias("part"), "bytes"), ["name", "part"], "left")
    best = parts.groupBy("name").agg(F.max_by("part", F.struct(F.col("part") == wanted, "bytes")).alias("part"))
    return paras.join(best, ["name", "part"])


def marker_lines(paras: DataFrame, levels: DataFrame, note_style: int) -> DataFrame:
    """(name, ln, line, matched): paragraphs as marked lines, tables as bar tables with their widths; levels are (style, marker).

    A paragraph without text is a blank line; matched says for one with text whether its style has a level.
    """
    known = paras.join(levels.select("style", "marker"), "style", "left")
    text = F.col("text")
    note = F.when(text.startswith("※"), text).otherwise(F.concat(F.lit("※ "), text))
    line = F.when(text == "", "").when(F.col("style") == note_style, note).when(F.coalesce("marker", F.lit("")) != "", F.concat("marker", F.lit(" "), text)).otherwise(text)
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.when(c == "", " ").otherwise(c)), " | "), F.lit(" |"))
    head = F.concat(F.lit("|"), F.array_join(F.transform(F.col("grid")[0], lambda c: F.lit("---")), "|"), F.lit("|"))
    width = F.when(F.size("widths") > 0, F.array(F.concat(F.lit("{cols="), F.array_join(F.transform("widths", lambda w: w.cast("string")), ","), F.lit("}")))).otherwise(F.array().cast("array<string>"))
    # an empty line before a table; those that were there already make no second one
    table = F.array_join(F.concat(F.array(F.lit("")), width, F.array(row(F.col("grid")[0]), head), F.transform(F.slice("grid", 2, F.greatest(F.size("grid"), F.lit(1))), row)), "\n")
    matched = F.when((F.col("kind") == "para") & (text != ""), F.col("marker").isNotNull() | (F.col("style") == note_style))
    return known.select("name", "ln", F.when(F.col("kind") == "table", F.when(F.size("grid") > 0, table)).otherwise(line).alias("line"), matched.alias("matched"))


def marker_text(lines: DataFrame) -> DataFrame:
    """(name, text, ratio): the lines of each package as one text, at most one blank line in a row, and the share of matched paragraphs."""
    kept = lines.filter("line is not null")
    each = kept.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]).alias("all"), F.coalesce(F.avg(F.col("matched").cast("int")), F.lit(0.0)).alias("ratio"))
    return each.select("name", F.concat(trim(F.regexp_replace(F.array_join("all", "\n"), r"\n{3,}", "\n\n")), F.lit("\n")).alias("text"), "ratio")


def double_bullets(paras: DataFrame, auto: DataFrame) -> DataFrame:
    """(name, ln, bullet, text): paragraphs whose shape sets a bullet (auto: para, bullet) and whose text begins with one too."""
    return paras.join(auto, "para").filter((F.col("text") != "") & F.lit(SYMBOLS).contains(F.substring("text", 1, 1))).select("name", "ln", "bullet", F.substring("text", 1, 24).alias("text"))


def changed_styles(shapes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, style, want, have): styles whose name isn't the wanted one (style, name), or that are gone."""
    every = shapes.select("name").distinct().join(F.broadcast(wanted.select("style", F.col("name").alias("want"))))  # the styles of one form
    have = shapes.select("name", "style", F.col("title").alias("have"))
    return every.join(have, ["name", "style"], "left").filter("not want <=> have")


def style_named(shapes: DataFrame, names: list[str]) -> DataFrame:
    """(name, style): the first style that has one of the names, in the order of names."""
    place = F.array_position(F.lit(names), F.col("title"))
    return shapes.withColumn("_p", place).filter("_p > 0").groupBy("name").agg(F.min_by("style", F.struct("_p", "style")).alias("style"))
