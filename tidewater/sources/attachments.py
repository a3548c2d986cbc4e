"""Attached files to text and tables: csv, html, xlsx, pptx, hwpx, txt and md; images and pdf pass as base64."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.tables import delimiter, room, squared

# Limits of a file and of its tables, and what is read how.
MAX_BYTES, MAX_CELLS, MAX_COLUMNS = 20 * 1024 * 1024, 40_000, 4096
TEXT, INLINE = ("txt", "md"), ("pdf", "png", "jpg", "jpeg")
SCHEMA = "name string, ext string, mode string, text string, tables array<array<array<string>>>, inline string, bytes long, error string"


def decode(data: bytes) -> str:
    """UTF-8, else EUC-KR; without a byte order mark, line ends as newlines."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("euc-kr", "replace")
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def cap(tables: list[list[list[str]]], most: int = MAX_CELLS) -> list[list[list[str]]]:
    used, out = 0, []
    for t in tables:
        kept = t[: room(used, len(t), len(t[0]) if t else 0, most)]
        if kept:
            out.append(kept)
            used += sum(map(len, kept))
    return out


def from_csv(data: bytes) -> tuple[str, list]:
    text = decode(data)
    return "", [squared([[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=delimiter(text[:65536]))])]


class _Html(HTMLParser):
    """Text outside of tables, and tables of cells; a colspan leaves blanks behind its cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.text: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[tuple[list[str], int, int]] = []  # parts, colspan, depth of its table
        self.skip = 0

    def close_cell(self):
        while self.cell and self.open and self.cell[-1][2] == len(self.open):
            parts, span, _ = self.cell.pop()
            if not self.open[-1]:
                self.open[-1].append([])
            row = self.open[-1][-1]
            row.extend(([" ".join("".join(parts).split())] + [""] * (span - 1))[: max(0, MAX_COLUMNS - len(row))])

    def handle_starttag(self, tag, attrs):
        if tag in ("tr", "td", "th"):
            self.close_cell()  # an end tag may be left out
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            raw = dict(attrs).get("colspan") or ""
            span = int(raw) if raw.isdigit() else 1
            self.cell.append(([], min(max(span, 1), MAX_COLUMNS), len(self.open)))
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th", "tr"):
            self.close_cell()
        elif tag == "table" and self.open:
            self.close_cell()
            self.tables.append(squared(self.open.pop()))

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[:1] in "xX" else int(name)
        # what is no character stays as it is written
        self.handle_data(chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else f"&#{name};")

    def handle_entityref(self, name):
        self.handle_data(unescape(f"&{name};"))

    def handle_data(self, data):
        if not self.skip:
            (self.cell[-1][0] if self.cell else self.text).append(data)


def from_html(data: bytes) -> tuple[str, list]:
    p = _Html()
    p.feed(decode(data))
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip(), [t for t in p.tables if t]


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(root, name: str) -> list:
    return [e for e in root.iter() if _local(e) == name]


def _path(base: str, target: str) -> str:
    """The archive's entry that `target` means from the folder `base`."""
    return target[1:] if target.startswith("/") else posixpath.normpath(f"{base}/{target}")


def _number(name: str) -> int:
    return int((re.findall(r"\d+", name) or ["0"])[-1])


def from_xlsx(data: bytes) -> tuple[str, list]:
    """A table per sheet in the workbook's order; phonetic runs are left out, cells without a usable reference come next."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()

    def shown(e) -> str:
        return "".join(t.text or "" for r in e for t in ([r] if _local(r) == "t" else _all(r, "t") if _local(r) == "r" else []))

    shared = [shown(e) for e in _all(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
    files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        targets = {e.get("Id"): _path("xl", e.get("Target", "")) for e in _all(ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")), "Relationship")}
        ids = [next((v for k, v in e.attrib.items() if k.endswith("}id")), None) for e in _all(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")]
        files = [targets[i] for i in ids if targets.get(i) in names] or files
    tables = []
    for f in files:
        rows = []
        for r in _all(ElementTree.fromstring(z.read(f)), "row"):
            cells: dict[int, str] = {}
            for c in _all(r, "c"):
                at = 0
                for ch in (re.match("[A-Z]*", c.get("r", "")) or [""])[0]:
                    at = at * 26 + ord(ch) - 64
                at = at - 1 if 0 < at <= 16_384 else max(cells, default=-1) + 1
                v = next(iter(_all(c, "v")), None)
                raw = (v.text or "") if v is not None else ""
                if c.get("t") == "s":
                    raw = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
                elif c.get("t") == "inlineStr":
                    raw = "".join(map(shown, _all(c, "is")))
                elif c.get("t") == "b":
                    raw = "TRUE" if raw == "1" else "FALSE"
                if at < MAX_COLUMNS:
                    cells[at] = raw.strip()
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        tables.append(squared(rows))
    return "", [t for t in tables if t]


def from_pptx(data: bytes) -> tuple[str, list]:
    """Paragraphs of the slides in numeric order, and their tables."""
    z = zipfile.ZipFile(io.BytesIO(data))
    text, tables = [], []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number):
        root = ElementTree.fromstring(z.read(name))
        said = lambda p: "".join("\n" if _local(e) == "br" else e.text or "" for e in p.iter() if _local(e) in ("t", "br"))
        in_tables = {id(p) for t in _all(root, "tbl") for p in _all(t, "p")}
        text += [said(p) for p in _all(root, "p") if id(p) not in in_tables and said(p).strip()]
        tables += [squared([["<br>".join(said(p) for p in _all(c, "p")) for c in _all(r, "tc")] for r in _all(t, "tr")]) for t in _all(root, "tbl")]
    return "\n".join(text), [t for t in tables if t]


def from_hwpx(data: bytes) -> tuple[str, list]:
    """Paragraphs of the body's sections, with their tables as bar tables where they stand, and the tables."""
    z = zipfile.ZipFile(io.BytesIO(data))
    text, tables = [], []
    said = lambda p: "".join(t.text or "" for r in p if _local(r) == "run" for t in r if _local(t) == "t")
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=_number):
        for p in (e for e in ElementTree.fromstring(z.read(name)) if _local(e) == "p"):
            if said(p).strip():
                text.append(said(p).strip())
            for t in (t for r in p if _local(r) == "run" for t in r if _local(t) == "tbl"):
                rows = squared([["\n".join(map(said, _all(c, "p"))).strip() for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"])
                if rows:
                    tables.append(rows)
                    lines = ["| " + " | ".join(" ".join(c.replace("|", "∣").split()) or " " for c in r) + " |" for r in rows]
                    text += [lines[0], "|" + "---|" * len(rows[0]), *lines[1:]]
    return "\n".join(text), tables


READERS = {"csv": from_csv, "html": from_html, "htm": from_html, "xlsx": from_xlsx, "xlsm": from_xlsx, "pptx": from_pptx, "hwpx": from_hwpx}


def extract(name: str, data: bytes) -> dict:
    """One file as a row of SCHEMA; what can't be read has an error and no content."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    row = {"name": name, "ext": ext, "mode": None, "text": None, "tables": None, "inline": None, "bytes": len(data), "error": None}
    try:
        if not data:
            raise ValueError("the file is empty")
        if len(data) > MAX_BYTES:
            raise ValueError("the file is too large")
        if ext in INLINE:
            import base64

            return row | {"mode": "inline", "inline": base64.b64encode(data).decode()}
        if ext in TEXT:
            text, tables = decode(data).strip(), []
        elif ext in READERS:
            text, tables = READERS[ext](data)
        elif data[:4] == bytes.fromhex("d0cf11e0"):
            raise ValueError("an old binary format")
        else:
            raise ValueError(f"unknown extension {ext!r}")
        tables = cap(tables)
        if not text and not tables:
            raise ValueError("nothing in it")
        return row | {"mode": "text", "text": text, "tables": tables}
    except Exception as e:  # a broken file is a row with its reason, not a failed job
        return row | {"error": str(e) or type(e).__name__}


def read_attachments(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A row of SCHEMA for each file under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return extract_files(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").filter("name not like '.%'"))


def listed(spark: SparkSession, path: str, extension: str = "") -> DataFrame:
    """(name, bytes) of the files in a folder by name, without hidden ones, of one extension if it is given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    return files.filter("name not like '.%'").filter(F.lower("name").endswith(extension.lower())).orderBy("name")


def extract_files(files: DataFrame) -> DataFrame:
    """The same for rows (name, content)."""
    kinds = {"name": pa.string(), "ext": pa.string(), "mode": pa.string(), "text": pa.string(), "tables": pa.list_(pa.list_(pa.list_(pa.string()))), "inline": pa.string(), "bytes": pa.int64(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("name"), b.column("content")):
                yield pa.RecordBatch.from_pylist([extract(name.as_py() or "", data.as_py() or b"")], schema=pa.schema(kinds))

    return files.select("name", "content").mapInArrow(run, SCHEMA)
