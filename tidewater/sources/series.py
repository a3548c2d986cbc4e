"""Yearly series: one JSON document per indicator, to a tidy table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "code string, name string, unit string, years array<int>, values map<string, array<double>>"


def read_series(spark: SparkSession, path: str, codes: list[str] | None = None) -> DataFrame:
    """(code, name, unit, place, year, value) from documents {code, name, unit, years, values: {place: [value or null]}}.

    Documents that can't be read are passed over, and so are requested codes without one; it is an error if no document of them is left.
    """
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).filter("code is not null")
    if codes is not None:
        docs = docs.filter(F.col("code").isin(codes))
        if docs.isEmpty():
            raise ValueError("none of the requested series can be read")
    by_place = docs.select("code", "name", "unit", "years", F.explode("values").alias("place", "row"))
    return by_place.select("code", "name", "unit", "place", F.explode(F.arrays_zip("years", "row")).alias("x")).select("code", "name", "unit", "place", F.col("x.years").alias("year"), F.col("x.row").alias("value")).filter("year is not null")


NODE = """id string, depth int, no string, title string, page int, parent string, children array<string>, howto struct<purpose:string,method:string,raw:string,chars:int>, howto_ref string, mirrors string,
    forms array<struct<idx:int,seq:int,kind:string,xml:string,rows:int,cols:int,header:array<string>,grid:array<array<string>>,colWidths:array<int>,required:boolean>>,
    limits array<struct<text:string,scope:string,op:string,n:int,unit:string>>, fixed boolean, markers array<string>"""


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The sections of a catalog document {nodes: [...]}, a row each, with ord, their place in it.

    A document without nodes, a section without an id and an id that occurs twice are errors.
    """
    fields = ", ".join(f"{n}:{t}" for n, t in (f.strip().split(" ", 1) for f in _fields(NODE)))
    docs = spark.read.schema(f"nodes array<struct<{fields}>>").option("multiLine", True).json(path)
    nodes = docs.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*")
    if nodes.isEmpty():
        raise ValueError("no catalog: it has no nodes")
    if not nodes.filter("coalesce(id, '') = ''").isEmpty():
        raise ValueError("a section has no id")
    twice = nodes.groupBy("id").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"two sections have the id {twice['id']!r}")
    return nodes


def read_index(spark: SparkSession, catalog: str, regions: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, types, places) of the documents {items: [...], type7_labels: {...}} and [{code, level, sido, sigungu, type7}]."""
    docs = spark.read.schema("items array<struct<code:string,name:string,unit:string,area:string,area_name:string,kind:string>>, type7_labels map<string,string>").option("multiLine", True).json(catalog)
    items = docs.select(F.posexplode("items").alias("ord", "i")).select("ord", "i.*")
    places = spark.read.schema("code string, level string, sido string, sigungu string, type7 int").option("multiLine", True).json(regions).filter("code is not null")
    if items.isEmpty() or places.isEmpty():
        raise ValueError("the index has no items or no places")
    types = docs.select(F.explode("type7_labels").alias("type", "label")).withColumn("type", F.col("type").cast("int"))
    return items, types, places.select(F.col("code").alias("place"), "level", F.col("sido").alias("province"), F.col("sigungu").alias("county"), F.col("type7").alias("type"))


def _fields(schema: str) -> list[str]:
    """Fields of a schema at its top level."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
