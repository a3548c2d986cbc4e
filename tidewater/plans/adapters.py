"""The test tables seen as indicators, sections, manuscripts, cards and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, size: int, most: int) -> DataFrame:
    """The rows by their key, in so many tasks that each has about `most` of a size; no fewer tasks than cores."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // most)), key)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as places, regions as provinces; a synthetic type, which one nation lacks."""
    kind = F.when(F.col("n_nationkey") != 3, F.col("n_nationkey") % 7)
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(F.col("n_nationkey").alias("place"), F.col("r_name").alias("province"), kind.alias("type"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, year, place, value): five yearly indicators of each nation; sums are exact decimals before they become doubles."""
    nation = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("place"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    sold = orders.join(nation, F.col("o_custkey") == F.col("c_custkey"))
    by_order = sold.groupBy("place", "year").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("revenue"), F.countDistinct("o_custkey").alias("buyers"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("r"))
    returned = lines.groupBy("l_orderkey").agg(F.count("*").alias("m"), F.sum("r").alias("r"))
    share = sold.join(returned, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("place", "year").agg((F.sum("r") / F.sum("m")).alias("share"))
    wide = by_order.join(share, ["place", "year"], "left")
    one = lambda code, value: F.struct(F.lit(code).alias("code"), value.cast("double").alias("value"))
    codes = F.array(one("A1", F.col("n")), one("A2", F.col("revenue")), one("A3", F.col("revenue") / F.col("n")), one("B1", F.col("buyers")), one("B2", F.col("share")))
    return wide.select("place", "year", F.explode(codes).alias("x")).select("x.code", "year", "place", "x.value")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of sections (id, parent, title, ord): regions, nations, market segments and customers; parts in chains of 40; and
    every 97th customer's parent isn't there."""
    text = lambda c: F.col(c).cast("string")
    row = lambda df, i, parent, title, ord: df.select(i.alias("id"), parent.alias("parent"), title.alias("title"), ord.cast("long").alias("ord"))
    customer = table(spark, sf_dir, "customer")
    segments = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("ord"))
    segment = lambda df: F.concat(F.lit("s"), text("c_nationkey"), F.lit("-"), "c_mktsegment")
    r = row(table(spark, sf_dir, "region"), F.concat(F.lit("r"), text("r_regionkey")), F.lit(None).cast("string"), F.col("r_name"), F.col("r_regionkey"))
    n = row(table(spark, sf_dir, "nation"), F.concat(F.lit("n"), text("n_nationkey")), F.concat(F.lit("r"), text("n_regionkey")), F.col("n_name"), F.col("n_nationkey"))
    s = row(segments, segment(segments), F.concat(F.lit("n"), text("c_nationkey")), F.col("c_mktsegment"), F.col("ord"))
    above = F.when(F.col("c_custkey") % 97 == 0, F.lit("gone")).otherwise(segment(customer))
    c = row(customer, F.concat(F.lit("c"), text("c_custkey")), above, F.col("c_name"), F.col("c_custkey"))
    part = table(spark, sf_dir, "part")
    before = F.when((F.col("p_partkey") - 1) % 40 > 0, F.concat(F.lit("p"), (F.col("p_partkey") - 1).cast("string")))
    p = row(part, F.concat(F.lit("p"), text("p_partkey")), before, F.concat(F.lit("t"), (F.col("p_partkey") % 10).cast("string")), F.col("p_partkey") + 100)
    return r.union(n).union(s).union(c).union(p)


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, ln, kind, level, text): each turn as a line whose kind and level follow from its text's length and number."""
    t = table(spark, sf_dir, "conversations")
    n = (F.coalesce(F.length("text"), F.lit(0)) + F.col("turn")).cast("int")
    kind = F.when(n % 7 == 0, "table").when(n % 11 == 0, "text").otherwise("item")
    level = F.when(kind == "item", n % 4 + 1)
    return t.select("conv_id", F.col("turn").alias("ln"), kind.alias("kind"), level.alias("level"), F.coalesce("text", F.lit("")).alias("text"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ln, style, para, char, text, in_table, after_table) of each line of a document: styles and what lines begin with
    follow from their length and number."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    n = F.length("line")
    line = line.withColumns({"style": (n % 5).cast("int"), "para": F.lit(0), "char": (F.col("ln") % 2).cast("int")})
    begin = F.when(F.col("ln") % 5 == 4, "").when(F.col("style") == 0, "□ ").when(F.col("style") == 1, "- ").when(F.col("style") == 2, F.concat((F.col("ln") % 20 + 1).cast("string"), F.lit(". "))).when(F.col("style") == 3, "가) ").otherwise("")
    after = ((F.col("style") == 4) & (F.col("char") == 0)) | (F.col("ln") % 7 == 1)
    return line.select("doc_id", "ln", "style", "para", "char", F.concat(begin, F.trim("line")).alias("text"), (F.col("ln") % 13 == 12).alias("in_table"), after.alias("after_table"))


def shapes(paras: DataFrame) -> DataFrame:
    """(doc_id, style, para, char, name, size, left, bullet, number) of the shapes of paragraphs()."""
    style, char = F.col("style"), F.col("char")
    name = F.when(style == 0, "제목").when(style == 1, "본문").when(style == 2, "자료 출처").when(style == 3, "기타")
    some = paras.select("doc_id", "style", "para", "char").distinct()
    return some.select("doc_id", "style", "para", "char", name.alias("name"), (16.0 - 2 * (style % 3) + char).alias("size"), (F.floor(style / 2) * 5.0).alias("left"), F.when((style == 1) & (char == 1), "◦").alias("bullet"), F.when((style == 3) & (char == 1), "^1)").alias("number"))


def read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ln, kind, text, size, notes, rows): lines of documents as paragraphs, tables of their words, and places of pictures."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    n, ln = F.length("line"), F.col("ln")
    kind = F.when(ln % 9 == 5, "table").when(ln % 17 == 7, "picture").otherwise("para")
    k = (n + ln) % 8
    begin = F.when(k == 0, "Ⅱ. ").when(k == 1, F.concat((ln % 30 + 1).cast("string"), F.lit(".  "))).when(k == 2, "나. ").when(k == 3, "③").when(k == 4, "○ ").when(k == 5, "-　").otherwise("")
    note = lambda at, said: F.struct(at.cast("int").alias("at"), said.alias("note"))
    one, other = note(n / 3, F.concat(F.lit("n"), ln.cast("string"))), note(F.when(n % 2 == 0, n / 3).otherwise(n + 9), F.lit("second"))
    notes = F.when(ln % 4 == 1, F.array(one)).when(ln % 6 == 2, F.array(one, other)).otherwise(F.array().cast("array<struct<at:int,note:string>>"))
    rows = F.when(kind == "table", F.transform(F.split("line", "[.,]"), lambda r: F.slice(F.split(F.trim(r), " "), 1, 4)))
    blank = F.array().cast("array<struct<at:int,note:string>>")
    return line.select("doc_id", "ln", kind.alias("kind"), F.when(kind == "para", F.concat(begin, "line")).otherwise("").alias("text"), F.when(kind == "para", 10 + n % 3).cast("int").alias("size"), F.when(kind == "para", notes).otherwise(blank).alias("notes"), rows.alias("rows"))


def moved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events 55 days later, so that the clocks of the ledger's zone change among them."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp") + F.expr("INTERVAL 55 DAYS"))


def diagram_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents whose lines are fenced diagrams of ten lines each, in turn trees and bands of two kinds."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    ln, word = F.col("ln"), F.substring_index("line", " ", 1)
    kind = F.floor(ln / 12) % 3
    named = F.when(kind == 0, "org").when(kind == 1, "matrix").otherwise("strategy")
    item = F.concat(F.repeat(F.lit(" "), (F.length("line") % 3 * 2).cast("int")), F.lit("- "), "line")
    band = F.when(ln % 4 == 0, F.concat(word, F.lit(" {fill=#abc} | "), F.substring("line", 1, 10), F.lit(" |  | "), word, F.lit(" | |"))).when(ln % 4 == 1, F.concat(F.lit(" | "), "line")).when(ln % 4 == 2, "|---|:--|").otherwise(F.col("line"))
    said = F.when(ln % 12 == 0, F.concat(F.lit(":::diagram type="), named, F.lit(' title="'), F.length("line").cast("string"), F.lit(' x" layout=side'))).when(ln % 12 == 11, ":::  ").otherwise(F.when(kind == 0, item).otherwise(band))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", said.alias("t")))), lambda v: v["t"]), "\n").alias("text"))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents as manuscripts: what each line is marked as follows from its number."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    ln, n, line = F.col("ln"), F.length("line"), F.col("line")
    word = lambda i: F.coalesce(F.try_element_at(F.split("line", " "), F.lit(i)), F.lit(""))
    k = (ln + F.floor(n / 64)) % 15
    label = F.concat(F.lit("[^"), ln.cast("string"), F.lit("]"))
    said = (
        F.when(k == 0, F.concat(F.lit("# "), line)).when(k == 1, F.concat(F.lit("○ "), line, label, F.lit(" tail"))).when(k == 2, F.concat(F.lit("[^"), (ln - 1).cast("string"), F.lit("]: "), word(1))).when(k == 3, F.concat(F.lit("[표: "), word(1), F.lit("]")))
        .when(k == 4, F.concat(F.lit("| "), word(1), F.lit(" | "), word(2), F.lit(" |"))).when(k == 5, "|---|:--|").when(k == 6, F.concat(F.lit("| "), word(3), F.lit(" |"))).when(k == 7, F.concat(F.lit("※ "), line)).when(k == 8, "")
        .when(k == 9, F.concat(F.lit("  - "), label, line, F.lit("[^gone]"))).when(k == 10, line).when(k == 11, F.concat(F.lit("{cols=1,"), (n % 3).cast("string"), F.lit("}"))).when(k == 12, F.concat(F.lit("[장: "), word(1), F.lit("]")))
        .when(k == 13, F.concat(F.lit("#### "), word(2), F.lit("[^"), (ln - n % 20).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("![x]("), word(1), F.lit(".png)")))
    )
    return x.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", said.alias("t")))), lambda v: v["t"]), "\n").alias("text"))
