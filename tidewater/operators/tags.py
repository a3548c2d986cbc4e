"""Tags of marked-up texts without a parser: tokens with their places, outermost spans of a tag, and whether all tags close.

A text is split at its tags and exploded; places and depths are prefix sums over the tokens of a text, and a closing tag meets
its opening one as the neighbour on the same depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A tag: a name behind < or </, then quoted values and anything else up to >. Possessive, as long tags would exhaust the matcher's stack.
TAG = r"""<(/?)([\w:]+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
# Character references of XML, in the order in which they are replaced.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def attr(attrs: Column, name: str) -> Column:
    """An attribute's double-quoted value; null without one."""
    found = F.regexp_extract_all(attrs, F.lit(rf'(?<![\w]){name}="([^"]*)"'), F.lit(1))
    return F.try_element_at(found, F.lit(1))


def unescape(c: Column) -> Column:
    for said, meant in REFERENCES:
        c = F.replace(c, F.lit(said), F.lit(meant))
    return c


def tokens(texts: DataFrame, key: str, text: str, void: tuple[str, ...] = ()) -> DataFrame:
    """(key, nth, kind, name, raw, attrs, start, end) of each tag: kind is open, close or empty, as void tags are; raw has the prefix
    that name lacks.

    Places count characters from 0. A text without tags, or null, has no rows.
    """
    zipped = F.posexplode(F.arrays_zip(F.split(text, TAG, -1).alias("gap"), F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(0)).alias("tag"))).alias("nth", "x")
    found = texts.filter(F.col(text).isNotNull()).select(key, zipped).select(key, "nth", "x.gap", "x.tag").filter("tag is not null")
    w = W.partitionBy(key).orderBy("nth")
    end = F.sum(F.length("gap") + F.length("tag")).over(w)
    raw = F.regexp_extract("tag", r"^</?([\w:]+)", 1)
    kind = F.when(F.col("tag").endswith("/>") | raw.isin(*void), "empty").when(F.col("tag").startswith("</"), "close").otherwise("open")
    out = found.withColumns({"end": end, "raw": raw, "kind": kind})
    inside = F.regexp_extract("tag", r"(?s)^</?[\w:]+(.*?)/?>$", 1)
    return out.select(key, "nth", "kind", F.element_at(F.split("raw", ":"), F.when(F.col("raw").contains(":"), 2).otherwise(1)).alias("name"), "raw", inside.alias("attrs"), (F.col("end") - F.length("tag")).alias("start"), "end")


def _outermost(tags: DataFrame, w: WindowSpec) -> DataFrame:
    """The tags that begin or end outermost spans, or both, which edge says, with the number of the span; for steps of a tag in w."""
    some = tags.withColumn("sum", F.sum("step").over(w))
    # depth with a floor at 0: the sum less its least value so far
    some = some.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(w)))
    before = F.coalesce(F.lag("depth").over(w), F.lit(0))
    edge = F.when((F.col("step") == 0) & (before == 0), "both").when((F.col("step") == 1) & (before == 0), "first").when((F.col("step") == -1) & (before == 1), "last")
    some = some.withColumn("edge", edge).filter("edge is not null").withColumn("span", F.sum((F.col("edge") != "last").cast("int")).over(w) - 1)
    return some.drop("sum", "depth")


def spans(tags: DataFrame, key: str, *raws: str) -> DataFrame:
    """(key, raw, span, attrs, start, inner_start, inner_end, end): the outermost spans of each tag (of raws, or of all), one after the other.

    A closing tag that nothing opened is passed over; a span that nothing closes isn't one, and hides what follows.
    """
    w = W.partitionBy(key, "raw").orderBy("nth")
    some = (tags.filter(F.col("raw").isin(*raws)) if raws else tags).withColumn("step", F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0))
    some = _outermost(some, w)
    of = lambda e, c: F.max(F.when(F.col("edge").isin(e, "both"), F.col(c)))
    both = some.groupBy(key, "raw", "span").agg(of("first", "attrs").alias("attrs"), of("first", "start").alias("start"), of("first", "end").alias("inner_start"), of("last", "start").alias("inner_end"), of("last", "end").alias("end"))
    both = both.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    return both.select(key, "raw", F.col("span").cast("int").alias("span"), "attrs", "start", "inner_start", F.greatest("inner_start", "inner_end").alias("inner_end"), "end")


def inner(span: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """The spans with what is inside them."""
    return span.join(texts.select(key, text), key).withColumn("inner", F.substring(text, F.col("inner_start") + 1, F.col("inner_end") - F.col("inner_start"))).drop(text)


def verdicts(tags: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, problem, tag, opened, roots) for every row of texts: the first thing wrong with a text's tags.

    Problems are `left over` (a closing tag with nothing open), `crossed` (one that closes another tag than the last opened,
    which is in opened), `not closed` (the innermost that stays open), and `roots` (not exactly one outermost element, how many
    is in roots); null for a text without a fault.
    """
    w = W.partitionBy(key).orderBy("nth")
    x = tags.withColumn("step", F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)).withColumn("depth", F.sum("step").over(w))
    x = x.withColumn("level", F.when(F.col("kind") == "close", F.col("depth") + 1).otherwise(F.col("depth")))
    level = W.partitionBy(key, "level", F.col("kind") == "empty").orderBy("nth")
    x = x.withColumns({"opened": F.lag("raw").over(level), "alone": F.lead("nth").over(level).isNull()})
    fault = F.when(F.col("kind") == "close", F.when(F.col("level") < 1, "left over").when(F.col("opened") != F.col("raw"), "crossed"))
    x = x.withColumn("fault", fault)
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("nth", "fault", "raw", F.when(F.col("fault") == "crossed", F.col("opened")).alias("opened"))))
    open_end = F.max(F.when((F.col("kind") == "open") & F.col("alone"), F.struct("level", "nth", "raw")))
    closes = ((F.col("kind") == "empty") | (F.col("kind") == "close")) & (F.col("depth") == 0)
    each = x.groupBy(key).agg(first.alias("f"), open_end.alias("o"), F.max_by("depth", "nth").alias("left"), F.count(F.when(closes, 1)).alias("n"))
    out = texts.select(key).join(each, key, "left")
    n = F.coalesce("n", F.lit(0))
    problem = F.when(F.col("f").isNotNull(), F.col("f.fault")).when(F.col("left") > 0, "not closed").when(n != 1, "roots")
    tag = F.when(F.col("f").isNotNull(), F.col("f.raw")).when(F.col("left") > 0, F.col("o.raw"))
    return out.select(key, problem.alias("problem"), tag.alias("tag"), F.col("f.opened").alias("opened"), F.when(problem == "roots", n).alias("roots"))


def edged(tags: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, nth, step, raw): the tags as steps of depth (1, -1, 0), between an opening and a closing one without a name around each text."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    around = F.array(*[F.struct(F.lit(at).alias("nth"), F.lit(way).alias("step")) for at, way in ((-1, 1), (2**31 - 1, -1))])
    whole = texts.select(key).distinct().select(key, F.explode(around).alias("x")).select(key, "x.nth", "x.step", F.lit("").alias("raw"))
    # tags without a key belong to no text
    return tags.filter(F.col(key).isNotNull()).select(key, "nth", step.alias("step"), "raw").union(whole)


def part_verdicts(edges: DataFrame, key: str) -> DataFrame:
    """(key, raw, span, problem, tag, opened, roots): what verdicts() says of every text (raw is empty) and of the inside of each outermost
    span of spans(), for edged() tags.

    The tags of an inside are those of its text between two places, so none is cut out and read again. A span's first tag knows the
    next one that falls below its depth, and the next that closes another than the last opened; the depth's next tag is the
    one that falls below, and those that end there are children of the same tag.
    """
    x = edges.withColumn("depth", F.sum("step").over(W.partitionBy(key).orderBy("nth")))
    # the depth that a tag opens or closes, or would, if it is empty
    x = x.withColumn("level", F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1)).drop("depth")
    w = W.partitionBy(key, "level").orderBy("nth")
    over = {"opened": F.when(F.col("step") == -1, F.lag("raw").over(w)), "below": F.lead("nth").over(w), "falls": F.lead("raw").over(w), "ended": F.count(F.when(F.col("step") < 1, 1)).over(w)}
    x = x.withColumns(over).drop("level")
    # backwards: an open frame behind a row would be read again for every row
    w = W.partitionBy(key).orderBy(F.desc("nth"))
    cross = F.when(F.col("opened") != F.col("raw"), F.struct("nth", "raw", "opened"))
    after = F.lag(F.col("ended") - (F.col("step") < 1).cast("int")).over(w)
    x = x.withColumns({"cross": F.last(cross, True).over(w.rowsBetween(W.unboundedPreceding, -1)), "since": after, "until": F.lead("ended").over(w)}).drop("ended")
    w = W.partitionBy(key, "raw").orderBy("nth")
    x = _outermost(x, w).withColumns({"end": F.lead("nth").over(w), "top": F.lead("opened").over(w), "until": F.lead("until").over(w)})
    x = x.filter((F.col("edge") == "both") | ((F.col("edge") == "first") & F.col("end").isNotNull()))
    crossed = F.col("cross.nth") < F.least("below", "end")
    n = F.col("until") - F.col("since")
    fault = F.when(crossed, "crossed").when(F.col("below") < F.col("end"), "left over").when(F.col("below").isNull() | (F.col("below") > F.col("end")), "not closed").when(n != 1, "roots")
    x = x.withColumn("problem", F.when(F.col("edge") == "both", "roots").otherwise(fault))
    problem = F.col("problem")
    tag = F.when(problem == "crossed", F.col("cross.raw")).when(problem == "left over", F.col("falls")).when(problem == "not closed", F.col("top"))
    roots = F.when(problem == "roots", F.when(F.col("edge") == "both", F.lit(0)).otherwise(n))
    return x.select(key, "raw", F.col("span").cast("int").alias("span"), "problem", tag.alias("tag"), F.when(problem == "crossed", F.col("cross.opened")).alias("opened"), roots.alias("roots"))
