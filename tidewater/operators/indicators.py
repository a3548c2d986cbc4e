"""Comparing a place with its peers: box statistics, ranks and trends of yearly indicators.

Input is tidy: values (code, year, place, value) and places (place, province, type). A plan joins the values with the
small table of places once, and computes all statistics of a group in one aggregation per code and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.text import particle

BASES = ("province", "type", "nation")
LABELS = {"nation": "전국", "province": "광역(시·도) 내", "type": "시·군·구 유형별"}  # fixed values: what a report calls a basis
RANKABLE, QUARTILES_FROM = 5, 4  # fixed values: members that a ranking and a yearly quartile need


def group_of(basis: str) -> Column:
    """The group that a place belongs to under a basis; null for an untyped place under `type`."""
    if basis not in BASES:
        raise ValueError(f"unknown basis {basis!r}; one of {BASES}")
    return F.lit("all") if basis == "nation" else F.col(basis).cast("string")


def basis_label(basis: Column) -> Column:
    """A basis as a report calls it; an unknown one as it is."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), basis), basis)


def peers(places: DataFrame, basis: str) -> DataFrame:
    """(place, peer) for every place and each member of its group, itself included."""
    keyed = places.withColumn("g", group_of(basis)).filter("g is not null")
    return keyed.select("g", "place").join(keyed.select("g", F.col("place").alias("peer")), "g").select("place", "peer")


def finite(values: DataFrame) -> DataFrame:
    """The values with null for what is no number."""
    return values.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def latest_years(values: DataFrame, places: DataFrame, basis: str) -> DataFrame:
    """(code, g, year): the latest year in which any member has a value, else the last listed year."""
    known = finite(values).join(places, "place").withColumn("g", group_of(basis)).filter("g is not null")
    with_value = F.max(F.when(F.col("value").isNotNull(), F.col("year")))
    return known.groupBy("code", "g").agg(F.coalesce(with_value, F.max("year")).alias("year"))


def box_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """n, avg, min, q1, q3, max of `value` by keys; quartiles interpolate linearly."""
    q = F.expr("percentile(value, array(0.25, 0.75))")
    stats = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("avg"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max"))
    return stats.select(*keys, "n", "avg", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "max")


def analyze(values: DataFrame, places: DataFrame, basis: str, place=None, codes: list[str] | None = None, year: int | None = None) -> DataFrame:
    """A row per code and place (or the one place): its value and rank in its group's latest year, or in `year`, with the group's
    statistics and the averages of its type and of the nation. Places without a value stay, with a null rank; codes that
    have no values have no row.

    One window over code and group gives the year, the statistics and the rank; one aggregation by code, year and type gives both averages.
    """
    if codes is not None:
        values = values.filter(F.col("code").isin(codes))
    if year is not None:
        values = values.filter(F.col("year") == int(year))
    known = finite(values).join(places, "place").withColumn("g", group_of(basis))
    w = W.partitionBy("code", "g")
    latest = F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("year"))).over(w), F.max("year").over(w))
    now = known.filter("g is not null").withColumn("_latest", latest).filter("year = _latest").drop("_latest")
    stats = {"n": F.count("value"), "avg": F.avg("value"), "min": F.min("value"), "_q": F.expr("percentile(value, array(0.25, 0.75))"), "max": F.max("value")}
    now = now.withColumns({k: v.over(w) for k, v in stats.items()}).withColumns({"q1": F.col("_q")[0], "q3": F.col("_q")[1]})
    rank = F.rank().over(w.orderBy(F.col("value").desc_nulls_last()))
    now = now.withColumn("rank", F.when(F.col("value").isNotNull(), rank))
    if place is not None:
        now = now.filter(F.col("place") == place)
    typed = known.groupBy("code", "year", "type").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    all_types = W.partitionBy("code", "year")
    typed = typed.select("code", "year", "type", (F.col("_s") / F.nullif("_n", F.lit(0))).alias("peer_avg"), F.col("_n").alias("peer_n"), (F.sum("_s").over(all_types) / F.nullif(F.sum("_n").over(all_types), F.lit(0))).alias("nation_avg"), F.sum("_n").over(all_types).alias("nation_n"))
    both = now.alias("a").join(typed.alias("b"), (F.col("a.code") == F.col("b.code")) & (F.col("a.year") == F.col("b.year")) & F.col("a.type").eqNullSafe(F.col("b.type")))
    peer = lambda c: F.when(F.col("a.type").isNotNull(), F.col(f"b.{c}")).alias(c)
    return both.select("place", "a.code", "a.year", F.col("value").alias("mine"), "rank", "n", "avg", "min", "q1", "q3", "max", peer("peer_avg"), peer("peer_n"), "nation_avg", "nation_n")


def analyze_place(values: DataFrame, places: DataFrame, items: DataFrame, place, basis: str, codes: list[str], year=None) -> DataFrame:
    """analyze() of one place for the requested codes in their order (ord), with name, unit and area of each.

    values may have name and unit of their own, which come before those of items (code, name, unit, area, area_name); an
    empty one counts as none, and the code stands in for a missing name. An unknown place, one that is no county (level), an
    untyped place compared by type, and a year that is no number raise.
    """
    mine = places.filter(F.col("place") == place).select("type", *(["level"] if "level" in places.columns else [])).first()
    if mine is None:
        raise ValueError(f"unknown place {place!r}")
    if "level" in places.columns and mine["level"] != "시군구":
        raise ValueError(f"{place!r} is no county")
    if basis == "type" and mine["type"] is None:
        raise ValueError(f"{place!r} has no type to compare by")
    if year is not None:
        try:
            year = int(year)
        except (TypeError, ValueError):
            raise ValueError(f"{year!r} is no year") from None
    counties = places.filter("level = '시군구'") if "level" in places.columns else places
    rows = analyze(values, counties, basis, place, codes, year)
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    known = {c: F.col(c) if c in values.columns else F.lit(None).cast("string") for c in ("name", "unit")}
    own = values.select("code", *[v.alias(c) for c, v in known.items()]).groupBy("code").agg(*[F.max(said(c)).alias(f"_{c}") for c in known])
    one = items.groupBy("code").agg(F.min(F.struct("name", "unit", "area", "area_name")).alias("i"))
    asked = values.sparkSession.createDataFrame([(c, i) for i, c in enumerate(codes)], "code string, ord int")
    out = asked.join(rows, "code").join(own, "code", "left").join(one, "code", "left")
    return out.select("ord", *rows.columns, F.coalesce(said("_name"), said("i.name"), F.col("code")).alias("name"), F.coalesce(said("_unit"), said("i.unit"), F.lit("")).alias("unit"), F.col("i.area").alias("area"), F.col("i.area_name").alias("area_name"))


def place_names(places: DataFrame, types: DataFrame) -> DataFrame:
    """(place, name, type_label): a province by its name, a county with its province before it; the label of its type, null without one."""
    name = F.when(F.col("level") == "시도", F.col("province")).otherwise(F.concat_ws(" ", "province", "county"))
    return places.join(types.select(F.col("type").alias("_t"), "label"), F.col("type") == F.col("_t"), "left").select("place", name.alias("name"), F.col("label").alias("type_label"))


def provinces(places: DataFrame, order: str) -> DataFrame:
    """(province, ord): each province once, in the order in which they first come."""
    first = places.groupBy("province").agg(F.min(order).alias("_o"))
    return first.select("province", F.row_number().over(W.orderBy("_o")).alias("ord"))


def bands(rows: DataFrame) -> DataFrame:
    """Rows of analyze() with band: below or above the quartiles, else inside, also where there are none."""
    return rows.withColumn("band", F.when(F.col("mine") < F.col("q1"), "below").when(F.col("mine") > F.col("q3"), "above").otherwise("inside"))


def positioned(rows: DataFrame) -> DataFrame:
    """Rows that can be ranked (a value, a rank, RANKABLE members at least) with position, the middle of the rank in percent of the group."""
    return rows.filter(F.col("mine").isNotNull() & F.col("rank").isNotNull() & (F.col("n") >= RANKABLE)).withColumn("position", (F.col("rank") - 0.5) / F.col("n") * 100)


def listed(rows: DataFrame, k: int, order: str = "code") -> DataFrame:
    """The rankable rows with list: high and low (the k first and last by position), outside or inside the quartiles for the rest, and nth within it.

    With fewer than 2k rows of a place, high has half of them, rounded up, and low the others. Ties go by `order`. Rows
    without quartiles are inside.
    """
    w = W.partitionBy("place")
    at = F.row_number().over(w.orderBy("position", order))
    numbered = positioned(rows).withColumns({"_at": at, "_all": F.count("*").over(w)})
    high = F.when(F.col("_all") < 2 * k, F.ceil(F.col("_all") / 2)).otherwise(k)
    low = F.when(F.col("_all") < 2 * k, F.col("_all") - F.ceil(F.col("_all") / 2)).otherwise(k)
    beyond = F.coalesce((F.col("mine") < F.col("q1")) | (F.col("mine") > F.col("q3")), F.lit(False))
    name = F.when(F.col("_at") <= high, "high").when(F.col("_at") > F.col("_all") - low, "low").when(beyond, "outside").otherwise("inside")
    nth = F.when(F.col("list") == "high", F.col("_at")).when(F.col("list") == "low", F.col("_all") - F.col("_at") + 1).otherwise(F.row_number().over(W.partitionBy("place", "list").orderBy(order)))
    return numbered.withColumn("list", name).withColumn("nth", nth.cast("int")).drop("_at", "_all")


def top_bottom(rows: DataFrame, k: int) -> DataFrame:
    """The k highest and lowest codes of each place by position in the group; a code is in one list only."""
    sides = F.when(F.col("list") == "high", "top").otherwise("bottom")
    return listed(rows, k).filter("list in ('high', 'low')").select("place", "code", sides.alias("list"), "rank", "n")


def report_facts(rows: DataFrame) -> DataFrame:
    """(place, codes, n_min, n_max, year_min, year_max, missing, missing_names): what the head of a report says; names of three codes without a value at most."""
    none = F.col("mine").isNull()
    names = F.slice(F.transform(F.sort_array(F.collect_list(F.when(none, F.struct("code")))), lambda x: x["code"]), 1, 3)
    return rows.groupBy("place").agg(F.count("*").alias("codes"), F.coalesce(F.min(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("n_min"), F.coalesce(F.max(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("n_max"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count(F.when(none, 1)).alias("missing"), F.array_join(names, ", ").alias("missing_names"))


def report_lines(rows: DataFrame, k: int, basis: str) -> DataFrame:
    """(place, list, nth, line): a report's line for each rankable row of analyze_place() or of analyze() with name and unit.

    High and low ones name rank, share of the group and averages, those outside the quartiles the quartiles and the side.
    Those inside have their name only.
    """
    from tidewater.functions.numbers import reference

    unit = F.when(F.col("unit") != "", F.concat(F.lit(" "), "unit")).otherwise("")
    value = lambda c: F.concat(reference(F.col(c)), unit)
    share = lambda v: F.greatest(F.lit(1), F.round(v)).cast("int").cast("string")
    head = F.concat(F.lit("- "), "name", F.lit(" "), value("mine"), F.lit("("), F.col("year").cast("string"), F.lit("년) — 비교집단 "), F.col("n").cast("string"), F.lit("곳 중 "), F.col("rank").cast("string"), F.lit("위"))
    side = F.when(F.col("list") == "high", F.concat(F.lit("(상위 "), share(F.col("position")), F.lit("%)"))).otherwise(F.concat(F.lit("(하위 "), share(100 - F.col("position")), F.lit("%)")))
    average = lambda who, n, c: F.concat(F.lit(who), F.col(n).cast("string"), F.lit("곳 평균 "), value(c))
    bits = []
    if basis != "type":
        bits.append(F.when(F.col("peer_n") > 0, average("같은 유형 ", "peer_n", "peer_avg")))
    if basis != "nation":
        bits.append(F.when(F.col("nation_n") > 0, average("전국 ", "nation_n", "nation_avg")))
    more = F.array_join(F.filter(F.array(*bits), lambda x: x.isNotNull()), " / ") if bits else F.lit("")
    long = F.concat(head, side, F.lit(", 비교평균 "), value("avg"), F.when(more != "", F.concat(F.lit("\n· "), more)).otherwise(""))
    beyond = F.concat(head, F.lit(", Q1~Q3 "), reference(F.col("q1")), F.lit("~"), value("q3"), F.when(F.col("mine") > F.col("q3"), " 위").otherwise(" 아래"))
    line = F.when(F.col("list").isin("high", "low"), long).when(F.col("list") == "outside", beyond).otherwise(F.col("name"))
    return listed(rows, k, "ord" if "ord" in rows.columns else "code").select("place", "list", "nth", line.alias("line"))


# Sentences of a report.
TITLE, COMPARED, GROUP_SIZE = "#### 지표로 본 지역 여건", "○ 비교 기준 — %s, %s 비교, 대상 지표 %d개", "- 비교집단 규모는 지표별로 %s개 시·군·구이며, 결측 지역은 평균 계산에서 뺐다"
LATEST, MIXED = "- 각 지표는 자료가 나와 있는 최신연도 값을 썼다", " (%d~%d년 혼재)"
NO_TYPE, TYPE_IS, OF_TYPE, WITH_TYPE = "- %s%s 시·군·구 7유형 구분에 들어가 있지 않아 유형별 비교는 넣지 않았다", "- %s의 시·군·구 유형은 %s이고, ", "비교집단이 곧 같은 유형 시·군·구다", "같은 유형 평균을 함께 적었다"
NO_VALUE, TOO_FEW = "- 값이 비어 있는 지표 %d개(%s%s)는 해석에서 뺐다", "- 순위를 매길 수 있는 지표가 모자라 판단을 미룬다"
HIGH, LOW = "○ 비교집단에서 값이 큰 쪽 지표", "○ 비교집단에서 값이 작은 쪽 지표"
OUTSIDE, INSIDE = "○ 그 밖에 비교집단과 뚜렷이 다른 지표 %d개 (Q1~Q3 구간 밖)", "○ 비교집단과 비슷한 수준인 지표 %d개 (Q1~Q3 구간 안) — 개별 서술 생략"
DIAGNOSIS = ("○ 종합 진단과 정책 방향 — 담당자 작성", "- 위 차이들을 묶어 볼 때 우리 지역의 상태를 한 문장으로 → ○○○○", "- 그래서 어떤 영역에 무엇을 먼저 해야 하는지 → ○○○○", "- 이 진단이 제1절 추진전략과 어떻게 이어지는지 → ○○○○", "")
CAUTION = ("○ 해석 시 유의점", "- 값이 높다고 곧 여건이 좋은 것은 아니다. 지표마다 방향이 달라 개별 지표의 의미를 확인하고 읽는다")
DENOMINATOR, WITHOUT_TYPE = "- 순위는 비교집단 안에서 값이 큰 순서이며, 분모가 되는 지역 수(%s곳)를 함께 본다", "- 유형별 평균이 빠져 있으므로 광역·전국 평균으로만 견준다"
SOURCE = "※ 자료：보건복지부·한국보건사회연구원, 「지역사회보장지표」. 값은 지표별 최신연도 기준이며, 평균은 시·군·구 단순평균임."


def _sizes() -> Column:
    return F.when(F.col("n_min") == F.col("n_max"), F.col("n_max").cast("string")).otherwise(F.concat(F.col("n_min").cast("string"), F.lit("~"), F.col("n_max").cast("string")))


def report_head(rows: DataFrame, named: DataFrame, basis: str) -> DataFrame:
    """(place, head, typed): the lines above a report's lists, for the rows of report_lines() and places named (place, title, typed, type_label).

    A place without a type is told so; a missing value's code is named, three at most.
    """
    x = report_facts(rows).join(named.select("place", "title", "typed", "type_label"), "place")
    years = F.when(F.col("year_min").isNull(), "").when(F.col("year_min") == F.col("year_max"), F.format_string(" (%d년)", "year_max")).otherwise(F.format_string(MIXED, "year_min", "year_max"))
    kind = F.when(~F.col("typed"), F.format_string(NO_TYPE, F.col("title"), particle(F.col("title")))).when(F.col("type_label").isNotNull(), F.concat(F.format_string(TYPE_IS, "title", "type_label"), F.lit(OF_TYPE if basis == "type" else WITH_TYPE)))
    none = F.when(F.col("missing") > 0, F.format_string(NO_VALUE, F.col("missing"), F.col("missing_names"), F.when(F.col("missing") > 3, " 등").otherwise("")))
    lines = F.array(F.lit(TITLE), F.lit(""), F.format_string(COMPARED, F.col("title"), F.lit(LABELS[basis]), F.col("codes")), F.format_string(GROUP_SIZE, _sizes()), F.concat(F.lit(LATEST), years), kind, none, F.lit(""))
    return x.select("place", F.filter(lines, lambda v: v.isNotNull()).alias("head"), "typed", _sizes().alias("sizes"))


def report_text(rows: DataFrame, named: DataFrame, k: int, basis: str) -> DataFrame:
    """(place, text): a place's whole report, head, lists and cautions in order."""
    each = report_lines(rows, k, basis).groupBy("place")
    lists = each.agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("list") == n, F.struct("nth", "line")))), lambda v: v["line"]).alias(n) for n in ("high", "low", "outside", "inside")])
    empty = F.array().cast("array<string>")
    x = report_head(rows, named, basis).join(lists, "place", "left").withColumns({n: F.coalesce(n, empty) for n in ("high", "low", "outside", "inside")})

    def side(name: str, title: str) -> Column:
        some = F.size(name) > 0
        return F.concat(F.array(F.concat(F.lit(title), F.when(some, F.format_string(" %d개", F.size(name))).otherwise(""))), F.when(some, F.col(name)).otherwise(F.array(F.lit(TOO_FEW))), F.array(F.lit("")))

    outside = F.when(F.size("outside") > 0, F.concat(F.array(F.format_string(OUTSIDE, F.size("outside"))), F.col("outside"), F.array(F.lit("")))).otherwise(empty)
    inside = F.when(F.size("inside") > 0, F.array(F.format_string(INSIDE, F.size("inside")), F.concat(F.lit("- "), F.array_join("inside", ", ")), F.lit(""))).otherwise(empty)
    end = F.concat(F.lit(list(DIAGNOSIS + CAUTION)), F.array(F.format_string(DENOMINATOR, "sizes")), F.when(~F.col("typed"), F.array(F.lit(WITHOUT_TYPE))).otherwise(empty), F.array(F.lit(""), F.lit(SOURCE)))
    return x.select("place", F.array_join(F.concat("head", side("high", HIGH), side("low", LOW), outside, inside, end), "\n").alias("text"))


def trend(values: DataFrame, places: DataFrame, basis: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Per place, code and year: its value, its group's average, count and quartiles (from four members on), the nation's average."""
    if first is not None:
        values = values.filter(F.col("year") >= first)
    if last is not None:
        values = values.filter(F.col("year") <= last)
    values = finite(values)
    known = values.join(places, "place").withColumn("g", group_of(basis)).filter("g is not null")
    groups = box_stats(known, "code", "year", "g").withColumns({q: F.when(F.col("n") >= QUARTILES_FROM, F.col(q)) for q in ("q1", "q3")})
    nation = values.groupBy("code", "year").agg(F.avg("value").alias("nation_avg"))
    out = known.join(groups, ["code", "year", "g"]).join(nation, ["code", "year"])
    return out.select("place", "code", "year", F.col("value").alias("mine"), "avg", "n", "q1", "q3", "nation_avg")


def noteworthy(rows: DataFrame) -> DataFrame:
    """(place, code, years, score) of trend() rows for codes with two values of the place at least.

    The score is the distance from the quartiles in the last year that has all three, in widths of their range;
    0 inside, -1 without quartiles.
    """
    width = F.coalesce(F.nullif(F.abs(F.col("q3") - F.col("q1")), F.lit(0.0)), F.nullif(F.abs("q3"), F.lit(0.0)), F.lit(1.0))
    score = F.when(F.col("mine") < F.col("q1"), (F.col("q1") - F.col("mine")) / width).when(F.col("mine") > F.col("q3"), (F.col("mine") - F.col("q3")) / width).otherwise(0.0)
    ready = F.col("mine").isNotNull() & F.col("q1").isNotNull() & F.col("q3").isNotNull()
    scored = rows.withColumn("s", F.when(ready, F.struct("year", score.alias("score"))))
    out = scored.groupBy("place", "code").agg(F.count("mine").alias("years"), F.max("s").alias("s")).filter("years >= 2")
    return out.select("place", "code", "years", F.coalesce("s.score", F.lit(-1.0)).alias("score"))


def pick(scores: DataFrame, k: int, wanted: list[str] | None = None) -> DataFrame:
    """The k most noteworthy codes of each place, then in the order of the request (wanted), else of code; so are ties.
    Codes that weren't requested go."""
    place = F.array_position(F.lit(wanted), F.col("code")) if wanted else F.lit(0)
    asked = scores.withColumn("_p", place).filter(F.lit(not wanted) | (F.col("_p") > 0))
    r = F.row_number().over(W.partitionBy("place").orderBy(F.desc("score"), "_p", "code"))
    kept = asked.withColumn("r", r).filter(F.col("r") <= k)
    return kept.withColumn("ord", F.row_number().over(W.partitionBy("place").orderBy("_p", "code"))).select("place", "code", "score", "ord")


def direction(rows: DataFrame) -> DataFrame:
    """(place, code, first, last, direction): up or down beyond 2 percent of the first value, else flat."""
    ends = rows.filter("mine is not null").groupBy("place", "code").agg(F.min_by("mine", "year").alias("first"), F.max_by("mine", "year").alias("last"), F.count("*").alias("n")).filter("n >= 2")
    change, band = F.col("last") - F.col("first"), F.abs(F.coalesce(F.nullif("first", F.lit(0.0)), F.lit(1.0))) * 0.02
    return ends.select("place", "code", "first", "last", F.when(F.abs(change) < band, "flat").when(change > 0, "up").otherwise("down").alias("direction"))


def trend_facts(rows: DataFrame) -> DataFrame:
    """direction() with, for the last year that has a value: the gap to the group's average and whether it lies within the quartiles (null without them)."""
    last = rows.filter("mine is not null").groupBy("place", "code").agg(F.max_by(F.struct("year", "mine", "avg", "q1", "q3"), "year").alias("x"))
    within = (F.col("x.mine") >= F.col("x.q1")) & (F.col("x.mine") <= F.col("x.q3"))
    return direction(rows).join(last, ["place", "code"]).select("place", "code", "first", "last", "direction", F.col("x.year").alias("year"), (F.col("x.mine") - F.col("x.avg")).alias("gap"), within.alias("within"))


def chunks(rows: DataFrame, order: list[str], most: int, *keys: str) -> DataFrame:
    """The rows with chunk, from 0: as few chunks of at most `most` as there must be, all of the same size but a smaller last one."""
    w = W.partitionBy(*keys)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1
    size = F.ceil(F.col("_n") / F.ceil(F.col("_n") / most))
    return rows.withColumns({"_n": n, "_i": i}).withColumn("chunk", F.floor(F.col("_i") / size).cast("int")).drop("_n", "_i")
