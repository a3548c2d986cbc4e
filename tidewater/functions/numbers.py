"""Number formats: grouped numbers with few decimals, ones of fixed decimals by the exact binary value, ticks of an axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EOK, JO = 1e8, 1e12  # fixed values: units of large amounts


def grouped(v: Column, decimals: int) -> Column:
    """Half away from zero on the shortest decimal, thousands grouped, trailing zeros dropped."""
    text = F.format_number(F.round(v, decimals), decimals)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if decimals else text


def fixed(v: Column, decimals: int) -> Column:
    """v (below 1,000 in size) with so many decimals, rounding its exact binary value half away from zero.

    A cast to decimal takes the shortest digits that mean the double, not its binary value. So the number is compared with the
    half between its neighbours, and where it equals the double next to that half, the rest of the division decides.
    """
    scale = float(10**decimals)
    size = F.abs(v)
    down = F.floor(size * scale)
    half = (down + 0.5) / scale
    slack = _remainder(half, scale, down + 0.5)
    more = (size > half) | ((size == half) & (slack >= 0))
    whole = F.when(more, down + 1).otherwise(down)
    digits = F.lpad(whole.cast("string"), decimals + 1, "0") if decimals else whole.cast("string")
    long = F.length(whole.cast("string")) > decimals
    text = F.when(long, whole.cast("string")).otherwise(digits)
    if decimals:
        text = F.concat(F.substring(text, F.lit(1), F.length(text) - decimals), F.lit("."), F.substring(text, F.length(text) - decimals + 1, F.lit(decimals)))
    return F.concat(F.when((v < 0) & (whole > 0), "-").otherwise(""), text)


def _remainder(q: Column, scale: float, product: Column) -> Column:
    """q * scale - product without rounding: q is split in two halves of 26 bits, whose products with a small number are exact."""
    c = q * float((1 << 27) + 1)
    high = c - (c - q)
    low = q - high
    return (high * scale - product) + low * scale


def amount(v: Column, unit: str = "") -> Column:
    """조 with two decimals and 억 with one for large amounts; else grouped, three decimals from 1,000, two below; null: —."""
    size = F.abs(v)
    text = (
        F.when(size >= JO, F.concat(grouped(v / JO, 2), F.lit("조"))).when(size >= EOK, F.concat(grouped(v / EOK, 1), F.lit("억")))
        .when((size >= 1000) | (v == F.floor(v)), grouped(v, 3)).otherwise(grouped(v, 2))
    )
    return F.when(v.isNull(), "—").otherwise(F.concat(text, F.lit(f" {unit}" if unit else "")))


def plain(v: Column) -> Column:
    """Grouped from 1,000; one decimal from 100; else two; null and NaN: –."""
    size = F.abs(v)
    return F.when(v.isNull() | F.isnan(v), "–").when(size >= 1000, grouped(v, 0)).when(size >= 100, fixed(v, 1)).otherwise(fixed(v, 2))


def reference(v: Column) -> Column:
    """plain(), but amount() from 1e8."""
    return F.when(~F.isnan(v) & (F.abs(v) >= EOK), amount(v)).otherwise(plain(v))


def ticks(low: Column, high: Column) -> Column:
    """Values of an axis from low to high, 1, 2, 2.5 or 5 times a power of ten apart, so that there are about five."""
    raw = (high - low) / 5
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.coalesce(*[F.when(size * m >= raw, size * m) for m in (1.0, 2.0, 2.5, 5.0, 10.0)], size * 10)
    first, last = F.ceil(low / step), F.floor((high + step * 1e-9) / step)
    some = F.transform(F.sequence(first, last), lambda k: F.round(k * step, 10))
    return F.when(high > low, F.when(last >= first, some).otherwise(F.array(low, high))).otherwise(F.array(low))


# Signs of counters, in order.
ROMANS, CIRCLED, SYLLABLES = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ", "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮", "가나다라마바사아자차카타파하"


def counter(n: Column, kind: Column) -> Column:
    """A counter as it is written before a line, by its kind; signs begin anew when they run out. Empty for no kind."""
    sign = lambda signs: F.substring(F.lit(signs), (F.pmod(n - 1, F.lit(len(signs))) + 1).cast("int"), F.lit(1))
    plain_number = n.cast("string")
    return (
        F.when(kind == "AUTO_ROMAN", F.concat(sign(ROMANS), F.lit(". "))).when(kind == "AUTO_NUM", F.concat(plain_number, F.lit(". "))).when(kind == "AUTO_PAREN", F.concat(plain_number, F.lit(") ")))
        .when(kind == "AUTO_ALPHA", F.concat(sign("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(". "))).when(kind == "AUTO_CIRCLED", F.concat(sign(CIRCLED), F.lit(" "))).when(kind == "AUTO_HANGUL", F.concat(sign(SYLLABLES), F.lit(". ")))
        .otherwise("")
    )
