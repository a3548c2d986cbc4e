"""Usage ledgers by the day of a zone, ordered fallback among models, and what an error message says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"
# Families of models with reference limits a day, a minute and in tokens a minute; names that are passed over.
FAMILIES = (("flash-lite", "Flash-Lite", 1000, 15, 250_000), ("flash", "Flash", 250, 10, 250_000), ("pro", "Pro", 100, 5, 250_000))
SKIPPED = "exp|experimental|preview|tts|image|embed|live|audio|thinking"
FAULTS = (
    ("key", "api key|permission|expired"), ("billing", r"prepay|credits?\s+(are|is)\s+depleted|out of credits"), ("daily", r"per\s*day|PerDay|requests_per_day|free_tier_requests"),
    ("retired", "no longer available|not available to new users|deprecated|discontinued"),
)


def zone_day(ts: Column, zone: str = ZONE) -> Column:
    """The calendar day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def next_reset(ts: Column, zone: str = ZONE) -> Column:
    """The instant of the zone's next midnight, across changes of its offset."""
    return F.to_utc_timestamp(F.date_add(zone_day(ts, zone), 1).cast("timestamp"), zone)


def until_reset(ts: Column, zone: str = ZONE) -> Column:
    """(hours, minutes) until the zone's next midnight."""
    left = F.greatest(F.lit(0), F.unix_timestamp(next_reset(ts, zone)) - F.unix_timestamp(ts.cast("timestamp")))
    return F.struct(F.floor(left / 3600).cast("int").alias("hours"), F.floor(left % 3600 / 60).cast("int").alias("minutes"))


def reset_text(ts: Column, local: str, zone: str = ZONE) -> Column:
    """The zone's next midnight in another zone: month, day, hour and minute."""
    return F.date_format(F.from_utc_timestamp(next_reset(ts, zone), local), "M.d. HH:mm")


def usage(events: DataFrame, model: str, ts: str, exhausted: Column, zone: str = ZONE, limit: Column | None = None) -> DataFrame:
    """(day, model, n, exhausted) per day of the zone, with limit also the last positive one that an event named."""
    more = [] if limit is None else [F.max_by(F.when(limit > 0, limit), F.when(limit > 0, F.col(ts))).alias("limit")]
    return events.withColumn("day", zone_day(F.col(ts), zone)).groupBy("day", F.col(model).alias("model")).agg(F.count("*").alias("n"), F.max(exhausted).alias("exhausted"), *more)


def daily(ledger: DataFrame) -> DataFrame:
    """(day, total, models, exhausted): all uses of a day, how many models, and the names of the exhausted ones in order."""
    names = F.sort_array(F.collect_set(F.when(F.col("exhausted"), F.col("model"))))
    return ledger.groupBy("day").agg(F.sum("n").alias("total"), F.count("*").alias("models"), names.alias("exhausted"))


def usable(models: DataFrame, ledger: DataFrame) -> DataFrame:
    """(day, model, ...) rows of models that aren't exhausted on their day."""
    return models.join(ledger.filter("exhausted").select("day", "model"), ["day", "model"], "left_anti")


def safe(name: Column) -> Column:
    """Whether a name can stand in an address: letters, digits, dots, hyphens and underscores, no two dots in a row."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~name.contains("..")


def wanted(name: Column) -> Column:
    """The model's name without a leading `models/`; null for names that aren't safe or of a kind that is passed over."""
    n = F.regexp_replace(name, "^models/", "")
    return F.when(safe(n) & ~n.rlike(f"(?i){SKIPPED}"), n)


def model_order(name: Column, place: Column) -> Column:
    """Sorts flash models first, of them lite before others, newer versions before older, then by name; all others keep their place."""
    version = lambda i: F.coalesce(F.regexp_extract(name, r"(\d+)\.(\d+)", i).try_cast("int"), F.lit(0))
    flash = name.contains("flash")
    of_flash = lambda c: F.when(flash, c)
    return F.struct(F.when(flash, 0).otherwise(1).alias("rest"), of_flash(F.when(name.contains("lite"), 0).otherwise(1)).alias("lite"), of_flash(-(version(1) * 100 + version(2))).alias("version"), of_flash(name).alias("name"), F.when(~flash, place).alias("place"))


def ordered_models(models: DataFrame, keys: list[str], name: str, place: str) -> DataFrame:
    """(keys, name, nth): the wanted models of a list, in the order in which they are tried."""
    known = models.withColumn(name, wanted(F.col(name))).filter(F.col(name).isNotNull())
    return known.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(model_order(F.col(name), F.col(place))))).select(*keys, name, "nth")


def default_model(models: DataFrame, keys: list[str], name: str, place: str) -> DataFrame:
    """(keys, name): the first flash-lite model in that order."""
    return ordered_models(models, keys, name, place).filter(F.lower(name).contains("flash-lite")).groupBy(*keys).agg(F.min_by(name, "nth").alias(name))


def preferred_model(models: DataFrame, successes: DataFrame, keys: list[str], name: str, place: str, ts: str) -> DataFrame:
    """(keys, name): the model that worked last, if it is still among the wanted ones; else the default."""
    last = successes.groupBy(*keys).agg(F.max_by(name, ts).alias(name))
    alive = last.join(ordered_models(models, keys, name, place).select(*keys, name).distinct(), [*keys, name], "left_semi")
    other = default_model(models, keys, name, place).withColumnRenamed(name, "_d")
    return alive.join(other, keys, "full").select(*keys, F.coalesce(name, "_d").alias(name))


def limits_of(ledger: DataFrame) -> DataFrame:
    """The ledger with rpd, source and label: the limit seen on the day, else that of the first family in the name, else none."""
    family = None
    for word, label, day, minute, tokens in FAMILIES:
        is_one = F.lower("model").contains(word)
        one = F.struct(F.lit(label).alias("label"), F.lit(day).alias("rpd"), F.lit(minute).alias("rpm"), F.lit(tokens).alias("tpm"))
        family = F.when(is_one, one) if family is None else family.when(is_one, one)
    seen = F.coalesce(F.col("limit") > 0, F.lit(False))
    out = ledger.withColumn("_f", family)
    source = F.when(seen, "observed").when(F.col("_f").isNotNull(), "reference").otherwise("unknown")
    return out.withColumns({"rpd": F.when(seen, F.col("limit")).otherwise(F.coalesce("_f.rpd", F.lit(0))), "source": source, "label": F.coalesce("_f.label", F.lit(""))}).drop("_f")


def fault(message: Column) -> Column:
    """What kind of fault a message tells of: key, billing, daily, retired or other; the first that fits."""
    out = None
    for name, words in FAULTS:
        hit = F.coalesce(message, F.lit("")).rlike(f"(?i){words}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def limit_in(message: Column) -> Column:
    """The limit that a message names; 0 without one."""
    return F.coalesce(F.regexp_extract(message, r"(?i)limit:\s*(\d+)", 1).try_cast("long"), F.lit(0))


def replacement_in(message: Column) -> Column:
    """The model that a message says to use instead; empty without one that is wanted."""
    name = F.regexp_extract(message, r"(?i)use\s+models/([A-Za-z0-9._-]+)", 1)
    return F.coalesce(F.when(name != "", wanted(name)), F.lit(""))
