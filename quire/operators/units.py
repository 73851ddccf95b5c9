"""Measurements in common units (problem 1).

Distinct unit spellings are few against the rows. Each is mapped once to a known
unit: an inverted index of character bigrams proposes units of the metric's
quantity, a weighted edit distance confirms, and the resulting dictionary is
joined to all rows. Numbers and units are read from ``raw_text`` first, since it
holds where the columns disagree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from quire.session import durable

# Quantity, unit, size in the quantity's base unit, spellings.
UNITS = [
    ("time", "ns", 1e-9, ["ns", "nsec", "nanosec", "nanosecond", "nanoseconds"]),
    ("time", "us", 1e-6, ["us", "µs", "μs", "usec", "µsec", "microsec", "microsecond", "microseconds"]),
    ("time", "ms", 1e-3, ["ms", "msec", "msecs", "millisec", "millisecs", "millisecond", "milliseconds"]),
    ("time", "s", 1.0, ["s", "sec", "secs", "second", "seconds"]),
    ("time", "min", 60.0, ["min", "mins", "minute", "minutes", "m"]),
    ("time", "h", 3600.0, ["h", "hr", "hrs", "hour", "hours"]),
    ("time", "d", 86400.0, ["d", "day", "days"]),
    ("time", "wk", 604800.0, ["wk", "wks", "week", "weeks"]),
    ("memory", "B", 1.0, ["B", "byte", "bytes"]),
    ("memory", "KB", 1e3, ["KB", "kB", "Kbyte", "Kbytes", "kilobyte", "kilobytes"]),
    ("memory", "MB", 1e6, ["MB", "Mbyte", "Mbytes", "megabyte", "megabytes"]),
    ("memory", "GB", 1e9, ["GB", "Gbyte", "Gbytes", "gigabyte", "gigabytes", "gig", "gigs"]),
    ("memory", "TB", 1e12, ["TB", "Tbyte", "Tbytes", "terabyte", "terabytes"]),
    ("memory", "KiB", 1024.0, ["KiB", "kibibyte", "kibibytes"]),
    ("memory", "MiB", 1024.0**2, ["MiB", "mebibyte", "mebibytes"]),
    ("memory", "GiB", 1024.0**3, ["GiB", "gibibyte", "gibibytes"]),
    ("memory", "TiB", 1024.0**4, ["TiB", "tebibyte", "tebibytes"]),
    ("count", "one", 1.0, ["count", "parameter", "parameters", "params", "weights", "units"]),
    ("count", "K", 1e3, ["K", "k", "thousand", "thousands", "Kparams", "thsd", "kilo"]),
    ("count", "M", 1e6, ["M", "m", "million", "millions", "mio", "mil", "mln", "Mparams", "mega"]),
    ("count", "B", 1e9, ["B", "b", "bn", "billion", "billions", "bln", "Bparams", "G", "giga"]),
    ("count", "T", 1e12, ["T", "trillion", "trillions", "trn"]),
    ("compute", "FLOPs", 1.0, ["FLOP", "FLOPs"]),
    ("compute", "KFLOPs", 1e3, ["KFLOP", "KFLOPs", "kiloflops"]),
    ("compute", "MFLOPs", 1e6, ["MFLOP", "MFLOPs", "megaflops"]),
    ("compute", "GFLOPs", 1e9, ["GFLOP", "GFLOPs", "gigaflops"]),
    ("compute", "TFLOPs", 1e12, ["TFLOP", "TFLOPs", "teraflops"]),
    ("compute", "PFLOPs", 1e15, ["PFLOP", "PFLOPs", "petaflops"]),
    ("share", "%", 0.01, ["%", "pct", "percent", "per cent", "pc", "percentage", "percents", "prozent"]),
    ("share", "fraction", 1.0, ["fraction", "ratio", "frac", "proportion", "share", "fractions"]),
    ("share", "permille", 0.001, ["‰", "permille", "per mille"]),
    ("energy", "J", 1.0, ["J", "joule", "joules"]),
    ("energy", "kJ", 1e3, ["kJ", "kilojoule", "kilojoules"]),
    ("energy", "MJ", 1e6, ["MJ", "megajoule", "megajoules"]),
    ("energy", "Wh", 3600.0, ["Wh", "watt-hour", "watt-hours", "watthours"]),
    ("energy", "kWh", 3.6e6, ["kWh", "kilowatt-hour", "kilowatt-hours", "kilowatthours", "kw-h"]),
    ("energy", "MWh", 3.6e9, ["MWh", "megawatt-hour", "megawatt-hours"]),
    ("power", "mW", 1e-3, ["mW", "milliwatt", "milliwatts"]),
    ("power", "W", 1.0, ["W", "watt", "watts"]),
    ("power", "kW", 1e3, ["kW", "kilowatt", "kilowatts"]),
    ("power", "MW", 1e6, ["MW", "megawatt", "megawatts"]),
    ("rate", "images/s", 1.0, ["images/s", "images/sec", "images per second", "image/s", "img/s", "img/sec", "imgs/s", "imgs/sec", "images per sec", "ips"]),
    ("rate", "k images/s", 1e3, ["k images/s", "k img/s", "k images per second", "thousand images/s", "thousand images per second", "kimages/s"]),
    ("rate", "images/min", 1 / 60, ["images/min", "images per minute", "img/min", "imgs/min", "images/minute"]),
    ("rate", "images/h", 1 / 3600, ["images/h", "images/hour", "images per hour", "img/h"]),
    ("level", "dB", 1.0, ["dB", "decibel", "decibels"]),
]

NUMBER = r"[-+]?[0-9](?:[0-9.,'’   ]*[0-9])?(?:\s*[eE][-+]?[0-9]+|\s*[x×*]\s*10\s*\^?\s*[-+]?[0-9]+)?"
#: A spelling is the known unit if the weighted distance stays under this part of its length.
SLACK = 0.34


def folded(unit: Column) -> Column:
    """A unit spelling without outer blanks, closing full stop and doubled blanks; case kept."""
    return F.regexp_replace(F.regexp_replace(F.trim(unit), r"\.+$", ""), r"\s+", " ")


def _bare(unit: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(unit), "µμ", "uu"), r"[\s\-_.·]+", "")


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which case, plural, blanks and hyphens cost little and first letters much.

    The case of a first letter counts, as ``mW`` and ``MW`` differ in it.
    """

    def put(ch: str, at: int) -> float:
        return 0.1 if ch in " -_." else 0.3 if ch in "sS" and at else 1.0

    n, m = len(a), len(b)
    row = [0.0]
    for j in range(m):
        row.append(row[-1] + put(b[j], j))
    for i in range(n):
        new = [row[0] + put(a[i], i)]
        for j in range(m):
            if a[i] == b[j]:
                swap = 0.0
            elif a[i].lower() == b[j].lower() or {a[i], b[j]} <= set("uµμ"):
                swap = 0.25 if i == 0 or j == 0 else 0.05
            else:
                swap = 2.0 if i == 0 and j == 0 else 1.2
            new.append(min(row[j] + swap, row[j + 1] + put(a[i], i), new[j] + put(b[j], j)))
        row = new
    return row[m]


@F.pandas_udf(DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)])


def known_units(spark) -> DataFrame:
    """(quantity, known, factor, alias): every known spelling."""
    rows = [(q, u, float(f), a) for q, u, f, names in UNITS for a in names]
    return spark.createDataFrame(rows, "quantity string, known string, factor double, alias string")


def _grams(text: Column) -> Column:
    padded = F.concat(F.lit("^"), _bare(text), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(2))))


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """(quantity, spelling, known, factor) for distinct (quantity, spelling) rows.

    A spelling meets the aliases of its quantity that share a bigram with it in
    the inverted index, and takes the nearest by the weighted distance, ties going
    to the larger bigram overlap, then the first alias. Spellings near nothing are
    left out.
    """
    known = known_units(spellings.sparkSession)
    index = known.withColumn("gram", F.explode(_grams(F.col("alias"))))
    asked = spellings.where("spelling is not null and spelling != ''").distinct()
    hits = (
        asked.withColumn("gram", F.explode(_grams(F.col("spelling"))))
        .join(F.broadcast(index), ["quantity", "gram"])
        .groupBy("quantity", "spelling", "known", "factor", "alias")
        .agg(F.count("*").alias("shared"))
    )
    near = hits.withColumn("distance", _distance(F.col("spelling"), F.col("alias")))
    near = near.where(F.col("distance") <= F.greatest(F.lit(0.3), SLACK * F.length("alias")))
    best = F.struct(F.col("distance"), (-F.col("shared")).alias("shared"), F.col("alias"))
    picked = near.groupBy("quantity", "spelling").agg(F.min_by(F.struct("known", "factor"), best).alias("u"))
    return picked.select("quantity", "spelling", F.col("u.known").alias("known"), F.col("u.factor").alias("factor"))


def number(said: Column, hint: Column | None = None) -> Column:
    """The number a string writes, with decimal commas, group marks and powers of ten.

    One mark before exactly three digits is open: the reading equal to ``hint``
    is taken where there is one, else a comma groups and a point does not.
    """
    mantissa = F.regexp_extract(said, r"^([-+]?[0-9](?:[0-9.,'’   ]*[0-9])?)", 1)
    power = F.coalesce(F.regexp_extract(said, r"(?:[eE]|10\s*\^?\s*)([-+]?[0-9]+)\s*$", 1).try_cast("int"), F.lit(0))
    has_power = said.rlike(r"[eEx×*]")
    bare = F.regexp_replace(mantissa, r"['’   ]", "")
    grouped = F.regexp_replace(bare, "[.,]", "").try_cast("double")
    as_decimal = F.regexp_replace(bare, ",", ".").try_cast("double")
    last = F.regexp_extract(bare, r"([.,])[0-9]*$", 1)
    mixed = F.when(last == ",", F.translate(F.regexp_replace(bare, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(bare, ",", "")).try_cast("double")
    open_ = bare.rlike(r"^[-+]?[1-9][0-9]{0,2}[.,][0-9]{3}$")
    by_mark = F.when(bare.contains(","), grouped).otherwise(as_decimal)
    if hint is not None:
        near = lambda x: F.abs(x - hint) <= F.abs(hint) * 1e-6
        by_mark = F.when(near(grouped), grouped).when(near(as_decimal), as_decimal).otherwise(by_mark)
    value = (
        F.when(bare.rlike(r"^[-+]?[0-9]{1,3}([.,])[0-9]{3}(?:\1[0-9]{3})+$"), grouped)
        .when(bare.rlike(r"[.,].*[.,]"), mixed)
        .when(open_ & ~has_power, by_mark)
        .otherwise(as_decimal)
    )
    return F.when(has_power, value * F.pow(F.lit(10.0), power)).otherwise(value)


def readings(results: DataFrame) -> DataFrame:
    """Adds what ``raw_text`` says: ``said`` (number as written), ``said_unit``, ``second``, ``second_unit``.

    Run counts, data set names and the metric's name are left out first. A unit in
    brackets before the number and one after it are both read; ``24 h 45 min`` and
    ``3:20 h:min`` give a second number.
    """
    raw = F.trim(F.coalesce("raw_text", F.lit("")))
    text = F.regexp_replace(raw, r",?\s*averaged over [0-9]+ runs?\.?$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^reached\s+", ""), r"\s+on\s+\p{Lu}\S*\s*\.?$", "")
    named = F.lower(F.translate(text, "_", " "))
    metric = F.lower(F.translate(F.trim("metric"), "_", " "))
    at = F.instr(named, F.coalesce(metric, F.lit("\u0000")))
    after = F.substring(text, at + F.length(metric), F.length(text))
    rest = F.when((at > 0) & after.rlike("[0-9]"), after).otherwise(text)
    bracket = r"[(\[]\s*([^()\[\]]+?)\s*[)\]]\s*[:=]?\s*"
    out = results.withColumn("_rest", rest)
    clock = r"([0-9]+):([0-9]{2})\s*h:min"
    big, small = "(d|days?|h|hrs?|hours?|m|mins?|minutes?)", "(h|hrs?|hours?|m|mins?|minutes?|s|secs?|seconds?)"
    pair = rf"([0-9][0-9.,]*)\s*{big}\b\s*(?:and\b|,)?\s*([0-9][0-9.,]*)\s*{small}\s*\.?$|([0-9]+){big}([0-9]+){small}\s*\.?$"
    is_clock, is_pair = F.col("_rest").rlike(clock), F.col("_rest").rlike(pair)
    first = lambda g, h: F.coalesce(F.nullif(F.regexp_extract("_rest", pair, g), F.lit("")), F.regexp_extract("_rest", pair, h))
    plain = F.regexp_extract("_rest", f"({NUMBER})", 1)
    behind = F.regexp_extract("_rest", f"^[^0-9]*(?>{NUMBER})\\s*([^0-9].*)$", 1)
    before = F.regexp_extract("_rest", f"{bracket}{NUMBER}", 1)
    unit = F.coalesce(F.nullif(before, F.lit("")), F.nullif(folded(behind), F.lit("")))
    return (
        out.withColumn("said", F.when(is_clock, F.regexp_extract("_rest", clock, 1)).when(is_pair, first(1, 5)).otherwise(F.nullif(plain, F.lit(""))))
        .withColumn("said_unit", F.when(is_clock, F.lit("h")).when(is_pair, first(2, 6)).otherwise(folded(unit)))
        .withColumn("second", F.when(is_clock, F.regexp_extract("_rest", clock, 2)).when(is_pair, first(3, 7)))
        .withColumn("second_unit", F.when(is_clock, F.lit("min")).when(is_pair, first(4, 8)))
        .drop("_rest")
    )


def measured(results: DataFrame, metric_units: DataFrame) -> DataFrame:
    """Every result with its measurement in the metric's common unit.

    (result_id, metric_name, common_unit, recorded, recorded_unit, is_mixed, common_value,
    is_converted). ``recorded_unit`` is the known unit the measurement was written
    in; null where there is no measurement or its unit is unknown, and then
    ``common_value`` is null. A percent metric without any unit is a fraction if
    at most 1. Null metrics and metrics not in the list give null units. Repeated
    rows stay; the text holds over the columns.
    """
    spark = results.sparkSession
    name = F.regexp_replace(F.lower(F.translate(F.trim("metric"), "_", " ")), r"\s+", " ")
    units = metric_units.select(name.alias("metric_name"), folded(F.col("common_unit")).alias("common_unit")).where("metric_name is not null").distinct()
    known = known_units(spark)
    # The quantity of a metric is that of its common unit; "M" and "B" are counts unless bytes or seconds fit.
    whole = known.select(F.col("alias").alias("common_unit"), "quantity", F.col("known").alias("common_known"), F.col("factor").alias("common_factor"))
    by_metric = units.join(F.broadcast(whole), "common_unit", "left")
    by_metric = by_metric.groupBy("metric_name", "common_unit").agg(
        F.min_by(F.struct("quantity", "common_known", "common_factor"), F.when((F.col("quantity") == "count") | (F.col("common_unit") == F.col("common_known")), 0).otherwise(1)).alias("q")
    ).select("metric_name", "common_unit", "q.*")
    read = readings(results.select("result_id", "metric", "value", "unit", "raw_text")).withColumn("metric_name", name)
    read = read.join(F.broadcast(by_metric), "metric_name", "left")
    own = F.nullif(folded(F.col("unit")), F.lit(""))
    said = F.col("said").isNotNull()
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    read = read.withColumn("recorded", F.when(said, number(F.col("said"), value)).otherwise(value))
    read = read.withColumn("spelling", F.when(said, F.coalesce("said_unit", own)).otherwise(own))
    # Read by the dictionary and by the rows it is joined to.
    read = durable(read.drop("metric", "unit", "raw_text", "said", "said_unit"))
    asked = read.select("quantity", "spelling").union(read.select("quantity", F.col("second_unit"))).where("quantity is not null")
    names = alias_dictionary(asked)
    read = read.join(names, ["quantity", "spelling"], "left")
    second = names.select("quantity", F.col("spelling").alias("second_unit"), F.col("known").alias("second_known"), F.col("factor").alias("second_factor"))
    read = read.join(second, ["quantity", "second_unit"], "left")
    bare = F.col("spelling").isNull() & F.col("recorded").isNotNull()
    as_share = bare & (F.col("quantity") == "share") & (F.col("common_known") == "%")
    unit = (
        F.when(F.col("recorded").isNull(), None)
        .when(as_share & (F.abs("recorded") <= 1), F.lit("fraction"))
        .when(bare, F.col("common_known"))
        .otherwise(F.col("known"))
    )
    factor = F.when(as_share & (F.abs("recorded") <= 1), F.lit(1.0)).when(bare, F.col("common_factor")).otherwise(F.col("factor"))
    mixed = F.col("second_known").isNotNull() & F.col("recorded").isNotNull()
    base = F.col("recorded") * factor + F.when(mixed, number(F.col("second")) * F.col("second_factor")).otherwise(0.0)
    return read.select(
        "result_id", "metric_name", "common_unit", "recorded", unit.alias("recorded_unit"), mixed.alias("is_mixed"),
        (base / F.col("common_factor")).alias("common_value"),
        F.coalesce((unit != F.col("common_known")) | mixed, F.lit(False)).alias("is_converted"),
    )


def found(results: DataFrame, metric_units: DataFrame) -> DataFrame:
    """(result_id): results recorded in another unit or scale than their metric's common unit."""
    return measured(results, metric_units).where("is_converted and result_id is not null").select("result_id").distinct()
