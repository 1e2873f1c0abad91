"""Type inference by elimination: each value rules types out, and what all values leave is the column's type.

Ruling out is a commutative AND, so it is one partial aggregate over any number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date formats in the order in which the first survivor is chosen, as (name, order of parts, separator, digits of the year).
DATE_FORMATS = (
    ("%Y-%m-%d", "ymd", "-", 4),
    ("%Y/%m/%d", "ymd", "/", 4),
    ("%d/%m/%Y", "dmy", "/", 4),
    ("%d-%m-%Y", "dmy", "-", 4),
    ("%d.%m.%Y", "dmy", ".", 4),
    ("%m/%d/%Y", "mdy", "/", 4),
    ("%m-%d-%Y", "mdy", "-", 4),
    ("%d/%m/%y", "dmy", "/", 2),
    ("%m/%d/%y", "mdy", "/", 2),
    ("%d-%m-%y", "dmy", "-", 2),
    ("%m-%d-%y", "mdy", "-", 2),
    ("%y/%m/%d", "ymd", "/", 2),
    ("%Y%m%d", "ymd", "", 4),
    ("%y%m%d", "ymd", "", 2),
)
TYPES = ("boolean", "integer", "float", "date", "datetime", "time", "duration", "string")


def is_null(v: Column) -> Column:
    return v.isNull() | (v == "") | (F.lower(v) == "null") | (v == "NA")


def in_calendar(y: Column, m: Column, d: Column) -> Column:
    year = F.when(y >= 100, y).when(y >= 70, y + 1900).otherwise(y + 2000)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(year.between(1900, 2100) & m.between(1, 12) & (d >= 1) & (d <= days), F.lit(False))


def with_dates(df: DataFrame, v: str = "v") -> DataFrame:
    """df with `days`, a number with a bit for each of DATE_FORMATS that the text in v fits as a day of the calendar.

    A text is taken apart once: three numbers between two equal separators, or the digits of one number.
    """
    t = F.col(v)
    apart = df.withColumns({"_s": F.regexp_extract(t, r"^[0-9]{1,4}([-/.])[0-9]{1,2}\1[0-9]{1,4}$", 1), "_c": F.when(t.rlike("^(?:[0-9]{6}|[0-9]{8})$"), t.try_cast("int")), "_n": F.length(t)})
    parts = F.when(F.col("_s") != "", F.split(t, "[-/.]"))
    apart = apart.withColumn("_p", parts)
    numbers = apart.withColumns({f"_{i}": F.get("_p", i).try_cast("int") for i in range(3)} | {f"_l{i}": F.length(F.get("_p", i)) for i in range(3)})
    bits = F.lit(0)
    for k, (_, order, separator, digits) in enumerate(DATE_FORMATS):
        if separator:
            of = {p: i for i, p in enumerate(order)}
            shape = (F.col("_s") == separator) & (F.col(f"_l{of['y']}") == digits) & (F.col(f"_l{of['m']}") <= 2) & (F.col(f"_l{of['d']}") <= 2)
            y, m, d = (F.col(f"_{of[p]}") for p in "ymd")
        else:
            shape, c = (F.col("_n") == digits + 4) & F.col("_c").isNotNull(), F.col("_c")
            y, m, d = F.floor(c / 10_000).cast("int"), F.floor(c / 100).cast("int") % 100, c % 100
        bits = bits + F.when(F.coalesce(shape, F.lit(False)) & in_calendar(y, m, d), 1 << k).otherwise(0)
    return numbers.withColumn("days", bits).select(*df.columns, "days")


def fits(v: Column, days: Column) -> dict[str, Column]:
    """Whether a value leaves a type possible; days: as of with_dates()."""
    numeric = v.rlike(r"^[+-]?[0-9eE,]*\.?[0-9eE,]*$") & v.rlike("[0-9]")
    low = F.lower(v)
    duration = low.rlike("^p.*[tymd]") | low.rlike("hour|min|sec|day|[hmsd]$") | (v.rlike("[0-9]") & low.rlike("[hms]"))
    return {
        "boolean": low.isin("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f"),
        "integer": numeric & ~F.contains(v, F.lit(".")),
        "float": numeric,
        "date": days != 0,
        "datetime": v.rlike("[ T]") & F.contains(v, F.lit(":")),
        "time": v.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d(:[0-5]?\d(\.\d+)?)?$"),
        "duration": duration,
        "string": F.lit(True),
    }


def hints(cannot_be: dict[str, tuple[str, ...]] | None, must_be: dict[str, str] | None) -> dict[str, set[str]]:
    """Types that a column can't have: those ruled out, and all but a demanded one (and string)."""
    hinted = {c: set(ts) for c, ts in (cannot_be or {}).items()}
    for c, t in (must_be or {}).items():
        hinted[c] = hinted.get(c, set()) | set(TYPES) - {t, "string"}
    if unknown := set().union(*hinted.values()) - set(TYPES):
        raise ValueError(f"unknown types {sorted(unknown)}")
    return hinted


def masks(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, null and mask of each value of each column. A mask is one number: a bit for each date format that the value leaves possible, then one for each type; what all values leave is the AND of their masks."""
    texts = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns])).alias("x")).select("x.*")
    v = F.col("v")
    bit = lambda test, i: F.when(test, 1 << i).otherwise(0)
    marked = with_dates(texts.withColumn("null", is_null(v)))
    types = reduce(lambda a, b: a + b, [bit(test, len(DATE_FORMATS) + i) for i, test in enumerate(fits(v, F.col("days")).values())])
    return marked.select("name", "null", F.when(~F.col("null"), F.coalesce(F.col("days") + types, F.lit(0))).alias("mask"))


def eliminated(values: DataFrame) -> DataFrame:
    """name, n_null, n_values and the mask that all values of masks() leave; of a table or a stream."""
    return values.groupBy("name").agg(F.count_if("null").alias("n_null"), F.count_if(~F.col("null")).alias("n_values"), F.bit_and("mask").alias("mask"))


def concluded(left_of: DataFrame, hinted: dict[str, set[str]]) -> DataFrame:
    """What the rows of eliminated() leave: possible types, the resolved one, and date formats."""
    n = len(DATE_FORMATS)
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    agg = left_of.select("name", "n_null", "n_values", *[has(n + i).alias(f"_{t}") for i, t in enumerate(TYPES)], *[has(i).alias(f"__{i}") for i in range(n)])
    allowed = {t: ~F.col("name").isin(*[c for c, ts in hinted.items() if t in ts]) if any(t in ts for ts in hinted.values()) else F.lit(True) for t in TYPES}
    left = F.array_compact(F.array(*[F.when(F.col(f"_{t}") & allowed[t], F.lit(t)) for t in TYPES]))
    survivors = F.array_compact(F.array(*[F.when(F.col(f"__{i}"), F.lit(f)) for i, (f, *_) in enumerate(DATE_FORMATS)]))
    typed = F.filter("possible", lambda t: t != "string")
    state = (
        F.when(F.col("n_values") == 0, "null").when(F.size(typed) == 0, "string").when(F.size(typed) == 1, typed[0])
        .when((F.size(typed) == 2) & F.array_contains(typed, "integer") & F.array_contains(typed, "float"), "integer").otherwise("ambiguous")
    )
    return agg.withColumn("possible", left).select("name", "n_null", "n_values", F.array_join("possible", ",").alias("possible"), state.alias("resolved"), F.array_join(survivors, ",").alias("date_formats"))


def infer(df: DataFrame, columns: list[str], cannot_be: dict[str, tuple[str, ...]] | None = None, must_be: dict[str, str] | None = None) -> DataFrame:
    """A row a column: possible types, resolved type, formats that survive, nulls, and distinct state. One pass over the table.

    Hints rule types out beforehand: cannot_be lists those of a column, must_be leaves one (and string).
    """
    return concluded(eliminated(masks(df, columns)), hints(cannot_be, must_be))


def intents(inferred: DataFrame) -> DataFrame:
    """name, declared_type, nullable, null_rate, candidates, method and the question to ask where several types are left, for rows of infer()."""
    typed = F.filter(F.split("possible", ","), lambda t: (t != "") & (t != "string"))
    open_ = F.col("resolved") == "ambiguous"
    candidates = F.when(open_, typed).when(F.col("resolved") == "null", F.array(F.lit("string"))).otherwise(F.array("resolved"))
    total = F.col("n_null") + F.col("n_values")
    out = inferred.withColumn("candidates", candidates)
    return out.select(
        "name", F.col("candidates")[0].alias("declared_type"), (F.col("n_null") > 0).alias("nullable"), F.round(F.when(total > 0, F.col("n_null") / total).otherwise(0.0), 6).alias("null_rate"),
        F.array_join("candidates", ",").alias("candidates"), F.when(open_ | (F.col("n_values") == 0), "ambiguous_requires_human").otherwise("constraint_elimination").alias("method"),
        F.when(open_, F.concat(F.lit("Column '"), "name", F.lit("' has ambiguous type. Which type should be used?"))).alias("question"),
    )
