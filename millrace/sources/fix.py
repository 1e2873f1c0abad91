"""FIX log lines taken apart into messages and fields, as expressions over a table of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_TYPES = ("D", "8", "F", "G", "9", "H")
SOH = "\u0001"


def messages(lines: DataFrame) -> DataFrame:
    """A row a message: all columns of lines, then message_index and message. Text before the first message is dropped; a line may hold many."""
    parts = F.filter(F.split("line", "(?=8=FIX)"), lambda p: F.startswith(p, F.lit("8=FIX")))
    return lines.select(*lines.columns, F.posexplode(parts).alias("message_index", "message"))


def delimiter(message: Column) -> Column:
    """SOH, pipe or ^A, the first that is there; space if the first three parts between spaces are fields."""
    head = F.slice(F.split(message, " "), 1, 3)
    spaced = F.contains(message, F.lit(" ")) & F.forall(head, lambda p: (p == "") | F.contains(p, F.lit("=")))
    return F.when(F.contains(message, F.lit(SOH)), SOH).when(F.contains(message, F.lit("|")), "|").when(F.contains(message, F.lit("^A")), "^A").when(spaced, " ").otherwise("|")


def fields(message: Column) -> Column:
    """Array of structs tag, value in message order; parts without `=` are passed over."""
    one = F.replace(message, delimiter(message), F.lit(SOH))
    parts = F.filter(F.split(one, SOH), lambda f: F.contains(f, F.lit("=")))
    return F.transform(parts, lambda f: F.struct(F.trim(F.substring_index(f, "=", 1)).alias("tag"), F.substring(f, F.instr(f, "=") + 1, F.length(f)).alias("value")))


def tags(lines: DataFrame) -> DataFrame:
    """A row a field: tag, value, position from 1."""
    m = messages(lines).withColumn("fields", fields(F.col("message")))
    return m.select(*[c for c in lines.columns if c != "line"], "message_index", F.posexplode("fields").alias("at", "f")).select(
        *[c for c in lines.columns if c != "line"], "message_index", F.col("f.tag").alias("tag"), F.col("f.value").alias("value"), (F.col("at") + 1).cast("long").alias("position")
    )
