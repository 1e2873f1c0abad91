"""Typing of samples: headers of delimited text, columns of text, values of JSON, columns of mixed types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.values import FLOAT, kind_of_sample


def is_header(cells: Column) -> Column:
    """Whether a first row's cells are names: none is empty, none a pure number."""
    return F.forall(cells, lambda c: (c != "") & ~(c.rlike(FLOAT) & ~c.rlike(r"\p{L}")))


def column_names(cells: Column) -> Column:
    """The cells if they are a header, else column_1, column_2, ..."""
    made = F.transform(cells, lambda c, i: F.concat(F.lit("column_"), (i + 1).cast("string")))
    return F.when(is_header(cells), cells).otherwise(made)


def infer_samples(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, data_type, format, nullable of text columns, each typed by what all of its values are; one pass."""
    v = F.col("v")
    kind, fmt = kind_of_sample(v)
    nullable = F.bool_or(v.isNull() | v.isin("", "null", "NULL", "NA"))
    texts = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    return texts.groupBy("name").agg(kind.alias("data_type"), fmt.alias("format"), nullable.alias("nullable"))


DATE = r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})$"
STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"


def json_types(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """name, candidates, method of keys of JSON objects: the types that none of the values present rules out. Nested values leave string alone."""
    whole = F.try_parse_json(text)
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.try_variant_get(whole, f"$.{k}", "variant").alias("v")) for k in keys])).alias("x")).select("x.*").where("v is not null and not is_variant_null(v)")
    kind = F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1)
    t = F.try_variant_get("v", "$", "string")
    number, boolean, string = kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), kind == "BOOLEAN", kind == "STRING"
    whole_number = number & (t.try_cast("double") == F.floor(t.try_cast("double")))
    texts = each.select(
        "name",
        (whole_number | string & t.rlike("^[+-]?[0-9]+$")).alias("i"), (number | string & t.rlike(FLOAT)).alias("f"), (boolean | string & F.lower(t).isin("true", "false", "1", "0")).alias("b"),
        (string & t.rlike(DATE)).alias("d"), (string & t.rlike(STAMP)).alias("s"),
    )
    agg = texts.groupBy("name").agg(*[F.bool_and(c).alias(c) for c in "ifbds"])
    found = F.array_compact(F.array(
        F.when(F.col("b"), "boolean"), F.when(F.col("i"), "int64"), F.when(F.col("f") & ~F.col("i"), "float64"), F.when(F.col("d"), "date"), F.when(F.col("s") & ~F.col("d"), "timestamp"),
    ))
    some = agg.withColumn("c", F.when(F.size(found) == 0, F.array(F.lit("string"))).otherwise(found))
    return some.select("name", F.array_join("c", ",").alias("candidates"), F.when(F.size("c") == 1, "constraint_elimination").otherwise("ambiguous_requires_human").alias("method"))


def one_type(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """name, type of keys of JSON objects as a parser's column would have them: the values' one type, numbers together, or string if they are mixed."""
    whole = F.try_parse_json(text)
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.try_variant_get(whole, f"$.{k}", "variant").alias("v")) for k in keys])).alias("x")).select("x.*").where("v is not null and not is_variant_null(v)")
    kind = F.regexp_extract(F.schema_of_variant("v"), "^([A-Z]+)", 1)
    group = F.when(kind.isin("DOUBLE", "DECIMAL", "FLOAT"), "double").when(kind == "BIGINT", "bigint").when(kind == "BOOLEAN", "boolean").otherwise("string")
    agg = each.select("name", group.alias("k")).groupBy("name").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    return agg.select("name", F.when(F.col("a") == F.col("b"), F.col("a")).when((F.col("a") == "bigint") & (F.col("b") == "double"), "double").otherwise("string").alias("type"))
