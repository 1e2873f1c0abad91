"""Text and JSON sources as tables of rows that know where they came from."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.text import value_type


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size and mtime (ms) of all files below a path; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def read_table(spark: SparkSession, path: str, kind: str, separator: str = ",") -> DataFrame:
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else separator, mode="PERMISSIVE")
    if kind == "json":
        schema = whole_file_schema(spark, path)
        return (spark.read.schema(schema) if schema.names else spark.read).json(path, multiLine=True)
    if kind == "ndjson":
        return spark.read.json(path)
    return spark.read.format(kind).load(path)


def whole_file_schema(spark: SparkSession, path: str) -> StructType:
    """Schema of JSON files that hold a value each, inferred from all of them as texts.

    Spark's own inference of multi-line JSON hands each file the paths of all, and packs small files into one task; contents
    read as rows are dealt over tasks by size and number of files.
    """
    contents = spark.read.format("binaryFile").load(path).select("content").rdd
    return spark.read.json(contents.map(lambda r: bytes(r["content"]).decode(json.detect_encoding(r["content"]), "replace"))).schema


def read_flexible(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """CSV with a header, of lines of any width, all columns text: what a short line lacks is null, what a long one has beyond the header is the array `_rest` (null for others). The header is the first file's."""
    own = {"header": True, "sep": separator, "escape": '"'}
    names = spark.read.csv(path, **own).columns
    schema = StructType([StructField(n, StringType()) for n in names] + [StructField("_line", StringType())])
    df = spark.read.schema(schema).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_line", enforceSchema=True, **own)
    # A line of another width is kept as it stands.
    rest = csv_fields(F.col("_line"), separator)
    return df.select(*[F.col(f"`{n}`") for n in names], F.when(F.size(rest) > len(names), F.slice(rest, len(names) + 1, F.greatest(F.size(rest), F.lit(1)))).alias("_rest"))


def raw_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """line_number from 1 and raw for each line of a text; a final line feed makes no line."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    return df.select(*keep, F.posexplode(lines).alias("at", "raw")).select(*keep, (F.col("at") + 1).cast("long").alias("line_number"), "raw")


def detect_format(head: Column) -> Column:
    """Format of a file's first characters: parquet by its mark, JSON by its first bracket (lines of objects are ndjson), then commas or tabs with a line break, then text; control characters make it binary."""
    lines = F.filter(F.split(head, "\n"), lambda x: F.trim(x) != "")
    first = F.ltrim(head)
    objects = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^\{.*\}$"))) >= 2
    broken = F.contains(head, F.lit("\n"))
    return (
        F.when(F.startswith(head, F.lit("PAR1")), "parquet").when(head.rlike(r"[\x00-\x08\x0E-\x1F\uFFFD]"), "binary").when(objects, "ndjson").when(first.rlike(r"^[\[{]"), "json")
        .when(F.contains(head, F.lit(",")) & broken, "csv").when(F.contains(head, F.lit("\t")) & broken, "tsv").otherwise("text")
    )


def raw_head(content: Column, n: int) -> Column:
    """The first n bytes in hexadecimal, two digits a byte with spaces between."""
    return F.rtrim(F.regexp_replace(F.hex(F.substring(content, 1, n)), "(..)", "$1 "))


def json_pairs(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row for each key of a flat JSON object: key, value_raw, value_type, value_int64."""
    pairs = F.map_entries(F.from_json(text, "map<string,string>"))
    each = df.select(*keep, F.explode(pairs).alias("e")).select(*keep, F.col("e.key").alias("key"), F.col("e.value").alias("value_raw"))
    kind = value_type(F.col("value_raw"))
    return each.withColumn("value_type", F.when(F.col("value_raw").isNull(), "empty").otherwise(kind)).withColumn("value_int64", F.when(F.col("value_type") == "int", F.col("value_raw").try_cast("bigint")))


def csv_fields(line: Column, delimiter: str = ",") -> Column:
    """All fields of a line of CSV as an array: quotes around a field are taken off, doubled ones inside are one, an empty field is null."""
    d = "\\" + delimiter if len(delimiter) == 1 and not delimiter.isalnum() else delimiter
    raw = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f'{d}("(?:[^"]|"")*"|[^{d}]*)'), F.lit(1))
    bare = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda x: F.when(x.rlike('^".*"$'), bare(x)).when(x != "", x))


def record_types(lines: DataFrame, line: str, keep: list[str], width: int, rest: str | None = None) -> DataFrame:
    """keep, record_type and column_1..width, all strings, of headerless CSV lines whose second field names their type.

    A trailing colon of the type is dropped; a short line has nulls; what a long one has beyond `width` is an array in the
    column `rest`, if that is named; a line without a type is left out.
    """
    flat = lines.withColumn("_f", csv_fields(F.col(line)))
    kind = F.regexp_replace(F.trim(F.get("_f", 1)), ":$", "")
    more = [F.slice("_f", F.lit(width + 1), F.greatest(F.size("_f") - width, F.lit(0))).alias(rest)] if rest else []
    return flat.withColumn("record_type", kind).where("record_type <> ''").select(*keep, "record_type", *[F.get("_f", i).alias(f"column_{i + 1}") for i in range(width)], *more)


def tables_by_type(records: DataFrame, types: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """A table for each wanted type: {type: {new name: column}}. Each is a filter and a projection of the same scan."""
    return {t: records.where(F.col("record_type") == t).select(*[F.col(old).alias(new) for new, old in columns.items()]) for t, columns in types.items()}


def made_paths(df: DataFrame, key: str, fan_out: tuple[int, ...], largest: int) -> DataFrame:
    """rel_path and size of a made-up file for each whole number in `key`: a folder level for each fan-out. To measure catalogs by."""
    k = F.col(key)
    folders = [F.concat(F.lit("d"), (k % n).cast("string"), F.lit("/")) for n in fan_out]
    return df.select(F.concat(*folders, F.lit("file_"), k.cast("string"), F.lit(".dat")).alias("rel_path"), (k % largest).alias("size"))
