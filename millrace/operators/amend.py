"""Contracts that change: what observed rows say should be amended, and changes applied to rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import inference
from millrace.operators.contract import ContractColumn, _cast

SAMPLES = 3


def proposals(raw: DataFrame, columns: list[ContractColumn]) -> DataFrame:
    """column, reason (type_mismatch, nullability_change, new_column), proposed type, n_rows and the least SAMPLES values, from rows as read.

    Bad values of a column propose string; forbidden nulls propose a nullable column; columns that the contract lacks are
    proposed as they are typed. One pass over the rows: every column is an aggregate.
    """
    kinds = dict(raw.dtypes)
    rows: list[tuple[str, str, str, Column, Column]] = []
    for c in columns:
        if c.name not in kinds:
            continue
        value, cast = F.col(c.name), _cast(c, kinds[c.name])
        missing = value.isNull() | (value == "") if kinds[c.name] == "string" else value.isNull()
        if kinds[c.name] == "string" and c.type != "string":
            rows.append((c.name, "type_mismatch", "string", ~missing & cast.isNull(), value))
        if not c.nullable:
            rows.append((c.name, "nullability_change", c.type, missing, F.lit(None).cast("string")))
    known = {c.name for c in columns}
    rows += [(name, "new_column", kind, F.col(name).isNotNull(), F.lit(None).cast("string")) for name, kind in raw.dtypes if name not in known]
    if not rows:
        return raw.sparkSession.createDataFrame([], "column string, reason string, proposed_type string, n_rows long, samples array<string>")
    each = F.array(*[F.when(test, F.struct(F.lit(name).alias("column"), F.lit(reason).alias("reason"), F.lit(kind).alias("proposed_type"), value.cast("string").alias("v"))) for name, reason, kind, test, value in rows])
    found = raw.select(F.explode(F.array_compact(each)).alias("x")).select("x.*").groupBy("column", "reason", "proposed_type", "v").agg(F.count("*").alias("n"))
    # Only the least few values a partition meet: a bounded heap an aggregate, not a list of all.
    firsts = found.groupBy("column", "reason", "proposed_type").agg(F.sum("n").alias("n_rows"))
    w = F.row_number().over(_least("column", "reason"))
    few = found.where("v is not null").withColumn("rn", w).where(F.col("rn") <= SAMPLES).groupBy("column", "reason").agg(F.sort_array(F.collect_list("v")).alias("samples"))
    return firsts.join(few, ["column", "reason"], "left")


def _least(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy("v")


@dataclass(frozen=True)
class Change:
    """kind: add, remove, retype, rename or reorder. `to` is a type, a new name or, for reorder, names joined by commas; `default` fills an added column or nulls of a kept one."""

    kind: str
    column: str = ""
    to: str = ""
    default: object = None


def apply_changes(df: DataFrame, changes: list[Change]) -> DataFrame:
    """df after the changes in turn; a value that a new type can't take becomes null, a name that is not there raises."""
    for c in changes:
        if c.kind == "add":
            if c.column in df.columns:
                raise ValueError(f"column {c.column} exists")
            df = df.withColumn(c.column, F.lit(c.default).cast(c.to))
            continue
        names = c.to.split(",") if c.kind == "reorder" else [c.column]
        if unknown := [n for n in names if n not in df.columns]:
            raise ValueError(f"no columns {unknown}")
        if c.kind == "remove":
            df = df.drop(c.column)
        elif c.kind == "retype":
            df = df.withColumn(c.column, F.col(c.column).try_cast(c.to))
        elif c.kind == "rename":
            if c.to in df.columns:
                raise ValueError(f"column {c.to} exists")
            df = df.withColumnRenamed(c.column, c.to)
        elif c.kind == "reorder":
            df = df.select(*names, *[n for n in df.columns if n not in names])
        elif c.kind == "default":
            df = df.withColumn(c.column, F.coalesce(F.col(c.column), F.lit(c.default)))
        else:
            raise ValueError(f"unknown change {c.kind}")
    return df


def without_files(df: DataFrame, excluded: DataFrame, file: str = "file_id") -> DataFrame:
    """Rows of files that an approval does not exclude."""
    return df.join(excluded.select(F.col(file).alias("_file")).distinct(), F.col(file) == F.col("_file"), "left_anti")


def elimination_evidence(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """name, type, value: for each column and type that its values rule out, the value of least `order` that does. One aggregate."""
    texts = df.select(F.col(order).alias("_o"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("_o", "x.*")
    texts = inference.with_dates(texts.withColumn("t", F.trim("v")).where(~inference.is_null(F.col("t"))), "t")
    tests = inference.fits(F.col("t"), F.col("days"))
    out = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(t)) for t, test in tests.items()]))
    return texts.select("name", "_o", "v", F.explode(out).alias("type")).groupBy("name", "type").agg(F.min_by("v", F.struct("_o", "v")).alias("value"))


def samples_of(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """name and samples: the `most` least distinct texts of each column, least first; empty text is no sample. One aggregate for each, that looks for the least text beyond the one before."""
    texts = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*").where("v <> ''")
    found = texts.groupBy("name").agg(F.array(F.min("v")).alias("samples"))
    for _ in range(most - 1):
        last = F.element_at("samples", -1)
        beyond = texts.join(F.broadcast(found), "name").where(F.col("v") > last).groupBy("name").agg(F.min("v").alias("next"))  # found has a row a column
        found = found.join(F.broadcast(beyond), "name", "left").select("name", F.array_compact(F.array_append("samples", F.col("next"))).alias("samples"))
    return found


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, has_null, type (string over boolean over float over integer), and its least value, of text columns. Empty text is a null."""
    texts = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    v = F.col("v")
    empty, low = v.isNull() | (v == ""), F.lower(F.col("v"))
    boolean, whole = low.isin("true", "false"), v.rlike(r"^[+-]?\d{1,18}$")
    number = v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    a = texts.groupBy("name").agg(
        F.bool_or(empty).alias("has_null"), F.bool_or(~empty & ~boolean & ~number).alias("s"), F.bool_or(~empty & boolean).alias("b"), F.bool_or(~empty & number & ~whole).alias("f"),
        F.bool_or(~empty & whole).alias("i"), F.min(F.when(~empty, v)).alias("example"),
    )
    mixed = F.col("b") & (F.col("f") | F.col("i"))
    return a.select("name", "has_null", F.when(F.col("s") | mixed, "string").when(F.col("b"), "boolean").when(F.col("f"), "float").when(F.col("i"), "integer").otherwise("null").alias("type"), "example")
