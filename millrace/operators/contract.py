"""Schema contracts: enforcement, valid and quarantined rows, policy, lineage, and differences between schemas."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from millrace.functions.text import strict_decimal, violation_type
from millrace.functions.values import offset_fits
from millrace.operators import nested

ERROR = "_cf_row_error"
LINEAGE = ("_cf_source_hash", "_cf_job_id", "_cf_processed_at", "_cf_parser_version")
#: Directives of strftime formats and the letters Spark has for them.
DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%y": "yy", "%z": "xx", "%.f": "[.SSSSSS]", "%j": "D", "%b": "MMM"}


@dataclass(frozen=True)
class ContractColumn:
    name: str
    type: str
    nullable: bool = True
    format: str | None = None
    zone: str | None = None


class SchemaMismatch(ValueError):
    pass


def java_format(fmt: str) -> str:
    for a, b in DIRECTIVES.items():
        fmt = fmt.replace(a, b)
    return fmt.replace("T", "'T'")


#: Kinds of source that a contract type takes as they are.
WIDENS = {"bigint": {"tinyint", "smallint", "int", "bigint"}, "double": {"tinyint", "smallint", "int", "bigint", "float", "double"}}


def check_shape(df: DataFrame, columns: list[ContractColumn]) -> None:
    """Raises unless df has the contract's columns, in number, name and order, with types it can take."""
    have = [c for c in df.columns if c not in (ERROR, "__cf_row_id")]
    want = [c.name for c in columns]
    if not want:
        raise SchemaMismatch("a contract has at least one column")
    if have != want:
        raise SchemaMismatch(f"missing {sorted(set(want) - set(have))}, extra {sorted(set(have) - set(want))}, expected order {want}")
    kinds = dict(df.dtypes)
    for c in columns:
        kind = kinds[c.name]
        if is_nested(c):
            wrong = [(path, a, b) for path, a, b, how in nested.compatibility(df.schema[c.name].dataType, nested.type_of(c.type), c.name) if how == nested.MISMATCH]
            if wrong:
                raise SchemaMismatch("; ".join(f"{path} is {a or 'missing'}, the contract says {b or 'nothing'}" for path, a, b in wrong))
            continue
        castable = kind == "string" and (c.type.startswith(("decimal", "date", "timestamp")) or c.type == "time")
        if kind not in ("void", c.type) and kind not in WIDENS.get(c.type, ()) and not castable:
            raise SchemaMismatch(f"column {c.name} is {kind}, the contract says {c.type}")


def is_nested(c: ContractColumn) -> bool:
    return c.type.startswith(("array", "struct", "map"))


def _leaf(v: Column, have: DataType, want: DataType) -> Column:
    """A part of a nested column in its type, by the formats that hold without a given one."""
    return _cast(ContractColumn("", want.simpleString()), have.simpleString(), v)


def _cast(c: ContractColumn, kind: str, raw: Column | None = None) -> Column:
    raw = F.col(c.name) if raw is None else raw
    if kind != "string" or c.type == "string":
        return raw.cast(c.type)
    filled = F.when(raw != "", raw)
    if c.type.startswith("decimal"):
        p, s = map(int, c.type[8:-1].split(","))
        return strict_decimal(filled, p, s)
    if c.type == "time":  # as text HH:MM:SS
        at = F.coalesce(*[F.try_to_timestamp(filled, F.lit(java_format(f))) for f in ((c.format,) if c.format else ("%H:%M:%S", "%H:%M"))])
        return F.date_format(at, "HH:mm:ss")
    if c.type == "timestamp" and c.zone:  # an instant whose offset must be the zone's
        return F.when(offset_fits(filled, c.zone), F.try_to_timestamp(F.replace(F.upper(filled), F.lit(" "), F.lit("T"))))
    fmt = java_format(c.format or ("%Y-%m-%d" if c.type == "date" else "%Y-%m-%dT%H:%M:%S"))
    return F.try_to_timestamp(filled, F.lit(fmt)).cast(c.type)


def _fits_format(c: ContractColumn) -> Column:
    """Whether a text column's value has the contract's temporal format; an empty one has any."""
    v = F.col(c.name)
    return (v == "") | F.try_to_timestamp(v, F.lit(java_format(c.format))).isNotNull()


def enforce(df: DataFrame, columns: list[ContractColumn]) -> DataFrame:
    """df in the contract's types with `_cf_row_error`: messages of bad values and forbidden nulls, or null. One projection, below it one in which each nested column is rewritten once."""
    check_shape(df, columns)
    kinds = dict(df.dtypes)
    rewritten = {c.name: f"__cf_rewritten_{i}" for i, c in enumerate(columns) if is_nested(c)}
    parts = [nested.rewrite(F.col(c.name), df.schema[c.name].dataType, nested.type_of(c.type), F.lit(c.name), _leaf, not c.nullable).alias(rewritten[c.name]) for c in columns if is_nested(c)]
    df = df.select(*df.columns, *parts) if parts else df
    messages: list[Column] = [F.when(F.col(ERROR) != "", F.col(ERROR))] if ERROR in df.columns else []
    cast = {c.name: _cast(c, kinds[c.name]) for c in columns if not is_nested(c)}
    for c in columns:
        if is_nested(c):
            cast[c.name], errors = F.col(rewritten[c.name])["v"], F.col(rewritten[c.name])["e"]
            messages.append(F.when(F.size(errors) > 0, F.array_join(errors, "; ")))
            continue
        raw, value = F.col(c.name), cast[c.name]
        if kinds[c.name] == "string" and c.type == "string" and c.format:
            messages.append(F.when(~_fits_format(c), f"schema: value does not match format '{c.format}' for '{c.name}'"))
        if kinds[c.name] == "string" and c.type != "string":
            messages.append(F.when((raw != "") & value.isNull(), f"schema: value does not match format '{c.format or c.type}' for '{c.name}'"))
        if not c.nullable:
            messages.append(F.when(value.isNull(), f"schema: null not allowed in '{c.name}'"))
    joined = F.concat_ws("; ", *messages) if messages else F.lit("")
    rest = [x for x in df.columns if x == "__cf_row_id"]
    return df.select(*[cast[c.name].alias(c.name) for c in columns], *rest, F.when(joined != "", joined).alias(ERROR))


def with_row_numbers(bad: DataFrame, position: str, row_id: str = "__cf_row_id") -> DataFrame:
    """Quarantined rows with `_source_row` from the parser's row id, or, if any of them has none or a negative one, with `_output_row_index` for all.

    The choice is made for the whole set: one row of an aggregate, broadcast.
    """
    if row_id not in bad.columns:
        return bad.withColumns({"_source_row": F.lit(None).cast("long"), "_output_row_index": F.col(position).cast("long")})
    usable = bad.agg(F.coalesce(F.bool_and(F.coalesce(F.col(row_id) >= 0, F.lit(False))), F.lit(True)).alias("_usable"))
    both = bad.crossJoin(F.broadcast(usable))
    own, index = F.when(F.col("_usable"), F.col(row_id)), F.when(~F.col("_usable"), F.col(position))
    return both.withColumns({"_source_row": own.cast("long"), "_output_row_index": index.cast("long")}).drop("_usable")


def mismatches(observed: DataFrame, declared: list[ContractColumn], by: str = "file") -> DataFrame:
    """by, kind (missing, extra, type), column, expected, actual: how the columns(by, name, type, position) of each file differ from a contract; order where only that differs."""
    spark = observed.sparkSession
    want = spark.createDataFrame([(c.name, c.type, i) for i, c in enumerate(declared)], "want_name string, want_type string, want_at int")  # a contract's columns: few
    files = observed.select(by).distinct().crossJoin(F.broadcast(want))
    have = observed.select(F.col(by).alias("_f"), F.col("name"), F.col("type"), F.col("position"))
    both = files.join(have, (F.col(by) == F.col("_f")) & (F.col("want_name") == F.col("name")), "full_outer")
    kind = (
        F.when(F.col("name").isNull(), "missing").when(F.col("want_name").isNull(), "extra").when(F.col("type") != F.col("want_type"), "type").when(F.col("position") != F.col("want_at"), "order")
    )
    rows = both.select(F.coalesce(by, "_f").alias(by), kind.alias("kind"), F.coalesce("want_name", "name").alias("column"), F.col("want_type").alias("expected"), F.col("type").alias("actual")).where("kind is not null")
    # A missing or extra column shifts the rest; order is reported only for files that have all columns and no other.
    other = rows.where("kind in ('missing', 'extra')").select(F.col(by).alias("_g")).distinct()
    return rows.join(other, F.col(by) == F.col("_g"), "left").where("kind <> 'order' or _g is null").drop("_g")


def scope_id(parser: Column | str, version: Column | str, output: Column | str) -> Column:
    """Digest of `parser:version:output`, by which contracts are kept."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (parser, version, output)]
    return F.sha2(F.concat_ws(":", *parts), 256)


def lock(columns: list[ContractColumn]) -> tuple[str, str]:
    """A contract as canonical JSON, and its SHA-256."""
    names = [c.name for c in columns]
    if not names:
        raise SchemaMismatch("a contract has at least one column")
    if len(set(names)) < len(names):
        raise SchemaMismatch(f"columns stand twice: {sorted({n for n in names if names.count(n) > 1})}")
    text = json.dumps([{"name": c.name, "type": c.type, "nullable": c.nullable, "format": c.format} for c in columns], separators=(",", ":"), sort_keys=True)
    return text, hashlib.sha256(text.encode()).hexdigest()


def approve(columns: list[ContractColumn], renames: dict[str, str] | None = None, nested: bool = False) -> list[ContractColumn]:
    """The columns under their new names. Raises for no column, names that then stand twice, and nested types unless they are opted in."""
    out = [replace(c, name=(renames or {}).get(c.name, c.name)) for c in columns]
    lock(out)
    deep = [c.name for c in out if c.type.startswith(("array", "struct", "map"))]
    if deep and not nested:
        raise SchemaMismatch(f"nested columns {deep} are not opted in")
    return out


def override(scope: str, contracts: dict[str, list[ContractColumn]], default: list[ContractColumn]) -> list[ContractColumn]:
    """The contract kept under a scope id, else the sink's own."""
    return contracts.get(scope, default)


def is_valid() -> Column:
    return F.col(ERROR).isNull() | (F.col(ERROR) == "")


def split(enforced: DataFrame, job_id: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows without the error column, and quarantined rows with what is wrong with them."""
    bad = enforced.where(~is_valid())
    bad = bad.withColumns({"_error_msg": F.col(ERROR), "_violation_type": violation_type(F.col(ERROR)), "_cf_job_id": F.lit(job_id)})
    return enforced.where(is_valid()).drop(ERROR), bad


@dataclass(frozen=True)
class QuarantinePolicy:
    allowed: bool = False
    max_percent: float = 10.0
    max_count: int | None = None


def policy_verdict(enforced: DataFrame, policy: QuarantinePolicy) -> DataFrame:
    """One row: rows, quarantined rows, and accepted or why not."""
    n = enforced.agg(F.count("*").alias("n_rows"), F.count_if(~is_valid()).alias("n_quarantined"))
    bad = F.col("n_quarantined")
    verdict = F.when(bad == 0, "accepted")
    if not policy.allowed:
        verdict = verdict.otherwise("quarantine disabled")
    else:
        if policy.max_count is not None:
            verdict = verdict.when(bad > policy.max_count, "too many rows")
        verdict = verdict.when(bad * 100 > policy.max_percent * F.col("n_rows"), "too large a share").otherwise("accepted")
    return n.withColumn("verdict", verdict)


def with_lineage(df: DataFrame, source_hash: Column, job_id: str, parser_version: str, processed_at: Column | None = None) -> DataFrame:
    taken = [c for c in LINEAGE if c in df.columns]
    if taken:
        raise ValueError(f"lineage columns exist already: {taken}")
    at = processed_at if processed_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.withColumns(dict(zip(LINEAGE, (source_hash, F.lit(job_id), at, F.lit(parser_version)))))


def schema_frame(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change: added, removed, type or nullability; before and after as of schema_frame()."""
    b = before.select(F.col("name").alias("old"), F.col("type").alias("old_type"), F.col("nullable").alias("old_null"))
    both = b.join(after, F.col("old") == F.col("name"), "full_outer")
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("name").isNull(), "removed")
        .when(F.col("old_type") != F.col("type"), "type").when(F.col("old_null") != F.col("nullable"), "nullability")
    )
    return both.select(F.coalesce("name", "old").alias("name"), change.alias("change")).where("change is not null")


def contract_changes(before: list[ContractColumn], after: list[ContractColumn]) -> list[tuple[str, str, str | None, str | None]]:
    """(column, change, old, new): added, removed, type, nullability, format; a column may have several."""
    old, new = {c.name: c for c in before}, {c.name: c for c in after}
    out: list[tuple[str, str, str | None, str | None]] = [(n, "removed", c.type, None) for n, c in old.items() if n not in new]
    for n, c in new.items():
        b = old.get(n)
        if b is None:
            out.append((n, "added", None, c.type))
            continue
        pairs = (("type", b.type, c.type), ("nullability", str(b.nullable).lower(), str(c.nullable).lower()), ("format", b.format, c.format))
        out += [(n, what, x, y) for what, x, y in pairs if x != y]
    return out


def any_null(df: DataFrame) -> DataFrame:
    """df with `_error_reason`: null_values for a row with a null in any column."""
    bad = F.lit(False)
    for c in df.columns:
        bad = bad | F.col(c).isNull()
    return df.withColumn("_error_reason", F.when(bad, "null_values"))
