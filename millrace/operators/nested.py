"""Contracts on nested columns: how types fit at every path, and values rewritten to the contract's type with the paths of what is wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, FloatType, IntegralType, LongType, MapType, NullType, StringType, StructType

COMPATIBLE, NULL_ONLY, CAST, MISMATCH = "compatible", "null_only", "cast", "mismatch"
#: Kinds of type that are read from text by a format, and those that need none.
BY_FORMAT, FROM_TEXT = ("date", "timestamp", "timestamp_ntz", "time"), (DecimalType,)


def type_of(text: str) -> DataType:
    """A type from its text; fields of structs may be NOT NULL."""
    return StructType.fromDDL(f"x {text}")[0].dataType


def fit(have: DataType, want: DataType, formatted: bool = True) -> str:
    """How a type itself, without its parts, fits what is wanted; formatted: times may be read from text."""
    if isinstance(have, NullType):
        return COMPATIBLE if isinstance(want, NullType) else NULL_ONLY
    if isinstance(have, StringType) and (isinstance(want, FROM_TEXT) or formatted and want.simpleString() in BY_FORMAT):
        return CAST
    same_kind = any(isinstance(have, k) and isinstance(want, k) for k in (ArrayType, StructType, MapType))
    widens = isinstance(have, IntegralType) and isinstance(want, (LongType, DoubleType)) or isinstance(have, FloatType) and isinstance(want, DoubleType)
    return COMPATIBLE if same_kind or widens or have == want else MISMATCH


def compatibility(have: DataType, want: DataType, path: str = "", formatted: bool = True) -> list[tuple[str, str, str, str]]:
    """(path, type, wanted type, outcome) of a type and all of its parts; a path ends in [] for a list's items. A field that only one side has is a mismatch, with an empty type on the other."""
    own = fit(have, want, formatted)
    out = [(path, have.simpleString(), want.simpleString(), own)]
    if own != COMPATIBLE:
        return out
    if isinstance(have, ArrayType):
        return out + compatibility(have.elementType, want.elementType, f"{path}[]", formatted)
    if isinstance(have, MapType):
        return out + compatibility(have.keyType, want.keyType, f"{path}{{key}}", formatted) + compatibility(have.valueType, want.valueType, f"{path}{{}}", formatted)
    if isinstance(have, StructType):
        dot = f"{path}." if path else ""
        there = {f.name: f.dataType for f in have}
        for f in want:
            if f.name in there:
                out += compatibility(there[f.name], f.dataType, dot + f.name, formatted)
            else:
                out.append((dot + f.name, "", f.dataType.simpleString(), MISMATCH))
        out += [(dot + n, t.simpleString(), "", MISMATCH) for n, t in there.items() if n not in want.names]
    return out


def compatibility_frame(spark: SparkSession, have: StructType, want: StructType) -> DataFrame:
    """compatibility() of two tables' schemas as rows; as many as there are paths."""
    return spark.createDataFrame(compatibility(have, want)[1:], "path string, have string, want string, outcome string")


def _none() -> Column:
    return F.array().cast("array<string>")


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), where x is evaluated once however often `then` names it; a column by itself stands anew in each place that names it, so work would double with every level of lists."""
    return F.transform(F.array(x), then)[0]


def rewrite(v: Column, have: DataType, want: DataType, path: Column, leaf: Callable[[Column, DataType, DataType], Column], required: bool = False) -> Column:
    """struct<v, e>: a value in the wanted type, and messages (array<string>) that name the paths of bad parts, such as `items[3].price`.

    leaf(value, have, want) casts what is no list or struct, and gives null for what it can't. Lists keep their length, and a
    part that is wrong becomes null. A null list or struct has no parts; fields that are not nullable must not be null. Each part
    is rewritten once, however deep it lies.
    """
    missing = F.array(F.concat(F.lit("schema: null not allowed in '"), path, F.lit("'"))) if required else _none()
    both = lambda value, errors: F.struct(value.alias("v"), errors.alias("e"))
    if isinstance(have, StructType) and isinstance(want, StructType):
        types = {f.name: f.dataType for f in have}
        if not want.fields:
            return both(F.when(v.isNotNull(), F.struct()), F.when(v.isNull(), missing).otherwise(_none()))
        parts = [rewrite(v.getField(f.name), types[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), leaf, not f.nullable).alias(f"_{i}") for i, f in enumerate(want)]

        def joined(s: Column) -> Column:
            value = F.struct(*[s[f"_{i}"]["v"].alias(f.name) for i, f in enumerate(want)])
            return both(F.when(v.isNotNull(), value), F.when(v.isNull(), missing).otherwise(F.concat(*[s[f"_{i}"]["e"] for i in range(len(parts))])))

        return _once(F.struct(*parts), joined)
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):

        def item(e: Column, i: Column) -> Column:
            return rewrite(e, have.elementType, want.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), leaf)

        def listed(xs: Column) -> Column:
            return both(F.transform(xs, lambda x: x["v"]), F.when(v.isNull(), missing).otherwise(F.flatten(F.transform(xs, lambda x: x["e"]))))

        return _once(F.transform(v, item), listed)
    text = isinstance(have, StringType)
    bad = F.concat(F.lit(f"schema: value does not match format '{want.simpleString()}' for '"), path, F.lit("'"))

    def judged(value: Column) -> Column:
        wrong = v.isNotNull() & value.isNull() & ((v != "") if text else F.lit(True))
        return both(value, F.when(wrong, F.array(bad)).when(value.isNull(), missing).otherwise(_none()))

    return _once(leaf(v, have, want), judged)
