"""Helpers that the operators share: column picking, staged tables, word splitting."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python strings at a time; bounds what a task holds besides the Arrow batch.
ROWS_AT_ONCE = 256

NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; a null text is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z only. bytes.split() parts at exactly those six characters."""
    return encoded(text).lower().split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z only."""
    return encoded(text).translate(_ALNUM).split()


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns _0, _1, ..., and which of them has a name; so names that clash, even by case, do no harm."""
    first = {c: f"_{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), first


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns new=old, chosen by exact name and position."""
    flat, first = numbered(df)
    return flat.select(*[F.col(first[old]).alias(new) for new, old in wanted.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a local session, whose executors are this machine, may do without."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._staged_at = at
    return back


def unstage(df: DataFrame) -> None:
    """Removes a staged table that nothing reads any more; what was made from it is staged itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_map(
    df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Maps whole texts in Arrow batches, without a shuffle.

    make() runs once a task and gives a function from a list of texts (or None) to a list of tuples, one a text.
    The result has the columns `keep`, then those of `schema`, one row for each input row, null ids included.
    """
    head = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keep]
    full = ", ".join([*head, schema])
    names = [x.split()[0] for x in _top_level(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        kinds = arrow_types(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = work(part.column(part.schema.get_field_index(text)).to_pylist())
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                made = [pa.array(c, type=t) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keep), *made], names=[*keep, *names])

    return df.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, full)


def arrow_types(schema: str) -> list[pa.DataType]:
    base = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}

    def of(kind: str) -> pa.DataType:
        if kind.startswith("array<"):
            return pa.list_(of(kind[6:-1]))
        if kind.startswith("struct<"):
            return pa.struct([(n, of(t)) for n, t in (x.split(":") for x in kind[7:-1].split(","))])
        return base[kind]

    return [of(x.strip().split(None, 1)[1].replace(" ", "")) for x in _top_level(schema)]


def _top_level(schema: str) -> list[str]:
    parts, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def crc_mod(value: object, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n
