"""Sinks: format by suffix, staged writes of many outputs, and names of output tables."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = {"append": "append", "replace": "overwrite", "error": "errorifexists"}


def format_of(uri: str) -> tuple[str, str]:
    """(format, path) of `parquet://dir`, `csv://dir`, `file://name.ext` or `table://name`."""
    scheme, _, path = uri.partition("://")
    path = path.split("?")[0]
    if scheme == "file":
        scheme = path.rpartition(".")[2]
    if scheme not in ("parquet", "csv", "json", "table"):
        raise ValueError(f"no sink for {uri}")
    return scheme, path


def write(df: DataFrame, uri: str, mode: str = "append") -> None:
    kind, path = format_of(uri)
    if kind == "table":
        df.write.mode(MODES[mode]).saveAsTable(path)
        return
    if mode != "append":
        raise ValueError("file sinks only append")
    df.write.mode("append").options(**({"header": True} if kind == "csv" else {"compression": "snappy"} if kind == "parquet" else {})).format(kind).save(path)


def write_all(outputs: dict[str, DataFrame], root: str, job_id: str, may_commit: Callable[[], bool] = lambda: True) -> dict[str, str]:
    """Writes every output once, under a hidden name beside its table; only when all are there are they renamed, in name order.

    may_commit is asked between the two. If it says no, or anything fails, what was written or renamed is taken back and the
    tables are as before. A job's folder that is there already is an error, before anything is written. Returns each table's path.
    """
    spark = next(iter(outputs.values())).sparkSession
    fs, path = file_system(spark, root)
    for name in sorted(outputs):
        check_name(name)
        if fs.exists(path(f"{root}/{name}/job={job_id}")):
            raise FileExistsError(f"{name} has rows of job {job_id} already")
    hidden = {name: f"{root}/{name}/_{job_id}-{uuid.uuid4().hex}" for name in sorted(outputs)}
    renamed: list[str] = []
    try:
        for name, at in hidden.items():
            outputs[name].write.option("compression", "snappy").parquet(at)
        if not may_commit():
            raise RuntimeError(f"job {job_id} may not commit")
        for name, at in hidden.items():
            final = f"{root}/{name}/job={job_id}"
            if not fs.rename(path(at), path(final)):
                raise OSError(f"{at} could not be renamed")
            renamed.append(final)
    except BaseException:
        for at in [*renamed, *hidden.values()]:
            fs.delete(path(at), True)
        raise
    return {name: f"{root}/{name}" for name in hidden}


def file_system(spark: SparkSession, root: str) -> tuple:
    """The folder's Hadoop file system, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(root).getFileSystem(spark._jsc.hadoopConfiguration()), make


def route(output: str, sinks: dict[str, str]) -> str:
    """The sink of an output: its own, else the default (`*`, then `output`), else the only one there is."""
    for name in (output, "*", "output"):
        if name in sinks:
            return sinks[name]
    if len(sinks) == 1:
        return next(iter(sinks.values()))
    raise KeyError(f"no sink for {output}")


def quarantine_sink(output: str, uri: str, quarantine: str | None = None) -> tuple[str, str]:
    """Name and uri under which an output's quarantined rows are written: with its own rows, or in a folder of their own (parquet and csv only)."""
    kind, _ = format_of(quarantine or uri)
    if quarantine and kind not in ("parquet", "csv"):
        raise ValueError("quarantined rows go to parquet or csv")
    return f"{output}_quarantine", quarantine or uri


def check_name(name: str) -> None:
    if not re.fullmatch("[a-z][a-z0-9_]*", name):
        raise ValueError(f"output name {name!r} is not of lower-case letters, digits and underscores")


def schema_table(base: str, schema: str) -> str:
    return f"{base}__schema_{hashlib.sha256(schema.encode()).hexdigest()[:8]}"


def register_views(spark: SparkSession, tables: dict[str, str], prefix: str = "outputs_") -> None:
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(f"{prefix}{name}")


def count_rows(outputs: dict[str, DataFrame]) -> DataFrame:
    """A row an output: its name and rows."""
    out = None
    for name, df in sorted(outputs.items()):
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("output"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
