"""Files processed once a generation: once for each (path, time, size, parser, target)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import generations
from millrace.sources.walk import local_path

#: What makes a generation one of its own.
LEDGER = ["path", "mtime", "size", "parser", "target"]
#: Lines that a task passes on at a time.
LINES_AT_ONCE = 4096


def read_lines(files: DataFrame) -> DataFrame:
    """path, mtime, line_number (from 1) and line of each file; files are opened by the tasks, line by line.

    A file that is no longer the generation named gives no line: its next generation is in a later batch.
    """
    schema = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("line_number", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = local_path(r["path"])
                try:
                    with open(at, "rb") as f:
                        s = os.fstat(f.fileno())
                        if (s.st_mtime_ns // 1_000_000, s.st_size) != (r["mtime"], r["size"]):
                            continue
                        first, held = 1, []
                        for line in f:
                            held.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                            if len(held) == LINES_AT_ONCE:
                                yield made(r, first, held)
                                first, held = first + len(held), []
                        if held:
                            yield made(r, first, held)
                except FileNotFoundError:
                    continue

    def made(r: dict, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array([r["mtime"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], schema=schema)

    return files.select("path", "mtime", "size").mapInArrow(run, "path string, mtime long, line_number long, line string")


def process_generations(spark: SparkSession, root: str, parse: Callable[[DataFrame], DataFrame], out: str, parser: str, target: str, options: dict | None = None) -> DataFrame:
    """Processes the generations that are there and were not processed yet by this parser for this target; gives all rows so far.

    parse gets read_lines() of a batch's files. The ledger is the state of a streaming deduplication, split by key over the
    cluster and kept with the checkpoint below `out`; it remembers every generation, a key for each. A batch that is tried
    again overwrites its own folder, and the ledger moves on only when the batch is done: no generation is lost or doubled.
    """
    generations.register(spark)
    files = spark.readStream.format(generations.Generations.name()).options(**{"path": root, **(options or {})}).load()
    fresh = files.withColumns({"parser": F.lit(parser), "target": F.lit(target)}).dropDuplicates(LEDGER)

    def write(batch: DataFrame, number: int) -> None:
        # Files of a folder lie together; they are dealt out anew for reading.
        parts = spark.sparkContext.defaultParallelism * 2
        parse(read_lines(batch.repartition(parts, "path"))).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = fresh.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("batch")


def current(rows: DataFrame, path: str = "path", generation: str = "mtime") -> DataFrame:
    """Rows of each file's last generation; generations are counted once a file, so a large file is no skewed key."""
    last = rows.select(path, generation).distinct().groupBy(path).agg(F.max(generation).alias(generation))
    return rows.join(last, [path, generation], "left_semi")
