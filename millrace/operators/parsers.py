"""Python parsers over files: one call a file may fill many output tables; and extractors that give JSON about a file.

Files come as a table with path and content (Spark's binaryFile reader), so a parser never opens a path itself. A file is one
task's work at most; a parser that raises spoils its own file only.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.operators.deadline import OK, Caller
from millrace.operators.sinks import check_name
from millrace.operators.staging import staged

#: Rows that a task holds as Python objects before it packs them.
ROWS_AT_ONCE = 4096
PAUSE_AFTER = 3
#: Seconds that an extractor has for a file.
DEADLINE = 5.0
Parser = Callable[[str, bytes], Iterable[tuple[str, dict]]]


def run_parser(files: DataFrame, parse: Parser, outputs: dict[str, StructType]) -> dict[str, DataFrame]:
    """Each output's rows with `_source_path` and `_source_row` (from 0 within file and output), and `_errors` (path, error).

    parse(path, content) yields (output, row as a dict); keys that an output lacks are dropped and missing ones are null. Rows
    that a file gave before it raised are kept out: a file counts whole or not at all, so its rows are held until it is done,
    packed by Arrow but for the last few.
    An unknown output is an error of the file. A null content is an empty file. All outputs come of one run, which is staged.
    """
    for name in outputs:
        check_name(name)
    tagged = StructType().add("_path", "string").add("_output", "string").add("_row", "long").add("_error", "string")
    for name, schema in outputs.items():
        tagged.add(name, schema)
    arrow = to_arrow_schema(tagged)
    fields = {name: schema.fieldNames() for name, schema in outputs.items()}

    def one(path: str, content: bytes) -> list[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []
        rows: list[dict] = []
        counts = dict.fromkeys(fields, 0)
        misfit: list[Exception] = []

        def pack() -> None:
            try:
                if rows and not misfit:
                    done.append(pa.RecordBatch.from_pylist(rows, schema=arrow))
            except Exception as error:  # noqa: BLE001  values that do not fit their types are the file's error, unless the parser itself raises later
                misfit.append(error)
            rows.clear()

        try:
            for output, row in parse(path, content):
                if output not in fields:
                    raise ValueError(f"unknown output {output!r}")
                rows.append({"_path": path, "_output": output, "_row": counts[output], output: {k: row.get(k) for k in fields[output]}})
                counts[output] += 1
                if len(rows) >= ROWS_AT_ONCE:
                    pack()
            pack()
            if misfit:
                raise misfit[0]
            return done
        except Exception as error:  # noqa: BLE001  a parser is the user's code; its failure is a row
            failed = {"_path": path, "_output": "_errors", "_error": "".join(traceback.format_exception_only(error)).strip()}
            return [pa.RecordBatch.from_pylist([failed], schema=arrow)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from one(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"")

    done = staged(files.select("path", "content").mapInArrow(run, tagged), "parsed")
    found = {name: done.where(F.col("_output") == name).select(f"{name}.*", F.col("_path").alias("_source_path"), F.col("_row").alias("_source_row")) for name in outputs}
    return found | {"_errors": done.where("_output = '_errors'").select(F.col("_path").alias("path"), F.col("_error").alias("error"))}


def preview(outputs: dict[str, DataFrame], rows: int = 1000, redact: dict[str, Callable[[Column], Column]] | None = None) -> dict[str, DataFrame]:
    """The first rows of each output by source path and row, with the columns named in `redact` put through its functions; errors whole."""
    redact = redact or {}
    shown = {k: v if k == "_errors" else v.orderBy("_source_path", "_source_row").limit(rows) for k, v in outputs.items()}
    return {k: v.select(*[redact[c](F.col(c)).alias(c) if c in redact else F.col(c) for c in v.columns]) for k, v in shown.items()}


def output_schemas(outputs: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """(output, place, column, type) of each output's own columns."""
    return [(name, k, f.name, f.dataType.simpleString()) for name, df in sorted(outputs.items()) if name != "_errors" for k, f in enumerate(x for x in df.schema if not x.name.startswith("_source_"))]


def extract(files: DataFrame, extractor: Callable[[str, bytes], dict], seconds: float = DEADLINE) -> DataFrame:
    """path, status (ok, error, timeout or crash), metadata (JSON with sorted keys) and error for each file.

    The extractor runs in a child of the task's worker and has so many seconds for a file; one that hangs is ended, one that
    takes its process down is begun anew, and either costs its own file only. A null content is an empty file.
    """

    def described(path: str, content: bytes) -> str:
        return json.dumps(extractor(path, content), sort_keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = Caller(described, seconds)
        try:
            for batch in batches:
                rows = []
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    status, said = call(path, content or b"")
                    rows.append((path, status, said, None) if status == OK else (path, status, None, said))
                columns = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "status", "metadata", "error"])
        finally:
            call.close()

    return files.select("path", "content").mapInArrow(run, "path string, status string, metadata string, error string")


def paused(log: DataFrame, extractor: str = "extractor", order: str = "run") -> DataFrame:
    """Extractors whose last PAUSE_AFTER runs or more failed, from a log of extractor, run, status."""
    ok = F.col("status") == "ok"
    last = log.groupBy(extractor).agg(F.max(F.when(ok, F.col(order))).alias("last_ok")).select(F.col(extractor).alias("e"), "last_ok")
    tail = log.join(last, F.col(extractor) == F.col("e")).where(~ok & (F.col("last_ok").isNull() | (F.col(order) > F.col("last_ok"))))
    return tail.groupBy(extractor).agg(F.count("*").alias("n_failures")).where(F.col("n_failures") >= PAUSE_AFTER)
