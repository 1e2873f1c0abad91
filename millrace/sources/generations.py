"""A streaming source of file generations: (path, size, mtime), so that a rewritten file comes again.

The offset is a point of time, and a batch has the files last written after one offset up to the next. Executors walk the
folders when a batch is read; the driver lists no more than the first levels, to have parts. Files whose time lies before
the offset (moved in with their old time, or under a parser that is new to them) come again within `lateness`, or always if
it is not given; what has been seen is for the reader's ledger to tell (streaming.generation_stream).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.sources.walk import SKIPPED_FOLDERS, WalkOptions, descend, entries, in_batches, local_path

#: Folders to a batch from which on no further level is listed by the driver, and entries it lists at most.
PARTS, LISTED = 64, 20_000
_ROWS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])


class Folders(InputPartition):
    """Some folders, to be walked whole, and files found before."""

    def __init__(self, folders: list[str], files: list[tuple[str, int, int]], since: int, until: int) -> None:
        self.folders, self.files, self.since, self.until = folders, files, since, until


class GenerationReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        #: A file written in the last moments may still be written to.
        self.settle = int(options.get("settle_ms", 2000))
        self.lateness = int(options["lateness_ms"]) if "lateness_ms" in options else None
        skip = json.loads(options.get("skip_folders", json.dumps(SKIPPED_FOLDERS)))
        self.walk = WalkOptions(hidden=options.get("hidden", "false").lower() == "true", follow=options.get("follow", "false").lower() == "true", skip_folders=tuple(skip))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": int(time.time() * 1000) - self.settle}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since = -1 if self.lateness is None else start["until"] - self.lateness
        level, files, listed = [self.root], [], 0
        while level and len(level) < PARTS and listed < LISTED:
            below: list[str] = []
            for folder in level:
                if listed >= LISTED:
                    below.append(folder)
                    continue
                try:
                    for kind, path, size, mtime, _ in entries(folder, self.walk):
                        listed += 1
                        if kind == "dir":
                            below.append(path)
                        elif kind == "file":
                            files.append((path, size, mtime))
                except FileNotFoundError:
                    continue
            if below == level:
                break
            level = below
        n = max(1, min(PARTS, len(level) + bool(files)))
        return [Folders(level[k::n], files[k::n], since, end["until"]) for k in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            yield from partition.files
            start = []
            for folder in partition.folders:
                at = local_path(folder)
                s = os.stat(at) if at and os.path.isdir(at) else None
                start.append((folder, 0, [f"{s.st_dev}:{s.st_ino}"] if s else []))
            for kind, path, size, mtime, *_ in descend(start, self.walk, 1 << 62):
                if kind == "file":
                    yield path, size, mtime

        yield from in_batches((r for r in rows() if partition.since < r[2] <= partition.until), _ROWS)


class Generations(DataSource):
    """Options: path; settle_ms (2000); lateness_ms (none: all files each time); hidden, follow (false); skip_folders (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "file_generations"

    def schema(self) -> str:
        return "path string, size long, mtime long"

    def streamReader(self, schema: object) -> GenerationReader:  # noqa: N802
        return GenerationReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Generations)
