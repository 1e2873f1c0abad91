"""Directory walks on executors: each round lists the folders that the round before has found.

A task goes down from its folders itself until it has met `budget` entries, and hands the folders it has not entered to the
next round, which deals them out anew; so a deep tree needs few rounds and a wide one many tasks. Files are staged round by
round; the driver holds neither files nor folders. Local and mounted paths are read with the operating system, other schemes
with Arrow's file systems, which know no links. All executors must see the same tree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.catalog import with_path_parts
from millrace.operators.staging import staged

#: Folders that are not entered unless asked for.
SKIPPED_FOLDERS = (".git", "node_modules", "__pycache__", ".cache")
#: Entries that a task meets before it hands folders over, and rows it gives at a time.
BUDGET, ROWS_AT_ONCE = 50_000, 8192
SCHEMA = "kind string, path string, size long, mtime long, depth int, uid string, above array<string>, error string"
_ARROW = pa.schema([("kind", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("depth", pa.int32()), ("uid", pa.string()), ("above", pa.list_(pa.string())), ("error", pa.string())])


@dataclass(frozen=True)
class WalkOptions:
    """hidden: enter and give names that begin with a dot. follow: follow links, else links are left out. max_depth: 1 is the
    root's own files. skip_folders: folder names not entered. skip_paths: texts that no path may contain."""

    hidden: bool = True
    follow: bool = False
    max_depth: int | None = None
    skip_folders: tuple[str, ...] = SKIPPED_FOLDERS
    skip_paths: tuple[str, ...] = field(default=())

    def wanted(self, name: str, path: str, folder: bool) -> bool:
        if not self.hidden and name.startswith("."):
            return False
        return not (folder and name in self.skip_folders) and not any(p in path for p in self.skip_paths)


def local_path(path: str) -> str | None:
    """The path on this machine's mounts, or None for another scheme."""
    parts = urlsplit(path)
    return path if not parts.scheme else parts.path if parts.scheme == "file" else None


def entries(folder: str, options: WalkOptions) -> Iterator[tuple[str, str, int, int, str]]:
    """(kind, path, size, mtime in ms, identity) of a folder's entries; kind is file, dir, or lost for one that went or that can't be read meanwhile."""
    at = local_path(folder)
    if at is None:
        fs, inner = pafs.FileSystem.from_uri(folder)
        base = folder.rstrip("/")
        for x in fs.get_file_info(pafs.FileSelector(inner)):
            is_dir = x.type == pafs.FileType.Directory
            if options.wanted(x.base_name, f"{base}/{x.base_name}", is_dir):
                yield "dir" if is_dir else "file", f"{base}/{x.base_name}", x.size or 0, (x.mtime_ns or 0) // 1_000_000, f"{base}/{x.base_name}"
        return
    with os.scandir(at) as found:
        for x in found:
            try:
                if x.is_symlink() and not options.follow:
                    continue
                is_dir = x.is_dir()
                path = f"{folder.rstrip('/')}/{x.name}"
                if options.wanted(x.name, path, is_dir):
                    s = x.stat()
                    yield "dir" if is_dir else "file", path, s.st_size, s.st_mtime_ns // 1_000_000, f"{s.st_dev}:{s.st_ino}"
            except OSError as error:
                yield "lost", f"{folder.rstrip('/')}/{x.name}", 0, 0, str(error)


def descend(start: list[tuple[str, int, list[str]]], options: WalkOptions, budget: int) -> Iterator[tuple]:
    """Rows of SCHEMA below some folders (path, depth, identities of the folders above and its own); kind dir: left for others. A folder that is among those above it is a loop and is not entered."""
    todo, met = list(reversed(start)), 0
    while todo:
        folder, depth, above = todo.pop()
        if met >= budget:
            yield "dir", folder, None, None, depth, None, above, None
            continue
        try:
            for kind, path, size, mtime, uid in entries(folder, options):
                met += 1
                if kind == "file":
                    yield "file", path, size, mtime, depth + 1, uid, None, None
                elif kind == "lost":
                    yield "error", path, None, None, depth + 1, None, None, uid
                elif uid in above:
                    yield "error", path, None, None, depth + 1, uid, None, "loop"
                elif options.max_depth is None or depth + 1 < options.max_depth:
                    todo.append((path, depth + 1, [*above, uid]))
        except OSError as error:
            yield "error", folder, None, None, depth, None, None, str(error)


def in_batches(rows: Iterator[tuple], schema: pa.Schema = _ARROW, most: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def walk(spark: SparkSession, root: str, options: WalkOptions = WalkOptions(), budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Files: path, rel_path, parent_path, name, extension, size, mtime (ms), depth, uid (device and inode). Errors: path, error ("loop" for a link back to a folder above).

    A root that is no folder gives one error. Files that go while the walk runs are left out or stand among the errors; a file
    reached by two links stands under either path, with one uid.
    """
    at = local_path(root)
    own = [f"{s.st_dev}:{s.st_ino}"] if at and os.path.isdir(at) and (s := os.stat(at)) else []
    frontier = spark.createDataFrame([(root, 0, own)], "path string, depth int, above array<string>")
    rounds, n = [], 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = [(r["path"], r["depth"], r["above"]) for b in batches for r in b.to_pylist()]
        yield from in_batches(descend(start, options, budget))

    most = max(spark.sparkContext.defaultParallelism * 4, 1)
    while n:
        found = staged(frontier.repartition(min(n, most)).mapInArrow(run, SCHEMA), "walk")
        rounds.append(found)
        frontier = found.where("kind = 'dir'").select("path", "depth", "above")
        n = frontier.count()
    every = reduce(DataFrame.unionAll, rounds)
    prefix = len(root.rstrip("/")) + 2
    files = every.where("kind = 'file'").withColumn("rel_path", F.substring("path", prefix, 1 << 20))
    files = with_path_parts(files).select("path", "rel_path", "parent_path", "name", "extension", "size", "mtime", "depth", "uid")
    return files, every.where("kind = 'error'").select("path", "error")


def write_files(df: DataFrame, root: str, rel_path: str = "rel_path", content: str = "content", mtime: str | None = None) -> DataFrame:
    """Writes each row's content (text or binary) as a file below root, each under a hidden name that is then renamed; gives rel_path and size.

    The write happens when the result is computed; a task tried again writes the same files. A null content is an empty file.
    mtime: a column of times (ms) that the files get.
    """
    base = local_path(root)
    if base is None:
        raise ValueError("files are written below a mounted folder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = r["content"] or b""
                data = data.encode() if isinstance(data, str) else bytes(data)
                at = os.path.join(base, r["rel_path"])
                os.makedirs(os.path.dirname(at), exist_ok=True)
                hidden = os.path.join(os.path.dirname(at), f".{os.path.basename(at)}.{os.getpid()}")
                with open(hidden, "wb") as f:
                    f.write(data)
                if r["mtime"] is not None:
                    os.utime(hidden, ns=(r["mtime"] * 1_000_000,) * 2)
                os.replace(hidden, at)
                out.append((r["rel_path"], len(data)))
            yield from in_batches(iter(out), pa.schema([("rel_path", pa.string()), ("size", pa.int64())]))

    time = F.col(mtime).cast("long") if mtime else F.lit(None).cast("long")
    return df.select(F.col(rel_path).alias("rel_path"), F.col(content).alias("content"), time.alias("mtime")).mapInArrow(run, "rel_path string, size long")


def move_files(df: DataFrame, root: str, rel_path: str = "rel_path", new_path: str = "new_path") -> DataFrame:
    """Moves files below root to other paths, or removes them where the new path is null; gives rel_path and whether the file was there. Done when the result is computed; a task tried again finds nothing left to do."""
    base = local_path(root)
    if base is None:
        raise ValueError("files are moved below a mounted folder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = os.path.join(base, r["rel_path"])
                try:
                    if r["new_path"] is None:
                        os.remove(at)
                    else:
                        os.makedirs(os.path.dirname(os.path.join(base, r["new_path"])), exist_ok=True)
                        os.replace(at, os.path.join(base, r["new_path"]))
                    out.append((r["rel_path"], True))
                except FileNotFoundError:
                    out.append((r["rel_path"], False))
            yield from in_batches(iter(out), pa.schema([("rel_path", pa.string()), ("done", pa.bool_())]))

    return df.select(F.col(rel_path).alias("rel_path"), F.col(new_path).alias("new_path")).mapInArrow(run, "rel_path string, done boolean")
