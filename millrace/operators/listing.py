"""Listings of the file catalog: filters, folders, pages, counts, tags and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import glob_regex
from millrace.operators.catalog import seeded
from millrace.operators.positions import page  # noqa: F401  pages of listings, by prefix sums


def list_files(df: DataFrame, tags: DataFrame | None = None, status: str | None = None, source: str | None = None, tag: str | None = None, untagged: bool = False, extension: str | None = None) -> DataFrame:
    """Files that fit every filter given; tags(file_id, tag) is needed for tag and untagged only."""
    for column, value in (("status", status), ("source", source), ("extension", extension)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if tag is not None:
        df = df.join(tags.where(F.col("tag") == tag).select("file_id"), "file_id", "left_semi")
    return df.join(tags.select("file_id"), "file_id", "left_anti") if untagged else df


def folder_contents(df: DataFrame, folder: str, limit: int = 100) -> DataFrame:
    """Files that lie in a folder itself, by name."""
    return df.where(F.col("parent_path") == folder).orderBy("name", "file_id").limit(limit)


def children_matching(df: DataFrame, prefix: str = "", glob: str = "", limit: int = 100) -> DataFrame:
    """The next path component below a prefix, of files that fit a glob: files, and whether it is itself a file; the most first."""
    rest = F.substring(F.col("rel_path"), len(prefix) + 1, 1 << 20)
    below = df.where(F.startswith("rel_path", F.lit(prefix)) & F.col("rel_path").rlike(glob_regex(glob)))
    below = below.select(F.substring_index(rest, "/", 1).alias("child"), (~F.contains(rest, F.lit("/"))).alias("is_file"))
    return below.groupBy("child").agg(F.count("*").alias("n_files"), F.bool_or("is_file").alias("is_file")).orderBy(F.desc("n_files"), "child").limit(limit)


def like_of(glob: str) -> str:
    """A glob as a LIKE pattern: folders of any depth vanish, `*` and `?` become `%` and `_`, and an underscore is escaped."""
    return escaped(glob.replace("**/", "")).replace("*", "%").replace("?", "_")


def escaped(text: str) -> str:
    """A text with the signs that mean something to LIKE made literal."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def glob_parts(glob: str) -> tuple[str | None, str | None]:
    """Extension and LIKE pattern of whole paths that a glob asks for; either may be None. Only a glob with folders has a pattern, and one that fits all paths is none."""
    tail = glob.rpartition("*.")[2] if "*." in glob else ""
    extension = tail.lower() if tail and not set("/*") & set(tail) else None
    if "/" not in glob and "**" not in glob:
        return extension, None
    body = glob[: -len(tail) - 2] + "*" if extension is not None else glob
    like = escaped(body).replace("**/", "%").replace("**", "%").replace("*", "%").replace("?", "_")
    while "%%" in like:
        like = like.replace("%%", "%")
    return extension, like if like.strip("%") else None


def matching_parts(df: DataFrame, glob: str) -> DataFrame:
    """Files that fit a glob by their extension column, which an index can serve, and by LIKE on the path."""
    extension, like = glob_parts(glob)
    df = df.where(F.col("extension") == extension) if extension is not None else df
    return df.where(F.col("rel_path").like(like)) if like is not None else df


def counts(df: DataFrame, prefixes: tuple[str, ...] = (), globs: tuple[str, ...] = (), folders: tuple[str, ...] = ()) -> DataFrame:
    """what, which, n_files: of each prefix, glob and folder, in one pass over the catalog."""
    tests = [("prefix", p, F.startswith("rel_path", F.lit(p))) for p in prefixes]
    tests += [("pattern", g, F.col("name").like(like_of(g))) for g in globs]
    tests += [("folder", f, F.col("parent_path") == f) for f in folders]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("what"), F.lit(b).alias("which"), F.count_if(t).alias("n_files")) for a, b, t in tests]).alias("all"))
    return one.select(F.inline("all"))


def tag_counts(df: DataFrame, tags: DataFrame, source: str = "source") -> DataFrame:
    """source, tag, n_files, the most first; files without a tag stand as null."""
    return df.join(tags.select("file_id", "tag"), "file_id", "left").groupBy(source, "tag").agg(F.count_distinct("file_id").alias("n_files"))


def source_stats(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def pending_extraction(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Files without metadata yet, the oldest first."""
    return df.where("status = 'pending'").orderBy("mtime", "file_id").limit(limit)


def prefix_sample(df: DataFrame, prefixes: int = 50, each: int = 5, by: str = "rel_path", seed: int = 42) -> DataFrame:
    """`each` files of each of the `prefixes` top folders with the most files, by a seeded hash; the folder list is a bounded broadcast."""
    top = F.substring_index("rel_path", "/", 1)
    most = df.groupBy(top.alias("prefix")).count().orderBy(F.desc("count"), "prefix").limit(prefixes).select("prefix")
    some = df.withColumn("prefix", top).join(F.broadcast(most), "prefix")
    w = W.partitionBy("prefix").orderBy(seeded(F.col(by), seed), F.col(by))
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).drop("rank")


def snapshots_with(members: DataFrame, snapshots: DataFrame, file_id: object, key: str = "snapshot_id") -> DataFrame:
    """Selections that contain a file, the newest first."""
    return snapshots.join(members.where(F.col("file_id") == file_id).select(key).distinct(), key, "left_semi").orderBy(F.desc("created_at"), key)


def overlapping_sources(paths: DataFrame, path: str = "path") -> DataFrame:
    """(parent, child) for sources one of which lies below the other: each path meets its own ancestors by equality."""
    p = paths.select(F.rtrim(F.col(path), F.lit("/")).alias("child")).distinct()
    steps = F.split("child", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    up = p.where(F.size(steps) > 1).select("child", F.explode(ancestors).alias("parent"))
    return up.join(p.select(F.col("child").alias("parent")), "parent", "left_semi").select("parent", "child")


def row_digest(*columns: str) -> Column:
    return F.xxhash64(*columns)


def set_digest(df: DataFrame, key: str) -> Column:
    """An aggregate: a digest of a set of keys that doesn't depend on order and needs no list. The keys' SHA-256, four bytes at a time, are summed."""
    h = F.sha2(F.col(key).cast("string"), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(",", F.count(F.col(key)).cast("string"), *parts), 256)


def collisions(derived: DataFrame, parsed: DataFrame, name: str = "name") -> DataFrame:
    """Names of derived fields that parsed columns have too, in any case."""
    return derived.select(F.lower(name).alias("name")).distinct().join(parsed.select(F.lower(name).alias("name")).distinct(), "name", "left_semi")
