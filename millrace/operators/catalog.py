"""File catalog: paths, tags, snapshots, incremental skips and selections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import glob_regex

EXCLUDED_DIRS = r"(^|/)(\.git|node_modules|__pycache__|\.cache)(/|$)"


def with_path_parts(df: DataFrame, rel_path: str = "rel_path") -> DataFrame:
    """parent_path, name and lower-case extension of a relative path."""
    p = F.col(rel_path)
    name = F.regexp_extract(p, "([^/]*)$", 1)
    return df.withColumns({"parent_path": F.regexp_extract(p, "^(.*)/[^/]*$", 1), "name": name, "extension": F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))})


def without_excluded(df: DataFrame, rel_path: str = "rel_path", substrings: tuple[str, ...] = ()) -> DataFrame:
    """df without paths below an excluded folder, or with one of the substrings anywhere."""
    out = df.where(~F.col(rel_path).rlike(EXCLUDED_DIRS))
    for part in substrings:
        out = out.where(~F.contains(rel_path, F.lit(part)))
    return out


def scan_filter(df: DataFrame, include: tuple = (), exclude: tuple = (), min_size: int | None = None, max_size: int | None = None, max_depth: int | None = None, extensions: tuple = ()) -> DataFrame:
    path = F.col("rel_path")
    if include:
        df = df.where(any_glob(path, include))
    if exclude:
        df = df.where(~any_glob(path, exclude))
    if min_size is not None:
        df = df.where(F.col("size") >= min_size)
    if max_size is not None:
        df = df.where(F.col("size") <= max_size)
    if max_depth is not None:
        df = df.where(F.size(F.split("rel_path", "/")) <= max_depth)
    return df.where(F.col("extension").isin(*extensions)) if extensions else df


def any_glob(path: Column, globs: tuple) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


@dataclass(frozen=True)
class TagRule:
    name: str
    pattern: str
    tag: str
    priority: int = 0


def in_order(rules: list[TagRule]) -> list[TagRule]:
    return sorted(rules, key=lambda r: (-r.priority, r.name))


def first_rule(df: DataFrame, rules: list[TagRule]) -> DataFrame:
    """rule and tag of the first rule that fits, by priority, then name. Rules are a short list, so this is one projection, not a join."""
    cases = [(F.col("rel_path").rlike(glob_regex(r.pattern)), r) for r in in_order(rules)]
    pick = lambda what: F.coalesce(*[F.when(test, F.lit(getattr(r, what))) for test, r in cases])
    return df.withColumns({"rule": pick("name"), "tag": pick("tag")})


def all_rules(df: DataFrame, rules: list[TagRule]) -> DataFrame:
    """A row for each file and rule that fits."""
    fits = F.array_compact(F.array(*[F.when(F.col("rel_path").rlike(glob_regex(r.pattern)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.tag).alias("tag"))) for r in in_order(rules)]))
    return df.withColumn("x", F.explode(fits)).select(*df.columns, "x.rule", "x.tag")


def stats(df: DataFrame) -> DataFrame:
    done = F.col("status") == "processed"
    return df.agg(
        F.count("*").alias("n_files"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(done).alias("n_processed"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "pending", F.col("size"))), F.lit(0)).alias("pending_bytes"), F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("processed_bytes"),
    )


def by_extension(df: DataFrame) -> DataFrame:
    return df.groupBy(F.when(F.col("extension") == "", "(no ext)").otherwise(F.col("extension")).alias("extension")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def children(df: DataFrame, prefix: str = "", limit: int = 100) -> DataFrame:
    """Next path component below a prefix: files in it, and whether it is itself a file; the largest first."""
    rest = F.substring(F.col("rel_path"), len(prefix) + 1, 1 << 20)
    below = df.where(F.startswith("rel_path", F.lit(prefix))).select(F.substring_index(rest, "/", 1).alias("child"), (~F.contains(rest, F.lit("/"))).alias("is_file"))
    return below.groupBy("child").agg(F.count("*").alias("n_files"), F.bool_or("is_file").alias("is_file")).orderBy(F.desc("n_files"), "child").limit(limit)


def diff(before: DataFrame, now: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Keys with state new, changed, unchanged or deleted; all_keys outer join, null-safe comparison."""
    b = before.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in compare], F.lit(True).alias("in_before"))
    n = now.select(*keys, *compare, F.lit(True).alias("in_now"))
    on = None
    for k in keys:
        on = (F.col(k) == F.col(f"b_{k}")) if on is None else on & (F.col(k) == F.col(f"b_{k}"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    state = F.when(F.col("in_before").isNull(), "new").when(F.col("in_now").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return n.join(b, on, "full_outer").select(*[F.coalesce(k, f"b_{k}").alias(k) for k in keys], state.alias("state"))


def upsert(before: DataFrame, now: DataFrame, key: str, compare: list[str], cleared: tuple[str, ...] = (), complete: bool = True) -> DataFrame:
    """The merged catalog, in one outer join: changed and new files are pending, unchanged keep their status, absent ones stay and are deleted.

    The columns `cleared` (tags, errors, jobs) keep their values for unchanged and absent files and become null for others.
    After a scan that is not complete, absent files keep their status.
    """
    old = before.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in (*compare, *cleared)], F.col("status").alias("_status"))
    both = now.select(key, *compare).join(old, F.col(key) == F.col("_k"), "full_outer")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    state = F.when(F.col("_k").isNull(), "new").when(F.col(key).isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    both = both.withColumn("state", state)
    gone, fresh = F.col("state") == "deleted", F.col("state").isin("new", "changed")
    status = F.when(fresh, "pending").when(gone & F.lit(complete), "deleted").otherwise(F.col("_status"))
    return both.select(
        F.coalesce(key, "_k").alias(key), *[F.when(gone, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in compare], *[F.when(~fresh, F.col(f"_{c}")).alias(c) for c in cleared], status.alias("status"), "state"
    )


def renames(before: DataFrame, now: DataFrame, uid: str = "uid", path: str = "rel_path", same: tuple[str, ...] = ()) -> DataFrame:
    """Same identity under another path. A file system gives the identity of a removed file to a new one; the columns `same` (size and time, say) tell these apart."""
    keys = [uid, *same]
    return before.select(*keys, F.col(path).alias("old_path")).join(now.select(*keys, F.col(path).alias("new_path")), keys).where("old_path <> new_path").drop(*same)


def to_process(candidates: DataFrame, done: DataFrame, file: str = "file_id", key: str = "key") -> DataFrame:
    """Files of which any wanted key is not materialised; one without a key is always wanted."""
    have = done.select(F.col(key).alias("done_key")).distinct()
    return candidates.join(have, F.col(key) == F.col("done_key"), "left").groupBy(file).agg(F.bool_and(F.coalesce(F.col("done_key").isNotNull(), F.lit(False))).alias("all_done")).where("not all_done").select(file)


def select_files(df: DataFrame, extension: str | None, until_ms: int, since_ms: int | None) -> DataFrame:
    df = df.where((F.col("status") != "deleted") & (F.col("mtime") <= until_ms))
    df = df.where(F.col("extension") == extension) if extension is not None else df
    return df.where(F.col("mtime") >= until_ms - since_ms) if since_ms is not None else df


def seeded(c: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


def sample(df: DataFrame, n: int, by: str, seed: int = 42) -> DataFrame:
    """n rows in an order that a seed fixes, the same on any cluster."""
    return df.orderBy(seeded(F.col(by), seed), by).limit(n)


def stratified_sample(df: DataFrame, stratum: str, k: int, by: str, seed: int = 42) -> DataFrame:
    """k rows a stratum. Spark keeps only k rows of each stratum a partition before the shuffle (window group limit)."""
    w = W.partitionBy(stratum).orderBy(seeded(F.col(by), seed), F.col(by))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def near_misses(df: DataFrame, extension: str, token: str, glob: str) -> DataFrame:
    """df with `verdict`: selected if extension, token and glob all fit, near_miss if extension or token does, else other."""
    path = F.col("rel_path")
    ext, tok = F.col("extension") == extension, F.contains(F.lower(path), F.lit(token.lower()))
    return df.withColumn("verdict", F.when(ext & tok & path.rlike(glob_regex(glob)), "selected").when(ext | tok, "near_miss").otherwise("other"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest `order` of each key, as one aggregate without a sort; ties go to the greatest row."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")


def mark_stale(extractions: DataFrame, extracted: DataFrame, by: str, key: str = "file_id") -> DataFrame:
    """extractions with status stale for files that extractor `by` has seen; others keep theirs."""
    seen = extracted.where(F.col("extractor") == by).select(F.col(key).alias("seen_key")).distinct()
    out = extractions.join(seen, F.col(key) == F.col("seen_key"), "left")
    return out.withColumn("status", F.when(F.col("seen_key").isNotNull(), "stale").otherwise(F.col("status"))).drop("seen_key")


def job_log(jobs: DataFrame, quarantine: DataFrame, job: str = "job_id") -> DataFrame:
    """jobs with n_quarantined; rows are counted before the join, 0 where there are none."""
    n = quarantine.groupBy(job).agg(F.count("*").alias("n_quarantined"))
    return jobs.join(n, job, "left").withColumn("n_quarantined", F.coalesce("n_quarantined", F.lit(0).cast("long")))


def materializations(outputs: DataFrame) -> DataFrame:
    """A record for each output that did not fail: no_data without rows, partial_success with quarantined ones, else success."""
    status = F.when(F.col("n_rows") + F.col("n_quarantined") == 0, "no_data").when(F.col("n_quarantined") > 0, "partial_success").otherwise("success")
    return outputs.where(~F.col("failed")).withColumn("status", status).drop("failed")


def evidence(df: DataFrame, tokens: tuple[str, ...], top: int = 10) -> DataFrame:
    """what, which, n of a selection: its `top` folders of three steps, its extensions, and how many paths have each token."""
    folder = F.array_join(F.slice(F.split("rel_path", "/"), 1, 3), "/")
    dirs = df.groupBy(folder.alias("which")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "which").limit(top)
    extensions = df.groupBy(F.col("extension").alias("which")).agg(F.count("*").alias("n"))
    found = F.array(*[F.struct(F.lit(t).alias("which"), F.count_if(F.contains(F.lower("rel_path"), F.lit(t.lower()))).alias("n")) for t in tokens])
    said = df.agg(found.alias("x")).select(F.inline("x"))
    out = None
    for what, part in (("dir", dirs), ("ext", extensions), ("token", said)):
        one = part.select(F.lit(what).alias("what"), "which", "n")
        out = one if out is None else out.unionByName(one)
    return out
