"""Shredding a mixed table into shards by key: the most frequent keys get their own, the rest share one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.positions import with_group, with_positions
from millrace.operators.staging import staged
from millrace.sources.lines import csv_fields
from millrace.sources.walk import write_files

REST = "_MISC"


def shards(df: DataFrame, key: str, top: int = 5) -> DataFrame:
    """df with `shard`. Keys are counted in a partial aggregate; the top few (a bounded table) are joined back."""
    best = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull()).orderBy(F.desc("n"), key).limit(top).select(F.col(key).alias("k"))
    return df.join(F.broadcast(best), F.col(key) == F.col("k"), "left").withColumn("shard", F.coalesce("k", F.lit(REST))).drop("k")


def promoted_shards(df: DataFrame, key: str, top: int = 5, promotion: int = 1000) -> DataFrame:
    """df with `shard`: the top keys have their own, and so has any other key of `promotion` rows or more; the rest share one.

    The counts are a row a key and are joined back by key, not broadcast, as there may be many.
    """
    n = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNotNull())
    best = n.orderBy(F.desc("_n"), key).limit(top)
    own = best.unionByName(n.where(F.col("_n") >= promotion)).select(F.col(key).alias("_k")).distinct()
    return df.join(own, F.col(key) == F.col("_k"), "left").withColumn("shard", F.coalesce(F.col("_k").cast("string"), F.lit(REST))).drop("_k")


def shard_sizes(sharded: DataFrame, key: str, order: str) -> DataFrame:
    """shard, rows, bytes of the rows as JSON, first and last place in the source, and how many keys it has."""
    row = F.octet_length(F.to_json(F.struct(*[c for c in sharded.columns if c != "shard"])))
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(row).alias("n_bytes"), F.min(order).alias("first_row"), F.max(order).alias("last_row"), F.count_distinct(key).alias("n_keys"))


def shard_metadata(sharded: DataFrame, order: str) -> DataFrame:
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min(order).alias("first_row"), F.max(order).alias("last_row"))


def write_shards(sharded: DataFrame, path: str, mode: str = "append") -> None:
    sharded.write.partitionBy("shard").mode(mode).parquet(path)


# ---- raw lines


def csv_key(line: Column, index: int, delimiter: str = ",") -> Column:
    """A field of a CSV line by its place (from 0), quotes undone; null for a short line or an empty field."""
    return F.get(csv_fields(line, delimiter), index)


def json_key(line: Column, path: str) -> Column:
    """What a JSON line has under a dotted path, as text; null where it has nothing, null, or is no JSON."""
    steps = "".join(f"['{p}']" for p in path.split("."))
    return F.get_json_object(line, f"${steps}")


def regex_key(line: Column, pattern: str, group: str) -> Column:
    """A named group of the first match; null for a line without a match or with an empty group."""
    index = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groupindex[group]
    found = F.regexp_extract(line, pattern.replace("(?P<", "(?<"), index)
    return F.when(found != "", found)


STRATEGIES = {"csv": csv_key, "json": json_key, "regex": regex_key}


def shred_lines(lines: DataFrame, line: str, strategy: str, top: int = 5, promotion: int = 1000, has_header: bool = False, order: list[str] | None = None, **options: object) -> DataFrame:
    """lines with `key` and `shard`, by a strategy and its options: csv (index, delimiter), json (path), regex (pattern, group), or passthrough, one shard for all.

    With has_header the first line of the order is no row. Lines without a key, and keys too rare for a shard, are in the rest.
    """
    if strategy == "passthrough":
        return lines.withColumns({"key": F.lit(None).cast("string"), "shard": F.lit(REST)})
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}")
    keyed = lines.withColumn("key", STRATEGIES[strategy](F.col(line), **options))
    if has_header:
        first = lines.orderBy(*order).limit(1).select(*[F.col(c).alias(f"_first_{k}") for k, c in enumerate(order)])
        same = F.lit(True)
        for k, c in enumerate(order):
            same = same & F.col(c).eqNullSafe(F.col(f"_first_{k}"))
        keyed = keyed.join(F.broadcast(first), same, "left_anti")
    return promoted_shards(keyed, "key", top, promotion)


def write_line_files(sharded: DataFrame, root: str, line: str, order: list[str], most_bytes: int, header: str | None = None) -> DataFrame:
    """Writes each shard's lines, in order, as files `shard=<shard>/<number>.txt` of at most `most_bytes`, with the header on top of each; gives shard, number, n_lines and size.

    Running bytes (prefix sums over shard and order) tell the file, so a hot shard becomes many files that many tasks write,
    and a task holds one file. A line that is itself too large has a file of its own. Characters of a shard's name other than
    letters, digits, `.`, `_` and `-` are written as `%` and their code.
    """
    top = "" if header is None else header + "\n"
    room = most_bytes - len(top.encode())
    if room < 1:
        raise ValueError("the header leaves no room")
    bytes_of = (F.coalesce(F.octet_length(line), F.lit(0)) + 1).cast("long")
    # Lines of over half the room stand alone; the others' files end where their running bytes pass what the largest of them leaves.
    sized = sharded.withColumns({"_size": bytes_of, "_alone": 2 * bytes_of > room})
    largest = sized.where("not _alone").agg(F.coalesce(F.max("_size"), F.lit(1))).first()[0]
    rows = staged(with_positions(sized, ["shard", "_alone", *order], "_line_at", F.col("_size"), "_upto"), "lines")
    both = with_group(rows, ["shard", "_alone"], {"_from": F.min(F.col("_upto") - F.col("_size")), "_first": F.min("_line_at")})
    slot = F.when(F.col("_alone"), F.col("_line_at") - F.col("_first")).otherwise(F.floor((F.col("_upto") - F.col("_size") - F.col("_from")) / (room - largest + 1)))
    held = F.sort_array(F.collect_list(F.struct("_line_at", F.coalesce(F.col(line), F.lit("")).alias("line"))))
    files = both.groupBy("shard", "_alone", slot.alias("slot")).agg(held.alias("xs"))
    name = F.concat(F.when(F.col("_alone"), "long-").otherwise("part-"), F.lpad(F.col("slot").cast("string"), 6, "0"))
    safe = F.replace(F.url_encode("shard"), F.lit("*"), F.lit("%2A"))
    content = F.concat(F.lit(top), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n"))
    made = files.select("shard", name.alias("number"), F.size("xs").cast("long").alias("n_lines"), F.concat(F.lit("shard="), safe, F.lit("/"), name, F.lit(".txt")).alias("rel_path"), content.alias("content"))
    made = staged(made.withColumn("size", F.octet_length("content").cast("long")), "line-files")
    write_files(made, root).write.format("noop").mode("overwrite").save()
    return made.select("shard", "number", "n_lines", "size")
