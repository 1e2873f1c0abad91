"""How sure a proposal is: weighted signals over selections, path fields and column types, and rules proposed for tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of each score's signals.
SELECTION = {"dir_concentration": 0.25, "extension_narrowness": 0.20, "semantic_tokens": 0.30, "tag_collision": 0.25}
PATH_FIELD = {"pattern_type": 0.30, "coverage": 0.35, "format_validation": 0.20, "value_uniqueness": 0.15}
SCHEMA_COLUMN = {"inference_method": 0.35, "candidate_clarity": 0.25, "null_stability": 0.20, "format_hits": 0.20}
PATTERNS = {"key_value": 1.0, "partition_dir": 0.9, "segment_position": 0.7, "regex": 0.5}
PREFIX_DEPTH, TOP_PREFIXES, EXAMPLES, ENOUGH_HITS = 3, 10, 5, 1000


def combined(weights: dict[str, float]) -> Column:
    """Weighted mean of the signals that are there."""
    total = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.round(F.when(total > 0, sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)) / total).otherwise(0.0), 6)


def selection_confidence(files: DataFrame, tokens: tuple[str, ...] = (), tagged: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """One row with SELECTION's signals and their score for chosen files (rel_path, parent_path, extension).

    Tokens count a path each; `tagged` are files that other tags have. An empty selection scores 0 on narrowness and lacks the
    signals that need files.
    """
    prefix = F.array_join(F.slice(F.split("parent_path", "/"), 1, PREFIX_DEPTH), "/")
    tops = files.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(TOP_PREFIXES)
    total = tops.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    spread = tops.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.ln(p))).alias("h"), F.count("*").alias("n_prefixes"))
    low = F.lower("rel_path")
    hits = sum((F.count_if(F.contains(low, F.lit(t.lower()))) for t in tokens), F.lit(0)) if tokens else F.lit(0)
    counts = files.agg(F.count("*").alias("n_files"), F.count_distinct("extension").alias("n_extensions"), hits.cast("long").alias("n_hits"))
    collisions = files.join(tagged.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_taken")) if tagged is not None else files.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_taken"))
    one = counts.crossJoin(spread).crossJoin(collisions)
    n = F.greatest("n_files", F.lit(1))
    k = F.col("n_extensions")
    signals = {
        "dir_concentration": F.when(F.col("n_prefixes") > 1, 1 - F.col("h") / F.ln("n_prefixes")).when(F.col("n_prefixes") == 1, 1.0),
        "extension_narrowness": F.when(k == 0, None).when(k == 1, 1.0).when(k <= 3, 0.8).when(k <= 5, 0.5).otherwise(0.2),
        "semantic_tokens": F.when(F.col("n_hits") > 0, F.least(F.col("n_hits") / n, F.lit(1.0))),
        "tag_collision": 1 - F.least(F.col("n_taken") / n, F.lit(1.0)),
    }
    return one.select("n_files", *[F.round(v, 6).alias(name) for name, v in signals.items()]).withColumn("score", combined(SELECTION))


def path_field_confidence(fields: DataFrame, total: DataFrame, pattern: str = "key_value") -> DataFrame:
    """field with PATH_FIELD's signals and score, for rows of field and value; `total` has one row, n (files). Examples are the EXAMPLES least distinct values."""
    v = F.col("value")
    is_int, is_date = v.rlike(r"^[+-]?\d{1,18}$"), v.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$|^\d{8}$")
    kinds = fields.groupBy("field", "value").agg(F.count("*").alias("n")).groupBy("field").agg(
        F.sum("n").alias("n_found"), F.bool_and(is_int).alias("ints"), F.bool_and(is_date).alias("dates"), F.count("*").alias("n_values"),
        F.count_if(is_int).alias("n_int"), F.count_if(is_date).alias("n_date"),
    )
    out = kinds.crossJoin(F.broadcast(total))
    shown = F.least("n_values", F.lit(EXAMPLES))
    signals = {
        "pattern_type": F.lit(PATTERNS[pattern]), "coverage": F.col("n_found") / F.greatest("n", F.lit(1)),
        "format_validation": F.when(F.col("ints"), F.col("n_int") / F.col("n_values")).when(F.col("dates"), F.col("n_date") / F.col("n_values")).otherwise(1.0),
        "value_uniqueness": F.when(shown > 1, 1.0).otherwise(0.5),
    }
    return out.select("field", *[F.round(x, 6).alias(name) for name, x in signals.items()]).withColumn("score", combined(PATH_FIELD))


def schema_column_confidence(inferred: DataFrame) -> DataFrame:
    """name with SCHEMA_COLUMN's signals and score, for rows of inference.infer()."""
    n = F.size(F.filter(F.split("possible", ","), lambda t: (t != "") & (t != "string")))
    candidates = F.greatest(n, F.lit(1))
    nulls, values = F.col("n_null"), F.col("n_values")
    signals = {
        "inference_method": F.when(F.col("resolved").isin("ambiguous", "null"), 0.3).otherwise(1.0), "candidate_clarity": F.when(candidates == 1, 1.0).when(candidates == 2, 0.6).otherwise(0.3),
        "null_stability": 1 - F.when(nulls + values > 0, nulls / (nulls + values)).otherwise(0.0), "format_hits": F.least(values / ENOUGH_HITS, F.lit(1.0)),
    }
    return inferred.select("name", *[F.round(x, 6).alias(k) for k, x in signals.items()]).withColumn("score", combined(SCHEMA_COLUMN))


def tag_proposals(files: DataFrame, extension_share: float = 0.8, folder_share: float = 0.5) -> DataFrame:
    """rule_id, pattern, extension, recall: extensions of over extension_share of the files, and the largest folder if it holds over folder_share of them (the least of equal ones)."""
    total = files.agg(F.count("*").alias("total"))
    e = files.where("extension <> ''").groupBy("extension").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > extension_share * F.col("total"))
    by_type = e.select(F.lit("ext_only").alias("rule_id"), F.lit(None).cast("string").alias("pattern"), F.concat(F.lit("."), "extension").alias("extension"), F.round(F.col("n") / F.col("total"), 6).alias("recall"))
    d = files.groupBy("parent_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent_path").limit(1).crossJoin(F.broadcast(total)).where(F.col("n") > folder_share * F.col("total"))
    kinds = by_type.agg(F.array_join(F.sort_array(F.collect_list("extension")), ",").alias("extension"))
    by_folder = d.crossJoin(kinds).select(F.lit("dir_pattern").alias("rule_id"), F.concat("parent_path", F.lit("/**")).alias("pattern"), F.nullif("extension", F.lit("")).alias("extension"), F.round(F.col("n") / F.col("total"), 6).alias("recall"))
    return by_type.unionByName(by_folder)
