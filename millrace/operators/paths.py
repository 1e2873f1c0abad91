"""Structure of paths: templates, key=value fields, positions, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions.text import path_template


def archetypes(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """Template of each path's folder: files, folders, depth and least example."""
    parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    t = df.select(path_template(parent).alias("template"), parent.alias("folder"))
    return t.groupBy("template").agg(F.count("*").alias("n_files"), F.count_distinct("folder").alias("n_folders"), F.min("folder").alias("example"))


def naming_schemes(df: DataFrame, name: str = "name") -> DataFrame:
    t = df.select(path_template(F.col(name)).alias("template"), F.col(name).alias("n"))
    return t.where(F.contains("template", F.lit("<"))).groupBy("template").agg(F.count("*").alias("n_files"), F.min("n").alias("example"))


def path_fields(df: DataFrame, text: str) -> DataFrame:
    """A row for each key=value in a text: `_cf_path_` and the key, and the value."""
    pairs = F.regexp_extract_all(text, F.lit(r"([a-zA-Z_]\w*=[^/\\&?#]+)"), F.lit(1))
    return df.withColumn("pair", F.explode(pairs)).select(*df.columns, F.concat(F.lit("_cf_path_"), F.substring_index("pair", "=", 1)).alias("field"), F.regexp_extract("pair", "^[^=]*=(.*)$", 1).alias("value"))


def field_coverage(fields: DataFrame, total: DataFrame) -> DataFrame:
    """Coverage, distinct values and type of each field over `total` (one row, n)."""
    v = F.col("value")
    kind = field_kind(v)
    per = fields.groupBy("field").agg(F.count("*").alias("n_found"), F.count_distinct("value").alias("n_values"), kind.alias("kind"), F.min("value").alias("example"))
    return per.crossJoin(F.broadcast(total)).select("field", "n_found", "n_values", "kind", "example", F.round(F.col("n_found") / F.col("n"), 6).alias("coverage"))


def positions(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """Each segment position: rows, distinct values, and whether all are numeric, years, or one value."""
    each = df.select(F.posexplode(F.split(path, "/")).alias("position", "segment"))
    s = F.col("segment")
    agg = each.groupBy("position").agg(
        F.count("*").alias("n_rows"), F.count_distinct("segment").alias("n_values"), F.bool_and(s.rlike("^[0-9]+$")).alias("numeric"), F.bool_and(s.rlike("^(19|20)[0-9]{2}$")).alias("years")
    )
    return agg.select(F.col("position").cast("long").alias("position"), "n_rows", "n_values", F.when(F.col("n_values") == 1, "fixed").when(F.col("years"), "year").when(F.col("numeric"), "numeric").otherwise("text").alias("kind"))


def concentration(df: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, entropy in nats, and 1 - entropy / ln(keys)."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("n_keys"))
    p = F.col("n") / F.col("total")
    out = counts.crossJoin(F.broadcast(total)).groupBy("n_keys").agg((-F.sum(p * F.ln(p))).alias("h"))
    return out.select("n_keys", F.round("h", 6).alias("entropy"), F.round(F.when(F.col("n_keys") > 1, 1 - F.col("h") / F.ln("n_keys")).otherwise(1.0), 6).alias("concentration"))


#: Types of a placeholder and what they match.
FIELD_TYPES = {"string": "[^/]+?", "str": "[^/]+?", "int": "[0-9]+", "integer": "[0-9]+", "date": r"\d{4}-?\d{2}-?\d{2}", "uuid": "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"}


def dated_fields(df: DataFrame, path: str) -> DataFrame:
    """A row for each named value of a path: key=value pairs, of which those that are folders are partitions, and days; with kind and value."""
    p = F.col(path)
    pair = lambda whole, kind: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("_cf_path_"), F.substring_index(whole, "=", 1)).alias("field"), F.regexp_replace(F.substring(whole, F.instr(whole, "=") + 1, 1 << 20), "/$", "").alias("value"))
    pairs = F.transform(F.regexp_extract_all(p, F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*=[^/\\]+/?)"), F.lit(1)), lambda w: F.when(F.endswith(w, F.lit("/")), pair(w, "partition")).otherwise(pair(w, "key_value")))
    days = F.transform(F.regexp_extract_all(p, F.lit(r"(\d{4}[-/]\d{2}[-/]\d{2})"), F.lit(1)), lambda d: F.struct(F.lit("regex").alias("kind"), F.lit("_cf_path_date").alias("field"), d.alias("value")))
    return df.select(*df.columns, F.inline(F.concat(pairs, days)))


def field_kind(v: Column) -> Column:
    """An aggregate: int, date, timestamp or string, as all values of a field are."""
    return (
        F.when(F.bool_and(v.rlike("^[+-]?[0-9]+$")), "int").when(F.bool_and(v.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$")), "date")
        .when(F.bool_and(v.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}")), "timestamp").otherwise("string")
    )


#: Forms of a date segment in the order of their tests.
DATE_SEGMENTS = (("date", r"^\d{4}-\d{2}-\d{2}$"), ("date", r"^\d{8}$"), ("year_month", r"^\d{4}-\d{2}$"))


def analyze_positions(df: DataFrame, path: str = "rel_path", share: float = 0.8) -> DataFrame:
    """position, kind, field, glob, n_rows of each segment position: fixed, filename, date, entity (one prefix before - or _ of more than `share` of the values), year, numeric or text."""
    each = df.select(F.posexplode(F.split(F.ltrim(F.col(path), F.lit("/")), "/")).alias("position", "s"))
    s = F.col("s")
    prefix = F.regexp_extract(s, "^([a-zA-Z]+)[-_]", 1)
    agg = each.groupBy("position").agg(
        F.count("*").alias("n_rows"), F.min("s").alias("lo"), F.max("s").alias("hi"), *[F.bool_and(s.rlike(r)).alias(f"d{i}") for i, (_, r) in enumerate(DATE_SEGMENTS)],
        F.bool_and(s.rlike(r"^(19\d{2}|20\d{2}|2100)$")).alias("years"), F.bool_and(s.rlike("^[0-9]+$")).alias("numeric"),
        F.min(F.substring_index(s, ".", -1)).alias("e1"), F.max(F.substring_index(s, ".", -1)).alias("e2"),
    )
    # The commonest prefix of a position: counted apart, so no list is held.
    prefixes = each.where(prefix != "").groupBy("position", prefix.alias("prefix")).agg(F.count("*").alias("n"))
    best = prefixes.groupBy(F.col("position").alias("p")).agg(F.max_by("prefix", F.struct("n", "prefix")).alias("prefix"), F.max("n").alias("n"))
    last = agg.agg(F.max("position").alias("deepest"))
    both = agg.join(best, F.col("position") == F.col("p"), "left").crossJoin(F.broadcast(last))  # a row a position; one row
    final, fixed = F.col("position") == F.col("deepest"), F.col("lo") == F.col("hi")
    dates = [(F.col(f"d{i}"), name) for i, (name, _) in enumerate(DATE_SEGMENTS)]
    dated = F.coalesce(*[F.when(test, F.lit(name)) for test, name in dates])
    entity = F.col("n") > share * F.col("n_rows")
    kind = F.when(fixed, F.when(final, "filename").otherwise("fixed")).when(dated.isNotNull(), "date").when(entity, "entity").when(F.col("years"), "year").when(F.col("numeric"), "numeric").when(final, "filename").otherwise("text")
    both = both.withColumn("kind", kind)
    k, at = F.col("kind"), F.col("position").cast("string")
    field = (
        F.when(k == "date", dated).when(k == "entity", F.lower("prefix")).when(k == "year", "year").when(k == "numeric", F.concat(F.lit("id_"), at))
        .when((k == "filename") & ~fixed, "filename").when(k == "text", F.concat(F.lit("field_"), at))
    )
    glob = F.when(k == "fixed", F.col("lo")).when((k == "filename") & (F.col("e1") == F.col("e2")) & F.contains("lo", F.lit(".")), F.concat(F.lit("*."), "e1")).otherwise("*")
    return both.select(F.col("position").cast("long").alias("position"), "kind", field.alias("field"), glob.alias("glob"), "n_rows")


def top_archetypes(df: DataFrame, top: int = 10, samples: int = 3, path: str = "rel_path") -> DataFrame:
    """The commonest templates of folders: files, folders, depth, and the `samples` least folders."""
    parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    folders = df.select(path_template(parent).alias("template"), parent.alias("folder")).groupBy("template", "folder").agg(F.count("*").alias("n"))
    first = W.partitionBy("template").orderBy("folder")
    few = folders.withColumn("at", F.row_number().over(first)).where(F.col("at") <= samples).groupBy("template").agg(F.array_join(F.array_sort(F.collect_list("folder")), "|").alias("samples"))
    best = folders.groupBy("template").agg(F.sum("n").alias("n_files"), F.count("*").alias("n_folders")).orderBy(F.desc("n_files"), "template").limit(top)
    depth = F.when(F.col("template") == "", 0).otherwise(F.size(F.split("template", "/")))
    return best.join(few, "template").select("template", "n_files", "n_folders", depth.cast("long").alias("depth"), "samples")


def placeholder_regex(pattern: str) -> tuple[str, list[str]]:
    """Regular expression with a group a field, and the fields' names, of a glob such as `mission_<id:int>/<day:date>/*.csv`.

    Raises for an unclosed, nested, empty, malformed or repeated field and for an unknown type; case matters in no literal.
    """
    import re

    names, out = [], ""
    for part in re.split(r"(<[^<>]*>)", pattern):
        if part.startswith("<") and part.endswith(">") and len(part) > 1:
            name, _, kind = part[1:-1].partition(":")
            if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
                raise ValueError(f"field name {name!r} in {pattern!r}")
            if name in names:
                raise ValueError(f"field {name} stands twice in {pattern!r}")
            if (kind or "string") not in FIELD_TYPES:
                raise ValueError(f"unknown type {kind!r} in {pattern!r}")
            names.append(name)
            out += f"({FIELD_TYPES[kind or 'string']})"
        elif "<" in part or ">" in part:
            raise ValueError(f"unclosed or nested field in {pattern!r}")
        else:
            out += "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|.", part, re.S))
    return f"(?i)^{out}$", names


def placeholder_fields(df: DataFrame, pattern: str, path: str = "rel_path") -> DataFrame:
    """Rows whose path fits a pattern with placeholders, each field as a column `_cf_path_<name>`."""
    regex, names = placeholder_regex(pattern)
    return df.where(F.col(path).rlike(regex)).withColumns({f"_cf_path_{n}": F.regexp_extract(path, regex, i + 1) for i, n in enumerate(names)})
