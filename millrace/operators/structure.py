"""What paths mean: kinds of segments, structure counted from the file, seeds of patterns, and patterns with named fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import first_of, once, path_template, token_kind

#: Folder names that tell a category.
CATEGORIES = (
    "reports", "logs", "data", "output", "input", "raw", "processed", "archive", "backup", "temp", "cache",
    "config", "docs", "src", "bin", "lib", "test", "tests", "spec", "specs", "export", "import",
)
#: Kinds of segments in the order of their tests, with the pattern and the confidence.
KINDS = (
    ("files", r"\.\w+$", 1.0),
    ("dated", r"^\d{4}-\d{2}-\d{2}$", 0.95),
    ("dated", r"^\d{8}$", 0.85),
    ("dated", r"^\d{4}-\d{2}$", 0.90),
    ("dated", r"^(?:1[3-9]|[2-9]\d)-\d{2}-\d{4}$", 0.85),
    ("dated", r"^\d{2}-\d{2}-\d{4}$", 0.70),
    ("year", r"^(?:FY)?(?:19|20)\d{2}$", 0.90),
    ("month", r"^(?:0[1-9]|1[0-2]|January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)$", 0.85),
    ("day", r"^(?:0[1-9]|[12]\d|3[01]|Day\d{1,2})$", 0.80),
    ("version", r"^v?\d+(?:\.\d+)*$|^release-\d+(?:\.\d+)*$", 0.90),
    ("category", "(?i)^(?:" + "|".join(CATEGORIES) + ")$", 0.95),
    ("entity", r"^[a-zA-Z]+[_-]\w+$", 0.80),
)
DEFAULT_CONFIDENCE = 0.0


def segment_kind(s: Column) -> Column:
    return first_of(*[(s.rlike(regex), kind) for kind, regex, _ in KINDS], default="unknown")


def segment_confidence(s: Column) -> Column:
    return first_of(*[(s.rlike(regex), confidence) for _, regex, confidence in KINDS], default=DEFAULT_CONFIDENCE)


def from_leaf(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """A row a position counted from the file (0): rows, kind and consistency.

    Only positions that all paths have count. Segments of one kind have their mean confidence and up to a tenth more for many
    examples, at most 1; a mixed position has 0.3 and kind unknown.
    """
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    each = df.select(F.posexplode(F.reverse(steps)).alias("position", "s"))
    kinds = each.select("position", segment_kind(F.col("s")).alias("kind"), segment_confidence(F.col("s")).alias("confidence"))
    per = kinds.groupBy("position").agg(F.count("*").alias("n_rows"), F.min("kind").alias("kind"), F.max("kind").alias("other"), F.avg("confidence").alias("mean"))
    all_rows = per.agg(F.max("n_rows").alias("all_rows"))
    same = F.col("kind") == F.col("other")
    score = F.least(F.col("mean") + F.least(F.col("n_rows") / 10.0, F.lit(0.1)), F.lit(1.0))
    out = per.crossJoin(F.broadcast(all_rows)).where("n_rows = all_rows")  # one row
    return out.select(F.col("position").cast("long").alias("position"), "n_rows", F.when(same, F.col("kind")).otherwise("unknown").alias("kind"), F.round(F.when(same, score).otherwise(0.3), 6).alias("consistency"))


def pattern_seeds(df: DataFrame, top: int = 10, path: str = "rel_path") -> DataFrame:
    """A glob for each of the commonest extensions, with the files it has."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    seeds = df.select(extension.alias("e")).where("e <> ''").groupBy("e").agg(F.count("*").alias("n_files"))
    return seeds.orderBy(F.desc("n_files"), "e").limit(top).select(F.concat(F.lit("**/*"), "e").alias("pattern"), "n_files")


#: Names and types of the fields that stand for kinds of tokens.
FIELD_OF = {"<date>": ("date", ":date"), "<datetime>": ("datetime", ""), "<uuid>": ("uuid", ":uuid"), "<n>": ("number", ":int"), "<hex>": ("hex", ""), "<code>": ("code", "")}
WHOLE = r"\d{8}[_-]\d{6}(?=/|$)|\d{4}-\d{2}-\d{2}(?=/|$)|\d{4}-\d{2}(?=/|$)|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?=/|$)"


def pattern_of(path: Column) -> Column:
    """A path as a pattern with named fields: what varies becomes `<name:type>`, numbered from the second of a name; the rest stays as it is."""
    parts = F.regexp_extract_all(path, F.lit(rf"((?<![^/])(?:{WHOLE})|[/_.-]|[^/_.-]+)"), F.lit(1))
    each = F.transform(parts, lambda p: F.struct(p.alias("part"), F.when(p.isin(*"/_.-"), p).otherwise(token_kind(p)).alias("kind")))
    names = F.create_map(*[F.lit(x) for k, (name, _) in FIELD_OF.items() for x in (k, name)])
    types = F.create_map(*[F.lit(x) for k, (_, t) in FIELD_OF.items() for x in (k, t)])

    def joined(own: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(own, F.lit(1), i + 1), lambda y: y["kind"] == x["kind"]))
            field = F.concat(F.lit("<"), F.element_at(names, x["kind"]), F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), F.element_at(types, x["kind"]), F.lit(">"))
            return F.when(x["kind"].isin(*FIELD_OF), field).otherwise(x["part"])

        return F.array_join(F.transform(own, part), "")

    return once(each, joined)


def rule_candidates(df: DataFrame, top: int = 10, path: str = "rel_path") -> DataFrame:
    """The commonest templates of whole paths: files, the least path as example, and the pattern made from it."""
    t = df.select(path_template(F.col(path)).alias("template"), F.col(path).alias("p")).groupBy("template").agg(F.count("*").alias("n_files"), F.min("p").alias("example"))
    return t.orderBy(F.desc("n_files"), "template").limit(top).select("template", "n_files", "example", pattern_of(F.col("example")).alias("pattern"))
