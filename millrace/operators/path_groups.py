"""Which path templates and tokens mean the same: variant groups and synonyms.

Candidates are found by equi joins on keys that every pair to be found must share, never by comparing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import path_template, token_kind
from millrace.operators.staging import staged

#: Scores are whole hundredths, so the threshold is met exactly.
LEAST_SCORE = 70
HARD_MISMATCH = 60
MAX_ROUNDS = 60
#: Abbreviations and what they stand for.
LEXICON = {
    "msn": "mission", "flt": "flight", "cfg": "config", "img": "image", "idx": "index", "ops": "operations", "rpt": "report", "tmp": "temp", "usr": "user", "sys": "system", "msg": "message",
    "doc": "document", "env": "environment", "srv": "server", "app": "application",
}


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, "[_.-]"), lambda t: t != "")


def literal(t: Column) -> Column:
    return ~F.startswith(t, F.lit("<"))


def _found(text: Column, letter: Column, start: Column) -> Column:
    """Place of a letter at or beyond a start, from 1; 0 without."""
    rest = F.instr(F.substring(text, start, F.length(text)), letter)
    return F.when(rest > 0, rest + start - 1).otherwise(0)


def fuzzy(a: Column, b: Column) -> Column:
    """Whether two literals may be spellings of one: same first letter, and a short one whose letters stand in the other in order, or both of up to six letters and few edits apart."""
    swap = F.length(a) <= F.length(b)
    short, long = F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)
    brief = F.length(short) <= 3
    # Up to three letters, the first of which is equal anyway: each further one is sought beyond the one before.
    second = F.when(F.length(short) < 2, 1).otherwise(_found(long, F.substring(short, 2, 1), F.lit(2)))
    third = F.when(F.length(short) < 3, second).otherwise(_found(long, F.substring(short, 3, 1), second + 1))
    inside = (second > 0) & (third > 0)
    few = (F.length(long) <= 6) & (F.levenshtein(a, b) <= F.when(brief, 3).otherwise(2))
    return (a != "") & (b != "") & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & ((brief & inside) | few)


def signatures(paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """A row a folder template: n_files, its least path, and what variants are compared by."""
    p = F.col(path)
    parent, name = F.regexp_extract(p, "^(.*)/[^/]*$", 1), F.regexp_extract(p, "([^/]*)$", 1)
    t = paths.select(path_template(parent).alias("template"), p.alias("sample")).groupBy("template").agg(F.count("*").alias("n_files"), F.min("sample").alias("sample"))
    name = F.regexp_extract("sample", "([^/]*)$", 1)
    stem, extension = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    segments = F.filter(F.split("template", "/"), lambda s: s != "")
    t = t.withColumns({"segments": segments, "name_template": F.array_join(F.transform(tokens(stem), token_kind), "_"), "extension": extension})
    t = t.withColumn("parts", F.flatten(F.transform("segments", tokens)))
    return t.select(
        "template", "n_files", "sample", "name_template", "extension", F.size("segments").alias("depth"), F.transform("parts", literal).alias("mask"), F.filter("parts", literal).alias("literals"),
        F.size(F.filter("segments", lambda s: F.exists(tokens(s), literal))).alias("n_literal"),
    ).withColumn("initials", F.array_join(F.transform(F.slice("literals", 1, F.greatest("n_literal", F.lit(1))), lambda x: F.substring(x, 1, 1)), ""))


#: Literals of up to so many letters may differ by edits; of up to SHORT letters a literal may stand for a longer one.
EDITED, SHORT = 6, 3
BLOCK = ("depth", "name_template", "n_literal", "initials")


def shortened(word: Column) -> Column:
    """A word with up to two letters left out, in all ways. Words two edits apart have one of these in common."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    once = without(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, without))))


def literal_keys(x: Column, probe: bool) -> Column:
    """Keys by which literals at one place meet if they may be spellings of one (see fuzzy): those that a literal lies under, or, to probe, those that its partners lie under.

    Longer literals meet their equals; those of four to EDITED letters any that share a shortened form; up to SHORT letters stand
    for any literal of the same first letter, so all lie under that too, and short ones apart from the others.
    """
    size, first = F.length(x), F.substring(x, 1, 1)
    own = F.when(size > EDITED, F.array(F.concat(F.lit("w:"), x))).otherwise(F.transform(shortened(x), lambda d: F.concat(F.lit("d:"), d)))
    short, every = F.array(F.concat(F.lit("s:"), first)), F.array(F.concat(F.lit("f:"), first))
    if probe:
        return F.when(size <= SHORT, every).otherwise(F.concat(own, short))
    return F.when(size <= SHORT, F.concat(short, every)).otherwise(F.concat(own, every))


def candidate_pairs(signatures: DataFrame) -> DataFrame:
    """(a, b), a < b: templates that agree in BLOCK and may have spellings of one literal at every place.

    As literals must fit at all places, one place finds all partners: each template probes that at which the fewest others
    lie under its keys. Templates without a literal are few, as only their kinds tell them apart, and meet by BLOCK alone.
    """
    place = F.transform(F.slice("literals", 1, F.greatest("n_literal", F.lit(1))), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    spot = signatures.where("n_literal > 0").select(*BLOCK, "template", F.explode(place).alias("p")).select(*BLOCK, "template", "p.i", "p.x")
    under = staged(spot.select(*BLOCK, "template", "i", F.explode(literal_keys(F.col("x"), False)).alias("key")), "keys")
    sizes = under.groupBy(*BLOCK, "i", "key").agg(F.count("*").alias("n"))
    probes = spot.select(*BLOCK, "template", "i", F.explode(literal_keys(F.col("x"), True)).alias("key"))
    met = staged(probes.join(sizes, [*BLOCK, "i", "key"]), "probes")
    cost = met.groupBy("template", "i").agg(F.sum("n").alias("cost")).groupBy("template").agg(F.min(F.struct("cost", "i")).alias("best"))
    chosen = met.join(cost.select(F.col("template").alias("_t"), F.col("best.i").alias("_i")), (F.col("template") == F.col("_t")) & (F.col("i") == F.col("_i"))).drop("n", "_t", "_i")
    found = chosen.withColumnRenamed("template", "a").join(under.withColumnRenamed("template", "b"), [*BLOCK, "i", "key"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    bare = signatures.where("n_literal = 0").select(*BLOCK, "template")
    rest = bare.withColumnRenamed("template", "a").join(bare.withColumnRenamed("template", "b"), list(BLOCK)).where("a < b").select("a", "b")
    return found.union(rest).distinct()


def variant_pairs(signatures: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """(a, b, score) of templates that may be variants of one layout. signatures are read several times, so they are staged before.

    A pair below HARD_MISMATCH is never a variant, so literals at the same place share their first letter; every segment with
    a literal has at least one, hence as many first letters as there are such segments are part of what pairs agree in.
    """
    a = signatures.select(*[F.col(c).alias(f"a_{c}") for c in signatures.columns])
    b = signatures.select(*[F.col(c).alias(f"b_{c}") for c in signatures.columns])
    n = F.least(F.size("a_literals"), F.size("b_literals"))
    both = F.arrays_zip(F.slice("a_literals", 1, n).alias("x"), F.slice("b_literals", 1, n).alias("y"))
    pairs = candidate_pairs(signatures).join(a, F.col("a") == F.col("a_template")).join(b, F.col("b") == F.col("b_template"))
    pairs = pairs.withColumn("differ", F.filter(F.when(n > 0, both).otherwise(F.array().cast("array<struct<x:string,y:string>>")), lambda z: z["x"] != z["y"]))
    hard = F.exists("differ", lambda z: ~fuzzy(z["x"], z["y"]))
    ratio = F.greatest("a_n_files", "b_n_files") / F.least("a_n_files", "b_n_files")
    shared, union = F.size(F.array_intersect("a_literals", "b_literals")), F.size(F.array_union("a_literals", "b_literals"))
    j = F.when(union == 0, 1.0).otherwise(shared / union)
    score = (
        F.lit(120) - F.when(F.col("a_extension") != F.col("b_extension"), 20).otherwise(0) + F.when(F.col("a_mask") == F.col("b_mask"), 20).otherwise(-20)
        - F.when(hard, 60).when(F.size("differ") > 0, 10).otherwise(0) + F.when(ratio <= 2, 10).otherwise(0) + F.when(j >= 0.6, 20).when(j >= 0.4, 10).when(j < 0.2, -20).otherwise(0)
    )
    pairs = pairs.withColumn("score", F.when(hard, F.least(score, F.lit(HARD_MISMATCH))).otherwise(score))
    return pairs.where(F.col("score") >= least).select("a", "b", "score")


def least_reachable(edges: DataFrame) -> DataFrame:
    """node, root (the least node it reaches over edges a, b). Labels fall to the least of the neighbours' and then to their label's label, so rounds grow with the logarithm of a chain."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("n")).select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        lower = staged(lower, "labels")
        jump = lower.select(F.col("node").alias("n"), F.col("root").alias("far"))
        after = staged(lower.join(jump, F.col("root") == F.col("n"), "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "before"), "labels")
        labels = after.select("node", "root")
        if after.where("root <> before").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"groups not settled after {MAX_ROUNDS} rounds")


def variant_groups(paths: DataFrame, path: str = "rel_path", least: int = LEAST_SCORE) -> DataFrame:
    """group (its least template), template, n_files, sample, extension for templates with a variant. Every counted pair scores at least `least`, so a member's mean does too and none is dropped again."""
    own = staged(signatures(paths, path), "signatures")
    roots = least_reachable(variant_pairs(own, least))
    return own.join(roots, F.col("template") == F.col("node")).select(F.col("root").alias("group"), "template", "n_files", "sample", "extension")


def depth_tokens(paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """depth (from 0), token (lower case, literal, two letters or more), n."""
    s = paths.select(F.posexplode(F.split(path, "/")).alias("depth", "segment"))
    t = s.select("depth", F.explode(F.transform(tokens(F.col("segment")), F.lower)).alias("token"))
    return t.where((F.length("token") >= 2) & literal(token_kind(F.col("token")))).groupBy("depth", "token").agg(F.count("*").alias("n"))


def close_tokens(found: DataFrame) -> DataFrame:
    """Pairs (a < b) at one depth with their score: one edit 2, two edits 1, prefix of up to three letters less 1 more; 2 at least.

    Two points need one edit, or two edits and a prefix. Tokens one edit apart share a token or one with a letter left out;
    a prefix two letters shorter is the token without its last two. So each token is joined by its length's number of keys.
    """
    t = F.col("token")
    size = F.length(t)
    without = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, size)))
    keys = F.array_distinct(F.concat(F.array(t), without, F.array(F.substring(t, F.lit(1), size - 2))))
    k = found.select("depth", "token", F.explode(keys).alias("key"))
    pairs = k.select("depth", F.col("token").alias("a"), "key").join(k.select("depth", F.col("token").alias("b"), "key"), ["depth", "key"]).where("a < b").select("a", "b").distinct()
    d, la, lb = F.levenshtein("a", "b"), F.length("a"), F.length("b")
    prefix = (F.least(la, lb) >= 3) & (F.startswith("a", F.col("b")) | F.startswith("b", F.col("a"))) & (F.abs(la - lb) <= 3)
    edits = F.when(d == 1, 2).when(d == 2, 1).otherwise(0)
    return pairs.withColumns({"edits": d, "prefix": prefix, "score": edits + F.when(prefix, 1).otherwise(0)}).where("score >= 2")


def synonyms(paths: DataFrame, path: str = "rel_path", least_paths: int = 30, top: int | None = 5) -> DataFrame:
    """short_form, canonical_form, score, confidence, reason: lexicon matches (3 points) and close tokens; equal lengths stand in order of the alphabet. None for fewer than least_paths paths."""
    found = depth_tokens(paths, path)
    known = F.create_map(*[F.lit(x) for kv in LEXICON.items() for x in kv])
    listed = found.where(F.col("token").isin(*LEXICON)).select("token").distinct().select(F.col("token").alias("short_form"), known[F.col("token")].alias("canonical_form"), F.lit(3).alias("score"), F.lit("Lexicon match").alias("reason"))
    close = close_tokens(found)
    b_first = F.length("b") < F.length("a")
    reason = F.concat_ws(", ", F.when(F.col("edits") <= 2, F.concat(F.lit("edit distance "), F.col("edits").cast("string"))), F.when(F.col("prefix"), "prefix match"))
    near = close.select(F.when(b_first, F.col("b")).otherwise(F.col("a")).alias("short_form"), F.when(b_first, F.col("a")).otherwise(F.col("b")).alias("canonical_form"), "score", reason.alias("reason"))
    lexical = F.create_map(*[F.lit(x) for kv in LEXICON.items() for x in kv])
    near = near.where(~((F.col("short_form") < F.col("canonical_form")) & lexical[F.col("short_form")].eqNullSafe(F.col("canonical_form"))))
    out = listed.unionByName(near).withColumn("confidence", F.when(F.col("score") >= 3, "high").otherwise("medium"))
    enough = paths.agg((F.count("*") >= least_paths).alias("enough"))
    out = out.crossJoin(F.broadcast(enough)).where("enough").drop("enough").orderBy(F.desc("score"), "short_form", "canonical_form")
    return out.limit(top) if top else out
