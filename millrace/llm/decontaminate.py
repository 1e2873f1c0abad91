"""Benchmark decontamination with DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one window). Every place of a window in a document
holds one of the document's chunks of GRAM words that start at a multiple of WINDOW - GRAM + 1, so each document hashes
only those chunks and looks them up in the set of hashes of the benchmark's runs of GRAM words. Only around a hit are
whole windows cut out, compared as text with the benchmark's, and their words counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import NOT_ALNUM, numbered, pick, read, stage

WINDOW = 13
#: Of a benchmark's distinct runs, so many at most become a set inside the plan (16 bytes each); a larger benchmark is joined.
MAX_SET = 100_000
#: A table of so many windows at most is broadcast (about 100 bytes each).
MAX_BROADCAST = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def empty(kind: str = "int") -> Column:
    return F.array().cast(f"array<{kind}>")


def spaced(text: str | Column) -> Column:
    """Words of a text with single spaces between, case as it is."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_ALNUM.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60"), " "))


def word_array(joined: Column) -> Column:
    return F.when(joined == "", empty("string")).otherwise(F.split(joined, " "))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hashed(words: Column, start: Column, n: int) -> Column:
    """Hash of n words from a 0-based start, after full lower-casing: equal for all words that A-Z lower-casing makes equal."""
    return F.xxhash64(F.array_join(F.slice(words, start + 1, n), " "))


def starts(n_words: Column, n: int, step: int = 1) -> Column:
    return F.when(n_words >= n, F.sequence(F.lit(0), n_words - n, F.lit(step))).otherwise(empty())


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """item_id, w (the window's words, A-Z lower-cased, spaces between), size; distinct."""
    words = items.select("item_id", word_array(ascii_lower(spaced(F.col("text")))).alias("words"))
    words = words.withColumn("size", F.least(F.size("words"), F.lit(window))).where("size > 0")
    each = words.select("item_id", "words", "size", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at"))
    return each.select("item_id", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("w"), "size").distinct()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_set: int = MAX_SET
) -> DataFrame:
    """For every row of docs: n_words, n_hit, n_items, items_sha256, contaminated, item_ids (sorted as strings) and spans (hit word ranges, end exclusive).

    A null or empty text has no words and is clean; an item without words has no window; a null item id is named "null".
    Null document ids and repeated rows give a row each, repeated rows with equal results. An empty table of either side
    gives clean rows or none. Other columns are not read. Equal windows of several items count for each of them.
    """
    if not 0 < window < 16:
        raise ValueError("a window has 1 to 15 words")
    items = pick(benchmark, item_id=item_id, text=item_text).withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null")))
    bench = stage(windows_of(items, window), "windows")
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most `window` rows
    base = pick(docs, doc_id=doc_id, text=text)
    base = base.withColumn("hash", F.xxhash64("text")).withColumn("joined", spaced(F.col("text")))
    base = base.withColumn("words", word_array(F.lower("joined"))).withColumn("n", F.size("words"))
    found = base.withColumn("p", empty())
    for size in sizes:
        gram = (size + 1) // 2
        step = size - gram + 1
        own = bench.where(F.col("size") == size).select(word_array(F.lower("w")).alias("words"))
        own = own.select(F.explode(F.transform(starts(F.size("words"), gram), lambda i: hashed(F.col("words"), i, gram))).alias("h")).distinct()
        chunk = f"xxhash64(array_join(slice(words, i + 1, {gram}), ' '))"
        found = found.withColumn("starts", starts(F.col("n"), gram, step))
        if (rows := own.limit(max_set + 1).collect()) and len(rows) <= max_set:
            found = found.withColumn("hits", F.expr(f"filter(starts, i -> {chunk} in ({', '.join(f"{r['h']}L" for r in rows)}))"))
        else:
            spread = base.withColumn("starts", starts(F.col("n"), gram, step))
            spread = spread.select("doc_id", "hash", F.explode(F.expr(f"transform(starts, i -> struct(i, {chunk} as h))")).alias("x")).select("doc_id", "hash", "x.*")
            spread = spread.join(own, "h").groupBy("doc_id", "hash").agg(F.collect_set("i").alias("hits"))
            spread = spread.select(F.col("doc_id").alias("d"), F.col("hash").alias("g"), "hits")
            found = found.join(spread, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("hash").eqNullSafe(F.col("g")), "left").withColumn("hits", F.coalesce("hits", empty())).drop("d", "g")
        # Windows that hold a hit chunk start at most step - 1 words before it.
        around = F.flatten(F.transform("hits", lambda i: F.sequence(F.greatest(i - step + 1, F.lit(0)), i)))
        kept = F.array_distinct(F.filter(around, lambda i: i <= F.col("n") - size))
        found = found.withColumn("p", F.concat("p", F.transform(kept, lambda i: i * 16 + size))).drop("hits", "starts")
    found = found.withColumn("exact", F.when(F.size("p") > 0, word_array(ascii_lower(F.col("joined")))))
    places = F.expr("transform(p, p -> struct(p div 16 as start, p % 16 as size, array_join(slice(exact, int(p div 16) + 1, p % 16), ' ') as w))")
    scan = found.select("doc_id", "hash", F.col("n").cast("long").alias("n_words"), F.when(F.size("p") > 0, places).alias("places"))
    scan = stage(scan, "decontaminate")
    small = bench.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    each = scan.where("places is not null").select("doc_id", "hash", F.explode("places").alias("x")).select("doc_id", "hash", "x.*").distinct()
    hits = each.join(F.broadcast(bench) if small else bench, ["w", "size"])
    per = hits.groupBy("doc_id", "hash").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    per = per.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), "spans", "item_ids")
    out = scan.select("doc_id", "hash", "n_words").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    # Spans stand by start; what a span adds are its words beyond the furthest end so far.
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["start"]), F.lit(0).cast("long"))).alias("n")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_hit", F.coalesce(n_hit, F.lit(0).cast("long"))).withColumn("item_ids", F.coalesce("item_ids", empty("string")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "item_ids", F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)).alias("spans"), "hash",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of docs that decontaminate does not call contaminated, with all their columns; cases as there."""
    bad = decontaminate(docs, benchmark, doc_id, text, **names).where("contaminated").select(F.col("doc_id").alias("id"), "hash").distinct()
    flat, at = numbered(docs)
    kept = flat.join(bad, F.col(at[doc_id]).eqNullSafe(F.col("id")) & (F.xxhash64(at[text]) == F.col("hash")), "left_anti")
    return kept.toDF(*docs.columns)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_ids", "spans", "hash")


OP10_SQL = r"""
with items as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), sized as (
  select *, least(len(words), 13) as size from items where len(words) > 0
), windows as (
  select distinct item_id, size, array_to_string(words[i:i + size - 1], ' ') as w from (select *, unnest(range(1, len(words) - size + 2)) as i from sized)
), docs as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), places as (
  select row, size, i, array_to_string(words[i:i + size - 1], ' ') as w
  from (select d.*, s.size, unnest(range(1, len(words) - s.size + 2)) as i from docs d, (select distinct size from windows) s)
), hits as (
  select p.row, p.i, p.size, w.item_id from places p join windows w using (size, w)
), covered as (
  select row, count(distinct k) as n_hit from (select row, unnest(range(i, i + size)) as k from hits) group by row
), named as (
  select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct row, item_id from hits) group by row
)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from docs left join covered using (row) left join named using (row)
"""
