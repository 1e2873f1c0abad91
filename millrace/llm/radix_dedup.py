"""Exact deduplication by most-significant-digit radix partitioning.

All texts start in one group. Round after round a group is split by its texts' next bytes (the first digit is the length,
then come 64 bytes, then sixteen times as many up to a mebibyte a round), counted with partial aggregation. A row whose
group has no other is done; so is a group whose texts have ended, as its rows agree on length and on every byte. Equality
is thus that of the bytes themselves; no digest takes part in it. Only rows of groups that go on are written for the next
round, with what is left of their texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pick, read, stage, unstage

#: Bytes of the first digit after the length, how they grow by round, and their most.
FIRST, GROWTH, MOST = 64, 16, 1 << 20
#: A group with more than this share of the rows is met by broadcast; there are fewer of those than its inverse, and their digits together stay below HOT_BYTES.
HOT_SHARE, HOT_BYTES = 1 / 256, 32 << 20
WHITE = "[\\x20\\x09-\\x0D]+"


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, most: int) -> DataFrame:
    """rows with the columns of groups, by a left join on keys whose groups have distinct keys. Groups of at least `most` rows (few, as all rows are only so many) are broadcast, so no task gets all rows of a large one."""
    more = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(n) >= most).select(*keys, *[F.col(c).alias(f"hot_{c}") for c in more])
    # One plan at every size: small tables are not broadcast where large ones are not.
    cold = groups.where(F.col(n) < most).hint("merge")
    known = rows.join(F.broadcast(hot), keys, "left")
    # Rows of hot groups need no partner any more and are dealt out by their number.
    spread = F.when(F.col(f"hot_{n}").isNull(), 0).otherwise(1 + F.pmod("row", F.lit(1 << 20)))
    both = known.withColumn("spread", spread).join(cold.withColumn("spread", F.lit(0).cast(rows.schema["row"].dataType)), [*keys, "spread"], "left")
    return both.select(*rows.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in more])


def equal_groups(rows: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """`carry`, row (a number of its own for each row), round and name (together the group's), group_size (long): one row for each of rows.

    Texts (binary) are equal if they have the same bytes. Rounds end when no group goes on: after the longest text that two rows share.
    """
    first = rows.select(*carry, F.col(text).alias("rest"), F.length(text).cast("long").alias("left")).withColumn("row", F.monotonically_increasing_id())
    keys = ["name", "left", "digit"]
    active = first.withColumn("name", F.lit(0).cast("long"))
    total, width, done, k = rows.count(), FIRST, [], 0
    while True:
        split = active.select("*", F.substring("rest", 1, width).alias("digit"))
        counts = stage(split.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("next")).where("n > 1"), "radix-counts")
        share = max(HOT_SHARE, width / HOT_BYTES)
        met = meet(split, counts, keys, "n", max(2, int(total * share)))
        ends = F.col("n").isNull() | (F.col("left") <= width)
        gone = F.when(~ends, F.expr(f"substring(rest, {width + 1})"))
        out = stage(
            met.select(*carry, "row", F.coalesce("next", "row").alias("name"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), ends.alias("ended"), (F.col("left") - width).alias("left"), gone.alias("rest")),
            "radix-rows",
        )
        unstage(counts)
        done.append(out.where("ended").select(*carry, "row", F.lit(k).alias("round"), "name", "group_size"))
        active = out.where("not ended").select(*carry, "row", "name", "left", "rest")
        if active.isEmpty():
            return reduce(DataFrame.unionAll, done)
        # Rows that are done stay in this table; what goes on is read from it in the next round.
        width, k = min(width * GROWTH, MOST), k + 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", white: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    A null text is empty, and empty texts are equal to one another; with `white`, runs of white space count as one space. Of
    equal texts the row of the least doc_id stays, a row without an id last; of rows that repeat the id, one stays. An empty
    table gives an empty one; other columns are not read. Texts are compared whole, whatever their length.
    """
    whole = normalised(F.col("text")) if white else F.coalesce("text", F.lit(""))
    texts = pick(docs, doc_id=doc_id, text=text).select("doc_id", whole.alias("text"))
    slim = equal_groups(texts.select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("bytes")), "bytes", ["doc_id", "sha"])
    alone = slim.where("group_size = 1")
    groups = slim.where("group_size > 1")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("at"))).alias("least")
    named = groups.groupBy("round", "name", "group_size").agg(least).select("round", "name", "group_size", "least", F.col("group_size").alias("n"))
    met = meet(groups, named.drop("group_size"), ["round", "name"], "n", max(2, int(slim.count() * HOT_SHARE)))
    one = alone.select("doc_id", F.col("doc_id").alias("keep_id"), "group_size", F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    more = met.select("doc_id", F.col("least.id").alias("keep_id"), "group_size", (F.col("row") == F.col("least.at")).alias("kept"), F.col("sha").alias("text_sha256"))
    return one.unionAll(more)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from texts window w as (partition by t)
"""
