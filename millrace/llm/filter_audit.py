"""Filter interaction audit by min-plus removal ranks.

Which filters a document fails is a mask. A mask is a row of a matrix with 0 where a filter fails and infinity elsewhere; an
order of filters is a column of each filter's place in it (the inverse permutation). The min-plus product of the two gives
for every mask and order the step that removes the document. Documents are counted by part and mask before (partial sums, no
more than 2 to the number of filters for each part); the counts are the weights that each step's columns are scattered with.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import pick, read

#: Orders are all permutations; 8 filters have 40 320.
MOST_FILTERS = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Production limits of the query's filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
WHITE = "[\\x20\\x09-\\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on one text: few words, few distinct words, many capitals, symbols."""
    words = F.array_remove(F.split(text, WHITE), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def removal_steps(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Step (from 1) at which an order removes a mask's documents, or infinity: min-plus product of masks (m x f) and places (o x f)."""
    steps = np.full((len(masks), len(places)), np.inf)
    for f in range(masks.shape[1]):
        np.minimum(steps, masks[:, f, None] + places[None, :, f], out=steps)
    return steps


def audited(fails: np.ndarray, weights: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """For each order and step: COUNTS. fails (m x f, boolean), weights (m x 3: documents, good, toxic), orders (o x f: filter by step)."""
    n_orders, n = orders.shape
    places = np.argsort(orders, axis=1) + 1
    steps = removal_steps(np.where(fails, 0.0, np.inf), places)
    removed = np.zeros((3, n_orders, n + 2), np.int64)
    late = np.zeros((n_orders, n + 2), np.int64)
    at = np.where(np.isinf(steps), n + 1, steps).astype(np.int64)
    every = np.broadcast_to(np.arange(n_orders), at.shape)
    for k in range(3):
        np.add.at(removed[k], (every, at), np.broadcast_to(weights[:, k, None], at.shape))
    for f in range(n):
        own = np.broadcast_to(places[None, :, f], at.shape)
        passed = fails[:, f, None] & (at < own)
        np.add.at(late, (every, own), np.where(passed, weights[:, 0, None], 0))
    alone = np.array([weights[(fails.sum(axis=1) == 1) & fails[:, f], 0].sum() for f in range(n)])
    taken = removed[:, :, 1 : n + 1]
    worth = np.zeros(n, np.int64)
    np.add.at(worth, orders, taken[0])
    kept = weights[:, 0].sum() - np.cumsum(taken[0], axis=1)
    return np.stack([kept, taken[0], late[:, 1 : n + 1], alone[orders], taken[1], taken[2], worth[orders]], axis=2)


def counted_masks(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """part, mask (bit k: the k-th filter of A to E fails), n, good, toxic, the last three added up."""
    rows = pick(docs, doc_id=doc_id, text=text, part=part).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_filters(F.col("text")).values())]
    # Rows without an id find no label; the salt keeps them from meeting in one task.
    slim = rows.select("doc_id", "part", F.sha2("text", 256).alias("sha"), sum(bits[1:], bits[0]).alias("mask")).withColumn("salt", F.when(F.col("doc_id").isNull(), F.xxhash64("sha", F.monotonically_increasing_id())).otherwise(0))
    known = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy("doc_id")
    known = known.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    both = slim.join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"])
    # Copies of a text agree in all other filters: they are counted together by part and label, then the first id of all of them is found.
    once = both.groupBy("doc_id", "salt", "sha", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    copies = once.groupBy("sha", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"), least)
    # A text has a row for each of its parts and labels by now, so few rows meet in a window.
    first = F.min("least.doc_id").over(Window.partitionBy("sha"))
    later = F.col("with_id") - F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    two = F.array(F.struct(F.col("mask"), (F.col("n") - later).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), later.alias("n")))
    each = copies.withColumn("first", first).select("part", "good", "toxic", F.explode(two).alias("x")).where("x.n > 0")
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def audit_masks(masks: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step and COUNTS for every part, order and step. masks: part, mask, n, good, toxic, one row for each part and mask."""
    size = len(names)
    if size > MOST_FILTERS:
        raise ValueError(f"{math.factorial(size)} orders of {size} filters; at most {MOST_FILTERS} filters")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        orders = np.array(list(itertools.permutations(range(size))))
        fails = (rows["mask"].to_numpy()[:, None] >> np.arange(size)) & 1 > 0
        found = audited(fails, rows[["n", "good", "toxic"]].to_numpy(np.int64), orders).reshape(-1, len(COUNTS))
        named = np.repeat(["".join(names[f] for f in o) for o in orders], size)
        out = {"part": rows["part"].iloc[0], "filter_order": named, "step": np.tile(np.arange(1, size + 1, dtype=np.int32), len(orders))}
        return pd.DataFrame(out | {c: found[:, k] for k, c in enumerate(COUNTS)})

    return masks.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step and COUNTS: 600 rows for each value of `part`, for the filters A to E.

    A null text is empty, a null part the empty string. A row is identical to a former one (E) if its text is that of any row
    of a smaller id; rows without an id, and rows that repeat the least id, are not. A document is good or toxic if any of its
    labels says so; null labels say nothing. Repeated rows count each. An empty table gives an empty one; other columns are
    not read. Texts are judged whole; copies are found by SHA-256.
    """
    return audit_masks(counted_masks(docs, labels, doc_id, text, part), "ABCDE")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), marked as (
  select doc_id, part, coalesce((select max((quality = 1)::int) from labels l where l.doc_id = d.doc_id), 0) as good, coalesce((select max((toxic = 1)::int) from labels l where l.doc_id = d.doc_id), 0) as toxic,
    (len(words) < 100)::int as a, (100 * len(list_distinct(words)) < 80 * len(words))::int as b, (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int as c,
    regexp_matches(t, '[#$%&*|]')::int as d, coalesce(doc_id > min(doc_id) over (partition by t), false)::int as e
  from texts d
), masks as (
  select part, a, b, c, d, e, count(*) as n, sum(good) as good, sum(toxic) as toxic from marked group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x), orders as (
  select concat(p.x, q.x, r.x, s.x, t.x) as o from letters p, letters q, letters r, letters s, letters t where length(replace(translate('ABCDE', concat(p.x, q.x, r.x, s.x, t.x), ''), ' ', '')) = 0
), fails as (
  select m.*, f.x, case f.x when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as failed from masks m, letters f
), stepped as (
  select m.*, o, least(case when a = 1 then instr(o, 'A') else 9 end, case when b = 1 then instr(o, 'B') else 9 end, case when c = 1 then instr(o, 'C') else 9 end, case when d = 1 then instr(o, 'D') else 9 end, case when e = 1 then instr(o, 'E') else 9 end) as gone
  from masks m, orders
), rows as (
  select part, o, k, sum(case when gone > k then n else 0 end) as kept, sum(case when gone = k then n else 0 end) as removed,
    sum(case when gone < k and case substr(o, k, 1) when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end = 1 then n else 0 end) as redundant,
    sum(case when a + b + c + d + e = 1 and case substr(o, k, 1) when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end = 1 then n else 0 end) as unique_fails,
    sum(case when gone = k then good else 0 end) as good_lost, sum(case when gone = k then toxic else 0 end) as toxic_lost
  from stepped, (select unnest(range(1, 6)) as k) group by all
)
select part, o as filter_order, cast(k as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, substr(o, k, 1)) as bigint) as shapley
from rows
"""
