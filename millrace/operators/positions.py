"""Positions and running sums in any order, by prefix sums of two levels.

Rows are dealt out by ranges of the order and sorted within each; what each range holds is summed; the sums before a range
are what its rows' own positions are raised by. No task sees more than its range: rows that tie on the whole order are told
apart by their number in the input, so a common value is cut into ranges as any other.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.operators.staging import staged

#: Numbers of a partition's rows end here (monotonically_increasing_id).
_PART = 1 << 33


def ranged(df: DataFrame, order: list, weight: Column | None = None, ranges: int | None = None) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """df in order, staged, with _part, _at (row within the part, from 0) and _weight; and of each part its number, rows and weight.

    The list has an entry for each range that has rows: it grows with the number of ranges, never with the rows in one.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tied = df.withColumns({"_weight": F.lit(0).cast("long") if weight is None else weight.cast("long"), "_tie": F.monotonically_increasing_id()})
    dealt = tied.repartitionByRange(ranges, *keys, "_tie") if ranges else tied.repartitionByRange(*keys, "_tie")
    number = F.monotonically_increasing_id()
    out = staged(dealt.sortWithinPartitions(*keys, "_tie").drop("_tie").withColumn("_number", number), "ranged")
    out = out.withColumns({"_part": F.floor(F.col("_number") / _PART), "_at": F.col("_number") % _PART}).drop("_number")
    sums = out.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("w")).collect()
    return out, sorted((r._part, r.n, r.w) for r in sums)


def with_positions(df: DataFrame, order: list, position: str = "position", weight: Column | None = None, running: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with each row's position in an order (long, from 0), and with the sum of a weight up to and with it if `running` is named. Null weights count nothing."""
    rows, parts = ranged(df, order, None if weight is None else F.coalesce(weight, F.lit(0)), ranges)
    return placed(rows, parts, position, running)


def placed(rows: DataFrame, parts: list[tuple[int, int, int]], position: str, running: str | None) -> DataFrame:
    before = list(zip((p for p, _, _ in parts), itertools.accumulate([0, *(n for _, n, _ in parts)]), itertools.accumulate([0, *(w for _, _, w in parts)])))
    spark = rows.sparkSession
    starts = spark.createDataFrame(before, "_part long, _rows long, _sum long") if before else spark.createDataFrame([], "_part long, _rows long, _sum long")
    out = rows.join(F.broadcast(starts), "_part").withColumn(position, F.col("_rows") + F.col("_at"))
    if running:
        out = out.withColumn(running, F.col("_sum") + F.sum("_weight").over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)))
    return out.drop("_part", "_at", "_weight", "_rows", "_sum")


def with_group(rows: DataFrame, keys: list[str], sums: dict[str, Column], share: int = 256) -> DataFrame:
    """rows (staged, or cheap to read twice) with aggregates of their keys' groups, null keys as one value. Groups with more than a `share`th of all rows are fewer than that, and broadcast; no task gets all rows of a large one."""
    own = [f"_own{k}" for k in range(len(keys))]
    per = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)]).agg(F.count(F.lit(1)).alias("_size_of_group"), *[c.alias(n) for n, c in sums.items()])
    many = F.broadcast(per.where(F.col("_size_of_group") * share > rows.count()))
    same = F.lit(True)
    for k, o in zip(keys, own):
        same = same & F.col(k).eqNullSafe(F.col(o))
    rest = rows.join(many.select(*own), same, "left_anti")
    return rows.join(many, same).unionByName(rest.join(per, same)).drop(*own, "_size_of_group")


def with_row_index(df: DataFrame, order: list, index: str = "_output_row_index") -> DataFrame:
    """df with the position of each row in its whole output."""
    return with_positions(df, order, index)


def text_bytes(df: DataFrame) -> Column:
    """UTF-8 bytes of a row as text, a null column as none."""
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns), F.lit(0).cast("long"))


def budgeted(df: DataFrame, order: list, max_rows: int, max_bytes: int, size: Column | None = None) -> DataFrame:
    """The first rows of an order that keep within max_rows and within max_bytes (of text_bytes, or of `size`), with position, running_bytes, and `truncated`: whether rows were left out.

    Only ranges that begin within the budget are read again; a first row that is larger than the budget gives no rows.
    """
    if max_rows < 0 or max_bytes < 0:
        raise ValueError("a budget is not negative")
    rows, parts = ranged(df, order, text_bytes(df) if size is None else F.coalesce(size, F.lit(0)))
    total_rows, total_bytes = sum(n for _, n, _ in parts), sum(w for _, _, w in parts)
    reach, n, w = [], 0, 0
    for part, more, weight in parts:
        if n < max_rows and w <= max_bytes:
            reach.append(part)
        n, w = n + more, w + weight
    first = rows.where(F.col("_part") <= (reach[-1] if reach else -1))
    out = placed(first, parts, "position", "running_bytes").where((F.col("position") < max_rows) & (F.col("running_bytes") <= max_bytes))
    return out.withColumn("truncated", F.lit(total_rows > max_rows or total_bytes > max_bytes))


def page(df: DataFrame, order: list, start: int, size: int) -> DataFrame:
    """Rows start .. start + size - 1 of an order, with `position` and the cursor of the next page (null on the last).

    Ranges beside the page are counted, not numbered, so a late page costs what the first does.
    """
    rows, parts = ranged(df, order)
    ends = list(itertools.accumulate(n for _, n, _ in parts))
    touched = [p for (p, n, _), end in zip(parts, ends) if end > start and end - n < start + size]
    some = rows.where(F.col("_part").between(touched[0], touched[-1]) if touched else F.lit(False))
    out = placed(some, parts, "position", None).where(F.col("position").between(start, start + size - 1))
    more = bool(ends) and ends[-1] > start + size
    return out.withColumn("next_cursor", F.lit(start + size if more else None).cast("long"))
